"""BPE encoding by a streaming transducer with bounded lookahead; decoding by an incremental byte-to-text machine.

Whether two neighbouring bytes end up in one token depends on text further right only through a chain of merges, each of a
lower rank than the one before and beginning at a piece that ends the one before. The longest such chain of a merge list,
in bytes, is its sufficient lookahead: a token that ends at least so far before the end of what has been read is stable.
The transducer holds a piece of a pre-token of about that size, emits tokens once they are stable, and goes on from there,
so its memory doesn't grow with the text. Every id comes out of it; what it gave for short words between spaces and for
short pre-tokens is remembered, up to a number of them.

Text becomes pre-tokens as the tokenizers library makes them: special tokens in the text as they stand, NFC, lower case,
white space dropped. Texts are read in pieces of bounded size, cut at spaces; a longer word is a stream, which is brought
into NFC and parted as it comes, cut where no character acts on the one before. What a piece gives goes to the decoder and
the digests before the next is read.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import importable
from tidemark.llm.words import Words, groups, pieces

#: Fixed value: how files of this kind part a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
NONE = 1 << 60


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


def lowers(path: str) -> bool:
    """Whether a tokenizer file is of the kind of this module."""
    try:
        PreTokens(path)
    except (ValueError, KeyError, TypeError):
        return False
    return True


class PreTokens:
    """What a tokenizer file says of normalizing and splitting, in the terms of this module; other files are refused."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        steps = [x["type"] for x in self.file["normalizer"]["normalizers"]]
        split = self.file["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or self.file["decoder"] or not split["invert"] or split["behavior"] != "Removed" or split["pattern"].get("Regex") != PATTERN:
            raise ValueError(f"{path} isn't a file of this kind")
        self.pattern = regex.compile(PATTERN)
        self.special = {x["content"]: x["id"] for x in self.file["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.known, self.library = set(), None

    def settled(self, text: str) -> bool:
        """Whether all characters are ones that every Unicode version in use here knows."""
        if text.isascii():
            return True
        new = set(text) - self.known
        if any(unicodedata.category(c) == "Cn" for c in new):
            return False
        self.known |= new
        return True

    def low(self, text: str) -> str | None:
        """A text as it is split: in NFC and lower case, letter by letter; null if the library has to be asked for it."""
        if not self.settled(text):
            return None
        return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()

    def asked(self, text: str) -> list[str]:
        """Pre-tokens of a text by the library, for characters that not every Unicode version knows."""
        if not self.library:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> Iterator[str | int]:
        """Special tokens' ids and the texts between them, in order."""
        for part in self.parts.split(text) if "<|" in text else [text]:
            if part:
                yield self.special.get(part, part)


class Merges:
    """A merge list over byte-level symbols with word ends."""

    def __init__(self, model: dict):
        vocab, letters = model["vocab"], byte_letters()
        self.inner, self.final = [vocab[x] for x in letters], [vocab[x + END] for x in letters]
        text = {i: x for x, i in vocab.items()}
        self.size = {i: len(x.removesuffix(END)) for i, x in text.items()}
        self.rank, self.made, right = {}, [], {}
        for a, b in (x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            pair, new = (vocab[a], vocab[b]), vocab[a + b]
            if pair not in self.rank:
                self.rank[pair] = len(self.made)
            self.made.append(new)
            right.setdefault(new, set()).add(vocab[b])
        self.lookahead = self.sufficient(right)

    def sufficient(self, right: dict[int, set[int]]) -> int:
        """The longest chain of merges, in bytes, each beginning at a piece that ends the one before, in falling rank."""
        tails: dict[int, set[int]] = {}

        def tail(x: int) -> set[int]:
            if x not in tails:
                tails[x] = {x}.union(*(tail(y) for y in right.get(x, ())))
            return tails[x]

        reach: dict[int, int] = {}
        for a, b in self.rank:  # from the lowest rank on
            reach[a] = max(reach.get(a, 0), self.size[b] + max(reach.get(x, 0) for x in tail(b)))
        return max(reach.values(), default=0)

    def merged(self, ids: list[int]) -> list[int]:
        """Always the leftmost pair of the lowest rank."""
        rank, made = self.rank, self.made
        ranks = list(map(rank.get, zip(ids, ids[1:], strict=False), repeat(NONE)))
        while ranks and (low := min(ranks)) < NONE:
            i = ranks.index(low)
            ids[i : i + 2] = [made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), NONE)
        return ids


class Transducer:
    """Takes the bytes of one pre-token in pieces of any size and gives tokens once they are stable."""

    BLOCK = 192

    def __init__(self, merges: Merges):
        self.merges, self.held, self.most = merges, b"", merges.lookahead + self.BLOCK

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.BLOCK):
            self.held += data[at : at + self.BLOCK]
            if len(self.held) > self.most:
                end, stable = 0, len(self.held) - self.merges.lookahead
                for token in self.merges.merged([self.merges.inner[b] for b in self.held]):
                    if end + self.merges.size[token] > stable:
                        break
                    end += self.merges.size[token]
                    yield token
                self.held = self.held[end:]

    def finish(self) -> list[int]:
        held, self.held = self.held, b""
        return self.merges.merged([*(self.merges.inner[b] for b in held[:-1]), self.merges.final[held[-1]]]) if held else []


class Stream:
    """Takes the text of one word in pieces of any size and gives ids once they are stable.

    Of the text it holds what isn't in NFC for sure yet: from the last character on before which a text may be cut, which is
    any but marks and the Hangul letters that join the one before, and what could be the beginning of a special token. Of the
    text in NFC it holds an apostrophe at the end, as what follows may make it a contraction.
    """

    LETTERS, MARKS = regex.compile(r"\p{L}+"), regex.compile(r"[^\s\p{L}\p{N}]+")

    def __init__(self, pre: PreTokens, merges: Merges):
        self.pre, self.transducer = pre, Transducer(merges)
        self.raw, self.low, self.open = "", "", None
        self.longest = max(map(len, pre.special), default=1)

    @staticmethod
    def joins(c: str) -> bool:
        return unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff"

    def feed(self, text: str) -> Iterator[int]:
        self.raw += text
        while True:
            found = self.pre.parts.search(self.raw)
            if found:
                yield from self.parted(self.raw[: found.start()], True)
                yield self.pre.special[found[0]]
                self.raw = self.raw[found.end() :]
                continue
            end = len(self.raw) - self.longest
            while end > 0 and self.joins(self.raw[end]):
                end -= 1
            if end > 0:
                yield from self.parted(self.raw[:end], False)
                self.raw = self.raw[end:]
            return

    def finish(self) -> Iterator[int]:
        yield from self.parted(self.raw, True)
        self.raw = ""

    def parted(self, text: str, last: bool) -> Iterator[int]:
        """Ids of the pre-tokens of a text of which more comes unless it is the last."""
        low, at = self.low + self.pre.low(text), 0
        self.low = ""
        if self.open and low:
            more = self.open.match(low)
            if more:
                at = more.end()
                yield from self.transducer.feed(more[0].encode())
            if at < len(low):
                yield from self.transducer.finish()
                self.open = None
        for found in self.pre.pattern.finditer(low, at):
            if not last and found[0][0] == "'" and len(low) - found.start() < 3:
                self.low = low[found.start() :]
                return
            yield from self.transducer.feed(found[0].encode())
            if found.end() == len(low):
                self.open = next((x for x in (self.LETTERS, self.MARKS) if x.fullmatch(found[0])), None)
                if self.open:
                    break
            yield from self.transducer.finish()
        if last:
            yield from self.transducer.finish()
            self.open = None


class Memory(dict):
    """word -> ids of short words, of two generations: when the young one is full it becomes the old one, from which words come back."""

    LIMIT, LONGEST = 120_000, 48

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = self.compute(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts, as arrays of unsigned integers."""

    LONG = 4096  # characters of a word from which on it is a stream
    BLOCK = 1 << 16

    def __init__(self, path: str):
        self.pre = PreTokens(path)
        self.merges = Merges(self.pre.file["model"])
        self.kind = np.dtype("<u2" if max(*self.merges.size, *self.pre.special.values()) < 1 << 16 else "<u4")
        self.memory = Memory(self.token)
        self.words = Words(self.learn, self.kind, True)

    def learn(self, words: pa.Array) -> pa.Array:
        return pa.array([np.fromiter(chain.from_iterable(self.word(w)), self.kind).tobytes() for w in words.to_pylist()], pa.binary())

    def token(self, token: str) -> tuple[int, ...]:
        """Ids of a pre-token."""
        t = Transducer(self.merges)
        return (*t.feed(token.encode()), *t.finish())

    def word(self, word: str) -> Iterator[Iterable[int]]:
        """Ids of a text that is read whole, as are all but words that are long and of characters that every Unicode version knows."""
        if len(word) > self.LONG and self.pre.settled(word):
            stream = Stream(self.pre, self.merges)
            for at in range(0, len(word), self.LONG):
                yield stream.feed(word[at : at + self.LONG])
            yield stream.finish()
            return
        for piece in self.pre.pieces(word):
            if isinstance(piece, int):
                yield (piece,)
            else:
                low = self.pre.low(piece)
                yield from map(self.memory.__getitem__, self.pre.asked(piece) if low is None else self.pre.pattern.findall(low))

    def long(self, text: str, most: int) -> Iterator[np.ndarray]:
        """Ids of a long text, piece by piece."""
        for piece in pieces(text, most):
            if len(piece) <= most:
                yield self.words(pa.array([piece]))[0]
            else:
                ids = chain.from_iterable(self.word(piece))
                while len(block := np.fromiter(islice(ids, self.BLOCK), self.kind)):
                    yield block

    def __call__(self, text: str | None) -> list[int]:
        return np.concatenate([np.empty(0, self.kind), *self.long(text or "", 1 << 20)]).tolist()


class Decoder:
    """Bytes of token after token to text; bytes of a character that isn't complete yet are its state.

    spelled: tokens as the vocabulary spells them with a space between, which is what a file without decoder asks for;
    otherwise the text that the tokens stand for, a space at each word's end.
    """

    def __init__(self, table: list[bytes]):
        self.table, self.state, self.begun = table, codecs.getincrementaldecoder("utf-8")("replace"), False

    @staticmethod
    def tables(file: dict, spelled: bool) -> list[bytes]:
        """The bytes of each id."""
        names = {i: x for x, i in file["model"]["vocab"].items()}
        special = {x["id"]: x["content"] for x in file["added_tokens"]}
        value = {x: i for i, x in enumerate(byte_letters())}
        table = [b""] * (max(*names, *special) + 1)
        for i, x in names.items():
            table[i] = b" " + x.encode() if spelled else bytes(value[c] for c in x.removesuffix(END)) + b" " * x.endswith(END)
        for i, x in special.items():
            table[i] = b" " * spelled + x.encode()
        return table

    def feed(self, ids: Iterable[int]) -> str:
        return self.take(b"".join(map(self.table.__getitem__, ids)))

    def take(self, data: bytes) -> str:
        """The text of the bytes of the next tokens."""
        out = self.state.decode(data)
        if not self.begun and out:
            self.begun, out = True, out.removeprefix(" ")
        return out

    def finish(self) -> str:
        return self.state.decode(b"", True)


class Spelled:
    """What each id stands for, gathered for many ids at once."""

    def __init__(self, table: list[bytes]):
        self.table = pa.array(table, pa.binary())

    def __call__(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """(the bytes of all ids side by side, where each one begins, and the end)."""
        taken = self.table.take(pa.array(ids))
        at = np.frombuffer(taken.buffers()[1], np.int32, len(ids) + 1)
        return memoryview(taken.buffers()[2] or b"")[: at[-1]], at


class Outcome:
    """What is asked of one text, from its ids as they come."""

    def __init__(self, outputs: list[str], table: list[bytes]):
        self.n, self.ids, self.texts, self.outputs = 0, [], [], outputs
        self.decimal, self.decoded, self.machine = sha256(), sha256(), Decoder(table)

    def told(self, text: str) -> None:
        self.decoded.update(text.encode())
        if "decoded" in self.outputs:
            self.texts.append(text)

    def add(self, ids: np.ndarray, decimal: memoryview | None, spelled: memoryview | None) -> None:
        if decimal is not None and len(ids):
            self.decimal.update(decimal if self.n else decimal[1:])  # no space before the first
        self.n += len(ids)
        if "ids" in self.outputs:
            self.ids += ids.tolist()
        if spelled is not None:
            for at in range(0, len(spelled), Encoder.BLOCK):
                self.told(self.machine.take(bytes(spelled[at : at + Encoder.BLOCK])))

    def values(self) -> dict:
        self.told(self.machine.finish())
        return {"n_tokens": self.n, "ids": self.ids, "decoded": "".join(self.texts), "ids_sha256": self.decimal.hexdigest(), "decoded_sha256": self.decoded.hexdigest()}


COLUMNS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
KINDS = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
LOADED: dict[str, tuple[Encoder, list[bytes], Spelled, Spelled]] = {}


def loaded(path: str) -> tuple[Encoder, list[bytes], Spelled, Spelled]:
    """One encoder for each file in a worker, kept from task to task, its tokens' bytes and decimal numbers."""
    if path not in LOADED:
        encoder = Encoder(path)
        table = Decoder.tables(encoder.pre.file, True)
        LOADED[path] = encoder, table, Spelled(table), Spelled([b" %d" % i for i in range(len(table))])
    return LOADED[path]


def outcomes(texts: pa.Array, path: str, outputs: list[str], most: int) -> Iterator[Outcome]:
    """The outcome of each text; neighbouring texts of at most so many bytes are read at once, longer ones in pieces."""
    encoder, table, spelled, decimal = loaded(path)
    no = lambda ids: (None, np.zeros(len(ids) + 1, np.int32))
    spell, number = (spelled if any(x.startswith("decoded") for x in outputs) else no), (decimal if "ids_sha256" in outputs else no)
    for at, n in groups(texts, most):
        if n == 1:
            out = Outcome(outputs, table)
            for ids in encoder.long(texts[at].as_py() or "", most):
                out.add(ids, number(ids)[0], spell(ids)[0])
            yield out
            continue
        ids, ends = encoder.words(texts.slice(at, n))
        (d, d_at), (s, s_at) = number(ids), spell(ids)
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out = Outcome(outputs, table)
            out.add(ids[a:b], d and d[d_at[a] : d_at[b]], s and s[s_at[a] : s_at[b]])
            yield out


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", outputs: Iterable[str] = ("n_tokens", "ids"), keep: Iterable[str] = ("doc_id",), most: int = 4 << 20) -> DataFrame:
    """The columns keep of docs, and of each whole text: n_tokens, ids, decoded (the ids decoded again), ids_sha256 (of the
    decimal ids joined by a space) and decoded_sha256, as outputs names them.

    path is a tokenizer file that every executor can open. Null and empty texts and texts of white space have no ids and
    decode to an empty text. Rows that repeat, null ids and other columns make no difference. Beside a text itself, and its
    ids or decoded text where these are asked for, about 40 times most (4 MB) bytes are held, however long it is, unless a
    word longer than that has characters that Python's Unicode version doesn't know: the library parts it, whole.
    """
    importable(docs.sparkSession)
    outputs, keep = list(outputs), list(keep)
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                own = batch.slice(at, 4000)
                values = [x.values() for x in outcomes(own.column(0), path, outputs, most)]
                yield pa.RecordBatch.from_arrays([*own.columns[1:], *(pa.array([v[x] for v in values], KINDS[COLUMNS[x]]) for x in outputs)], names=[*names, *outputs])

    chosen = docs.select(F.col(text_col).cast("string").alias("t"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))
    schema = ", ".join([*(f"{n} {chosen.schema[n].dataType.simpleString()}" for n in names), *(f"{x} {COLUMNS[x]}" for x in outputs)])
    return chosen.mapInArrow(run, schema).toDF(*keep, *outputs)
