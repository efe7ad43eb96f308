import random
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.bpe import Decoder, Encoder, Merges, Stream, Transducer, encode_documents

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", " \t\n", "Hello <|endoftext|> it's Σίσυφος İ H̱x <|startoftext|>", "͸՘a", "don't 123 x́y ﬁ ½  z\x1cq\x85w", "'''s''t", "é" * 5000, "ab" * 9000, "!?" * 4000, "中文字" * 700, " x y", "🙂👍🏽 ok"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def test_equals_the_library(encoder, library):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["the ", "in", "gan", "'s", "É", "\n", "$", "7", "x"]) for _ in range(rng.randint(1, 400))) for _ in range(200)]
    tables = {spelled: Decoder.tables(encoder.pre.file, spelled) for spelled in (True, False)}
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder(text) == ids
        machine = Decoder(tables[True])
        assert "".join(machine.feed([i]) for i in ids) + machine.finish() == library.decode(ids, skip_special_tokens=False)
        assert set().union(encoder(text)) == set(ids)
    machine = Decoder(tables[False])
    ids = encoder("Wörld 🙂 it's")
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == "wörld 🙂 it 's "


def test_tokens_are_stable_whatever_the_pieces(encoder):
    rng = random.Random(4)
    for alphabet in ("ab", "aeth", "ingrhe", "!?."):
        word = "".join(rng.choice(alphabet) for _ in range(4000)).encode()
        whole = encoder.merges.merged([*(encoder.merges.inner[b] for b in word[:-1]), encoder.merges.final[word[-1]]])
        t, got, at, most = Transducer(encoder.merges), [], 0, 0
        while at < len(word):
            n = rng.randint(1, 300)
            got += t.feed(word[at : at + n])
            at, most = at + n, max(most, len(t.held))
        assert got + t.finish() == whole
        assert most <= t.most + Transducer.BLOCK


def test_lookahead_of_a_small_list():
    """a b, then c after that only if b isn't taken: deciding about ab needs what follows b."""
    from tidemark.llm.bpe import END, byte_letters

    letters = [*byte_letters(), *(x + END for x in byte_letters())]
    model = {"vocab": {x: i for i, x in enumerate([*letters, "cd", "bc", "ab"])}, "merges": ["c d", "b c", "a b"]}
    assert Merges(model).lookahead == 3


def test_documents(spark, library):
    texts = [*ODD, None, "The and the", "The and the"]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted(encode_documents(docs, PATH, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256", "decoded")).collect(), key=repr)
    expected = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((None if i == 3 else i, len(ids), ids, sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest(), text))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert encode_documents(docs.limit(0), PATH).collect() == []


PARTS = ["the", "In", "gan", "'s", "'", "'LL", "É", "é", "e\u0301", "\u0327\u0301", "\uac00\u11a8", "\u1100\u1161\u11a8", "$", "!", "7", "\xa0", "\x85", "\x1c", "\t", "İ", "ß", "Σ", "<|endoftext|>", "<|", "|>", "²", "中", "H̱", "ﬁ", "🙂", "क\u094d", "া"]


def test_streams_of_words_without_spaces(encoder, library):
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 90)))
        stream, got, at = Stream(encoder.pre, encoder.merges), [], 0
        while at < len(text):
            n = rng.randint(1, 40)
            got += stream.feed(text[at : at + n])
            at += n
        assert [*got, *stream.finish()] == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_texts_of_many_scripts_word_by_word(encoder, library):
    rng = random.Random(9)
    for some in (PARTS + [" ", "\n"], [x for x in PARTS if max(x) < "\u0250"] + [" ", "\n", "\r\n"]):
        for _ in range(300):
            text = "".join(rng.choice(some) for _ in range(rng.randint(1, 60)))
            assert encoder(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("unit", ["abcdefgh", "!?'", "é ", "ther and\n", "'s7"])
def test_long_texts_are_held_in_bounded_pieces(encoder, library, monkeypatch, unit):
    """What is held between pieces doesn't grow with the text, with white space or without, and no pre-token bypasses the transducer."""
    text, most, fed = unit * (400_000 // len(unit)), [0, 0], [0]
    feed, add = Stream.parted, Transducer.feed

    def parted(self, *a):
        yield from feed(self, *a)
        most[0] = max(most[0], len(self.raw) + len(self.low) + len(self.transducer.held))

    def watched(self, data):
        for x in add(self, data):
            yield x
            most[1] = max(most[1], len(self.held))
        fed[0] += len(data)

    monkeypatch.setattr(Stream, "parted", parted)
    monkeypatch.setattr(Transducer, "feed", watched)
    encoder.memory.clear(), encoder.memory.old.clear(), encoder.words.forget()
    blocks = [len(b) for b in encoder.long(text, 20_000)]
    ids = library.encode(text, add_special_tokens=False).ids
    assert sum(blocks) == len(ids) and max(blocks) <= 1 << 16 and encoder(text) == ids
    assert max(most) < 6000 and fed[0] > 0


def test_outcomes_in_pieces_equal_whole_ones(library):
    import pyarrow as pa

    texts = [*ODD, "ther and\n" * 900, "x" * 9000 + " 'll " + "é!" * 3000, None, "a b"]
    for most in (64, 5000, 1 << 22):
        got = [x.values() for x in bpe.outcomes(pa.array(texts, pa.string()), PATH, list(bpe.COLUMNS), most)]
        for t, x in zip(texts, got, strict=True):
            ids = library.encode(t or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            assert x == {"n_tokens": len(ids), "ids": ids, "decoded": text, "ids_sha256": sha256(" ".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": sha256(text.encode()).hexdigest()}
