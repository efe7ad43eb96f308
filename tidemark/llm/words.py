"""Ids of whole texts, word by word.

The words between spaces and line ends of many texts are made unique at once, a function is asked for the ids of those that
aren't remembered, and the ids of all the texts are gathered in one take. No tokenizer of these files has a token over such
a space, so the ids of a text are those of its words side by side. What is remembered has a bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUNS, BESIDE = r"([^\pL\pN\s']+)", r"'[^\pL\pN\s]|[^\pL\pN\s]'"  # runs of marks; an apostrophe beside another mark
LIMIT, LONGEST = 500_000, 48  # words that are remembered; bytes of such a word
GROUP = 16 << 20


def even(texts: pa.Array) -> pa.Array:
    """Whether a text (none is null) has only characters below U+0240 but U+0130, which every Unicode version in use treats
    alike and which are in NFC whatever stands beside them, nothing that may begin a special token, and no apostrophe beside
    another mark."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    # their first byte is below 0xC9; that of U+0130 is 0xC4, and 0xB0 follows
    other = np.concatenate([np.flatnonzero(data >= 0xC9), np.flatnonzero((data[:-1] == 0xC4) & (data[1:] == 0xB0))])
    out = np.ones(len(texts), bool)
    out[np.searchsorted(offsets, other + offsets[0], "right") - 1] = False
    out &= ~pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
    quoted = np.flatnonzero(out & pc.match_substring(texts, "'").to_numpy(zero_copy_only=False))
    out[quoted] = ~pc.match_substring_regex(texts.take(pa.array(quoted)), BESIDE).to_numpy(zero_copy_only=False)
    return pa.array(out)


def parted(texts: pa.Array) -> pa.Array:
    """Texts with A to Z in lower case and spaces around runs of marks, so that there are fewer different words.

    This changes no id where the tokenizer lowers letters, drops white space and parts letters, numbers and other characters
    from each other. Apostrophes, which begin contractions, stay where they are, and texts that aren't even as they are.
    """
    return pc.if_else(even(texts), pc.replace_substring_regex(pc.ascii_lower(texts), RUNS, r" \1 "), texts)


class Words:
    """learn: ids of an array of different words, as an array of bytes. lower: whether texts may be parted first.

    What is remembered are the last LIMIT words learned of at most LONGEST bytes, in two arrays.
    """

    def __init__(self, learn: Callable[[pa.Array], pa.Array], kind: np.dtype, lower: bool = False):
        self.learn, self.kind, self.lower = learn, np.dtype(kind), lower
        self.forget()

    def forget(self) -> None:
        self.names, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def known(self, words: pa.Array) -> pa.Array:
        """The ids of different words in bytes."""
        at = pc.index_in(words, self.names)
        missing = pc.is_null(at)
        new = words.filter(missing)
        if not len(new):
            return self.ids.take(at)
        ids = self.learn(new)
        place = np.where(missing.to_numpy(zero_copy_only=False), len(self.ids) + np.cumsum(missing.to_numpy(zero_copy_only=False)) - 1, at.fill_null(0).to_numpy())
        out = pa.concat_arrays([self.ids, ids]).take(pa.array(place))
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        names, ids = ([x, y.filter(short)] for x, y in ((self.names, new), (self.ids, ids)))
        self.names, self.ids = (pa.concat_arrays(x) for x in (names, ids))
        if len(self.names) > LIMIT + LIMIT // 4:
            last = pa.array(np.arange(len(self.names) - LIMIT, len(self.names)))  # copied, so that what is forgotten is freed
            self.names, self.ids = self.names.take(last), self.ids.take(last)
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts side by side, where each text's end)."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.replace_substring(parted(texts) if self.lower else texts, "\n", " "), " ")
        every = lists.values.dictionary_encode()
        taken = self.known(every.dictionary).take(every.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)
        ids = np.frombuffer(taken.buffers()[2] or b"", self.kind, int(ends[-1]) // self.kind.itemsize)
        places = np.frombuffer(lists.offsets.buffers()[1], np.int32, len(lists) + 1)
        return ids, ends[places[1:]] // self.kind.itemsize


def groups(texts: pa.Array, most: int = GROUP) -> Iterator[tuple[int, int]]:
    """(first, number) of neighbouring texts of at most so many bytes together; a longer one is alone."""
    total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield at, end - at
        at = end


def pieces(text: str, most: int = GROUP) -> Iterator[str]:
    """A text cut at spaces and line ends into pieces of at most so many characters; a longer word is a piece."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(" ", at + 1, at + most), text.rfind("\n", at + 1, at + most))
        if end < 0:
            end = min((x for x in (text.find(" ", at + most), text.find("\n", at + most)) if x >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]
