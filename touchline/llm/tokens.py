"""Exact ids of a public byte-level BPE file, with every distinct piece encoded once a worker.

Texts of Latin code points are cut into pieces by array operations; a piece seen before costs a lookup of
its hash. All other texts (other scripts, control signs, apostrophes, special tokens) go to the library whole.
"""
from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

from touchline.llm.textscan import Flat, blocks

LETTER, DIGIT, SPACE, OTHER, FOREIGN = range(5)
LATIN = 0x180
#: Known pieces kept in a worker; beyond it the store is emptied and filled anew.
MEMO_PIECES = 2_000_000
#: Code points scanned at once and pieces the library encodes at once: both take some hundred bytes each meanwhile.
SCAN_CHARS, LEARN_PIECES = 1 << 18, 4096


def _classes() -> np.ndarray:
    """Class of each code point below LATIN; signs on which Unicode versions or rules may differ are FOREIGN."""
    out = np.full(LATIN + 1, FOREIGN, dtype=np.uint8)
    for i in range(LATIN):
        kind = unicodedata.category(chr(i))[0]
        out[i] = {"L": LETTER, "N": DIGIT, "P": OTHER, "S": OTHER, "M": OTHER}.get(kind, FOREIGN)
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[[0x27, 0x130]] = FOREIGN
    return out


CLASSES = _classes()


def is_plain(text: str, specials: tuple[str, ...]) -> bool:
    """Whether the array rules hold for ``text``: known code points, no apostrophe, no special token."""
    if not text.isascii():
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if (CLASSES[np.minimum(cp, LATIN)] == FOREIGN).any():
            return False
    elif (CLASSES[np.frombuffer(text.encode(), dtype=np.uint8)] == FOREIGN).any():
        return False
    return not any(s in text for s in specials)


def byte_pieces(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of plain texts: a run of letters, digits or signs with the one blank before it; of white space before
    a piece its last sign stands apart (unless it is that blank), white space at the end of a text is one piece."""
    kind = CLASSES[flat.cp]
    kind[flat.starts[1:] - 1] = FOREIGN  # the newline between texts
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.concatenate(([0], change)) if len(kind) else change
    end = np.concatenate((change, [len(kind)])) if len(kind) else change
    k = kind[start]
    before_text_end = np.concatenate((k[1:] == FOREIGN, [True])) if len(k) else k == FOREIGN
    space = k == SPACE
    glued = space & ~before_text_end & (flat.cp[end - 1] == 32)
    head = np.where(space & ~before_text_end, end - 1, end)  # where the first part of a white-space run ends
    word = (k != SPACE) & (k != FOREIGN)
    after_blank = np.concatenate(([False], glued[:-1]))
    s = [start[word] - after_blank[word], start[space & (head > start)], end[space & ~before_text_end & ~glued] - 1]
    e = [end[word], head[space & (head > start)], end[space & ~before_text_end & ~glued]]
    s, e = np.concatenate(s), np.concatenate(e)
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


class Encoder:
    """ids of texts as the library gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task owns one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.empty()

    def empty(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int32)
        self.store = np.zeros(0, dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Keep the ids of pieces not known yet; ``hashes`` ascend."""
        got = []
        for a in range(0, len(pieces), LEARN_PIECES):
            got += [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch(pieces[a : a + LEARN_PIECES], add_special_tokens=False)]
        if len(self.known) + len(got) > MEMO_PIECES:
            self.empty()
        count = np.fromiter(map(len, got), dtype=np.int32, count=len(got))
        first = len(self.store) + np.cumsum(count, dtype=np.int64) - count
        self.store = np.concatenate((self.store, *got))
        at = np.searchsorted(self.known, hashes)
        self.known, self.first, self.count = np.insert(self.known, at, hashes), np.insert(self.first, at, first), np.insert(self.count, at, count)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        flat = Flat(texts)
        s, e = byte_pieces(flat)
        if not len(s):
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        distinct, at, back = np.unique(flat.hashes(s, e), return_index=True, return_inverse=True)
        for _ in range(2):  # a second time if the store was emptied meanwhile
            place = np.searchsorted(self.known, distinct)
            new = place == len(self.known)
            new[~new] = self.known[place[~new]] != distinct[~new]
            if not new.any():
                break
            which = at[new]
            cp = flat.cp
            self._learn(distinct[new], [cp[a:b].tobytes().decode("utf-32-le") for a, b in zip(s[which], e[which])])
        place = np.searchsorted(self.known, distinct)
        count, first = self.count[place][back], self.first[place][back]
        stop = np.cumsum(count, dtype=np.int64)
        ids = self.store[np.arange(stop[-1]) + np.repeat(first - (stop - count), count)]
        bounds = np.concatenate(([0], stop))[np.searchsorted(s, flat.starts)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and is_plain(t, self.specials)]
        for a, b in blocks([texts[i] for i in plain], SCAN_CHARS):
            for i, ids in zip(plain[a:b], self._plain([texts[i] for i in plain[a:b]])):
                out[i] = ids
        done = set(plain)
        for i, t in enumerate(texts):
            if t and i not in done:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process; tasks of the same worker share what it has learnt."""
    return Encoder(path)
