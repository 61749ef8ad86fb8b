"""Quality rules: counted word and line rules, and divergence from language references.

Each document's histograms (character classes, common words) are compared with the histograms of whole languages by the
Jensen-Shannon distance. The references are sums over all labelled documents that pass the counted rules.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from touchline.llm.textscan import Flat, ascii_space, blocks, window_hashes
from touchline.llm.work import slices

SYMBOLS = "#*$%&|<>"
CLASSES = ("small letter", "capital letter", "other letter", "digit", "blank", "line end", "comma or full stop", "shout", "rule symbol", "other sign")
#: Word counts are kept by a hash of the lower-cased word modulo this, so their number is fixed.
SLOTS = 1 << 13
WINDOW = 5
#: Code points scanned at once: they take some hundred bytes each meanwhile.
SCAN_CHARS = 1 << 17

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@lru_cache(maxsize=1)
def _char_class() -> np.ndarray:
    out = np.full(0x110000, 9, dtype=np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        if kind[0] in "LM":
            out[i] = 0 if kind == "Ll" else 1 if kind in ("Lu", "Lt") else 2
        elif kind[0] == "N":
            out[i] = 3
        elif kind == "Zs" or i in (9, 11, 12):
            out[i] = 4
    out[[10, 13]] = 5
    out[[ord(c) for c in ".,"]] = 6
    out[[ord(c) for c in "!?"]] = 7
    out[[ord(c) for c in SYMBOLS]] = 8
    return out


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each range between consecutive ``starts``."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[starts[1:]] - total[starts[:-1]]


def _seen_before(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item in order: whether an equal one of the same owner stands earlier, and whether any other equal one exists."""
    order = np.lexsort((h, owner))  # stable: equal items stay in text order
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    later = np.zeros(len(h), dtype=bool)
    twice = np.zeros(len(h), dtype=bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return later, twice


class Features:
    """Counts and histograms of a block of texts."""

    def __init__(self, texts: list[str]):
        n, flat = len(texts), Flat(texts)
        self.n, space = n, ascii_space(flat.cp)
        start, end = flat.runs(~space)
        owner = flat.owner(start)
        h = flat.hashes(start, end)
        symbol = np.isin(flat.cp, [ord(c) for c in SYMBOLS])
        self.counts = {"n_words": np.bincount(owner, minlength=n), "word_chars": _sums(~space, flat.starts), "n_symbols": _sums(symbol, flat.starts)}
        a, b = flat.lines()
        filled = np.concatenate(([0], np.cumsum(~space)))
        a, b = a[(k := filled[b] > filled[a])], b[k]
        line_owner = flat.owner(a)
        later, _ = _seen_before(line_owner, flat.hashes(a, b))
        self.counts["n_dup_lines"] = np.bincount(line_owner, weights=later, minlength=n).astype(np.int64)
        wh, first = window_hashes(h, owner, WINDOW)
        _, twice = _seen_before(owner[first], wh)
        cover = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(cover, first[twice], 1)
        np.subtract.at(cover, first[twice] + WINDOW, 1)
        self.counts["n_repeat_words"] = np.bincount(owner, weights=np.cumsum(cover)[:-1] > 0, minlength=n).astype(np.int64)
        lower = Flat([t.lower() for t in texts])
        low_start, low_end = lower.runs(~ascii_space(lower.cp))
        self.owner, self.slot = lower.owner(low_start), (lower.hashes(low_start, low_end) % np.uint64(SLOTS)).astype(np.int64)
        own_newline = np.zeros(len(flat.cp), dtype=bool)
        own_newline[flat.starts[1:] - 1] = True
        char_owner = np.repeat(np.arange(n), np.diff(flat.starts))
        key = char_owner * len(CLASSES) + _char_class()[flat.cp]
        self.chars = np.bincount(key[~own_newline], minlength=n * len(CLASSES)).reshape(n, -1)

    def base_failed(self, min_words: int, max_repeat: int) -> np.ndarray:
        words = self.counts["n_words"]
        return (words < min_words) | (100 * self.counts["n_repeat_words"] > max_repeat * words)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Features]]:
    for part in slices(batches):
        texts = [t if isinstance(t, str) else "" for t in part["text"].to_pylist()]
        for a, b in blocks(texts, SCAN_CHARS):
            yield part.slice(a, b - a), Features(texts[a:b])


def language_counts(docs: DataFrame, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """lang, kind (0 character class, 1 word slot), slot and count over all labelled documents that pass the counted rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, words = {}, {}
        for part, f in _blocks(batches):
            good = ~f.base_failed(min_words, max_repeat)
            lang = np.array(part["lang"].to_pylist(), dtype=object)
            for name in {x for x in lang[good] if isinstance(x, str)}:
                mine = good & (lang == name)
                chars[name] = chars.get(name, 0) + f.chars[mine].sum(axis=0)
                words[name] = words.get(name, 0) + np.bincount(f.slot[mine[f.owner]], minlength=SLOTS)
        for kind, by in ((0, chars), (1, words)):
            for name, c in by.items():
                at = np.flatnonzero(c)
                columns = {"lang": pa.array([name] * len(at), pa.string()), "kind": pa.array([kind] * len(at), pa.int32()), "slot": pa.array(at, pa.int64()), "count": pa.array(c[at], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)

    part = docs.select("lang", "text").mapInArrow(run, "lang string, kind int, slot long, count long")
    return part.groupBy("lang", "kind", "slot").agg(F.sum("count").alias("count"))


class References:
    """Language histograms, as shares: character classes, and the most common words of every language with the rest."""

    def __init__(self, counts: pd.DataFrame, common: int):
        self.langs = sorted(counts["lang"].unique())
        top: set[int] = set()
        for _, g in counts[counts["kind"] == 1].groupby("lang"):
            top |= set(g.sort_values(["count", "slot"], ascending=[False, True])["slot"].head(common))
        self.column = np.full(SLOTS, len(top), dtype=np.int64)
        self.column[sorted(top)] = np.arange(len(top))
        self.width = len(top) + 1
        self.chars = np.zeros((len(self.langs), len(CLASSES)))
        self.words = np.zeros((len(self.langs), self.width))
        for i, lang in enumerate(self.langs):
            mine = counts[counts["lang"] == lang]
            c, w = mine[mine["kind"] == 0], mine[mine["kind"] == 1]
            self.chars[i, c["slot"]] = c["count"]
            np.add.at(self.words[i], self.column[w["slot"]], w["count"])
        for m in (self.chars, self.words):
            m /= np.maximum(m.sum(axis=1, keepdims=True), 1)

    def word_counts(self, f: Features) -> np.ndarray:
        return np.bincount(f.owner * self.width + self.column[f.slot], minlength=f.n * self.width).reshape(f.n, -1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of ``p`` from ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip(d / 2, 0, 1))


def nearest(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Each row's distance from the reference nearest to it; 0 without a reference or a count."""
    if not len(references):
        return np.zeros(len(counts))
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    return np.where(total[:, 0] > 0, np.min([js_distance(p, q) for q in references], axis=0), 0.0)


def score(docs: DataFrame, common: int = 10, min_words: int = 10, max_repeat: int = 20, guard_chars: int = 300, guard_words: int = 60, char_limit: float = 0.28, word_limit: float = 0.29) -> DataFrame:
    """``docs`` with the counted rules, both distances, base_failed and kept.

    A document is kept if it passes the counted rules (at least ``min_words`` words, at most ``max_repeat`` percent of
    them in repeated windows of five) and is near some language: the distance of its character classes is at most
    ``char_limit``, and that of its common words at most ``word_limit``. Documents with fewer than ``guard_chars``
    characters or ``guard_words`` words are too short for the respective distance, which then decides nothing. A null
    text counts as empty (no words, not kept). Null labels add to no reference; without any reference the distances are
    0. Rows are judged one by one, so repeated rows come back as often; columns with the names of results are replaced.
    The references are languages x (2**13 + 10) sums at most, whatever the corpus size.
    """
    refs = References(language_counts(docs, min_words, max_repeat).toPandas(), common)
    result = [*COUNTS, "char_distance", "word_distance", "base_failed", "kept"]
    kinds = ["long"] * 5 + ["double", "double", "boolean", "boolean"]
    keep = [c for c in docs.columns if c.lower() not in result]
    rows = docs.select(*keep)
    schema = StructType(list(rows.schema.fields))
    for name, kind in zip(result, kinds):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, f in _blocks(batches):
            char_distance, word_distance = nearest(f.chars, refs.chars), nearest(refs.word_counts(f), refs.words)
            failed = f.base_failed(min_words, max_repeat)
            far = (f.chars.sum(axis=1) >= guard_chars) & (char_distance > char_limit)
            far |= (f.counts["n_words"] >= guard_words) & (word_distance > word_limit)
            found = [pa.array(f.counts[name], pa.int64()) for name in COUNTS] + [pa.array(x) for x in (char_distance, word_distance, failed, ~failed & ~far)]
            yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*keep, *result])

    return rows.mapInArrow(run, schema)
