"""Spelling variants of words, found in sorted permuterm rotations.

A word with a terminator is turned through all its rotations. In the sorted list of rotations, all words that differ from
x_y in the character between x and y share the prefix y$x, and so does the word xy without it: replacements and indels are
prefix ranges that skip the edited character. A range holds at most one word a character of the alphabet, so its scan is
short however many words there are.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.textscan import Flat, blocks
from touchline.llm.work import cut

#: Stands after the last character; no word contains it.
END = "$"
#: Characters of texts that are counted together.
BLOCK = 1 << 22


def _letters(flat: Flat) -> np.ndarray:
    """Where the letters stand; A-Z become small on the way."""
    cp = flat.cp
    capital = (cp >= 65) & (cp <= 90)
    flat.cp = cp + (capital * np.uint32(32)).astype(np.uint32)
    return capital | ((cp >= 97) & (cp <= 122)) | ((cp >= 0xC0) & (cp <= 0xFF))


def _seeds(ids: list[str], owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the crc32 of ``<id>:`` adds to that of a word of ``size`` bytes that follows it.

    crc32 is affine in its start value, and how it depends on it is told by as many zero bytes.
    """
    start = [zlib.crc32(f"{i}:".encode()) for i in ids]
    pairs, which = np.unique(owner * (1 << 32) + size, return_inverse=True)
    made = [zlib.crc32(bytes(p & 0xFFFFFFFF), start[p >> 32]) ^ zlib.crc32(bytes(p & 0xFFFFFFFF)) for p in pairs.tolist()]
    return np.array(made, dtype=np.int64)[which] if len(made) else np.zeros(0, dtype=np.int64)


def _counts(ids: list[str], texts: list[str], least_length: int) -> Counter[str]:
    """Words of some texts after the seeded deletions, with how often each occurs."""
    flat = Flat(texts)
    start, end = flat.runs(_letters(flat))
    long = end - start >= least_length  # deletion only shortens
    start, end = start[long], end[long]
    high = np.concatenate(([0], np.cumsum(flat.cp > 127)))
    _, first, which = np.unique(flat.hashes(start, end), return_index=True, return_inverse=True)
    words = [flat.cp[a:b].tobytes().decode("utf-32-le") for a, b in zip(start[first].tolist(), end[first].tolist())]
    crc = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.int64)
    h = (crc[which] if len(words) else np.zeros(0, dtype=np.int64)) ^ _seeds(ids, flat.owner(start), end - start + high[end] - high[start])
    hit = h % 97 == 0
    total = Counter(dict(zip(words, np.bincount(which[~hit], minlength=len(words)).tolist())))
    for i, at in zip(which[hit].tolist(), (h[hit] % (end - start)[hit]).tolist()):
        word = words[i][:at] + words[i][at + 1 :]
        if len(word) >= least_length:
            total[word] += 1
    return total


def counted_words(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: lower-cased (A-Z only) runs of the letters A-Z, a-z and U+00C0 to U+00FF in all texts, seeded with one
    deletion in about 97 runs.

    With h the crc32 of ``<doc_id>:<run>``, a run whose h is a multiple of 97 loses its code point at h % length.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["id"].tolist(), batch["text"].tolist()
            for a, b in blocks(texts, BLOCK):
                total = +_counts(ids[a:b], texts[a:b], least_length)
                yield pd.DataFrame({"word": pd.Series(list(total), dtype=object), "n": np.array(list(total.values()), dtype=np.int64)})

    texts = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def numbered(words: DataFrame) -> DataFrame:
    """word, n and id, which follows the order of the words' code points; written, so that ids stay."""
    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    return cut(ordered.withColumn("id", F.monotonically_increasing_id()), "words")


def rotations(words: DataFrame) -> DataFrame:
    """key, mark, id, n, kind: every rotation, as a whole (kind 2) and without its last character (kinds 0 and 1).

    Whole rotations are ranges that a longer word can fall in. The others skip their last character, the edited one; kind 1
    tells that it differs from the one before it in the word, so that of equal neighbours only one counts as inserted.
    ``mark`` is a hash of the key, by which neighbours in the sorted list are told apart.
    """

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, kind = [], []
            for w in batch["word"]:
                size, double = len(w) + 1, (w + END) * 2
                keys += [double[i : i + size] for i in range(size)]
                keys += [double[i : i + size - 1] for i in range(1, size)]
                kind += [2] * size + [1] + [int(x != y) for x, y in zip(w[1:], w)]
            at = np.repeat(np.arange(len(batch)), 2 * batch["word"].str.len().to_numpy() + 1)
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "id": batch["id"].to_numpy()[at], "n": batch["n"].to_numpy()[at], "kind": kind})

    turned = words.select("word", "id", "n").mapInPandas(turn, "key string, id long, n long, kind int")
    return turned.withColumn("mark", F.xxhash64("key"))


def _near(members: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """id, number of near words and the most frequent of them (n and id), for each word (id, n, kind) of one range."""
    order = lambda m: (-m[1], m[0])
    skipped = sorted((m for m in members if m[2] < 2), key=order)
    whole = [m for m in members if m[2] == 2]  # one word at most
    firsts = [m for m in skipped if m[2] == 1]
    for m in skipped:
        near = [x for x in skipped[:2] if x[0] != m[0]][:1] + (whole if m[2] else [])
        if near:
            best = min(near, key=order)
            yield m[0], len(skipped) - 1 + (len(whole) if m[2] else 0), best[1], best[0]
    for m in whole:
        if firsts:
            yield m[0], len(firsts), firsts[0][1], firsts[0][0]


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near and best (struct of -n and id): how many words are one edit away, and the most frequent of them.

    Rotations are dealt by key and sorted, and each partition's list is scanned range by range. Two words replace each
    other in one range only; an indel is counted in the range of the first of equal characters, so no pair counts twice.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "n_near", "n", "best"]
        table = lambda rows: pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, 4), columns=names)
        held, mark = [], None  # the range that may go on in the next batch
        for batch in batches:
            if batch.empty:
                continue
            out = []
            marks = batch["mark"].to_numpy()
            edge = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
            stop = np.append(edge[1:], len(marks))
            crowd = stop - edge > 1  # a single row has no neighbour, unless its range goes on in another batch
            crowd[[0, -1]] = True
            rows = batch[["id", "n", "kind"]].to_numpy()
            for a, b in zip(edge[crowd].tolist(), stop[crowd].tolist()):
                if marks[a] != mark:
                    out += _near(held) if len(held) > 1 else []
                    held, mark = [], marks[a]
                held += map(tuple, rows[a:b].tolist())
            yield table(out)
        yield table(list(_near(held)) if len(held) > 1 else [])

    ordered = rotations(words).repartition("key").sortWithinPartitions("key").select("mark", "id", "n", "kind")
    found = ordered.mapInPandas(scan, "id long, n_near long, n long, best long")
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("best").alias("id")))
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow one another, by joins that double the steps.

    A form is at least twice as frequent as its word, so chains are short and have no loops.
    """
    steps = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(ahead, "root", "left")
        steps = cut(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def group_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every distinct word with enough code points and occurrences.

    Near words differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word of largest n
    (ties: the smallest by code points) if that n is at least ``ratio`` times the word's, else null; ``root`` follows
    forms to the last. Null and empty texts have no words; a null doc_id counts as the empty text; repeated rows count
    each. Columns beyond doc_id and text are ignored. An empty table gives no rows.
    """
    words = numbered(counted_words(docs.select("doc_id", "text"), least_length, least_count))
    near = words.join(neighbours(words), "id", "left")
    form_n = F.when(-F.col("best.minus_n") >= ratio * F.col("n"), -F.col("best.minus_n"))
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"), F.when(form_n.isNotNull(), F.col("best.id")).alias("form_id"))
    forms = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    near = cut(near.join(forms, "form_id", "left").select("word", "form", "n", "n_near", "form_n"), "near-words")
    roots = followed(near.where(F.col("form").isNotNull()))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
