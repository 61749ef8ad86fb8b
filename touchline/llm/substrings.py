"""Removal of repeated passages by prefix-partitioned suffix trees.

A passage repeats where a window of ``window`` consecutive words of one document also starts earlier. Shipping every
suffix would move each word ``window`` times, so the trees hold the suffixes around content-chosen places: of the
``anchor``-word runs inside a window the one with the least hash is its anchor, and equal windows have equal anchors.

1. Anchors that occur once cannot lie in a repeated window. They are counted by hash; a hash clash only keeps too much.
2. Around each repeated anchor a segment stays: the words of all windows that this anchor stands for. A segment that a
   block of documents holds several times goes out once, its later copies are repeats already.
3. Segments are split by the prefix at their anchor. A prefix that holds over ``group`` segments is lengthened to whole
   windows, so no group grows with the corpus.
4. Each group builds its suffix tree: suffixes sorted by doubled prefixes of 1, 2, 4, ... words. An internal node at least
   ``window`` words deep is a repeat; its earliest suffix stays, all others are repeats.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.textscan import Flat, ascii_space, blocks, mix
from touchline.llm.work import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters of documents that are searched together, and of segments whose trees are built together.
BLOCK = 1 << 20
#: Characters of documents whose repeated anchors are settled before the shuffle.
LOCAL = 1 << 23
PLACE = ["no_id", "id", "th"]
SEGMENT = "no_id boolean, id long, th long, pos long, count long, prefix long, segment string, spans binary"
#: Up to this many crowded prefixes (8 bytes each) are sent to all executors; more are joined by shuffle.
FEW = 1_000_000


@dataclass(frozen=True)
class Settings:
    window: int = 20
    anchor: int = 6
    group: int = 1 << 15


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of each ``width`` consecutive ones."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        span += step
    return at


class Windows:
    """Words of a block of texts and, for each window in one text, its first word, text and anchor."""

    def __init__(self, texts: list[str], settings: Settings):
        flat = Flat(texts)
        start, end = flat.runs(~ascii_space(flat.cp))
        code = flat.hashes(start, end)
        owner = flat.owner(start)
        self.first = np.searchsorted(owner, np.arange(len(texts) + 1))
        n = len(code)
        if n < settings.window:
            self.at = self.owner = self.place = np.zeros(0, dtype=np.int64)
            self.anchor = np.zeros(0, dtype=np.uint64)
            return
        runs = code[: n - settings.anchor + 1].copy()
        for k in range(1, settings.anchor):
            runs *= np.uint64(0xD6E8FEB86659FD93)
            runs += code[k : n - settings.anchor + 1 + k]
        runs = mix(runs)
        place = _sliding_least(runs, settings.window - settings.anchor + 1)
        self.at = np.flatnonzero(owner[: n - settings.window + 1] == owner[settings.window - 1 :])
        self.owner, self.place = owner[self.at], place[self.at]
        self.anchor = runs[self.place]


def _documents(docs: DataFrame) -> DataFrame:
    """id, no_id, th (hash of the text) and text; no column is null, so no id changes its type on the way to a worker."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.withColumn("dk", F.xxhash64("id", "no_id", "th"))


def _zipped(rows: DataFrame) -> DataFrame:
    """The rows with their text compressed, for a shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zipper = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            batch["text"] = [zipper.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"]]
            yield batch

    return rows.mapInPandas(run, "id long, no_id boolean, th long, text binary, dk long")


def _unzipped(texts: pd.Series) -> Iterator[str]:
    unzip = zstandard.ZstdDecompressor()
    return (unzip.decompress(bytes(t)).decode("utf-8", "surrogatepass") for t in texts)


def _packed(rows: pd.DataFrame, owner: np.ndarray, first: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Place and packed (first word, last word + 1) pairs, one row for each of ``owner``, which is in order."""
    pairs = np.stack([first, end], axis=1).astype(">i8")
    cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, dtype=np.int64)
    ends = np.append(cuts[1:], len(owner))
    out = rows[PLACE].iloc[owner[cuts]].copy()
    out["spans"] = [pairs[i:j].tobytes() for i, j in zip(cuts, ends)]
    return out


def _bucket(dk: np.ndarray, parts: int) -> np.ndarray:
    return (mix(dk.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _settle(anchor: np.ndarray, dk: np.ndarray, parts: int) -> pd.DataFrame:
    """Packed rows of one block: kind 1 repeats in the block, 0 and 2 are each anchor once, 2 if it repeats here."""
    order = np.lexsort((dk, anchor))
    anchor, dk = anchor[order], dk[order]
    head = np.append(True, anchor[1:] != anchor[:-1])
    known = ~head | np.append(~head[1:], False)
    fresh = known & (head | np.append(True, dk[1:] != dk[:-1]))  # once a document
    a, d = np.concatenate([anchor[head], anchor[fresh]]), np.concatenate([dk[head], dk[fresh]])
    kind = np.concatenate([np.where(known[head], 2, 0), np.ones(int(fresh.sum()), dtype=np.int64)])
    part = np.where(kind == 1, _bucket(d, parts), (a % np.uint64(parts)).astype(np.int64))
    order = np.lexsort((d, kind, part))
    a, d, kind, part = a[order], d[order], kind[order], part[order]
    edge = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])))
    ends = np.append(edge[1:], len(part))
    cells = [(a[i:j].tobytes(), d[i:j].tobytes()) for i, j in zip(edge, ends)]
    return pd.DataFrame({"part": part[edge], "kind": kind[edge], "anchors": [c[0] for c in cells], "dks": [c[1] for c in cells]})


def _by_bucket(anchor: np.ndarray, dk: np.ndarray, parts: int) -> pd.DataFrame:
    """Packed rows, one for each bucket of documents."""
    bucket = _bucket(dk, parts)
    order = np.argsort(bucket, kind="stable")
    anchor, dk, bucket = anchor[order], dk[order], bucket[order]
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(dk) else np.zeros(0, dtype=np.int64)
    ends = np.append(edge[1:], len(dk))
    cells = [(anchor[i:j].tobytes(), dk[i:j].tobytes()) for i, j in zip(edge, ends)]
    return pd.DataFrame({"bucket": bucket[edge], "anchors": [c[0] for c in cells], "dks": [c[1] for c in cells]})


def _by_document(anchor: np.ndarray, dk: np.ndarray) -> pd.DataFrame:
    order = np.argsort(dk, kind="stable")
    anchor, dk = anchor[order], dk[order]
    edge = np.flatnonzero(np.append(True, dk[1:] != dk[:-1])) if len(dk) else np.zeros(0, dtype=np.int64)
    ends = np.append(edge[1:], len(dk))
    return pd.DataFrame({"dk": dk[edge], "anchors": [anchor[i:j].tobytes() for i, j in zip(edge, ends)]})


def repeated_anchors(rows: DataFrame, parts: int, settings: Settings) -> DataFrame:
    """dk and packed hashes (one row a document): the anchors of that document that occur twice or more in the corpus.

    What repeats within a block of documents is settled there and only passes through; of each anchor one occurrence a
    block is compared across blocks, so an anchor in a third of all documents meets as one row a block. What is found goes
    on packed by buckets of documents, and each bucket (about the size of a block) is opened to one row a document.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            texts, dks = batch["text"].tolist(), batch["dk"].to_numpy()
            for a, b in blocks(texts, BLOCK):
                w = Windows(texts[a:b], settings)
                if len(w.place):
                    step = np.append(True, w.place[1:] != w.place[:-1])
                    held.append((w.anchor[step], dks[a + w.owner[step]]))
                size += sum(map(len, texts[a:b]))
                if held and size > LOCAL:
                    yield _settle(*(np.concatenate(x) for x in zip(*held)), parts)
                    held, size = [], 0
        if held:
            yield _settle(*(np.concatenate(x) for x in zip(*held)), parts)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors, dks, sure = [], [], []
        for batch in batches:
            for part, kind, a, d in zip(batch["part"], batch["kind"], batch["anchors"], batch["dks"]):
                a, d = np.frombuffer(a, dtype=np.uint64), np.frombuffer(d, dtype=np.int64)
                if kind == 1:
                    yield pd.DataFrame({"bucket": [part], "anchors": [a.tobytes()], "dks": [d.tobytes()]})
                else:
                    anchors.append(a)
                    dks.append(d)
                    sure.append(np.full(len(a), kind == 2))
        if anchors:
            a, d, s = (np.concatenate(x) for x in (anchors, dks, sure))
            _, which, n = np.unique(a, return_inverse=True, return_counts=True)
            hit = (n[which] > 1) & ~s  # what repeats in its own block has gone out already
            yield _by_bucket(a[hit], d[hit], parts)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors, dks = [], []
        for batch in batches:
            anchors += batch["anchors"].tolist()
            dks += batch["dks"].tolist()
        if anchors:
            yield _by_document(np.frombuffer(b"".join(anchors), dtype=np.uint64), np.frombuffer(b"".join(dks), dtype=np.int64))

    packed = rows.select("text", "dk").mapInPandas(local, "part long, kind long, anchors binary, dks binary")
    found = packed.repartition(parts, "part").mapInPandas(compare, "bucket long, anchors binary, dks binary")
    return found.repartition(parts, "bucket").mapInPandas(gather, "dk long, anchors binary")


def segments(rows: DataFrame, anchors: DataFrame, settings: Settings) -> DataFrame:
    """The words around repeated anchors: place (no_id, id, th, pos), prefix, segment; or place and spans of repeats.

    A segment covers ``count`` windows from word ``pos`` on. Where the same words come again in the block of documents, the
    later copies are repeats as a whole: they go out as spans only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(_unzipped(batch["text"]))
            for a, b in blocks(texts, BLOCK):
                part = batch.iloc[a:b]
                w = Windows(texts[a:b], settings)
                if not len(w.at):
                    continue
                lists = [np.frombuffer(x, dtype=np.uint64) for x in part["anchors"]]
                salt = mix(np.arange(b - a, dtype=np.uint64) + np.uint64(1))
                good = np.isin(w.anchor ^ salt[w.owner], np.concatenate([x ^ salt[i] for i, x in enumerate(lists)]))
                at, owner, place, anchor = w.at[good], w.owner[good], w.place[good], w.anchor[good]
                if not len(at):
                    continue
                edge = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))
                count = np.diff(np.append(edge, len(at)))
                docs, pos = owner[edge], at[edge] - w.first[owner[edge]]
                names, words = -1, []
                keys = list(zip(part["no_id"], part["id"], part["th"]))
                first: dict[str, int] = {}
                again = []
                for i, (d, p, n) in enumerate(zip(docs.tolist(), pos.tolist(), count.tolist())):
                    if d != names:
                        names, words = d, WORD.findall(texts[a + d])
                    text = " ".join(words[p : p + n + settings.window - 1])
                    seen = first.setdefault(text, i)
                    if seen != i and keys[d] < keys[docs[seen]]:
                        first[text], seen, i = i, i, seen
                    if seen != i and keys[docs[i]] != keys[docs[seen]] or pos[i] != pos[seen]:
                        again.append(i)
                lead = np.fromiter(first.values(), dtype=np.int64, count=len(first))
                out = part[PLACE].iloc[docs[lead]].copy()
                out["pos"], out["count"], out["prefix"], out["segment"], out["spans"] = pos[lead], count[lead], anchor[edge][lead].view(np.int64), list(first), None
                yield out
                again = np.sort(np.array(again, dtype=np.int64))
                out = _packed(part, docs[again], pos[again], pos[again] + count[again] + settings.window - 1)
                out[["pos", "count", "prefix"]] = 0
                out.insert(6, "segment", None)
                yield out[[c.split()[0] for c in SEGMENT.split(", ")]]

    both = _zipped(rows).join(anchors, "dk").select(*PLACE, "text", "anchors")
    return both.mapInPandas(run, SEGMENT)


def lengthened(parts: DataFrame, settings: Settings) -> DataFrame:
    """Segments with the prefix of their group; where over ``group`` segments have one, its windows by all their words."""
    crowded = parts.groupBy("prefix").count().where(F.col("count") > settings.group).select("prefix", F.lit(True).alias("crowded"))
    crowded = cut(crowded, "crowded-prefixes")
    crowded = F.broadcast(crowded) if crowded.count() <= FEW else crowded
    rows = parts.join(crowded, "prefix", "left")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first: dict[str, tuple] = {}
            gone = []
            for no_id, i, th, pos, n, text in zip(*(batch[c] for c in ("no_id", "id", "th", "pos", "count", "segment"))):
                words = text.split(" ")
                for k in range(n):
                    window, row = " ".join(words[k : k + settings.window]), (no_id, i, th, pos + k)
                    seen = first.setdefault(window, row)
                    if row < seen:
                        first[window], row, seen = row, seen, row
                    if row != seen:
                        gone.append(row)
            rows = [(*row, 1, int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True), t, None) for t, row in first.items()]
            pairs = [(*row[:3], 0, 0, 0, None, np.array([row[3], row[3] + settings.window], dtype=">i8").tobytes()) for row in gone]
            yield pd.DataFrame(rows + pairs, columns=[c.split()[0] for c in SEGMENT.split(", ")])

    columns = [c.split()[0] for c in SEGMENT.split(", ")]
    return rows.where(F.col("crowded").isNull()).select(*columns).union(rows.where("crowded").select(*columns).mapInPandas(windows, SEGMENT))


def subtree(codes: np.ndarray, depth: int) -> np.ndarray:
    """The node at ``depth`` words of the suffix that starts at each word: suffixes are equal that far where nodes are.

    Nodes are numbered in the order of their suffixes, from ranks of prefixes of 1, 2, 4, ... words, paired up.
    """
    def pair(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        after = np.full(len(left), -1, dtype=np.int64)
        after[: max(0, len(left) - shift)] = right[shift:]
        return np.unique(left * (np.int64(len(left)) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)

    doubled = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    while 2 << (len(doubled) - 1) <= depth:
        doubled.append(pair(doubled[-1], doubled[-1], 1 << (len(doubled) - 1)))
    rank, length = doubled[-1], 1 << (len(doubled) - 1)
    for k in range(len(doubled) - 1, -1, -1):
        if length + (1 << k) <= depth:
            rank, length = pair(rank, doubled[k], length), length + (1 << k)
    return rank


def repeats(groups: DataFrame, settings: Settings) -> DataFrame:
    """no_id, id, th and packed (start, end) word positions of later occurrences, from the suffix tree of each group."""

    def spans(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        texts, count = rows["segment"].tolist(), rows["count"].to_numpy()
        flat = Flat(texts)
        start, end = flat.runs(~ascii_space(flat.cp))
        first = np.searchsorted(flat.owner(start), np.arange(len(texts)))
        node = subtree(flat.hashes(start, end), settings.window)
        owner = np.repeat(np.arange(len(texts)), count)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        node, pos = node[first[owner] + shift], rows["pos"].to_numpy()[owner] + shift
        keys = [rows[c].to_numpy() for c in PLACE]
        order = np.lexsort((pos, *(k[owner] for k in reversed(keys)), node))
        lead = np.append(True, node[order][1:] != node[order][:-1])
        leader = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
        same = pos[order] == pos[leader]
        for k in keys:
            same &= k[owner[order]] == k[owner[leader]]
        gone = np.zeros(len(order), dtype=bool)
        gone[order[~same]] = True
        owner, pos = owner[gone], pos[gone]
        edge = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pos[1:] != pos[:-1] + 1))) if len(pos) else np.zeros(0, dtype=np.int64)
        last = np.append(edge[1:], len(pos))[: len(edge)] - 1
        return _packed(rows, owner[edge], pos[edge], pos[last] + settings.window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups arrive in a row; trees of whole groups are built together, about BLOCK characters at a time."""
        held, size, last = [], 0, None
        for batch in batches:
            chars = batch["segment"].str.len().to_numpy().cumsum()
            prefix = batch["prefix"].to_numpy()
            begin = 0
            heads = np.flatnonzero(np.append(last is None or prefix[0] != last, prefix[1:] != prefix[:-1])).tolist()
            for h in heads + [None]:
                stop = len(batch) if h is None else h
                if h is not None and (size + (chars[h - 1] if h else 0) - (chars[begin - 1] if begin else 0)) < BLOCK:
                    continue
                if stop > begin:
                    held.append(batch.iloc[begin:stop])
                    size += int(chars[stop - 1] - (chars[begin - 1] if begin else 0))
                if h is not None and held:
                    yield spans(held)
                    held, size = [], 0
                begin = stop
            last = prefix[-1]
        if held:
            yield spans(held)

    known = groups.where(F.col("segment").isNull()).select(*PLACE, "spans")
    ordered = groups.where(F.col("segment").isNotNull()).drop("spans").repartition("prefix").sortWithinPartitions("prefix")
    return known.union(ordered.mapInPandas(run, "no_id boolean, id long, th long, spans binary"))


def remove_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text, n_words, n_removed and ``kept`` (the words that stay, joined by one blank) of every row.

    Words are runs of anything but blanks and the ASCII characters 9 to 13, unchanged. A word goes if a window of
    ``window`` words over it also starts earlier: in a smaller doc_id, or at an earlier word of the same document. All
    windows are judged on the input. Null ids come after all others; rows that share a doc_id but not the text are
    ordered by a hash of it; rows that repeat doc_id and text are one document and come back alike. Null and empty texts
    have no words and an empty ``kept``. Columns beyond doc_id and text are ignored. An empty table gives no rows.
    """
    rows = _documents(docs)
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-chars // (1 << 24)))
    found = cut(segments(rows, repeated_anchors(rows, parts, settings), settings), "segments", "zstd")
    known, texts = found.where(F.col("segment").isNull()), found.where(F.col("segment").isNotNull())
    spans = repeats(lengthened(texts, settings).union(known), settings)
    spans = spans.groupBy(*PLACE).agg(F.collect_list("spans").alias("spans"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, no_id, text, spans in zip(batch["id"], batch["no_id"], _unzipped(batch["text"]), batch["spans"]):
                words = WORD.findall(text)
                if spans is None:
                    kept = words
                else:
                    pairs = np.frombuffer(b"".join(spans), dtype=">i8").astype(np.int64).reshape(-1, 2)
                    change = np.bincount(pairs[:, 0], minlength=len(words) + 1) - np.bincount(pairs[:, 1], minlength=len(words) + 1)
                    gone = np.cumsum(change)[:-1] > 0
                    kept = [words[k] for k in np.flatnonzero(~gone).tolist()]
                out.append((i, no_id, text, len(words), len(words) - len(kept), " ".join(kept)))
            yield pd.DataFrame(out, columns=["id", "no_id", "text", "n_words", "n_removed", "kept"])

    both = _zipped(rows).join(spans, PLACE, "left").select("id", "no_id", "text", "spans")
    out = both.mapInPandas(keep, "id long, no_id boolean, text string, n_words long, n_removed long, kept string")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "text", "n_words", "n_removed", "kept")


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
