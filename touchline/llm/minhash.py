"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Words are lower-cased runs of letters and digits, shingles are five consecutive words. A shingle weighs
(1 + ln tf) * idf in its document. Documents whose weighted samples agree in a whole band are candidates; the weighted
Jaccard similarity of each candidate pair is computed from the texts.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.components import components
from touchline.llm.textscan import Flat, blocks, mix, table, window_hashes
from touchline.llm.work import cut, slices

WORDS = 5
#: Two rows of this many counters hold the document frequencies of all shingles, whatever their number.
WIDTH = 1 << 19
SLICE = 1 << 14
#: A shingle in a smaller share of the documents than this weighs as one in this share.
LEAST_SHARE = 0.01
TABLE_BITS = 16
BLOCK = 1 << 17
#: Up to this many ids (some 30 MB) are sent to all executors to pick their texts; more are joined by shuffle.
FEW_IDS = 2_000_000


@dataclass(frozen=True)
class Settings:
    least: float = 0.8
    bands: int = 14
    rows: int = 3
    pivots: int = 4
    group: int = 256
    seed: int = 11

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def shingles(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Distinct shingle hashes (ascending), their counts and a 128-bit signature of the word sequence, for each text.

    A text of one to four words is one shingle; a text without words has none and signature 0.
    """
    for a, b in blocks(texts, BLOCK):
        flat = Flat([t.lower() if t else "" for t in texts[a:b]])
        s, e = flat.runs(table("alnum")[flat.cp])
        h, owner = flat.hashes(s, e), flat.owner(s)
        first = np.searchsorted(owner, np.arange(b - a + 1))
        place = (np.arange(len(h)) - first[owner]).astype(np.uint64)
        totals = []
        for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ mix(place * np.uint64(k) + np.uint64(k))))))
            totals.append(sums[first[1:]] - sums[first[:-1]])
        wh, at = window_hashes(h, owner, WORDS)
        bounds = np.searchsorted(at, first)
        for i in range(b - a):
            n = first[i + 1] - first[i]
            sig = [int(t[i].astype(np.int64)) for t in totals]
            if 0 < n < WORDS:
                yield totals[0][i : i + 1], np.ones(1, dtype=np.int64), *sig
            else:
                yield *np.unique(wh[bounds[i] : bounds[i + 1]], return_counts=True), *sig


def _counter_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(WIDTH - 1)).astype(np.int64), WIDTH + ((h >> np.uint64(32)) & np.uint64(WIDTH - 1)).astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf by counter place: 1 + ln(1 / share) of the documents that have a shingle of that place.

    Document frequencies are counted over all documents in a count-min sketch of two rows; a shingle takes the smaller
    count, so its share is too large by 1/2**19 of the shingles of a mean document at most on average. Sketches are
    added slice by slice as a stream, and the driver gets their fixed 2**20 counters.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, n = np.zeros(2 * WIDTH, dtype=np.int64), 0
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            for a, b in blocks(texts, BLOCK):
                all_h = [h for h, _, _, _ in shingles(texts[a:b])]
                n += sum(len(h) > 0 for h in all_h)
                for place in _counter_places(np.concatenate(all_h)):
                    np.add.at(counters, place, 1)
        for i in range(0, 2 * WIDTH, SLICE):
            counts = zlib.compress(counters[i : i + SLICE].astype("<u4").tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"slice": [i], "n": [n if i == 0 else 0], "counts": [counts]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            n += int(batch["n"].sum())
            for at, c in zip(batch["slice"], batch["counts"]):
                total[at] = total.get(at, 0) + np.frombuffer(zlib.decompress(c), dtype="<u4").astype(np.int64)
        for at, c in total.items():
            yield pd.DataFrame({"slice": [at], "n": [n], "counts": [zlib.compress(c.tobytes(), 1)]})
            n = 0

    parts = docs.select("text").mapInArrow(count, "slice long, n long, counts binary")
    got = parts.repartition("slice").mapInPandas(add, "slice long, n long, counts binary").toPandas()
    counters = np.zeros(2 * WIDTH)
    for at, c in zip(got["slice"], got["counts"]):
        counters[at : at + SLICE] = np.frombuffer(zlib.decompress(c), dtype=np.int64)
    share = counters / max(1, got["n"].sum())
    return (1 - np.log(np.clip(share, LEAST_SHARE, 1))).astype(np.float32)


def weights(h: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    a, b = _counter_places(h)
    return (1 + np.log(counts)) * np.maximum(idf[a], idf[b]).astype(np.float64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger, for two (hashes, weights); 0 for empty ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - both
    return float(both / whole) if whole > 0 else 0.0


def sampling_tables(seed: int) -> tuple[np.ndarray, ...]:
    """Draws of consistent weighted sampling by hash: 1/r, beta, r and ln c - r + r * beta, with r, c of Gamma(2, 1)."""
    rng = np.random.default_rng(seed)
    n = 1 << TABLE_BITS
    r, c, beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
    return tuple(x.astype(np.float32) for x in (1 / r, beta, r, np.log(c) - r + r * beta))


def samples(h: np.ndarray, log_weights: np.ndarray, starts: np.ndarray, settings: Settings, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """Sample codes (documents x samples) of documents whose shingles lie between ``starts``; none of them is empty.

    For each sample a shingle gets t = floor(ln w / r + beta) and a = ln c - r * (t - beta + 1); the shingle with the
    least a is drawn, and (shingle, t) is the sample. Two documents draw the same with the probability of their
    weighted Jaccard similarity. Equal a (the draws come from a table) go to the smaller hash.
    """
    inverse_r, beta, r, rest = tables
    lw = log_weights.astype(np.float32)
    out = np.zeros((len(starts), settings.samples), dtype=np.uint32)
    lengths = np.diff(np.append(starts, len(h)))
    owner = np.repeat(np.arange(len(starts)), lengths)
    odd = np.random.default_rng(settings.seed + 1).integers(1, 1 << 62, settings.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(settings.samples):
        at = (h * odd[k]) >> np.uint64(64 - TABLE_BITS)
        t = np.floor(lw * inverse_r[at] + beta[at])
        a = rest[at] - r[at] * t
        hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), lengths))
        if len(hit) > len(starts):
            hit = hit[np.lexsort((h[hit], owner[hit]))]
            hit = hit[np.concatenate(([True], owner[hit][1:] != owner[hit][:-1]))]
        out[:, k] = (mix(h[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return out


def band_keys(codes: np.ndarray, settings: Settings) -> np.ndarray:
    key = np.arange(1, settings.bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for j in range(settings.rows):
        key = mix(key ^ codes[:, j :: settings.rows].astype(np.uint64))
    return key.view(np.int64)


def features(docs: DataFrame, idf, settings: Settings) -> DataFrame:
    """doc_id, signature (s1, s2), sample codes and band keys of every document; no bands without words."""
    tables = sampling_tables(settings.seed)

    row = pa.schema([("doc_id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("codes", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            for a, b in blocks(texts, BLOCK):
                got = list(shingles(texts[a:b]))
                some = [i for i, g in enumerate(got) if len(g[0])]
                codes, keys = [b""] * (b - a), [np.zeros(0, dtype=np.int64)] * (b - a)
                if some:
                    h = np.concatenate([got[i][0] for i in some])
                    w = weights(h, np.concatenate([got[i][1] for i in some]), idf.value)
                    starts = np.cumsum([0] + [len(got[i][0]) for i in some[:-1]])
                    drawn = samples(h, np.log(w), starts, settings, tables)
                    for i, c, k in zip(some, drawn, band_keys(drawn, settings)):
                        codes[i], keys[i] = c.tobytes(), k
                yield pa.RecordBatch.from_pydict({"doc_id": ids[a:b], "s1": [g[2] for g in got], "s2": [g[3] for g in got], "codes": codes, "bands": keys}, schema=row)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, s1 long, s2 long, codes binary, bands array<long>")


def _sets(ids, texts, idf) -> dict:
    """(hashes, weights) by id for the distinct ids of a batch."""
    distinct = dict(zip(ids, texts))
    return {i: (h, weights(h, c, idf)) for i, (h, c, _, _) in zip(distinct, shingles(list(distinct.values())))}


def verified(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have a weighted Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in slices(batches):
            a, b, ta, tb = (c.to_pylist() for c in p.columns)
            sets_a, sets_b = _sets(a, ta, idf.value), _sets(b, tb, idf.value)
            good = [weighted_jaccard(sets_a[x], sets_b[y]) >= least for x, y in zip(a, b)]
            yield p.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def star_pairs(buckets: DataFrame, pivots: int) -> DataFrame:
    """Pairs of each bucket's ``pivots`` most central members with all its members.

    Central are those that meet most others over all bands. In buckets of up to pivots + 1 members these are all pairs.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rows = buckets.join(sizes, "key")
    central = rows.groupBy("id").agg(F.sum("n").alias("meets"))
    ranked = rows.join(central, "id").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("meets"), "id")))
    chosen = ranked.where(F.col("rank") <= pivots).select("key", F.col("id").alias("p"))
    pairs = rows.select("key", "id").join(chosen, "key").where(F.col("id") != F.col("p"))
    return pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def rest_links(buckets: DataFrame, labels: DataFrame, feats: DataFrame, texts: DataFrame, idf, settings: Settings) -> DataFrame:
    """Links the stars may have missed: in buckets too large for them that still hold several components, all members of
    different components are compared, block against block, so no task holds more than two blocks of a bucket."""
    large = buckets.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > settings.pivots + 1)
    rows = cut(buckets.join(large, "key"), "large-buckets").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = rows.groupBy("key").agg(F.max("n").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where(F.col("lo") != F.col("hi"))
    open_ = open_.select("key", F.ceil(F.col("n") / settings.group).cast("int").alias("parts"))
    rows = rows.join(open_, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = cut(rows.select("key", "id", "component", "part", "parts"), "open-buckets")
    ids = rows.select(F.col("id").alias("doc_id")).distinct()
    content = feats.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "codes", "bands").join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    spread = rows.select("key", "id", "component", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    spread = spread.select("key", "id", "component", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).join(content, "id")
    fewest = int(settings.samples * settings.least - 5 * np.sqrt(settings.samples * settings.least * (1 - settings.least)))

    def compare(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", ignore_index=True)
        codes = np.stack([np.frombuffer(c, dtype=np.uint32) for c in g["codes"]])
        bands = np.stack(g["bands"].to_numpy())
        part, component = g["part"].to_numpy(), g["component"].to_numpy()
        band = int(np.argmax((bands == key[0]).all(axis=0)))
        out, sets = [], None
        for x in range(len(g) - 1):
            y = np.arange(x + 1, len(g))
            y = y[(component[y] != component[x]) & ((part[y] != part[x]) | (key[1] == key[2]))]
            y = y[~(bands[y, :band] == bands[x, :band]).any(axis=1)]  # met in an earlier band
            y = y[(codes[y] == codes[x]).sum(axis=1) >= fewest]
            if len(y) and sets is None:
                sets = _sets(g["id"], g["text"], idf.value)
            out += [(g["id"][x], g["id"][k]) for k in y if weighted_jaccard(sets[g["id"][x]], sets[g["id"][k]]) >= settings.least]
        return pd.DataFrame(out, columns=["a", "b"])

    return spread.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable by links) and kept of every row of ``docs`` (doc_id, text).

    Documents with the same words in order are one class, found by exact grouping; other documents link when they share
    a band and their weighted Jaccard similarity is ``settings.least`` or more. With 14 bands of 3 samples a pair at
    0.8 is missed with probability 4e-5. Within a bucket, stars around its central members come first; what they leave
    in several components is compared pair by pair in blocks. A null or empty text, or one without letters and digits,
    links with nothing. A null doc_id keeps its row, with a null component. Rows that repeat a doc_id share its
    component, which joins all their texts. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))  # 4 MB, whatever the corpus
    known = docs.where(F.col("doc_id").isNotNull())
    feats = cut(features(known, idf, settings).where(F.size("bands") > 0), "features")
    classes = cut(feats.groupBy("s1", "s2").agg(F.min("doc_id").alias("id")), "classes")
    member = cut(feats.select("doc_id", "s1", "s2").join(classes, ["s1", "s2"]).select("doc_id", "id").distinct(), "members")
    reps = feats.join(classes.select(F.col("id").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"]).dropDuplicates(["doc_id", "s1", "s2"])
    buckets = cut(reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")).distinct(), "buckets")
    pairs = cut(star_pairs(buckets, settings.pivots), "pairs")
    wanted = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "candidate-ids")
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_IDS else wanted
    texts = cut(known.join(wanted, "doc_id", "left_semi").distinct(), "candidate-texts")
    several = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where(F.col("a") != F.col("z"))
    links = verified(pairs, texts, idf, settings.least).union(member.join(several, "doc_id").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")))
    first = cut(components(links).select(F.col("node").alias("id"), "component"), "first-components")
    rest = rest_links(buckets, first, reps, texts, idf, settings)
    names = first.select(F.col("id").alias("a"), F.col("component").alias("ca")), first.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    rest = rest.join(names[0], "a", "left").join(names[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(rest).select(F.col("node").alias("component"), F.col("component").alias("final"))
    label = member.join(first, "id", "left").withColumn("component", F.coalesce("component", "id")).join(second, "component", "left")
    label = label.groupBy("doc_id").agg(F.min(F.coalesce("final", "component")).alias("component_id"))
    out = docs.select("doc_id").join(label, "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id; rows without a doc_id all stay."""
    keep = near_duplicates(docs, settings).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.where(F.col("doc_id").isNotNull()).join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where(F.col("doc_id").isNull()))
