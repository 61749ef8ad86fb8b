"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.work import cut


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotations(count: int, dim: int, seed: int) -> np.ndarray:
    """Random signs of ``count`` rotations, three diagonals each."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(count, 3, dim))


def nearest_corners(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest corners of the cross-polytope for each row after one rotation: 2 * axis + (negative)."""
    for s in signs:
        x = hadamard(x * s)
    axes = np.argpartition(-np.abs(x), range(probes), axis=1)[:, :probes] if probes < x.shape[1] else np.argsort(-np.abs(x), axis=1, kind="stable")
    return 2 * axes + (np.take_along_axis(x, axes, axis=1) < 0)


def bucket_keys(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Own bucket (rows x tables) and probed buckets (rows x tables x n) of unit vectors.

    A bucket is one corner of each of ``hashes`` rotations. Probes change one rotation at a time to its next nearest
    corners. Rows are padded with zeros to a power of two.
    """
    dim = max(2, 1 << (x.shape[1] - 1).bit_length())
    if dim != x.shape[1]:
        x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    signs = rotations(tables * hashes, dim, seed)
    width = 2 * dim
    own, more = [], []
    for t in range(tables):
        corners = [nearest_corners(x, signs[t * hashes + j], min(probes + 1, dim)) for j in range(hashes)]
        key = np.full(len(x), t, dtype=np.int64)
        for c in corners:
            key = key * width + c[:, 0]
        own.append(key)
        step = 1
        for c in reversed(corners):
            more += [key + (c[:, p] - c[:, 0]) * step for p in range(1, c.shape[1])]
            step *= width
    n = len(x)
    return np.stack(own, axis=1), np.stack(more, axis=1).reshape(n, -1) if more else np.zeros((n, 0), dtype=np.int64)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and the unit vector in double precision; rows that can link with nothing are left out."""
    v = F.col("embedding").cast("array<double>")
    top = F.array_max(F.transform(v, F.abs))  # scaled by it first, so squares neither overflow nor vanish
    sane = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(sane).select("vec_id", v.alias("v"), top.alias("top")).where(F.col("top") > 0)
    rows = rows.select("vec_id", F.transform("v", lambda x: x / F.col("top")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    return rows.withColumn("norm", norm).select("vec_id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _hashed(units: DataFrame, tables: int, hashes: int, probes: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["v"].map(len)
            for n, part in batch.groupby(length):
                own, more = bucket_keys(np.stack(part["v"].to_numpy()), tables, hashes, probes, seed)
                yield pd.DataFrame({"id": part["id"], "dim": n, "own": list(own), "probe": list(more)})

    return units.select("id", "v").mapInPandas(run, "id long, dim int, own array<long>, probe array<long>")


def _verified(pairs: DataFrame, units: DataFrame, least: float) -> DataFrame:
    a, b = units.select(F.col("id").alias("a"), F.col("v").alias("va")), units.select(F.col("id").alias("b"), F.col("v").alias("vb"))

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(np.dot(p, q)) for p, q in zip(x, y)], dtype="float64")

    both = pairs.join(a, "a").join(b, "b").withColumn("cosine", cosine("va", "vb"))
    return both.where(F.col("cosine") >= least).select("a", "b")


def hash_length(rows: int, dim: int) -> int:
    """Rotations to a bucket key: one more than it takes for as many buckets as rows, so chance meetings stay few."""
    return 1 + max(1, math.ceil(math.log(max(rows, 2)) / math.log(2 * max(dim, 2))))


def pairs_at(cosine: float, dim: int, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``n`` random pairs of unit vectors with this cosine."""
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, dim))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * y


def met(x: np.ndarray, y: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Whether row i of ``x`` and row i of ``y`` are candidates, by table."""
    (own_x, more_x), (own_y, more_y) = (bucket_keys(v, tables, hashes, probes, seed) for v in (x, y))
    look = lambda own, more: np.concatenate((own[:, :, None], more.reshape(len(own), tables, -1)), axis=2)
    return (look(own_x, more_x) == own_y[:, :, None]).any(axis=2) | (look(own_y, more_y) == own_x[:, :, None]).any(axis=2)


def tables_for(dim: int, hashes: int, probes: int, least: float, missed: float = 5e-4, fewest: int = 12) -> int:
    """Tables that miss a pair at the threshold with probability ``missed`` at most, whatever the key length.

    The chance of one table is measured on 2000 random pairs at the threshold in four tables, the same in every run.
    """
    if dim < 2 or not 0 < least < 1:
        return fewest
    x, y = pairs_at(least, dim, 2000, np.random.default_rng(5))
    chance = min(max(met(x, y, 4, hashes, probes, 3).mean(), 1e-3), 0.999)
    return max(fewest, math.ceil(math.log(missed) / math.log(1 - chance)))


def near_duplicates(vectors: DataFrame, least: float = 0.95, tables: int | None = None, hashes: int | None = None, probes: int = 2, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    Two vectors link when their cosine in double precision is at least ``least``. Candidates share a bucket of one of
    ``tables`` tables (by default tables_for the key length, so recall at the threshold holds at every size), a vector looking into its own bucket and into ``probes`` more for each of the ``hashes``
    rotations (by default hash_length of the table, so candidates grow with the rows and not their square); each candidate pair is verified, so there are no false links, and every bucket is joined whole. Equal
    unit vectors are one class, found by exact grouping and weighted by its size. Vectors that are null, zero or hold a
    null or non-finite component link with nothing, as do those of different lengths; a null vec_id keeps its row with
    no links and a null component. Rows that repeat a vec_id repeat its result; among rows of one vec_id with different
    vectors the smallest counts. Other columns are ignored; an empty table gives no rows. Memory is bounded by a batch;
    the pairs of a group of near copies are counted, as n_links asks, but never gathered.
    """
    units = unit_vectors(vectors).groupBy("vec_id").agg(F.min("v").alias("v"))
    units = cut(units.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(seed), "v")), "unit-vectors")
    classes = units.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    member = units.join(classes, ["h1", "h2"]).select("vec_id", "id", "size", "v")
    member = cut(member, "vector-classes")
    reps = member.where(F.col("vec_id") == F.col("id")).select("id", "v")
    if hashes is None or tables is None:
        n, dim = reps.agg(F.count("*"), F.max(F.size("v"))).first()
        hashes = hashes or hash_length(n, dim or 2)
        tables = tables or tables_for(dim or 2, hashes, probes, least)
    hashed = cut(_hashed(reps, tables, hashes, probes, seed), "buckets")
    own = hashed.select(F.col("id").alias("a"), "dim", F.explode("own").alias("key"))
    look = hashed.select(F.col("id").alias("b"), "dim", F.explode(F.concat("own", "probe")).alias("key"))
    pairs = own.join(look, ["dim", "key"]).where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut(_verified(pairs, reps, least), "vector-links")
    sizes = member.where(F.col("vec_id") == F.col("id")).select("id", "size")
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    others = ends.join(sizes.select(F.col("id").alias("other"), "size"), "other").groupBy("id").agg(F.sum("size").alias("others"))
    whole = components(links).select(F.col("node").alias("id"), "component")
    known = member.join(others, "id", "left").join(whole, "id", "left").select(
        "vec_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    out = vectors.select("vec_id").join(known, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
