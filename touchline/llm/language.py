"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (orders 1 to 3, blended) present in both, normalised by the
numbers present in each. Nystroem features against a few landmark texts feed one-versus-rest kernel ridge regression.
Because the score is linear in the presence of landmark n-grams, the fitted model is one matrix (n-grams x languages)
and a batch of texts is scored by one matrix product.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.textscan import Flat, table
from touchline.llm.work import map_rows

ORDERS = 3
#: n-grams are told apart by a hash of this many bits.
BITS = 18
BATCH = 256


class Presence:
    """Which n-grams a text has. Letters are lower-cased, every run of other signs counts as one blank."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, dtype=bool)

    def slots(self, text: str) -> np.ndarray:
        """Slots of the text's n-grams, repeated as they occur; none if it has no letter."""
        cp = Flat([text.lower()]).cp
        letter = table("alpha")[cp]
        if not letter.any():
            return np.zeros(0, dtype=np.uint32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first sign after a letter stands for the run
        c = np.where(letter, cp, 32)[keep].astype(np.uint32)
        c = np.concatenate(([np.uint32(32)], c)) if c[0] != 32 else c
        out, h = [], np.zeros(len(c), dtype=np.uint32)
        for n in range(ORDERS):
            if len(c) <= n:
                break
            h = (h[: len(c) - n] * np.uint32(0x01000193)) ^ (c[n:] * np.uint32(0x9E3779B1))
            g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * n)
            out.append(g >> np.uint32(32 - BITS))
        return np.concatenate(out)

    def mark(self, slots: np.ndarray) -> int:
        self.seen[slots] = True
        return int(np.count_nonzero(self.seen))

    def clear(self, slots: np.ndarray) -> None:
        self.seen[slots] = False


@dataclass
class Model:
    langs: list[str]
    slots: np.ndarray  # landmark n-grams
    weights: np.ndarray  # landmark n-grams x languages


def training_sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """At most ``per_lang`` labelled rows of each language, by the order of a hash of their ids.

    A first filter on the hash leaves about four times as many, so the ordering never meets a whole language. The
    number of rows of each language goes through the driver.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text").withColumn("h", F.xxhash64("doc_id"))
    counts = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang").count().collect()
    share = (F.col("h").cast("double") / F.lit(2.0**64)) + 0.5
    few = [F.col("lang").eqNullSafe(r["lang"]) & (share * r["count"] <= 4 * per_lang) for r in counts]
    near = labelled.where(reduce(lambda a, b: a | b, few, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("lang", "rank", "text")


def fit(docs: DataFrame, per_lang: int = 500, landmarks_per_lang: int = 48, ridge: float = 1e-2) -> Model | None:
    """The model of ``docs`` (doc_id, lang, text), from a bounded sample: ``per_lang`` rows of each language.

    Executors turn the sampled texts into presence bits (2**18 bits a row at most); those meet in the driver, which
    solves two small systems. Null labels and texts without letters teach nothing; None if nothing is left.
    """

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Presence()
        for batch in batches:
            rows = []
            for lang, rank, text in zip(batch["lang"], batch["rank"], batch["text"]):
                s = p.slots(text)
                if len(s):
                    p.mark(s)
                    rows.append((lang, rank, zlib.compress(np.packbits(p.seen).tobytes(), 1)))
                    p.clear(s)
            yield pd.DataFrame(rows, columns=["lang", "rank", "bits"])

    got = training_sample(docs, per_lang).mapInPandas(bits, "lang string, rank int, bits binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "rank"], ignore_index=True)
    row = lambda packed: np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8))
    langs = sorted(got["lang"].unique())
    mark = (got.groupby("lang").cumcount() < landmarks_per_lang).to_numpy()
    slots = np.flatnonzero(reduce(np.bitwise_or, map(row, got["bits"][mark])))
    size = np.sqrt([int(row(b).sum()) for b in got["bits"]])
    unit = lambda i: (row(got["bits"][i])[slots] / size[i]).astype(np.float32)
    land = np.stack([unit(i) for i in np.flatnonzero(mark)])
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    good = values > 1e-8 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # Nystroem map, K_mm ** -1/2 up to a rotation
    phi = np.stack([land @ unit(i) for i in range(len(got))]).astype(np.float64) @ root
    y = np.where(got["lang"].to_numpy()[:, None] == np.array(langs, dtype=object)[None, :], 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + ridge * len(phi) / 100 * np.eye(phi.shape[1]), phi.T @ y)
    return Model(langs, slots, land.T @ (root @ w).astype(np.float32))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), from the whole text alone.

    Null texts and texts without letters get ``und`` and 0, as does everything without a model. Equal scores go to the
    language first in order. Columns named lang_pred or score are replaced; repeated rows come back as often.
    """
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Presence()
        for batch in batches:
            for a in range(0, len(batch), BATCH):
                part = batch.iloc[a : a + BATCH].copy()
                n = len(part)
                lang, score = np.full(n, "und", dtype=object), np.zeros(n)
                if model is not None:
                    x, has = np.zeros((n, len(model.slots)), dtype=np.float32), np.zeros(n, dtype=bool)
                    size = np.ones(n, dtype=np.float32)
                    for i, text in enumerate(part["text"]):
                        s = p.slots(text) if isinstance(text, str) else ()
                        if len(s):
                            size[i] = np.sqrt(p.mark(s))
                            x[i] = p.seen[model.slots]
                            has[i] = True
                            p.clear(s)
                    f = (x @ model.weights) / size[:, None]
                    best = f.argmax(axis=1)
                    lang[has] = np.array(model.langs, dtype=object)[best[has]]
                    score[has] = np.clip((f[np.arange(n), best] + 1) / 2, 0, 1)[has]
                part["lang_pred"], part["score"] = lang, score
                yield part

    return map_rows(docs.select(*keep), run, schema, keep)
