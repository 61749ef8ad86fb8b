"""Token counts kept as additive totals, maintained by signed deltas in idempotent batches."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources import markers

GROUP = ("source", "lang", "version")
ADDITIVE = ("docs", "tokens")

#: Tokenizer versions by name: a native count of each text's tokens. Any column expression will do.
VERSIONS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))),
    "words-2": lambda text: F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_\x{80}-\x{10FFFF}]+|[^A-Za-z0-9_\x{80}-\x{10FFFF}\x20\x09-\x0D]"), F.lit(0))),
}


def bpe_counter(path: str) -> Callable[[Column], Column]:
    """A version that counts the ids of a public byte-level BPE file."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        from touchline.llm.tokens import encoder

        return pd.Series([len(ids) for ids in encoder(path).encode([t if isinstance(t, str) else None for t in texts])], dtype="int64")

    return lambda text: count(text)


def tokens(text: Column, version: str, counter: Callable[[Column], Column] | None = None) -> Column:
    """Tokens of a text; a null one has none."""
    return (counter or VERSIONS[version])(F.coalesce(text, F.lit(""))).cast("long")


def counted(docs: DataFrame, version: str, counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, source, lang, version and tokens of every document."""
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("version"), tokens(F.col("text"), version, counter).alias("tokens"))


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Inserts (+1) or deletes (-1) of counted documents, summed by group before any shuffle of rows."""
    return rows.groupBy(*GROUP).agg((F.count("*") * sign).alias("docs"), (F.sum("tokens") * sign).alias("tokens"))


def revision(before: DataFrame, after: DataFrame) -> DataFrame:
    """The delta that takes counted documents ``before`` out and puts ``after`` in."""
    return signed(before, -1).unionByName(signed(after, 1)).groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ADDITIVE])


class Ledger:
    """Signed deltas by batch in a shared folder; totals are their sums.

    A commit writes its delta to a folder of its own and then creates the next numbered marker, which names it. A job that
    dies before the marker changes nothing, and readers never see half a delta. Committing a batch again makes its new
    delta count in place of the earlier one, so a repeated or retried commit leaves the totals as they were; batches
    commute, so late ones need no order. ``compact`` sums what is committed, so that totals read its result and the
    batches since. Totals are read from the few delta rows of each batch, never from documents. Null sources, languages
    and texts form groups and counts of their own; a document twice in a batch counts twice; an empty delta commits
    nothing to the totals; other columns are ignored.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.schema = "source string, lang string, version string, docs long, tokens long, delta string"

    def _write(self, kind: str, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select(*GROUP, *ADDITIVE).coalesce(1).write.parquet(f"{self.folder}/{kind}/delta={name}")
        return name

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{kind}")

    def commit(self, batch: str, delta: DataFrame) -> None:
        """Add the delta of ``batch``; an equal id replaces its earlier delta."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch id holds letters, digits, - and _ only: {batch!r}")
        markers.append(self.spark, f"{self.folder}/log", f"{batch}/{self._write('deltas', delta)}")

    def _log(self) -> DataFrame:
        """number, batch, delta of all commits; the batch is empty for a compaction."""
        parts = F.split("text", "/")
        return markers.markers(self.spark, f"{self.folder}/log").select("number", F.get(parts, 0).alias("batch"), F.get(parts, 1).alias("delta"), F.get(parts, 2).cast("long").alias("upto"))

    def _live(self, log: DataFrame, upto: int) -> DataFrame:
        """batch and delta that counts for it, of the commits up to a number."""
        return log.where((F.col("batch") != "") & (F.col("number") <= upto)).groupBy("batch").agg(F.max_by("delta", "number").alias("delta"), F.max("number").alias("number"))

    def deltas(self) -> DataFrame:
        """All rows that count: the last compaction, what was committed since, and minus what that replaced in it."""
        log = self._log()
        base = log.where(F.col("batch") == "").agg(F.max_by(F.struct("delta", "upto"), F.struct("upto", "number")).alias("b")).first()["b"]
        now = self._live(log, (1 << 63) - 1)
        if base is None:
            return self._read("deltas").join(now.select("delta"), "delta", "left_semi")
        since = now.where(F.col("number") > base["upto"])
        replaced = self._live(log, base["upto"]).join(since.select("batch"), "batch", "left_semi").select("delta")
        minus = self._read("deltas").join(replaced, "delta", "left_semi").withColumns({c: -F.col(c) for c in ADDITIVE})
        rows = self._read("totals").where(F.col("delta") == base["delta"]).unionByName(minus)
        return rows.unionByName(self._read("deltas").join(since.select("delta"), "delta", "left_semi"))

    def totals(self) -> DataFrame:
        """Current totals by source, language and version; groups without documents are left out."""
        sums = self.deltas().groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ADDITIVE])
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0))

    def compact(self) -> None:
        """Write the totals of all commits so far and let later reads start from them; no delta is lost or counted twice
        if a commit comes in between, or if this job dies on the way."""
        upto = self._log().agg(F.max("number")).first()[0]
        if upto is None:
            return
        frozen = Ledger(self.spark, self.folder)
        log = self._log().where(F.col("number") <= upto)
        frozen._log = lambda: log  # type: ignore[method-assign]
        markers.append(self.spark, f"{self.folder}/log", f"/{self._write('totals', frozen.totals())}/{upto}")
