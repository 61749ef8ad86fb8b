"""The registered queries of this folder and their SQL."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import conversations, html, language, linededup, minhash, packing, pii, quality, rollups, spelling, substrings, vectors, wordtable
from touchline.llm.work import cut
from touchline.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file, the same on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_minhash_dedup")
def _(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_html_extraction")
def _(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op3_packing")
def _(spark, sf_dir):
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


@query("op4_language_id")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


@query("op5_pii")
def _(spark, sf_dir):
    return pii.digests(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op6_embedding_dedup")
def _(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_quality_rules")
def _(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents")).drop("text", "lang", "source", "n_chars")


@query("op8_bpe_codec")
def _(spark, sf_dir):
    return wordtable.digests(wordtable.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


@query("op9_line_dedup")
def _(spark, sf_dir):
    return linededup.deduplicate_lines(table(spark, sf_dir, "documents"), linededup.WHOLE).select("doc_id", "n_lines", "n_removed", "text")


ROLLUP_SQL = r"""
WITH labelled AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
counted AS (
  SELECT d.source, d.lang, CASE WHEN l.doc_id IS NULL THEN 'words-1' ELSE 'words-2' END AS version,
    CASE WHEN l.doc_id IS NULL THEN len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))
      ELSE len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_\x{80}-\x{10FFFF}]+|[^A-Za-z0-9_\x{80}-\x{10FFFF}\x20\x09-\x0D]')) END AS n
  FROM documents d LEFT JOIN labelled l ON d.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) <> 1)
SELECT source, lang, version, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM counted GROUP BY ALL"""


@query("op10_token_counts", ROLLUP_SQL)
def _(spark, sf_dir):
    """All documents enter; those labelled toxic leave; labelled ones move to the second version; one batch comes twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    # each text is counted once; then counts are joined, not texts
    counts = cut(docs.select("doc_id", "source", "lang", *[rollups.tokens(F.col("text"), v).alias(v) for v in ("words-1", "words-2")]), "token-counts")
    one, two = (counts.select("doc_id", "source", "lang", F.lit(v).alias("version"), F.col(f"`{v}`").alias("tokens")) for v in ("words-1", "words-2"))
    leave, move = labels.where(toxic).select("doc_id"), labels.where(~toxic).select("doc_id")
    ledger = rollups.Ledger(spark, f"{shared_folder(spark)}/corpus/token-counts-{uuid.uuid4().hex}")
    ledger.commit("load", rollups.signed(one, 1))
    ledger.commit("toxic-out", rollups.signed(one.join(leave, "doc_id", "left_semi"), -1))
    for _ in range(2):
        ledger.commit("recount", rollups.revision(one.join(move, "doc_id", "left_semi"), two.join(move, "doc_id", "left_semi")))
    return ledger.totals()


@query("op11_substring_dedup")
def _(spark, sf_dir):
    return substrings.digests(substrings.remove_repeats(table(spark, sf_dir, "documents")))


@query("op12_spelling_variants")
def _(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query("op13_conversation_trie")
def _(spark, sf_dir):
    return conversations.conversation_trie(table(spark, sf_dir, "conversations"))
