"""Ids beyond 2**53 next to a null id come back unchanged from every operator that works in Python."""
import pytest
from pyspark.sql import functions as F

from touchline.llm import html, language, linededup, packing, quality, substrings, wordtable
from touchline.llm.queries import tokenizer_file

IDS = [None, 2**53 + 1, 2**53 + 3, -(2**62) - 1, 7]


@pytest.fixture(scope="module")
def docs(spark):
    text = "The quick brown fox jumps over the lazy dog and runs into the deep dark forest again."
    return spark.createDataFrame([(i, text, "en", "a", None if i == 7 else i) for i in IDS], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[0] for r in df.select(name).distinct().collect()), key=str)


def test_ids_and_other_longs(docs):
    want = sorted(IDS, key=str)
    assert ids(packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))) == want
    assert ids(wordtable.encode_decode(docs, tokenizer_file("word_bpe_49k.json"))) == want
    assert ids(substrings.remove_repeats(docs)) == want
    scored = quality.score(docs)
    assert ids(scored) == want and dict(scored.dtypes)["doc_id"] == "bigint"
    assert ids(scored, "n_chars") == sorted([None, *IDS[1:4]], key=str)
    labelled = language.predict(docs, language.fit(docs.where(F.col("doc_id").isNotNull())))
    assert ids(labelled) == want and ids(labelled, "n_chars") == sorted([None, *IDS[1:4]], key=str)


def test_page_ids(spark):
    pages = spark.createDataFrame([(i, "http://a.b/", "<p>hello there</p>") for i in IDS], "page_id long, url string, html string").coalesce(1)
    assert ids(html.extract(pages), "page_id") == sorted(IDS, key=str)


def test_words_of_one_sign_do_not_link(spark):
    """delta and w1475, epsilon and w929 may share a sign; two of five words differ, so the lines are apart."""
    rows = [(1, "alpha beta gamma delta w929"), (2, "alpha beta gamma epsilon w1475")]
    out = linededup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), linededup.Settings(radius=None))
    assert [r.n_removed for r in out.collect()] == [0, 0]
