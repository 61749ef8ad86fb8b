"""Repeated passages against brute force."""
import hashlib
import random
import re

import pytest

from brute import SF
from touchline.llm import substrings as sub

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def brute(rows, window=20):
    """{(doc_id, text): (n_words, n_removed, kept)}; rows that repeat id and text are one document."""
    seen, out = set(), {}
    for no_id, i, text in sorted({(i is None, i or 0, t or "") for i, t in rows}):
        words = WORD.findall(text)
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            if w in seen:
                gone[p : p + window] = [True] * window
            seen.add(w)
        kept = [w for w, g in zip(words, gone) if not g]
        out[None if no_id else i, text] = (len(words), sum(gone), " ".join(kept))
    return out


def check(spark, rows, **settings):
    want = brute(rows, settings.get("window", 20))
    got = sub.remove_repeats(spark.createDataFrame(rows, SCHEMA), sub.Settings(**settings)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id, r.text], r.doc_id


def corpus(rng, n=60):
    """Documents of few words, shared passages, near copies and copies."""
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "é", "日本"]
    passages = [[rng.choice(vocab) for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(40))]
        if rng.random() < 0.3 and rows:
            words = WORD.findall(rows[rng.randrange(len(rows))][1] or "")
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = "changed"
        rows.append((i * 3 - 20, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("settings", [{}, {"group": 2}, {"window": 7, "anchor": 3}])
def test_against_brute_force(spark, settings):
    check(spark, corpus(random.Random(5)), **settings)


def test_odd_rows(spark):
    base = " ".join(f"a{i}" for i in range(30))
    rows = [
        (None, base), (None, None), (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, base), (5, base), (6, base + " tail"), (6, "head " + base),
        (7, "w " * 500), (8, "x y " * 2000 + base), (2**53 + 1, base), (2**53 + 3, base + "."), (-9, " ".join(f"a{i}" for i in range(5, 26))), (9, " ".join("abc") + " " + base),
    ]
    check(spark, rows)
    check(spark, rows, group=1)


def test_exactly_a_window_and_one_less(spark):
    words = [f"q{i}" for i in range(20)]
    check(spark, [(1, " ".join(words)), (2, "p " + " ".join(words) + " r"), (3, " ".join(words[:19])), (4, " ".join(words[:19]) + " z")])


def test_empty_table_and_other_columns(spark):
    assert sub.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, "a b", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, n_words int, prefix string")
    assert [r.n_words for r in sub.remove_repeats(rows).orderBy("doc_id").collect()] == [2, 0]


def test_many_occurrences_of_one_passage(spark):
    """A third of the documents hold one passage, with other words around it each time."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} c{i} {passage} d{i} e{i}" if i % 3 == 0 else f"only {i}") for i in range(900)]
    check(spark, rows, group=50)


def test_whole_table(spark, docs):
    from touchline.llm.queries import QUERIES

    want = {i: (n, r, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, r, k) in brute([tuple(r) for r in docs.select("doc_id", "text").collect()]).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op11_substring_dedup"](spark, SF).collect()}
    assert got == want


def test_anchors_of_a_document_come_in_one_row(spark):
    """However many parts its anchors are dealt to, so rows grow with the documents."""
    rng = random.Random(3)
    text = [" ".join(rng.choices("abcdefghijklmnop", k=200)) for _ in range(5)]
    rows = spark.createDataFrame([(i, text[i % 5]) for i in range(40)], SCHEMA).repartition(4)
    found = sub.repeated_anchors(sub._documents(rows), 8, sub.Settings()).collect()
    assert len(found) == len({r["dk"] for r in found}) == 40
