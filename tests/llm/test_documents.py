"""Language, quality, PII and token counts against plain Python."""
import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import language, pii, quality, rollups
from touchline.llm.queries import tokenizer_file


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            cover |= set(range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), n < 10 or 100 * len(cover) > 20 * n


def test_counted_rules(docs, texts):
    rows = quality.score(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in (*quality.COUNTS, "base_failed")) == counted(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_junk_goes_and_prose_stays(docs, spark):
    base = [r["text"] for r in docs.where("lang = 'en'").limit(5).collect()]
    good = [t for t in base if len(t.split()) > 80 and not re.search(r"[#$%&|]|!!", t)]
    rows = [(i, t, None) for i, t in enumerate(good)]
    rows += [(100 + i, " ".join(f"{w}{'###&&&$$$'[3 * (k % 3):][:3]}" for k, w in enumerate(t.split())), None) for i, t in enumerate(good)]
    both = docs.select("doc_id", "text", "lang").where("lang is not null").withColumn("doc_id", F.col("doc_id") + 1000).union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r["doc_id"]: r["kept"] for r in quality.score(both).where("doc_id < 1000").collect()}
    assert all(kept[i] == (i < 100) for i in kept)


def test_js_distance():
    p, q = np.array([[0.5, 0.5, 0]]), np.array([0, 0, 1.0])
    assert quality.js_distance(p, q)[0] == pytest.approx(1)
    assert quality.js_distance(p, p[0])[0] == 0


def test_quality_scans_small_parts_of_a_batch():
    texts = [f"{i} " + "word and other " * 100 for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    seen = [(part["text"].to_pylist(), f.counts["n_words"].tolist()) for part, f in quality._blocks([batch])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum((t for t, _ in seen), []) == texts and sum((n for _, n in seen), []) == [301] * 2000
    assert peak < 40e6  # 3 million signs


def test_quality_passes_other_columns_on(spark):
    """Longs beside nulls, odd names, nested values, times and decimals come back as they went in."""
    sql = "select 9007199254740993L as `a b`, 'x' as text, 'en' as lang, array(struct(1 as u, 'v' as w)) as n, timestamp'2024-03-31 02:30:00' as at, 1.50BD as d, map('k', 1L) as m"
    rows = spark.sql(sql + " union all select null, null, null, null, null, null, null")
    out = quality.score(rows)
    assert out.dtypes[:7] == rows.dtypes
    assert sorted(map(str, out.select(*[f"`{c}`" for c in rows.columns]).collect())) == sorted(map(str, rows.collect()))


def test_quality_odd_rows(odd):
    rows = quality.score(odd.withColumn("Kept", F.lit("old"))).collect()
    assert len(rows) == odd.count() and all(isinstance(r["kept"], bool) for r in rows)
    assert not any(r["kept"] for r in rows if not r["text"])
    unlabelled = quality.score(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r["char_distance"] == 0 for r in unlabelled)
    assert quality.score(odd.limit(0)).count() == 0


def test_language_held_out_accuracy(docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.fit(docs.where(~held))
    rows = language.predict(docs.where(held), model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_score_is_the_kernel_form(docs):
    """Folding landmarks into one matrix leaves the scores of Nystroem features times ridge weights."""
    rows = docs.where("lang is not null").select("doc_id", "lang", "text").limit(40).collect()
    p = language.Presence()

    def grams(text):
        return set(p.slots(text).tolist())

    spark = docs.sparkSession
    sample = language.training_sample(spark.createDataFrame(rows), 5).collect()
    assert max(Counter(r["lang"] for r in sample).values()) <= 5
    sample.sort(key=lambda r: (r["lang"], r["rank"]))
    sets = [grams(r["text"]) for r in sample]
    land = [s for s, r in zip(sets, sample) if r["rank"] <= 3]
    k = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    kmm = np.array([[k(a, b) for b in land] for a in land])
    values, vectors = np.linalg.eigh(kmm)
    root = vectors / np.sqrt(values)
    phi = np.array([[k(a, b) for b in land] for a in sets]) @ root
    langs = sorted({r["lang"] for r in sample})
    y = np.array([[1.0 if r["lang"] == x else -1.0 for x in langs] for r in sample])
    w = np.linalg.solve(phi.T @ phi + 1e-2 * len(phi) / 100 * np.eye(len(land)), phi.T @ y)
    model = language.fit(spark.createDataFrame(rows), per_lang=5, landmarks_per_lang=3)
    for r in rows[:10]:
        g = grams(r["text"])
        want = np.array([k(g, b) for b in land]) @ root @ w
        mark = np.isin(model.slots, list(g))
        assert mark @ model.weights / np.sqrt(len(g)) == pytest.approx(want, abs=1e-3)


def test_language_odd_rows(odd):
    model = language.fit(odd)
    rows = {(r["doc_id"], r["text"]): r["lang_pred"] for r in language.predict(odd.withColumn("Score", F.lit("x")), model).collect()}
    assert rows[(1, None)] == rows[(2, "")] == rows[(5, "!!! --- ???")] == "und"
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(odd.limit(0))).collect()} == {"und"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m.group())]


def same_spans(found):
    for r in found.collect():
        base = base_spans(r["text"])
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in dict((b[0], 0) for b in BASE)] == base
    sums = {r["doc_id"]: r for r in pii.digests(found).collect()}
    for r in found.collect():
        base = base_spans(r["text"])
        assert sums[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()
        assert sums[r["doc_id"]]["n_card"] == sum(s[0] == "card" for s in base)


def test_pii_base_spans(docs, odd, spark):
    same_spans(pii.find(docs))
    same_spans(pii.find(odd.where("doc_id <> 7")))
    hard = ["x" * 5000 + "@", "1" * 20000, "a@b.c_d@e.f. g@h..i", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255", "é+12 (345) 678-90.", "+1" + " 2" * 3000, "0 1 2 3 4 5 6 7 8 9 0 1 2 3", "a@b.c@d.e", "𝒳 x@y.zz 😀 +49 30 1234567"]
    same_spans(pii.find(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")))


def test_pii_checked_kinds_and_context(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32 ok"), (2, "GB82WEST12345698765432"), (3, "GB83WEST12345698765432"), (4, "number 123-45-6789"), (5, "my social security number is 123-45-6789"), (6, "SSN 000-45-6789")]
    got = {r["doc_id"]: [s["kind"] for s in r["pii"] if s["kind"] in ("iban", "ssn")] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["iban"], 2: ["iban"], 3: [], 4: [], 5: ["ssn"], 6: []}


def test_redaction(spark, odd):
    rows = [(1, "é a@b.co, call +1 (555) 555-5555.", 3), (2, None, None), (3, "clean", 5)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(pii.find(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))).collect()}
    assert got == {1: ("é [EMAIL], call [PHONE].", 24), 2: (None, None), 3: ("clean", 5)}
    assert pii.redact(pii.find(odd)).count() == odd.count() and pii.find(odd.limit(0)).count() == 0


def test_ledger_is_idempotent_and_additive(spark, odd, tmp_path):
    ledger = rollups.Ledger(spark, str(tmp_path))
    one, two = rollups.counted(odd, "words-1"), rollups.counted(odd, "words-2")
    ledger.commit("a", rollups.signed(one, 1))
    first = {tuple(r) for r in ledger.totals().collect()}
    want = Counter()
    for r in odd.collect():
        want[(r["source"], r["lang"], "words-1")] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert {r[:3]: r[4] for r in first} == dict(want)
    ledger.commit("a", rollups.signed(one, 1))
    assert {tuple(r) for r in ledger.totals().collect()} == first
    ledger.commit("b", rollups.revision(one, two))
    assert {r["version"] for r in ledger.totals().collect()} == {"words-2"}
    ledger.commit("c", rollups.signed(two, -1))
    ledger.commit("empty", rollups.signed(one.limit(0), 1))
    assert ledger.totals().count() == 0
    with pytest.raises(ValueError):
        ledger.commit("../x", rollups.signed(one, 1))


def test_commits_that_die_and_compaction(spark, tmp_path, monkeypatch):
    """A job that dies before its marker changes nothing; totals stay the same over compactions and replaced batches."""
    from touchline.sources import markers

    rows = lambda *r: spark.createDataFrame(r, "source string, lang string, version string, docs long, tokens long")
    ledger = rollups.Ledger(spark, str(tmp_path))
    seen = lambda: sorted(map(tuple, rollups.Ledger(spark, str(tmp_path)).totals().collect()), key=str)
    ledger.commit("a", rows(("s", "en", "v", 2, 10), (None, None, "v", 1, 0)))
    before = seen()
    with monkeypatch.context() as m:
        m.setattr(markers, "append", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.commit("a", rows(("s", "en", "v", 9, 99)))
        with pytest.raises(OSError):
            ledger.compact()
    assert seen() == before == sorted([("s", "en", "v", 2, 10), (None, None, "v", 1, 0)], key=str)
    ledger.commit("b", rows(("s", "en", "v", -1, -4), ("t", "de", "w", 3, 7)))
    want = sorted([("s", "en", "v", 1, 6), (None, None, "v", 1, 0), ("t", "de", "w", 3, 7)], key=str)
    assert seen() == want
    ledger.compact()
    assert seen() == want
    ledger.commit("b", rows(("s", "en", "v", -1, -4), ("t", "de", "w", 5, 8)))  # replaces what the compaction holds
    ledger.commit("c", rows(("u", "fr", "w", 1, 1)))
    want = sorted([("s", "en", "v", 1, 6), (None, None, "v", 1, 0), ("t", "de", "w", 5, 8), ("u", "fr", "w", 1, 1)], key=str)
    assert seen() == want
    ledger.compact()
    ledger.commit("c", rows(("u", "fr", "w", 1, 1)))
    assert seen() == want


def test_two_public_tokenizers_as_versions(spark, docs, tmp_path):
    """Documents move from one public BPE file to another; the totals are those of the library."""
    from tokenizers import Tokenizer

    from touchline.llm.queries import tokenizer_file

    some = docs.where("doc_id % 4 = 0")
    path = tokenizer_file("byte_bpe_50k.json")
    one = rollups.counted(some, "words-1").persist()
    two = rollups.counted(some, "byte-bpe", rollups.bpe_counter(path))
    ledger = rollups.Ledger(spark, str(tmp_path))
    ledger.commit("load", rollups.signed(one, 1))
    ledger.commit("move", rollups.revision(one, two))
    library, want = Tokenizer.from_file(path), {}
    for r in some.collect():
        key = (r.source, r.lang, "byte-bpe")
        n, total = want.get(key, (0, 0))
        want[key] = (n + 1, total + len(library.encode(r.text or "", add_special_tokens=False).ids))
    assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in ledger.totals().collect()} == want


def test_bpe_version_counts_tokens(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    part = docs.limit(20)
    rows = part.collect()
    got = {r["doc_id"]: r["tokens"] for r in rollups.counted(spark.createDataFrame(rows, docs.schema), "bpe", rollups.bpe_counter(path)).collect()}
    assert got == {r["doc_id"]: len(t.encode(r["text"], add_special_tokens=False).ids) for r in rows}
