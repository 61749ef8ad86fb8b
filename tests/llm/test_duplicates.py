"""MinHash, line and vector near-duplicates, and components, against brute force."""
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from touchline.llm import linededup, minhash, vectors
from touchline.llm.work import slices
from touchline.llm.components import components

from brute import SF, union_find


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(500, 500), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == union_find({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


VOCABULARY = [f"w{i}" for i in range(400)]


def near_copies(seed, groups=6, copies=12):
    """Texts in groups of copies with a growing number of changed words, and loners."""
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [rng.choice(VOCABULARY) for _ in range(200)]
        for k in range(copies):
            words = list(base)
            for _ in range(k // 3):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            out.append(" ".join(words))
    out += [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 80))) for _ in range(30)]
    rng.shuffle(out)
    return out


def brute_components(rows, least):
    """Components by the weighted Jaccard similarity of all pairs, with exact document frequencies."""
    sets = {i: Counter() for i, _ in rows}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i].update([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
    df = Counter(x for s in sets.values() for x in s)
    n = sum(bool(s) for s in sets.values())
    weigh = {i: {x: (1 + np.log(c)) * (1 - np.log(max(df[x] / n, minhash.LEAST_SHARE))) for x, c in s.items()} for i, s in sets.items()}
    links = []
    ids = [i for i, s in sets.items() if s]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = sum(min(v, weigh[b][x]) for x, v in weigh[a].items() if x in weigh[b])
            if both and both / (sum(weigh[a].values()) + sum(weigh[b].values()) - both) >= least:
                links.append((a, b))
    return union_find(sets, links)


@pytest.mark.parametrize("settings", [minhash.Settings(), minhash.Settings(pivots=1, group=4)])
def test_minhash_components_equal_brute_force(spark, settings):
    rows = list(enumerate(near_copies(5)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()}
    want = brute_components(rows, settings.least)
    assert len(set(want.values())) < len(rows) - 30
    assert got == want


def test_consistent_sampling_estimates_weighted_jaccard():
    settings = minhash.Settings(bands=400, rows=3)
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    a, b = (h[:250], rng.uniform(0.5, 6, 250)), (h[50:], rng.uniform(0.5, 6, len(h) - 50))
    both = np.concatenate((a[0], b[0])), np.log(np.concatenate((a[1], b[1])))
    drawn = minhash.samples(*both, np.array([0, 250]), settings, minhash.sampling_tables(1))
    assert (drawn[0] == drawn[1]).mean() == pytest.approx(minhash.weighted_jaccard(a, b), abs=0.05)


def test_minhash_odd_rows(odd):
    rows = minhash.near_duplicates(odd.withColumn("component_id", odd["doc_id"])).collect()
    assert len(rows) == odd.count()
    assert all(r["component_id"] == r["doc_id"] for r in rows)
    kept = minhash.deduplicate(odd).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_one_id_with_two_texts_joins_both(spark):
    a, b = near_copies(9, groups=2, copies=1)[:2]
    rows = [(3, a), (5, a), (5, b), (9, b), (4, "quite another text of its own words")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 4: 4}


def brute_lines(rows, settings):
    """Kept text of each document by comparing all pairs of different lines."""
    cut = regex.compile(r"[^\p{L}\p{N}]+")
    places = {}
    for i, text in rows:
        for p, line in enumerate((text or "").split("\n")):
            w = tuple(x for x in cut.split(line.lower()) if x)
            if len(w) >= settings.min_words:
                places.setdefault(w, []).append((i, p))

    def sim(w):
        h = np.array([xxhash.xxh64(x.encode(), seed=42).intdigest() for x in w], dtype=np.uint64)
        ones = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
        return sum(1 << b for b in range(64) if ones[b] * 2 > len(w))

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    lines = list(places)
    sims = [sim(w) for w in lines]
    links = [(j, i) for i in range(len(lines)) for j in range(i) if (sims[i] ^ sims[j]).bit_count() <= 3 and 1 - distance(lines[i], lines[j]) / max(len(lines[i]), len(lines[j])) >= settings.least - 1e-12]
    group = {}
    for k, root in union_find(range(len(lines)), links).items():
        group.setdefault(root, []).extend(places[lines[k]])
    gone = {x for g in group.values() for x in set(g) - {min(g)}}
    return {i: "\n".join(line for p, line in enumerate(text.split("\n")) if (i, p) not in gone) for i, text in rows if text is not None}, len(links)


def test_lines_equal_brute_force(spark):
    settings = linededup.Settings()
    rng = random.Random(4)
    base = [[rng.choice(VOCABULARY) for _ in range(rng.randrange(3, 90))] for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice(VOCABULARY) for _ in range(30)]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            lines.append(" ".join(w).title() + rng.choice(["", ".", " !"]))
        rows.append((i, "\n".join(lines)))
    base[0] = [rng.choice(VOCABULARY) for _ in range(60)]
    for i in range(60, 90):  # many variants of one line
        w = list(base[0])
        w[i % 60] = rng.choice(VOCABULARY)
        rows.append((i, " ".join(w)))
    want, links = brute_lines(rows, settings)
    assert links > 10
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()}
    assert got == want


def test_lines_of_documents(docs, texts):
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicate_lines(docs).collect()}
    assert got == brute_lines(sorted(texts.items()), linededup.Settings())[0]


def brute_edit_lines(rows, least, min_words):
    """Kept text of each document by the edit similarity of all pairs of different lines alone, and the pairs' words."""
    places = {}
    for i, text in rows:
        for p, line in enumerate(text.split("\n")):
            w = tuple(regex.findall(r"[\p{L}\p{N}]+", line.lower()))
            if len(w) >= min_words:
                places.setdefault(w, []).append((i, p))

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    lines = list(places)
    sets = {w: set(w) for w in lines}
    apart = lambda a, b: max(len(a), len(b)) - min(len(a) - sum(x not in sets[b] for x in a), len(b) - sum(x not in sets[a] for x in b))  # edits at least
    near = lambda a, b: min(len(a), len(b)) >= least * max(len(a), len(b)) - 1e-9 and 1 - apart(a, b) / max(len(a), len(b)) >= least - 1e-9 and 1 - distance(a, b) / max(len(a), len(b)) >= least - 1e-9
    links = [(j, i) for i in range(len(lines)) for j in range(i) if near(lines[i], lines[j])]
    group = {}
    for k, root in union_find(range(len(lines)), links).items():
        group.setdefault(root, []).extend(places[lines[k]])
    gone = {x for g in group.values() for x in set(g) - {min(g)}}
    return {i: "\n".join(line for p, line in enumerate(text.split("\n")) if (i, p) not in gone) for i, text in rows}, [(lines[a], lines[b]) for a, b in links]


@pytest.mark.parametrize("least", [0.8, 0.9, 0.6])
def test_whole_line_dedup_finds_every_pair_by_edit_similarity(spark, least):
    """Substitutions, insertions and deletions up to the threshold, at all lengths from five words."""
    rng, rows = random.Random(12), []
    for n in [*range(5, 32), 50, 77, 120]:
        base = [rng.choice(VOCABULARY) for _ in range(n)]
        rows.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(int((1 - least) * n + 1e-9) + rng.randrange(2)):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (kind != 0)] = [rng.choice(VOCABULARY)] if kind < 2 else []
            rows.append(" ".join(w))
    rows = list(enumerate(rows))
    settings = linededup.Settings(least=least, radius=None)
    want, links = brute_edit_lines(rows, least, settings.min_words)
    assert len(links) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = linededup._lines(df, 5).selectExpr("h1 as id", "size(words) as words", "array_join(words, ' ') as line").distinct()
    name = {r["id"]: tuple(r["line"].split()) for r in keys.collect()}
    pairs = linededup.similar(linededup.candidates(keys, least), keys, least).collect()
    assert {frozenset((name[r["a"]], name[r["b"]])) for r in pairs} == {frozenset(p) for p in links}
    assert {r["doc_id"]: r["text"] for r in linededup.deduplicate_lines(df, settings).collect()} == want


def test_registered_line_dedup_equals_edit_similarity(spark, texts):
    from touchline.llm.queries import QUERIES

    got = {r["doc_id"]: r["text"] for r in QUERIES["op9_line_dedup"](spark, SF).collect()}
    assert got == brute_edit_lines(sorted((i, t) for i, t in texts.items() if t is not None), 0.8, 5)[0]


def test_long_lines_vote_alike(spark):
    """Both widths of the counters give the SimHash of plain counting."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(VOCABULARY) for _ in range(n)) for n in (5, 64, 16_383, 16_384, 40_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["sim"] & (1 << 64) - 1 for r in linededup.simhashes(rows, 5).collect()}
    for i, text in enumerate(texts):
        w = text.split()
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in w]
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(w))


def test_repeated_rows_vote_once(spark):
    """A row that comes 200 times has the SimHash of one that comes once."""
    rng = random.Random(3)
    text = " ".join(rng.choice(VOCABULARY) for _ in range(100))
    rows = spark.createDataFrame([(1, text)] * 200 + [(None, text)] * 200 + [(2, text)], "doc_id long, text string")
    got = {(r["doc_id"], r["sim"]) for r in linededup.simhashes(rows, 5).collect()}
    assert len(got) == 3 and len({sim for _, sim in got}) == 1


def test_lines_odd_rows(odd):
    rows = linededup.deduplicate_lines(odd.withColumn("n_lines", odd["doc_id"])).collect()
    assert len(rows) == odd.count()
    by = {(r["doc_id"], i): r for i, r in enumerate(rows)}
    assert [r["text"] for r in by.values() if r["doc_id"] == 1] == [None]
    assert [r["text"] for r in by.values() if r["doc_id"] == 7] == ["one two three four five six seven"] * 2
    assert [r["text"] for r in by.values() if r["doc_id"] is None] == [""]
    assert linededup.deduplicate_lines(odd.limit(0)).count() == 0


def clustered(seed, n=300, dim=48):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * rng.uniform(0.02, 0.5, (n, 1))
    return x.astype(np.float32)


def brute_vectors(x, least):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    return [(j, i) for i in range(len(u)) for j in range(i) if u[i] @ u[j] >= least]


def test_vectors_against_brute_force(spark):
    x = clustered(1)
    x[10] = x[11]
    links = brute_vectors(x, 0.95)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    out = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    degree = Counter(i for p in links for i in p)
    assert all(out[i]["n_links"] <= degree[i] for i in out)  # no false link
    assert sum(r["n_links"] for r in out.values()) >= 0.99 * 2 * len(links)
    want = union_find(range(len(x)), links)
    assert np.mean([out[i]["component_id"] == want[i] for i in out]) >= 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.values())


@pytest.mark.parametrize("hashes", [2, 3, 4, 5, 6])
def test_vector_recall_holds_for_every_key_length(hashes):
    """Pairs at the threshold are candidates whatever the number of rows asks of the keys."""
    x, y = vectors.pairs_at(0.95, 64, 4000, np.random.default_rng(9))
    tables = vectors.tables_for(64, hashes, 2, 0.95)
    assert vectors.met(x, y, tables, hashes, 2, 7).any(axis=1).mean() >= 0.998


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 0.0]), (4, [nan, 1.0, 0.0]), (5, [inf, 1.0, 0.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [2.0, 4.0, 6.0]), (8, [2.0, 4.0, 6.0]),
        (9, [1e-38, 2e-38, 3e-38]), (10, [3e38, 0.0, 0.0]), (11, [1.0, 0.0]), (None, [1.0, 2.0, 3.0]), (12, [1.0]), (13, [5.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()))
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6)]
    assert out == [(0, 0, None, True), *alone, (7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False), (9, 2, 7, False), (10, 0, 10, True), (11, 0, 11, True), (12, 1, 12, True), (13, 1, 12, False)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert vectors.hadamard(vectors.hadamard(x)) == pytest.approx(x)


def test_passes_over_runs_give_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        w = rng.choices(VOCABULARY, k=rng.randrange(5, 40))
        rows += [" ".join(w), " ".join(w[:2] + ["zz"] + w[3:])]
    keys = spark.createDataFrame([(i, len(r.split()), r) for i, r in enumerate(dict.fromkeys(rows))], "id long, words int, line string")
    whole = {tuple(r) for r in linededup.candidates(keys, 0.8).collect()}
    shares = [{tuple(r) for r in linededup.candidates(keys, 0.8, k, 3).collect()} for k in range(3)]
    assert whole and set().union(*shares) == whole and all(s != whole for s in shares)


def test_shuffle_files_go_with_the_write(spark):
    """Steps of an operator do not add up on disk."""
    import glob
    import tempfile
    import time

    from touchline.llm.work import CLEANUP, cut

    files = lambda: set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*"))
    before, setting = files(), spark.conf.get(CLEANUP, "false")
    out = cut(spark.range(10_000).repartition(7, "id"), "rows")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and out.count() == 10_000 and spark.conf.get(CLEANUP, "false") == setting


def test_families_of_near_lines_make_no_square_of_pairs(spark, monkeypatch):
    """Lines of a family are held against one of it, not against each other; a line near the edge of the family still joins it."""
    rng, held = random.Random(21), []
    similar = linededup.similar
    monkeypatch.setattr(linededup, "similar", lambda pairs, *rest: held.append(pairs.count()) or similar(pairs, *rest))
    base = [f"base{k}{rng.choice(VOCABULARY)}" for k in range(40)]
    rows = [" ".join(base[:k] + [f"own{k}x{i}"] + base[k + 1 :]) for i, k in enumerate(rng.randrange(30) for _ in range(200))]
    rows.append(" ".join(base[:32] + [f"edge{k}" for k in range(8)]))  # eight words from the base, nine from the others
    rows.append(" ".join(base[:30] + [f"far{k}" for k in range(10)]))
    out = linededup.deduplicate_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), linededup.WHOLE).collect()
    want = brute_edit_lines(list(enumerate(rows)), 0.8, 5)[0]
    assert {r["doc_id"]: r["text"] for r in out} == want
    assert 0 < sum(held) < 10 * len(rows)


def test_lines_that_meet_by_chance_are_parted_there(spark, monkeypatch):
    """Lines of other words that share a pair of words give no pairs that grow with the square of them."""
    rng, held = random.Random(23), []
    met = linededup._met
    monkeypatch.setattr(linededup, "_met", lambda *a: held.append(met(*a).count()) or met(*a))
    rows = [f"extraordinarily{'y' * 20} longest{'z' * 20} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in [*[14] * 150, *[70] * 150]]
    rows.append(rows[0] + " more")
    out = linededup.deduplicate_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), linededup.WHOLE).collect()
    assert {r["doc_id"] for r in out if r["text"] == ""} == {300}
    assert held and sum(held) < len(rows)


def test_marks_part_no_near_lines(spark):
    """At all lengths, about LONG words too, and whichever edits make up the distance."""
    rng, rows = random.Random(24), []
    for n in [*range(5, 70), 100, 150, 400]:
        words = [rng.choice(VOCABULARY) + str(rng.randrange(40)) for _ in range(n)]
        for kinds in ((0,), (1,), (2,), (0, 1, 2)):
            w, most = list(words), int(0.2 * n + 1e-9)
            for _ in range(most):
                at, kind = rng.randrange(len(w)), rng.choice(kinds)
                w[at : at + (kind != 0)] = [f"new{rng.randrange(10**6)}"] if kind < 2 else []
            rows += [(*sorted((words, w), key=len, reverse=True), most)]
    df = spark.createDataFrame([(x, y) for x, y, _ in rows], "x array<string>, y array<string>")
    df = df.select("x", "y", linededup._marks(F.col("x"), F.size("x")).alias("p"), linededup._marks(F.col("y"), F.size("y")).alias("q"))
    near = linededup._alike(lambda i: F.col("p")[i], lambda i: F.col("q")[i], F.size("x"), F.size("y"), 0.8)
    assert df.where(near).count() == len(rows)


def test_lines_meet_by_few_keys(spark):
    """Some two keys for every word by which a near line may differ, not one for every run of words."""
    rng = random.Random(22)
    rows = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in range(5, 200)]
    keys = spark.createDataFrame([(i, len(r.split()), r) for i, r in enumerate(rows)], "id long, words int, line string")
    assert linededup.meetings(keys, 0.8).count() <= sum(0.5 * len(r.split()) + 1 + linededup.SHARED for r in rows)


def test_plain_lines_have_the_words_of_lines(spark):
    """One normalisation of the whole text gives the words of each line."""
    texts = ["A, b;c  d-e f\n\n  Ünï ÇA 日本 x9\tk \n-- a b c d e --", "ΟΔΟΣ ΟΔΟΣ\nΣ a b c d Σ\r\nİ I ı a.b.c.d𝒳y", " ", "", None, "one two three four five six seven\n" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((r["doc_id"], r["pos"], " ".join(r["words"]), len(r["words"])) for r in linededup._lines(docs, 1).collect())
    assert sorted((r["doc_id"], r["pos"], r["line"], r["n"]) for r in linededup._plain(docs, 1).collect()) == want and want


def test_shingles_scan_small_parts():
    texts = [f"{i} " + " ".join(f"word{i * k % 9973}" for k in range(150)) for i in range(2000)]
    alone = [h.tolist() for t in texts[::97] for h, *_ in minhash.shingles([t])]
    tracemalloc.start()
    seen = [h.tolist() if i % 97 == 0 else [] for i, (h, *_) in enumerate(minhash.shingles(texts))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(seen) == 2000 and seen[::97] == alone
    assert peak < 25e6  # 2.5 million signs


def test_slices_keep_all_rows():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 1, 500, 1201)]
    parts = [p["x"].to_pylist() for p in slices(batches)]
    assert [len(p) for p in parts] == [1, 500, 500, 500, 201]
    assert sum(parts, []) == [*range(1), *range(500), *range(1201)]
