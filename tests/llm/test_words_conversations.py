"""Spelling variants and conversation tries against brute force."""
import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import pytest

from brute import SF
from touchline.llm import conversations as conv
from touchline.llm import spelling as sp
from touchline.llm.queries import QUERIES


def variants(rows, least_length=5, least_count=3):
    n, lower = Counter(), str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least_count}
    skip, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            skip[w[:i] + "?" + w[i + 1 :]].add(w)
            short = w[:i] + w[i + 1 :]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for group in skip.values():
        for a in group:
            near[a] |= group - {a}
    form = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_variants_of_the_table(spark, docs):
    got = {tuple(r) for r in QUERIES["op12_spelling_variants"](spark, SF).collect()}
    assert got == variants([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_variants_of_few_letters(spark):
    """Words of two letters, so that equal neighbours, chains and crowded ranges are common."""
    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(5, 9))) for _ in range(400)]
    rows = [(i if i % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, "ÀÉÎõü×÷ÿ Àéîõü×÷ÿ"), (4, "ABCDE abcde AbCdE abcdé abcdef " * 3), (4, "ABCDE abcde AbCdE abcdé abcdef " * 3), (5, "x" * 3000 + " $$$ 日本語"), (2**60, "aabaa " * 200)]
    got = {tuple(r) for r in sp.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == variants(rows)


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, word int, n int")
    assert sp.group_variants(empty).count() == 0


def trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(turns)] for c, turns in own.items()}
    seq = {c: tuple(own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4 :]) for c, v in own.items()}
    members, children = defaultdict(list), defaultdict(set)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in children[p])
        ends = ",".join(str(c) for c in sorted(members[p]) if len(seq[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_conversation_trie"](spark, SF).collect()), key=str) == trie(rows)


@pytest.mark.parametrize("sizes", [{}, {"shard_turns": 20, "fan_in": 2}, {"shard_turns": 40, "fan_in": 3}])
def test_trie_over_shards(spark, sizes):
    """Few texts, so prefixes are shared widely; shards small enough to cut paths, levels enough to merge twice."""
    rng = random.Random(8)
    said = ["", "hi", "hi there", " a\tb\nc ", None]
    rows = []
    for c in [*range(0, 90, 1), *range(200, 230, 7), -3, 2**53 + 1]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(said)))
    rows += [(7, 1, "user", "hi")] * 2 + [(None, 0, "user", "lost")] + [(600, t, "user", f"turn {t}") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, conv.conversation_trie(df, **sizes).collect()), key=str) == trie(rows)


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", f"t{t} x") for c in range(1, 400) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, conv.conversation_trie(df, shard_turns=100, fan_in=2).collect()), key=str) == trie(rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, depth long, n_convs string")
    assert conv.conversation_trie(empty).count() == 0


def test_medians_first():
    for n in range(20):
        order = list(conv.medians_first(n))
        assert sorted(order) == list(range(n)) and (not n or order[0] == n // 2)
