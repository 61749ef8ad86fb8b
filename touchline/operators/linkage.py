"""Name linkage without comparing all pairs.

Two normalised names match when they are equal or share a token longer than ``min_len``.
That is an "any shared key" rule, so the first match, the number of distinct matches and
the existence of a match all follow from one small summary per key: every row is exploded
to its few keys, joined to the summary of each key and folded back. The work is linear in
rows times tokens even when one surname covers a third of them.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import tokens
from touchline.operators.ordered import positions, top_n
from touchline.session import durable, in_shares


def link_keys(name: Column, min_len: int = 3) -> Column:
    """The whole name and every token longer than ``min_len``."""
    long_tokens = F.filter(tokens(name), lambda t: F.length(t) > min_len)
    whole = F.array(F.concat(F.lit("="), name))
    return F.concat(whole, F.transform(long_tokens, lambda t: F.concat(F.lit("~"), t)))


def fuzzy_first(left: DataFrame, right: DataFrame, left_id: str, right_id: str, ordinal: str,
                name: str = "name", scope: list[str] | None = None, min_len: int = 3) -> DataFrame:
    """First right row (by ``ordinal``) whose name matches, per left row.

    Returns left_id, match_id, match_ordinal, ambiguous (more than one distinct match).
    """
    scope = scope or []
    keys = right.select(*scope, F.col(right_id).alias("_id"), F.col(ordinal).alias("_ord"), F.explode(link_keys(F.col(name), min_len)).alias("_k"))
    summary = keys.groupBy(*scope, "_k").agg(
        F.min(F.struct("_ord", "_id")).alias("first"), F.min("_id").alias("lo"), F.max("_id").alias("hi")
    )
    probes = left.select(*scope, F.col(left_id), F.explode(link_keys(F.col(name), min_len)).alias("_k"))
    hits = probes.join(summary, [*scope, "_k"])
    return hits.groupBy(*scope, left_id).agg(
        F.min("first").alias("_f"), (F.min("lo") != F.max("hi")).alias("ambiguous")
    ).select(*scope, left_id, F.col("_f._id").alias("match_id"), F.col("_f._ord").alias("match_ordinal"), "ambiguous")


def cascade_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, ordinal: str,
                  name: str = "name", scope: list[str] | None = None) -> DataFrame:
    """Exact name, else the only name holding the last token, else the first of several that
    also holds the first token. Returns left_id, match_id, stage (null when unmatched)."""
    scope = scope or []
    # one row per distinct right name; a repeated name keeps its last id
    names = right.groupBy(*scope, name).agg(
        F.max_by(right_id, F.struct(ordinal, right_id)).alias("_id"), F.min(ordinal).alias("_ord")
    ).withColumn("_t", tokens(F.col(name)))
    exact = names.select(*scope, F.col(name), F.col("_id").alias("_exact"))
    by_token = names.select(*scope, "_id", "_ord", F.explode("_t").alias("_last")).groupBy(*scope, "_last").agg(
        F.count("*").alias("_n"), F.min_by("_id", F.struct("_ord", "_id")).alias("_only")
    )
    pair = names.select(*scope, "_id", "_ord", F.explode("_t").alias("_last"), F.col("_t"))
    pair = pair.select(*scope, "_id", "_ord", "_last", F.explode("_t").alias("_first"))
    by_pair = pair.groupBy(*scope, "_last", "_first").agg(F.min_by("_id", F.struct("_ord", "_id")).alias("_both"))
    probe = left.withColumn("_last", F.element_at(F.split(name, " "), -1)).withColumn(
        "_first", F.element_at(F.split(name, " "), 1)
    )
    out = probe.join(exact, [*scope, name], "left").join(by_token, [*scope, "_last"], "left").join(
        by_pair, [*scope, "_last", "_first"], "left"
    )
    last = F.when(F.col("_n") == 1, F.col("_only"))
    first = F.when(F.col("_n") > 1, F.col("_both"))
    stage = F.when(F.col("_exact").isNotNull(), "exact").when(last.isNotNull(), "last_token").when(first.isNotNull(), "first_and_last")
    return out.select(*scope, left_id, F.coalesce("_exact", last, first).alias("match_id"), stage.alias("stage"))


def link_fixtures(left: DataFrame, right: DataFrame, left_id: str, right_id: str, ordinal: str, min_len: int = 3) -> DataFrame:
    """First right fixture whose home and away names both match and whose score agrees when
    both scores are known. Columns home, away, score_home, score_away on both sides.

    The key is (home key, away key), as a hash of 128 bits. A left row with a score looks at the right rows with that score and at
    those without one, a left row without a score at all; each key's right rows are folded into one summary first.
    The keys are dealt to parts that are done one after the other.
    """

    def exploded(df: DataFrame, *columns: Column) -> DataFrame:
        keys = df.select(*columns, F.explode(link_keys(F.col("home"), min_len)).alias("_h"), "away").select("*", F.explode(link_keys(F.col("away"), min_len)).alias("_a"))
        return keys.select(*[c for c in keys.columns if c not in ("_h", "_a", "away")], F.xxhash64("_h", "_a").alias("_k1"), F.xxhash64(F.lit(1), "_h", "_a").alias("_k2"))

    scores = [F.col("score_home").alias("_sh"), F.col("score_away").alias("_sa")]
    known = F.col("score_home").isNotNull()
    item = F.struct(F.col(ordinal).alias("_ord"), F.col(right_id).alias("_id")).alias("_f")
    p_known, p_open = left.where(known), left.where(~known)
    r_known, r_open = right.where(known), right.where(~known)
    steps = [(exploded(p_known, F.col(left_id), *scores), exploded(r_known, item, *scores), True)]
    steps += [(exploded(p_known, F.col(left_id)), exploded(r_open, item), False)] if not r_open.isEmpty() else []
    steps += [(exploded(p_open, F.col(left_id)), exploded(right, item), False)] if not p_open.isEmpty() else []

    def found(mine: Callable[[Column], Column]) -> DataFrame:
        out = []
        for p, r, scored in steps:
            p, r = p.where(mine(F.col("_k1"))), r.where(mine(F.col("_k1")))
            keys = ["_k1", "_k2", "_sh", "_sa"] if scored else ["_k1", "_k2"]
            first = r.groupBy(*keys).agg(F.min("_f").alias("_f"))
            if scored:
                on = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in keys[:3]] + [F.col("p._sa").eqNullSafe(F.col("r._sa"))]
                out.append(p.alias("p").join(first.alias("r"), on).select(F.col(f"p.{left_id}").alias("_left"), F.col("r._f").alias("_f")))
            else:
                out.append(p.join(first, keys).select(F.col(left_id).alias("_left"), "_f"))
        hits = out[0]
        for more in out[1:]:
            hits = hits.union(more)
        return hits.groupBy("_left").agg(F.min("_f").alias("_f"))

    best = in_shares(found).groupBy("_left").agg(F.min("_f").alias("_m"))
    out = left.select(left_id).join(best, F.col(left_id) == F.col("_left"), "left")
    return out.select(left_id, F.col("_m._id").alias("match_id"))


def _leftovers(a: list[tuple], b: list[tuple]) -> Iterator[tuple]:
    """Rows of ``a`` without any match in ``b`` and rows of ``b`` that stay free; rows are (keys of the name, row), in order.

    Free rows of ``b`` wait in one queue a name key, so a row of ``a`` looks at the heads of its own queues only.
    """
    queues: dict[str, deque[int]] = {}
    for j, (names, _) in enumerate(b):
        for k in set(names):
            queues.setdefault(k, deque()).append(j)
    known, free = set(queues), [True] * len(b)
    for names, row in a:
        if known.isdisjoint(names):
            yield row
            continue
        heads = []
        for k in names:
            q = queues.get(k)
            while q and not free[q[0]]:
                q.popleft()
            if q:
                heads.append(q[0])
        if heads:
            free[min(heads)] = False
    yield from (row for (_, row), left in zip(b, free) if left)


def _first_choices(heads: DataFrame, words: DataFrame) -> DataFrame:
    """For the first free row of each name: the name of the other side's first free row that matches (``best``), and the
    position of the first one of yet another name (``until``, null if there is none).

    Of all rows that share a word only the first two names are looked at, so a common word costs its names once.
    """
    spread = heads.join(words, ["_g", "source", "_name"])
    firsts = top_n(spread, ["_g", "_k", "source"], [F.col("_pos"), F.col("_name")], 2, "_n")
    firsts = firsts.groupBy("_g", "_k", "source").agg(F.collect_list(F.struct("_pos", "_name")).alias("firsts"))  # two at most
    other = firsts.withColumn("source", F.when(F.col("source") == "a", "b").otherwise("a"))
    seen = spread.select("_g", "source", "_name", "_k").join(other, ["_g", "_k", "source"])
    seen = seen.groupBy("_g", "source", "_name").agg(F.array_sort(F.flatten(F.collect_list("firsts"))).alias("f"))  # two a word of the name
    best = F.col("f")[0]["_name"]
    return seen.select("_g", "source", "_name", best.alias("best"), F.get(F.filter("f", lambda r: r["_name"] != best), 0)["_pos"].alias("until"))


def _settled(choices: DataFrame, rows: DataFrame, state: DataFrame) -> DataFrame:
    """_g, source, _name and how many more of its first free rows are matched in this round.

    Where two names are each other's first choice, their rows pair in order as far as no third name comes in between on
    either side: until then nobody else wants them, and they want nobody else.
    """
    a = choices.where(F.col("source") == "a").select("_g", F.col("_name").alias("a"), F.col("best").alias("b"), F.col("until").alias("b_before"))
    b = choices.where(F.col("source") == "b").select("_g", F.col("_name").alias("b"), F.col("best").alias("a"), F.col("until").alias("a_before"))
    mutual = a.join(b, ["_g", "a", "b"])
    side = lambda x: mutual.select("_g", F.lit(x).alias("source"), F.col(x).alias("_name"), F.col(f"{x}_before").alias("before"), "a", "b")
    free = rows.join(state, ["_g", "source", "_name"]).where(F.col("_rank") > F.col("_gone")).join(side("a").union(side("b")), ["_g", "source", "_name"])
    ahead = free.where(F.col("before").isNull() | (F.col("_pos") < F.col("before"))).groupBy("_g", "a", "b").agg(*[F.count_if(F.col("source") == x).alias(f"n_{x}") for x in "ab"])
    more = ahead.select("_g", F.least("n_a", "n_b").alias("_more"), F.explode(F.array(*[F.struct(F.lit(x).alias("source"), F.col(x).alias("_name")) for x in "ab"])).alias("s"))
    return more.select("_g", "s.source", "s._name", "_more")


#: Rows of both lists of a match side up to which the side is settled within its row.
SIDE = 100


def _in_row(rows: DataFrame, keys: list[str], ordinal: str, name: str, min_len: int) -> DataFrame:
    """Leftovers of sides of at most SIDE rows: each side's two lists are put in one row and folded there."""
    item = F.struct(F.col(ordinal).alias("ordinal"), F.col(name).alias("name"))
    listed = lambda x: F.collect_list(F.when(F.col("source") == x, item)).alias(x)
    whole = lambda r: F.struct(r["ordinal"].alias("ordinal"), F.coalesce(r["name"], F.lit("")).alias("word"), r["name"].alias("name"), link_keys(r["name"], min_len).alias("keys"))
    # only what the result needs goes through the shuffle
    sides = rows.select("_g", "source", ordinal, name).groupBy("_g").agg(listed("a"), listed("b"))
    sides = sides.select("_g", *[F.array_sort(F.transform(x, whole)).alias(x) for x in "ab"])
    meets = lambda x, y: F.coalesce(F.arrays_overlap(x["keys"], y["keys"]), F.lit(False))
    free = lambda taken, x: F.filter("b", lambda y, i: ~F.array_contains(taken, i) & meets(x, y))
    place = lambda taken, x: F.transform(F.slice(free(taken, x), 1, 1), lambda y: y["at"])
    sides = sides.withColumn("b", F.transform("b", lambda y, i: F.struct(y["ordinal"].alias("ordinal"), y["name"].alias("name"), y["keys"].alias("keys"), i.alias("at"))))
    taken = F.aggregate("a", F.array().cast("array<int>"), lambda taken, x: F.concat(taken, place(taken, x)))
    left = lambda x, of: F.transform(of, lambda y: F.struct(F.lit(x).alias("source"), y["ordinal"].alias("ordinal"), y["name"].alias("name")))
    a = left("a", F.filter("a", lambda x: ~F.exists("b", lambda y: meets(x, y))))
    b = F.get(F.transform(F.array(taken), lambda t: left("b", F.filter("b", lambda y: ~F.array_contains(t, y["at"])))), 0)  # folded once a side
    out = sides.select("_g", F.explode(F.concat(a, b)).alias("r"))
    return out.select(*[F.col(f"_g.{k}").alias(k) for k in keys], "r.source", F.col("r.ordinal").alias(ordinal), F.col("r.name").alias(name))


def match_scorers(a: DataFrame, b: DataFrame, keys: list[str], ordinal: str = "ordinal", name: str = "name", min_len: int = 3, rounds: int = 16) -> DataFrame:
    """Leftovers of two goal lists of the same match side, of any length.

    A row of ``a`` is left over when no row of ``b`` matches its name at all. Rows of ``b`` are consumed one to one:
    each row of ``a``, in order, takes the first free match. Sides of at most SIDE rows are settled within one row, after one
    shuffle. In longer ones the same pairs come out of rounds in which all rows that are
    each other's first free choice pair up, rows of two names that want each other all at once; the rows of a name are used
    up from the first on, so a round carries one number a name. Names that still wait for one another after ``rounds`` rounds (a
    chain in which each takes the next one's choice) are folded in order, a side in a task.
    Returns keys, source ('a' or 'b'), ordinal, name.
    """
    out = [*keys, "source", ordinal, name]
    rows = a.select(*keys, F.lit("a").alias("source"), ordinal, name).union(b.select(*keys, F.lit("b").alias("source"), ordinal, name))
    rows = rows.withColumns({"_g": F.struct(*keys), "_name": F.coalesce(F.col(name), F.lit(""))})
    long = durable(rows.groupBy("_g").count().where(F.col("count") > SIDE).select("_g"))
    if long.isEmpty():
        return _in_row(rows, keys, ordinal, name, min_len)
    short, rows = rows.join(long, "_g", "left_anti"), rows.join(long, "_g", "left_semi")
    rows = positions(rows, ["_g", "source"], [F.col(ordinal), F.col("_name")], "_pos")
    rows = durable(positions(rows, ["_g", "source", "_name"], [F.col("_pos")], "_rank"))
    names = rows.groupBy("_g", "source", "_name").agg(F.max(name).alias("_shown"))
    words = durable(names.select("_g", "source", "_name", F.explode(F.array_distinct(link_keys(F.col("_shown"), min_len))).alias("_k")))
    met = words.select("_g", "_k", F.when(F.col("source") == "a", "b").otherwise("a").alias("source")).distinct()
    state = durable(words.join(met, ["_g", "_k", "source"], "left_semi").select("_g", "source", "_name").distinct().withColumn("_gone", F.lit(0).cast("long")))
    known, waiting = state.drop("_gone"), True
    for _ in range(rounds):
        heads = rows.join(state, ["_g", "source", "_name"]).where(F.col("_rank") == F.col("_gone") + 1).select("_g", "source", "_name", "_pos")
        more = durable(_settled(_first_choices(heads, words), rows, state))
        waiting = not more.isEmpty()
        if not waiting:
            break
        state = durable(state.join(more, ["_g", "source", "_name"], "left").select("_g", "source", "_name", (F.col("_gone") + F.coalesce("_more", F.lit(0))).alias("_gone")))
    free = rows.join(state, ["_g", "source", "_name"], "left").where(F.col("_rank") > F.coalesce("_gone", F.lit(0)))
    unknown = free.join(known, ["_g", "source", "_name"], "left_anti")
    rest = free.join(known, ["_g", "source", "_name"], "left_semi")
    if waiting:
        rest = _folded(rest, keys, out, name, min_len)
    else:
        rest = rest.where(F.col("source") == "b").select(*out)
    return unknown.select(*out).union(rest).union(_in_row(short, keys, ordinal, name, min_len))


def _folded(rows: DataFrame, keys: list[str], out: list[str], name: str, min_len: int) -> DataFrame:
    """What stays of rows that all match some row of the other side, each side's rows taken in order."""
    rows = rows.repartition("_g").sortWithinPartitions("_g", "source", "_pos").select(*out, link_keys(F.col(name), min_len).alias("_k"))
    at = len(keys)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side, sides = None, {"a": [], "b": []}
        left = lambda: (row for row in _leftovers(**sides) if row[at] == "b")
        for batch in batches:
            done = []
            for *row, words in zip(*[batch[c].tolist() for c in [*out, "_k"]]):
                if row[:at] != side:
                    done += left()
                    side, sides = row[:at], {"a": [], "b": []}
                sides[row[at]].append((words, row))
            yield pd.DataFrame(done, columns=out)
        yield pd.DataFrame(list(left()), columns=out)

    return rows.mapInPandas(fold, rows.select(*out).schema)
