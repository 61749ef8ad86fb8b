"""A prefix trie of conversations, built as ternary search trees on range shards.

Turns get dictionary ids in the order of (role, text). Conversations, as lists of ids, are range-partitioned and sorted, so
equal ones meet in one stream and a shard holds one interval of the list. Each shard inserts its distinct lists into a
ternary search tree, the median of every interval first, and accumulates members, leaves and savings in one pass without
recursion. Only nodes on the path of a shard's first or last list can go on in other shards: these boundary nodes are merged
by ``fan_in`` neighbouring shards at a time, by the same tree, until no boundary is left.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.work import cut

NO_MEMBERS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A boundary node: its shard, the paths it is on, and what has been settled below it so far.
OPEN = "shard long, in_first boolean, in_last boolean, turn_id long, tokens long"
ROWS = f"{NODE}, key binary, parent_key binary, {OPEN}"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


class Tree:
    """A ternary search tree: per node a turn id, links to smaller and larger turn ids and to the tree of next turns."""

    def __init__(self):
        self.turn, self.smaller, self.larger, self.next = [0], [-1], [-1], [-1]
        self.parent, self.depth, self.tokens = [-1], [0], [0]
        self.members, self.least, self.ends = [0], [None], [None]
        self.children, self.leaves, self.saved = [0], [0], [0]

    def child(self, node: int, turn: int, tokens: int) -> int:
        at, link, came = self.next[node], self.next, node
        while at >= 0 and self.turn[at] != turn:
            link, came = (self.smaller, at) if turn < self.turn[at] else (self.larger, at)
            at = link[came]
        if at < 0:
            at = len(self.turn)
            link[came] = at
            for column, value in zip(self._columns(), (turn, -1, -1, -1, node, self.depth[node] + 1, tokens, 0, None, None, 0, 0, 0)):
                column.append(value)
        return at

    def _columns(self):
        return (self.turn, self.smaller, self.larger, self.next, self.parent, self.depth, self.tokens, self.members, self.least, self.ends, self.children, self.leaves, self.saved)

    def path(self, turns, tokens) -> list[int]:
        """The nodes from the root along ``turns``, made where absent."""
        nodes = [0]
        for t, n in zip(turns, tokens):
            nodes.append(self.child(nodes[-1], t, n))
        return nodes

    def add(self, node: int, members: int, least: int | None, ends: str | None, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.members[node] += members
        self.children[node] += children
        self.leaves[node] += leaves
        self.saved[node] += saved
        self._lower(node, least)
        self.ends[node] = ends or self.ends[node]

    def _lower(self, node: int, least: int | None) -> None:
        if least is not None and (self.least[node] is None or least < self.least[node]):
            self.least[node] = least

    def settle(self, first: list[int], last: list[int], shard: int, keys: dict[int, bytes] | None = None) -> pd.DataFrame:
        """Rows of all nodes; those on the paths ``first`` and ``last`` stay open, the others are final.

        Nodes are made after their parents, so the list from its end is a walk from the leaves. ``keys`` names nodes that
        were open before; open ones get the hash of their path.
        """
        on_first, on_last = set(first), set(last)
        keys = dict(keys or {})
        for nodes in (first, last):
            for up, node in zip([-1, *nodes], nodes):
                if node not in keys:
                    keys[node] = hashlib.blake2b(keys[up] + self.turn[node].to_bytes(8, "little", signed=True) if up >= 0 else b"", digest_size=16).digest()
        out = []
        for v in range(len(self.turn) - 1, -1, -1):
            if v in on_first or v in on_last:
                continue
            self.leaves[v] = self.leaves[v] if self.children[v] else 1
            self.saved[v] += (self.members[v] - 1) * self.tokens[v]
            up = self.parent[v]
            if up >= 0:
                self.add(up, self.members[v], self.least[v], None, 1, self.leaves[v], self.saved[v])
        for v in range(len(self.turn)):
            is_open = v in on_first or v in on_last
            up = self.parent[v]
            up_open = up in on_first or up in on_last
            parent = self.least[up] if up >= 0 and not up_open else None
            row = (self.least[v], self.depth[v], parent, self.members[v], self.children[v], self.leaves[v], self.saved[v], self.ends[v] if is_open else self.ends[v] or NO_MEMBERS, keys.get(v), keys[up] if up_open else None)
            out.append((*row, shard if is_open else None, v in on_first, v in on_last, self.turn[v], self.tokens[v]))
        return frame(out)


def frame(rows: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*rows)) if rows else [()] * len(NAMES)
    kinds = {c.split()[0]: c.split()[1] for c in ROWS.split(", ")}
    return pd.DataFrame({name: pd.array(values, dtype="Int64") if kinds[name] == "long" else pd.Series(values, dtype="bool" if kinds[name] == "boolean" else "object") for name, values in zip(NAMES, columns)})


def medians_first(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle of every interval before its halves."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            todo += [(m + 1, b), (a, m)]


def _shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tree of one sorted partition; copies of a list stream by and leave a count and a running hash of their ids."""
    lists: list[list] = []  # turns, tokens, members, least id, hash of the ids
    for batch in batches:
        for conv, turns, tokens in zip(batch["conv_id"], batch["turns"], batch["tokens"]):
            turns, name = np.asarray(turns, dtype=np.int64), str(conv).encode()
            if lists and np.array_equal(lists[-1][0], turns):
                lists[-1][2] += 1
                lists[-1][4].update(b"," + name)
            else:
                lists.append([turns, np.asarray(tokens, dtype=np.int64), 1, int(conv), hashlib.sha256(name)])
    if lists:
        tree, edges = Tree(), {}
        for i in medians_first(len(lists)):
            turns, tokens, members, least, ends = lists[i]
            nodes = tree.path(turns.tolist(), tokens.tolist())
            tree.add(nodes[-1], members, least, ends.hexdigest())
            if i in (0, len(lists) - 1):
                edges[i] = nodes
        yield tree.settle(edges[0], edges[len(lists) - 1], TaskContext.get().partitionId())


def _merger(fan_in: int, final: bool):
    return lambda rows: _merge(rows, fan_in, final)


def _merge(rows: pd.DataFrame, fan_in: int, final: bool) -> pd.DataFrame:
    """The boundary nodes of neighbouring shards in one tree; those of the outer paths stay open unless all is merged."""
    tree, keys, paths = Tree(), {}, []
    rows = rows.sort_values(["shard", "depth"], kind="stable")
    for _, shard in rows.groupby("shard", sort=True):
        for side in ("in_first", "in_last"):
            on = shard[shard[side].astype(bool)]
            below = on.iloc[1:]
            nodes = tree.path(below["turn_id"].tolist(), below["tokens"].tolist())
            paths.append(nodes)
            for node, r in zip(nodes, on.to_dict("records")):
                keys[node] = r["key"]
                if side == "in_first" or not r["in_first"]:
                    least = None if pd.isna(r["conv_id"]) else int(r["conv_id"])
                    tree.add(node, int(r["n_convs"]), least, r["ends_sha256"], int(r["n_children"]), int(r["n_leaves"]), int(r["saved_tokens"]))
    first, last = ([], []) if final else (paths[0], paths[-1])
    return tree.settle(first, last, int(rows["shard"].iloc[0]) // fan_in, keys)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns, tokens: the dictionary ids and word counts of the rebuilt conversations, in order."""
    said = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = said.select("role", "text").distinct().repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long")
    known = cut(ordered.select("role", "text", F.monotonically_increasing_id().alias("id"), words.alias("words")), "turn-dictionary")
    turns = said.withColumn("h", F.xxhash64("role", "text")).join(known.withColumn("h", F.xxhash64("role", "text")), ["h", "role", "text"])
    own = cut(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("own")), "own-turns")
    heads = own.where(F.pmod(F.col("conv_id"), F.lit(20)) == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, 3).alias("head"))
    convs = own.withColumn("base", F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(20))).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int"))
    both = convs.join(heads, "base", "left")
    lent = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    whole = F.concat(lent, F.slice("own", F.col("h") + 1, F.size("own")))
    return both.select("conv_id", F.transform(whole, lambda t: t["id"]).alias("turns"), F.transform(whole, lambda t: t["words"]).alias("tokens"))


def prefix_trie(sequences: DataFrame, shard_turns: int = 1 << 16, fan_in: int = 64) -> DataFrame:
    """One row for each distinct prefix of the lists ``turns`` (with the word counts ``tokens``) of the rows ``conv_id``.

    conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Lists may be empty, then they end at the root; an empty table gives no rows. A shard takes about
    ``shard_turns`` turns in memory, besides its longest list.
    """
    sequences = cut(sequences, "sequences")
    total = sequences.agg(F.sum(F.size("turns").cast("long") + 1)).first()[0] or 0
    parts = -(-total // shard_turns) or 1
    ranged = sequences.repartitionByRange(parts, "turns").sortWithinPartitions("turns", "conv_id")
    rows = cut(ranged.mapInPandas(_shard, ROWS), "trie-shards")
    done, merged = [rows.where(F.col("shard").isNull())], []
    while rows is not None:
        parts = -(-parts // fan_in)
        final = parts == 1
        left = rows.where(F.col("shard").isNotNull())
        rows = cut(left.groupBy(F.floor(F.col("shard") / fan_in).alias("part")).applyInPandas(_merger(fan_in, final), ROWS), "trie-merged")
        merged.append(rows.where(F.col("shard").isNull()))
        rows = None if final else rows
    nodes = done[0]
    for part in merged:
        nodes = nodes.union(part)
    places = merged[0]
    for part in merged[1:]:
        places = places.union(part)
    places = places.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("open_parent"))
    out = nodes.join(places, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("open_parent", "parent_conv_id"))
    return out.select(*[c.split()[0] for c in NODE.split(", ")])


def conversation_trie(conversations: DataFrame, **sizes: int) -> DataFrame:
    """The prefix trie of all rebuilt conversations.

    Turns come in order of ``turn`` (null first; ties by role and text; repeated rows are turns each); a null role or text
    is empty. A conversation c takes the first h turns of conversation c - c % 20, h = crc32 of its decimal id modulo 4,
    then its own from h on. Rows without conv_id belong to no conversation. Columns beyond conv_id, turn, role and text are
    ignored. An empty table gives no rows.
    """
    return prefix_trie(rebuilt(conversations), **sizes)
