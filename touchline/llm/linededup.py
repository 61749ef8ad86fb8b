"""Repeated and nearly repeated lines across documents, with DataFrame functions only.

Lines are normalised to lower-cased words. Equal lines are grouped by a 128-bit hash. Different ones link when the edit
similarity of their words is high enough, and none of these pairs is missed: an edit leaves all but two pairs of neighbouring
words standing, so when all lines rank their pairs of words alike, two near lines share some of their first ones and meet by them.
Lines that meet are first held against the first line of their meeting, then against lines of other groups only, and
those whose words alone are too far apart are parted where they meet.
Of each connected group one occurrence stays.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.work import cut

#: Words of the grams by which lines meet.
GRAM = 2
#: Grams that near lines are made to share, if they have as many to spare, and words for each one more: with more, each line
#: goes to more meetings, and fewer chance pairs are left to be held against each other.
SHARED, SHARED_WORDS = 3, 32
#: Parts of the keys that meet one after the other, so that a fraction of the meetings is on disk.
SHARES = 6
#: Longs in which the words of a line are marked, so that lines of other words part where they meet; a line of fewer than
#: LONG words takes half of them, as few marks pack better. MARKS is a power of two.
MARKS, LONG = 4, 48
#: Up to this many ids (some 30 MB) are sent to all executors to pick their lines; more are joined by shuffle.
FEW_IDS = 2_000_000
#: Removals of documents up to this number are sent to all executors (some 30 MB); more are joined by shuffle.
SMALL = 500_000


@dataclass(frozen=True)
class Settings:
    """Lines link at an edit similarity of ``least``; with a ``radius``, their SimHashes must also be that near."""

    least: float = 0.8
    min_words: int = 5
    radius: int | None = 3


#: The edit similarity alone decides.
WHOLE = Settings(radius=None)


def words(line: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]++"), "")


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """Lines with enough words: document (id and text hash), position, words and their 128-bit hash."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.select("doc_id", "th", "pos", words(F.col("line")).alias("words")).where(F.size("words") >= min_words)
    return rows.select("doc_id", "th", "pos", "words", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"))


def _votes(lines: DataFrame, fields: int) -> DataFrame:
    """Counts of set bits over the words of each line: ``fields`` counts in one long, bit i of each field in sum i."""
    width = 64 // fields
    ones = sum(1 << (width * f) for f in range(fields))
    word = lines.select("doc_id", "th", "pos", "h1", "h2", F.explode("words").alias("w")).withColumn("w", F.xxhash64("w"))
    sums = [F.sum(F.shiftrightunsigned("w", i).bitwiseAND(F.lit(ones))).alias(f"v{i}") for i in range(width)]
    return word.groupBy("doc_id", "th", "pos", "h1", "h2").agg(F.count("*").alias("n"), *sums)


def _majority(fields: int) -> Column:
    """The SimHash from such counts: a bit is set where 2 * count > n, for all fields of a long at once.

    In fields of w bits, 2 * count + 2**(w - 2) - 1 - n has bit w - 2 set just then, for n below 2**(w - 2).
    """
    width = 64 // fields
    ones = F.lit(sum(1 << (width * f) for f in range(fields)))
    level = (F.lit((1 << (width - 2)) - 1) - F.col("n")) * ones
    bits = [F.shiftleft(F.shiftrightunsigned(F.shiftleft(f"v{i}", 1) + level, width - 2).bitwiseAND(ones), i) for i in range(width)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


#: Words of a line up to which four counts fit a long.
SHORT = (1 << 14) - 1


def simhashes(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, th, pos, h1, h2 and the 64-bit SimHash of every line.

    For each bit the words of a line vote. A line's words lie in one input row, so the counts are whole before they are
    shuffled. Lines of over SHORT words are counted in wider fields (up to a thousand million words). Rows that repeat
    doc_id and text vote once, so no count exceeds its line's words.
    """
    docs = docs.select("doc_id", "text").dropDuplicates()
    line = ["doc_id", "th", "pos", "h1", "h2"]
    short = _votes(_lines(docs, min_words).where(F.size("words") <= SHORT), 4).select(*line, _majority(4).alias("sim"))
    long = _lines(docs.where(F.length("text") > 2 * SHORT), min_words).where(F.size("words") > SHORT)
    return short.union(_votes(long, 2).select(*line, _majority(2).alias("sim")))


def _plain(docs: DataFrame, min_words: int) -> DataFrame:
    """The lines of ``_lines`` with their words joined by blanks: each text is normalised at once, and no words are cut out."""
    flat = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]{2,}+|[^\p{L}\p{N}\n ]", " ")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(flat, "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line"))
    blanks = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    rows = rows.withColumn("n", F.when(F.col("line") == "", 0).otherwise(blanks + 1)).where(F.col("n") >= min_words)
    return rows.select("doc_id", "th", "pos", "line", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _edits(n: Column, least: float) -> Column:
    """Edits that leave a line of ``n`` words similar enough to one that is not longer."""
    return F.floor((1 - F.lit(least)) * n + 1e-9).cast("int")


def _steps(least: float, q: int) -> range:
    """Extra words of a longer line up to which the bound in ``lost_grams`` can rise."""
    return range(ceil(q / (1 - q * (1 - least))) + 1 if q * (1 - least) < 1 else 1)


def lost_grams(n: int, least: float, q: int) -> int:
    """Grams of ``q`` words of a line of ``n`` words that a near line may lack at most.

    A word changed or put in breaks up to q of them, a word left out one less. The nearest longer line of n + k words
    has k words more, that are left out here.
    """
    return max(q * int((1 - least) * (n + k) + 1e-9) - k for k in _steps(least, q))


def gram_lengths(least: float) -> tuple[int, dict[int, list[int]]]:
    """The words in a gram of long lines, and for each smaller number the lengths of lines that may meet a shorter line by it.

    Two lines meet by the grams of the shorter one. They are as long as leaves at least one whole.
    """
    top = max(q for q in range(1, GRAM + 1) if q == 1 or 1 - q * (1 - least) > 1e-9)
    long = ceil(4 * top / (1 - top * (1 - least))) + top + 2 if top > 1 else 1
    best, short = top, {}
    for n in range(long, 0, -1):  # no line that is longer has shorter grams
        best = max(q for q in range(1, best + 1) if q == 1 or n - q + 1 > lost_grams(n, least, q))
        if best < top:
            short.setdefault(best, set()).update(m for m in range(n, 3 * long) if m - int((1 - least) * m + 1e-9) <= n)
    return top, {q: sorted(ns) for q, ns in short.items()}


def _grams(words: Column, q: int) -> Column:
    """The distinct grams of ``q`` words as numbers, in the order all lines share: those of long words, which few lines have, come first."""
    hashed = F.transform(words, lambda w: F.shiftleft(F.xxhash64(w), 5) + F.least(F.octet_length(w), F.lit(31)))
    low, rest = lambda v: v.bitwiseAND(F.lit(31)), lambda *v: F.shiftrightunsigned(F.xxhash64(F.lit(q), *v), 14)
    if q == 1:
        each = F.transform(hashed, lambda v: F.shiftleft((31 - low(v)).cast("long"), 50) + rest(v))
    else:
        two = lambda v, u: F.shiftleft((62 - low(v) - low(u)).cast("long"), 50) + rest(v, u)
        pairs = lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), two)
        each = F.get(F.transform(F.array(hashed), pairs), 0)  # the words are hashed once
    return F.sort_array(F.array_distinct(each))


#: Numbers of shared grams up to this one go with the number of words into one long.
NEED = 255


def _keys(words: Column, n: Column, least: float, q: int) -> Column:
    """The first grams of a line, one of which at least any near line has among its own, and how many such lines share at least."""
    lost = F.greatest(F.lit(0), *[q * _edits(n + k, least) - k for k in _steps(least, q)])
    more = F.least(F.lit(NEED), SHARED + F.floor(n / SHARED_WORDS).cast("int"))
    pick = lambda g: F.struct(F.slice(g, 1, lost + more).alias("keys"), F.greatest(F.lit(1), F.least(more, F.size(g) - lost)).alias("need"))
    return F.get(F.transform(F.array(_grams(words, q)), pick), 0)


def _key_lists(lines: DataFrame, least: float, *more: Column) -> DataFrame:
    """id, size (words and need) and the keys of every line, by one of which it meets any near one."""
    top, short = gram_lengths(least)
    n, w = F.col("words"), F.split("line", " ")
    sets = [(F.when(n >= top, _keys(w, n, least, top)) if top > 1 else _keys(w, n, least, top)), *[F.when(n.isin(ns), _keys(w, n, least, q)) for q, ns in short.items()]]
    sets = lines.select("id", n.alias("n"), F.array_compact(F.array(*sets)).alias("sets"), *more)
    size = F.col("n").cast("long") * (NEED + 1) + F.array_min(F.col("sets.need"))
    return sets.withColumns({"size": size, "keys": F.flatten("sets.keys")}).drop("n", "sets")


def meetings(lines: DataFrame, least: float, share: int = 0, shares: int = 1) -> DataFrame:
    """key, id and size (words and need) of every line at every key by which it may meet a near one.

    Near lines share as many keys as the smaller need of the two, at least. Each line gives some two
    keys for every word by which a near one may differ. With ``shares``, only one share of the keys is given.
    """
    rows = _key_lists(lines, least).select(F.explode("keys").alias("key"), "id", "size")
    return rows if shares == 1 else rows.where(F.pmod(F.xxhash64("key"), F.lit(shares)) == share)


def _marks(words: Column, n: Column) -> Column:
    """The set of words as MARKS longs: each word sets the bit of its hash in one of them. Shorter lines have both halves in the first."""
    half = MARKS // 2
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    marked = lambda hs, i, of: F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: F.when(F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(of - 1)) == i, a.bitwiseOR(bit(h))).otherwise(a))
    none = F.lit(0).cast("long")
    of = lambda hs: F.when(n >= LONG, F.array(*[marked(hs, i, MARKS) for i in range(MARKS)])).otherwise(F.array(*[marked(hs, i, half) if i < half else none for i in range(MARKS)]))
    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(F.lit(MARKS), w))), of), 0)  # the words are hashed once


def _alike(x: Callable[[int], Column], y: Callable[[int], Column], n: Column, m: Column, least: float) -> Column:
    """Whether the marks of a line of ``n`` words and of one of ``m``, not more, leave them near.

    Each word that one line has and the other lacks is an edit; as many as the lines differ in length only take words from the longer.
    """
    half = MARKS // 2
    lacks = lambda a, b: reduce(lambda s, t: s + t, [F.bit_count(v.bitwiseAND(F.bitwise_not(w))) for v, w in zip(a, b)])
    near = lambda a, b: (lacks(a, b) <= _edits(n, least)) & (lacks(b, a) <= _edits(n, least) - (n - m))
    folded = lambda v: [v(i).bitwiseOR(v(i + half)) for i in range(half)]
    whole = lambda v: [v(i) for i in range(MARKS)]
    return near(folded(x), folded(y)) & ((m < LONG) | near(whole(x), whole(y)))


def _words_of(size: Column) -> Column:
    return F.floor(size / (NEED + 1)).cast("int")


def _met(rows: DataFrame, least: float, apart: str | None = None) -> DataFrame:
    """Pairs a < b of ids that are not too far apart in length alone, the number of keys at which they meet, and their need.

    With ``apart``, only pairs that differ in this column and whose marks leave them near.
    """
    more = [apart, *[f"marks{i}" for i in range(MARKS)]] if apart else []
    side = lambda i, of: of.select("key", F.col("id").alias(i), F.col("size").alias(f"s{i}"), *[F.col(c).alias(f"{c}_{i}") for c in more])
    n, m = _words_of(F.col("sx")), _words_of(F.col("sy"))
    near = (m <= n) & (m >= n - _edits(n, least)) & ((m < n) | (F.col("x") < F.col("y"))) & (F.col("x") != F.col("y"))
    if apart:
        near = near & (F.col(f"{apart}_x") != F.col(f"{apart}_y")) & _alike(lambda i: F.col(f"marks{i}_x"), lambda i: F.col(f"marks{i}_y"), n, m, least)
    both = side("x", rows).join(side("y", rows), "key").where(near)
    need = F.least(F.col("sx") % (NEED + 1), F.col("sy") % (NEED + 1))
    return both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("shared"), F.min(need).alias("need"))


def _led(rows: DataFrame, least: float, apart: str) -> DataFrame:
    """Pairs a < b of each line with the smallest id that meets at its key, if they differ in ``apart`` and their words leave them near.

    Lines of a key are read in order and not held.
    """
    lead = F.struct("id", "size", apart, *[f"marks{i}" for i in range(MARKS)])
    rows = rows.withColumn("lead", F.first(lead).over(Window.partitionBy("key").orderBy("id")))
    rows = rows.withColumns({"n": _words_of(F.col("size")), "m": _words_of(F.col("lead.size"))})
    n, m = F.col("n"), F.col("m")
    mine, its = (lambda i: F.col(f"marks{i}")), (lambda i: F.col(f"lead.marks{i}"))
    longer = (n >= m) & (m >= n - _edits(n, least)) & _alike(mine, its, n, m, least)
    shorter = (n < m) & (n >= m - _edits(m, least)) & _alike(its, mine, m, n, least)
    rows = rows.where((F.col("lead.id") < F.col("id")) & (F.col(f"lead.{apart}") != F.col(apart)) & (longer | shorter))
    return rows.select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()


def candidates(lines: DataFrame, least: float, share: int = 0, shares: int = 1) -> DataFrame:
    """Pairs a < b of ids, among them all whose word edit similarity is ``least`` or more.

    ``lines`` has distinct ids and their words, joined by blanks. Grams are taken as sets, so a line that repeats
    itself meets another once a gram. Lines whose lengths alone are too far apart do not meet. With ``shares``, only the
    keys of one share meet; all shares together give all pairs.
    """
    return _met(meetings(lines, least, share, shares), least).select("a", "b")


#: Code points that can stand for words: all but the surrogates.
SIGNS = 0x110000 - 0x800


def word_signs(words: Column) -> Column:
    """The words with one sign for each, so that an edit distance of strings is one of words."""
    number = lambda w: F.pmod(F.xxhash64(w), F.lit(SIGNS))
    code = F.transform(words, lambda w: F.lpad(F.hex(number(w) + F.when(number(w) >= 0xD800, 0x800).otherwise(0)), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def similar(pairs: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """The pairs whose word edit similarity (1 - distance / longer length) is ``least`` or more.

    A sign stands for any of many words: two given words pass for one another with probability 9e-7.
    """
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "line-ids")
    signs = cut(lines.join(_few(ids), "id", "left_semi").select("id", word_signs(F.split("line", " ")).alias("signs")), "line-signs")
    both = pairs.join(signs.select(F.col("id").alias("a"), F.col("signs").alias("x")), "a").join(signs.select(F.col("id").alias("b"), F.col("signs").alias("y")), "b")
    both = both.withColumn("most", _edits(F.greatest(F.length("x"), F.length("y")), least))
    return both.where(F.expr("levenshtein(x, y, most)") >= 0).select("a", "b")  # -1 beyond the third argument


def within_radius(pairs: DataFrame, lines: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose SimHashes differ in at most ``radius`` bits."""
    sims = simhashes(docs, settings.min_words).groupBy("h1").agg(F.min("sim").alias("sim"))
    sims = lines.select("id", F.xxhash64(F.split("line", " ")).alias("h1")).join(sims, "h1")
    left, right = (sims.select(F.col("id").alias(i), F.col("sim").alias(f"s{i}")) for i in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= settings.radius).select("a", "b")


def line_links(lines: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Links a, b of lines (``id``, ``words``, ``line``) that make the connected groups of all near pairs.

    First every line is held against the smallest id that meets at its key, by one share of the keys and then by the others,
    which joins most of a family of copies without all their pairs. Then only lines of different groups are held against each
    other, so no link between groups is missed. Lines part where they meet if their words alone leave them too far apart.
    """
    least, here = settings.least, Window.partitionBy("key")
    sets = _key_lists(lines, least, _marks(F.split("line", " "), F.col("words")).alias("marks"))
    sets = cut(sets.select("id", "size", "keys", *[F.col("marks")[i].alias(f"marks{i}") for i in range(MARKS)]), "line-keys")

    def rows(links: DataFrame | None, share: int) -> DataFrame:
        """Meetings at a share of the keys, with the group of each line."""
        some = sets.withColumn("keys", F.filter("keys", lambda k: F.pmod(F.xxhash64(k), F.lit(SHARES)) == share))
        if links is None:
            some = some.withColumn("group", F.col("id"))
        else:
            some = some.join(links, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
        return some.select(F.explode("keys").alias("key"), *[c for c in some.columns if c != "keys"])

    def linked(pairs: DataFrame) -> DataFrame:
        found = similar(pairs, lines, least)
        return cut(found if settings.radius is None else within_radius(found, lines, docs, settings), "line-links")

    def groups(links: DataFrame) -> DataFrame:
        return _few(cut(components(links).select(F.col("node").alias("id"), "component"), "line-groups"))

    def mixed(of: DataFrame) -> DataFrame:
        of = of.withColumns({"low": F.min("group").over(here), "high": F.max("group").over(here)})
        return of.where(F.col("low") < F.col("high")).drop("low", "high")

    links = linked(cut(_led(rows(None, 0), least, "group"), "line-pairs"))
    group = groups(links)
    pairs = [cut(_led(rows(group, k), least, "group"), "line-pairs") for k in range(1, SHARES)]
    links = links.union(linked(cut(reduce(DataFrame.union, pairs).distinct(), "line-pairs")))
    group = groups(links)
    met = [cut(_met(mixed(rows(group, k)), least, "group"), "line-pairs") for k in range(SHARES)]
    met = reduce(DataFrame.union, met).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
    return links.union(linked(cut(met.where(F.col("shared") >= F.col("need")).select("a", "b"), "line-pairs")))


def removed_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, th and the positions of the lines to remove, one row for each document that loses any."""
    docs = docs.select("doc_id", "text")
    lines = _plain(docs, settings.min_words)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos", "th")
    keys = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.first("n").alias("words"), F.first("line").alias("line"))
    keys = cut(keys.withColumn("id", F.monotonically_increasing_id()), "distinct-lines", "zstd")  # written, so the numbers stay
    groups = components(line_links(keys.select("id", "words", "line"), docs, settings)).select(F.col("node").alias("id"), "component")
    grouped = keys.drop("line", "words").join(groups, "id", "left")
    lead = cut(grouped.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("lead")), "leads")
    known = grouped.where((F.col("times") > 1) | F.col("component").isNotNull()).join(lead, "component", "left")
    keep = known.select("h1", "h2", F.coalesce("lead", "first").alias("keep"))
    gone = lines.select("doc_id", "th", "pos", "h1", "h2").join(keep, ["h1", "h2"])
    here = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("pos") == F.col("keep.pos")) & (F.col("th") == F.col("keep.th"))
    return gone.where(~here).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))


def deduplicate_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without lines that repeat an earlier one or nearly so, with n_lines and n_removed.

    A line is what stands between newlines; only lines of at least ``min_words`` words take part, all shorter ones stay.
    Two different lines link when 1 - (word edit distance) / (words of the longer) is at least ``least`` and, unless
    ``radius`` is None as in WHOLE, their SimHashes differ in at most ``radius`` bits. Of a connected group the occurrence with the smallest doc_id and position stays
    (null ids come last). A document that loses all lines has the empty text. Null texts stay null, with 0 lines; an
    empty text has one line. Rows that repeat doc_id and text are one document and come back alike. n_chars, if there,
    follows the new text; other columns stay, those named n_lines or n_removed are replaced.
    """
    base = docs.drop("n_lines", "n_removed")
    gone = cut(removed_lines(base, settings), "removed-lines").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    positions = gone.agg(F.sum(F.size("__gone") + 8)).first()[0] or 0
    gone = F.broadcast(gone) if positions <= 8 * SMALL else gone  # some 30 MB at most
    out = base.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left")
    line = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(line, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(line)).cast("long")
    out = out.withColumn("n_lines", n_lines).withColumn("n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")).withColumn("text", text)
    out = out.drop("__id", "__th", "__gone")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
