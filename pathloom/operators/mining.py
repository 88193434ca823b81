"""Frequent sets of metapaths on weighted pairs, their refinement by shared nodes, and closedness.

Tables: paths (a, b, mp_id, mids, score); weights (a, b, weight); occurrences (items, a, b, weight), one row per set and
pair; patterns (items, clause), where a clause lists (mp, pos): the same node stands there on a path of each listed metapath.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.expressions import reversed_metapath
from pathloom.operators import bitmaps
from pathloom.sources.store import written_once

CLAUSE = "array<struct<mp:int,pos:int>>"


def least_support(weights: DataFrame, ratio: float, weighted: bool = True) -> float:
    """ratio of all weight; without weights, of all pairs, rounded down."""
    r = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"), F.count("*").alias("n")).first()
    return r["w"] * ratio if weighted else float(int(r["n"] * ratio))


def directed(paths: DataFrame, direction: int, compat: bool = False) -> DataFrame:
    """Paths (with mp) as walked from their start (1) or their end (-1)."""
    if direction == 1:
        return paths
    return paths.withColumn("mp", reversed_metapath(F.col("mp"), compat)).withColumn("mids", F.reverse("mids"))


def turned(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) and, beside them, the same with a and b in turn."""
    swapped = pairs.withColumns({"a": F.col("b"), "b": F.col("a")})
    return pairs.unionByName(swapped)


def both_ways(paths: DataFrame, compat: bool = False) -> DataFrame:
    """Paths (with mp), and each of them as walked from its end, as a path of the turned pair.

    A set of items then holds a pair in one direction if it holds the pair or the turned pair: items never mix directions.
    """
    back = directed(paths, -1, compat)
    return paths.unionByName(back.withColumns({"a": F.col("b"), "b": F.col("a")}).select(paths.columns))


def items_of(paths: DataFrame, weights: DataFrame) -> DataFrame:
    return paths.select("a", "b", "mp_id").distinct().join(weights.select("a", "b", "weight"), ["a", "b"])


def once(occurrences: DataFrame, *keys: str) -> DataFrame:
    """Occurrences of a pair and of the turned pair as one."""
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return occurrences.groupBy(*keys, *ends).agg(F.max("weight").alias("weight"))


def supported(occurrences: DataFrame, least: float, *keys: str, turning: bool = False) -> DataFrame:
    """Sets whose weight reaches least, up to rounding of the sum; turning: a pair counts once, whichever way it is held."""
    occurrences = once(occurrences, *keys) if turning else occurrences
    return occurrences.groupBy(*keys).agg(F.sum("weight").alias("support"), F.count("*").alias("n_matches")).filter(F.round("support", 9) >= round(least, 9))


def frequent_metapaths(items: DataFrame, least: float, turning: bool = False) -> DataFrame:
    return supported(items, least, "mp_id", turning=turning)


def longer_sets(known: DataFrame) -> DataFrame:
    """items one longer than the known ones, and the two of these that it is made of (head: all but the last, tail: all but the
    last but one): sets that agree but for their last items, all of whose subsets are known."""
    k = F.size("items")
    stem = F.slice("items", 1, k - 1).alias("stem")
    left = known.select(stem, F.element_at("items", -1).alias("last"), F.col("items").alias("head"))
    right = known.select(stem, F.element_at("items", -1).alias("next"), F.col("items").alias("tail"))
    longer = left.join(right, "stem").filter("last < next").select(F.concat("head", F.array("next")).alias("items"), "head", "tail")
    return longer.join(all_subsets_frequent(longer.select("items"), known), "items", "left_semi")


def all_subsets_frequent(sets: DataFrame, known: DataFrame) -> DataFrame:
    """The sets (items) all of whose subsets of one item less are among known (items)."""
    n = F.size("items")
    parts = sets.select("items", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.slice("items", 1, i - 1), F.slice("items", i + 1, n)))).alias("part"))
    hit = parts.join(known.select(F.col("items").alias("part")), "part", "left_semi")
    return hit.groupBy("items").agg(F.count("*").alias("n")).filter(F.col("n") == n).select("items")


class Transactions:
    """The pairs (a, b, weight) of items as bitmaps: items and sets of items are words of pairs that hold them.

    bits: (items, word, ahead, back).  Without turning, ahead has the pairs; with it, a pair and the turned pair share a bit,
    in ahead if they are held as a <= b and in back otherwise.  Sets meet direction by direction, and a pair counts once.
    """

    def __init__(self, items: DataFrame, turning: bool, kept: Callable[[DataFrame], DataFrame]):
        self.turning = turning
        items = items.withColumns({"_x": F.least("a", "b"), "_y": F.greatest("a", "b")} if turning else {"_x": F.col("a"), "_y": F.col("b")})
        ends = items.groupBy("_x", "_y").agg(F.max("weight").alias("weight"))
        self.pairs = kept(bitmaps.numbered(ends, ["_x", "_y"]))
        self.weights = kept(bitmaps.weight_tables(self.pairs, weight=F.col("weight")))
        ahead = (F.col("a") == F.col("_x")) if turning else F.lit(True)
        by = items.join(self.pairs.select("_x", "_y", "word", "bit"), ["_x", "_y"]).groupBy(F.array("mp_id").alias("items"), "word")
        self.bits = kept(by.agg(bitmaps.set_of(where=ahead).alias("ahead"), bitmaps.set_of(where=~ahead).alias("back")))

    def supported(self, bits: DataFrame, least: float) -> DataFrame:
        """items, support, n_matches of the sets whose weight reaches least, up to rounding of the sum."""
        held = F.col("ahead").bitwiseOR(F.col("back"))
        weighed = bits.join(self.weights, "word").select("items", bitmaps.weight_of(held, "weight").alias("w"), F.bit_count(held).alias("n"))
        return weighed.groupBy("items").agg(F.sum("w").alias("support"), F.sum("n").cast("long").alias("n_matches")).filter(F.round("support", 9) >= round(least, 9))

    def met(self, sets: DataFrame, bits: DataFrame) -> DataFrame:
        """Bits of sets (items, head, tail) from those of their heads and tails."""
        head = sets.join(bits.withColumnRenamed("items", "head"), "head")
        both = head.join(bits.select(F.col("items").alias("tail"), "word", F.col("ahead").alias("_ahead"), F.col("back").alias("_back")), ["tail", "word"])
        met = both.select("items", "word", F.col("ahead").bitwiseAND(F.col("_ahead")).alias("ahead"), F.col("back").bitwiseAND(F.col("_back")).alias("back"))
        return met.filter("ahead <> 0 or back <> 0")

    def occurrences(self, bits: DataFrame) -> DataFrame:
        """a, b, weight, items: the pairs themselves, where a step asks for them."""
        each = bits.join(self.pairs, "word")
        ways = [F.when(bitmaps.has("ahead"), F.struct(F.col("_x").alias("a"), F.col("_y").alias("b")))]
        if self.turning:
            ways.append(F.when(bitmaps.has("back"), F.struct(F.col("_y").alias("a"), F.col("_x").alias("b"))))
        each = each.select("items", "weight", F.explode(F.array_compact(F.array(*ways))).alias("p"))
        return each.select("p.a", "p.b", "weight", "items")


def apriori(items: DataFrame, least: float, longest: int = 3, turning: bool = False, kept: Callable[[DataFrame], DataFrame] = written_once) -> list[tuple[DataFrame, DataFrame]]:
    """Per size from 1, (patterns: items, support, n_matches; their occurrences).  Ends early when a level has fewer than two sets.

    Between levels there are bitmaps, a row a set and word of 64 pairs; single pairs come back where occurrences are read.
    kept: writes what is read more than once: the pairs' numbers, a level's bits and its sets.
    """
    known = Transactions(items, turning, kept)
    bits = known.bits
    level = kept(known.supported(bits, least))
    out = []
    for size in range(1, longest + 1):
        bits = bits.join(level.select("items"), "items", "left_semi")
        out.append((level, known.occurrences(bits)))
        if size == longest or (size > 1 and level.limit(2).count() < 2):
            break
        bits = kept(known.met(longer_sets(level.select("items")), bits))
        level = kept(known.supported(bits, least))
    return out


def mined(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Occurrences of all sets of two items and more."""
    out = levels[0][1].limit(0)
    for _, occurrences in levels[1:]:
        out = out.unionByName(occurrences)
    return out


def unifiable(patterns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Patterns (items) of which two metapaths have an intermediate node type in common."""
    inner = dictionary.select("mp_id", F.explode(F.array_distinct(F.slice("mp.nodes", 2, F.size("mp.nodes") - 2))).alias("kind"))
    each = patterns.select("items", F.explode("items").alias("mp_id")).join(F.broadcast(inner), "mp_id")  # metapaths of the schema
    return each.groupBy("items", "kind").agg(F.count("*").alias("n")).filter("n >= 2").select("items").distinct()


def path_nodes(paths: DataFrame) -> DataFrame:
    """a, b, mp_id, node, pos (from 1): where the intermediate nodes of the paths of each metapath stand, with the best score."""
    each = paths.select("a", "b", "mp_id", "score", F.posexplode("mids").alias("p", "node"))
    return each.groupBy("a", "b", "mp_id", "node", (F.col("p") + 1).alias("pos")).agg(F.max("score").alias("score"))


def unifications(occurrences: DataFrame, places: DataFrame) -> DataFrame:
    """items, clause, a, b, weight: every choice of two or more metapaths of a set that share a node, and its positions."""
    each = occurrences.select("items", "a", "b", "weight", F.posexplode("items").alias("slot", "mp_id")).join(places.select("a", "b", "mp_id", "node", "pos"), ["a", "b", "mp_id"])
    step = each.select("items", "a", "b", "weight", "node", "slot", F.struct(F.col("mp_id").alias("mp"), F.col("pos").cast("int").alias("pos")).alias("part"))
    key = ["items", "a", "b", "node"]
    right = step.select(*key, F.col("slot").alias("next"), F.col("part").alias("more"))
    grown = step.select(*key, "weight", "slot", F.array("part").alias("clause"))
    longest = occurrences.agg(F.coalesce(F.max(F.size("items")), F.lit(0))).first()[0]
    out = None
    for _ in range(2, longest + 1):
        grown = grown.join(right, key).filter("slot < next").select(*key, "weight", F.col("next").alias("slot"), F.concat("clause", F.array("more")).alias("clause"))
        out = grown if out is None else out.unionByName(grown)
    if out is None:
        out = grown.limit(0)
    return out.select("items", "clause", "a", "b", "weight").distinct()


def with_unifications(occurrences: DataFrame, found: DataFrame, least: float, turning: bool = False) -> DataFrame:
    """Occurrences (items, clause, a, b, weight) of the sets as they are (clause empty) and of the frequent ones of their unifications (found; it is read twice)."""
    kept = found.join(supported(found, least, "items", "clause", turning=turning).select("items", "clause"), ["items", "clause"], "left_semi")
    return occurrences.select("items", F.array().cast(CLAUSE).alias("clause"), "a", "b", "weight").unionByName(kept.select("items", F.col("clause").cast(CLAUSE).alias("clause"), "a", "b", "weight"))


def closed(patterns: DataFrame, strict: bool = False) -> DataFrame:
    """Patterns (items, clause, n_matches) that no pattern one level up makes needless.

    The level is the number of items, and one more with a clause.  A pattern goes if one a level up that holds its first
    item has as many matches (strict: that holds all its items and parts of its clause).
    """
    if strict:
        most = held_below(patterns).groupBy("items", "clause").agg(F.max("up_n").alias("up_n"))
        return patterns.join(most, ["items", "clause"], "left").filter(F.col("up_n").isNull() | (F.col("up_n") < F.col("n_matches"))).select(patterns.columns)
    level = F.size("items") + F.when(F.size("clause") > 0, 1).otherwise(0)
    up = patterns.select(F.col("items").alias("up_items"), F.col("n_matches").alias("up_n"), (level - 1).alias("level"))
    most = up.select("level", F.explode("up_items").alias("mp"), "up_n").groupBy("level", "mp").agg(F.max("up_n").alias("up_n"))
    keyed = patterns.withColumn("level", level).withColumn("mp", F.element_at("items", 1))
    return keyed.join(most, ["level", "mp"], "left").filter(F.col("up_n").isNull() | (F.col("up_n") < F.col("n_matches"))).select(patterns.columns)


def held_below(patterns: DataFrame) -> DataFrame:
    """items, clause, up_n: every pattern one level down that each pattern holds, whole, with the matches of the latter.

    Without a clause these are its sets of one item less.  With one, its items without a clause, and its sets of one item less
    with every part of the clause that these items leave: two places at least.  Patterns have a handful of items, so these
    are few, and a pattern meets those that hold it by one join on its whole key.
    """
    n = F.size("items")
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.slice("items", 1, i - 1), F.slice("items", i + 1, n)))
    none = F.array().cast(CLAUSE)
    plain = patterns.filter(F.size("clause") == 0).select(F.explode(less).alias("items"), none.alias("clause"), F.col("n_matches").alias("up_n"))
    tied = patterns.filter(F.size("clause") > 0)
    whole = tied.select("items", none.alias("clause"), F.col("n_matches").alias("up_n"))
    parts = F.expr("filter(transform(sequence(1, cast(pow(2, size(clause)) as int) - 1), m -> filter(clause, (c, i) -> shiftright(m, i) % 2 = 1)), p -> size(p) >= 2)")
    part = tied.select(F.explode(less).alias("items"), parts.alias("parts"), F.col("n_matches").alias("up_n")).select("items", F.explode("parts").alias("clause"), "up_n")
    part = part.filter(F.forall("clause", lambda c: F.array_contains("items", c["mp"])))
    return plain.unionByName(whole).unionByName(part)


def pattern_table(occurrences: DataFrame, turning: bool = False) -> DataFrame:
    occurrences = once(occurrences, "items", "clause") if turning else occurrences
    return occurrences.groupBy("items", "clause").agg(F.count("*").alias("n_matches"), F.sum("weight").alias("support"))


def with_ids(patterns: DataFrame) -> DataFrame:
    """Patterns numbered from 1 in the order of items and clause; there are as many as the support lets through."""
    spread = patterns.withColumn("_first", F.element_at("items", 1))
    counts = spread.groupBy("_first").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("_first").orderBy("items", "clause"))
    return spread.withColumn("_at", at).join(F.broadcast(counts), "_first").withColumn("pat_id", (F.col("_at") + F.col("_before")).cast("int")).drop("_first", "_n", "_before", "_at")  # a row per metapath
