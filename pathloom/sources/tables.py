"""A property graph over the star-schema tables, and pairs of customers to learn from.

Node ids are strings with a letter for the type; edges are listed once, in one direction.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """nodes: id, type, name, abbrev, orient_val.  edges: eid, src, dst, label, score, target_id, ctx (array, null: neutral)."""

    nodes: DataFrame
    edges: DataFrame


Kind = tuple[str, str, str]


@dataclass(frozen=True)
class Cliques:
    """Edges that join every two members of a group, kept as the members: grp, id, place, value.

    Of two members the one of the smaller place is the source; the score is the smaller value over the larger one, and the
    target is the member of the larger value (of equal ones, and where one is null, the edge's end).  kind (type, label,
    type): both types are the same, and no other edges have the label.  A group of n members stands for n * (n - 1) / 2 edges.
    """

    members: DataFrame
    kind: Kind

    def edges(self) -> DataFrame:
        """The edges one by one: src, dst, label, score, target_id, ctx, eid."""
        a, b = self._side("a"), self._side("b")
        # Files of members are small and the pairs are not: a broadcast would leave the pairs to the tasks that scan those files.
        return self._joined(a.join(b.hint("shuffle_hash"), "grp"))

    def among(self, asked: DataFrame) -> DataFrame:
        """Those of the edges that join two of the asked nodes (u, v), whichever is the source; no others are listed."""
        ways = F.array(F.struct(F.col("u").alias("a_id"), F.col("v").alias("b_id")), F.struct(F.col("v").alias("a_id"), F.col("u").alias("b_id")))
        both = asked.select(F.explode(ways).alias("w")).select("w.a_id", "w.b_id").distinct()
        return self._joined(both.join(self._side("a").hint("shuffle_hash"), "a_id").join(self._side("b").hint("shuffle_hash"), ["b_id", "grp"]))

    def _side(self, k: str) -> DataFrame:
        return self.members.select("grp", *(F.col(c).alias(f"{k}_{c}") for c in ("id", "place", "value")))

    def _joined(self, both: DataFrame) -> DataFrame:
        target = F.when(F.col("a_value") > F.col("b_value"), F.col("a_id")).otherwise(F.col("b_id"))
        return both.filter("a_place < b_place").select(
            F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.lit(self.kind[1]).alias("label"), (F.least("a_value", "b_value") / F.greatest("a_value", "b_value")).alias("score"),
            target.alias("target_id"), F.lit(None).cast("array<string>").alias("ctx"), edge_id(F.lit(self.kind[1]), F.col("a_id"), F.col("b_id")),
        )


def edge_id(label: F.Column, src: F.Column, dst: F.Column) -> F.Column:
    return F.concat_ws("|", label, src, dst).alias("eid")


#: Of the projected edges: type of the source, label, type of the target.
ALIKE = ("Part", "resembles", "Part")
KINDS: list[Kind] = [
    ("Customer", "purchases", "Part"), ("Supplier", "supplies", "Part"), ("Customer", "locatedIn", "Nation"), ("Supplier", "locatedIn", "Nation"), ("Customer", "inSegment", "Segment"),
    ("Part", "hasBrand", "Brand"), ALIKE, ("Nation", "sameRegion", "Nation"), ("Customer", "refers", "Customer"), ("Nation", "inRegion", "Region"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(df: DataFrame, letter: str, kind: str, abbrev: str, key: str, name: str, value: F.Column) -> DataFrame:
        return df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), F.lit(abbrev).alias("abbrev"), value.cast("double").alias("orient_val"))

    customer, part, supplier, nation, region = (table(spark, sf_dir, t) for t in ("customer", "part", "supplier", "nation", "region"))
    none = F.lit(0.0)
    parts = [
        of(customer, "C", "Customer", "C", "c_custkey", "c_name", F.col("c_acctbal")),
        of(part, "P", "Part", "P", "p_partkey", "p_name", F.col("p_retailprice")),
        of(supplier, "S", "Supplier", "S", "s_suppkey", "s_name", F.col("s_acctbal")),
        of(nation, "N", "Nation", "N", "n_nationkey", "n_name", none),
        of(region, "R", "Region", "R", "r_regionkey", "r_name", none),
        of(customer.select("c_mktsegment").distinct(), "G", "Segment", "SG", "c_mktsegment", "c_mktsegment", none),
        of(part.select("p_brand").distinct(), "B", "Brand", "B", "p_brand", "p_brand", none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alike(spark: SparkSession, sf_dir: str) -> Cliques:
    """Parts of one brand and size, every two of which resemble each other."""
    part = table(spark, sf_dir, "part").filter("p_brand IS NOT NULL AND p_size IS NOT NULL AND p_partkey IS NOT NULL")
    grp = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return Cliques(part.select(grp.alias("grp"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("place"), F.col("p_retailprice").alias("value")), ALIKE)


def _flags(lineitem: DataFrame) -> F.Column:
    """The sorted set of a group's return flags: bits of a number, since sets of texts are grouped by sorting all rows."""
    names = sorted(r[0] for r in lineitem.select("l_returnflag").filter("l_returnflag IS NOT NULL").distinct().limit(63).collect())
    if len(names) > 62:
        return F.sort_array(F.collect_set("l_returnflag"))
    if not names:
        return F.first(F.array().cast("array<string>"))
    place = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i).cast("long"))))
    found = F.coalesce(F.bit_or(F.try_element_at(place, F.col("l_returnflag"))), F.lit(0).cast("long"))
    return F.array_compact(F.array(*(F.when(found.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(n)) for i, n in enumerate(names))))


def edges(spark: SparkSession, sf_dir: str, kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """All edges, or those of some kinds alone."""
    customer, part, supplier, nation, orders, lineitem = (table(spark, sf_dir, t) for t in ("customer", "part", "supplier", "nation", "orders", "lineitem"))

    def key(letter: str, column: str) -> F.Column:
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    none_ctx, no_target = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    flags = _flags(lineitem) if {KINDS[0], KINDS[1]} & set(kinds) else F.lit(None)
    bought = (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg((F.avg("l_quantity") / 50).alias("score"), flags.alias("ctx"))
        .select(key("C", "o_custkey").alias("src"), key("P", "l_partkey").alias("dst"), F.lit("purchases").alias("label"), "score", key("P", "l_partkey").alias("target_id"), "ctx")
    )
    supplied = (
        lineitem.groupBy("l_suppkey", "l_partkey").agg(F.avg(1 - 5 * F.col("l_discount")).alias("score"), flags.alias("ctx"))
        .select(key("S", "l_suppkey").alias("src"), key("P", "l_partkey").alias("dst"), F.lit("supplies").alias("label"), "score", key("P", "l_partkey").alias("target_id"), "ctx")
    )

    def plain(df: DataFrame, src: F.Column, dst: F.Column, label: str, score: F.Column, target: F.Column = no_target) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(label).alias("label"), score.cast("double").alias("score"), target.alias("target_id"), none_ctx.alias("ctx"))

    one = F.lit(1.0)
    n1, n2 = (nation.select(F.col("n_nationkey").alias(f"{k}_key"), "n_regionkey") for k in "ab")
    total = customer.agg(F.count("*").alias("n"))
    refers = (
        customer.filter("c_custkey % 3 = 0").crossJoin(F.broadcast(total))  # one row
        .select("c_custkey", ((7 * F.col("c_custkey") + 13) % F.col("n")).alias("other")).filter("c_custkey <> other")
    )
    parts = {
        KINDS[0]: bought, KINDS[1]: supplied,
        KINDS[2]: plain(customer, key("C", "c_custkey"), key("N", "c_nationkey"), "locatedIn", one),
        KINDS[3]: plain(supplier, key("S", "s_suppkey"), key("N", "s_nationkey"), "locatedIn", one),
        KINDS[4]: plain(customer, key("C", "c_custkey"), key("G", "c_mktsegment"), "inSegment", F.lit(0.5)),
        KINDS[5]: plain(part, key("P", "p_partkey"), key("B", "p_brand"), "hasBrand", one),
        ALIKE: alike(spark, sf_dir).edges().drop("eid"),
        KINDS[7]: plain(n1.join(n2, "n_regionkey").filter("a_key < b_key"), key("N", "a_key"), key("N", "b_key"), "sameRegion", F.lit(0.8)),
        KINDS[8]: plain(refers, key("C", "c_custkey"), key("C", "other"), "refers", 0.5 + (F.col("c_custkey") % 50) / 100, key("C", "other")),
        KINDS[9]: plain(nation, key("N", "n_nationkey"), key("R", "n_regionkey"), "inRegion", one),
    }
    found = [parts[k] for k in KINDS if k in kinds]
    out = reduce(DataFrame.unionByName, found) if found else parts[KINDS[-1]].limit(0)
    return out.withColumn("eid", edge_id(F.col("label"), F.col("src"), F.col("dst")))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered distinct pairs (x, y) of customer keys: (c, (7c + 13k) mod n) for k in 1, 2."""
    customer = table(spark, sf_dir, "customer")
    total = customer.agg(F.count("*").alias("n"))
    both = customer.crossJoin(F.broadcast(total)).select("c_custkey", "n", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))  # total is one row
    other = both.select("c_custkey", ((7 * F.col("c_custkey") + 13 * F.col("k")) % F.col("n")).alias("other")).filter("c_custkey <> other")
    return other.select(F.least("c_custkey", "other").alias("x"), F.greatest("c_custkey", "other").alias("y")).distinct()


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oriented pairs (a, b) with label, weight and the evidence that gives it (fam, smeta, smanual, level)."""
    from pathloom.functions.expressions import evidence_level, first_of_pair

    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    home = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", "n_regionkey")  # nation is a fixed list of countries
    x, y = (home.select(*(F.col(c).alias(f"{k}_{c}") for c in home.columns)) for k in "xy")
    both = raw_pairs(spark, sf_dir).join(x, F.col("x") == F.col("x_c_custkey")).join(y, F.col("y") == F.col("y_c_custkey"))
    ids = both.withColumn("xi", F.concat(F.lit("C"), F.col("x").cast("string"))).withColumn("yi", F.concat(F.lit("C"), F.col("y").cast("string")))
    first = first_of_pair(F.col("xi"), F.col("x_c_acctbal"), F.col("yi"), F.col("y_c_acctbal"))
    oriented = ids.select(
        F.when(first, F.col("xi")).otherwise(F.col("yi")).alias("a"), F.when(first, F.col("yi")).otherwise(F.col("xi")).alias("b"),
        F.when(F.col("x_n_regionkey") == F.col("y_n_regionkey"), 1).otherwise(0).alias("label"),
        ((F.col("x") + F.col("y")) % 4).cast("int").alias("fam"), ((F.col("x") * F.col("y")) % 3).cast("int").alias("smeta"), (F.col("x") % 2).cast("int").alias("smanual"),
        (((7 * F.col("x") + F.col("y")) % 100 + 1) / 100).alias("raw_weight"),
    )
    level = evidence_level(F.col("fam"), F.col("smeta"), F.col("smanual"))
    scaled = oriented.withColumn("level", level)
    most = scaled.filter("label = 0").agg(F.max("raw_weight").alias("most"))
    return scaled.crossJoin(F.broadcast(most)).withColumn("weight", F.when(F.col("label") == 1, F.greatest(F.col("level"), F.lit(1)) / 3).otherwise(F.try_divide("raw_weight", "most"))).drop("most", "raw_weight")
