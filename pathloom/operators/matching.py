"""Matching rules on pairs, and the sub-graph that explains a match.

rules: rule_id, items, clause, thr (one threshold per item; null: none).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.mining import path_nodes
from pathloom.sources.tables import Cliques, Graph


def slots(rules: DataFrame) -> DataFrame:
    """A row per rule and item: rule_id, n, slot, mp_id, least, pos (in the clause, or null), n_clause."""
    each = rules.select("rule_id", F.size("items").alias("n"), F.size("clause").alias("n_clause"), "clause", "thr", F.posexplode("items").alias("slot", "mp_id"))
    pos = F.try_element_at(F.filter("clause", lambda c: c["mp"] == F.col("mp_id")), F.lit(1))["pos"]
    least = F.when(F.col("thr").isNull(), F.lit(None).cast("double")).otherwise(F.get("thr", F.col("slot")))
    return each.select("rule_id", "n", "n_clause", "slot", "mp_id", least.alias("least"), pos.alias("pos"))


def _enough(score: str) -> F.Column:
    return F.col("least").isNull() | (F.col(score) >= F.col("least"))


def all_items(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """rule_id, a, b where every item of the rule has a path that reaches its threshold."""
    best = paths.groupBy("a", "b", "mp_id").agg(F.max("score").alias("score"))
    hit = best.join(slots(rules), "mp_id").filter(_enough("score"))
    return hit.groupBy("rule_id", "n", "a", "b").agg(F.count("*").alias("k")).filter("k = n").select("rule_id", "a", "b")


def clause_nodes(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """rule_id, a, b, node: nodes that stand where the clause says on a path of each of its metapaths."""
    parts = slots(rules).filter("pos is not null")
    hit = path_nodes(paths).join(parts, ["mp_id", "pos"]).filter(_enough("score"))
    return hit.groupBy("rule_id", "n_clause", "a", "b", "node").agg(F.count_distinct("slot").alias("k")).filter("k = n_clause").select("rule_id", "a", "b", "node")


def match(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """rule_id, a, b: all items present and, with a clause, some node shared as it says."""
    found = all_items(rules, paths)
    plain = found.join(rules.filter(F.size("clause") == 0).select("rule_id"), "rule_id", "left_semi")
    shared = found.join(clause_nodes(rules, paths).select("rule_id", "a", "b").distinct(), ["rule_id", "a", "b"], "left_semi")
    return plain.unionByName(shared)


def folded(matches: DataFrame, pairs: DataFrame, *more: str) -> DataFrame:
    """rule_id, a, b (and more) of pairs or turned pairs, all as rows of the pairs (a, b) themselves."""
    known = pairs.select("a", "b").distinct()
    back = matches.withColumns({"a": F.col("b"), "b": F.col("a")})
    return matches.unionByName(back).join(known, ["a", "b"], "left_semi").select("rule_id", "a", "b", *more).distinct()


def matching_paths(rules: DataFrame, paths: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """rule_id, a, b, node, slot, mp_id, mids, score: the paths of each match, per qualifying node where there is a clause.

    found: the matches, where something else than match decides on them.

    A metapath outside the clause has its paths under a null node, once any node qualifies.
    """
    found, s = match(rules, paths) if found is None else found, slots(rules)
    hit = paths.join(s, "mp_id").filter(_enough("score")).join(found, ["rule_id", "a", "b"], "left_semi")
    free = hit.filter("pos is null").withColumn("node", F.lit(None).cast("string"))
    tied = hit.filter("pos is not null").withColumn("node", F.get("mids", F.col("pos") - 1)).join(clause_nodes(rules, paths), ["rule_id", "a", "b", "node"], "left_semi")
    return free.unionByName(tied, allowMissingColumns=True).select("rule_id", "a", "b", "node", "slot", "mp_id", "mids", "score")


class Matcher(Protocol):
    """Decides which pairs a rule holds.  An engine takes any object with these two methods in place of MetapathMatcher."""

    def match(self, rules: DataFrame, paths: DataFrame) -> DataFrame:
        """rule_id, a, b, each once.  rules: rule_id, items, clause, thr; paths: a, b, mp_id, mids, score."""
        ...

    def matching_paths(self, rules: DataFrame, paths: DataFrame) -> DataFrame:
        """rule_id, a, b, node, slot, mp_id, mids, score: the paths that explain each of the matches."""
        ...


@dataclass(frozen=True)
class MetapathMatcher:
    """All items over their thresholds, and the shared nodes of the clause."""

    def match(self, rules: DataFrame, paths: DataFrame) -> DataFrame:
        return match(rules, paths)

    def matching_paths(self, rules: DataFrame, paths: DataFrame) -> DataFrame:
        return matching_paths(rules, paths)


def low_fpr(rules: DataFrame, negative_matches: DataFrame, weights: DataFrame, most: float = 1.0) -> DataFrame:
    """Rules whose weighted negative matches are at most a share of all negative weight; with that weight."""
    hit = negative_matches.join(weights.select("a", "b", "weight"), ["a", "b"]).groupBy("rule_id").agg(F.sum("weight").alias("fp"))
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))
    return rules.join(hit, "rule_id", "left").crossJoin(F.broadcast(total)).withColumn("fp", F.coalesce("fp", F.lit(0.0))).filter(F.round("fp", 9) <= F.round(F.col("total") * most, 9)).drop("total")  # total is one row


def significant(rules: DataFrame, tp: str, fp: str, positives: int, negatives: int, alpha: float = 0.05) -> DataFrame:
    """Rules with a one-sided Fisher p of at most alpha; tp and fp are columns of whole counts.

    The tail of the hypergeometric distribution is summed over at most min(tp + fp, positives) - tp + 1 terms, in logs.
    """
    def log_choose(n: F.Column, k: F.Column) -> F.Column:
        # Stirling's series for the logarithm of the gamma function, good to 1e-9 from 8 on; smaller values by recurrence.
        def lg(x: F.Column) -> F.Column:
            y = x + 8
            series = (y - 0.5) * F.ln(y) - y + 0.5 * F.ln(F.lit(6.283185307179586)) + 1 / (12 * y) - 1 / (360 * y * y * y)
            shift = sum((F.ln(x + i) for i in range(1, 8)), F.ln(x))
            return series - shift

        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    hits, pos, neg = (F.col(tp) + F.col(fp)).cast("double"), F.lit(float(positives)), F.lit(float(negatives))
    terms = F.sequence(F.col(tp).cast("long"), F.least(hits, pos).cast("long"))
    p = F.aggregate(terms, F.lit(0.0), lambda s, x: s + F.when((hits - x.cast("double")) <= neg, F.exp(log_choose(pos, x.cast("double")) + log_choose(neg, hits - x.cast("double")) - log_choose(pos + neg, hits))).otherwise(0.0))
    return rules.withColumn("p_value", F.least(p, F.lit(1.0))).filter(F.col("p_value") <= alpha)


#: What an explanation tells of an edge.
EDGE = ("eid", "src", "dst", "label", "score", "target_id")


def explanation_edges(graph: Graph, found: DataFrame, dictionary: DataFrame, cliques: Cliques | None = None) -> DataFrame:
    """rule_id, a, b, eid: every edge (parallel ones too) of the wanted type along the matching paths.

    cliques: further edges, listed for the steps of the paths alone.
    """
    return explanation_steps(graph, found, dictionary, cliques).select("rule_id", "a", "b", "eid").distinct()


def explanation_steps(graph: Graph, found: DataFrame, dictionary: DataFrame, cliques: Cliques | None = None) -> DataFrame:
    """rule_id, a, b and the columns EDGE of these edges; the edges themselves stay as they are, steps are asked both ways."""
    hops = found.select("rule_id", "a", "b", "mp_id", F.concat(F.array("a"), "mids", F.array("b")).alias("walk")).distinct().join(F.broadcast(dictionary), "mp_id")  # metapaths of the schema
    each = hops.select("rule_id", "a", "b", F.posexplode("mp.edges").alias("i", "label"), "walk").select("rule_id", "a", "b", "label", F.get("walk", F.col("i")).alias("u"), F.get("walk", F.col("i") + 1).alias("v")).distinct()
    edges = graph.edges.select(*EDGE)
    if cliques is not None:
        edges = edges.unionByName(cliques.among(each.filter(F.col("label") == cliques.kind[1])).select(*EDGE))
    ways = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    asked = each.select("rule_id", "a", "b", "label", F.explode(F.array_distinct(ways)).alias("w")).select("rule_id", "a", "b", "label", "w.src", "w.dst").distinct()
    return asked.join(edges, ["label", "src", "dst"]).select("rule_id", "a", "b", *EDGE)


def subgraph_sizes(found: DataFrame) -> DataFrame:
    """Per match: distinct paths and distinct nodes, its ends included."""
    n_paths = found.groupBy("rule_id", "a", "b").agg(F.count_distinct("mp_id", "mids").alias("n_paths"))
    nodes = found.select("rule_id", "a", "b", F.explode(F.concat(F.array("a"), "mids", F.array("b"))).alias("n")).groupBy("rule_id", "a", "b").agg(F.count_distinct("n").alias("n_nodes"))
    return n_paths.join(nodes, ["rule_id", "a", "b"])
