"""Selection of pairs to learn from: evidence, hold-out, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.expressions import evidence_level, first_of_pair
from pathloom.operators.graph import adjacency
from pathloom.sources.tables import Graph

#: The types of nodes that say which pairs are positive.  A path through them would be the label itself.
EVIDENCE_TYPES = ("OligogenicCombination", "Disease")


def with_level(evidence: DataFrame) -> DataFrame:
    """Evidence rows (fam, smeta, smanual, ...) with their confidence level."""
    return evidence.withColumn("level", evidence_level(F.col("fam"), F.col("smeta"), F.col("smanual")))


def positive_pairs(evidence: DataFrame, least: int = 1, top: float = 3.0) -> DataFrame:
    """a, b, level (highest), ts (earliest), weight = level / top, of pairs whose level is at least least."""
    best = with_level(evidence).groupBy("a", "b").agg(F.max("level").alias("level"), F.min("ts").alias("ts"))
    return best.filter(F.col("level") >= least).withColumn("weight", F.col("level") / F.lit(top))


def evidence_index(graph: Graph, evidence_type: str = EVIDENCE_TYPES[0], entity_type: str = "Gene", context_type: str = EVIDENCE_TYPES[1]) -> DataFrame:
    """evidence_id, a, b, fam, smeta, smanual, ts, contexts, publications: evidence nodes with exactly two entity neighbours, oriented.

    contexts: ids of the neighbours of context_type.  Numbers come from the nodes' props; one that is missing counts as 0.
    """
    near = adjacency(graph).filter(F.col("u_type") == evidence_type).filter(F.col("v_type").isin(entity_type, context_type))
    mine = lambda kind: F.collect_list(F.when(F.col("v_type") == kind, F.col("v")))  # noqa: E731  neighbours of one node of evidence
    ends = near.groupBy(F.col("u").alias("evidence_id")).agg(F.count_if(F.col("v_type") == entity_type).alias("n"), F.min(F.when(F.col("v_type") == entity_type, F.col("v"))).alias("id1"), F.max(F.when(F.col("v_type") == entity_type, F.col("v"))).alias("id2"), F.array_distinct(mine(context_type)).alias("contexts"))
    value = graph.nodes.select("id", "orient_val")
    both = ends.filter("n = 2").join(value.select(F.col("id").alias("id1"), F.col("orient_val").alias("v1")), "id1").join(value.select(F.col("id").alias("id2"), F.col("orient_val").alias("v2")), "id2")
    first = first_of_pair(F.col("id1"), F.col("v1"), F.col("id2"), F.col("v2"))
    number = lambda name, kind: F.coalesce(F.try_element_at("props", F.lit(name)).try_cast(kind), F.lit(0).cast(kind))
    known = graph.nodes.filter(F.col("type") == evidence_type).select(F.col("id").alias("evidence_id"), number("FAMmanual", "int").alias("fam"), number("STATmeta", "int").alias("smeta"), number("STATmanual", "int").alias("smanual"), number("timestamp", "double").cast("long").alias("ts"), F.regexp_extract_all(F.coalesce(F.try_element_at("props", F.lit("PMIDs")), F.lit("")), F.lit(r"\d+"), F.lit(0)).alias("publications"))
    a, b = F.when(first, F.col("id1")).otherwise(F.col("id2")), F.when(first, F.col("id2")).otherwise(F.col("id1"))
    return both.join(known, "evidence_id").select("evidence_id", a.alias("a"), b.alias("b"), "fam", "smeta", "smanual", "ts", "contexts", "publications")


def graph_positives(index: DataFrame, least: int = 1, n_held_out: int = 15, least_held_out: int = 2) -> tuple[DataFrame, DataFrame]:
    """(positives, those held out), both a, b, weight, ts, contexts: pairs of the evidence index whose level is at least least.

    The most recent pairs of a higher level that share no entity are held out; contexts is the union over a pair's evidence.
    """
    seen = index.select("a", "b", F.explode_outer("contexts").alias("c")).groupBy("a", "b").agg(F.sort_array(F.collect_set("c")).alias("contexts"))
    found = positive_pairs(index, least).join(seen, ["a", "b"])
    held = recent_distinct(found.filter(F.col("level") >= least_held_out).select("a", "b", "ts"), n_held_out).select("a", "b")
    columns = ["a", "b", "weight", "ts", "contexts"]
    return found.join(held, ["a", "b"], "left_anti").select(columns), found.join(held, ["a", "b"], "left_semi").select(columns)


def recent_distinct(candidates: DataFrame, n: int) -> DataFrame:
    """The n most recent pairs (a, b, ts) that share no entity with a more recent one of them; ties by id.

    Greedy choice is one pair after another; each step is a top-1 over what the choice so far leaves, so only n rows ever
    come to the driver.
    """
    out = candidates.limit(0)
    left = candidates
    order = [F.desc("ts"), F.asc("a"), F.asc("b")]
    chosen = []
    for _ in range(n):
        best = left.orderBy(*order).first()
        if best is None:
            break
        chosen.append(best)
        left = left.filter(~F.col("a").isin(best["a"], best["b"]) & ~F.col("b").isin(best["a"], best["b"]))
    return candidates.sparkSession.createDataFrame(chosen, candidates.schema) if chosen else out


def max_scaled(df: DataFrame, column: str, most: float | None = None) -> DataFrame:
    """column / its largest value (or a given one), 0 where that is 0."""
    top = df.agg(F.max(column).alias("_most")) if most is None else df.sparkSession.createDataFrame([(float(most),)], "_most double")
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.coalesce(F.try_divide(column, "_most"), F.lit(0.0))).drop("_most")  # one row


def minmax_scaled(df: DataFrame, column: str) -> DataFrame:
    ends = df.agg(F.min(column).alias("_least"), F.max(column).alias("_most"))
    return df.crossJoin(F.broadcast(ends)).withColumn(column, F.coalesce(F.try_divide(F.col(column) - F.col("_least"), F.col("_most") - F.col("_least")), F.lit(0.0))).drop("_least", "_most")  # one row


def training_set(positives: DataFrame, negatives: DataFrame, held_out: DataFrame) -> DataFrame:
    """a, b, weight, label, part: positives without the held-out ones, negatives, and the held-out positives."""
    cols = ["a", "b", "weight"]
    rest = positives.select(cols).join(held_out.select("a", "b"), ["a", "b"], "left_anti")
    mark = lambda df, label, part: df.select(*cols, F.lit(label).alias("label"), F.lit(part).alias("part"))
    return mark(rest, 1, "train").unionByName(mark(negatives, 0, "train")).unionByName(mark(held_out, 1, "held-out"))


def level_statistics(evidence: DataFrame) -> DataFrame:
    """Of each level, and of all levels from 1 ('selected'): rows, pairs, entities and contexts (such as diseases).

    A row counts at its own level, with its contexts (array, if the column is there); a pair and its entities at the highest
    level of the pair's rows.
    """
    rows = with_level(evidence)
    contexts = F.col("contexts") if "contexts" in evidence.columns else F.array().cast("array<string>")
    rows = rows.select("a", "b", "level", contexts.alias("contexts"))
    pairs = rows.groupBy("a", "b").agg(F.max("level").alias("level"))

    def grouped(df: DataFrame) -> DataFrame:
        groups = F.array_compact(F.array(F.col("level").cast("string"), F.when(F.col("level") >= 1, F.lit("selected"))))
        return df.withColumn("grp", F.explode(groups)).drop("level")

    counts = grouped(rows).groupBy("grp").agg(F.count("*").alias("n_rows"))
    n_contexts = grouped(rows).select("grp", F.explode("contexts").alias("c")).groupBy("grp").agg(F.count_distinct("c").alias("n_contexts"))
    n_pairs = grouped(pairs).groupBy("grp").agg(F.count("*").alias("n_pairs"))
    n_entities = grouped(pairs).select("grp", F.explode(F.array("a", "b")).alias("entity")).groupBy("grp").agg(F.count_distinct("entity").alias("n_entities"))
    out = counts.join(n_pairs, "grp", "left").join(n_entities, "grp", "left").join(n_contexts, "grp", "left")
    return out.select("grp", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_rows", "n_pairs", "n_entities", "n_contexts")))


def holdout_details(evidence: DataFrame, graph_nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Names, level and date of chosen pairs, the names of their contexts and their publications, over all rows of evidence.

    contexts (ids) and publications are arrays; where evidence lacks one of them, it stays empty.
    """
    n = graph_nodes.select("id", "name")
    of = lambda c: F.col(c) if c in evidence.columns else F.array().cast("array<string>")
    mine = evidence.join(pairs.select("a", "b").distinct(), ["a", "b"], "left_semi").withColumns({c: of(c) for c in ("contexts", "publications")})
    best = positive_pairs(mine, 0)
    named = best.join(n.select(F.col("id").alias("a"), F.col("name").alias("name_a")), "a", "left").join(n.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b", "left")
    listed = lambda c, name: F.array_join(F.sort_array(F.collect_set(c)), name)
    seen = mine.select("a", "b", F.explode("contexts").alias("id")).join(n, "id").groupBy("a", "b").agg(listed("name", "-").alias("contexts"))
    told = mine.select("a", "b", F.explode("publications").alias("p")).groupBy("a", "b").agg(listed("p", ";").alias("publications"))
    out = named.join(seen, ["a", "b"], "left").join(told, ["a", "b"], "left")
    texts = (F.coalesce(c, F.lit("")).alias(c) for c in ("contexts", "publications"))
    return out.select("a", "b", "name_a", "name_b", "level", F.date_format(F.timestamp_seconds("ts"), "dd/MM/yyyy").alias("date"), *texts)


def folds(samples: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """Samples with a fold each, every label dealt evenly, in an order that the seed shuffles.

    A label's rows are ranked in two levels (bucket of the shuffle key, then inside the bucket), so no label gathers in
    one task.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "a", "b"))
    keyed = samples.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, 2))
    before = Window.partitionBy("label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("label", "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("label", "_bucket").orderBy("_key"))
    ranked = keyed.withColumn("_at", inside).join(F.broadcast(counts), ["label", "_bucket"])  # 256 buckets a label
    return ranked.withColumn("fold", ((F.col("_at") + F.col("_before") - 1) % n).cast("int")).drop("_key", "_bucket", "_at", "_before")
