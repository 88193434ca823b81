"""A compact decision set: greedy weighted cover, probabilities, predictions.

coverage: rule_id, a, b, label, weight, a row per rule and training pair that it matches.  samples: a, b, label, weight.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pathloom.functions.expressions import ratio
from pathloom.operators import bitmaps
from pathloom.sources.store import StageStore


def totals(samples: DataFrame) -> dict:
    r = samples.agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("weight"))), F.lit(0.0)).alias("wp"), F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("weight"))), F.lit(0.0)).alias("wn"),
        F.count_if(F.col("label") == 1).alias("np"), F.count_if(F.col("label") == 0).alias("nn"),
    ).first()
    return r.asDict()


def rule_totals(coverage: DataFrame) -> DataFrame:
    """rule_id, tp, fp: matched weight of either label."""
    part = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("weight"))), F.lit(0.0))
    return coverage.groupBy("rule_id").agg(part(1).alias("tp"), part(0).alias("fp"))


def confidences(coverage: DataFrame, r: float = 1.0) -> DataFrame:
    return rule_totals(coverage).withColumn("confidence", ratio(F.col("tp"), F.col("tp") + r * F.col("fp")))


def set_weight(coverage: DataFrame, t: dict, alpha: float = 0.5) -> float:
    """alpha (1 - TPR) + (1 - alpha) FPR of what the rules match together; 1 for no rules."""
    rows = rule_totals(coverage.select("a", "b", "label", "weight").distinct().withColumn("rule_id", F.lit(0))).first()
    if rows is None:
        return 1.0
    return alpha * (1 - rows["tp"] / t["wp"] if t["wp"] else 1.0) + (1 - alpha) * (rows["fp"] / t["wn"] if t["wn"] else 0.0)


class Coverage:
    """Coverage as bitmaps of pairs, and the weight that each rule would still add to a set.

    gains: rule_id, tp, fp (weights of what the rule matches and no chosen rule does) and confidence; a row a rule.  A step is one
    written table with the gains after it and, without a rule_id, the words and bits that it newly covered.  bits:
    rule_id, word, part, bits, in folders by part of the words, so that a step reads those of the words it changes; by_rule: the
    same in the order of the rules, so that a chosen rule's words are found by their files' statistics.
    """

    PARTS = 32

    def __init__(self, coverage: DataFrame, store: StageStore):
        self.store, self.key, self.step = store, uuid.uuid4().hex, 0
        ends = coverage.groupBy("a", "b", "label").agg(F.max("weight").alias("weight"))
        pairs = self._kept("cover-pairs", bitmaps.numbered(ends, ["a", "b", "label"]))
        part = F.pmod(F.xxhash64("word"), F.lit(self.PARTS)).cast("int").alias("part")
        of = lambda label: F.when(F.col("label") == label, F.col("weight"))
        self.weights = self._kept("cover-weights", bitmaps.weight_tables(pairs, tp=of(1), fp=of(0)))
        held = coverage.select("rule_id", "a", "b", "label").join(pairs.select("a", "b", "label", "word", "bit"), ["a", "b", "label"]).groupBy("rule_id", "word").agg(bitmaps.set_of().alias("bits"))
        self.by_rule = self._kept("cover-rules", held.repartitionByRange("rule_id").sortWithinPartitions("rule_id"))
        self.bits = self._kept("cover-words", self.by_rule.select("rule_id", "word", "bits", part).repartition("part"), "part")
        gains = self._weighed(self.by_rule).withColumn("confidence", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        self.gains = self._kept("cover-gains", gains.withColumns({"word": F.lit(None).cast("long"), "bits": F.lit(None).cast("long")}))
        self.steps: list[str] = []

    def _kept(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        self.step += 1
        return self.store.get_or_make(name, lambda: df, partition_by=by, run=self.key, step=self.step)

    def _weighed(self, sets: DataFrame) -> DataFrame:
        """rule_id, tp, fp of sets (rule_id, word, bits)."""
        total = lambda name: F.sum(bitmaps.weight_of(F.col("bits"), name)).alias(name)
        return sets.join(self.weights, "word").groupBy("rule_id").agg(total("tp"), total("fp"))

    def best(self, t: dict, alpha: float, base: float) -> Row | None:
        """The rule of least marginal weight, ties to the higher confidence, then to the higher id."""
        tp, fp = (F.col("tp") / t["wp"] if t["wp"] else F.lit(0.0)), (F.col("fp") / t["wn"] if t["wn"] else F.lit(0.0))
        return self.gains.withColumn("marginal", F.round((1 - alpha) * fp - alpha * tp + base, 12)).orderBy("marginal", F.desc("confidence"), F.desc("rule_id")).first()

    def choose(self, rule: int) -> None:
        """What the rule adds is taken off the other rules' gains: only the words that it changes are read."""
        spark, mine = self.bits.sparkSession, self.by_rule.filter(F.col("rule_id") == rule).select("word", "bits")
        if self.steps:
            seen = spark.read.schema(self.gains.schema).parquet(*self.steps).filter("rule_id is null").join(mine.select("word"), "word", "left_semi")
            before = seen.groupBy("word").agg(F.bit_or("bits").alias("before"))
            mine = mine.join(before, "word", "left").select("word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("before", F.lit(0).cast("long")))).alias("bits"))
        new = mine.filter("bits <> 0").withColumn("part", F.pmod(F.xxhash64("word"), F.lit(self.PARTS)).cast("int"))
        hit = self.bits.join(new.select("part", "word", F.col("bits").alias("new")), ["part", "word"]).select("rule_id", "word", F.col("bits").bitwiseAND(F.col("new")).alias("bits")).filter("bits <> 0")
        less = self._weighed(hit).select("rule_id", F.col("tp").alias("_tp"), F.col("fp").alias("_fp"))
        left = lambda name: (F.col(name) - F.coalesce(F.col(f"_{name}"), F.lit(0.0))).alias(name)
        rest = self.gains.filter(F.col("rule_id") != rule).join(less, "rule_id", "left").select("rule_id", left("tp"), left("fp"), "confidence", "word", "bits")
        step = self._kept("cover-step", rest.unionByName(new.select("word", "bits"), allowMissingColumns=True))
        self.steps.append(self.store.made[-1])
        self.gains = step.filter("rule_id is not null")


def set_cover(coverage: DataFrame, t: dict, alpha: float = 0.5, most: int | None = None, store: StageStore | None = None) -> list[tuple[int, float]]:
    """Rules in the order of choice, with the marginal weight of each: the smallest goes in, while it is below zero.

    Each step starts from the written gains of the one before and reads the words of pairs that the last rule covered; one row
    comes to the driver.  The tables of the search are deleted when it ends.
    """
    store = store or StageStore(coverage.sparkSession)
    mark, chosen = len(store.made), []
    try:
        state = Coverage(coverage, store)
        while most is None or len(chosen) < most:
            best = state.best(t, alpha, 0.0 if chosen else alpha - 1.0)  # the empty set weighs 1, not alpha
            if best is None or best["marginal"] >= 0:
                break
            chosen.append((best["rule_id"], best["marginal"]))
            if most is None or len(chosen) < most:
                state.choose(best["rule_id"])
    finally:
        store.drop_since(mark)
    return chosen


def default_probability(samples: DataFrame, covered: DataFrame, r: float) -> DataFrame:
    """One row: the probability of pairs that no rule of the set matches."""
    rest = samples.join(covered.select("a", "b").distinct(), ["a", "b"], "left_anti")
    part = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("weight"))), F.lit(0.0))
    return rest.agg(part(1).alias("tp"), part(0).alias("fp")).select(ratio(F.col("tp"), F.col("tp") + r * F.col("fp")).alias("default_probability"))


def rule_probabilities(coverage: DataFrame, t: dict) -> DataFrame:
    r = t["np"] / t["nn"] if t["nn"] else 0.0
    return confidences(coverage, r).select("rule_id", F.col("confidence").alias("probability"))


def predict(pairs: DataFrame, matches: DataFrame, probabilities: DataFrame, default: DataFrame) -> DataFrame:
    """a, b, probability, predicted: the best matching rule's probability, else the default; 1 above one half."""
    best = matches.join(F.broadcast(probabilities), "rule_id").groupBy("a", "b").agg(F.max("probability").alias("best"))  # a row a rule of the chosen set
    out = pairs.select("a", "b").join(best, ["a", "b"], "left").crossJoin(F.broadcast(default))  # default is one row
    p = F.coalesce("best", "default_probability")
    return out.select("a", "b", p.alias("probability"), F.when(p > 0.5, 1).otherwise(0).alias("predicted"))


def explanations(matches: DataFrame, probabilities: DataFrame) -> DataFrame:
    """a, b, rule_id, probability, rank (dense, by probability) of every rule that matches."""
    from pyspark.sql import Window

    rank = F.dense_rank().over(Window.partitionBy("a", "b").orderBy(F.desc("probability")))
    return matches.join(F.broadcast(probabilities), "rule_id").select("a", "b", "rule_id", "probability", rank.cast("int").alias("rank"))  # a row a rule of the chosen set
