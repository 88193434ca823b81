"""Training, prediction, explanation and evaluation as compositions of the operators.

All tables stay in Spark; what comes to the driver is one row per step of a search (a support, the next rule, a batch of
threshold vectors).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import cover, evaluation, labels, matching, mining, paths, thresholds
from pathloom.operators.graph import adjacency
from pathloom.plans.tuning import tuned
from pathloom.sources.store import StageStore, fingerprint
from pathloom.sources.tables import Graph


@dataclass(frozen=True)
class Parameters:
    path_cutoff: int = 3
    minsup_ratio: float = 0.2
    max_rule_length: int = 3
    alpha: float = 0.5
    excluded_types: tuple[str, ...] = ()
    evidence_types: tuple[str, ...] = labels.EVIDENCE_TYPES  # excluded beside those: paths through them are the labels themselves
    compute_unifications: bool = True
    optimise_thresholds: str | None = "DE"
    max_fpr: float = 1.0
    closed_mode: str = "compat"
    use_context: bool = True
    orient_pairs: bool = True  # False: a pattern may hold a pair as walked from either end
    reversal: str = "strict"  # how metapaths are reversed: strict or compat

    @property
    def blocked_types(self) -> tuple[str, ...]:
        """Types of nodes that no path passes."""
        return tuple(dict.fromkeys([*self.excluded_types, *self.evidence_types]))

    @classmethod
    def from_json(cls, text: str) -> Parameters:
        """Defaults with the given ones over them."""
        given = json.loads(text)
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


@dataclass
class Model:
    """rules: rule_id, items, clause, thr, mps (the metapaths themselves), probability; default: of pairs that no rule matches."""

    rules: DataFrame
    default: float
    parameters: Parameters
    seconds: dict[str, float] = field(default_factory=dict)

    def save(self, path: str, overwrite: bool = False) -> None:
        """Parquet tables under path; an existing model stays unless overwrite is set."""
        mode = "overwrite" if overwrite else "errorifexists"
        self.rules.write.mode(mode).parquet(f"{path}/rules")
        meta = json.dumps({"default": self.default, "parameters": asdict(self.parameters), "seconds": self.seconds})
        self.rules.sparkSession.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode(mode).text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        p = {k: tuple(v) if isinstance(v, list) else v for k, v in meta["parameters"].items()}
        return cls(spark.read.parquet(f"{path}/rules"), meta["default"], Parameters(**p), meta["seconds"])


class Engine:
    """Steps over one graph.  The adjacency and the paths of a table of pairs are known by what they are made from: a hash of the
    graph's rows and of the pairs, and the parameters that paths depend on.  So engines that share a store, such as those of
    a parameter study, walk each table of pairs once, and a changed edge walks it anew.  All other stages are an engine's own.
    matcher: what decides which pairs a rule holds; candidates and thresholds are found by metapaths in any case.
    """

    def __init__(self, graph: Graph, parameters: Parameters | None = None, store: StageStore | None = None, matcher: matching.Matcher | None = None):
        self.graph, self.parameters, self.matcher = graph, parameters or Parameters(), matcher or matching.MetapathMatcher()
        self.store = store or StageStore(tuned(graph.nodes.sparkSession))
        #: No two engines have the same, so none reads the own stages of another, nor two steps those of each other.
        self._key, self._stage, self._adjacency, self._content = uuid.uuid4().hex, 0, None, None
        self._own: list[str] = []
        self._shared: list[str] = []

    def _noted(self, paths: list[str], name: str, make: Callable[[], DataFrame], **made_from: object) -> DataFrame:
        mark = len(self.store.made)
        out = self.store.get_or_make(name, make, **made_from)
        paths += self.store.made[mark:]
        return out

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        """df as a written table: later steps start from it, and a lost executor costs no more than its tasks."""
        self._stage += 1
        return self._noted(self._own, name, lambda: df, engine=self._key, step=self._stage)

    def close(self, shared: bool = False) -> None:
        """Deletes the stages of this engine, models that were not saved among them; shared: adjacency and paths that it wrote, too."""
        own = dict.fromkeys([*self._own, *(self._shared if shared else [])])
        self.store.drop([p for p in own if p in self.store.made])
        self._own, self._adjacency = [], None
        self._shared = [] if shared else self._shared

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def content(self) -> dict[str, str]:
        if self._content is None:
            self._content = {"nodes": fingerprint(self.graph.nodes.select("id", "type")), "edges": fingerprint(self.graph.edges.select("src", "dst", "label", "score", "target_id", "ctx"))}
        return self._content

    def adjacency(self) -> DataFrame:
        if self._adjacency is None:
            self._adjacency = self._noted(self._shared, "adjacency", lambda: adjacency(self.graph), **self.content())
        return self._adjacency

    def paths(self, pairs: DataFrame) -> DataFrame:
        """a, b, mp, mids, score; without orientation, each path also as walked from its end, with a and b in turn."""
        p, ends = self.parameters, pairs.select("a", "b").distinct()
        walk = lambda: paths.enumerate_paths(self.graph, ends, p.path_cutoff, p.blocked_types, p.use_context, self.adjacency())
        found = self._noted(self._shared, "paths", walk, pairs=fingerprint(ends), cutoff=p.path_cutoff, blocked=sorted(p.blocked_types), context=p.use_context, **self.content())
        return found if p.orient_pairs else mining.both_ways(found, p.reversal == "compat")

    def _both(self, pairs: DataFrame) -> DataFrame:
        return pairs if self.parameters.orient_pairs else mining.turned(pairs)

    def _folded(self, matches: DataFrame, pairs: DataFrame) -> DataFrame:
        return matches if self.parameters.orient_pairs else matching.folded(matches, pairs)

    def mine(self, found: DataFrame, positives: DataFrame) -> DataFrame:
        """pat_id, items, clause, thr: candidate patterns of positive pairs (a, b, weight); found: their paths with mp_id."""
        p, turning = self.parameters, not self.parameters.orient_pairs
        least, weighed = mining.least_support(positives, p.minsup_ratio), self._both(positives.select("a", "b", "weight"))
        levels = mining.apriori(mining.items_of(found, weighed), least, p.max_rule_length, turning, lambda df: self._kept("candidates", df))
        occurrences = self._kept("sets", mining.mined(levels))
        if p.compute_unifications:
            shared = self._kept("unifications", mining.unifications(occurrences, mining.path_nodes(found)))
            occurrences = self._kept("unified", mining.with_unifications(occurrences, shared, least, turning))
        else:
            occurrences = occurrences.withColumn("clause", F.array().cast(mining.CLAUSE))
        patterns = mining.closed(mining.pattern_table(occurrences, turning), p.closed_mode == "strict")
        patterns = self._kept("patterns", mining.with_ids(patterns).withColumn("thr", F.lit(None).cast("array<double>")))
        if not p.optimise_thresholds:
            return patterns
        rules = patterns.select(F.col("pat_id").alias("rule_id"), "items", "clause", "thr")
        shown = matching.matching_paths(rules, found.join(weighed.select("a", "b"), ["a", "b"], "left_semi"))
        counts = self._kept("counts", thresholds.count_arrays(thresholds.slot_scores(shown), weighed))
        chosen = thresholds.optimise(counts, least, p.optimise_thresholds, turning) if not patterns.isEmpty() else None
        if chosen is None:
            return patterns
        found_thr = chosen.select("pat_id", F.transform("x", lambda v: v / 100.0).alias("thr"))
        return self._kept("thresholds", patterns.drop("thr").join(found_thr, "pat_id", "left"))

    def train(self, samples: DataFrame, walked: DataFrame | None = None) -> Model:
        """samples: a, b, label, weight; walked: their paths, if they are at hand."""
        p, took, clock = self.parameters, {}, time.perf_counter()
        walked = self.paths(samples) if walked is None else walked
        found, dictionary = paths.intern(walked)
        positives, negatives = samples.filter("label = 1"), samples.filter("label = 0")
        patterns = self.mine(found, positives)
        took["mining"], clock = time.perf_counter() - clock, time.perf_counter()
        rules = patterns.select(F.col("pat_id").alias("rule_id"), "items", "clause", "thr")
        matches = self._kept("matches", self._folded(self.matcher.match(rules, found), samples))
        kept = self._kept("rules", matching.low_fpr(rules, matches.join(negatives.select("a", "b"), ["a", "b"], "left_semi"), negatives, p.max_fpr))
        coverage = self._kept("coverage", matches.join(kept.select("rule_id"), "rule_id", "left_semi").join(samples.select("a", "b", "label", "weight"), ["a", "b"]))
        t = cover.totals(samples)
        if not t["nn"]:
            raise ValueError("training needs at least one negative pair")
        ids = [r for r, _ in cover.set_cover(coverage, t, p.alpha)]
        mine = coverage.filter(F.col("rule_id").isin(ids)) if ids else coverage.limit(0)
        probability = cover.rule_probabilities(mine, t)
        default = cover.default_probability(samples, mine, t["np"] / t["nn"]).first()[0]
        mps = F.array_sort(F.collect_list(F.struct("slot", "mp")))
        spelled = kept.select("rule_id", F.posexplode("items").alias("slot", "mp_id")).join(F.broadcast(dictionary), "mp_id").groupBy("rule_id").agg(F.transform(mps, lambda e: e["mp"]).alias("mps"))  # metapaths of the schema
        rules = self._kept("model", kept.join(probability, "rule_id").join(spelled, "rule_id").select("rule_id", "items", "clause", "thr", "mps", "probability"))
        took["training"] = time.perf_counter() - clock
        return Model(rules, float(default), p, took)

    def _matches(self, model: Model, pairs: DataFrame, walked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(matches, paths with the model's mp_id) of new pairs; walked: their paths, if they are at hand."""
        walked = self.paths(pairs) if walked is None else walked
        known = model.rules.select(F.explode(F.arrays_zip("items", "mps")).alias("e")).select(F.col("e.items").alias("mp_id"), F.col("e.mps").alias("mp")).distinct()
        found = self._kept("new-paths", walked.join(F.broadcast(known), "mp").select("a", "b", "mp_id", "mids", "score"))  # metapaths of the schema
        return self._kept("new-matches", self._folded(self.matcher.match(model.rules, found), pairs)), found

    def _default(self, model: Model) -> DataFrame:
        return model.rules.sparkSession.createDataFrame([(model.default,)], "default_probability double")

    def predict(self, model: Model, pairs: DataFrame, walked: DataFrame | None = None) -> DataFrame:
        return cover.predict(pairs, self._matches(model, pairs, walked)[0], model.rules.select("rule_id", "probability"), self._default(model))

    def explain(self, model: Model, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(a, b, rule_id, probability, rank, n_paths, n_nodes; the edges rule_id, a, b, eid of each explanation)."""
        matches, found = self._matches(model, pairs)
        shown = self.matcher.matching_paths(model.rules, found)
        ranked = cover.explanations(matches, model.rules.select("rule_id", "probability"))
        known = model.rules.select(F.explode(F.arrays_zip("items", "mps")).alias("e")).select(F.col("e.items").alias("mp_id"), F.col("e.mps").alias("mp")).distinct()
        sizes, edges = matching.subgraph_sizes(shown), matching.explanation_edges(self.graph, shown, known)
        if not self.parameters.orient_pairs:  # of both ways of a pair, the one with more paths counts
            sizes = matching.folded(sizes, pairs, "n_paths", "n_nodes").groupBy("rule_id", "a", "b").agg(F.max(F.struct("n_paths", "n_nodes")).alias("m")).select("rule_id", "a", "b", "m.n_paths", "m.n_nodes")
            edges = matching.folded(edges, pairs, "eid")
        return ranked.join(sizes, ["rule_id", "a", "b"]), edges

    def evaluate(self, samples: DataFrame, n_folds: int = 10, seed: int = 42, chosen: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """(per fold: fold, roc_auc, pr_auc; predictions: fold, a, b, label, weight, probability).

        Paths are walked once, for all samples; each fold takes those of its own pairs.
        """
        dealt = self._kept("folds", labels.folds(samples, n_folds, seed))
        walked, scored = self.paths(dealt), None
        of = lambda pairs: walked.join(self._both(pairs.select("a", "b")), ["a", "b"], "left_semi")
        for k in chosen if chosen is not None else range(n_folds):
            rest, test = dealt.filter(F.col("fold") != k), dealt.filter(F.col("fold") == k)
            model = self.train(rest, of(rest))
            found = self.predict(model, test, of(test)).join(test.select("a", "b", "label", "weight", "fold"), ["a", "b"])
            scored = found if scored is None else scored.unionByName(found)
        scored = self._kept("scored", scored.withColumn("score", F.col("probability")))
        return evaluation.roc_auc(scored, "fold").join(evaluation.pr_auc(scored, "fold"), "fold"), scored.drop("score", "predicted")
