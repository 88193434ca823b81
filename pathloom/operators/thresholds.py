"""Score thresholds per metapath of a pattern: fewer paths for little lost support.

Every match has, per item, a histogram of its path scores summed from above: counts[x] = paths with a score of x/100 or
more.  The cost of a threshold vector is ((1 - S/S0) + P/P0) / 2, with S the weight of the matches that keep a path of
each item and P their weighted mean of paths; it is 1 where S falls below the least support.
Candidates are evaluated in Spark: matches become points of the grid of scores, which are summed, and sums travel, not matches.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.sources.store import StageStore

STEPS = 100
#: Items of patterns for which every vector of thresholds is tried: 101 ** 3 vectors at most.
GRID_ITEMS = 3
#: Population, most generations, and the weight range and crossover rate of differential evolution.
POPULATION, GENERATIONS, F_LOW, F_HIGH, CROSSOVER, TOLERANCE = 50, 1000, 0.5, 1.0, 0.7, 0.01


def slot_scores(found: DataFrame) -> DataFrame:
    """pat_id, a, b, slot, score from matching paths (see matching.matching_paths): with a clause, once per qualifying node.

    Scores of items in the clause stand for the node that they go through; those of the others count for every node.
    """
    nodes = found.filter("node is not null").select("rule_id", "a", "b", F.col("node").alias("_q")).distinct()
    tied = found.filter("node is not null").select("rule_id", "a", "b", "slot", "score")
    free = found.filter("node is null").select("rule_id", "a", "b", "slot", "score")
    per_node = free.join(nodes, ["rule_id", "a", "b"], "left").select("rule_id", "a", "b", "slot", "score")
    return tied.unionByName(per_node).withColumnRenamed("rule_id", "pat_id")


def bin_of(score: Column) -> Column:
    """The largest x from 0 to 100 with x/100 <= score."""
    return F.greatest(F.least(F.floor(F.round(score * STEPS, 9)), F.lit(STEPS)), F.lit(0)).cast("int")


def histogram(scores: DataFrame) -> DataFrame:
    """pat_id, a, b, slot, bin, n_at_least for the bins that hold scores."""
    by = scores.groupBy("pat_id", "a", "b", "slot", bin_of(F.col("score")).alias("bin")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("pat_id", "a", "b", "slot").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return by.select("pat_id", "a", "b", "slot", "bin", F.sum("n").over(down).alias("n_at_least"))


def count_arrays(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """pat_id, a, b, weight, counts: per slot the 101 counts; one row per match."""
    by = scores.groupBy("pat_id", "a", "b", "slot", bin_of(F.col("score")).alias("bin")).agg(F.count("*").alias("n"))
    bins = by.groupBy("pat_id", "a", "b", "slot").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))  # 101 at most
    counts = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda x: F.aggregate("bins", F.lit(0).cast("long"), lambda s, e: s + F.when(e["bin"] >= x, e["n"]).otherwise(0)))
    slots = bins.withColumn("counts", counts).groupBy("pat_id", "a", "b").agg(F.sort_array(F.collect_list(F.struct("slot", "counts"))).alias("s"))  # one entry per item
    return slots.select("pat_id", "a", "b", F.transform("s", lambda e: e["counts"]).alias("counts")).join(weights.select("a", "b", "weight"), ["a", "b"])


def n_after(counts: Column, thresholds: Column) -> Column:
    """Paths left of a match at a vector of thresholds (whole hundredths): 0 if any item keeps none."""
    left = F.zip_with(counts, thresholds, lambda c, x: F.get(c, x))
    return F.when(F.exists(left, lambda n: n == 0), F.lit(0).cast("long")).otherwise(F.aggregate(left, F.lit(0).cast("long"), lambda s, n: s + n))


def _better_way(counted: DataFrame, *keys: str) -> DataFrame:
    """Counts n of pairs and turned pairs (a, b, weight, n), the larger of the two for each pair."""
    return counted.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").alias("weight"), F.max("n").alias("n"))


def base_values(matches: DataFrame, turning: bool = False) -> DataFrame:
    """pat_id, s0 (weight) and p0 (weighted mean of paths) without thresholds."""
    n = n_after(F.col("counts"), F.transform("counts", lambda c: F.lit(0)))
    counted = matches.select("pat_id", "a", "b", "weight", n.alias("n"))
    counted = _better_way(counted, "pat_id") if turning else counted
    return counted.groupBy("pat_id").agg(F.sum("weight").alias("s0"), (F.sum(F.col("weight") * F.col("n")) / F.sum("weight")).alias("p0"))


def _cost(sums: DataFrame, base: DataFrame, least: float, *keys: str) -> DataFrame:
    """pat_id, keys, cost from s (weight that survives) and wn (weight times paths)."""
    cost = ((1 - F.try_divide("s", "s0")) + F.try_divide(F.try_divide("wn", "s"), "p0")) / 2
    known = F.when(F.round("s", 9) < round(least, 9), 1.0).otherwise(F.coalesce(cost, F.lit(1.0)))
    return sums.join(base, "pat_id").select("pat_id", *keys, known.alias("cost"))


def costs(matches: DataFrame, candidates: DataFrame, least: float, turning: bool = False) -> DataFrame:
    """pat_id, candidate, cost of candidates (pat_id, candidate, x: array<int>).

    turning: matches hold pairs and turned pairs, of which the one with more paths left counts.
    """
    if not turning:
        return point_costs(grid_points(matches), base_values(matches), candidates, least)
    lists = candidates.groupBy("pat_id").agg(F.collect_list(F.struct("candidate", "x")).alias("asked"))  # some hundreds a pattern, whatever the data
    each = matches.join(lists, "pat_id").select("pat_id", "a", "b", "weight", "counts", F.explode("asked").alias("c")).select("pat_id", "c.candidate", "a", "b", "weight", n_after(F.col("counts"), F.col("c.x")).alias("n"))
    each = _better_way(each, "pat_id", "candidate")
    sums = each.groupBy("pat_id", "candidate").agg(F.sum(F.when(F.col("n") > 0, F.col("weight")).otherwise(0.0)).alias("s"), F.sum(F.col("weight") * F.col("n")).alias("wn"))
    return _cost(sums, base_values(matches, True), least, "candidate")


def point_costs(points: DataFrame, base: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """Costs of candidates from the grid points of the matches and their base values: sums over the points from x on.

    Matches themselves, with all their counts, do not travel: of two items there are 10,201 points a pattern at most.
    """
    lists = candidates.groupBy("pat_id").agg(F.collect_list(F.struct("candidate", "x")).alias("asked"))  # some hundreds a pattern, whatever the data
    above = lambda c: F.forall(F.zip_with("x", c["x"], lambda p, v: p >= v), lambda held: held)
    met = points.join(lists, "pat_id").select("pat_id", F.explode(F.transform(F.filter("asked", above), lambda c: c["candidate"])).alias("candidate"), "s", "wn")
    none = candidates.select("pat_id", "candidate", F.lit(0.0).alias("s"), F.lit(0.0).alias("wn"))  # a vector may leave no point
    sums = met.unionByName(none).groupBy("pat_id", "candidate").agg(F.sum("s").alias("s"), F.sum("wn").alias("wn"))
    return _cost(sums, base, least, "candidate")


def slot_costs(matches: DataFrame, state: DataFrame, least: float) -> DataFrame:
    """pat_id, slot, v, cost of every value v of each free item while the others stay as they are, where the cost changes.

    state: pat_id, x, free (a row a pattern).  A match keeps all of its paths of an item up to the highest score among them,
    so each match adds one row per score that it has, not one per value: with o the paths of the other items, the surviving
    weight at v is that of the matches whose highest score reaches v, and weight times paths is the sum over the scores from
    v on and o times that weight.  Both are sums from above over at most 101 scores.
    """
    each = matches.join(F.broadcast(state), "pat_id").select("pat_id", "weight", "counts", "x", F.explode("free").alias("slot"))
    others = F.filter(F.zip_with("counts", "x", lambda c, v: F.get(c, v)), lambda n, k: k != F.col("slot"))
    each = each.select("pat_id", "slot", "weight", F.get("counts", F.col("slot")).alias("c"), others.alias("others")).filter(~F.exists("others", lambda n: n == 0))
    o = F.aggregate("others", F.lit(0).cast("long"), lambda s, n: s + n)
    after = lambda v: F.coalesce(F.get("c", v + 1), F.lit(0).cast("long"))
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda v: F.struct(v.alias("v"), (F.get("c", v) - after(v)).alias("n"), (after(v) == 0).alias("last"))), lambda s: s["n"] > 0)
    rows = each.select("pat_id", "slot", "weight", o.alias("o"), F.explode(steps).alias("e")).select("pat_id", "slot", "weight", "o", "e.v", "e.n", "e.last")
    last = F.when(F.col("last"), F.col("weight")).otherwise(0.0)
    by = rows.groupBy("pat_id", "slot", "v").agg(F.sum(last).alias("s"), F.sum(F.col("weight") * F.col("n") + last * F.col("o")).alias("wn"))
    of = Window.partitionBy("pat_id", "slot")  # at most 101 rows
    above = of.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    first = F.coalesce(F.lag("v").over(of.orderBy("v")) + 1, F.lit(0))  # costs are the same from here to v, and the first of equal ones counts
    sums = by.select("pat_id", "slot", first.alias("v"), F.sum("s").over(above).alias("s"), F.sum("wn").over(above).alias("wn"))
    return _cost(sums, base_values(matches), least, "slot", "v")


def _slot_candidates(matches: DataFrame, state: list[tuple], least: float, turning: bool) -> DataFrame:
    """pat_id, candidate (slot and value in one number), cost."""
    spark = matches.sparkSession
    if turning:  # the larger of two ways is no sum, so every value of every free item is tried
        asked = [(p, j * (STEPS + 1) + v, [v if k == j else x[k] for k in range(n)]) for p, n, x, free, _ in state for j in free for v in range(STEPS + 1)]
        return costs(matches, spark.createDataFrame(asked, "pat_id int, candidate int, x array<int>"), least, True)
    at = spark.createDataFrame([(p, x, list(free)) for p, _, x, free, _ in state], "pat_id int, x array<int>, free array<int>")
    return slot_costs(matches, at, least).select("pat_id", (F.col("slot") * (STEPS + 1) + F.col("v")).alias("candidate"), "cost")


def greedy(matches: DataFrame, least: float, turning: bool = False) -> DataFrame:
    """pat_id, x, cost: in each round, the best value of the best free item is fixed; the first of equal costs wins."""
    patterns = matches.groupBy("pat_id").agg(F.max(F.size("counts")).alias("n"))
    state = [(r["pat_id"], r["n"], [0] * r["n"], tuple(range(r["n"])), None) for r in patterns.collect()]  # a row a pattern
    spark = matches.sparkSession
    for _ in range(max((s[1] for s in state), default=0)):
        best = _slot_candidates(matches, state, least, turning).groupBy("pat_id").agg(F.min(F.struct(F.round("cost", 12).alias("cost"), "candidate")).alias("m"))
        found = {r["pat_id"]: (r["m"]["cost"], r["m"]["candidate"]) for r in best.collect()}
        after = []
        for p, n, x, free, cost in state:
            if free and p in found and (cost is None or found[p][0] <= cost):
                j, v = divmod(found[p][1], STEPS + 1)
                x = [v if k == j else x[k] for k in range(n)]
                free, cost = tuple(k for k in free if k != j), found[p][0]
            after.append((p, n, x, free, cost))
        state = after
    return spark.createDataFrame([(p, x, c) for p, _, x, _, c in state], "pat_id int, x array<int>, cost double")


def evolve(matches: DataFrame, least: float, seed: int = 0, turning: bool = False, generations: int = GENERATIONS) -> DataFrame:
    """pat_id, x, cost by differential evolution (best/1/bin) over whole hundredths, seeded per pattern.

    All patterns go through a generation together: one Spark job scores all trial vectors of those that have not settled.
    The first vector is all zeros, so no cost exceeds that of no thresholds.  At the end each item's value is polished: while
    it gains, the best value of the best item is taken, all others as they are.
    """
    spark = matches.sparkSession
    store = StageStore(spark)
    kept = lambda df: store.get_or_make("points", lambda: df, run=uuid.uuid4().hex)
    points, base = (None, None) if turning else (kept(grid_points(matches)), kept(base_values(matches)))
    sizes = {r["pat_id"]: r["n"] for r in matches.groupBy("pat_id").agg(F.max(F.size("counts")).alias("n")).collect()}  # a row a pattern
    rngs = {p: np.random.default_rng([seed, p]) for p in sizes}

    def first(p: int) -> np.ndarray:
        out = np.zeros((POPULATION, sizes[p]), int)
        for k in range(1, POPULATION):
            share = rngs[p].dirichlet(np.ones(sizes[p])) * rngs[p].random() * rngs[p].choice([0.25, 0.5, 0.75, 1.0])
            out[k] = np.clip(np.round(share * STEPS), 0, STEPS)
        return out

    def score(vectors: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        asked = [(p, k, [int(v) for v in x]) for p, xs in vectors.items() for k, x in enumerate(xs)]
        out = {p: np.ones(len(xs)) for p, xs in vectors.items()}
        trials = spark.createDataFrame(asked, "pat_id int, candidate int, x array<int>")
        scored = costs(matches, trials, least, True) if turning else point_costs(points, base, trials, least)
        for r in scored.collect():  # POPULATION rows a pattern
            out[r["pat_id"]][r["candidate"]] = r["cost"]
        return out

    if not sizes:
        store.drop_since(0)
        return spark.createDataFrame([], "pat_id int, x array<int>, cost double")
    x = {p: first(p) for p in sizes}
    cost = score(x)
    for _ in range(generations):
        open_ = [p for p in x if cost[p].std() > TOLERANCE * abs(cost[p].mean())]
        if not open_:
            break
        trial = {}
        for p in open_:
            rng, n = rngs[p], sizes[p]
            best = x[p][cost[p].argmin()]
            a, b = (x[p][rng.permutation(POPULATION)] for _ in range(2))
            mutant = np.clip(np.round(best + rng.uniform(F_LOW, F_HIGH) * (a - b)), 0, STEPS).astype(int)
            cross = rng.random((POPULATION, n)) < CROSSOVER
            cross[np.arange(POPULATION), rng.integers(0, n, POPULATION)] = True
            trial[p] = np.where(cross, mutant, x[p])
        for p, c in score(trial).items():
            better = c <= cost[p]
            x[p][better], cost[p][better] = trial[p][better], c[better]
    store.drop_since(0)
    found = {p: ([int(v) for v in x[p][cost[p].argmin()]], float(cost[p].min())) for p in x}
    return spark.createDataFrame([(p, v, c) for p, (v, c) in _polished(matches, found, least, turning).items()], "pat_id int, x array<int>, cost double")


def _polished(matches: DataFrame, found: dict[int, tuple[list[int], float]], least: float, turning: bool) -> dict[int, tuple[list[int], float]]:
    """Vectors (pattern: x, cost) of which no single value could change for the better."""
    open_, done = dict(found), dict(found)
    while open_:
        state = [(p, len(x), x, tuple(range(len(x))), c) for p, (x, c) in open_.items()]
        best = _slot_candidates(matches, state, least, turning).groupBy("pat_id").agg(F.min(F.struct(F.round("cost", 12).alias("cost"), "candidate")).alias("m"))
        gained = {}
        for r in best.collect():  # a row a pattern
            (x, c), (j, v) = open_[r["pat_id"]], divmod(r["m"]["candidate"], STEPS + 1)
            if r["m"]["cost"] < round(c, 12):
                gained[r["pat_id"]] = ([v if k == j else x[k] for k in range(len(x))], r["m"]["cost"])
        done |= gained
        open_ = gained
    return done


def grid_points(matches: DataFrame) -> DataFrame:
    """pat_id, x, s, wn: what matches add to the weight and to weight times paths at x and at every vector below it.

    With the tops of a match (the highest score of each item), its weight counts up to there; its paths of an item count up to
    their own score on that item's axis and up to the tops on the others.  So a match adds a point per score that it has.
    """
    after = lambda c, v: F.coalesce(F.get(c, v + 1), F.lit(0).cast("long"))
    bins = F.transform("counts", lambda c: F.filter(F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda v: F.struct(v.alias("v"), (F.get(c, v) - after(c, v)).alias("n"))), lambda e: e["n"] > 0))
    each = matches.select("pat_id", "weight", bins.alias("bins")).filter(~F.exists("bins", lambda b: F.size(b) == 0))  # without a path of an item it never counts
    each = each.withColumn("top", F.transform("bins", lambda b: F.element_at(b, -1)["v"]))
    moved = lambda j, v: F.transform("top", lambda t, k: F.when(k == j, v).otherwise(t))
    paths = F.flatten(F.transform("bins", lambda b, j: F.transform(b, lambda e: F.struct(moved(j, e["v"]).alias("x"), F.lit(0.0).alias("s"), (F.col("weight") * e["n"]).alias("wn")))))
    whole = F.array(F.struct(F.col("top").alias("x"), F.col("weight").cast("double").alias("s"), F.lit(0.0).alias("wn")))
    points = each.select("pat_id", F.explode(F.concat(whole, paths)).alias("p")).select("pat_id", "p.x", "p.s", "p.wn")
    return points.groupBy("pat_id", "x").agg(F.sum("s").alias("s"), F.sum("wn").alias("wn"))


def grid(matches: DataFrame, least: float) -> DataFrame:
    """pat_id, x, cost: the best of all vectors of thresholds, of equal ones the first; patterns of GRID_ITEMS items at most.

    The points of all matches are summed from above along one axis after another, which leaves at each vector the sums over all
    points above it.  Costs change only at coordinates that points have, so the grid has those alone, 101 an axis at most,
    and a coordinate stands for the values down to the one before it.
    """
    points = grid_points(matches)
    longest = matches.agg(F.coalesce(F.max(F.size("counts")), F.lit(0))).first()[0]
    if longest > GRID_ITEMS:
        raise ValueError(f"the grid has room for {GRID_ITEMS} items, not {longest}")
    cells = points
    for j in range(longest):
        own = F.get("x", j)
        axis = points.filter(F.size("x") > j).groupBy("pat_id").agg(F.sort_array(F.collect_set(own), asc=False).alias("axis"))  # 101 at most
        others = F.transform("x", lambda v, k: F.when(k == j, -1).otherwise(v))
        lines = cells.filter(F.size("x") > j).groupBy("pat_id", others.alias("x")).agg(F.map_from_entries(F.collect_list(F.struct(own, F.struct("s", "wn")))).alias("at"))  # 101 at most
        none = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("wn"))

        def summed(axis: Column, at: Column) -> Column:
            step = lambda done, v: F.concat(done, F.array(F.struct(v.alias("v"), (F.try_element_at(done, F.lit(-1))["s"] + F.coalesce(F.try_element_at(at, v), none)["s"]).alias("s"), (F.try_element_at(done, F.lit(-1))["wn"] + F.coalesce(F.try_element_at(at, v), none)["wn"]).alias("wn"))))
            start = F.array(F.struct(F.lit(None).cast("int").alias("v"), F.lit(0.0).alias("s"), F.lit(0.0).alias("wn")))
            return F.slice(F.aggregate(axis, start, step), 2, STEPS + 1)

        filled = lines.join(axis, "pat_id").select("pat_id", "x", F.explode(summed(F.col("axis"), F.col("at"))).alias("e"))
        filled = filled.select("pat_id", F.transform("x", lambda v, k: F.when(k == j, F.col("e.v")).otherwise(v)).alias("x"), "e.s", "e.wn")
        cells = filled.unionByName(cells.filter(F.size("x") <= j))
    axes = points.select("pat_id", F.posexplode("x").alias("k", "v")).groupBy("pat_id", "k").agg(F.sort_array(F.collect_set("v")).alias("axis"))
    axes = axes.groupBy("pat_id").agg(F.sort_array(F.collect_list(F.struct("k", "axis"))).alias("axes"))  # an entry an item
    below = lambda axis, v: F.coalesce(F.array_max(F.filter(axis, lambda z: z < v)) + 1, F.lit(0))
    low = F.zip_with("x", "axes", lambda v, a: below(a["axis"], v))
    found = _cost(cells, base_values(matches), least, "x").join(axes, "pat_id")
    best = found.groupBy("pat_id").agg(F.min(F.struct(F.round("cost", 12).alias("cost"), low.alias("x"))).alias("m"))
    return best.select("pat_id", "m.x", "m.cost")


def optimise(matches: DataFrame, least: float, strategy: str | None = "DE", turning: bool = False) -> DataFrame | None:
    if not strategy:
        return None
    if strategy == "DE":
        return evolve(matches, least, turning=turning)
    if strategy == "GREEDY":
        return greedy(matches, least, turning)
    if strategy == "GRID":  # exact; the larger of two ways is no sum, and long patterns have too many vectors
        short = F.size("counts") <= GRID_ITEMS
        if turning:
            return evolve(matches, least, turning=True)
        return grid(matches.filter(short), least).unionByName(evolve(matches.filter(~short), least))
    raise ValueError(f"unknown strategy {strategy!r}")


def surviving(matches: DataFrame, chosen: DataFrame) -> DataFrame:
    """pat_id, a, b, n_paths: matches that keep paths of every item.  chosen: a row a pattern."""
    return matches.join(F.broadcast(chosen), "pat_id").select("pat_id", "a", "b", n_after(F.col("counts"), F.col("x")).alias("n_paths")).filter("n_paths > 0")
