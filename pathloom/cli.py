"""Command line: train, predict, explain, test, evaluate, and reach over a GraphML file and files of pairs."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import labels, networks, paths
from pathloom.plans.engine import Engine, Model, Parameters
from pathloom.sources import graphml
from pathloom.sources.pairs import one_pair, prediction_table, read_pairs, write_delimited, write_predictions
from pathloom.sources.sinks import append_run, explanation_graphs, held_out_table, write_explanation_graphs, write_graph_files
from pathloom.sources.store import StageStore
from pathloom.sources.tables import Graph


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom", description=__doc__)
    p.add_argument("action", choices=["train", "predict", "explain", "test", "evaluate", "reach"])
    p.add_argument("--kg", required=True, help="GraphML file")
    p.add_argument("--model", help="folder of the model")
    p.add_argument("--input", help="file of pairs (predict, reach) or one pair (explain)")
    p.add_argument("--positives", help="file of positive pairs with header first, second, weight; without, they come from the evidence nodes of the graph")
    p.add_argument("--negatives", help="file of negative pairs with header first, second, weight")
    p.add_argument("--id_format", choices=["id", "name"], default="name")
    p.add_argument("--delimiter", default="\t")
    p.add_argument("--output", default=".")
    p.add_argument("--holdout", type=int, default=15, help="positive pairs without a common entity that stay out of training")
    p.add_argument("--minsup_ratio", type=float)
    p.add_argument("--path_cutoff", type=int)
    p.add_argument("--max_rule_length", type=int)
    p.add_argument("--alpha", type=float)
    p.add_argument("--excluded_type", action="append", default=[])
    p.add_argument("--parameters", help="JSON that overrides defaults")
    p.add_argument("--stages", help="folder for adjacency and paths that later runs on the same graph and pairs find again")
    p.add_argument("--folds", type=int, default=10)
    p.add_argument("--overwrite", action="store_true")
    return p


def parameters(args: argparse.Namespace) -> Parameters:
    base = Parameters.from_json(args.parameters) if args.parameters else Parameters()
    given = {k: getattr(args, k) for k in ("minsup_ratio", "path_cutoff", "max_rule_length", "alpha") if getattr(args, k) is not None}
    return replace(base, **given, excluded_types=tuple(dict.fromkeys([*base.excluded_types, *args.excluded_type])))


def samples(spark: SparkSession, graph: Graph, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(training samples, held-out positives).  Files have the columns first, second and weight; all pairs must be known."""
    both = []
    for path in filter(None, (args.positives, args.negatives)):
        pairs, unresolved = read_pairs(spark, graph, path, args.id_format, args.delimiter, ("first", "second"))
        if not unresolved.isEmpty():
            raise SystemExit(f"{path} has pairs that the graph lacks")
        both.append(pairs)
    negatives = labels.max_scaled(both[-1], "weight")
    if args.positives:
        positives = both[0]
        held = labels.recent_distinct(positives.withColumn("ts", F.col("weight")), args.holdout).drop("ts")
    else:
        rest, held = (df.select("a", "b", "weight") for df in labels.graph_positives(labels.evidence_index(graph), n_held_out=args.holdout))
        positives = rest.unionByName(held)
    rows = labels.training_set(positives, negatives, held)
    return rows.filter("part = 'train'").drop("part"), rows.filter("part = 'held-out'").drop("part")


def explained(engine: Engine, model: Model, pairs: DataFrame, out: str, single: bool) -> None:
    """Ranked rules, and the edges of their sub-graphs, as delimited files; the sub-graphs of a single pair also as files of their own."""
    ranked, edges = engine.explain(model, pairs)
    write_delimited(ranked, f"{out}/explanations")
    write = write_graph_files if single else write_explanation_graphs
    write(explanation_graphs(engine.graph, ranked, edges), f"{out}/explanation_graphs")
    write_delimited(edges.join(engine.graph.edges.select("eid", "src", "dst", "label", "score", "target_id"), "eid"), f"{out}/explanation_edges")


def reached(graph: Graph, pairs: DataFrame, out: str) -> None:
    """Pairs joined within one to four hops of each named network, and the types that networks list and the graph lacks."""
    write_delimited(paths.reachability(paths.network_distances(graph, pairs, networks.by_types())), f"{out}/reachability")
    write_delimited(networks.unknown_types(graph), f"{out}/unknown_types")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pathloom").getOrCreate()
    graph = graphml.read(spark, args.kg)
    if args.action == "reach":
        reached(graph, read_pairs(spark, graph, args.input, args.id_format, args.delimiter)[0], args.output)
        return
    engine = Engine(graph, parameters(args), StageStore(spark, args.stages) if args.stages else None)
    if args.action in ("train", "test", "evaluate"):
        train, held = samples(spark, graph, args)
    if args.action == "train":
        model = engine.train(train)
        model.save(args.model, args.overwrite)
        append_run(spark, f"{args.output}/runs", args.model, model.parameters, model.seconds)
        write_delimited(held_out_table(graph, held, args.id_format), f"{args.output}/held_out")
    elif args.action == "evaluate":
        areas, scored = engine.evaluate(train, args.folds)
        write_delimited(areas, f"{args.output}/performance")
        for r in areas.collect():  # a row a fold
            append_run(spark, f"{args.output}/runs", "evaluate", engine.parameters, {k: r[k] for k in ("roc_auc", "pr_auc") if r[k] is not None}, r["fold"])
        write_delimited(scored, f"{args.output}/fold_predictions")
    else:
        model = Model.load(spark, args.model)
        unresolved = None
        if args.action == "predict":
            pairs, unresolved = read_pairs(spark, graph, args.input, args.id_format, args.delimiter)
        elif args.action == "explain":
            pairs, unresolved = one_pair(spark, graph, args.input, args.id_format)
            if not unresolved.isEmpty():
                raise SystemExit(f"{args.input}: the graph lacks one of them")
        else:
            pairs = held
        write_predictions(prediction_table(graph, engine.predict(model, pairs), unresolved), f"{args.output}/predictions")
        if args.action != "predict":
            explained(engine, model, pairs, args.output, args.action == "explain")
    engine.close(shared=not args.stages)


if __name__ == "__main__":
    main()
