"""Greedy cover against a plain one, and that no path runs through the evidence of its own label."""

import random

import pytest

from pathloom import cli
from pathloom.operators import cover, labels
from pathloom.plans.engine import Engine, Parameters
from pathloom.sources.store import StageStore
from pathloom.sources.tables import Graph


@pytest.mark.parametrize("alpha,most", [(0.5, None), (0.8, None), (0.5, 4)])
def test_cover_against_plain(spark, alpha, most):
    rng = random.Random(12)
    pairs = [(f"a{i}", f"b{i}", int(i % 3 == 0), rng.choice([0.25, 0.5, 1.0])) for i in range(300)]
    matched = {r: {i for i in range(300) if rng.random() < (0.12 if pairs[i][2] else 0.02) * (1 + r % 3)} for r in range(1, 31)}
    rows = [(r, *pairs[i]) for r, m in matched.items() for i in m]
    c = spark.createDataFrame(rows, "rule_id int, a string, b string, label int, weight double").repartition(4)
    t = {"wp": sum(p[3] for p in pairs if p[2]), "wn": sum(p[3] for p in pairs if not p[2])}
    share = lambda ids, y, total: sum(pairs[i][3] for i in ids if pairs[i][2] == y) / total
    confidence = {r: share(m, 1, 1) / (share(m, 1, 1) + share(m, 0, 1)) if m else 0 for r, m in matched.items()}
    want, covered = [], set()
    while most is None or len(want) < most:
        left = [r for r in matched if r not in [x for x, _ in want] and matched[r]]
        change = {r: round((1 - alpha) * share(matched[r] - covered, 0, t["wn"]) - alpha * share(matched[r] - covered, 1, t["wp"]) + (0 if want else alpha - 1), 12) for r in left}
        best = min(left, key=lambda r: (change[r], -confidence[r], -r))
        if change[best] >= 0:
            break
        want.append((best, change[best]))
        covered |= matched[best]
    store = StageStore(spark)
    got = cover.set_cover(c, t, alpha, most, store)
    assert [r for r, _ in got] == [r for r, _ in want] and len(want) >= 4
    assert [m for _, m in got] == pytest.approx([m for _, m in want], abs=1e-11)
    assert cover.set_cover(c.limit(0), t, alpha, most, store) == []
    assert not store.made  # the search leaves no tables


@pytest.fixture(scope="module")
def evidence_graph(spark):
    """Genes in pairs with an evidence node each, some with a disease, and hubs of a third type between the pairs' genes."""
    nodes = [(f"g{i}", "Gene", f"g{i}", "G", float(i), {}) for i in range(16)] + [("d1", "Disease", "d1", "D", 0.0, {}), ("p1", "Process", "p1", "P", 0.0, {})]
    edges = [(f"p{i}", f"g{i}", "p1", "associated", 0.5, None, None) for i in range(16)]
    for k in range(6):
        a, b, o = f"g{2 * k}", f"g{2 * k + 1}", f"o{k}"
        nodes.append((o, "OligogenicCombination", o, "O", 0.0, {"FAMmanual": "3", "timestamp": str(k)}))
        edges += [(f"b{k}", a, b, "binds", 0.5, None, None), (f"{o}a", o, a, "involves", 1.0, None, None), (f"{o}b", o, b, "involves", 1.0, None, None), (f"{o}d", o, "d1", "causes", 1.0, None, None), (f"da{k}", "d1", a, "links", 1.0, None, None)]
    schema = "id string, type string, name string, abbrev string, orient_val double, props map<string,string>"
    return Graph(spark.createDataFrame(nodes, schema), spark.createDataFrame(edges, "eid string, src string, dst string, label string, score double, target_id string, ctx array<string>"))


def test_no_path_runs_through_its_label(spark, evidence_graph):
    rest, held = labels.graph_positives(labels.evidence_index(evidence_graph), n_held_out=2)
    pairs = rest.unionByName(held)
    assert pairs.count() == 6
    for p in (Parameters(), Parameters(path_cutoff=4, excluded_types=("Phenotype",)), Parameters.from_json('{"path_cutoff": 2}')):
        found = Engine(evidence_graph, p).paths(pairs).collect()
        assert found and not {n for r in found for n in r["mp"]["nodes"]} & set(labels.EVIDENCE_TYPES)
    through = Engine(evidence_graph, Parameters(evidence_types=())).paths(pairs).collect()  # only on request
    assert {n for r in through for n in r["mp"]["nodes"]} >= set(labels.EVIDENCE_TYPES)


def test_command_line_excludes_evidence(spark, evidence_graph, tmp_path):
    """A whole training run whose positives come from the graph: no rule knows the evidence nodes."""
    from pathloom.plans.engine import Model
    from pathloom.sources import graphml

    path = tmp_path / "kg.graphml"
    xml = graphml.to_xml([r.asDict() for r in evidence_graph.nodes.collect()], [r.asDict() for r in evidence_graph.edges.drop("ctx").collect()])
    xml = xml.replace("<graph ", '<key id="n_FAM" for="node" attr.name="FAMmanual" attr.type="int"/><key id="n_ts" for="node" attr.name="timestamp" attr.type="int"/><graph ', 1)
    for k in range(6):
        xml = xml.replace(f'<node id="o{k}">', f'<node id="o{k}"><data key="n_FAM">3</data><data key="n_ts">{k}</data>')
    path.write_text(xml)
    (tmp_path / "n.tsv").write_text("first\tsecond\tweight\ng1\tg4\t0.5\ng3\tg8\t0.7\n")
    base = ["--kg", str(path), "--negatives", str(tmp_path / "n.tsv"), "--id_format", "id", "--holdout", "1", "--parameters", '{"optimise_thresholds": null, "max_rule_length": 2, "path_cutoff": 2}']
    args = cli.parser().parse_args(["train", *base])
    assert set(labels.EVIDENCE_TYPES) <= set(cli.parameters(args).blocked_types)
    graph = graphml.read(spark, str(path))
    train, held = cli.samples(spark, graph, args)
    assert train.filter("label = 1").count() + held.count() == 6 and held.count() == 1
    train = spark.createDataFrame(train.collect(), train.schema)
    Engine(graph, cli.parameters(args)).train(train).save(str(tmp_path / "model"))
    rules = Model.load(spark, str(tmp_path / "model")).rules.collect()
    assert rules and not {n for r in rules for mp in r["mps"] for n in mp["nodes"]} & set(labels.EVIDENCE_TYPES)
