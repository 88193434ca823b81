"""GraphML as a data source: byte ranges, folders, odd texts, streams."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.sources import graphml
from pathloom.sources.graphml_source import GraphmlReader, GraphmlSource, dicts_of, maps_of
from pathloom.sources.tables import Graph

ODD = ["", " spaced ", "<a & b>", "\"quoted\" 'both'", "line\r\nbreak\ttab", "\u00e9\U0001f600", "]]>", None]


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(GraphmlSource)


def nodes_of(spark, n=40):
    rows = [(f"n{i}", {"name": ODD[i % len(ODD)], f"extra{i % 3}": "x" * (i % 50)}) for i in range(n)]
    return rows, spark.createDataFrame(rows, "xml_id string, props map<string,string>")


def seen(df):
    return sorted(((r["xml_id"], tuple(sorted((r["props"] or {}).items()))) for r in df.collect()), key=str)


def given(rows):
    return sorted(((i, tuple(sorted((k, v) for k, v in p.items() if v is not None))) for i, p in rows), key=str)


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 64 << 20])
def test_each_element_is_read_once_however_ranges_fall(spark, tmp_path, split):
    rows, df = nodes_of(spark, 12 if split == 1 else 40)
    path = str(tmp_path / "g")
    df.coalesce(1).write.format("graphml").option("element", "node").mode("append").save(path)
    found = spark.read.format("graphml").option("splitBytes", max(split, 20)).load(path) if split == 1 else spark.read.format("graphml").option("splitBytes", split * 9).load(path)
    assert seen(found) == given(rows)
    if split == 64:
        assert found.rdd.getNumPartitions() > 3


def test_equal_to_the_xml_reader(spark, tmp_path):
    path = tmp_path / "kg.graphml"
    body = "".join(f'<node id="n{i}"><data key="l">:Gene</data><data key="m">g{i}</data><data key="r">{i / 4}</data></node>\n' for i in range(30))
    body += "".join(f'<edge id="e{i}" source="n{i}" target="n{(7 * i + 1) % 30}"><data key="b">binds</data><data key="s">0.{i}</data><data key="c">[\'u\', "v"]</data><data key="zz">?</data></edge>' for i in range(30))
    body += '<edge source="n1" target="n9"/>\n<node id="n30"/>'
    keys = '<key id="l" for="node" attr.name="labels"/><key id="m" for="node" attr.name="name"/><key id="r" for="node" attr.name="rvis_exac"/>'
    keys += '<key id="b" for="edge" attr.name="label"/><key id="s" for="all" attr.name="score"/><key id="c" for="edge" attr.name="in"/>'
    path.write_text(f'<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">{body}</graph></graphml>')
    a, b = graphml.read(spark, str(path)), graphml.read(spark, str(path), source="graphml")
    for one, other in ((a.nodes, b.nodes), (a.edges, b.edges)):
        left, right = (sorted((str({**r.asDict(), "props": sorted((r["props"] or {}).items()), "eid": None}) for r in x.collect())) for x in (one, other))
        assert left == right and left


def test_graph_round_trip_and_overwriting(spark, tmp_path):
    nodes = spark.createDataFrame([("A", "Gene", "a & b", "G", 1.5), ("B", "Gene", None, "G", float("nan")), ("X", "Disease", "x", None, 0.0)], "id string, type string, name string, abbrev string, orient_val double")
    edges = spark.createDataFrame([("e1", "A", "B", "binds", 0.1 + 0.2, "B", None), ("e2", "A", "X", "has", 1e-7, None, ["u", "v w"]), ("e3", "X", "B", "has", 0.5, None, [])], "eid string, src string, dst string, label string, score double, target_id string, ctx array<string>")
    path = str(tmp_path / "g")
    for _ in range(2):  # the second time takes the place of the first
        graphml.write(Graph(nodes, edges), path)
        back = graphml.read(spark, path, source="graphml")
        assert sorted(str(tuple(r)) for r in back.nodes.drop("props").collect()) == sorted(str(tuple(r)) for r in nodes.collect())
        want = edges.withColumn("ctx", F.when(F.size("ctx") > 0, F.col("ctx")))
        assert sorted(map(str, back.edges.drop("props").collect())) == sorted(map(str, want.collect()))
    assert not list((tmp_path / "g").glob("_temporary*"))


def test_bounded_files_and_empty_tables(spark, tmp_path):
    rows, df = nodes_of(spark)
    path = str(tmp_path / "g")
    df.coalesce(1).write.format("graphml").option("rowsPerFile", 7).mode("append").save(path)
    assert len(list((tmp_path / "g").glob("nodes-*.graphml"))) == 6
    assert seen(spark.read.format("graphml").load(path)) == given(rows)
    assert spark.read.format("graphml").option("element", "edge").load(path).count() == 0
    empty = str(tmp_path / "e")
    df.filter("false").write.format("graphml").mode("append").save(empty)
    assert spark.read.format("graphml").load(empty).count() == 0
    with pytest.raises(Exception, match="columns of nodes"):
        df.withColumn("more", F.lit(1)).write.format("graphml").mode("append").save(empty)


def test_characters_without_a_form_in_xml(spark, tmp_path):
    df = spark.createDataFrame([("n\x01", {"name\x02": "a\x00b"}), (None, None)], "xml_id string, props map<string,string>")
    df.write.format("graphml").mode("append").save(str(tmp_path / "g"))
    assert seen(spark.read.format("graphml").load(str(tmp_path / "g"))) == sorted([("n\ufffd", (("name\ufffd", "a\ufffdb"),)), (None, ())], key=str)


def test_stream_writes_each_batch_once(spark, tmp_path):
    rows, df = nodes_of(spark)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.format("graphml").option("element", "node").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert len({p.name.split("-")[1] for p in (tmp_path / "out").glob("nodes-batch*")}) == 4
    assert seen(spark.read.format("graphml").load(str(tmp_path / "out"))) == given(rows)


def test_a_scan_for_nodes_does_not_parse_edges(tmp_path):
    path = tmp_path / "edges.graphml"
    path.write_text('<graphml><graph>' + "".join(f'<edge source="a{i}" target="b"/>' for i in range(50)) + "</graph></graphml>")
    with open(path, "rb") as f:
        assert GraphmlReader(str(path), "node", 1 << 20)._first(f, 0, path.stat().st_size) is None
        assert GraphmlReader(str(path), "edge", 1 << 20)._first(f, 0, path.stat().st_size) == 16


def test_maps_go_by_whole_columns():
    rows = [{"a": "1", "b": ""}, {}, {"a": "x"}, {"c": None}]
    column = maps_of(rows)
    assert list(dicts_of(column)) == rows
    assert list(dicts_of(column.slice(1, 2))) == rows[1:3]
    missing = pa.array([None, [("k", "v")]], column.type)
    assert list(dicts_of(missing)) == [{}, {"k": "v"}]
