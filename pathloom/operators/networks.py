"""Named parts of a gene graph, and which of them a graph can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.graph import typed_subgraph
from pathloom.sources.tables import Graph

# The networks of gene-gene evidence by name, mode, edge labels and node types.
GENE_NETWORKS = [
    ("SEQSIM", "keep", ("seqSimilar",), ("Gene",)),
    ("COEXP", "keep", ("coexpresses",), ("Gene",)),
    ("PPI", "keep", ("physInteracts",), ("Gene",)),
    ("GENE-CENTRIC", "keep", ("coexpresses", "seqSimilar", "physInteracts"), ("Gene",)),
    ("DOMAIN", "keep", ("hasUnit",), ("Gene", "ProteinDomain")),
    ("FAMILY", "keep", ("belongs",), ("Gene", "ProteinFamily")),
    ("COMPLEX", "keep", ("forms",), ("Gene", "ProteinComplex")),
    ("PROCESS", "keep", ("associated", "resembles"), ("Gene", "BiologicalProcess")),
    ("FUNCTION", "keep", ("associated", "resembles"), ("Gene", "MolecularFunction")),
    ("CELLCMP", "keep", ("associated", "resembles"), ("Gene", "CellularComponent")),
    ("PHENO", "keep", ("associated", "resembles"), ("Gene", "Phenotype")),
    ("COMPOSITE", "keep", ("hasUnit", "belongs", "forms", "associated", "resembles"),
     ("Gene", "ProteinDomain", "ProteinFamily", "ProteinComplex", "BiologicalProcess", "MolecularFunction", "CellularComponent", "Phenotype")),
    ("ALL", "drop", ("causes", "involves", "described"), ("OligogenicCombination", "Disease")),
    ("ALL_NOPHENO", "drop", ("causes", "involves", "described"), ("OligogenicCombination", "Disease", "Phenotype")),
]

Network = tuple[str, str, Sequence[str], Sequence[str]]


def by_types(networks: Sequence[Network] = GENE_NETWORKS) -> list[tuple[str, str, tuple[str, ...]]]:
    """The form that classify_networks and network_distances take: labels and node types in one list, as no name is both."""
    return [(name, mode, (*labels, *types)) for name, mode, labels, types in networks]


def named_network(graph: Graph, name: str, networks: Sequence[Network] = GENE_NETWORKS) -> Graph:
    """The part of a graph that a network keeps."""
    mode, labels, types = {n: rest for n, *rest in networks}[name]
    return typed_subgraph(graph, types, labels, mode == "keep")


def unknown_types(graph: Graph, networks: Sequence[Network] = GENE_NETWORKS) -> DataFrame:
    """network, kind ('edge' or 'node'), type: what the networks list and the graph has not; no rows if all is well."""
    listed = [(name, kind, t) for name, _, labels, types in networks for kind, names in (("edge", labels), ("node", types)) for t in names]
    asked = graph.nodes.sparkSession.createDataFrame(listed, "network string, kind string, type string")
    present = graph.edges.select(F.lit("edge").alias("kind"), F.col("label").alias("type")).unionByName(graph.nodes.select(F.lit("node").alias("kind"), "type")).distinct()
    return asked.join(F.broadcast(present), ["kind", "type"], "left_anti").select("network", "kind", "type")  # types of the schema
