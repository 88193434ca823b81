"""Column expressions of the graph engine; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column

#: Added to every edge score, so that a score of zero leaves some of a path's score.
TINY = 1e-7


def first_of_pair(id1: Column, value1: Column, id2: Column, value2: Column) -> Column:
    """Whether 1 goes first: by rising value, ties by id; a value that is missing or NaN compares as equal."""
    known = ~(F.isnan(value1) | F.isnan(value2))
    less, more = F.coalesce(known & (value1 < value2), F.lit(False)), F.coalesce(known & (value1 > value2), F.lit(False))
    return F.when(less, True).when(more, False).otherwise(id1 <= id2)


def type_of(labels: Column) -> Column:
    """The type in a label string such as ':Gene'."""
    return F.element_at(F.split(labels, ":"), 2)


def evidence_level(fam: Column, stat_meta: Column, stat_manual: Column) -> Column:
    """0 to 3; levels 2 and 3 share the bound on stat_meta, so whoever reaches it is at 3."""
    strong = (fam >= 3) | (stat_meta >= 2)
    moderate = (fam >= 2) | (stat_meta >= 2)
    weak = (fam >= 1) | ((stat_meta >= 1) & (stat_manual >= 1))
    return F.when(strong, 3).when(moderate, 2).when(weak, 1).otherwise(0)


def step_direction(target: Column, reached: Column) -> Column:
    """0 along an undirected edge, 1 towards its target, else -1."""
    return F.when(target.isNull(), 0).when(target == reached, 1).otherwise(-1)


def shared_context(x: Column, y: Column) -> Column:
    """Intersection of two context sets, where null stands for any context."""
    return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.array_intersect(x, y))


def consistent(ctx: Column) -> Column:
    return ctx.isNull() | (F.size(ctx) > 0)


def log_score(score: Column) -> Column:
    return F.ln(score + TINY)


def reversed_metapath(mp: Column, compat: bool = False) -> Column:
    """The same path walked from its end.  compat negates the directions without reversing them."""
    dirs = F.transform(mp["dirs"], lambda d: -d)
    return F.struct(F.reverse(mp["edges"]).alias("edges"), F.reverse(mp["nodes"]).alias("nodes"), (dirs if compat else F.reverse(dirs)).alias("dirs"))


def metapath_key(mp: Column) -> Column:
    """One string for a metapath: types and edges in turn, with < or > at directed edges."""
    steps = F.transform(
        F.sequence(F.lit(1), F.size(mp["edges"])),
        lambda i: F.concat(
            F.when(F.element_at(mp["dirs"], i) == -1, "<").otherwise("-"), F.element_at(mp["edges"], i), F.when(F.element_at(mp["dirs"], i) == 1, ">").otherwise("-"), F.element_at(mp["nodes"], i + 1)
        ),
    )
    return F.concat(F.element_at(mp["nodes"], 1), F.array_join(steps, ""))


def _bare(node: Column) -> Column:
    """The type in a node such as Gene#1."""
    return F.element_at(F.split(node, "#"), 1)


def _spelled(names: Column, node: Column) -> Column:
    """The abbreviation of a node's type; what stands behind a # follows an underscore."""
    variable = F.try_element_at(F.split(node, "#"), F.lit(2))
    return F.concat(F.coalesce(F.element_at(names, _bare(node)), _bare(node)), F.when(variable.isNull() | (variable == ""), F.lit("")).otherwise(F.concat(F.lit("_"), variable)))


def _arrows(same: Column, direction: Column, edge: Column) -> Column:
    """edge with < or > where it is directed and joins two nodes of one type."""
    return F.concat(F.when(same & (direction == -1), "<").otherwise(""), edge, F.when(same & (direction == 1), ">").otherwise(""))


def abbreviated_metapath(mp: Column, node_names: Column, edge_names: Column) -> Column:
    """Abbreviations in a row; < and > only where a directed edge joins two nodes of one type.  Names are maps."""

    def step(i: Column) -> Column:
        left, right, edge = F.element_at(mp["nodes"], i), F.element_at(mp["nodes"], i + 1), F.element_at(mp["edges"], i)
        return F.concat(_arrows(_bare(left) == _bare(right), F.element_at(mp["dirs"], i), F.coalesce(F.element_at(edge_names, edge), edge)), _spelled(node_names, right))

    return F.concat(_spelled(node_names, F.element_at(mp["nodes"], 1)), F.array_join(F.transform(F.sequence(F.lit(1), F.size(mp["edges"])), step), ""))


def abbreviated_metaedge(first: Column, edge: Column, second: Column, direction: Column, node_names: Column, edge_names: Column) -> Column:
    short = lambda names, key: F.coalesce(F.element_at(names, key), key)
    return F.concat(short(node_names, first), _arrows(first == second, direction, short(edge_names, edge)), short(node_names, second))


def pretty_metaedge(first: Column, edge: Column, second: Column, direction: Column) -> Column:
    """Whole names, with -- between them."""
    return F.concat_ws("--", first, _arrows(first == second, direction, edge), second)


def jaccard(x: Column, y: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def ratio(x: Column, y: Column) -> Column:
    """x / y, 0 where y is 0."""
    return F.coalesce(F.try_divide(x, y), F.lit(0.0))
