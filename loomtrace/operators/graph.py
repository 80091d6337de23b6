"""Graph operators over edges(s, p, o).

Fixpoints run as rounds of joins whose state is written to checkpoints, so lineage stays short and a
lost executor costs a round at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import vocabulary as V
from loomtrace.functions.text import is_clause
from loomtrace.operators.state import cut


def subjects(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("s").alias("node")).distinct()


def predicates(edges: DataFrame) -> DataFrame:
    return edges.select("p").distinct()


def objects(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("o").alias("node")).distinct()


def concepts(edges: DataFrame) -> DataFrame:
    return subjects(edges).union(objects(edges)).distinct()


def roots(edges: DataFrame) -> DataFrame:
    return subjects(edges).join(objects(edges), "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return objects(edges).join(subjects(edges), "node", "left_anti")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))


def incoming(edges: DataFrame, node: Column) -> DataFrame:
    return edges.where(F.col("o") == node).select("p", F.col("s").alias("node"))


def outgoing(edges: DataFrame, node: Column) -> DataFrame:
    return edges.where(F.col("s") == node).select("p", F.col("o").alias("node"))


def between(edges: DataFrame, a: Column, b: Column) -> DataFrame:
    return edges.where(((F.col("s") == a) & (F.col("o") == b)) | ((F.col("s") == b) & (F.col("o") == a))).distinct()


def without_leaves(edges: DataFrame, predicate: Callable[[Column], Column] = lambda p: F.lit(True)) -> DataFrame:
    """Edges but those that match and whose object is a leaf reached by a matching edge."""
    gone = leaves(edges).join(edges.where(predicate(F.col("p"))).select(F.col("o").alias("node")).distinct(), "node", "left_semi")
    bad = edges.where(predicate(F.col("p"))).join(gone, F.col("o") == F.col("node"), "left_semi")
    return edges.join(bad.distinct(), ["s", "p", "o"], "left_anti")


def predicate_dictionary(edges: DataFrame, predicate: str, by_length: bool = False) -> DataFrame:
    """(s, values): the objects of one predicate, ascending, or the shortest first."""
    rows = edges.where(F.col("p") == predicate)
    if by_length:
        return rows.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.length("o").alias("n"), "o"))), lambda x: x["o"]).alias("values"))
    return rows.groupBy("s").agg(F.sort_array(F.collect_list("o")).alias("values"))


def edge_dictionary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("p", "o"))).alias("edges"))


def reachable(edges: DataFrame, start: DataFrame, depth: int | None = None, forward: bool = True) -> DataFrame:
    """(node, depth) of all nodes within ``depth`` steps of start(node), itself included; all without a depth."""
    steps = edges.select(F.col("s").alias("node"), F.col("o").alias("to")) if forward else edges.select(F.col("o").alias("node"), F.col("s").alias("to"))
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    front, n = seen, 0
    while depth is None or n < depth:
        n += 1
        found = front.join(steps, "node").select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut(found.withColumn("depth", F.lit(n)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if n % 5 == 0:
            seen = cut(seen)
    return seen


def sub_classes(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    return reachable(edges.where(F.col("p") == V.SUBCLASS), start, depth, forward=False)


def super_classes(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    return reachable(edges.where(F.col("p") == V.SUBCLASS), start, depth)


def rooted(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Edges that can be reached from start(node)."""
    return edges.join(reachable(edges, start).select(F.col("node").alias("s")), "s", "left_semi").select("s", "p", "o").distinct()


def on_paths(edges: DataFrame, source: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges on any path from a source to a target."""
    ahead = reachable(edges, source).select(F.col("node").alias("s"))
    back = reachable(edges, targets, forward=False).select(F.col("node").alias("o"))
    return edges.join(ahead, "s", "left_semi").join(back, "o", "left_semi").select("s", "p", "o").distinct()


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph of pairs(a, b): the smallest node of each component.

    Nodes take the smallest label among their neighbours, and then the label of that label, so a
    round halves the distance to it; rounds stop when no label changes.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    both = cut(both)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        own = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        jump = own.select(F.col("node").alias("at"), F.col("component").alias("further"))
        after = cut(own.join(jump, own["component"] == jump["at"]).select("node", F.col("further").alias("component"), "old"))
        moved = not after.where("component <> old").isEmpty()
        labels = after.select("node", "component")
        if not moved:
            return labels


def component_edges(edges: DataFrame) -> DataFrame:
    """Edges with their component and its number of edges."""
    found = connected_components(edges.select(F.col("s").alias("a"), F.col("o").alias("b")))
    sized = edges.join(found, edges["s"] == found["node"]).select("s", "p", "o", "component")
    return sized.join(sized.groupBy("component").agg(F.count("*").alias("size")), "component")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other share the smallest of them.

    Nodes without way in or out are trimmed first. Then every open node gets the smallest node that
    reaches it; those that also reach their label back are that label's component, and the rest go on.
    """
    steps = cut(edges.select("s", "o").where("s <> o").distinct())
    nodes = cut(edges.select(F.col("s").alias("node")).union(edges.select("o")).distinct())
    done = nodes.limit(0).withColumn("component", F.col("node"))
    while not nodes.isEmpty():
        inner = cut(steps.join(nodes.select(F.col("node").alias("s")), "s", "left_semi").join(nodes.select(F.col("node").alias("o")), "o", "left_semi"))
        core = inner.select("s").intersect(inner.select("o")).select(F.col("s").alias("node"))
        loose = cut(nodes.join(core, "node", "left_anti"))
        if not loose.isEmpty():
            done = done.unionByName(loose.withColumn("component", F.col("node")))
            nodes = cut(nodes.join(loose, "node", "left_anti"))
            continue
        label = _spread(inner, nodes.withColumn("label", F.col("node")))
        # Within one label, walk back from the label itself.
        same = inner.join(label.select(F.col("node").alias("s"), F.col("label").alias("x")), "s").join(label.select(F.col("node").alias("o"), F.col("label").alias("y")), "o").where("x = y").select("s", "o")
        back = reachable(same.withColumn("p", F.lit("")), label.where("node = label").select("node"), forward=False)
        found = cut(back.join(label, "node").select("node", F.col("label").alias("component")))
        done = done.unionByName(found)
        nodes = cut(nodes.join(found, "node", "left_anti"))
    return done


def _spread(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """The smallest label that reaches each node along the steps."""
    labels = cut(labels)
    while True:
        came = steps.join(labels.select(F.col("node").alias("s"), F.col("label").alias("l")), "s").groupBy("o").agg(F.min("l").alias("l"))
        after = cut(labels.join(came, labels["node"] == came["o"], "left").select("node", F.least("label", "l").alias("label"), F.col("label").alias("old")))
        moved = not after.where("label <> old").isEmpty()
        labels = after.select("node", "label")
        if not moved:
            return labels


def betweenness(edges: DataFrame, most_edges: int = 2_000_000) -> DataFrame:
    """(node, score): Brandes' betweenness, normalised, of a directed graph.

    Sources are dealt to tasks, each of which holds the graph; a graph above ``most_edges`` is refused.
    """
    pairs = edges.select("s", "o").where("s <> o").distinct()
    if pairs.count() > most_edges:
        raise ValueError("the graph is too large to be sent to every task")
    found: dict = {}
    for r in pairs.orderBy("s", "o").toLocalIterator():
        found.setdefault(r.s, []).append(r.o)
    shared = edges.sparkSession.sparkContext.broadcast(found)
    nodes = concepts(edges)
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    kind = nodes.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        total: dict = {}
        for batch in batches:
            for source in batch["node"]:
                depth, ways, parents, order = {source: 0}, {source: 1.0}, {}, [source]
                for at in order:
                    for to in graph.get(at, ()):
                        if to not in depth:
                            depth[to] = depth[at] + 1
                            ways[to] = 0.0
                            order.append(to)
                        if depth[to] == depth[at] + 1:
                            ways[to] += ways[at]
                            parents.setdefault(to, []).append(at)
                share = dict.fromkeys(order, 0.0)
                for at in reversed(order):
                    for up in parents.get(at, ()):
                        share[up] += ways[up] / ways[at] * (1 + share[at])
                    if at != source:
                        total[at] = total.get(at, 0.0) + share[at]
        yield pd.DataFrame({"node": list(total), "part": list(total.values())})

    sums = nodes.repartition("node").mapInPandas(run, f"node {kind}, part double").groupBy("node").agg(F.sum("part").alias("part"))
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) * scale).alias("score"))


def equivalents(edges: DataFrame, same: str = V.SAME) -> DataFrame:
    """(node, component) over edges of equivalence."""
    return connected_components(edges.where(F.col("p") == same).select(F.col("s").alias("a"), F.col("o").alias("b")))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """Edges out of the nodes that start(node) reaches without clauses and subclass edges."""
    plain = edges.where(~is_clause(F.col("p")) & (F.col("p") != V.SUBCLASS))
    near = reachable(plain, start, depth).select(F.col("node").alias("s"))
    return edges.join(near, "s", "left_semi").select("s", "p", "o")


def aspect_graph(edges: DataFrame, start: DataFrame, depth: int | None = None, incoming_too: bool = False) -> DataFrame:
    """Edges out of a concept, its equivalents, sub- and superclasses; the edges into them, too, if asked for."""
    classes = equivalents(edges)
    mates = start.join(classes, "node").select("component").join(classes, "component").select("node")
    base = start.select("node").union(mates).distinct()
    family = base.union(sub_classes(edges, base, depth).select("node")).union(super_classes(edges, base, depth).select("node")).distinct()
    out = edges.join(family.select(F.col("node").alias("s")), "s", "left_semi").select("s", "p", "o")
    if incoming_too:
        out = out.union(edges.join(family.select(F.col("node").alias("o")), "o", "left_semi").select("s", "p", "o"))
    return out.distinct()


def taxonomical_view(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """Subclass edges around a concept and one label, the shortest, for each node in them."""
    near = super_classes(edges, start, depth).select("node").union(sub_classes(edges, start, depth).select("node")).distinct()
    tax = edges.where(F.col("p") == V.SUBCLASS)
    view = tax.join(near.select(F.col("node").alias("s")), "s", "left_semi").select("s", "p", "o").union(tax.join(near.select(F.col("node").alias("o")), "o", "left_semi").select("s", "p", "o")).distinct()
    labels = edges.where(F.col("p") == V.LABEL).join(concepts(view).select(F.col("node").alias("s")), "s", "left_semi")
    one = labels.groupBy("s", "p").agg(F.min_by("o", F.struct(F.length("o"), "o")).alias("o"))
    return view.unionByName(one.select("s", "p", "o"))


def graphml(edges: DataFrame, path: str, most: int = 100_000, width: int = 128) -> int:
    """Write a bounded graph as GraphML; the number of edges written."""
    rows = edges.select("s", "p", "o").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges")
    from xml.sax.saxutils import escape, quoteattr

    names: Sequence[str] = sorted({str(x) for r in rows for x in (r.s, r.o)})
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        f.write('<key id="label" for="all" attr.name="label" attr.type="string"/>\n<graph edgedefault="directed">\n')
        for n in names:
            f.write(f"<node id={quoteattr(n)}><data key=\"label\">{escape(n[:width])}</data></node>\n")
        for r in rows:
            f.write(f"<edge source={quoteattr(str(r.s))} target={quoteattr(str(r.o))}><data key=\"label\">{escape(str(r.p)[:width])}</data></edge>\n")
        f.write("</graph>\n</graphml>\n")
    return len(rows)
