"""The graph as HTML: one page on the nodes with the most edges, or a folder of pages on all of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import graph

PAGE = """<!doctype html><meta charset="utf-8"><title>Symbols</title>
<style>body{font:14px sans-serif;margin:2em}li{margin:.2em 0}.kind{color:#777}</style>
<h1>Symbols</h1><input id="q" placeholder="name"><ul id="list"></ul>
<script>
const data = __DATA__, list = document.getElementById("list"), box = document.getElementById("q");
function show() {
  list.replaceChildren(...data.nodes.filter(n => (n.label + " " + n.id).toLowerCase().includes(box.value.toLowerCase())).map(n => {
    const li = document.createElement("li"), out = data.edges.filter(e => e.from_qualname === n.id).map(e => e.label + " " + e.to_qualname);
    li.title = n.title || ""; li.textContent = n.id + " (" + n.node_group + ") " + out.join(", "); return li;
  }));
}
box.oninput = show; show();
</script>
"""


def top_nodes(symbols: DataFrame, edges: DataFrame, limit: int = 1000) -> DataFrame:
    """The nodes with the most outgoing edges, ties by id, and the external nodes behind them."""
    inner = graph.graph_nodes(symbols, edges).select("id", "label", "node_group", "title", "outgoing")
    outer = graph.graph_externals(symbols, edges).select("id", "label", F.lit("external").alias("node_group"), F.lit("").alias("title"), F.lit(0).cast("long").alias("outgoing"))
    return inner.union(outer).orderBy(F.desc("outgoing"), "id").limit(limit)


def html(symbols: DataFrame, edges: DataFrame, limit: int = 1000, limit_edges: int = 10_000) -> str:
    """The page. It shows the first ``limit`` nodes and ``limit_edges`` of the edges among them, so its size is bounded."""
    nodes = top_nodes(symbols, edges, limit)
    ids = nodes.select("id")
    shown = graph.graph_edges(symbols, edges)
    for end in ("from_qualname", "to_qualname"):
        shown = shown.join(F.broadcast(ids.withColumnRenamed("id", end)), end, "left_semi")
    shown = shown.orderBy("from_qualname", "to_qualname", "label").limit(limit_edges)
    data = json.dumps({"nodes": [r.asDict() for r in nodes.collect()], "edges": [r.asDict() for r in shown.collect()]})
    return PAGE.replace("__DATA__", data.replace("<", "\\u003c"))


#: Nodes of one page of the folder.
SHARD_NODES = 1000


def shard_lines(symbols: DataFrame, edges: DataFrame, shards: int) -> DataFrame:
    """(shard, part, id, line): the lines of ``shards`` pages, in order of part and id.

    A page has the nodes whose ids hash to it, external ones included, and the edges that go out from these. Each node
    and each edge is a line of its own, so no page and no hub is ever held in one piece.
    """
    line = lambda df, *names: F.concat(F.replace(F.to_json(F.struct(*names)), F.lit("<"), F.lit("\\u003c")), F.lit(","))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    inner = graph.first_symbol(symbols).select(F.col("qualname").alias("id"), F.col("name").alias("label"), F.col("kind").alias("node_group"))
    nodes = inner.unionByName(graph.graph_externals(symbols, edges).withColumn("node_group", F.lit("external")))
    kept = graph.graph_edges(symbols, edges)
    head, _, tail = PAGE.partition("__DATA__")
    frame = symbols.sparkSession.range(shards).select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.lit(x).alias("line")) for k, x in ((0, head + '{"nodes": ['), (2, '], "edges": ['), (4, "]}" + tail))])).alias("f"))
    parts = (
        frame.select(F.col("id").alias("shard"), "f.part", F.lit("").alias("id"), "f.line"),
        nodes.select(place("id").alias("shard"), F.lit(1).alias("part"), "id", line(nodes, "id", "label", "node_group").alias("line")),
        kept.select(place("from_qualname").alias("shard"), F.lit(3).alias("part"), F.col("from_qualname").alias("id"), line(kept, "from_qualname", "to_qualname", "label", "dashes").alias("line")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_shards(symbols: DataFrame, edges: DataFrame, folder: str, size: int = SHARD_NODES) -> int:
    """Write the whole graph as pages of some ``size`` nodes into folder/shard=K, and return their number.

    The writer commits all pages at the end or none.
    """
    shards = max(1, -(-symbols.select("qualname").distinct().count() // size))
    lines = shard_lines(symbols, edges, shards)
    ordered = lines.repartition("shard").sortWithinPartitions("shard", "part", "id", "line")
    ordered.select("shard", "line").write.mode("overwrite").partitionBy("shard").text(folder)
    return shards
