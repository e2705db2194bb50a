"""Tables written out: JSON lines, graphs, routed records, statistics, logs."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .files import store_of

#: Colour of a node by its type, and of others.
COLOURS = {"Module": "#ffcc00", "Function": "#66cc66", "Test": "#ff6666", "Library": "#66b2ff", "ExternalAPI": "#cc99ff", "File": "#cccccc"}
OTHER_COLOUR = "#dddddd"

#: Draws the nodes on a spiral and shows what lies under the pointer.
_PAGE = (
    """<!DOCTYPE html>
<html><head><meta charset="utf-8"><style>body{margin:0;font:12px sans-serif}#tip{position:fixed;background:#fff;border:1px solid #999;padding:2px 4px}</style></head>
<body><svg id="view" width="100%" height="100vh"></svg><div id="tip" hidden></div><script>
const nodes = [""",
    """], edges = [""",
    """];
const view = document.getElementById("view"), tip = document.getElementById("tip"), at = {}, ns = "http://www.w3.org/2000/svg";
const side = 40 + 24 * Math.sqrt(nodes.length || 1);
view.setAttribute("viewBox", [-side, -side, 2 * side, 2 * side].join(" "));
function add(tag, attrs, text) {
  const e = document.createElementNS(ns, tag);
  for (const k in attrs) e.setAttribute(k, attrs[k]);
  e.onmousemove = m => { tip.hidden = false; tip.style.left = m.clientX + 9 + "px"; tip.style.top = m.clientY + 9 + "px"; tip.textContent = text; };
  e.onmouseout = () => { tip.hidden = true; };
  view.appendChild(e);
}
nodes.forEach((n, i) => { const r = 22 * Math.sqrt(i), t = 2.399963 * i; at[n.id] = [r * Math.cos(t), r * Math.sin(t)]; });
edges.forEach(e => { const a = at[e.source], b = at[e.target]; if (a && b) add("line", {x1: a[0], y1: a[1], x2: b[0], y2: b[1], stroke: "#999999"}, e.source + " " + e.label + " " + e.target); });
nodes.forEach(n => add("circle", {cx: at[n.id][0], cy: at[n.id][1], r: 7, fill: n.color}, n.label + " - " + n.title));
</script></body></html>
""",
)


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One record a line in UTF-8, nulls written."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as JSON text: a line that opens it, one for each node and edge, and one that closes it; part and value."""
    node = F.to_json(F.struct(*[c for c in nodes.columns if c != "order"]))
    edge = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.array_sort("etypes").alias("etype")))
    return nodes.select(F.lit("node").alias("part"), node.alias("value")).union(edges.select(F.lit("edge"), edge))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One document {directed, nodes, edges}, streamed to the driver row by row, as a single file has one writer."""
    lines = graph_lines(nodes, edges)
    store, at = store_of(path)
    with store.open_output_stream(at) as out:
        out.write(b'{"directed": true')
        for name, part in (("nodes", "node"), ("edges", "edge")):
            out.write(f', "{name}": ['.encode())
            for k, r in enumerate(lines.where(F.col("part") == part).toLocalIterator()):
                out.write((", " * (k > 0) + r.value).encode())
            out.write(b"]")
        out.write(b"}")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph in GraphML, streamed; nulls are left out, lists are joined to text."""
    flat = lambda t: t.select(*[(F.array_join(c, ",") if t.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")).alias(c) for c in t.columns if c != "order"])
    nodes, edges = flat(nodes), flat(edges)
    store, at = store_of(path)
    with store.open_output_stream(at) as out:
        say = lambda s: out.write(s.encode())
        say('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for kind, t, own in (("node", nodes, ("id",)), ("edge", edges, ("src", "dst"))):
            for c in t.columns:
                if c not in own:
                    say(f'<key id="{kind}_{c}" for="{kind}" attr.name="{c}" attr.type="string"/>\n')
        say('<graph edgedefault="directed">\n')
        for kind, t, own in (("node", nodes, ("id",)), ("edge", edges, ("src", "dst"))):
            for r in t.toLocalIterator():
                d = r.asDict()
                say(f"<node id={quoteattr(d['id'])}>" if kind == "node" else f"<edge source={quoteattr(d['src'])} target={quoteattr(d['dst'])}>")
                say("".join(f'<data key="{kind}_{c}">{escape(v)}</data>' for c, v in d.items() if c not in own and v is not None) + f"</{kind}>\n")
        say("</graph>\n</graphml>\n")


def write_routed(rows: DataFrame, accepted: Column, good: str, bad: str) -> DataFrame:
    """Two JSON tables by a predicate; returns kept, rejected, kept_ratio."""
    # Made once, as a model's answers may differ when they are made again.
    rows = cut(rows.withColumn("_ok", F.coalesce(accepted, F.lit(False))))
    write_jsonl(rows.where("_ok").drop("_ok"), good)
    write_jsonl(rows.where("NOT _ok").drop("_ok"), bad)
    return routed_stats(rows, "_ok", good, bad)


def routed_stats(rows: DataFrame, ok: str, good: str = "", bad: str = "") -> DataFrame:
    out = rows.agg(F.count_if(ok).alias("kept"), F.count_if(~F.col(ok)).alias("rejected"))
    return out.select("kept", "rejected", (F.col("kept") / F.greatest(F.col("kept") + F.col("rejected"), F.lit(1))).alias("kept_ratio"), F.lit(good).alias("output"), F.lit(bad).alias("rejected_output"))


def write_tokens(rows: DataFrame, path: str) -> None:
    """A table of tokens; streams cannot be written so."""
    if rows.isStreaming:
        raise ValueError("a stream has no table of tokens")
    rows.write.mode("errorifexists").parquet(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    write_jsonl(rows.select("prompt", "predict", "label"), path)


def write_rewards(rows: DataFrame, path: str) -> None:
    write_jsonl(rows.select(F.round("chosen", 2).alias("chosen"), F.round("rejected", 2).alias("rejected")), path)


def write_results(results: DataFrame, accuracy: DataFrame, folder: str) -> None:
    """Results and a readable table of accuracies; an existing folder is an error."""
    results.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{folder}/results")
    accuracy.select(F.format_string("%15s: %.2f", "category", "accuracy")).write.mode("errorifexists").text(f"{folder}/log")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def shown_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, label, title, color of nodes, and source, target, label of edges, for a drawing."""
    colour = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    label = F.coalesce(F.nullif("name", F.lit("")), F.nullif("path", F.lit("")), F.col("id"))
    shown = nodes.select("id", label.alias("label"), F.concat_ws(": ", "node_type", "id").alias("title"), F.coalesce(F.try_element_at(colour, F.col("node_type")), F.lit(OTHER_COLOUR)).alias("color"))
    return shown, edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.array_join(F.array_sort("etypes"), ", ").alias("label"))


def write_graph_html(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as one page that draws itself, nodes coloured by type; streamed to the driver row by row, as a single file has one writer."""
    store, at = store_of(path)
    with store.open_output_stream(at) as out:
        for head, t in zip(_PAGE, shown_graph(nodes, edges)):  # noqa: B905
            out.write(head.encode())
            # No text may end the script.
            for k, r in enumerate(t.select(F.replace(F.to_json(F.struct("*")), F.lit("<"), F.lit("\\u003c")).alias("value")).toLocalIterator()):
                out.write((",\n" * (k > 0) + r.value).encode())
        out.write(_PAGE[2].encode())
