"""Renderings of a graph: rows that Spark makes and, but for drawings and reports, tasks write."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import rounded, truncated
from ..model import EDGE_KEY, PropertyGraph, confidence_name, ends
from ..operators import analyze as A
from ..operators import metrics as M
from ..operators import query as Q
from ..operators.cluster import layout
from .writers import delete, write_lines, write_notes

#: Colours of communities in a page and in a drawing, and the largest graph that a page can draw.
PALETTE = ("#4E79A7", "#F28E2B", "#E15759", "#76B7B2", "#59A14F", "#EDC948", "#B07AA1", "#FF9DA7", "#9C755F", "#BAB0AC")
SVG_PALETTE = ("#4285F4", "#EA4335", "#FBBC04", "#34A853", "#FF6D00", "#9C27B0", "#00BCD4", "#8BC34A", "#FF5722", "#795548", "#607D8B", "#E91E63", "#3F51B5", "#009688", "#FFC107")
PAGE_NODES = 5000


def json_nodes(g: PropertyGraph) -> DataFrame:
    return g.nodes.select("id", "label", "type", "community", F.coalesce("relative_path", "file_path").alias("file_path"), "language", confidence_name(F.col("confidence_ord")).alias("confidence"), "metadata")


def json_edges(g: PropertyGraph) -> DataFrame:
    return g.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relationship", "weight", confidence_name(F.col("confidence_ord")).alias("confidence"), "metadata")


def write_json(g: PropertyGraph, path: str) -> None:
    """One graph.json in order of keys, written by tasks; nulls are left out."""
    s = M.statistics(g).first()
    row = lambda df: F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    nodes, edges = json_nodes(g), json_edges(g)
    first = f"{path}.nodes"
    write_lines(nodes, row(nodes), [F.col("id")], first, '{"nodes": [\n', "\n", ",\n")
    meta = {"node_count": s.node_count, "edge_count": s.edge_count, "community_count": s.community_count}
    write_lines(edges, row(edges), [F.col("source"), F.col("target"), F.col("relationship")], path, '], "edges": [\n', '\n], "metadata": ' + json.dumps(meta) + "}\n", ",\n", first)
    delete(first)


def write_tables(g: PropertyGraph, path: str) -> None:
    """nodes and edges as JSON lines, in parallel and of any size."""
    json_nodes(g).write.mode("overwrite").json(f"{path}/nodes")
    json_edges(g).write.mode("overwrite").json(f"{path}/edges")


def cypher(g: PropertyGraph) -> DataFrame:
    """(section, ord, statement): nodes, edges and indexes as CREATE statements."""
    q = lambda c: F.concat(F.lit("'"), T.cypher_text(c), F.lit("'"))
    extra = F.array_sort(F.filter(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda e: (F.trim(e["value"]) != "") & (e["key"] != "label")))
    props = F.array_join(F.transform(extra, lambda e: F.concat(F.lit(", "), F.regexp_replace(e["key"], "[^A-Za-z0-9_]", "_"), F.lit(": '"), T.cypher_text(e["value"]), F.lit("'"))), "")
    community = F.when(F.col("community").isNotNull(), F.concat(F.lit(", community: "), F.col("community").cast("string"))).otherwise("")
    nodes = g.nodes.select(F.lit(0).alias("section"), F.col("id").alias("ord"), F.concat(F.lit("CREATE ("), T.cypher_variable(F.col("id")), F.lit(":"), T.cypher_label(F.col("type")), F.lit(" {id: "), q(F.col("id")), F.lit(", label: "), q(F.col("label")), community, props, F.lit("});")).alias("statement"))
    edges = g.edges.select(F.lit(1).alias("section"), F.concat_ws("|", *EDGE_KEY).alias("ord"), F.concat(F.lit("MATCH (a {id: "), q(F.col("src")), F.lit("}), (b {id: "), q(F.col("dst")), F.lit("}) CREATE (a)-[:"), T.cypher_relationship(F.col("relationship")), F.lit(" {weight: "), F.format_string("%.2f", "weight"), F.lit(", confidence: '"), confidence_name(F.col("confidence_ord")), F.lit("'}]->(b);")).alias("statement"))
    index = g.nodes.select(T.cypher_label(F.col("type")).alias("t")).distinct().select(F.lit(2).alias("section"), F.col("t").alias("ord"), F.concat(F.lit("CREATE INDEX IF NOT EXISTS FOR (n:"), F.col("t"), F.lit(") ON (n.id);")).alias("statement"))
    return nodes.unionByName(edges).unionByName(index)


def table_cypher(g: PropertyGraph) -> DataFrame:
    """(section, ord, statement) for a store with declared tables: definitions, nodes and edges with metadata maps."""
    spark = g.nodes.sparkSession
    q = lambda c: F.concat(F.lit("'"), T.cypher_text(F.coalesce(c, F.lit(""))), F.lit("'"))
    entries = F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))))
    meta = lambda: F.concat(F.lit("map(["), F.array_join(F.transform(entries, lambda e: F.concat(F.lit("'"), T.cypher_text(e["key"]), F.lit("'"))), ", "), F.lit("], ["), F.array_join(F.transform(entries, lambda e: F.concat(F.lit("'"), T.cypher_text(e["value"]), F.lit("'"))), ", "), F.lit("])"))
    ddl = spark.createDataFrame([(0, "0", "CREATE NODE TABLE Entity(id STRING, label STRING, type STRING, community INT64, metadata MAP(STRING, STRING), PRIMARY KEY(id));"), (0, "1", "CREATE REL TABLE Relates(FROM Entity TO Entity, relationship STRING, weight DOUBLE, confidence STRING, metadata MAP(STRING, STRING));")], "section int, ord string, statement string")
    nodes = g.nodes.select(F.lit(1).alias("section"), F.col("id").alias("ord"), F.concat(F.lit("CREATE (:Entity {id: "), q(F.col("id")), F.lit(", label: "), q(F.col("label")), F.lit(", type: "), q(F.col("type")), F.lit(", community: "), F.coalesce(F.col("community").cast("string"), F.lit("NULL")), F.lit(", metadata: "), meta(), F.lit("});")).alias("statement"))
    edges = g.edges.select(F.lit(2).alias("section"), F.concat_ws("|", *EDGE_KEY).alias("ord"), F.concat(F.lit("MATCH (a:Entity {id: "), q(F.col("src")), F.lit("}), (b:Entity {id: "), q(F.col("dst")), F.lit("}) CREATE (a)-[:Relates {relationship: "), q(F.col("relationship")), F.lit(", weight: "), F.format_string("%.2f", "weight"), F.lit(", confidence: "), q(F.initcap(confidence_name(F.col("confidence_ord")))), F.lit(", metadata: "), meta(), F.lit("}]->(b);")).alias("statement"))
    return ddl.unionByName(nodes).unionByName(edges)


def write_statements(statements: DataFrame, path: str) -> None:
    """One text file in order."""
    write_lines(statements, F.col("statement"), [F.col("section"), F.col("ord")], path, tail="\n")


def page_nodes(g: PropertyGraph) -> DataFrame:
    """(id, label, community, color, size, font): how a page draws nodes."""
    d = M.with_degree(g).withColumn("community", F.coalesce("community", F.lit(0)))
    most = M.degrees(g).agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    color = F.element_at(F.array(*map(F.lit, PALETTE)), F.pmod(F.col("community"), F.lit(len(PALETTE))) + 1)
    return d.join(most).select("id", T.html_label(F.col("label")).alias("label"), "community", color.alias("color"), rounded(10 + 30 * F.col("degree") / F.col("most"), 1).alias("size"), F.when(F.col("degree") >= 0.15 * F.col("most"), 12).otherwise(0).alias("font"))


def page_edges(g: PropertyGraph) -> DataFrame:
    sure = F.col("confidence_ord") == 0
    return g.edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("relationship").alias("title"), (~sure).alias("dashes"), F.when(sure, 2).otherwise(1).alias("width"), F.when(sure, 0.7).otherwise(0.35).alias("opacity"))


_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title>
<style>body{{margin:0;font-family:sans-serif}}#graph{{width:100vw;height:100vh}}#legend{{position:fixed;right:8px;top:8px;background:#fffc;padding:8px}}</style></head>
<body><div id="graph"></div><div id="legend"></div><script src="https://unpkg.com/vis-network/standalone/umd/vis-network.min.js"></script>
<script>const nodes={nodes},edges={edges},legend={legend};
new vis.Network(document.getElementById('graph'),{{nodes:new vis.DataSet(nodes.map(n=>({{...n,shape:'dot',font:{{size:n.font}}}}))),edges:new vis.DataSet(edges.map(e=>({{...e,color:{{opacity:e.opacity}},arrows:'to'}})))}},{{physics:{{stabilization:true}}}});
for(const c of legend){{const d=document.createElement('div');d.textContent=c.label+' ('+c.size+')';d.style.color=c.color;document.getElementById('legend').append(d)}}</script></body></html>
"""


def _bounded(g: PropertyGraph) -> None:
    if (n := g.nodes.limit(PAGE_NODES + 1).count()) > PAGE_NODES:
        raise ValueError(f"a page draws at most {PAGE_NODES} nodes; this graph has {n} or more")


def _row(df: DataFrame) -> Column:
    return F.replace(F.to_json(F.struct(*[F.col(c) for c in df.columns])), F.lit("</"), F.lit("<\\/"))


def write_html(g: PropertyGraph, path: str, title: str = "Graph") -> None:
    """One page; its nodes are bounded by PAGE_NODES, and its edges go from tasks to the file."""
    _bounded(g)
    nodes, edges = page_nodes(g), page_edges(g)
    legend = nodes.groupBy("community", "color").agg(F.count("*").alias("size")).select("community", F.concat(F.lit("Community "), F.col("community").cast("string")).alias("label"), "size", "color")
    head, between, then, tail = (x.replace("{{", "{").replace("}}", "}") for x in re.split(r"\{nodes\}|\{edges\}|\{legend\}", _PAGE.replace("{title}", html.escape(title))))
    for k, (rows, order, before, behind) in enumerate([(nodes, ["id"], head + "[", "]"), (edges, ["from", "to", "title"], between + "[", "]"), (legend, ["community"], then + "[", "]" + tail)]):
        write_lines(rows, _row(rows), [F.col(c) for c in order], path if k == 2 else f"{path}.{k}", before, behind, ",", f"{path}.{k - 1}" if k else None)
    for k in (0, 1):
        delete(f"{path}.{k}")


def write_svg(g: PropertyGraph, path: str) -> None:
    """A drawing of 1600 x 1200 with force-directed places; nodes and edges go through the driver, as one file does."""
    shown = M.with_degree(g).orderBy("id").select("id", T.xml_text(truncated(F.col("label"), 20)).alias("label"), "community", "degree").collect()
    links = [(r.src, r.dst) for r in g.edges.select("src", "dst").orderBy("src", "dst").collect()]
    at = layout([r.id for r in shown], links)
    out = ['<svg xmlns="http://www.w3.org/2000/svg" width="1600" height="1200">']
    out += ["<text x='800' y='600' text-anchor='middle'>No nodes</text>"] if not shown else []
    out += [f'<line x1="{at[a][0]:.1f}" y1="{at[a][1]:.1f}" x2="{at[b][0]:.1f}" y2="{at[b][1]:.1f}" stroke="#999" stroke-opacity="0.5"/>' for a, b in links if a in at and b in at]
    for r in shown:
        x, y = at[r.id]
        color = "#cccccc" if r.community is None else SVG_PALETTE[r.community % len(SVG_PALETTE)]
        out.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{8 + min(r.degree / 5, 10):.1f}" fill="{color}"/>')
        if r.degree > 10:
            out.append(f'<text x="{x:.1f}" y="{y - 12:.1f}" font-size="11">{r.label}</text>')
    Path(path).write_text("\n".join([*out, "</svg>\n"]), encoding="utf-8")


def vault_notes(g: PropertyGraph) -> DataFrame:
    """(file, text): a linked Markdown note for each file name; of nodes with one name the last by id stays."""
    if g.sides is None:
        x = ends(g.distinct_edges(), "relationship", "confidence_ord").join(g.nodes.select(F.col("id").alias("other"), T.file_stem(F.col("label")).alias("far")), "other")
    else:
        end = lambda own, far: F.struct(F.col(own).alias("id"), F.col(f"{far}_stem").alias("far"), "relationship", "confidence_ord")
        x = g.sides({"stem": T.file_stem(F.col("label"))})
        x = x.select(F.inline(F.when(F.col("src") == F.col("dst"), F.array(end("src", "dst"))).otherwise(F.array(end("src", "dst"), end("dst", "src")))))
    x = g.spread(x.select("id", "far", "relationship", "confidence_ord"), "id")  # one exchange for both groups
    x = x.select("id", "relationship", F.concat(F.lit("- [["), "far", F.lit("]] "), F.lower(confidence_name(F.col("confidence_ord")))).alias("line"))
    per = x.groupBy("id", "relationship").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    all_ = per.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "relationship", "lines"))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("## "), p["relationship"], F.lit("\n"), p["lines"])), "\n\n")
    last = g.nodes.groupBy(T.file_stem(F.col("label")).alias("file")).agg(F.max("id").alias("id"))
    d = M.with_degree(g).join(last, "id").join(all_, "id", "left")
    head = F.concat(F.lit("---\nid: "), T.yaml_quoted(F.col("id")), F.lit("\ntype: "), F.col("type"), F.lit("\ncommunity: "), F.coalesce(F.col("community").cast("string"), F.lit("none")), F.lit("\ndegree: "), F.col("degree").cast("string"), F.lit("\n---\n# "), F.col("label"), F.lit("\n\n"))
    return d.select("file", F.concat(head, F.coalesce(body, F.lit("No connections.")), F.lit("\n")).alias("text"))


def wiki_articles(g: PropertyGraph, members: int = 25, links: int = 12, files: int = 20) -> DataFrame:
    """(file, text): an article for each community with its members, links to others, source files and audit trail.

    The edges are written once for degrees and links, and what lies between communities is counted once for all parts.
    """
    g = g.settled(community=F.col("community"))
    between = M.community_links(g).persist()
    top = M.top_members(g, members).join(g.nodes.select("id", "label"), "id")
    body = top.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "label", F.lit(" ("), F.col("degree").cast("string"), F.lit(")")).alias("t")))), lambda s: s["t"]), "\n").alias("members"), F.max("more").alias("more"))
    far = M.cross_links(g, links, between).groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.format_string("- Community %d: %d links", "other", "links").alias("t")))), lambda s: s["t"]), "\n").alias("far"))
    all_ = Window.partitionBy("community")
    share = F.bround(100.0 * F.col("n") / F.sum("n").over(all_), 0).cast("int")
    trail = M.audit_trail(g, between).withColumn("share", share).withColumn("t", F.struct((-F.col("n")).alias("k"), "confidence", F.format_string("- %s: %d (%d%%)", "confidence", "n", "share").alias("line")))
    audit = trail.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda s: s["line"]), "\n").alias("audit"))
    own = g.nodes.where("community is not null").select("community", F.try_element_at("metadata", F.lit("source_file")).alias("file")).where("file <> ''").distinct()
    rank = F.row_number().over(Window.partitionBy("community").orderBy("file"))
    source = own.withColumn("rank", rank).where(F.col("rank") <= files).groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list("file")), lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n").alias("source"))
    x = M.communities(g).join(M.community_labels(g), "community").join(M.cohesion_report(g, between if g.unique else None), "community").join(body, "community").join(far, "community", "left").join(audit, "community", "left").join(source, "community", "left")
    text = F.concat(F.lit("# "), "label", F.format_string("\n\n%d nodes, cohesion %.2f\n\n## Members\n", "size", "cohesion"), "members", F.when(F.col("more") > 0, F.format_string("\n- and %d more", "more")).otherwise(""), F.lit("\n\n## Links\n"), F.coalesce("far", F.lit("none")), F.when(F.col("source").isNotNull(), F.concat(F.lit("\n\n## Source files\n"), "source")).otherwise(""), F.lit("\n\n## Audit trail\n"), F.coalesce("audit", F.lit("none")), F.lit("\n"))
    return x.select(F.concat(F.lit("community-"), F.col("community").cast("string")).alias("file"), text.alias("text"))


def god_articles(g: PropertyGraph, n: int = 10, links: int = 20) -> DataFrame:
    """(file, text): an article for each of the n nodes of the highest degree, its links by relationship, most links first."""
    line = F.concat(F.lit("- [["), "label", F.lit("]]"), F.when(F.col("confidence") != "EXTRACTED", F.concat(F.lit(" `"), F.lower("confidence"), F.lit("`"))).otherwise(""))
    per = Q.god_links(g, n, links).groupBy("id", "relationship", "total").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))).alias("ls"))
    part = F.concat(F.lit("### "), "relationship", F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["t"]), "\n"))
    body = per.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("k"), "relationship", part.alias("t")))).alias("ps"))
    top = M.top_degree(g, n).select("id", "label", "degree").join(g.nodes.select("id", "community"), "id").join(body, "id", "left")
    head = F.concat(F.lit("# "), "label", F.format_string("\n\n> God node, %d connections\n\n", "degree"), F.when(F.col("community").isNotNull(), F.format_string("**Community:** [[Community_%d]]\n\n", "community")).otherwise(""), F.lit("## Connections by relation\n\n"))
    text = F.concat(head, F.coalesce(F.array_join(F.transform("ps", lambda p: p["t"]), "\n\n"), F.lit("none")), F.lit("\n\nSee [[index]].\n"))
    return top.select(wiki_file(F.col("label")).alias("file"), text.alias("text"))


def wiki_file(name: Column) -> Column:
    """A file name as wikis have it: no path, space or colon."""
    return F.regexp_replace(F.translate(name, "/\\ :", "--_-"), "\0", "_")


def _lines(spark: SparkSession, section: int, lines: list[str]) -> DataFrame:
    """Lines of a page's frame as rows (section, a, b, line)."""
    return spark.createDataFrame([(section, k, "", x) for k, x in enumerate(lines)], "section int, a long, b string, line string")


def _listed(df: DataFrame, section: int, a: Column, b: Column, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), a.cast("long").alias("a"), b.cast("string").alias("b"), line.alias("line"))


def write_page(parts: list[DataFrame], path: str) -> None:
    """A page of rows (section, a, b, line) in this order."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    write_lines(rows, F.col("line"), [F.col("section"), F.col("a"), F.col("b")], path, tail="\n")


def wiki_index(g: PropertyGraph, n: int = 10) -> list[DataFrame]:
    """The wiki's first page: totals, communities by size, god nodes."""
    spark, s = g.nodes.sparkSession, M.statistics(g).first()
    return [
        _lines(spark, 0, ["# Knowledge graph index", "", f"**{s.node_count} nodes, {s.edge_count} edges, {s.community_count} communities**", "", "## Communities", ""]),
        _listed(M.communities(g), 1, -F.col("size"), F.format_string("%012d", "community"), F.format_string("- [[community-%d]]: %d nodes", "community", "size")),
        _lines(spark, 2, ["", "## God nodes", ""]),
        _listed(M.top_degree(g, n), 3, -F.col("degree"), F.col("id"), F.format_string("- [[%s]]: %d connections", "label", "degree")),
    ]


def vault_index(g: PropertyGraph, top: int = 20, members: int = 10) -> list[DataFrame]:
    """The vault's first note: totals, the most connected nodes, each community's first members, counts of types."""
    spark, s = g.nodes.sparkSession, M.statistics(g).first()
    shown = M.top_members(g, members).join(g.nodes.select("id", "label"), "id").groupBy("community").agg(F.sort_array(F.collect_list(F.struct("rank", "label"))).alias("ms"), F.max("more").alias("more"))
    each = F.array_join(F.transform("ms", lambda m: F.concat(F.lit("- [["), F.coalesce(m["label"], F.lit("None")), F.lit("]]"))), "\n")
    part = F.concat(F.format_string("\n### Community %d\n\n*%d nodes*\n\n", "community", "size"), each, F.when(F.col("more") > 0, F.format_string("\n- *... and %d more*", "more")).otherwise(""))
    return [
        _lines(spark, 0, ["---", "title: Knowledge Graph Index", "---", "", "# Knowledge Graph Index", "", "## Statistics", "", f"- **Nodes:** {s.node_count}", f"- **Edges:** {s.edge_count}", f"- **Communities:** {s.community_count}", "", "## Most connected nodes", ""]),
        _listed(M.top_degree(g, top), 1, -F.col("degree"), F.col("id"), F.format_string("- [[%s]] (%d connections)", "label", "degree")),
        _lines(spark, 2, ["", "## By community"]),
        _listed(M.communities(g).join(shown, "community"), 3, -F.col("size"), F.format_string("%012d", "community"), part),
        _lines(spark, 4, ["", "## By type", ""]),
        _listed(M.histogram(g.nodes, "type"), 5, -F.col("n"), F.coalesce("type", F.lit("")), F.format_string("- %s: %d", F.coalesce("type", F.lit("None")), F.col("n"))),
    ]


def _surprises(g: PropertyGraph) -> list[str]:
    """Lines on the few surprising edges, with the files of their ends where both have one."""
    found = A.surprises(g)
    path = lambda end: g.nodes.select(F.col("id").alias(end), F.col("file_path").alias(f"{end}_file"))
    out = []
    for r in found.join(path("src"), "src", "left").join(path("dst"), "dst", "left").collect():
        tag = " [semantically similar]" if r.relationship == "semantically_similar_to" else ""
        files = f" {r.src_file} -> {r.dst_file}" if r.src_file and r.dst_file else ""
        out.append(f"- `{r.src}` --{r.relationship}--> `{r.dst}` [{r.confidence}]{tag}{files} {r.why}")
    return out


def report(g: PropertyGraph, name: str = "project", day: str | None = None) -> str:
    """A Markdown report, dated today unless a day is given: summary, god nodes, surprises, communities, questions and gaps."""
    s, c = M.statistics(g).first(), M.confidence_summary(g).first()
    out = [f"# Graph report: {name} ({day or date.today().isoformat()})", "", "## Summary", f"- {s.node_count} nodes, {s.edge_count} edges, {s.community_count} communities", f"- average degree {s.average_degree:.2f}, {s.isolated_node_count} nodes with at most one edge", f"- {c.extracted_percent}% extracted, {c.inferred_percent}% inferred, {c.ambiguous_percent}% ambiguous", "", "## God nodes"]
    out += [f"{k}. `{r.label}` - {r.edge_count} edges" for k, r in enumerate(A.god_nodes(g).collect(), 1)] or ["none"]
    out += ["", "## Surprising connections"] + (_surprises(g) or ["none"]) + ["", "## Communities"]
    cohesion = {r.community: r.cohesion for r in M.cohesion_report(g).collect()}
    shown: dict[int, list] = {}
    for r in M.top_members(g, 8).orderBy("community", "rank").collect():
        shown.setdefault(r.community, []).append(r)
    for r in M.communities(g).orderBy(F.desc("size"), "first_id").collect():
        more = shown[r.community][0].more
        out += [f"### Community {r.community}: {r.size} nodes, cohesion {cohesion[r.community]:.2f}", ", ".join(m.id for m in shown[r.community]) + (f" (+{more} more)" if more else "")]
    out += ["", "## Questions"] + [f"- [{r.kind}] {r.question or ''} {r.why}" for r in A.questions(g).collect()]
    alone = A.isolated(g)
    some = [r.label for r in alone.orderBy("id").limit(5).collect()]
    out += ["", "## Knowledge gaps", f"- {alone.count()} isolated entities" + (f": {', '.join(some)}" if some else "")]
    if c.edges and c.ambiguous * 5 > c.edges:
        out.append("- more than a fifth of the edges are ambiguous")
    return "\n".join(out) + "\n"


def summary_lines(g: PropertyGraph) -> list[str]:
    """What a console shows after a run."""
    s = M.statistics(g).first()
    return [f"Nodes: {s.node_count}", f"Edges: {s.edge_count}", f"Average degree: {s.average_degree:.2f}", *[f"  {r.label} ({r.edge_count})" for r in A.god_nodes(g, 5).collect()]]


#: Format name: what writes it into a folder.
FORMATS: dict[str, Callable[[PropertyGraph, str], None]] = {
    "json": lambda g, d: write_json(g, f"{d}/graph.json"),
    "html": lambda g, d: write_html(g, f"{d}/graph.html"),
    "svg": lambda g, d: write_svg(g, f"{d}/graph.svg"),
    "neo4j": lambda g, d: write_statements(cypher(g), f"{d}/graph.cypher"),
    "ladybug": lambda g, d: write_statements(table_cypher(g), f"{d}/graph.ladybug.cypher"),
    "obsidian": lambda g, d: (write_notes(vault_notes(g), f"{d}/obsidian"), write_page(vault_index(g), f"{d}/obsidian/_Index.md"), None)[2],
    "wiki": lambda g, d: (write_notes(wiki_articles(g).unionByName(god_articles(g)), f"{d}/wiki"), write_page(wiki_index(g), f"{d}/wiki/index.md"), None)[2],
    "report": lambda g, d: (Path(d, "GRAPH_REPORT.md").write_text(report(g), encoding="utf-8"), None)[1],
}


def export(g: PropertyGraph, folder: str, formats: tuple[str, ...] = ("json", "html", "report")) -> dict[str, str]:
    """Write the formats; what failed, by format. An unknown or failing one doesn't stop the others."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    failed = {}
    for name in formats:
        if (write := FORMATS.get(name)) is None:
            failed[name] = "unknown format"
            continue
        try:
            write(g, folder)
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {e}"
    return failed
