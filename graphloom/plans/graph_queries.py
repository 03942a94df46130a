"""Graph queries over the relational tables, each with SQL of equal meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph, confidence_name
from ..operators import analyze as A
from ..operators import build as B
from ..operators import metrics as M
from ..operators import query as Q
from ..operators import traverse as T
from ..sources.relational import line_tasks, star_edges, star_graph, star_nodes, table

#: The graph of sources/relational.py in SQL: nodes, raw edges, merged edges, degrees.
GRAPH = """
with nodes as (
  select 'region:' || r_regionkey as id, r_name as label, 'Region' as type, cast(null as varchar) as file_path, cast(null as int) as community from region
  union all select 'nation:' || n_nationkey, n_name, 'Nation', 'nation/r' || n_regionkey || '.md', cast(n_regionkey as int) from nation
  union all select 'customer:' || c_custkey, c_name, 'Customer', 'customer/' || lower(c_mktsegment) || '.py', cast(c_nationkey % 5 as int) from customer
  union all select 'supplier:' || s_suppkey, s_name, 'Supplier', 'supplier/n' || s_nationkey || '.cs', cast(s_nationkey % 5 as int) from supplier
  union all select 'part:' || p_partkey, p_name, 'Part', 'part/' || replace(p_brand, '#', '_') || '.pdf', cast(p_partkey % 5 as int) from part),
raw as (
  select 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst, 'located_in' as relationship, 1.0::double as weight, 0 as confidence_ord, cast(n_nationkey as bigint) as ord, 'schema.md' as source_file from nation
  union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 1.0, 0, c_custkey, 'schema.md' from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 1.0, 0, s_suppkey, 'schema.md' from supplier
  union all select 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', l_quantity, case l_returnflag when 'R' then 0 when 'N' then 1 else 2 end, l_orderkey * 8 + l_linenumber, 'lineitem/' || lower(l_linestatus) || '.py' from lineitem
  union all select 'customer:' || o_custkey, 'part:' || l_partkey, 'buys', l_quantity, case l_returnflag when 'R' then 0 when 'N' then 1 else 2 end, l_orderkey * 8 + l_linenumber, 'lineitem/' || lower(l_linestatus) || '.py' from lineitem join orders on l_orderkey = o_orderkey),
merged as (select src, dst, relationship, sum(weight) as weight, cast(min(confidence_ord) as int) as confidence_ord, count(*) as merge_count, min({'o': ord, 's': source_file}).s as source_file from raw group by all),
edges as (select * from merged where src in (select id from nodes) and dst in (select id from nodes)),
hits as (select src as id from edges union all select dst from edges),
degree as (select n.id, count(h.id) as degree from nodes n left join hits h on n.id = h.id group by n.id),
nd as (select n.*, d.degree from nodes n join degree d using (id)),
names as (select * from (values (0, 'EXTRACTED'), (1, 'INFERRED'), (2, 'AMBIGUOUS')) t(o, confidence)),
ends as (select src as id, dst as other, relationship, weight, confidence_ord from edges union all select dst, src, relationship, weight, confidence_ord from edges where src <> dst),
je as (select e.*, a.label as src_label, b.label as dst_label, a.file_path as src_file_path, b.file_path as dst_file_path, a.community as src_community, b.community as dst_community, a.degree as src_degree, b.degree as dst_degree from edges e join nd a on e.src = a.id join nd b on e.dst = b.id),
sizes as (select community, count(*) as size, min(id) as first_id from nodes where community is not null group by community),
members as (select community, id, degree, row_number() over (partition by community order by degree desc, id) as rank from nd where community is not null)
"""


def _text_edges(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "relationship", "weight", confidence_name(F.col("confidence_ord")).alias("confidence"), F.element_at("metadata", "merge_count").cast("long").alias("merge_count"), F.element_at("metadata", "source_file").alias("source_file"))


def _extracted(spark, sf):
    """Line items as extracted nodes: the same part is extracted many times."""
    x = table(spark, sf, "lineitem")
    return x.select(
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("id"),
        F.concat(F.lit("line "), F.col("l_orderkey").cast("string")).alias("label"),
        F.when(F.col("l_returnflag") == "R", "Document").when(F.col("l_returnflag") == "N", "Code").otherwise("Paper").alias("file_type"),
        F.concat(F.lit("lineitem\\"), F.lower("l_linestatus"), F.lit(".py")).alias("source_file"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("source_location"),
        F.create_map(F.lit("k"), F.col("l_returnflag"), F.lit("line"), F.col("l_linenumber").cast("string")).alias("metadata"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
    )


def _meta(*keys: str) -> list:
    return [F.try_element_at("metadata", F.lit(k)).alias(f"m_{k}") for k in keys]


QUERIES = {
    "graph_edge_merge": lambda s, d: _text_edges(star_graph(s, d).edges),
    "graph_min_weight": lambda s, d: B.merge_edges(star_edges(s, d), star_nodes(s, d), 40.0).select("src", "dst", "relationship", "weight"),
    "graph_dangling_edges": lambda s, d: B.merge_edges(star_edges(s, d), star_nodes(s, d).where("type <> 'Supplier'")).groupBy("relationship").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")),
    "graph_node_merge": lambda s, d: B.merge_nodes(_extracted(s, d)).select("id", "label", "type", "file_path", *_meta("k", "line", "source_location", "merge_count")),
    "graph_node_merge_fold": lambda s, d: B.merge_nodes(_extracted(s, d), strategy="aggregate", tasks=line_tasks(s, d)).select("id", "label", *_meta("k", "line", "merge_count")),
    "graph_file_nodes": lambda s, d: B.file_nodes(_extracted(s, d)).select("id", "label", "type", "file_path"),
    "graph_contains_edges": lambda s, d: B.contains_edges(_extracted(s, d), star_edges(s, d)).select("src", "dst", "relationship", "weight"),
    "graph_relative_paths": lambda s, d: B.relative_paths(_extracted(s, d).withColumn("relative_path", F.concat(F.lit("rel/"), "label"))),
    "graph_degree": lambda s, d: M.degrees(star_graph(s, d)),
    "graph_top_degree": lambda s, d: M.top_degree(star_graph(s, d)),
    "graph_statistics": lambda s, d: M.statistics(star_graph(s, d)),
    "graph_statistics_no_edge": lambda s, d: M.statistics(star_graph(s, d), 0),
    "graph_nodes_by_type": lambda s, d: M.histogram(star_graph(s, d).nodes, "type"),
    "graph_edges_by_relationship": lambda s, d: M.histogram(star_graph(s, d).edges, "relationship"),
    "graph_confidence_summary": lambda s, d: M.confidence_summary(star_graph(s, d)),
    "graph_communities": lambda s, d: M.communities(star_graph(s, d)),
    "graph_community_labels": lambda s, d: M.community_labels(star_graph(s, d)),
    "graph_audit_trail": lambda s, d: M.audit_trail(star_graph(s, d)),
    "graph_cross_links": lambda s, d: M.cross_links(star_graph(s, d)),
    "graph_adjacency": lambda s, d: M.adjacency(star_graph(s, d)),
    "graph_modularity": lambda s, d: M.modularity(star_graph(s, d)),
    "graph_cohesion_engine": lambda s, d: M.cohesion_engine(star_graph(s, d)),
    "graph_cohesion_report": lambda s, d: M.cohesion_report(star_graph(s, d)),
    "graph_density": lambda s, d: M.density(star_graph(s, d)),
    "graph_inferred_counts": lambda s, d: M.inferred_counts(star_graph(s, d)),
    "graph_top_members": lambda s, d: M.top_members(star_graph(s, d), 5),
    "graph_god_nodes": lambda s, d: A.god_nodes(star_graph(s, d)),
    "graph_surprise_scores": lambda s, d: A.surprise_scores(star_graph(s, d)),
    "graph_cross_file_surprises": lambda s, d: A.cross_file_surprises(star_graph(s, d)),
    "graph_bridges": lambda s, d: A.bridges(star_graph(s, d)),
    "graph_bridge_nodes": lambda s, d: A.bridge_nodes(star_graph(s, d)).select("id", "label", F.array_join(F.col("others").cast("array<string>"), ",").alias("others")),
    "graph_inferred_examples": lambda s, d: A.inferred_examples(star_graph(s, d)),
    "graph_isolated": lambda s, d: A.isolated(star_graph(s, d), 30),
    "graph_question_kinds": lambda s, d: A.questions(star_graph(s, d)).groupBy("kind").agg(F.count("*").alias("n")),
    "graph_search": lambda s, d: Q.search(star_graph(s, d), "RIC"),
    "graph_explain_edges": lambda s, d: Q.explain_edges(star_graph(s, d), "nation:3"),
    "graph_community_totals": lambda s, d: Q.community_totals(star_graph(s, d)),
    "graph_god_links": lambda s, d: Q.god_links(star_graph(s, d), 40),
    "graph_explain": lambda s, d: Q.explain(star_graph(s, d), "nation:3"),
    "graph_communities_overview": lambda s, d: Q.communities_overview(star_graph(s, d)),
    "graph_community_members": lambda s, d: Q.community_members(star_graph(s, d), 2),
    "graph_mean_weight": lambda s, d: Q.analyze(star_graph(s, d))["mean_weight"],
    "graph_insights": lambda s, d: Q.insights(star_graph(s, d)),
    "graph_incident_edges": lambda s, d: star_graph(s, d).incident("nation:3").select("src", "dst", "relationship", "weight"),
    "graph_out_neighbors": lambda s, d: star_graph(s, d).out_neighbors("supplier:1").select("id", "label"),
    "graph_shortest_path": lambda s, d: T.shortest_path(star_graph(s, d), "supplier:1", "region:" + str(_region_of(s, d, 1))),
    "graph_expand": lambda s, d: T.expand(star_graph(s, d), star_nodes(s, d).where("id in ('supplier:1', 'customer:1')").select("id")),
    "graph_seeds": lambda s, d: T.seeds(star_graph(s, d), "which supplier#000000007 or customer sells", 5),
    "graph_retrieval_cost": lambda s, d: T.retrieval_cost(star_graph(s, d), ("where is supplier#000000007 located", "what about nation and region america")),
    "graph_merge": lambda s, d: M.histogram(_merged(s, d).edges, "relationship"),
    "graph_merge_preserving": lambda s, d: M.histogram(_merged(s, d, True).edges, "relationship"),
}


def _region_of(spark, sf, supplier: int) -> int:
    x = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.where(F.col("s_suppkey") == supplier).first().n_regionkey


def _merged(spark, sf, keep: bool = False) -> PropertyGraph:
    """The graph with nations of region 1 written anew and their edges to regions given again."""
    g = star_graph(spark, sf)
    nodes = g.nodes.where("type = 'Nation' and community = 1").withColumn("label", F.lower("label"))
    edges = g.edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select(*g.edges.columns)
    return g.merge(PropertyGraph(nodes, edges), keep)


_FILE_LABEL = r"(regexp_matches({0}, '[.](py|ts|tsx|js|go|rs|java|rb|cpp|c|h|cs|kt|scala|php)$') or ({0} like '.%' and {0} like '%()') or ({0} like '%()' and {0} not like '%.%'))"
_CONCEPT = "(coalesce({0}, '') = '' or split_part({0}, '/', -1) not like '%.%')"
_CATEGORY = "(case when {0} like '%.py' or {0} like '%.cs' then 'code' when {0} like '%.pdf' then 'paper' else 'doc' end)"
_SURPRISE = (
    ", sp as (select src, dst, relationship, confidence_ord, "
    "case confidence_ord when 2 then 3 when 1 then 2 else 1 end + case when ca <> cb then 2 else 0 end + case when da <> db then 2 else 0 end + case when src_community <> dst_community then 1 else 0 end + case when least(src_degree, dst_degree) <= 2 and greatest(src_degree, dst_degree) >= 5 then 1 else 0 end as score, "
    "concat_ws('; ', case when confidence_ord > 0 then lower(confidence) || ' connection' end, case when ca <> cb then 'crosses file types (' || ca || ' to ' || cb || ')' end, case when da <> db then 'connects different directories' end, case when src_community <> dst_community then 'bridges communities' end, case when least(src_degree, dst_degree) <= 2 and greatest(src_degree, dst_degree) >= 5 then 'peripheral node reaches a hub' end) as reasons, confidence "
    "from (select *, " + _CATEGORY.format("src_file_path") + " as ca, " + _CATEGORY.format("dst_file_path") + " as cb, split_part(src_file_path, '/', 1) as da, split_part(dst_file_path, '/', 1) as db from je join names on o = confidence_ord "
    "where relationship not in ('imports', 'imports_from', 'contains', 'method') and not " + _CONCEPT.format("src_file_path") + " and not " + _CONCEPT.format("dst_file_path") + " and not " + _FILE_LABEL.format("src_label") + " and not " + _FILE_LABEL.format("dst_label") + " and src_file_path <> dst_file_path)) "
)
_EXTRACTED = """
with x as (select 'part_' || l_partkey as id, 'line ' || l_orderkey as label, case l_returnflag when 'R' then 'Document' when 'N' then 'Entity' else 'Paper' end as type,
  'lineitem/' || lower(l_linestatus) || '.py' as file_path, l_returnflag as k, cast(l_linenumber as varchar) as line, l_orderkey * 8 + l_linenumber as ord, case l_returnflag when 'R' then 'Document' when 'N' then 'Code' else 'Paper' end as file_type from lineitem),
r as (select *, count(*) over (partition by id) as n, row_number() over (partition by id order by ord desc, file_path desc, label desc, line desc, file_type desc) as r from x)
"""


def _g(sql: str) -> str:
    return GRAPH + sql


ORACLES = {
    "graph_edge_merge": _g("select src, dst, relationship, weight, confidence, cast(merge_count as bigint) as merge_count, source_file from edges join names on o = confidence_ord"),
    "graph_min_weight": _g("select src, dst, relationship, weight from edges where weight >= 40"),
    "graph_dangling_edges": _g("select relationship, count(*) as n, sum(weight) as weight from edges where src not like 'supplier:%' and dst not like 'supplier:%' group by 1"),
    "graph_node_merge": _EXTRACTED + "select id, label, type, file_path, k as m_k, line as m_line, 'L' || line as m_source_location, case when n > 1 then cast(n as varchar) end as m_merge_count from r where r = 1",
    "graph_node_merge_fold": _EXTRACTED + "select id, label, k as m_k, line as m_line, case when n > 1 then cast(n as varchar) end as m_merge_count from r where r = 1",
    "graph_file_nodes": _EXTRACTED + "select distinct 'file:' || file_path as id, split_part(file_path, '/', -1) as label, 'File' as type, file_path from x",
    "graph_contains_edges": _EXTRACTED + "select distinct 'file:' || file_path as src, id as dst, 'contains' as relationship, 1.0::double as weight from x",
    "graph_relative_paths": _EXTRACTED + "select replace(file_path, '/', chr(92)) as path_key, max({'o': ord, 'p': 'rel/' || label}).p as relative_path from x group by 1",
    "graph_degree": _g("select id, cast(degree as bigint) as degree from degree"),
    "graph_top_degree": _g("select id, label, degree from nd order by degree desc, id limit 10"),
    "graph_statistics": _g("select count(*) as node_count, (select count(*) from edges) as edge_count, count(distinct community) as community_count, round_even(cast(sum(degree) as double) / count(*) * 100, 0) / 100 as average_degree, count(*) filter (degree <= 1) as isolated_node_count from nd"),
    "graph_statistics_no_edge": _g("select count(*) as node_count, (select count(*) from edges) as edge_count, count(distinct community) as community_count, round_even(cast(sum(degree) as double) / count(*) * 100, 0) / 100 as average_degree, count(*) filter (degree <= 0) as isolated_node_count from nd"),
    "graph_nodes_by_type": _g("select type, count(*) as n from nodes group by 1"),
    "graph_edges_by_relationship": _g("select relationship, count(*) as n from edges group by 1"),
    "graph_confidence_summary": _g("select count(*) as edges, count(*) filter (confidence_ord = 0) as extracted, count(*) filter (confidence_ord = 1) as inferred, count(*) filter (confidence_ord = 2) as ambiguous, cast(round_even(extracted * 100.0::double / greatest(edges, 1), 0) as int) as extracted_percent, cast(round_even(inferred * 100.0::double / greatest(edges, 1), 0) as int) as inferred_percent, cast(round_even(ambiguous * 100.0::double / greatest(edges, 1), 0) as int) as ambiguous_percent, round_even(coalesce(avg(weight) filter (confidence_ord = 1), 0) * 100, 0) / 100 as mean_inferred_weight from (select * from edges) e"),
    "graph_communities": _g("select community, size, first_id from sizes"),
    "graph_community_labels": _g("select community, type || ' (Community ' || community || ')' as label from (select community, type, row_number() over (partition by community order by count(*) desc, type) as r from nodes where community is not null group by 1, 2) where r = 1"),
    "graph_audit_trail": _g("select community, confidence, count(*) as n from (select src as id, confidence_ord from edges union all select dst, confidence_ord from edges) h join nodes using (id) join names on o = confidence_ord where community is not null group by 1, 2"),
    "graph_cross_links": _g("select * from (select src_community as community, dst_community as other, count(*) as links, cast(row_number() over (partition by src_community order by count(*) desc, dst_community) as int) as rank from je where src_community <> dst_community group by 1, 2) where rank <= 12"),
    "graph_adjacency": _g("select id, other, sum(weight) as weight from ends group by 1, 2"),
    "graph_modularity": _g("select round_even(sum(inn / w - pow(deg / (2 * w), 2)) * 1e6, 0) / 1e6 as modularity from (select a.community, sum(case when a.community = b.community then weight else 0 end) / 2 as inn, sum(weight) as deg from ends join nodes a using (id) left join nodes b on b.id = other where a.community is not null group by 1), (select sum(weight) as w from edges)"),
    "graph_cohesion_engine": _g("select community, case when size <= 1 then 1.0 else round_even(cast(coalesce(h, 0) as double) / (size * (size - 1) / 2) * 100, 0) / 100 end as cohesion from sizes left join (select src_community as community, 2 * count(*) as h from je where src_community = dst_community and src < dst group by 1) using (community)"),
    "graph_cohesion_report": _g("select community, case when size < 2 then 0.0 else round_even(cast(coalesce(h, 0) as double) / (size * (size - 1)) * 100, 0) / 100 end as cohesion from sizes left join (select src_community as community, sum(case when src = dst then 1 else 2 end) as h from je where src_community = dst_community group by 1) using (community)"),
    "graph_density": _g("select community, case when size < 2 then 0.0 else round_even(cast(coalesce(h, 0) as double) / (size * (size - 1) / 2) * 1e6, 0) / 1e6 end as density from sizes left join (select community, count(*) as h from (select distinct src_community as community, least(src, dst) as a, greatest(src, dst) as b from je where src_community = dst_community and src <> dst) group by 1) using (community)"),
    "graph_inferred_counts": _g("select id, count(*) as inferred from ends where confidence_ord = 1 group by 1"),
    "graph_top_members": _g("select community, cast(rank as int) as rank, id, degree, greatest(size - 5, 0) as more from members join sizes using (community) where rank <= 5"),
    "graph_god_nodes": _g("select id, label, degree as edge_count from nd where not " + _FILE_LABEL.format("label") + " and not " + _CONCEPT.format("file_path") + " order by degree desc, id limit 10"),
    "graph_surprise_scores": _g(_SURPRISE + "select src, dst, relationship, confidence, cast(score as int) as score, case when reasons = '' then 'cross-file semantic connection' else reasons end as why from sp"),
    "graph_cross_file_surprises": _g(_SURPRISE + "select src, dst, relationship, confidence, cast(score as int) as score, case when reasons = '' then 'cross-file semantic connection' else reasons end as why from sp order by score desc, src, dst, relationship limit 5"),
    "graph_bridges": _g("select low, high, src, dst, relationship, confidence from (select least(src_community, dst_community) as low, greatest(src_community, dst_community) as high, src, dst, relationship, confidence_ord, row_number() over (partition by low, high order by src, dst, relationship) as r from je where relationship not in ('imports', 'imports_from', 'contains', 'method') and src_community <> dst_community and not " + _FILE_LABEL.format("src_label") + " and not " + _FILE_LABEL.format("dst_label") + ") join names on o = confidence_ord where r = 1 order by confidence_ord desc, src, dst, relationship limit 5"),
    "graph_bridge_nodes": _g("select id, label, string_agg(cast(far as varchar), ',' order by far) as others from (select distinct src as id, src_label as label, dst_community as far from je where src_community is not null and dst_community <> src_community and not " + _FILE_LABEL.format("src_label") + " and not " + _CONCEPT.format("src_file_path") + ") group by 1, 2 having count(*) >= 2 order by id limit 3"),
    "graph_inferred_examples": _g(", top as (select id, count(*) as inferred from ends join nodes using (id) where confidence_ord = 1 and not " + _FILE_LABEL.format("label") + " group by 1 having count(*) >= 2 order by inferred desc, id limit 3) select id, inferred, cast(rank as int) as rank, other from (select id, inferred, other, row_number() over (partition by id order by other) as rank from (select distinct id, other from ends where confidence_ord = 1) join top using (id)) where rank <= 2"),
    "graph_isolated": _g("select id, label, degree from nd where degree <= 30 and not " + _FILE_LABEL.format("label") + " and not " + _CONCEPT.format("file_path")),
    "graph_question_kinds": _g("select kind, count(*) as n from (select 'ambiguous_edge' as kind from edges where confidence_ord = 2 limit 10) group by 1"),
    "graph_search": _g(", h as (select * from nd where contains(lower(id), 'ric') or contains(lower(label), 'ric') or contains(lower(type), 'ric') order by id limit 10) select h.id, label, type, degree, coalesce((select string_agg(t, ', ' order by r) from (select relationship || ':' || other as t, row_number() over (order by other, relationship) as r from ends e where e.id = h.id) where r <= 5), '') as connections from h"),
    "graph_explain_edges": _g("select 'in' as direction, relationship, src as other, label, weight, confidence from edges join names on o = confidence_ord left join nodes on nodes.id = src where dst = 'nation:3' union all select 'out', relationship, dst, label, weight, confidence from edges join names on o = confidence_ord left join nodes on nodes.id = dst where src = 'nation:3'"),
    "graph_community_totals": _g("select count(distinct community) as communities, count(community) as members, count(*) filter (community is null) as without from nodes"),
    "graph_god_links": GRAPH
    + ", tops as (select id from nd order by degree desc, id limit 40), o as (select src as id, dst as other, relationship, confidence_ord from edges where src in (select id from tops)), "
    + "b as (select e.dst as id, e.src as other, e.relationship, e.confidence_ord from edges e join (select distinct id, other from o) k on e.dst = k.id and e.src = k.other where e.src <> e.dst), "
    + "x as (select l.id, relationship, nd.label, confidence_ord, min({'d': -nd.degree, 'o': l.other}) as place from (select * from o union all select * from b) l join nd on nd.id = l.other group by all), "
    + "r as (select *, row_number() over (partition by id, relationship order by place, confidence_ord) as rank, count(*) over (partition by id, relationship) as total from x) "
    + "select id, relationship, total, rank, label, confidence from r join names on names.o = confidence_ord where rank <= 20",
    "graph_explain": _g("select id, label, type, file_path, community, i as in_count, u as out_count, lower(type) as role, case when i + u = 0 then 'isolated' when i + u = 1 then 'connected once' when i + u < 5 then 'lightly connected' when i + u < 20 then 'well connected' else 'a hub' end as connectivity from nodes, (select count(*) as i from edges where dst = 'nation:3'), (select count(*) as u from edges where src = 'nation:3') where id = 'nation:3'"),
    "graph_communities_overview": _g("select community, size, string_agg(id, ', ' order by rank) as members from members join sizes using (community) where rank <= 5 group by 1, 2"),
    "graph_community_members": _g("select id, label, degree from nd where community = 2"),
    "graph_mean_weight": _g("select relationship, round_even(avg(weight) * 1e4, 0) / 1e4 as mean_weight from edges group by 1"),
    "graph_insights": _g(", s as (select count(*) as n, (select count(*) from edges) as e, count(*) filter (degree = 0) as i, count(distinct community) as c from nd), t as (select label, degree from nd order by degree desc, id limit 1) select 0 as ord, 'The graph has ' || n || ' nodes and ' || e || ' edges.' as insight from s union all select 1, 'Most connected is ' || label || ' with ' || degree || ' edges.' from t union all select 2, i || ' nodes have no edges.' from s where i > 0 union all select 3, 'There are ' || c || ' communities.' from s where c > 1"),
    "graph_incident_edges": _g("select src, dst, relationship, weight from edges where src = 'nation:3' or dst = 'nation:3'"),
    "graph_out_neighbors": _g("select n.id, n.label from edges e join nodes n on n.id = e.dst where e.src = 'supplier:1'"),
    "graph_shortest_path": _g("select step, id, label from nodes join (select 0 as step, 'supplier:1' as id union all select 1, 'nation:' || s_nationkey from supplier where s_suppkey = 1 union all select 2, 'region:' || n_regionkey from supplier join nation on s_nationkey = n_nationkey where s_suppkey = 1) using (id)"),
    "graph_expand": _g(", h0 as (select unnest(['supplier:1', 'customer:1']) as id), h1 as (select distinct dst as id from edges where src in (select id from h0) and dst not in (select id from h0)), h2 as (select distinct dst as id from edges where src in (select id from h1) and dst not in (select id from h0 union all select id from h1)), h3 as (select distinct dst as id from edges where src in (select id from h2) and dst not in (select id from h0 union all select id from h1 union all select id from h2)) select id, 0 as hop from h0 union all select id, 1 from h1 union all select id, 2 from h2 union all select id, 3 from h3"),
    "graph_seeds": _g("select id, cast(score as int) as score from (select id, (contains(lower(label), 'which'))::int + (contains(lower(label), 'supplier#000000007'))::int + (contains(lower(label), 'customer'))::int + (contains(lower(label), 'sells'))::int as score from nodes) where score > 0 order by score desc, id limit 5"),
    "graph_merge": _g("select relationship, count(*) as n from edges where not (dst in (select id from nodes where type = 'Nation' and community = 1)) group by 1"),
    "graph_merge_preserving": _g("select relationship, count(*) as n from edges group by 1"),
}
