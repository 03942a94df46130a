"""Queries over pages, documents and events: cleaning, validation, extraction, renderings and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions import validate as V
from ..model import PropertyGraph
from ..operators import cluster as C
from ..operators import extract as X
from ..sources import sinks as S
from ..sources.files import web_documents
from ..sources.relational import star_graph, table
from ..streaming import incremental as I
from .graph_queries import GRAPH


def events(s, d):
    """Events as changes of a file for each user: every tenth is a deletion."""
    gone = F.col("event_id") % 10 == 0
    return table(s, d, "events").select(F.format_string("u/%d.py", "user_id").alias("path"), F.when(gone, "deleted").otherwise("changed").alias("kind"), F.when(~gone, F.col("props")).alias("content"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def _located(s, d):
    """What lies where: every supplier and customer in its nation, nations in regions."""
    g = star_graph(s, d)
    return PropertyGraph(g.nodes.where("type <> 'Part'"), g.edges.where("relationship = 'located_in'"))


def _state(s, d):
    last = I.last_changes(events(s, d))
    half = F.substring(F.sha2("path", 256), 1, 1) < "8"
    known = last.where(half).select("path", F.sha2(F.coalesce("content", F.lit("x")), 256).alias("content_hash"))
    return I.changed(last.select("path", "content"), known)


def _code(s, d):
    """A Python file for each supplier."""
    name = F.translate("s_name", "#", "_")
    body = F.concat(F.lit("import os.path\n\n\nclass "), name, F.lit(":\n    def run_"), F.col("s_nationkey").cast("string"), F.lit("(self):\n        pass\n\n    def stop(self):\n        pass\n"))
    return table(s, d, "supplier").select(F.format_string("src/s%d.py", "s_suppkey").alias("path"), F.lit("Python").alias("language"), body.alias("content"))


def _payloads(s, d):
    """Model answers made of orders: one suspicious node, one edge to nowhere, a weight over 1."""
    node = '{"id":"o%d","label":"Order %d"},{"id":"c%d","label":"Customer"},{"id":"x%d","label":"<script>"}'
    j = F.format_string('```json\n{"nodes":[' + node + '],"edges":[{"source":"O%d","target":"c%d","weight":%d},{"source":"o%d","target":"zzz"}]}\n```', "o_orderkey", "o_orderkey", "o_custkey", "o_orderkey", "o_orderkey", "o_custkey", F.col("o_orderkey") % 3, "o_orderkey")
    x = table(s, d, "orders").select("o_orderkey", V.payload(j).alias("p"))
    return x.select("o_orderkey", F.size("p.nodes").alias("nodes"), F.size("p.edges").alias("edges"), F.get("p.edges", F.lit(0))["weight"].alias("weight"), F.get("p.edges", F.lit(0))["relation"].alias("relation"))


def _linked(s, d):
    """Pages, some under addresses of papers and repositories, one safe name for several."""
    n = F.col("page_id").cast("string")
    paper = F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad(F.pmod("page_id", F.lit(100)).cast("string"), 5, "0"), F.lit("?v="), n)
    code = F.concat(F.lit("https://github.com/owner/repo"), n)
    kind, even = F.pmod("page_id", F.lit(5)), F.col("page_id") % 2 == 0
    head = '<h1 class="title mathjax"><b>On</b>\n "it"</h1><div class="authors">A, B</div><blockquote class="abstract x">About\n  it</blockquote>'
    same = F.concat(F.lit("https://Web.example.org/"), F.when(even, "#").otherwise("/"), n)
    url = F.when(kind == 0, paper).when(kind == 1, code).when(kind == 2, same).otherwise(F.col("url"))
    return table(s, d, "pages").select(url.alias("url"), F.when((kind == 0) & even, F.concat(F.lit(head), "html")).otherwise(F.col("html")).alias("html"))


QUERIES = {
    "text_markdown": lambda s, d: table(s, d, "pages").select("page_id", T.html_to_markdown(F.col("html")).alias("markdown")),
    "text_title": lambda s, d: table(s, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title")),
    "text_labels": lambda s, d: table(s, d, "pages").select("page_id", T.html_label(F.col("html"), 400).alias("plain"), T.safe_label(F.col("html"), 400).alias("safe")),
    "text_urls": lambda s, d: table(s, d, "pages").select("page_id", T.url_kind(F.col("url")).alias("kind"), T.url_file_name(F.col("url")).alias("file_name")),
    "text_url_errors": lambda s, d: table(s, d, "pages").select("page_id", F.array_join(V.url_errors(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp://h/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 5 == 1, F.lit("http://10.0.0.1/x")).when(F.col("page_id") % 5 == 2, F.lit(" ")).otherwise(F.col("url"))), "; ").alias("errors")),
    "text_input_errors": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(V.input_errors(F.col("text")), "; ").alias("errors")),
    "text_tokens": lambda s, d: table(s, d, "documents").select("doc_id", T.text_tokens(F.col("text")).alias("tokens"), T.words_to_tokens(F.size(F.split("text", " "))).alias("by_words"), T.content_hash(F.col("text")).alias("hash"), P.truncated(F.col("text"), 40).alias("short")),
    "text_quoting": lambda s, d: table(s, d, "documents").select("doc_id", T.cypher_text(F.col("text")).alias("cypher"), T.xml_text(F.col("text")).alias("xml"), T.yaml_quoted(F.col("text")).alias("yaml")),
    "text_ids": lambda s, d: table(s, d, "part").select("p_partkey", X.make_id(F.col("p_name"), F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("id")),
    "text_paths": lambda s, d: star_graph(s, d).nodes.select("id", P.path_category(F.coalesce("file_path", F.lit(""))).alias("category"), P.top_dir(F.coalesce("file_path", F.lit(""))).alias("top"), P.is_concept(F.col("file_path")).alias("concept"), P.is_file_label(F.col("label")).alias("file_label")),
    "text_payloads": _payloads,
    "web_documents": lambda s, d: web_documents(_linked(s, d), F.lit("2024-05-06T07:08:09Z"), 'Ann "A" Lee').select("url", "kind", "file", F.sha2("document", 256).alias("document_sha256")),
    "extract_nodes": lambda s, d: X.extract(_code(s, d))[0].select("id", "label", "source_file", "source_location"),
    "extract_edges": lambda s, d: X.extract(_code(s, d))[1].select("src", "dst", "relationship", "source_location"),
    "sink_cypher": lambda s, d: S.cypher(star_graph(s, d)).select("section", "ord", "statement"),
    "sink_page_nodes": lambda s, d: S.page_nodes(star_graph(s, d)).select("id", "community", "color", "size", "font"),
    "sink_vault": lambda s, d: S.vault_notes(star_graph(s, d)).select("file", F.sha2("text", 256).alias("text_sha256")),
    "sink_wiki": lambda s, d: S.wiki_articles(star_graph(s, d)),
    "incremental_last_changes": lambda s, d: I.last_changes(events(s, d)).select("path", "kind"),
    "incremental_changed": lambda s, d: _state(s, d).select("path", "content_hash", "state"),
    "incremental_ticks": lambda s, d: I.ticks(events(s, d), "1 hour").groupBy("kind").agg(F.count("*").alias("n")),
    "cluster_detect": lambda s, d: C.detect(star_graph(s, d)),
    "cluster_spread": lambda s, d: C.detect(_located(s, d), giant=0),
}

_CODE = "with f as (select *, lower(replace(s_name, '#', '_')) as low, replace(s_name, '#', '_') as name, 's' || s_suppkey as stem, 'src/s' || s_suppkey || '.py' as path from supplier) "
_CATEGORY = "case when file_path like '%.py' or file_path like '%.cs' then 'code' when file_path like '%.pdf' then 'paper' else 'doc' end"
EVENTS = "with e as (select 'u/' || user_id || '.py' as path, case when event_id % 10 = 0 then 'deleted' else 'changed' end as kind, case when event_id % 10 <> 0 then props end as content, ts, event_id from events), l as (select path, max({'ts': ts, 'kind': kind, 'content': content}) as m from e group by path), last as (select path, m.kind as kind, m.content as content from l) "


def _in_order(x: str, steps: list[tuple[str, str]], how: str) -> str:
    for a, b in steps:
        x = f"regexp_replace({x}, {a}, {b}, 'g')" if how == "regex" else f"replace({x}, {a}, {b})"
    return x


_NO_TAGS = [("'[\\x00-\\x1F\\x7F]'", "''"), ("'(?is)<script[^>]*>.*?</script>'", "''"), ("'<[^>]*>'", "''")]
_ENTITIES = [("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"), ("'\"'", "'&quot;'"), ("''''", "'&#39;'")]
def _markdown(html: str) -> str:
    """SQL of html_to_markdown()."""
    bare = _in_order(html, [("'(?is)<script[^>]*>.*?</script>'", "''"), ("'(?is)<style[^>]*>.*?</style>'", "''")], "regex")
    inner = lambda tag: f"'(?is)<{tag}[^>]*>(.*?)</{tag}>'"
    part = f"case when regexp_matches({bare}, {inner('article')}) then regexp_extract({bare}, {inner('article')}, 1) when regexp_matches({bare}, {inner('main')}) then regexp_extract({bare}, {inner('main')}, 1) else {bare} end"
    heads = [(f"'(?is)<h{k}[^>]*>(.*?)</h{k}>'", f"chr(10) || '{'#' * k} \\1' || chr(10)") for k in (1, 2, 3)]
    rest = [("'(?is)<p[^>]*>(.*?)</p>'", "'\\1' || chr(10) || chr(10)"), ("'(?i)<br\\s*/?>'", "chr(10)"), ("'<[^>]+>'", "' '"), ("'[ \\t]+'", "' '"), ("'\\n\\n\\n+'", "chr(10) || chr(10)"), ("'^\\s+|\\s+$'", "''")]
    return _in_order(part, [*heads, *rest], "regex")


_TITLE = "nullif(" + _in_order("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)", [("'\\s+'", "' '"), ("'^\\s+|\\s+$'", "''")], "regex") + ", '')"


def _quoted(x: str) -> str:
    """SQL of yaml_quoted()."""
    return "'\"' || " + _in_order(x, [("chr(92)", "chr(92) || chr(92)"), ("'\"'", "chr(92) || '\"'"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "''")], "text") + " || '\"'"


_PARTS = "'^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#:]*)([^#]*)'"
_FILE = "substr(" + _in_order(f"lower(regexp_extract(url, {_PARTS}, 1)) || regexp_extract(url, {_PARTS}, 2)", [("'[^A-Za-z0-9_\\-]'", "'_'"), ("'_+'", "'_'"), ("'^_+|_+$'", "''")], "regex") + ", 1, 80)"
_KIND = "case when contains(lower(url), 'arxiv.org') then 'arxiv' when contains(lower(url), 'github.com') then 'github' else 'web' end"
#: The documents of _linked(): lines of each kind, joined by line feeds.
_DOCUMENTS = f"""
with p as (select case page_id % 5 when 0 then 'https://arxiv.org/abs/2401.' || lpad((page_id % 100)::varchar, 5, '0') || '?v=' || page_id when 1 then 'https://github.com/owner/repo' || page_id
    when 2 then 'https://Web.example.org/' || case page_id % 2 when 0 then '#' else '/' end || page_id else url end as url, page_id % 5 = 0 and page_id % 2 = 0 as titled,
    case when titled then '<h1 class="title mathjax"><b>On</b>' || chr(10) || ' "it"</h1><div class="authors">A, B</div><blockquote class="abstract x">About' || chr(10) || '  it</blockquote>' || html else html end as html from pages),
  x as (select url, titled, {_KIND} as kind, coalesce({_TITLE}, url) as title, {_markdown("html")} as body, {_FILE} as base, regexp_extract(url, '([0-9]{{4}}[.][0-9]{{4,5}})', 1) as number, string_split(url, '/') as parts,
    ['captured_at: 2024-05-06T07:08:09Z', 'contributor: "Ann \\"A\\" Lee"', '---', ''] as foot from p),
  d as (select url, kind, base, array_to_string(list_concat(['---', 'source_url: ' || url], case kind
    when 'arxiv' then list_concat(['arxiv_id: ' || number, 'type: paper', 'title: "' || case when titled then 'On \\"it\\"' else number end || '"'], case when titled then ['paper_authors: "A, B"'] else [] end, foot,
      case when titled then ['# On "it"', '', '**Authors:** A, B'] else ['# ' || number, ''] end, ['**arXiv:** ' || number, '', '## Abstract', '', case when titled then 'About it' else '' end, '', 'Source: ' || url, '', ''])
    when 'github' then list_concat(['type: github_repo', 'github_owner: owner', 'github_repo: ' || parts[-1]], foot, ['# owner/' || parts[-1], '', 'GitHub Repository: ' || url, '', '*Use GitHub API or clone the repository for full code analysis.*', '', ''])
    else list_concat(['type: webpage', 'title: ' || {_quoted("title")}], foot, ['# ' || title, '', 'Source: ' || url, '', '---', ''], case when length(body) > 12000 then [substr(body, 1, 12000), '', '*[Content truncated]*', ''] else [body] end, [''])
    end), chr(10)) as document from x),
  n as (select *, row_number() over (partition by base order by url, document) - 1 as k from d)
select url, kind, base || case when k > 0 then '_' || k else '' end || '.md' as file, sha256(document) as document_sha256 from n
"""
ORACLES = {
    "text_markdown": "select page_id, " + _markdown("html") + " as markdown from pages",
    "text_title": "select page_id, " + _TITLE + " as title from pages",
    "text_labels": "select page_id, substr(trim(" + _in_order("html", _NO_TAGS, "regex") + "), 1, 400) as plain, " + _in_order("substr(" + _in_order("html", [_NO_TAGS[0], _NO_TAGS[2]], "regex") + ", 1, 400)", _ENTITIES, "text") + " as safe from pages",
    "text_urls": f"select page_id, {_KIND} as kind, {_FILE} as file_name from pages",
    "text_url_errors": "select page_id, case page_id % 5 when 0 then 'URL scheme is not allowed' when 1 then 'URL host is private' when 2 then 'URL is blank' else '' end as errors from pages",
    "text_input_errors": "select doc_id, concat_ws('; ', case when trim(text) = '' then 'input is blank' end, case when length(text) > 1000 then 'input is too long' end, case when (length(text) - length(regexp_replace(text, '[;''\"\\\\<>&]', '', 'g'))) * 10 > length(text) then 'input has too many special characters' end, case when regexp_matches(text, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') then 'input has control characters' end) as errors from documents",
    "text_tokens": "select doc_id, greatest(1, length(text) // 4) as tokens, cast(len(string_split(text, ' ')) * 100 // 75 as bigint) as by_words, sha256(text) as hash, case when length(text) > 40 then substr(text, 1, 37) || '...' else text end as short from documents",
    "text_quoting": "select doc_id, " + _in_order("text", [("chr(92)", "chr(92) || chr(92)"), ("''''", "chr(92) || ''''"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'")], "text") + " as cypher, " + _in_order("text", [*_ENTITIES[:4], ("''''", "'&apos;'")], "text") + " as xml, " + _quoted("text") + " as yaml from documents",
    "text_ids": "select p_partkey, lower(" + _in_order("p_name || '_' || p_brand || '_' || p_type", [("'[^a-zA-Z0-9]+'", "'_'"), ("'^_+|_+$'", "''")], "regex") + ") as id from part",
    "text_paths": GRAPH + f"select id, {_CATEGORY} as category, split_part(coalesce(file_path, ''), '/', 1) as top, coalesce(file_path, '') = '' or split_part(file_path, '/', -1) not like '%.%' as concept, regexp_matches(label, '[.](py|ts|tsx|js|go|rs|java|rb|cpp|c|h|cs|kt|scala|php)$') or (label like '.%' and label like '%()') or (label like '%()' and label not like '%.%') as file_label from nodes",
    "text_payloads": "select o_orderkey, 2 as nodes, 1 as edges, least(o_orderkey % 3, 1)::double as weight, 'related_to' as relation from orders",
    "web_documents": _DOCUMENTS,
    "extract_nodes": _CODE + "select stem as id, stem || '.py' as label, path as source_file, 'L1' as source_location from f union all select stem || '_' || low, name, path, 'L2' from f union all select stem || '_run_' || s_nationkey, 'run_' || s_nationkey || '()', path, 'L5' from f union all select stem || '_stop', 'stop()', path, 'L7' from f",
    "extract_edges": _CODE + "select stem as src, 'path' as dst, 'imports' as relationship, 'L1' as source_location from f union all select stem, stem || '_' || low, 'contains', 'L2' from f union all select stem, stem || '_run_' || s_nationkey, 'contains', 'L5' from f union all select stem, stem || '_stop', 'contains', 'L7' from f",
    "sink_cypher": GRAPH
    + "select 0 as section, id as ord, 'CREATE (' || replace(id, ':', '_') || ':' || type || ' {id: ''' || id || ''', label: ''' || label || '''' || coalesce(', community: ' || community, '') || '});' as statement from nodes "
    + "union all select 1, src || '|' || dst || '|' || relationship, 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) CREATE (a)-[:' || upper(relationship) || ' {weight: ' || printf('%.2f', weight) || ', confidence: ''' || confidence || '''}]->(b);' from edges join names on o = confidence_ord "
    + "union all select distinct 2, type, 'CREATE INDEX IF NOT EXISTS FOR (n:' || type || ') ON (n.id);' from nodes",
    "sink_page_nodes": GRAPH + "select id, coalesce(community, 0) as community, list_extract(['#4E79A7', '#F28E2B', '#E15759', '#76B7B2', '#59A14F'], coalesce(community, 0) + 1) as color, round_even((10 + 30 * degree::double / most) * 10, 0) / 10 as size, case when degree >= 0.15::double * most then 12 else 0 end as font from nd, (select greatest(max(degree), 1) as most from degree)",
    "sink_vault": GRAPH
    + ", l as (select e.id, relationship, '- [[' || label || ']] ' || lower(confidence) as line from ends e join nodes n on e.other = n.id join names on o = confidence_ord), "
    + "p as (select id, relationship, count(*) as n, string_agg(line, chr(10) order by line) as lines from l group by id, relationship), "
    + "b as (select id, string_agg('## ' || relationship || chr(10) || lines, chr(10) || chr(10) order by n desc, relationship) as body from p group by id), "
    + "t as (select label as file, id, '---' || chr(10) || 'id: \"' || id || '\"' || chr(10) || 'type: ' || type || chr(10) || 'community: ' || coalesce(community::varchar, 'none') || chr(10) || 'degree: ' || degree || chr(10) || '---' || chr(10) || '# ' || label || chr(10) || chr(10) || coalesce(body, 'No connections.') || chr(10) as text from nd left join b using (id)) "
    + "select file, sha256(arg_max(text, id)) as text_sha256 from t group by file",
    "incremental_last_changes": EVENTS + "select path, kind from last",
    "incremental_changed": EVENTS + ", k as (select path, sha256(coalesce(content, 'x')) as old from last where sha256(path)[1:1] < '8') select path, sha256(content) as content_hash, case when content is null then 'deleted' when old is null then 'new' else 'changed' end as state from last left join k using (path) where content is null or old is null or old <> sha256(content)",
    "incremental_ticks": EVENTS + ", t as (select date_trunc('hour', ts) as tick, path, max({'ts': ts, 'kind': kind}).kind as kind from e group by 1, 2) select kind, count(*) as n from t group by 1",
}
