"""Validators: each gives an array of error texts, empty if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unfenced

_ITEM = "struct<id:string,label:string,type:string,metadata:map<string,string>>"
_LINK = "struct<source:string,target:string,relation:string,confidence:string,weight:double>"
PAYLOAD = f"struct<nodes:array<{_ITEM}>,edges:array<{_LINK}>>"
#: Most nodes and edges of a payload, and what makes a text suspicious.
MOST_NODES, MOST_EDGES = 50, 100
SUSPICIOUS = r"(?i)<script[^>]*>|</script>|javascript:|on\w+\s*="


def _errors(*tests: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(text)) for t, text in tests]), lambda e: e.isNotNull())


def _blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def url_errors(url: Column) -> Column:
    """Not blank, absolute http or https, and no local or private host."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    private = host.rlike(r"^(localhost|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2\d|3[01])\..*|169\.254\..*|0\.0\.0\.0|\[::1?\]|\[f[cd].*\]|\[fe80.*\])$")
    blank = _blank(url)
    return _errors((blank, "URL is blank"), (~blank & (scheme == ""), "URL is not absolute"), (~blank & (scheme != "") & ~scheme.isin("http", "https"), "URL scheme is not allowed"), (~blank & scheme.isin("http", "https") & (host == ""), "URL has no host"), (private, "URL host is private"))


def path_errors(path: Column, base: str | None = None) -> Column:
    tests = [(_blank(path), "path is blank"), (path.contains("\0"), "path has a NUL"), (path.contains(".."), "path goes up")]
    if base is not None:
        tests.append((~path.startswith(base.rstrip("/") + "/") & (path != base), "path leaves its base"))
    return _errors(*[(F.coalesce(t, F.lit(False)) if k else t, text) for k, (t, text) in enumerate(tests)])


def input_errors(text: Column, limit: int = 1000) -> Column:
    """Not blank, not long, no control characters, at most a tenth of characters of ;'"\\<>&."""
    n = F.length(text)
    odd = n - F.length(F.regexp_replace(text, r"""[;'"\\<>&]""", ""))
    no = lambda c: F.coalesce(c, F.lit(False))
    return _errors((_blank(text), "input is blank"), (no(n > limit), "input is too long"), (no(text.contains("\0")), "input has a NUL"), (no(odd * 10 > n), "input has too many special characters"), (no(text.rlike(r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]")), "input has control characters"))


def extraction_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key, error) of extracted rows: blanks, and ends that no node has if there are nodes at all."""
    n = nodes.select(F.lit("node").alias("kind"), F.coalesce("id", F.lit("")).alias("key"), F.explode(_errors((_blank(F.col("id")), "id is blank"), (_blank(F.col("label")), "label is blank"), (_blank(F.col("source_file")), "source file is blank"))).alias("error"))
    key = F.concat_ws("->", "src", "dst")
    e = edges.select(F.lit("edge").alias("kind"), key.alias("key"), F.explode(_errors((_blank(F.col("src")), "source is blank"), (_blank(F.col("dst")), "target is blank"), (_blank(F.col("relationship")), "relation is blank"), (_blank(F.col("source_file")), "source file is blank"))).alias("error"))
    ids = nodes.where(~_blank(F.col("id"))).select("id").distinct()
    some = ids.limit(1).select(F.lit(1).alias("any"))
    out = n.unionByName(e)
    for end in ("src", "dst"):
        lost = edges.where(~_blank(F.col(end))).join(ids.withColumnRenamed("id", end), end, "left_anti").join(some)
        out = out.unionByName(lost.select(F.lit("edge").alias("kind"), key.alias("key"), F.lit("source is unknown" if end == "src" else "target is unknown").alias("error")))
    return out


def payload(text: Column) -> Column:
    """Nodes and edges of a model's JSON answer, cleaned: null where it can't be read.

    Suspicious or blank entries go, at most MOST_NODES and MOST_EDGES stay, labels are cut to 200, edges need ends
    among the nodes (without case), and weights are held between 0 and 1.
    """
    x = F.from_json(unfenced(text), PAYLOAD)
    bad = lambda c: _blank(c) | c.rlike(SUSPICIOUS)
    nodes = F.slice(F.filter(x["nodes"], lambda n: ~bad(n["id"]) & ~bad(n["label"])), 1, MOST_NODES)
    nodes = F.transform(nodes, lambda n: F.struct(F.trim(n["id"]).alias("id"), F.substring(F.trim(n["label"]), 1, 200).alias("label"), F.coalesce(n["type"], F.lit("Entity")).alias("type"), n["metadata"].alias("metadata")))
    ids = F.transform(nodes, lambda n: F.lower(n["id"]))
    fits = lambda e: ~bad(e["source"]) & ~bad(e["target"]) & F.array_contains(ids, F.lower(F.trim(e["source"]))) & F.array_contains(ids, F.lower(F.trim(e["target"])))
    edges = F.transform(F.slice(F.filter(F.coalesce(x["edges"], F.array().cast(f"array<{_LINK}>")), fits), 1, MOST_EDGES), lambda e: F.struct(F.trim(e["source"]).alias("source"), F.trim(e["target"]).alias("target"), F.coalesce(e["relation"], F.lit("related_to")).alias("relation"), F.coalesce(F.upper(e["confidence"]), F.lit("INFERRED")).alias("confidence"), F.least(F.greatest(F.coalesce(e["weight"], F.lit(1.0)), F.lit(0.0)), F.lit(1.0)).alias("weight")))
    return F.when(x["nodes"].isNotNull(), F.struct(nodes.alias("nodes"), edges.alias("edges")))
