"""Extraction of nodes and edges from source text by a table of rules and one operator."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from ..functions.paths import file_name


def make_id(*parts: Column) -> Column:
    """Non-blank parts joined by _, runs of other characters than letters and digits as one _, lower case."""
    kept = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")), "_")
    return F.lower(F.regexp_replace(F.regexp_replace(kept, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


@dataclass(frozen=True)
class Rule:
    """kind "node": the capture is a node that the file contains; else the relation of an edge to the capture's id.

    tail: what of the capture counts, as (separator, characters to trim first); suffix: put after a node's label.
    """

    language: str
    name: str
    pattern: str
    kind: str = "node"
    suffix: str = ""
    tail: str = ""
    trim: str = ""
    skip: tuple[str, ...] = ()


# What each language's declarations and imports look like.
RULES = (
    Rule("csharp", "using", r"^\s*using\s+([a-zA-Z_][\w.]*)\s*;", "imports", tail="."),
    Rule("csharp", "namespace", r"^\s*namespace\s+([a-zA-Z_][\w.]*)"),
    Rule("csharp", "class", r"^\s*(?:public|private|protected|internal|static|abstract|sealed|partial)*\s*(?:class|interface|struct|record)\s+([a-zA-Z_]\w+)"),
    Rule("csharp", "method", r"^\s*(?:public|private|protected|internal|static|virtual|override|async|abstract)*\s+[\w<>\[\],\s]+\s+([a-zA-Z_]\w+)\s*\(", suffix="()"),
    Rule("python", "import", r"^\s*import\s+([a-zA-Z_][\w.]*)", "imports", tail="."),
    Rule("python", "from", r"^\s*from\s+([a-zA-Z_][\w.]*)\s+import", "imports_from", tail="."),
    Rule("python", "class", r"^\s*class\s+([a-zA-Z_]\w+)"),
    Rule("python", "def", r"^\s*def\s+([a-zA-Z_]\w+)\s*\(", suffix="()"),
    Rule("javascript", "import", r"""^\s*import\s+.*?\s+from\s+["']([^"']+)["']""", "imports_from", tail="/", trim="."),
    Rule("javascript", "class", r"^\s*(?:export\s+)?class\s+([a-zA-Z_]\w+)"),
    Rule("javascript", "function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z_]\w+)\s*\(", suffix="()"),
    Rule("javascript", "arrow", r"^\s*(?:const|let|var)\s+([a-zA-Z_]\w+)\s*=\s*(?:async\s+)?\(", suffix="()"),
    Rule("typescript", "interface", r"^\s*(?:export\s+)?interface\s+([a-zA-Z_]\w+)"),
    Rule("go", "import", r"""^\s*import\s+["']([^"']+)["']""", "imports", tail="/"),
    Rule("go", "type", r"^\s*type\s+([a-zA-Z_]\w+)\s+(?:struct|interface)"),
    Rule("go", "func", r"^\s*func\s+(?:\([^)]*\)\s+)?([a-zA-Z_]\w+)\s*\(", suffix="()"),
    Rule("java", "import", r"^\s*import\s+([a-zA-Z_][\w.]*)\s*;", "imports", tail="."),
    Rule("java", "class", r"^\s*(?:public|private|protected|abstract|final)*\s*(?:class|interface|enum)\s+([a-zA-Z_]\w+)"),
    Rule("java", "method", r"^\s*(?:public|private|protected|static|final|abstract|synchronized)*\s+[\w<>\[\],\s]+\s+([a-zA-Z_]\w+)\s*\(", suffix="()"),
    Rule("rust", "use", r"^\s*use\s+([a-zA-Z_][\w:]*)", "imports", tail="::", trim="{}"),
    Rule("rust", "struct", r"^\s*(?:pub\s+)?struct\s+([a-zA-Z_]\w+)"),
    Rule("rust", "trait", r"^\s*(?:pub\s+)?trait\s+([a-zA-Z_]\w+)"),
    Rule("rust", "fn", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+([a-zA-Z_]\w+)\s*[<(]", suffix="()"),
    Rule("c", "include", r"""^\s*#include\s+[<"]([^>"]+)[>"]""", "imports", tail="/", trim=""),
    Rule("c", "function", r"^\s*(?:static\s+)?(?:inline\s+)?(?:extern\s+)?[\w\s*]+\s+([a-zA-Z_]\w+)\s*\([^)]*\)\s*\{", suffix="()", skip=("if", "while", "for", "switch", "return")),
    Rule("cpp", "class", r"^\s*(?:class|struct)\s+([a-zA-Z_]\w+)"),
)
#: Languages that have another's rules too, and other names of languages.
BASES = {"typescript": ("javascript",), "cpp": ("c",)}
NAMES = {"c#": "csharp", "c++": "cpp"}


def rules_of(language: str) -> list[Rule]:
    names = (*BASES.get(language, ()), language)
    return [r for name in names for r in RULES if r.language == name]


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules of each language as rows; a few dozen, so joins may broadcast it."""
    rows = [(lang, k, r.pattern, r.kind, r.name, r.suffix, r.tail, r.trim, list(r.skip)) for lang in sorted({r.language for r in RULES}) for k, r in enumerate(rules_of(lang))]
    return spark.createDataFrame(rows, "language string, rule int, pattern string, kind string, rule_name string, suffix string, tail string, trim string, skip array<string>")


def with_matches(df: DataFrame) -> DataFrame:
    """df (content, pattern) with a row for each match: raw, its first group, and line.

    A line counts from 1 and is where the match, with its leading blank lines, starts: the n matches lie between
    n + 1 gaps, and a match starts after all gaps and matches before it.
    """
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    flagged = F.concat(F.lit("(?mdU)"), "pattern")
    x = df.withColumn("texts", F.regexp_extract_all("content", flagged, F.lit(1))).where(F.size("texts") > 0)
    x = x.withColumn("whole", F.regexp_extract_all("content", F.concat(F.lit("(?mdU)("), "pattern", F.lit(")")), F.lit(1))).withColumn("gaps", F.expr("split(content, concat('(?mdU)', pattern), -1)"))
    x = x.withColumn("steps", F.zip_with(F.slice("gaps", 1, F.size("texts")), "whole", lambda g, w: F.struct(breaks(g).alias("g"), breaks(w).alias("w"))))
    x = x.select("*", F.posexplode("texts").alias("at", "raw"))
    line = F.aggregate(F.slice("steps", F.lit(1), F.col("at")), F.lit(1), lambda acc, t: acc + t["g"] + t["w"]) + F.get("steps", F.col("at"))["g"]
    return x.withColumn("line", line).drop("texts", "whole", "gaps", "steps", "at")


def _last() -> Column:
    """What of an import's capture names the thing imported."""
    t = F.col("raw")
    for sep, pattern in ((".", r"\."), ("/", "/"), ("::", "::")):
        t = F.when(F.col("tail") == sep, F.element_at(F.split(F.col("raw"), pattern), -1)).otherwise(t)
    first = F.element_at(F.split(F.regexp_replace(t, r"^\.+", ""), r"\."), 1)
    stem = F.regexp_replace(t, r"\.[^.]*$", "")
    return F.trim(F.when(F.col("trim") == ".", first).when(F.col("rule_name") == "include", stem).when(F.col("trim") == "{}", F.regexp_replace(t, "[{}]", "")).otherwise(t))


def table_function(find: Callable[[str, str], Iterable[tuple[str, str, str, int]]]) -> UserDefinedTableFunction:
    """A hook for extract(): find gives (kind, raw, label, line) for a file's path and content.

    kind "node": raw is a name that the file contains; else the relation of an edge to the id of label.
    """

    class Found:
        def eval(self, path: str, content: str):
            yield from find(path, content)

    return F.udtf(Found, returnType="kind string, raw string, label string, line int", useArrow=True)


def extract(files: DataFrame, hooks: dict[str, UserDefinedTableFunction] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of (path, language, content), in the shape that build() takes.

    Each file is a node named after its stem; unknown languages give nothing. Names of languages count without case.
    hooks: by language, table functions from (path, content) to (kind, raw, label, line), such as table_function()
    makes; a lateral join runs them beside the rules, and a language may have both.
    """
    hooks = {k.lower(): f for k, f in (hooks or {}).items()}
    lang = F.lower("language")
    for name, key in NAMES.items():
        lang = F.when(F.lower("language") == name, key).otherwise(lang)
    rules = rule_table(files.sparkSession)
    known = sorted({r.language for r in RULES} | set(hooks))
    src = files.select("path", lang.alias("language"), F.coalesce("content", F.lit("")).alias("content")).where(F.col("language").isin(*known))
    name = file_name(F.col("path"))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    src = src.withColumn("stem", stem).withColumn("file_id", make_id(F.col("stem")))
    hits = with_matches(src.join(F.broadcast(rules), "language")).where(~F.array_contains("skip", F.col("raw")))
    hits = hits.withColumn("label", F.when(F.col("kind") == "node", F.concat("raw", "suffix")).otherwise(_last())).where("label <> ''")
    found_cols = ["path", "stem", "file_id", "kind", "raw", "label", "line", "rule"]
    hits = hits.select(*found_cols)
    for k, (language, hook) in enumerate(sorted(hooks.items())):
        own_files = src.where(F.col("language") == language)
        more = own_files.lateralJoin(hook(F.col("path").outer(), F.col("content").outer())).where("raw is not null and label <> ''")
        hits = hits.unionByName(more.withColumn("rule", F.lit(1000 + k)).select(*found_cols))
    node_id = make_id(F.col("stem"), F.col("raw"))
    place = F.format_string("L%d", "line")
    ord_ = F.col("rule").cast("long") * 1_000_000 + F.col("line")
    base = {"file_type": F.lit("Code"), "metadata": F.lit(None).cast("map<string,string>")}
    own = src.select(F.col("file_id").alias("id"), name.alias("label"), base["file_type"].alias("file_type"), F.col("path").alias("source_file"), F.lit("L1").alias("source_location"), base["metadata"].alias("metadata"), F.lit(-1).cast("long").alias("ord"))
    found = hits.where("kind = 'node'").select(node_id.alias("id"), "label", base["file_type"].alias("file_type"), F.col("path").alias("source_file"), place.alias("source_location"), base["metadata"].alias("metadata"), ord_.alias("ord"))
    target = F.when(F.col("kind") == "node", node_id).otherwise(make_id(F.col("label")))
    edges = hits.select(F.col("file_id").alias("src"), target.alias("dst"), F.when(F.col("kind") == "node", "contains").otherwise(F.col("kind")).alias("relationship"), F.lit(1.0).alias("weight"), F.lit(0).cast("tinyint").alias("confidence_ord"), F.col("path").alias("source_file"), place.alias("source_location"), ord_.alias("ord"))
    return own.unionByName(found), edges
