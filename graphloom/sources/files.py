"""Files and web pages as tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import file_name
from ..functions.text import arxiv_id, paper_document, repository, repository_document, url_file_name, url_kind, web_document, with_contributor
from .graph_json import read_graph
from .listing import list_files, with_content

__all__ = ["detect_files", "listed_files", "read_graph", "texts", "tracked_files", "web_documents"]

# Extensions by category, and language names.
CODE = (".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".rb", ".cs", ".kt", ".scala", ".php", ".swift", ".r", ".lua", ".sh", ".bash", ".ps1", ".yaml", ".yml", ".json", ".toml", ".xml")
DOCUMENTS = (".md", ".txt", ".rst", ".adoc")
MEDIA = (".pdf", ".png", ".jpg", ".jpeg", ".webp", ".gif", ".svg")
LANGUAGES = {
    ".py": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".go": "Go", ".rs": "Rust", ".java": "Java", ".c": "C", ".cpp": "C++", ".h": "C", ".hpp": "C++",
    ".rb": "Ruby", ".cs": "CSharp", ".kt": "Kotlin", ".scala": "Scala", ".php": "PHP", ".swift": "Swift", ".r": "R", ".lua": "Lua", ".sh": "Shell", ".bash": "Shell", ".ps1": "PowerShell",
    ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".toml": "TOML", ".xml": "XML", ".md": "Markdown", ".txt": "Text", ".rst": "ReStructuredText", ".adoc": "AsciiDoc",
    ".pdf": "PDF", ".png": "PNG", ".jpg": "JPEG", ".jpeg": "JPEG", ".webp": "WebP", ".gif": "GIF", ".svg": "SVG",
}


def tracked_files(root: str) -> list[str] | None:
    """Paths that git tracks below root; None if it isn't a repository."""
    run = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, text=True)
    return [p for p in run.stdout.split("\0") if p] if run.returncode == 0 else None


def listed_files(spark: SparkSession, root: str, max_bytes: int = 1 << 20, exclude: tuple[str, ...] = (), extensions: tuple[str, ...] | None = None, tracked: list[str] | None = None) -> DataFrame:
    """(file_path, relative_path, file_name, extension, language, category, size_bytes) of files worth reading; none is opened.

    Hidden files and folders, the folders of listing.SKIPPED, symbolic links, large files, unknown extensions and paths
    that contain an excluded text are left out; folders that are left out aren't listed. tracked: only these relative
    paths. A root that isn't a folder raises FileNotFoundError.
    """
    x = list_files(spark, root).where(F.col("size_bytes") <= max_bytes)
    x = x.withColumn("file_name", file_name(F.col("file_path")))
    x = x.withColumn("extension", F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1)))
    known = [(k, c, LANGUAGES[k]) for c, names in (("Code", CODE), ("Documentation", DOCUMENTS), ("Media", MEDIA)) for k in names]
    kinds = spark.createDataFrame(known, "extension string, category string, language string")
    if extensions is not None:
        x = x.where(F.col("extension").isin(*[e.lower() for e in extensions]))
    for text in exclude:
        x = x.where(~F.contains(F.lower("relative_path"), F.lit(text.lower())))
    if tracked is not None:
        own = spark.createDataFrame([(p.lower(),) for p in tracked], "key string")
        x = x.join(own, F.lower("relative_path") == F.col("key"), "left_semi")
    x = x.join(F.broadcast(kinds), "extension")  # a few dozen rows
    return x.select("file_path", "relative_path", "file_name", "extension", "language", "category", "size_bytes")


def detect_files(spark: SparkSession, root: str, max_bytes: int = 1 << 20, exclude: tuple[str, ...] = (), extensions: tuple[str, ...] | None = None, tracked: list[str] | None = None) -> DataFrame:
    """listed_files() with their content, in order of relative path: only what is left after all filters is opened."""
    return with_content(listed_files(spark, root, max_bytes, exclude, extensions, tracked), root).orderBy("relative_path")


def texts(files: DataFrame) -> DataFrame:
    """(path, language, content) of code files, for extract()."""
    return files.where("category = 'Code'").select(F.col("relative_path").alias("path"), "language", F.decode("content", "UTF-8").alias("content"))


def web_documents(pages: DataFrame, captured_at: Column | None = None, author: str | None = None) -> DataFrame:
    """(url, kind, file, document) of pages (url, html): papers, repositories and other pages as Markdown.

    file is a safe name; a second page with the same name gets _1, a third _2, in order of url. captured_at: text of
    the time of capture, by default now. author: named as contributor. A null html counts as empty.
    """
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if captured_at is None else captured_at
    kind, url = url_kind(F.col("url")), F.col("url")
    page = F.coalesce("html", F.lit(""))
    text = F.when((kind == "arxiv") & (arxiv_id(url) != ""), paper_document(url, page, when)).when((kind == "github") & (repository(url)[0] != ""), repository_document(url, when)).otherwise(web_document(url, page, when))
    x = pages.select("url", kind.alias("kind"), url_file_name(url).alias("base"), (text if author is None else with_contributor(text, author)).alias("document"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("url", "document")) - 1
    file = F.concat("base", F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(".md"))
    return x.select("url", "kind", file.alias("file"), "document")
