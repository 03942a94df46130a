"""Cleaning of HTML, labels, names and quoted text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replace(x: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        x = F.regexp_replace(x, pattern, to)
    return x


def html_label(text: Column, limit: int = 200) -> Column:
    """Without control characters, scripts and tags, trimmed and cut."""
    return F.substring(F.trim(_replace(text, (r"[\x00-\x1F\x7F]", ""), (r"(?is)<script[^>]*>.*?</script>", ""), (r"<[^>]*>", ""))), 1, limit)


def safe_label(text: Column, limit: int = 200) -> Column:
    """Without control characters and tags, cut, and then with HTML's special characters as entities."""
    x = F.substring(_replace(text, (r"[\x00-\x1F\x7F]", ""), (r"<[^>]*>", "")), 1, limit)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


# The patterns by which pages are cleaned and read, in this and the following functions.
def html_to_markdown(html: Column) -> Column:
    """The article's (else main's, else all) text with headings, paragraphs and breaks."""
    x = _replace(html, (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""))
    inner = lambda tag: rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"
    article, main = inner("article"), inner("main")
    x = F.when(x.rlike(article), F.regexp_extract(x, article, 1)).when(x.rlike(main), F.regexp_extract(x, main, 1)).otherwise(x)
    x = _replace(x, (r"(?is)<h1[^>]*>(.*?)</h1>", "\n# $1\n"), (r"(?is)<h2[^>]*>(.*?)</h2>", "\n## $1\n"), (r"(?is)<h3[^>]*>(.*?)</h3>", "\n### $1\n"))
    x = _replace(x, (r"(?is)<p[^>]*>(.*?)</p>", "$1\n\n"), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", " "), (r"[ \t]+", " "), (r"\n\n\n+", "\n\n"))
    return _trimmed(x)


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def html_title(html: Column) -> Column:
    """The first title with white space collapsed; null if there is none or it is blank."""
    x = _trimmed(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.when(x != "", x)


def url_kind(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("arxiv.org"), "arxiv").when(low.contains("github.com"), "github").otherwise("web")


def url_file_name(url: Column, limit: int = 80) -> Column:
    """Host in lower case, path and query, with anything but word characters and dashes as one _, cut."""
    parts = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)"
    x = F.when(url.rlike(parts), F.concat(F.lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2))).otherwise(F.regexp_replace(url, "#.*$", ""))
    x = _replace(x, (r"[^A-Za-z0-9_\-]", "_"), (r"_+", "_"), (r"^_+|_+$", ""))
    return F.substring(x, 1, limit)


def _front(*lines: Column) -> Column:
    """Lines of front matter with a blank line after."""
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body uses it: the variable of a lambda isn't copied into it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def web_document(url: Column, html: Column, captured_at: Column, limit: int = 12_000) -> Column:
    """A page as Markdown with front matter; a longer body is cut and says so."""
    captured = F.concat(F.lit("captured_at: "), captured_at)

    def head(title: Column) -> Column:
        front = _front(F.concat(F.lit("source_url: "), url), F.lit("type: webpage"), F.concat(F.lit("title: "), yaml_quoted(title)), captured)
        return F.concat(front, F.lit("# "), title, F.lit("\n\nSource: "), url, F.lit("\n\n---\n\n"))

    def cut(body: Column) -> Column:
        return F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("\n\n*[Content truncated]*\n"))).otherwise(body)

    return F.concat(let(F.coalesce(html_title(html), url), head), let(html_to_markdown(html), cut))


def paper_fields(html: Column) -> dict[str, Column]:
    """Title, authors and abstract of a paper's page; empty where it has none."""
    clean = lambda p: F.regexp_replace(_trimmed(F.regexp_replace(F.regexp_extract(html, p, 1), "<[^>]+>", "")), r"\s+", " ")
    return {"title": clean(r"(?is)class=\"title[^\"]*\"[^>]*>(.*?)</h1>"), "authors": clean(r"(?is)class=\"authors\"[^>]*>(.*?)</div>"), "abstract": clean(r"(?is)class=\"abstract[^\"]*\"[^>]*>(.*?)</blockquote>")}


def paper_document(url: Column, html: Column, captured_at: Column) -> Column:
    """A paper's page as Markdown: its number, title, authors and abstract."""
    f, number = paper_fields(html), arxiv_id(url)
    title, some = F.when(f["title"] != "", f["title"]).otherwise(number), f["authors"] != ""
    head = _front(F.concat(F.lit("source_url: "), url), F.concat(F.lit("arxiv_id: "), number), F.lit("type: paper"), F.concat(F.lit("title: "), yaml_quoted(title)), F.when(some, F.concat(F.lit("paper_authors: "), yaml_quoted(f["authors"]))), F.concat(F.lit("captured_at: "), captured_at))
    authors = F.when(some, F.concat(F.lit("**Authors:** "), f["authors"], F.lit("\n"))).otherwise("")
    return F.concat(head, F.lit("# "), title, F.lit("\n\n"), authors, F.lit("**arXiv:** "), number, F.lit("\n\n## Abstract\n\n"), f["abstract"], F.lit("\n\nSource: "), url, F.lit("\n"))


def arxiv_id(url: Column) -> Column:
    return F.regexp_extract(url, r"(\d{4}\.\d{4,5})", 1)


def repository(url: Column) -> tuple[Column, Column]:
    """Owner and name of a repository's URL."""
    p = r"github\.com/([^/]+)/([^/]+)"
    return F.regexp_extract(url, p, 1), F.regexp_extract(url, p, 2)


def repository_document(url: Column, captured_at: Column) -> Column:
    owner, name = repository(url)
    head = _front(F.concat(F.lit("source_url: "), url), F.lit("type: github_repo"), F.concat(F.lit("github_owner: "), owner), F.concat(F.lit("github_repo: "), name), F.concat(F.lit("captured_at: "), captured_at))
    return F.concat(head, F.lit("# "), owner, F.lit("/"), name, F.lit("\n\nGitHub Repository: "), url, F.lit("\n\n*Use GitHub API or clone the repository for full code analysis.*\n"))


def with_contributor(document: Column, author: str) -> Column:
    """document with a contributor line at the end of its front matter, and a line feed at its own end."""

    def named(lines: Column) -> Column:
        marks = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) == "---", i + 1)), lambda i: i.isNotNull())

        def at(end: Column) -> Column:
            new = F.concat(F.slice(lines, F.lit(1), end - 1), F.array(F.concat(F.lit("contributor: "), yaml_quoted(F.lit(author)))), F.slice(lines, end, F.size(lines)))
            return F.array_join(F.when(end.isNull(), lines).otherwise(new), "\n")

        return let(F.get(marks, F.lit(1)), at)

    return F.concat(let(F.split(document, "\n", -1), named), F.lit("\n"))


def yaml_quoted(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), x, F.lit('"'))


def cypher_text(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def xml_text(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def cypher_variable(node_id: Column, limit: int = 50) -> Column:
    """A name of letters, digits and _; long ones end in digits of a stable hash."""
    x = _replace(node_id, (r"[^A-Za-z0-9_]", "_"))
    x = F.when(x.rlike("^[A-Za-z_]"), x).otherwise(F.concat(F.lit("n"), x))
    tail = F.lpad(F.pmod(F.xxhash64(node_id), F.lit(1000)).cast("string"), 3, "0")
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - 3), tail)).otherwise(x)


def cypher_label(kind: Column) -> Column:
    x = _replace(kind, (r"[^A-Za-z0-9_]", ""))
    return F.when(x == "", "Node").when(x.rlike("^[0-9]"), F.concat(F.lit("N"), x)).otherwise(x)


def cypher_relationship(name: Column) -> Column:
    x = _replace(F.upper(name), (r"[^A-Z0-9_]", "_"), (r"_+", "_"), (r"^_+|_+$", ""))
    return F.when(x == "", "RELATED_TO").otherwise(x)


def file_stem(label: Column, limit: int = 100) -> Column:
    """A file name without characters that file systems mind."""
    x = F.trim(_replace(label, (r'[\\/:*?"<>|\x00-\x1F]', "_")))
    return F.when(x == "", "unnamed").otherwise(F.substring(x, 1, limit))


def unfenced(text: Column) -> Column:
    """Without a Markdown fence around it."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")


def words_to_tokens(words: Column) -> Column:
    return F.floor(words * 100 / 75).cast("long")


def text_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
