"""Predicates and projections over labels and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of code in labels and paths, of papers and of images.
CODE_EXTENSIONS = ("py", "ts", "tsx", "js", "go", "rs", "java", "rb", "cpp", "c", "h", "cs", "kt", "scala", "php")
PAPER_EXTENSIONS = ("pdf",)
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif", "svg")


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(normal_path(path), "/"), -1)


def is_file_label(label: Column) -> Column:
    """Names of files, of methods that start with a dot, and of bare functions."""
    parts = F.split(label, r"\.")
    named = (F.size(parts) > 1) & F.element_at(parts, -1).isin(*CODE_EXTENSIONS)
    call = label.endswith("()")
    return named | (label.startswith(".") & call) | (call & ~label.contains("."))


def is_concept(path: Column) -> Column:
    """No path, or one whose file name has no dot."""
    path = F.coalesce(path, F.lit(""))
    return (path == "") | ~file_name(path).contains(".")


def path_category(path: Column) -> Column:
    name = file_name(path)
    ext = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    return F.when(ext.isin(*CODE_EXTENSIONS), "code").when(ext.isin(*PAPER_EXTENSIONS), "paper").when(ext.isin(*IMAGE_EXTENSIONS), "image").otherwise("doc")


def top_dir(path: Column) -> Column:
    return F.element_at(F.split(normal_path(path), "/"), 1)


def truncated(text: Column, n: int) -> Column:
    """At most n characters; a cut text ends in three dots."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def rounded(x: Column, digits: int = 2) -> Column:
    """To even on the scaled double."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def percent(part: Column, whole: Column) -> Column:
    return F.rint(part * 100.0 / F.greatest(whole, F.lit(1))).cast("int")
