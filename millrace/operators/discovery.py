"""Choosing files: suffixes, ignore patterns with precedence, covered targets, test paths."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of the five languages.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "mts": "typescript", "cts": "typescript", "rs": "rust", "pl": "perl", "pm": "perl", "t": "perl",
}


def language(path: Column) -> Column:
    """The language of a path's suffix, in either case; null for others and for names without a dot."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def glob_regex(pattern: str) -> str:
    """A git-style pattern as a regular expression over a relative path: ``**`` crosses folders, a slash anchors, a trailing one means the folder."""
    folder, pattern = pattern.endswith("/"), pattern.rstrip("/")
    anchored, pattern = "/" in pattern, pattern.lstrip("/")
    out = ""
    for part in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\])", pattern):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, part if part.startswith("[") else re.escape(part))
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last matching pattern excludes the path; ``!`` takes it back in. No match, or a null path, isn't ignored."""
    def step(acc: Column, pattern: str) -> Column:
        back = pattern.startswith("!")
        return F.when(path.rlike(glob_regex(pattern.lstrip("!"))), F.lit(not back)).otherwise(acc)

    return F.coalesce(reduce(step, patterns, F.lit(False)), F.lit(False))


def uncovered(targets: DataFrame, path: str = "path") -> DataFrame:
    """Targets without those below another target: each folder on a path's way up is looked up by equality."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ways = targets.select(path, F.explode(F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))).alias("_up"))
    covered = ways.join(targets.select(F.col(path).alias("_up")).distinct(), "_up", "left_semi").select(path).distinct()
    return targets.select(path).distinct().join(covered, path, "left_anti")


def is_test(path: Column) -> Column:
    """Whether a part of a path is ``test``, ``tests`` or ``__tests__``, or its name is that of a test."""
    name = F.substring_index(path, "/", -1)
    return path.rlike(r"(^|/)(test|tests|__tests__)(/|$)") | F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py")) | F.endswith(name, F.lit(".t")) | F.contains(name, F.lit(".test.")) | F.contains(name, F.lit(".spec."))


def ancestors(path: Column) -> Column:
    """Every folder a path lies in, from the root, which is empty, down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scope_table(spark, scopes: list[tuple[str, list[str]]]) -> DataFrame:
    """(folder, place, pattern, keep) of the ignore lists of folders: each pattern as an expression over paths relative to its folder, ``!`` taking back in."""
    rows = [(folder, i, glob_regex(p.removeprefix("!")), p.startswith("!")) for folder, patterns in scopes for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "folder STRING, place INT, pattern STRING, keep BOOLEAN")


def scoped_ignored(files: DataFrame, scopes: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``ignored``: what the last matching pattern of the deepest folder that has one says; false where none matches.

    Folders on a path's way meet the lists by equality, so lists may be as many as folders; the last match is a map-side combined maximum.
    """
    ways = files.select(path, F.explode(ancestors(F.col(path))).alias("folder")).distinct()
    rows = ways.join(scopes, "folder").withColumn("_rel", F.when(F.col("folder") == "", F.col(path)).otherwise(F.expr(f"substring({path}, length(folder) + 2)")))
    hits = rows.filter(F.regexp_like("_rel", F.col("pattern")))
    last = hits.groupBy(path).agg(F.max_by(~F.col("keep"), F.struct(F.length("folder").alias("l"), "place")).alias("_ignored"))
    return files.join(last, path, "left").withColumn("ignored", F.coalesce("_ignored", F.lit(False))).drop("_ignored")


def choice(path: Column, ignored_: Column, include: list[str], exclude: list[str]) -> Column:
    """Why a file is looked at or not: a suffix of no language, not included, excluded, ignored, or selected."""
    any_of = lambda patterns: reduce(lambda a, p: a | path.rlike(glob_regex(p)), patterns, F.lit(False))
    return F.when(language(path).isNull(), "unknown_suffix").when(~any_of(include) if include else F.lit(False), "not_included").when(any_of(exclude), "excluded").when(ignored_, "ignored").otherwise("selected")


def under(files: DataFrame, targets: DataFrame, path: str = "path") -> DataFrame:
    """The files that are a target or lie under one, by the folders on their way."""
    ways = files.select(path, F.explode(F.concat(ancestors(F.col(path)), F.array(F.col(path)))).alias("_t"))
    return files.join(ways.join(targets.select(F.col("path").alias("_t")).distinct(), "_t", "left_semi").select(path).distinct(), path, "left_semi")
