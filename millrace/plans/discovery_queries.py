"""Queries of discovery: ignore lists of folders, why files are chosen, targets and changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import discovery
from millrace.sources.tables import table

from .queries import FILES, LANGUAGE_SQL, REGISTRY

# The ignore lists of some folders, the root's first, and what a run includes and excludes.
SCOPES = [
    ("", ["vendor/", "*.min.js", "tests/", "*.cjs"]), ("corvid/monolith", ["lib/", "!tests/", "src/**/*.rs"]), ("corvid/monolith/tests", ["*.pl"]), ("tallow", ["!*.cjs", "generated/"]), ("ostrel/monolith/core", ["*.py", "!*_keeper.py"]),
]
INCLUDE, EXCLUDE = ["*.py", "*.ts", "*.rs", "*.pl", "*.js", "*.cjs"], ["**/generated/**", "internal/"]


def _quoted(text: str) -> str:
    return text.replace("'", "''")


LISTS = "scopes AS (SELECT * FROM (VALUES " + ", ".join(f"('{folder}', {i}, '{_quoted(discovery.glob_regex(p.removeprefix('!')))}', {str(p.startswith('!')).lower()})" for folder, patterns in SCOPES for i, p in enumerate(patterns)) + ") t(folder, place, pattern, keep))"
IGNORED = f"""{FILES}, {LISTS}, hits AS (SELECT f.path, s.keep, s.place, length(s.folder) AS depth FROM (SELECT DISTINCT path FROM files) f JOIN scopes s ON (s.folder = '' OR starts_with(f.path, s.folder || '/')) AND regexp_matches(CASE WHEN s.folder = '' THEN f.path ELSE substr(f.path, length(s.folder) + 2) END, s.pattern)),
ruled AS (SELECT path, NOT arg_max(keep, struct_pack(a := depth, b := place)) AS ignored FROM hits GROUP BY path)"""
ANY = lambda patterns: "(" + " OR ".join(f"regexp_matches(f.path, '{_quoted(discovery.glob_regex(p))}')" for p in patterns) + ")"
WHY = f"CASE WHEN {LANGUAGE_SQL.format('f.path')} IS NULL THEN 'unknown_suffix' WHEN NOT {ANY(INCLUDE)} THEN 'not_included' WHEN {ANY(EXCLUDE)} THEN 'excluded' WHEN coalesce(r.ignored, false) THEN 'ignored' ELSE 'selected' END"


def _paths(spark, d, *columns):
    return table(spark, d, "source_files", "path", *columns).dropDuplicates(["path"])


def _ruled(spark, d):
    return discovery.scoped_ignored(_paths(spark, d), discovery.scope_table(spark, SCOPES))


@REGISTRY.query(f"WITH {IGNORED} SELECT DISTINCT f.path, coalesce(r.ignored, false) AS ignored FROM files f LEFT JOIN ruled r USING (path)")
def ignore_scopes(spark, d):
    return _ruled(spark, d).select("path", "ignored")


@REGISTRY.query(f"WITH {IGNORED} SELECT DISTINCT f.path, {WHY} AS why FROM files f LEFT JOIN ruled r USING (path)")
def file_choice(spark, d):
    return _ruled(spark, d).select("path", discovery.choice(F.col("path"), F.col("ignored"), INCLUDE, EXCLUDE).alias("why"))


TARGETS = "t AS (SELECT DISTINCT CASE WHEN diag_id % 3 = 0 THEN regexp_replace(path, '/[^/]*$', '') WHEN diag_id % 3 = 1 THEN path ELSE path || '.gone' END AS target FROM diagnostics)"


def _asked(spark, d):
    k = F.col("diag_id") % 3
    target = F.when(k == 0, F.regexp_replace("path", "/[^/]*$", "")).when(k == 1, F.col("path")).otherwise(F.concat("path", F.lit(".gone")))
    return table(spark, d, "diagnostics", "diag_id", "path").select(target.alias("path")).distinct()


@REGISTRY.query(f"WITH {FILES}, {TARGETS}, m AS (SELECT t.target, count(f.path) AS n, count(f.content) AS n_readable, bool_or(f.path = t.target) AS is_file FROM t LEFT JOIN (SELECT DISTINCT path, content FROM files) f ON f.path = t.target OR starts_with(f.path, t.target || '/') GROUP BY t.target) SELECT target, CASE WHEN n = 0 THEN 'missing' WHEN n_readable = 0 THEN 'unreadable' WHEN is_file THEN 'file' ELSE 'folder' END AS found, n::BIGINT AS n_files FROM m")
def discover_targets(spark, d):
    files = _paths(spark, d, "content").select("path", F.col("content").isNotNull().alias("readable"))
    ways = files.select(F.explode(F.concat(discovery.ancestors(F.col("path")), F.array("path"))).alias("target"), "path", "readable")
    found = ways.join(_asked(spark, d).select(F.col("path").alias("target")), "target").groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if("readable").alias("ok"), F.max(F.col("path") == F.col("target")).alias("is_file"))
    every = _asked(spark, d).select(F.col("path").alias("target")).join(found, "target", "left")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("ok") == 0, "unreadable").when(F.col("is_file"), "file").otherwise("folder")
    return every.select("target", state.alias("found"), F.coalesce("n", F.lit(0)).alias("n_files"))


@REGISTRY.query(f"WITH {FILES}, {TARGETS}, c AS (SELECT path, max(observed_at) AS seen FROM source_files GROUP BY path) SELECT c.path FROM c WHERE seen >= (SELECT max(observed_at) - INTERVAL 90 DAY FROM source_files) AND EXISTS (SELECT 1 FROM t WHERE c.path = t.target OR starts_with(c.path, t.target || '/'))")
def changed_files(spark, d):
    seen = table(spark, d, "source_files", "path", "observed_at").groupBy("path").agg(F.max("observed_at").alias("at"))
    since = seen.agg(F.max("at") - F.expr("interval 90 days")).scalar()
    return discovery.under(seen.filter(F.col("at") >= since), _asked(spark, d)).select("path")


@REGISTRY.query(rf"WITH {FILES} SELECT file_id, content IS NULL AS unreadable, coalesce(strlen(content), 0) > 2000 AS too_large, coalesce(strlen(content), 0)::BIGINT AS n_bytes, coalesce(position(chr(65533) IN content) > 0, false) AS replaced FROM files WHERE {LANGUAGE_SQL.format('path')} IS NOT NULL")
def bounded_reads(spark, d):
    rows = table(spark, d, "source_files", "file_id", "path", "content").filter(discovery.language(F.col("path")).isNotNull())
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    return rows.select("file_id", F.col("content").isNull().alias("unreadable"), (size > 2000).alias("too_large"), size.cast("bigint").alias("n_bytes"), F.coalesce(F.contains("content", F.lit("�")), F.lit(False)).alias("replaced")).dropDuplicates(["file_id"])
