"""Finding source that bears on a target by name: index, lookup, ranking and fair union."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.spans import called, read

from .discovery import language

def latest_units(units: DataFrame, *columns: str) -> DataFrame:
    """The row of each unit with the greatest scanned_at (null least, ties to the later arrival and the greater span), as a map-side combined maximum."""
    keep = [c for c in columns if c != "unit_id"]
    order = F.struct("scanned_at", "ingested_at", "start_byte", "end_byte")
    return units.groupBy("unit_id").agg(F.max_by(F.struct(*keep), order).alias("u")).select("unit_id", "u.*")


def short_name(name: Column) -> Column:
    """The last segment of a qualified name, whether joined by dots or double colons."""
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def definitions(units: DataFrame) -> DataFrame:
    """(name, path, unit_id) of functions and methods by their short name."""
    rows = latest_units(units, "path", "kind", "qualified_name").filter("kind IN ('function', 'method')")
    return rows.select(short_name(F.col("qualified_name")).alias("name"), "path", "unit_id")


def references(files: DataFrame) -> DataFrame:
    """(path, name, n) of names that are called in a file's code; null content has none. A narrow map: one batch of rows a batch of files."""
    rows = files.filter("content IS NOT NULL").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(path, name, n) for path, text in zip(*(c.to_pylist() for c in batch.columns)) for name, n in Counter(called(text, path)).items()]
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["path", "name", "n"])

    return rows.mapInArrow(run, "path STRING, name STRING, n BIGINT").dropDuplicates(["path", "name"])  # a repeated file gives the same rows again


def repo_of(path: Column) -> Column:
    return F.substring_index(path, "/", 2)


def caller_counts(units: DataFrame, files: DataFrame) -> DataFrame:
    """(unit_id, path, own, near, far, n_calls): in how many other files of its repository and of others a unit's name is called.

    Counts come from aggregates by name and by name and repository, less the unit's own file; pairs of units and callers are never made.
    """
    refs = references(files).withColumn("repo", repo_of(F.col("path")))
    by_repo = refs.groupBy("name", "repo").agg(F.count(F.lit(1)).alias("in_repo"), F.sum("n").alias("calls"))
    by_name = by_repo.groupBy("name").agg(F.sum("in_repo").alias("in_all"), F.sum("calls").alias("calls"))
    d = definitions(units).withColumn("repo", repo_of(F.col("path")))
    rows = d.join(by_name, "name").join(by_repo.drop("calls"), ["name", "repo"], "left").join(refs.select("name", "path", F.col("n").alias("own")), ["name", "path"], "left")
    own, zero = F.col("own").isNotNull().cast("int"), F.lit(0)
    near = F.coalesce("in_repo", zero)
    return rows.select("unit_id", "path", F.col("own").isNotNull().alias("own"), (near - own).alias("near"), (F.col("in_all") - near).alias("far"), (F.col("calls") - F.coalesce("own", zero)).alias("n_calls"))


def candidates(units: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """(unit_id, path, caller, n, family): of the other files that call a unit's name, at least the ``most`` with most calls in its
    repository (``near``) and the ``most`` in others (``far``), ties by path.

    A repository keeps its ``most`` + 1 best callers of a name, and a name the best 2 (``most`` + 1) of these: leaving out one
    repository, or the unit's own file, still leaves the best. So a name defined and called everywhere joins a fixed number of rows to each unit.
    """
    refs = references(files).select("name", F.col("path").alias("caller"), repo_of(F.col("path")).alias("repo"), "n")
    best = [F.desc("n"), F.asc("caller")]
    in_repo = refs.withColumn("_k", F.row_number().over(Window.partitionBy("name", "repo").orderBy(*best))).filter(F.col("_k") <= most + 1).drop("_k")
    in_all = in_repo.withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy(*best))).filter(F.col("_k") <= 2 * (most + 1)).drop("_k")
    d = definitions(units).withColumn("repo", repo_of(F.col("path")))
    near = d.join(in_repo, ["name", "repo"]).filter("path <> caller").select("unit_id", "path", "caller", "n", F.lit("near").alias("family"))
    far = d.join(in_all.withColumnRenamed("repo", "_repo"), "name").filter("repo <> _repo").select("unit_id", "path", "caller", "n", F.lit("far").alias("family"))
    return near.unionByName(far)


def top_candidates(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best callers of each unit: same repository first, then more calls, then the path."""
    w = Window.partitionBy("unit_id").orderBy(F.desc("family"), F.desc("n"), "caller")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def fair_union(pools: DataFrame, key: str, family: str, item: str, order: list) -> DataFrame:
    """Items of several families taken in turn, each once, at its first place: (key, item, place)."""
    turn = F.row_number().over(Window.partitionBy(key, family).orderBy(*order))
    rows = pools.withColumn("_turn", turn)
    first = rows.groupBy(key, item).agg(F.min(F.struct("_turn", family)).alias("_m"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_m._turn"), F.col(f"_m.{family}")))
    return first.select(key, item, place.alias("place"))


def impl_type(name: Column) -> Column:
    """The type an implementation block is for, by its displayed name: without trait, parameters and path."""
    last = F.substring_index(name, " for ", -1)
    return F.substring_index(F.substring_index(F.regexp_replace(last, "^impl ", ""), "<", 1), "::", -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def definition_candidates(units: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """(path, unit_id, rank, n_omitted): of the definitions in the language of a file that go by names called in it, the ``most`` best, and how many others there are.

    The same file comes first, then the same folder, then the shorter, by path and start. Definitions that lie whole within a class, package or
    implementation of the file itself are there already and don't count. A name keeps its best definitions by file, by folder and of
    all, as many as could be among the best of any file, so a name that is defined everywhere joins a fixed number of rows to each caller;
    how many there are comes from counts.
    """
    rows = latest_units(units, "path", "kind", "qualified_name", "start_byte", "end_byte").filter("start_byte >= 0 AND start_byte < end_byte")
    owners = rows.filter("kind IN ('class', 'impl', 'package')").select("path", F.col("start_byte").alias("_s"), F.col("end_byte").alias("_e"))
    d = rows.filter("kind IN ('function', 'method')").select("unit_id", F.col("path").alias("at"), "start_byte", (F.col("end_byte") - F.col("start_byte")).alias("size"), short_name(F.col("qualified_name")).alias("name"), language(F.col("path")).alias("language"))
    inside = d.select("unit_id", F.col("at").alias("path"), "start_byte", (F.col("start_byte") + F.col("size")).alias("_to")).join(owners, "path").filter("_s <= start_byte AND _to <= _e").select("unit_id").distinct().withColumn("held", F.lit(True))
    d = d.join(inside, "unit_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    asks = references(files).select("path", "name", language(F.col("path")).alias("language"))
    # how many: all of the name in the language, less those the file itself holds in an owner
    n_all = d.groupBy("name", "language").agg(F.count(F.lit(1)).alias("n"))
    n_held = d.filter("held").groupBy("name", F.col("at").alias("path")).agg(F.count(F.lit(1)).alias("n_held"))
    totals = asks.join(n_all, ["name", "language"]).join(n_held, ["name", "path"], "left").groupBy("path").agg(F.sum(F.col("n") - F.coalesce("n_held", F.lit(0))).alias("n_matched"))
    short = [F.asc("size"), F.asc("at"), F.asc("start_byte"), F.asc("unit_id")]

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("_k", F.row_number().over(Window.partitionBy("name", "language", *keys).orderBy(*short))).filter(F.col("_k") <= most).drop("_k")

    free = d.filter("NOT held")
    own = asks.join(best(free, "at").withColumnRenamed("at", "path"), ["path", "name", "language"]).withColumn("at", F.col("path"))
    abroad = d.withColumn("near", folder(F.col("at")))
    # other files see held definitions too; a file's own take no place among ``most`` of them where one file's rows are kept besides
    by_file = abroad.withColumn("_f", F.row_number().over(Window.partitionBy("name", "language", "at").orderBy(*short))).filter(F.col("_f") <= most).drop("_f")
    ranked_near = by_file.withColumn("_d", F.dense_rank().over(Window.partitionBy("name", "language", "near").orderBy("size", "at", "start_byte", "unit_id"))).filter(F.col("_d") <= 2 * most).drop("_d")
    ranked_all = by_file.withColumn("_d", F.dense_rank().over(Window.partitionBy("name", "language").orderBy("size", "at", "start_byte", "unit_id"))).filter(F.col("_d") <= 2 * most).drop("_d")
    others = asks.withColumn("near", folder(F.col("path")))
    same_folder = others.join(ranked_near, ["name", "language", "near"]).filter("at <> path")
    anywhere = others.drop("near").join(ranked_all, ["name", "language"]).filter("at <> path")
    cols = ["path", "unit_id", "at", "size", "start_byte"]
    found = own.select(*cols).unionByName(same_folder.select(*cols)).unionByName(anywhere.select(*cols)).distinct()
    place = Window.partitionBy("path").orderBy((F.col("at") != F.col("path")).cast("int"), (folder(F.col("at")) != folder(F.col("path"))).cast("int"), "size", "at", "start_byte", "unit_id")
    top = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most)
    return top.join(totals, "path").select("path", "unit_id", "rank", F.greatest(F.lit(0), F.col("n_matched") - most).alias("n_omitted"))


def local_dependencies(units: DataFrame, files: DataFrame) -> DataFrame:
    """(unit_id, dep_id, hop): declarations of a unit's own file it leads to by the names it calls, and by those these call; none that holds it or lies in it.

    Names, not pairs of units, are joined, within a file.
    """
    rows = latest_units(units, "path", "kind", "qualified_name", "start_byte", "end_byte").filter("kind IN ('function', 'method')")
    one = files.filter("content IS NOT NULL").dropDuplicates(["path"])
    calls = read(rows.select("unit_id", "path", "start_byte", "end_byte"), one, "unit_id").select("unit_id", "path", F.explode(F.array_distinct("calls")).alias("name"))
    calls = calls.join(rows.select("unit_id", "start_byte", "end_byte"), "unit_id")
    defs = rows.select(F.col("unit_id").alias("dep_id"), "path", short_name(F.col("qualified_name")).alias("name"), F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
    apart = "NOT (s <= start_byte AND e >= end_byte) AND NOT (start_byte <= s AND e <= end_byte)"
    first = calls.join(defs, ["path", "name"]).filter(apart).select("unit_id", "path", "start_byte", "end_byte", "dep_id").distinct()
    onward = calls.select(F.col("unit_id").alias("dep_id"), "name")
    seen = calls.select("unit_id", "name")
    names = first.join(onward, "dep_id").select("unit_id", "path", "start_byte", "end_byte", "name").distinct().join(seen, ["unit_id", "name"], "left_anti")
    second = names.join(defs, ["path", "name"]).filter(apart).select("unit_id", "dep_id").distinct()
    hops = first.select("unit_id", "dep_id", F.lit(1).alias("hop")).unionByName(second.select("unit_id", "dep_id", F.lit(2).alias("hop")))
    return hops.groupBy("unit_id", "dep_id").agg(F.min("hop").alias("hop"))
