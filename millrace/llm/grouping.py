"""Problem 7: splits that keep related records together, by Borůvka-style contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.lineage import cut, keep

# What stands for a missing key, after lower case and trimming.
PLACEHOLDERS = ["", "-", "none", "n/a", "unknown"]

PROVENANCE = "source_group STRING, author STRING"


def clean_key(column):
    """A key without case and outer blanks; null for placeholders."""
    key = F.lower(F.regexp_replace(column, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""))
    return F.when(~key.isin(PLACEHOLDERS), key)


def case_keys(cases: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(case_id, key): each tie of a case, one row per pair.

    Null, blank and placeholder keys tie nothing; provenance that isn't JSON has no keys; rows of adjudications whose
    case isn't in ``cases`` count for nothing; repeats count once. Kinds of keys never mix.
    """
    known = cases.filter("case_id IS NOT NULL").select("case_id", F.from_json("provenance", PROVENANCE).alias("p"))
    own = known.select("case_id", F.explode(F.array(*(F.concat(F.lit(f"{k}:"), clean_key(F.col(f"p.{k}"))) for k in ("source_group", "author")))).alias("key"))
    scene = adjudications.select("case_id", F.concat(F.lit("scenario_id:"), clean_key(F.col("scenario_id"))).alias("key")).filter("key IS NOT NULL")
    scene = scene.join(known.select("case_id"), "case_id", "left_semi")
    return own.filter("key IS NOT NULL").unionByName(scene).distinct()


def spanning_forest(keys: DataFrame, node: str = "case_id", key: str = "key") -> DataFrame:
    """The spanning forest of the bipartite graph of nodes and keys, written as a table: its edges (``node``, ``key``) with the root of their tree.

    Each round every component takes its minimum edge under a total order that changes by round; the picks form trees
    with one mutual pair each, whose smaller end is the root. Pointers are doubled to the roots, edges within a
    component go, parallel edges are merged. A hub is a key with many edges, never a list of pairs; picks are a
    map-side combined minimum. Components halve at least each round. Every round is written to the shared checkpoint folder.
    An empty input has no forest.
    """
    edges = keys.select(F.concat(F.lit("n:"), node).alias("u"), F.concat(F.lit("k:"), key).alias("v"))
    # a key on one node ties nothing
    shared = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("v")
    edges = cut(edges.join(shared, "v", "left_semi").select("u", "v", F.col("u").alias("a"), F.col("v").alias("b")))
    labels = cut(edges.select(F.col("u").alias("vertex")).distinct().withColumn("label", F.col("vertex")))
    forest = edges.select("u", "v").limit(0)
    round_ = 0
    while not edges.isEmpty():
        weight = F.struct(F.xxhash64(F.lit(round_), F.least("a", "b"), F.greatest("a", "b")), F.least("a", "b"), F.greatest("a", "b"))
        both = edges.select("a", "b", "u", "v", weight.alias("w")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "u", "v", weight.alias("w")))
        picks = cut(both.groupBy("a").agg(F.min(F.struct("w", "b", "u", "v")).alias("m")).select("a", "m.b", "m.u", "m.v"))
        other = picks.select(F.col("a").alias("b"), F.col("b").alias("back"))
        hooked = picks.join(other, "b")
        root = (F.col("back") == F.col("a")) & (F.col("a") < F.col("b"))
        forest = forest.unionByName(picks.select("u", "v"))
        pointers = hooked.select(F.col("a").alias("child"), F.when(root, F.col("a")).otherwise(F.col("b")).alias("parent"))
        while True:
            up = pointers.select(F.col("child").alias("parent"), F.col("parent").alias("over"))
            doubled = cut(pointers.join(up, "parent").select("child", F.col("over").alias("parent"), (F.col("over") != F.col("parent")).alias("moved")))
            pointers = doubled.select("child", "parent")
            if doubled.filter("moved").isEmpty():
                break
        labels = labels.join(pointers, labels.label == pointers.child, "left").select("vertex", F.coalesce("parent", "label").alias("label"))
        pa, pb = pointers.toDF("a", "pa"), pointers.toDF("b", "pb")
        merged = edges.join(pa, "a").join(pb, "b").filter("pa <> pb").groupBy("pa", "pb").agg(F.min(F.struct("u", "v")).alias("m"))
        edges = cut(merged.select("m.u", "m.v", F.col("pa").alias("a"), F.col("pb").alias("b")))
        labels = cut(labels)
        round_ += 1
    forest = forest.distinct().join(labels.withColumnRenamed("vertex", "u"), "u")
    forest = keep(forest.select(F.substring("u", 3, 1 << 30).alias(node), F.substring("v", 3, 1 << 30).alias(key), F.substring("label", 3, 1 << 30).alias("root"), F.left("label", F.lit(1)).alias("root_kind")))
    return forest


def forest(cases: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(case_id, key, group_case_id): the persisted spanning forest, an edge a row, with the smallest case_id of its tree as text."""
    trees = spanning_forest(case_keys(cases, adjudications))
    roots = trees.groupBy("root", "root_kind").agg(F.min("case_id").alias("group_case_id"))
    return trees.join(roots, ["root", "root_kind"]).select("case_id", "key", "group_case_id")


def groups(cases: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(case_id, group_case_id) of the cases tied to another, with the smallest case_id of the group as text: the trees of the forest."""
    return forest(cases, adjudications).select("case_id", "group_case_id").distinct()


def tree_sizes(cases: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Per tree of the forest its cases, keys and edges; a tree has an edge less than it has cases and keys."""
    return forest(cases, adjudications).groupBy("group_case_id").agg(F.countDistinct("case_id").alias("n_cases"), F.countDistinct("key").alias("n_keys"), F.count(F.lit(1)).alias("n_edges"))


def together(assigned: DataFrame) -> DataFrame:
    """Per group of two cases or more, its size and the number of splits it is in."""
    return assigned.groupBy("group_case_id").agg(F.count(F.lit(1)).alias("n_cases"), F.countDistinct("target_split").alias("n_splits")).filter("n_cases > 1")


def assign_splits(cases: DataFrame, adjudications: DataFrame, targets: DataFrame, seed: int = 7, large: int = 2000) -> DataFrame:
    """(case_id, group_case_id, target_split) of every case; a case without ties is a group of its own.

    Groups are stratified by size band (powers of two). A group of at least 1/``large`` of all cases goes, largest
    first, to the split that lacks most; there can't be more than ``large`` of these. The others lie, band by band, on
    a line in seeded order and are cut by the shares still open, so no band misses a boundary by more than one group.
    Proportions are normalised to their sum; null or negative ones count as 0. No targets give null splits.
    """
    tied = groups(cases, adjudications)
    every = cases.filter("case_id IS NOT NULL").select("case_id").distinct().join(tied, "case_id", "left")
    every = cut(every.select("case_id", F.coalesce("group_case_id", "case_id").alias("group_case_id")))
    sizes = every.groupBy("group_case_id").agg(F.count(F.lit(1)).alias("size"))
    total = every.count()
    shares = {r.target_split: max(0.0, r.p or 0.0) for r in targets.groupBy("target_split").agg(F.max("proportion").alias("p")).filter("target_split IS NOT NULL").orderBy("target_split").collect()}
    names = list(shares)
    whole = sum(shares.values())
    if not names or not whole:
        return every.withColumn("target_split", F.lit(None).cast("string"))
    want = {k: v / whole * total for k, v in shares.items()}
    is_large = F.col("size") >= max(1.0, total / large)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"group_case_id": [], "size": []})])
        rows = rows.sort_values(["size", "group_case_id"], ascending=[False, True])
        left, out = dict(want), []
        for size in rows["size"]:
            name = max(names, key=lambda k: left[k])
            left[name] -= size
            out.append(name)
        yield pd.DataFrame({"group_case_id": rows.group_case_id.astype("str"), "size": rows["size"].astype("int64"), "target_split": pd.Series(out, dtype="str", index=rows.index)})

    first = cut(sizes.filter(is_large).repartition(1).mapInPandas(deal, "group_case_id STRING, size BIGINT, target_split STRING"))
    dealt = {r.target_split: r.n for r in first.groupBy("target_split").agg(F.sum("size").alias("n")).collect()}
    open_ = {k: max(0.0, want[k] - dealt.get(k, 0)) for k in names}
    rest = sum(open_.values()) or 1.0
    small = sizes.filter(~is_large).select("group_case_id", "size", F.floor(F.log2("size")).cast("int").alias("band"), F.xxhash64(F.lit(seed), "group_case_id").alias("h"))
    small = small.withColumn("bucket", F.shiftrightunsigned("h", 54).cast("int"))
    tallies = small.groupBy("band", "bucket").agg(F.sum("size").alias("n"))  # at most 64 bands of 1,024 buckets
    ahead = Window.partitionBy("band").orderBy("bucket")
    tallies = tallies.select("band", "bucket", (F.sum("n").over(ahead) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("band")).alias("mass"))
    order = Window.partitionBy("band", "bucket").orderBy("h", "group_case_id")
    placed = small.join(F.broadcast(tallies), ["band", "bucket"]).withColumn("at", (F.col("before") + F.sum("size").over(order) - F.col("size") / 2) / F.col("mass"))
    choice, upto = F.lit(names[-1]), 1.0
    for name in reversed(names[:-1]):
        upto = sum(open_[k] for k in names[: names.index(name) + 1]) / rest
        choice = F.when(F.col("at") < upto, F.lit(name)).otherwise(choice)
    second = placed.select("group_case_id", choice.alias("target_split"))
    return every.join(first.select("group_case_id", "target_split").unionByName(second), "group_case_id").select("case_id", "group_case_id", "target_split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split: cases, groups and actual share beside the target."""
    n = assigned.groupBy("target_split").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("case_id") == F.col("group_case_id")).alias("n_groups"))
    n = n.withColumn("actual", F.col("n_cases") / F.sum("n_cases").over(Window.partitionBy()))
    return targets.select("target_split", "proportion").join(n, "target_split", "full")
