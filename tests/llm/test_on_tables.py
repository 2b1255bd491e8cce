"""Operators over the smallest tables and small fixtures, against brute force and the limits they must keep."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from millrace.llm import encoding, grouping, handwritten, mixing, overlap, packing, reading, secrets, splitting, syntax


def test_overlap_equals_all_pairs(tables):
    cases = tables["calibration_cases"]
    side, lines, words = {}, {}, {}
    for r in cases.select("case_id", "split", "question_wire", F.map_values("evidence.source_documents").alias("docs")).collect():
        s = re.sub(r"[\s\-_]", "", r.split.lower())
        side[r.case_id] = "dev" if s == "development" else "eval" if s in ("heldout", "validation") else None
        lines[r.case_id] = {x for t in r.docs for x in ("".join(v.split()) for v in t.split("\n")) if x}
        words[r.case_id] = set(re.findall(r"[^\W_]+", json.loads(r.question_wire)["instructions"].lower()))
    near = lambda a, b, t: bool(a | b) and len(a & b) > t * len(a | b)
    want = {tuple(sorted((a, b))) for a in side if side[a] == "dev" for b in side if side[b] == "eval" and near(lines[a], lines[b], 0.5) and near(words[a], words[b], 0.75)}
    assert {tuple(r) for r in overlap.found(cases).collect()} == want


def case(spark, tables, rows):
    """Cases of (id, split, text, question) under the table's schema."""
    schema = tables["calibration_cases"].schema
    blank = {f.name: None for f in schema}
    out = []
    for i, split, text, question in rows:
        out.append(blank | {"case_id": i, "split": split, "question_wire": json.dumps({"instructions": question}), "evidence": {"state": None, "source_documents": {"p": text}}, "provenance": "{}"})
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in out], schema)


def test_overlap_of_hot_copies_and_edges(spark, tables):
    body = "\n".join(f"value_{i} = call({i})" for i in range(20))
    part = "\n".join(f"value_{i} = call({i})" for i in range(10)) + "\n" + "\n".join(f"other_{i}" for i in range(9))
    rows = [(f"d{i}", "Development", body, "Is the value checked before use?") for i in range(6)] + [("e1", "held-out", body + "\nx = 1", "is the VALUE checked before use"), ("e2", " validation", part, "Is the value checked before use?"), ("e3", "heldout", body, "Another question altogether here"), ("e4", "heldout", "", "Is the value checked before use?"), ("e5", None, body, "Is the value checked before use?")]
    got = {tuple(r) for r in overlap.found(case(spark, tables, rows)).collect()}
    assert got == {(f"d{i}", "e1") for i in range(6)}


def test_groups_equal_union_find(tables):
    cases, notes = tables["calibration_cases"], tables["adjudications"]
    parent = {r.case_id: r.case_id for r in cases.select("case_id").collect()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_key = defaultdict(set)
    clean = lambda v: None if v is None or v.strip().lower() in grouping.PLACEHOLDERS else v.strip().lower()
    for r in cases.select("case_id", "provenance").collect():
        for k in ("source_group", "author"):
            if clean(json.loads(r.provenance).get(k)):
                by_key[k, clean(json.loads(r.provenance)[k])].add(r.case_id)
    for r in notes.collect():
        if r.case_id in parent and clean(r.scenario_id):
            by_key["scenario", clean(r.scenario_id)].add(r.case_id)
    for members in by_key.values():
        first = min(members)
        for x in members:
            a, b = sorted((root(first), root(x)))
            parent[b] = a
    groups = defaultdict(list)
    for x in parent:
        groups[root(x)].append(x)
    want = {(x, min(v)) for v in groups.values() if len(v) > 1 for x in v}
    assert {tuple(r) for r in grouping.groups(cases, notes).collect()} == want


def test_a_hub_key_makes_one_group_and_splits_keep_it(spark):
    cases = spark.createDataFrame([(f"c{i:03d}", json.dumps({"author": "Hub " if i < 60 else f"a{i // 2}"})) for i in range(180)], "case_id string, provenance string")
    notes = spark.createDataFrame([], "case_id string, scenario_id string")
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "target_split string, proportion double")
    out = grouping.assign_splits(cases, notes, targets).collect()
    assert len(out) == 180
    assert {r.group_case_id for r in out if r.case_id < "c060"} == {"c000"}
    split = defaultdict(set)
    for r in out:
        split[r.group_case_id].add(r.target_split)
    assert all(len(v) == 1 for v in split.values())
    n = lambda k: sum(r.target_split == k for r in out)
    assert abs(n("train") - 144) <= 2 and abs(n("test") - 18) <= 2
    assert {r.target_split for r in grouping.assign_splits(cases, notes, targets.limit(0)).collect()} == {None}


def test_containers_keep_their_limits(tables):
    packed, limits = packing.pack(tables["budget_estimates"], tables["pack_limits"], shard_rows=64).collect(), {r.model: r for r in tables["pack_limits"].collect()}
    sums = defaultdict(lambda: [0, 0, 0])
    for r in packed:
        for i, v in enumerate((r.body_bytes, r.questions, r.context_tokens)):
            sums[r.model, r.container_id][i] += v
    for (model, _), (b, q, c) in sums.items():
        m = limits[model]
        assert b <= m.max_body_bytes and q <= m.max_questions and c <= m.max_context_tokens
    valid = packing.valid_requests(tables["budget_estimates"]).collect()
    assert {r.request_id for r in packed} == {r.request_id for r in valid}
    whole = {r.request_id: r for r in valid}
    for r in packed:
        m, v = limits[r.model], whole[r.request_id]
        assert r.n_parts == 1 or v.body_bytes > m.max_body_bytes or v.questions > m.max_questions or v.context_tokens > m.max_context_tokens


def test_mix_keeps_caps_and_total(spark):
    docs = spark.createDataFrame([(i, " A " if i < 60 else "b" if i < 90 else "c", "some words of text " * (1 + i % 7)) for i in range(300)] + [(900, None, "x"), (901, "a", None), (902, "a", "")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.2, 2), ("none", 0.0, 4)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(docs, targets, block_tokens=4)
    rows = {r.source: r for r in report.collect()}
    total = encoding.count_tokens(docs.select("doc_id", "text")).agg(F.sum("tokens")).first()[0]
    assert all(r.copies <= {"a": 3, "b": 1, "c": 2}[r.source] for r in chosen.collect())
    assert abs(sum(r.tokens for r in rows.values()) - total) <= 0.03 * total
    assert abs(rows["a"].tokens / total - 0.5) < 0.15 and rows["none"].tokens == 0
    assert mixing.mix(docs, targets.limit(0))[0].count() == 0


def file_rows(spark, tables, rows):
    schema = tables["source_files"].schema
    stamp = datetime(2025, 1, 1)
    return spark.createDataFrame([(i, "/".join(p.split("/")[:2]), p, None, t, None, None, stamp, stamp) for i, (p, t) in enumerate(rows)], schema)


LIBRARY = "\n".join(f"def helper_{i}(value):\n    if value > {i}:\n        return value - {i}\n    return other_{i}(value)\n" for i in range(12))


def test_copies_across_repositories_are_vendored(spark, tables):
    own = LIBRARY.replace("helper", "mine").replace("other", "ours")
    files = file_rows(spark, tables, [("a/x/lib/one.py", LIBRARY), ("b/y/src/two.py", "# note\n" + LIBRARY), ("a/x/src/own.py", own), ("a/x/src/again.py", own), ("c/z/vendor/thing/k.py", own.replace("mine", "else_")), ("a/x/conf.yaml", LIBRARY), ("a/x/null.py", None)])
    got = {r.file_id: r.reason for r in handwritten.not_handwritten(files).collect()}
    assert got == {0: "vendored", 1: "vendored", 4: "vendored"}
    units = spark.createDataFrame([("u0", "a/x/lib/one.py"), ("u2", "a/x/src/own.py"), (None, "a/x/src/own.py")], "unit_id string, path string")
    assert [r.unit_id for r in handwritten.handwritten_units(units, files).collect()] == ["u2"]


def test_pieces_of_units(tables):
    pieces = splitting.split_units(tables["units"], tables["source_files"], tables["size_limits"]).collect()
    text = {r.path: r.content.encode() for r in tables["source_files"].filter("content IS NOT NULL").collect()}
    limits = {r.language: r.max_bytes for r in tables["size_limits"].collect()}
    assert pieces
    for p in pieces:
        assert text[p.path][p.start_byte : p.end_byte].decode() == p.text
        assert p.end_byte - p.start_byte <= max(limits.values())


def test_redaction_leaves_the_rest(tables):
    before = {(r.holder, r.holder_id, r.path): r.text for r in secrets.holders(tables["source_files"], tables["calibration_cases"]).collect()}
    for r in secrets.redacted_texts(tables["source_files"], tables["calibration_cases"]).collect():
        old = before[r.holder, r.holder_id, r.path]
        assert len(old) == len(r.redacted) and old != r.redacted
        assert all(a == b or b == "*" for a, b in zip(old, r.redacted))


def test_invalid_files(spark, tables):
    files = file_rows(spark, tables, [("a/x/ok.py", "x = 1\n"), ("a/x/bad.py", "def f(:\n"), ("a/x/bad.rs", "fn f() { let = 4; }\n"), ("a/x/none.ts", None), ("a/x/empty.js", ""), ("a/x/comment.pl", "# nothing\n"), ("a/x/c.yaml", "{{{"), ("a/x/bom.js", "﻿let a = 1;\n")])
    assert sorted(r.file_id for r in syntax.invalid(files).collect()) == [1, 2]
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid) for r in syntax.rates(files).collect()}
    assert rates["a/x", "python"] == (2, 1) and rates["a/x", "rust"] == (1, 1) and rates["a/x", "perl"] == (1, 0)


def test_ids_of_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello"), (3, "hello")], "doc_id long, text string")
    rows = encoding.encode(df).collect()
    assert [list(r.ids) for r in rows if r.doc_id < 3] == [[], []] and len(rows) == 4
    trip = encoding.roundtrip(df).first()
    assert (trip.n_docs, trip.n_exact) == (4, 4)


def test_levels_without_labels(tables):
    out = reading.levels(tables["documents"], tables["reading_labels"].limit(0))
    assert out.filter("level IS NOT NULL").count() == 0 and out.count() > 0
