"""Core operators against small fixtures and, where SQL expresses them, against the SQL over the smallest tables."""

from __future__ import annotations

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import spans
from millrace.functions.assessment import assess, policies
from millrace.operators import accounting, compatibility, discovery, evidence, folds, packing, planning, retrieval, routing, search, services
from millrace.plans import calibration_queries, discovery_queries, planning_queries, protocol_queries  # noqa: F401  (each adds its queries)
from millrace.plans.catalogue import rule_policies, rules
from millrace.plans.evidence_queries import abbreviated_signatures
from millrace.plans.queries import REGISTRY
from millrace.plans.shipping import ship
from millrace.sources import jsonl
from millrace.sources.frontend import parse, parsed


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        name = path.rsplit("/", 1)[-1][:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    say = lambda v: f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)
    return sorted(tuple(say(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_equals_sql(name, spark, data, duck):
    df = REGISTRY.queries[name](spark, data)
    result = duck.execute(REGISTRY.sql[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert shown(df.columns, [tuple(r) for r in df.collect()]) == shown(columns, result.fetchall())


ANSWER = "struct<type:string,noul:double,choice:string,score:double,confidence:double,probabilities:map<string,double>>"
TABLE = [
    # score policy: warning 1 at confidence .6, error 2 at .7
    (("score", None, None, 0.9, 0.4, {}), True, "unknown", "low_confidence", None), (("score", None, None, 1.0, 0.59, {}), True, "unknown", "low_confidence", "warning"), (("score", None, None, 1.0, 0.6, {}), True, "warning", None, None),
    (("score", None, None, 2.0, 0.69, {}), True, "unknown", "low_confidence", "error"), (("score", None, None, 2.0, 0.7, {}), True, "error", None, None), (("score", None, None, 0.2, 0.9, {}), True, "ok", None, None), (("score", None, None, 0.2, 0.9, {}), False, "unknown", "reduced_context", None),
    (("boolean", 0.95, None, None, None, {}), True, "error", None, None), (("boolean", 0.5, None, None, None, {}), True, "unknown", "probability_ambiguous", None), (("boolean", 0.6, None, None, None, {}), True, "ok", None, None), (("boolean", None, None, None, None, {}), True, "ok", None, None),
    (("choice", None, "unclear", None, 0.99, {"unclear": 0.95}), True, "unknown", "missing_evidence", None), (("choice", None, "lost", None, 0.9, {"lost": 0.95}), True, "error", None, None), (("choice", None, "lost", None, 0.5, {"lost": 0.95}), True, "unknown", "low_confidence", "error"),
    (("choice", None, "lost", None, 0.9, {"lost": 0.5}), True, "unknown", "low_choice_probability", None), (("choice", None, "kept", None, 0.9, {"kept": 0.9}), True, "ok", None, None), (("choice", None, "kept", None, None, {"kept": 0.9}), True, "ok", None, None), (("score", None, None, 0.2, None, {}), True, "ok", None, None), (("score", None, None, 1.2, None, {}), True, "unknown", "low_confidence", "warning"),
]


def test_decision_table(spark):
    rows = [(i, a, complete) for i, (a, complete, *_) in enumerate(TABLE)]
    df = spark.createDataFrame(rows, f"i int, answer {ANSWER}, context_complete boolean")
    policy = policies(spark).select("type", F.struct("*").alias("policy"))
    got = {r.i: r.o for r in df.join(policy, F.col("answer.type") == F.col("type")).select("i", assess().alias("o")).collect()}
    for i, (_, _, status, reason, tentative) in enumerate(TABLE):
        assert (got[i].status, got[i].reason, got[i].tentative) == (status, reason, tentative), TABLE[i]


def test_spans(spark):
    df = spark.createDataFrame([("a", s, e) for s, e in [(0, 5), (5, 9), (12, 15), (1, 3), (14, 20), (7, 7), (9, 2), (None, 3)]], "k string, start_byte long, end_byte long")
    merged = spans.merge_spans(df, "k")
    assert sorted((r.start_byte, r.end_byte) for r in merged.collect()) == [(0, 9), (12, 20)]
    sizes = spark.createDataFrame([("a", 25), ("b", 4)], "k string, size long")
    assert sorted(tuple(r) for r in spans.gaps(merged, sizes, "k", "size").collect()) == [("a", 9, 12), ("a", 20, 25), ("b", 0, 4)]
    files = spark.createDataFrame([("a.py", "aé\nb(c)  # d(e)\n"), ("e.py", ""), ("n.py", None)], "path string, content string")
    asked = spark.createDataFrame([("whole", "a.py", 0, 17), ("cut", "a.py", 2, 5), ("reversed", "a.py", 5, 2), ("beyond", "a.py", 0, 99), ("none", "n.py", 0, 1), ("null", "a.py", None, 3)], "unit_id string, path string, start_byte long, end_byte long")
    got = {r.unit_id: (r.first_line, r.last_line, r.starts_whole, r.ends_whole, r.calls) for r in spans.read(asked, files, "unit_id").collect()}
    assert got == {"whole": (1, 2, True, True, ["b"]), "cut": (1, 2, False, True, [])}
    held = spark.createDataFrame([("a", "p", 0, 10), ("b", "p", 0, 10), ("c", "p", 2, 5), ("d", "p", 4, 12), ("e", "q", 0, 9), ("f", "p", 3, 3)], "unit_id string, path string, start_byte long, end_byte long")
    assert {r.unit_id: r.n_inside for r in spans.n_inside(held, "path").collect()} == {"a": 2, "b": 2, "c": 0, "d": 0, "e": 0}


RECORD = f"case_id string, rule_id string, split string, label string, adjudicated_severity string, answer {ANSWER}, context_complete boolean, support string"


def _boolean(values):
    return [(f"c{i}", "QRY13", "development", label, None, ("boolean", p, None, None, None, {}), True, f"g{group}") for i, (p, label, group) in enumerate(values)]


def test_candidates_are_the_observed_values(spark):
    seen = [(k / 1250, "Agree" if k % 3 else "Disagree", k) for k in range(1, 1250)]
    df = spark.createDataFrame(_boolean(seen), RECORD)
    policies = rule_policies(spark).filter("rule_id = 'QRY13'")
    tried = {r.place: r for r in search.candidates(df, policies).collect()}
    assert tried[0].warning_p == 0.71 and {r.warning_p for r in tried.values()} == {p for p, *_ in seen if p <= 0.9} | {0.0, 0.71, 0.9}
    assert not any(r.truncated for r in tried.values())
    few = search.candidates(df, policies, 9).collect()
    assert len(few) == 4 and all(r.truncated for r in few) and all(abs(r.warning_p - 0.71) < 0.01 for r in few)  # half of the limit, the baseline among them
    assert search.candidates(df.limit(0), policies).count() > 0 and search.dimensions(df.limit(0), policies.limit(0)).count() == 0


def test_choice_of_a_candidate(spark):
    policies = rule_policies(spark).filter("rule_id = 'QRY13'")

    def choose(values, **kw):
        df = spark.createDataFrame(_boolean(values), RECORD)
        tried = search.candidates(df, policies)
        return search.choose(search.metrics(df, policies, tried), tried, policies, **kw).first()

    won = choose([(0.65, "Agree", 1), (0.66, "Agree", 2), (0.3, "Disagree", 3)])
    assert (won.reason, won.warning_p, won.objective, won.baseline_objective) == ("selected", 0.65, 8.0, -8.0)
    tie = choose([(0.95, "Agree", 1), (0.1, "Disagree", 2)])
    assert (tie.reason, tie.place) == ("selected", 0)
    assert choose([(0.95, "Agree", 1)]).reason == "insufficient_labeled_support"
    # a group with many cases weighs as much as one with a single case
    grouped = choose([(0.75, "Agree", 1)] * 1 + [(0.75, "Disagree", 2)] * 9 + [(0.8, "Agree", 3)])
    assert grouped.baseline_objective == 4 - 8 + 4


def test_conflicts_and_authority(spark):
    rows = spark.createDataFrame([("a", "x", "m"), ("a", "x", "n"), ("b", None, "m"), ("b", "y", "m")], "k string, q string, m string")
    assert {(r.k, r.field): r.n for r in compatibility.conflicts(rows, "k", {"q": "q", "m": "m"}).collect()} == {("a", "q"): 1, ("a", "m"): 2, ("b", "q"): 1, ("b", "m"): 1}
    case = lambda i, split, model, version: (i, "r", split, model, (version, "p"))
    cases = spark.createDataFrame([case("1", "development", " ", 3), case("2", "development", "m", 3), case("3", "Held-Out", "n", 3), case("4", "heldout", "m", 0)], "case_id string, rule_id string, split string, returned_model string, prompt struct<version:int,policy:string>")
    checked = compatibility.check(cases)
    assert {(r.case_id, r.field) for r in checked.filter("actual <> expected OR actual IS NULL").collect()} == {("1", "returned_model"), ("3", "returned_model"), ("4", "prompt.version")}
    assert {r.split: r.reason for r in compatibility.reasons(checked, "fit").collect()} == {"development": "fit_compatibility_metadata_missing", "heldout": "fit_compatibility_metadata_missing"}


def test_running_and_folds(spark):
    df = spark.createDataFrame([("k" if i % 3 else "l", i, float(i % 7)) for i in range(500)], "k string, t long, v double")
    got = {(r.k, r.t): (r.s, r.m) for r in folds.running(folds.running(df, "k", ["t"], F.col("v"), "s"), "k", ["t"], F.col("v"), "m", "min").collect()}
    for k in ("k", "l"):
        total, least = 0.0, 9.0
        for i in range(500):
            if ("k" if i % 3 else "l") == k:
                total, least = total + i % 7, min(least, i % 7)
                assert got[k, i] == (total, least)


def test_rules_and_targets(spark):
    errors = planning.rule_errors(rule_policies(spark))
    assert {(r.rule_id, r.error) for r in errors.collect()} == {("QRY15", "range")}
    chosen = planning.selected(rules(spark), spark.createDataFrame([("design", True), ("state", False)], "ruleset string, enabled boolean"), ["ALL"], ["file-purpose"])
    assert {r.rule for r in chosen.collect()} == {"mixed-duties", "incohesive-owner"}
    assert planning.selected(rules(spark), spark.createDataFrame([("design", True)], "ruleset string, enabled boolean"), [], []).count() == 0


def test_packing_by_violations(spark):
    rows = [("g", f"q{i}", n * 3, n, 30) for i, n in enumerate([40, 50, 60, 20])] + [("h", f"q{i}", 30, 10, 9_000) for i in range(5)]
    df = spark.createDataFrame(rows, "gid string, check_id string, bytes long, tokens long, state long")
    got = planning.pack(df, "gid", ["check_id"], "state", 0, 612, 632, 10_000, 2)
    batches = {k: [r.batch for r in got.filter(f"gid = '{k}'").orderBy("check_id").collect()] for k in "gh"}
    assert batches == {"g": [0, 0, 1, 1], "h": [0, 0, 1, 1, 2]}  # the evidence of h is too large itself: its questions are counted out


def test_routing_and_answers(spark):
    score = lambda n, s: F.struct(F.lit(n).alias("name"), F.lit(s).alias("score"))
    scores = F.array(score("tests", 0.9), score("callers", 0.9), score("definitions", 0.2))
    go = lambda c, k: spark.range(1).select(routing.routing(F.lit(c), F.lit(k), F.lit(0.9), scores, 0.5, 0.5, 0.5).alias("r")).first().r
    assert tuple(go("local_evidence", 0.9)) == ("local_evidence", ["callers", "tests"]) and tuple(go("local_evidence", 0.1)) == (None, []) and tuple(go("sufficient", 0.9)) == ("sufficient", [])
    df = spark.createDataFrame([(0, ("choice", None, "z", None, 0.5, {"a": 1.5})), (1, ("boolean", 0.5, None, None, None, {})), (2, ("score", None, None, 2.0, 0.4, {"a": 0.1, "b": 0.2}))], f"i int, answer {ANSWER}")
    errors = {r.i: r.e for r in df.select("i", routing.answer_errors("answer", F.array(F.lit("a"), F.lit("b"))).alias("e")).collect()}
    assert errors == {0: ["choice", "labels", "range"], 1: [], 2: ["score"]}
    judged = spark.range(1).select(accounting.offline_answer(F.lit("choice"), F.array(F.lit("x"), F.lit("y"))).alias("a")).first().a
    assert (judged.choice, judged.confidence, judged.probabilities) == ("x", 1.0, {"x": 1.0, "y": 0.0})
    assert spark.range(1).select(retrieval.impl_type(F.lit("impl Display for a::Reader<T>"))).first()[0] == "Reader"


def test_signatures_are_cut_above_1024_only(spark, data):
    texts = ["def f():", "é" * 61, "x" * 1024, "y" * 1025]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(evidence.abbreviated(F.col("t")).alias("s")).collect()]
    assert got == [*texts[:3], "y" * 1024 + " [signature abbreviated]"]
    whole = {r.signature for r in spark.read.parquet(f"{data}/units.parquet").select("signature").collect()}
    shown = [r.signature for r in abbreviated_signatures(spark, data).collect()]
    assert max(map(len, shown)) > 60 and set(shown) <= whole


def test_next_fit(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([4, 5, 3, 7, 2, 9])], "g string, o long, s long")
    assert [r.batch for r in packing.next_fit(df, "g", "o", "s", 10).orderBy("o").collect()] == [0, 0, 1, 1, 2, 3]
    assert packing.next_fit(df.limit(0), "g", "o", "s", 10).count() == 0


def test_discovery(spark):
    paths = ["tests/a.py", "tests/x/b.rs", "src/vendor/c.py", "src/d.min.js", "src/e.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = df.filter(~discovery.ignored(F.col("path"), ["tests/", "vendor/", "*.min.js", "!tests/**/*.rs"]))
    assert sorted(r.path for r in kept.collect()) == ["src/e.py", "tests/x/b.rs"]
    targets = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("c/d/e.py",), ("c/d",)], "path string")
    assert sorted(r.path for r in discovery.uncovered(targets).collect()) == ["a", "ab", "c/d"]


def test_services(spark):
    df = spark.createDataFrame([("u", 1, 60.0), ("u", 2, 60.0), ("u", 3, 10.0), ("v", 1, 5.0)], "k string, t long, c double")
    assert sorted((r.k, r.t) for r in services.ledger(df, "k", ["t"], "c", 100).collect()) == [("u", 1), ("v", 1)]
    assert [(r.k, r.t) for r in services.breaker(df, ["k"], ["t"], 3).collect()] == [("u", 3)]
    assert sorted((r.k, r.t) for r in services.latest(df, ["k"], ["t"]).collect()) == [("u", 3), ("v", 1)]


def _units(path, text):
    return {(u["qualified_name"], u["kind"], u["has_implementation"], text.encode()[u["start_byte"] : u["end_byte"]].decode().split("\n")[0]) for u in parse(path, text) if u["record"] == "unit"}


def test_frontend():
    assert _units("a.py", "x = 'é'\nclass A:\n    def f(self):\n        \'\'\'x\'\'\'\n    def g(self):\n        if x:\n            return 1\ndef h(): pass\n") == {("A", "class", False, "class A:"), ("A.f", "method", False, "def f(self):"), ("A.g", "method", True, "def g(self):"), ("h", "function", False, "def h(): pass")}
    js = "// é } {\nexport class B extends A {\n  x = { y: [1] };\n  async m(a, b = '}') {\n    return this.n(a); }\n  get n() { return `}`; }\n}\nconst f = (a) => {\n  g(a); };\nfunction k() {}\n"
    assert _units("a.js", js) == {("B", "class", False, "export class B extends A {"), ("B.m", "method", True, "async m(a, b = '}') {"), ("B.n", "method", True, "get n() { return `}`; }"), ("f", "function", True, "const f = (a) => {"), ("k", "function", False, "function k() {}")}
    rust = "pub struct S<'a> { x: &'a str }\nimpl<'a> S<'a> {\n  pub fn new(c: char) -> Self { let q = '{'; helper(c) }\n}\nfn helper(c: char) {}\n"
    assert {x[:2] for x in _units("a.rs", rust)} == {("S", "struct"), ("S<'a>", "impl"), ("S<'a>::new", "method"), ("helper", "function")}
    perl = "package A::B;\nsub f { my $s = '}'; g($s); }\n# }\npackage C;\nsub h { 1 }\n"
    assert {x[:2] for x in _units("a.pm", perl)} == {("A::B", "package"), ("A::B::f", "method"), ("C", "package"), ("C::h", "method")}
    calls = {(r["name"], r["parent_id"]) for r in parse("a.js", js) if r["record"] == "reference"}
    assert calls == {("n", f"a.js:{js.encode().index(b'async')}:method"), ("g", f"a.js:{js.encode().index(b'const f')}:function")}
    assert [(r["record"], r["kind"], r["start_line"]) for r in parse("a.js", "f(\n")] == [r for r in [("diagnostic", "syntax-error", 1)]]
    assert [r["kind"] for r in parse("a.py", "def f(")] == ["syntax-error"] and list(parse("a.txt", "x")) == [] and [r["kind"] for r in parse("a.py", "def f(): 1\ndef g(): 2\n", 1)] == ["unit-limit"]


def test_parsed_files(spark):
    df = spark.createDataFrame([("a.py", "import os\ndef f(): g()\n"), ("a.py", "import os\ndef f(): g()\n"), ("b.rs", None), ("c.js", "x" * 99), ("d.md", "x"), (None, "x"), ("e.pl", "")], "path string, content string")
    got = sorted((r.path, r.record, r.kind or r.name or r.signature) for r in parsed(df, max_bytes=50).collect())
    assert got == [("a.py", "import", "import os"), ("a.py", "reference", "g"), ("a.py", "unit", "function"), ("b.rs", "diagnostic", "unreadable"), ("c.js", "diagnostic", "size-limit")]
    assert parsed(df.limit(0)).count() == 0


def test_jsonl_round_trip(spark, data, tmp_path):
    cases = spark.read.parquet(f"{data}/calibration_cases.parquet").select("case_id", "rule_id", "answer", "label")
    jsonl.write_cases(cases, str(tmp_path / "cases"))
    again = jsonl.read_cases(spark, str(tmp_path / "cases"), cases.schema)
    key = lambda df: sorted((r.case_id, r.label, r.answer.noul) for r in df.collect() if r.answer.noul is not None)
    assert key(again) == key(cases)


def test_faults_of_json_lines(spark, tmp_path):
    schema = spark.createDataFrame([], "case_id string, n int").schema
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text('{"case_id": "1", "n": 1}\n\n{"case_id": "2", "n": "many"}\n{"case_id": "3", "m": 1}\n{"case_id": "1"}\n[1]\nnull\n{"case_id": "4"}\n')
    got = {(r.line_no, r.error) for r in jsonl.faults(spark, str(tmp_path / "x"), schema).collect()}
    assert got == {(2, "empty"), (3, "invalid"), (4, "unknown_field"), (5, "duplicate"), (6, "invalid"), (7, "invalid")}


def test_stream_equals_batch(spark, data):
    got = REGISTRY.queries["stream_summary"](spark, data)
    last = spark.read.parquet(f"{data}/events.parquet").agg(F.max("ts")).first()[0]
    assert got.agg(F.max("since")).first()[0] < last and got.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    ship(spark)
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_recovery_comes_to_an_end(spark):
    from millrace.operators import recovery

    row = lambda e, i, tokens, size, state, bare: (e, "unit", "p", f"q{i}", tokens, size, state, bare)
    rows = [row("fits", i, 10, 30, 60, 60) for i in range(2)] + [row("wide", i, 10, 30, 60, 60) for i in range(5)] + [row("large", i, 10, 30, 9_000, 60) for i in range(2)]
    rows += [row("rejected", i, 10, 30 + i, 900, 60) for i in range(2)] + [row("never", 0, 900, 2_700, 60, 60)]
    df = spark.createDataFrame(rows, "evidence string, scope string, path string, check_id string, tokens long, bytes long, state long, bare long")
    got = {(r.evidence, r.check_id): (r.outcome, r.rounds) for r in recovery.recover(df, 0, 1_000, 2_000, 4_000, 3, 800).collect()}
    assert {k: v for k, v in got.items() if k[0] in ("fits", "wide", "never")} == {("fits", "q0"): ("direct", 0), ("fits", "q1"): ("direct", 0), **{("wide", f"q{i}"): ("split", 0) for i in range(5)}, ("never", "q0"): ("omitted", 3)}
    assert {v for k, v in got.items() if k[0] in ("large", "rejected")} <= {("compacted", n) for n in (1, 2, 3)} | {("final", 3)} and len(got) == len(rows)
    assert recovery.recover(df.limit(0), 0, 1, 1, 1, 1, 1).count() == 0
