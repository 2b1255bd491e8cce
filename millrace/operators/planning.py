"""From rules and declarations to checks, skips, evidence groups, estimates and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .discovery import language
from .folds import fold

CALLABLE = ("function", "method")
# Limits of a request, and the part of its body that is always there.
LIMITS = {"context": 28_000, "total": 56_000, "bytes": 1_048_576, "questions": 128}
BYTES_PER_TOKEN, RESERVE = 3.0, 512
FRAME = '{"model":,"questions":{},"state":}'


def selected(rules: DataFrame, rulesets: DataFrame, select: list[str], ignore: list[str]) -> DataFrame:
    """The rules of a run: on, in a set that is on, and selected and not ignored by name, set or ``ALL``."""
    names = F.array("rule", "ruleset", F.lit("ALL"))
    listed = lambda words: F.arrays_overlap(names, F.array(*map(F.lit, words)) if words else F.array().cast("array<string>"))
    on = rulesets.filter("enabled").select("ruleset")
    return rules.filter("enabled").filter(listed(select) & ~listed(ignore)).join(F.broadcast(on), "ruleset", "left_semi")


def unknown_selectors(rules: DataFrame, words: DataFrame) -> DataFrame:
    """Words that name no rule, no set and aren't ``ALL``."""
    known = rules.select(F.explode(F.array("rule", "ruleset", F.lit("ALL"))).alias("word"))
    return words.join(known, "word", "left_anti")


def rule_errors(policies: DataFrame) -> DataFrame:
    """(rule_id, error): what a policy does against the contract of its question; a row a fault.

    An error must be at least as strict as the warning, in the same mode; scores have gates or levels of a mass, not both; the levels of an
    error are among those of its warning; labels of a choice are each of one kind; a range of ambiguity lies about one half.
    """
    c = F.col
    both = lambda a, b, bad: c(a).isNotNull() & c(b).isNotNull() & bad
    mass = F.size("warning_levels") > 0
    gates = c("warning_s").isNotNull() | c("error_s").isNotNull()
    overlap = lambda a, b: F.arrays_overlap(a, b)
    faults = {
        "probability_order": both("warning_p", "error_p", c("warning_p") > c("error_p")) & ~(mass & (F.size("error_levels") > 0)),
        "confidence_order": both("warning_c", "error_c", c("warning_c") > c("error_c")),
        "score_order": both("warning_s", "error_s", F.when(c("descending"), c("warning_s") < c("error_s")).otherwise(c("warning_s") > c("error_s"))),
        "score_mode": (c("type") == "score") & (mass == gates),
        "levels": F.size(F.array_except("error_levels", "warning_levels")) > 0,
        "labels": (c("type") == "choice") & (overlap("defect", "uncertain") | overlap("defect", "inapplicable") | overlap("uncertain", "inapplicable") | (F.size("defect") == 0)),
        "range": c("low").isNotNull() & ~((c("low") >= 0) & (c("low") <= 0.5) & (c("high") > 0.5) & (c("high") <= 1)),
        "boolean_confidence": (c("type") == "boolean") & (c("warning_c").isNotNull() | c("error_c").isNotNull()),
        "probability_needed": c("type").isin("boolean", "choice") & c("warning_p").isNull(),
    }
    named = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in faults.items())))
    return policies.select("rule_id", F.explode(named).alias("error"))


def targets(units: DataFrame, files: DataFrame) -> DataFrame:
    """Files with readable content and their declarations, as what a rule can look at: the file first, then units by start and falling end.

    ``units`` has one row a unit; repeated files count once, and only their sizes are moved. A file has the facts of all its units; ``has_members`` marks owners of an
    implemented callable. Units of other paths are left out; the language is that of the path's suffix.
    """
    owners = units.filter(F.col("kind").isin(*CALLABLE) & F.col("has_implementation") & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("unit_id")).distinct().withColumn("has_members", F.lit(True))
    facts = units.select("path", F.explode("syntax_facts").alias("f")).groupBy("path").agg(F.array_sort(F.collect_set("f")).alias("facts"))
    breaks = F.size(F.split("content", "\n")) - 1
    n_lines = F.greatest(F.lit(1), breaks + F.when((F.col("content") == "") | F.endswith("content", F.lit("\n")), 0).otherwise(1))
    sized = files.filter("content IS NOT NULL").select("path", language(F.col("path")).alias("language"), F.octet_length("content").cast("bigint").alias("size"), n_lines.alias("n_lines")).dropDuplicates(["path"])
    none = F.array().cast("array<string>")
    file = sized.join(facts, "path", "left").select(
        F.col("path").alias("target_id"), "path", "language", "size", "n_lines", F.lit("file").alias("scope"), F.lit(None).cast("string").alias("kind"), F.col("path").alias("name"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(0).cast("bigint").alias("start_byte"), F.col("size").alias("end_byte"), F.lit(1).alias("start_line"), F.col("n_lines").alias("end_line"), F.lit(True).alias("has_body"), F.lit(True).alias("implemented"), F.lit(False).alias("has_members"), F.coalesce("facts", none).alias("facts"),
    )
    unit = units.filter("start_byte >= 0 AND start_byte < end_byte").join(sized, "path").filter("end_byte <= size").join(owners, "unit_id", "left").select(
        F.col("unit_id").alias("target_id"), "path", "language", "size", "n_lines", F.lit("unit").alias("scope"), "kind", F.col("qualified_name").alias("name"), "parent_id", "start_byte", "end_byte", "start_line", "end_line",
        "has_body", F.col("has_implementation").alias("implemented"), F.coalesce("has_members", F.lit(False)).alias("has_members"), F.coalesce("syntax_facts", none).alias("facts"),
    )
    return file.unionByName(unit)


def matched(targets_: DataFrame, rules: DataFrame) -> DataFrame:
    """Targets with the rules whose structure they have: scope, language (none named: all), kind, body and members; and ``missing``, the facts
    a rule asks for and the target lacks: each of those all of which it needs, and all of those any of which it needs where it has none."""
    c = F.col
    rows = targets_.join(F.broadcast(rules), "scope").filter((F.size("languages") == 0) | F.array_contains("languages", c("language")))  # a row a rule
    unit = F.array_contains("kinds", c("kind")) & (~c("needs_body") | (c("has_body") & c("implemented"))) & (~c("needs_members") | c("has_members"))
    rows = rows.filter(c("language").isNotNull() & ((c("scope") == "file") | unit))
    any_missing = (F.size("requires_any") > 0) & ~F.arrays_overlap("requires_any", "facts")
    return rows.withColumn("missing", F.concat(F.array_except("requires_all", "facts"), F.when(any_missing, c("requires_any")).otherwise(F.array().cast("array<string>"))))


def checks(matches: DataFrame, line_limit: int | None = None) -> DataFrame:
    """What is asked: matches without missing facts, numbered within their file by target and rule as ``q%05d``; with ``omitted``, whether the
    file is too long for a rule that needs it whole, and the span of source asked for (``wanted``, ``from_byte``, ``to_byte``).

    A rule may want the file, the unit, or the unit's owner: the declaration a callable lies in, or the file where there is none and in
    Rust. A unit whose owner would be a file over the limit is asked about alone.
    """
    c = F.col
    limited = F.lit(line_limit is not None) & (c("n_lines") > (line_limit or 0))
    order = Window.partitionBy("path").orderBy((c("scope") != "file").cast("int"), "start_byte", F.desc("end_byte"), "target_id", "rule")
    rows = matches.filter(F.size("missing") == 0).withColumn("check_id", F.format_string("q%05d", F.row_number().over(order) - 1))
    owner_is_file = (c("language") == "rust") | c("owner_start").isNull()
    callable_ = c("kind").isin(*CALLABLE)
    wanted = F.when((c("scope") == "file") | (c("context") == "file"), "file").when((c("context") == "unit") | ~callable_, "unit").when(~owner_is_file, "owner").when(limited, "unit").otherwise("file")
    rows = rows.withColumn("wanted", wanted)
    start = F.when(c("wanted") == "file", F.lit(0)).when(c("wanted") == "owner", c("owner_start")).otherwise(c("start_byte")).cast("bigint")
    end = F.when(c("wanted") == "file", c("size")).when(c("wanted") == "owner", c("owner_end")).otherwise(c("end_byte"))
    return rows.withColumn("from_byte", start).withColumn("to_byte", end).withColumn("omitted", limited & ((c("scope") == "file") | (c("context") == "file")))


def with_owner(targets_: DataFrame) -> DataFrame:
    """Targets with the span of their parent."""
    parents = targets_.filter("scope = 'unit'").select(F.col("target_id").alias("parent_id"), F.col("start_byte").alias("owner_start"), F.col("end_byte").alias("owner_end"))
    return targets_.join(parents, "parent_id", "left")


def bound_question(rubric: Column, type_: str = "boolean") -> Column:
    """The question of a check as it is sent: its rubric by reference and where the target is, as JSON with sorted keys and without blanks."""
    c = F.col
    target = F.struct(c("end_line"), c("kind"), c("name"), c("path"), F.array("start_byte", "end_byte").alias("span"), c("start_line"))
    instructions = F.struct(rubric.alias("rubric"), target.alias("target"), F.lit("Apply referenced rubric.").alias("task"))
    return F.to_json(F.struct(instructions.alias("instructions"), F.lit(type_).alias("type")))


def question_sizes(asked: DataFrame) -> DataFrame:
    """Checks with their question and its size in a body: the quoted id, a colon, the question; in bytes and in tokens, rounded up."""
    rows = asked.withColumn("question", bound_question(F.left(F.sha2("rule", 256), F.lit(16))))
    rows = rows.withColumn("bytes", F.octet_length("question") + F.octet_length("check_id") + 3)
    return rows.withColumn("tokens", F.ceil(F.col("bytes") / BYTES_PER_TOKEN).cast("bigint"))


def estimate(state: Column, model: Column, longest: Column, total: Column, size: Column, n: Column) -> Column:
    """struct<context, total, bytes> of a request from the bytes of its state and the sizes of its questions.

    Fixed parts and state are rounded up together, a reserve is added; the context needs the longest question, the whole all of them.
    """
    fixed = F.lit(len(FRAME)) + F.octet_length(F.to_json(F.struct(model.alias("m")))) - 6
    base = F.ceil((state + fixed) / BYTES_PER_TOKEN) + RESERVE
    return F.struct((base + longest).cast("bigint").alias("context"), (base + total).cast("bigint").alias("total"), (fixed + state + size + n - 1).cast("bigint").alias("bytes"))


def violations(estimated: Column, n: Column, context: Column, total: Column) -> Column:
    """Which limits an estimate passes; a null limit is none."""
    over = [(n > LIMITS["questions"], "questions"), (estimated.context > context, "context"), (estimated.total > total, "total"), (estimated.bytes > LIMITS["bytes"], "bytes")]
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in over)))


def published(model: Column) -> Column:
    """struct<context, total> of a model whose limits are known; null for others."""
    known = F.lower(F.trim(model)).rlike(r"^judge-(?:latest|1\.[45])$")
    return F.when(known, F.struct(F.lit(32_000).alias("context"), F.lit(64_000).alias("total")))


def pack(sized: DataFrame, group: str, order: list[str], state: str, fixed: int, context: int, total: int, most_bytes: int, questions: int) -> DataFrame:
    """``sized`` with ``batch``: the questions of an evidence group in order, a new request where the next one would pass a limit; a question
    that doesn't fit alone is a request of its own. Where the first question doesn't fit, the evidence itself is too large: its
    questions are then only counted out, ``questions`` to a request, to be recovered later."""

    def begin() -> list:
        return [0, -1, 0, 0, 0, 0, False]  # rows, batch, questions, longest, tokens, bytes in it, whether only counted

    def step(s: list, row: tuple) -> int:
        tokens, size, held = row
        base = -(-(held + fixed) // BYTES_PER_TOKEN) + RESERVE
        fits = lambda n, longest, sum_, bytes_: n <= questions and base + longest <= context and base + sum_ <= total and fixed + held + bytes_ + n - 1 <= most_bytes
        if not s[0]:
            s[6] = not fits(1, tokens, tokens, size)
        s[0] += 1
        new = s[1] < 0 or (s[2] >= questions if s[6] else not fits(s[2] + 1, max(s[3], tokens), s[4] + tokens, s[5] + size))
        if new:
            s[1], s[2], s[3], s[4], s[5] = s[1] + 1, 1, tokens, tokens, size
        else:
            s[2], s[3], s[4], s[5] = s[2] + 1, max(s[3], tokens), s[4] + tokens, s[5] + size
        return s[1]

    return fold(sized, [group], order, ["tokens", "bytes", state], T.StructField("batch", T.IntegerType()), begin, step)
