"""What holds for all operators: empty tables, nulls anywhere, repeated rows, clashing columns."""

from __future__ import annotations

import pytest

NAMES = ["p1", "p1_classes", "p1_report", "p2", "p3", "p4", "p5", "p6", "p7", "p7_splits", "p8", "p9", "p10"]


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select(sorted(df.columns)).collect())))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, operators, tables):
    empty = {k: v.limit(0) for k, v in tables.items()}
    assert operators[name](empty).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_nulls_in_any_column(name, operators, nulled):
    operators[name](nulled).collect()


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_and_repeated_rows_change_nothing(name, operators, tables, clashing):
    """Rows delivered twice count once, but for operators that map row by row, which only get the further columns."""
    once = name in ("p8", "p9", "p10")
    fixed = ("size_limits", "pack_limits", "split_targets")
    again = {k: v if once or k in fixed else v.unionByName(v) for k, v in clashing.items()}
    assert rows(operators[name](again)) == rows(operators[name](tables))
