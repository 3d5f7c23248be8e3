"""Predicates from configuration: rule rows, value lists, ranges, patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcome_engine.operators.clean import parse_literal


def apply_where(df: DataFrame, where: Column | str | None) -> DataFrame:
    """Filter by a Column or SQL text; None and blank text keep every row."""
    if where is None or (isinstance(where, str) and not where.strip()):
        return df
    return df.filter(where)


def _listed(value) -> list:
    if isinstance(value, (list, tuple, set)):
        return list(value)
    return [parse_literal(part) for part in str(value).split(",") if part.strip()]


# The operator names accepted in rule rows.
RULES = {
    "==": lambda c, v: c == parse_literal(v),
    "!=": lambda c, v: c != parse_literal(v),
    ">": lambda c, v: c > parse_literal(v),
    ">=": lambda c, v: c >= parse_literal(v),
    "<": lambda c, v: c < parse_literal(v),
    "<=": lambda c, v: c <= parse_literal(v),
    "contains": lambda c, v: c.cast("string").rlike(str(parse_literal(v))),
    "starts with": lambda c, v: c.cast("string").startswith(str(parse_literal(v))),
    "in": lambda c, v: c.isin(_listed(v)),
    "not in": lambda c, v: ~c.isin(_listed(v)),
    "is null": lambda c, v: c.isNull(),
    "is not null": lambda c, v: c.isNotNull(),
}


def rules_to_column(rules: Sequence[Mapping[str, object]]) -> Column | None:
    """AND of the enabled rule rows (Field, Operator, Value, Enabled); None if there are none."""
    terms = []
    for rule in rules:
        name, operator = str(rule.get("Field", "")).strip(), str(rule.get("Operator", "")).strip()
        if not rule.get("Enabled", True) or not name or operator not in RULES:
            continue
        terms.append(RULES[operator](F.col(name), rule.get("Value", "")))
    return reduce(lambda a, b: a & b, terms) if terms else None


def filter_by_rules(df: DataFrame, rules: Sequence[Mapping[str, object]]) -> DataFrame:
    return apply_where(df, rules_to_column(rules))


def filter_interactive(df: DataFrame, values: Mapping[str, Sequence] | None = None,
                       ranges: Mapping[str, tuple] | None = None,
                       patterns: Mapping[str, str] | None = None, case: bool = True) -> DataFrame:
    """Value lists, inclusive numeric or date ranges, regular expressions (with a case switch)."""
    for name, allowed in (values or {}).items():
        df = df.filter(F.col(name).isin(list(allowed)))
    for name, (low, high) in (ranges or {}).items():
        df = df.filter(F.col(name).between(low, high))
    for name, pattern in (patterns or {}).items():
        if pattern:
            df = df.filter(F.col(name).rlike(pattern if case else f"(?i){pattern}"))
    return df


def filter_dimensions(df: DataFrame, selected: Mapping[str, Sequence]) -> DataFrame:
    """Global filter values, for those dimensions the frame has and for which values are chosen."""
    return filter_interactive(df, {d: v for d, v in selected.items() if d in df.columns and v})
