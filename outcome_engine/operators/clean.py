"""Cleaning of raw interaction and holding records: names, defaults, times, duplicates."""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_engine.spec import ACTION_ID, DECISION_TIME, DEDUP_KEYS, GROUP, ISSUE, NAME, OUTCOME_TIME

# Technical columns of the raw records that carry no analysis value.
TECHNICAL_COLUMNS = (
    "pxFactID", "pyLabel", "pxUpdateDateTime", "pxStreamPartition", "EvaluationCriteria", "pyOrganization",
    "pyUnit", "pyDivision", "pyComponent", "pyApplicationVersion", "pyStrategy", "pyApplication", "pyFulfilled",
    "IPAddress", "pyInteraction", "pyLatitude", "pyLongitude", "pyOperator", "pyPartitionKey", "pyWorkID", "WorkID",
    "pyBehaviour", "pyIsPropositionActive", "pyISFactID", "pyInternalTags", "pxStreamPosition", "ReferrerUrl",
)
TIME_PATTERN = "yyyyMMdd'T'HHmmss.SSS z"


def drop_technical(df: DataFrame) -> DataFrame:
    return df.drop(*TECHNICAL_COLUMNS)


def canonical_names(names: Sequence[str]) -> list[str]:
    """Strip a leading px/py/pz unless that name is taken already; start with a capital."""
    taken = set(names)

    def one(name: str) -> str:
        short = re.sub("^p[xyz]", "", name)
        chosen = name if short in taken else short
        return chosen[:1].upper() + chosen[1:]

    renamed = [one(n) for n in names]
    double = sorted({n for n in renamed if renamed.count(n) > 1})
    if double:
        raise ValueError(f"columns collide after renaming: {double}")
    return renamed


def with_canonical_names(df: DataFrame) -> DataFrame:
    return df.toDF(*canonical_names(df.columns))


def _number_or_text(value):
    try:
        return float(value)
    except (TypeError, ValueError):
        return value


def parse_literal(value):
    """Text as a literal: true/false, numbers and quoted strings; anything else stays text."""
    if value is None or isinstance(value, (bool, int, float)):
        return value
    text = str(value).strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    try:
        return ast.literal_eval(text)
    except (SyntaxError, ValueError):
        return text


def with_defaults(df: DataFrame, defaults: Mapping[str, object], numeric: bool = True,
                  parse: bool = False) -> DataFrame:
    """Absent column -> literal; present column -> literal where NULL.

    numeric: number-like text becomes a double (interactions do this, holdings do not).
    parse: true/false and literals are recognised as well.
    """
    changes: dict[str, Column] = {}
    for name, raw in defaults.items():
        if not str(name).strip():
            continue
        value = parse_literal(raw) if parse else (_number_or_text(raw) if numeric else raw)
        if name in df.columns:
            changes[name] = F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType))
        else:
            changes[name] = F.lit(value)
    return df.withColumns(changes) if changes else df


def with_calculated(df: DataFrame, expressions: Mapping[str, str | Column]) -> DataFrame:
    """Configured columns; text is a Spark SQL expression. Blank text is skipped."""
    named = {n: (F.expr(e) if isinstance(e, str) else e) for n, e in expressions.items()
             if n.strip() and not (isinstance(e, str) and not e.strip())}
    return df.withColumns(named) if named else df


def with_time_aliases(df: DataFrame, outcome_time: str | None = None, decision_time: str | None = None) -> DataFrame:
    pairs = {OUTCOME_TIME: outcome_time, DECISION_TIME: decision_time}
    named = {target: F.col(source) for target, source in pairs.items()
             if source and source in df.columns and source != target}
    return df.withColumns(named) if named else df


def parse_time(c: Column | str, lenient: bool = False) -> Column:
    """`20240710T145658.123 GMT` -> timestamp. Strict raises on bad text, lenient gives NULL."""
    parse = F.try_to_timestamp if lenient else F.to_timestamp
    return parse(F.col(c) if isinstance(c, str) else c, F.lit(TIME_PATTERN) if lenient else TIME_PATTERN)


def with_parsed_times(df: DataFrame, lenient: bool = False) -> DataFrame:
    texts = [n for n in (OUTCOME_TIME, DECISION_TIME)
             if isinstance(df.schema[n].dataType, T.StringType)]
    return df.withColumns({n: parse_time(n, lenient) for n in texts}) if texts else df


def with_action_id(df: DataFrame) -> DataFrame:
    """Issue/Group/Name; NULL as soon as one part is NULL."""
    return df.withColumn(ACTION_ID, F.concat(ISSUE, F.lit("/"), GROUP, F.lit("/"), NAME))


def calendar(time: str) -> dict[str, Column]:
    t = F.col(time)
    return {
        "Day": F.to_date(t),
        "Month": F.date_format(t, "yyyy-MM"),
        "Year": F.year(t).cast("short"),
        "Quarter": F.concat(F.year(t).cast("string"), F.lit("_Q"), F.quarter(t).cast("string")),
    }


def with_calendar(df: DataFrame, time: str = OUTCOME_TIME) -> DataFrame:
    return df.withColumns(calendar(time))


def with_response_time(df: DataFrame) -> DataFrame:
    return df.withColumn("ResponseTime", F.expr(f"timestampdiff(SECOND, {DECISION_TIME}, {OUTCOME_TIME})"))


def dedup_events(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS) -> DataFrame:
    """One row per key: the smallest row in the order of the remaining columns (NULL first).

    Spark applies the limit of one row per key before the shuffle as well as after it, so a key that
    holds a large share of the rows sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ordered = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in rest])
    return df.withColumn("__n", F.row_number().over(ordered)).filter(F.col("__n") == 1).drop("__n")


@dataclass(frozen=True)
class CleaningConfig:
    defaults: Mapping[str, object] = field(default_factory=dict)
    where: Column | str | None = None
    calculated: Mapping[str, str | Column] = field(default_factory=dict)


def clean_interactions(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    from outcome_engine.operators.filters import apply_where

    df = with_canonical_names(drop_technical(df))
    df = apply_where(with_defaults(df, config.defaults), config.where)
    df = with_response_time(with_calendar(with_action_id(with_parsed_times(df))))
    return with_calculated(dedup_events(df), config.calculated)


def clean_holdings(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    from outcome_engine.operators.filters import apply_where

    df = with_defaults(with_canonical_names(df), config.defaults, numeric=False)
    return with_calculated(apply_where(df, config.where), config.calculated)
