"""Running sums, ranks and exact quantiles over groups of any size.

A window ordered over a whole group would put a group that holds most rows into one task.
Here the order is cut into value buckets first (a literal list of cut points, so the bucket of a
row depends on nothing but its value): a window runs inside (group, bucket), and a second one
over the few bucket totals of each group supplies the offset. Cut points only balance the work;
any choice gives the same, exact result.

Quantiles need no order of all values: a first scan brackets them, and only what lies inside the brackets is ordered.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outcome_engine.functions.columns import join_on_nullable
from outcome_engine.session import new_folder

BUCKET = "__bucket"
BUCKETS_PER_PARTITION = 8
MARGIN = 0.002  # how far the ends of a bracket lie from the wanted quantile, as a share of the group


def cut_points(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Approximate quantiles per column: `buckets` numbers each reach the driver, by default a few for each shuffle
    partition, so that a bucket grows no faster than a partition does."""
    buckets = buckets or BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / buckets for i in range(1, buckets)]
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    found = doubles.approxQuantile(list(columns), shares, 1.0 / (2 * buckets))
    return {c: sorted(set(v)) for c, v in zip(columns, found)}


def _splits(cuts: Sequence[float]) -> list[float]:
    inf = float("inf")
    inner = sorted({float(c) for c in cuts if -inf < c < inf}) or [0.0]
    return [-inf, *inner, inf]


def with_bucket(df: DataFrame, column: str, cuts: Sequence[float]) -> DataFrame:
    ready = df.withColumn("__v", F.col(column).cast("double"))
    marker = Bucketizer(splits=_splits(cuts), inputCol="__v", outputCol=BUCKET, handleInvalid="keep")
    return marker.transform(ready).drop("__v")


def prefix_sums(df: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str],
                cuts: Sequence[float] | None = None, buckets: int | None = None) -> DataFrame:
    """Add `{m}_before` (sum over strictly smaller order values) and `{m}_total` per group.

    `df` holds one row per (keys, order value): aggregate before calling.
    """
    if cuts is None:
        cuts = cut_points(df, [order], buckets)[order]
    return _prefix_within_buckets(with_bucket(df, order, cuts), keys, order, measures)


def _prefix_within_buckets(marked: DataFrame, keys: Sequence[str], order: str,
                           measures: Sequence[str]) -> DataFrame:
    inside = Window.partitionBy(*keys, BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumns({f"__in_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
    totals = marked.groupBy(*keys, BUCKET).agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, BUCKET,
        *[F.coalesce(F.sum(f"__t_{m}").over(earlier), F.lit(0)).alias(f"__off_{m}") for m in measures],
        *[F.sum(f"__t_{m}").over(group).alias(f"{m}_total") for m in measures],
    )
    joined = join_on_nullable(local, offsets, [*keys, BUCKET])
    added = joined.withColumns({f"{m}_before": F.col(f"__in_{m}") + F.col(f"__off_{m}") for m in measures})
    return added.drop(BUCKET, *[f"__in_{m}" for m in measures], *[f"__off_{m}" for m in measures])


def quantile_brackets(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], extra: Sequence[Column] = (),
                      margin: float = MARGIN) -> DataFrame:
    """One stored row per group: `extra`, and per column the arrays `__lo{i}` and `__hi{i}` with a bracket for each quantile.

    The ends are quantiles `margin` below and above the wanted one from a sketch whose error is at most a tenth of
    `margin`, so the wanted ranks lie inside. A group of up to 4 / `margin` rows, where a rank more or less counts, is
    one bracket as a whole. NaN is larger than every number.
    """
    inf, nan, count = float("inf"), F.lit(float("nan")), len(probs)
    ends = [min(1.0, max(0.0, p + side)) for side in (-margin, margin) for p in probs]
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [F.count(c).alias(f"__n{i}"), F.percentile_approx(F.when(F.isnan(v), inf).otherwise(v), ends, math.ceil(10 / margin)).alias(f"__q{i}")]
    found = df.groupBy(*keys).agg(*extra, *aggs)
    for i in range(len(columns)):
        at, small = F.col(f"__q{i}"), F.col(f"__n{i}") <= 4 / margin
        low = [F.lit(-inf) if ends[j] == 0 else F.when(small, -inf).otherwise(at[j]) for j in range(count)]
        high = [nan if ends[count + j] == 1 else F.when(small | (at[count + j] == inf), nan).otherwise(at[count + j]) for j in range(count)]
        found = found.withColumns({f"__lo{i}": F.array(*low), f"__hi{i}": F.array(*high)})
    path = new_folder(df.sparkSession, "brackets")
    found.drop(*[f"__{x}{i}" for i in range(len(columns)) for x in "nq"]).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bracketed_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], brackets: DataFrame, count: int) -> DataFrame:
    """(keys, __c, bucket, __v, __n): the values inside the brackets with their numbers, and one row with a NULL value for
    all that lie between two brackets. Buckets ascend with the values. Only what is inside is shuffled by value.

    The brackets are a stored table, so Spark knows their size: it broadcasts them where they are small, and shuffles else.
    """
    ends = [f"__{side}{i}" for i in range(len(columns)) for side in ("lo", "hi")]
    values = df.select(*keys, *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    if keys:
        marked = join_on_nullable(values, brackets.select(*keys, *ends), keys)
    else:
        row = brackets.first()
        marked = values.withColumns({e: F.array(*[F.lit(x) for x in row[e]]) for e in ends})
    cells = F.array(*[F.struct(F.lit(i).alias("c"), *[F.col(f"__{x}{i}").alias(x) for x in ("v", "lo", "hi")]) for i in range(len(columns))])
    long = marked.select(*keys, F.explode(cells).alias("__p")).filter(F.col("__p.v").isNotNull())
    v, low, high = (F.col(f"__p.{x}") for x in ("v", "lo", "hi"))
    begun = reduce(lambda a, b: a + b, [(v >= low[j]).cast("int") for j in range(count)])
    ended = reduce(lambda a, b: a + b, [(v > high[j]).cast("int") for j in range(count)])
    inside = F.when(begun > ended, v)
    return long.groupBy(*keys, F.col("__p.c").alias("__c"), (begun + ended).alias(BUCKET), inside.alias("__v")).agg(
        F.count("*").alias("__n"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Mapping[str, float],
                    extra: Sequence[Column] = (), margin: float = MARGIN) -> DataFrame:
    """Linear-interpolated exact quantiles: one row per group, columns `{column}_{name}`, the same plan at every size.

    Two scans: the first brackets each quantile in every group, the second counts what lies below and orders what lies
    inside, some 2 * `margin` of the rows a quantile. Groups without any value have no row. With `extra`, aggregates
    that the first scan makes beside its sketches, every group has one.
    """
    brackets = quantile_brackets(df, keys, columns, list(probs.values()), extra, margin)
    placed = _prefix_within_buckets(bracketed_counts(df, keys, columns, brackets, len(probs)), [*keys, "__c"], "__v", ["__n"])

    picks = []
    before, total = F.col("__n_before"), F.col("__n_total")
    value = F.coalesce("__v", F.raise_error(F.lit("a wanted rank lies outside of its bracket")).cast("double"))
    for name, p in probs.items():
        position = (total - 1) * F.lit(float(p))
        for side, target in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (before <= target) & (target < before + F.col("__n"))
            picks.append(F.max(F.when(hit, value)).alias(f"__{name}_{side}"))
        picks.append(F.max(position - F.floor(position)).alias(f"__{name}_part"))
    found = placed.groupBy(*keys, "__c").agg(*picks)
    out = []
    for i, c in enumerate(columns):
        mine = F.col("__c") == i
        for name in probs:
            low, high, part = (F.col(f"__{name}_{s}") for s in ("lo", "hi", "part"))
            between = F.when(low == high, low).otherwise(low + (high - low) * part)  # equal infinities have no difference
            out.append(F.max(F.when(mine, between)).alias(f"{c}_{name}"))
    result = found.groupBy(*keys).agg(*out)
    if not extra:
        return result
    return join_on_nullable(brackets.drop(*[f"__{side}{i}" for i in range(len(columns)) for side in ("lo", "hi")]), result, keys, "left")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str,
                  cuts: Sequence[float] | None = None) -> DataFrame:
    """One row per (keys, value) with `rank`: ties share the mean of their positions."""
    counts = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    placed = prefix_sums(counts, keys, value, ["__w"], cuts)
    return placed.select(*keys, value, (F.col("__w_before") + (F.col("__w") + 1) / F.lit(2.0)).alias("rank"),
                         F.col("__w").alias("weight"), F.col("__w_total").alias("total"))
