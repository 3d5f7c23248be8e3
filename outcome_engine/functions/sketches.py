"""Mergeable quantile sketches: thin column forms over Spark's KLL functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcome_engine.functions.columns import col

SKETCH_K = 500
GRID_STEPS = 1000


def build(c: Column | str, k: int = SKETCH_K) -> Column:
    """Aggregate: sketch of the non-null values."""
    return F.kll_sketch_agg_double(col(c).cast("double"), k)


def merge(c: Column | str, k: int = SKETCH_K) -> Column:
    """Aggregate: one sketch from many."""
    return F.kll_merge_agg_double(col(c), k)


def size(sketch: Column | str) -> Column:
    return F.kll_sketch_get_n_double(col(sketch))


def quantile(sketch: Column | str, q: float) -> Column:
    """Quantile of a sketch; 0 when it is empty."""
    sketch = col(sketch)
    return F.when(size(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))).otherwise(F.lit(0.0))


def quantiles(sketch: Column | str, qs: Sequence[float]) -> Column:
    """Array of quantiles; zeros when the sketch is empty."""
    sketch = col(sketch)
    ranks = F.array(*[F.lit(float(q)) for q in qs])
    zeros = F.array(*[F.lit(0.0) for _ in qs])
    return F.when(size(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, ranks)).otherwise(zeros)


def ranks(sketch: Column | str, points: Sequence[float]) -> Column:
    """Array of P(value <= point)."""
    sketch = col(sketch)
    edges = F.array(*[F.lit(float(p)) for p in points])
    zeros = F.array(*[F.lit(0.0) for _ in points])
    return F.when(size(sketch) > 0, F.kll_sketch_get_rank_double(sketch, edges)).otherwise(zeros)


def histogram(df: DataFrame, sketch: str, bins: int = 30,
              value_range: tuple[float, float] | None = None) -> DataFrame:
    """One row per bin: bin, left, right, center, mass. `df` holds one sketch per row.

    With a given range the masses are rank differences at literal edges; the first bin is closed on both sides. Without
    one the range is each sketch's own [min, max], and the mass comes from an even grid of ranks. Empty bins have mass 0.
    """
    keep = [c for c in df.columns if c != sketch]
    if value_range is not None:
        low, high = map(float, value_range)
        width = (high - low) / bins
        edges = [low + width * i for i in range(bins + 1)]
        at = df.withColumn("__rank", ranks(sketch, [math.nextafter(low, -math.inf), *edges[1:]]))
        out = at.select(*keep, "__rank", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        return out.select(
            *keep, "bin",
            (F.lit(low) + F.col("bin") * width).alias("left"),
            (F.lit(low) + (F.col("bin") + 1) * width).alias("right"),
            (F.lit(low) + (F.col("bin") + 0.5) * width).alias("center"),
            (F.element_at("__rank", F.col("bin") + 2) - F.element_at("__rank", F.col("bin") + 1)).alias("mass"),
        )
    grid = quantiles(sketch, [i / GRID_STEPS for i in range(GRID_STEPS + 1)])
    one = df.filter(size(sketch) > 0).withColumn("__grid", grid)
    one = one.withColumns({"__low": F.element_at("__grid", 1), "__high": F.element_at("__grid", GRID_STEPS + 1)})
    def position(v: Column) -> Column:
        place = F.floor(F.try_divide(v - F.col("__low"), F.col("__high") - F.col("__low")) * bins)
        return F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")

    masses = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(
        F.filter(F.transform("__grid", position), lambda p: p == i)) / F.lit(GRID_STEPS + 1.0))
    counted = one.select(*keep, "__low", "__high", F.posexplode(masses).alias("bin", "mass"))
    width = (F.col("__high") - F.col("__low")) / bins
    return counted.select(
        *keep, "bin",
        (F.col("__low") + F.col("bin") * width).alias("left"),
        (F.col("__low") + (F.col("bin") + 1) * width).alias("right"),
        (F.col("__low") + (F.col("bin") + 0.5) * width).alias("center"),
        "mass",
    )
