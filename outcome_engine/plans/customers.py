"""Tables over the customer value summary: histograms, segments, correlations, densities, figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outcome_engine.functions.columns import col, count_values, join_on_nullable, ratio, total
from outcome_engine.operators.prefix import average_ranks, cut_points, prefix_sums
from outcome_engine.spec import MetricSpec

AGGREGATES = {"count": lambda c: F.count(c), "sum": lambda c: F.sum(c), "avg": lambda c: F.avg(c),
              "min": lambda c: F.min(c), "max": lambda c: F.max(c)}


def _bin(value: str, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the largest value belongs to the last bin."""
    place = F.floor(F.try_divide(F.col(value).cast("double") - low, high - low) * bins)
    return F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")


def _bounds(df: DataFrame, *columns: str) -> Column:
    packed = [F.struct(F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high"))
              .alias(c) for c in columns]
    return df.agg(F.struct(*packed)).scalar()


def histogram(rfm: DataFrame, x: str, bins: int = 20, y: str | None = None, func: str = "count",
              norm: str = "", cumulative: bool = False, group_by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram with the usual normalisations, optionally cumulative."""
    marked = rfm.filter(F.col(x).isNotNull()).withColumn("__b", _bounds(rfm, x)[x])
    low, high = F.col("__b.low"), F.col("__b.high")
    counted = (marked.withColumn("bin", _bin(x, low, high, bins))
               .groupBy(*group_by, "bin", low.alias("__low"), high.alias("__high"))
               .agg(AGGREGATES[func](y or x).cast("double").alias("__v")))
    width = (F.col("__high") - F.col("__low")) / bins
    group = Window.partitionBy(*group_by)
    share = ratio(F.col("__v"), F.sum("__v").over(group))
    value = {"": F.col("__v"), "percent": share * 100, "probability": share,
             "density": ratio(F.col("__v"), width), "probability density": ratio(share, width)}[norm]
    out = counted.select(*group_by, "bin", (F.col("__low") + F.col("bin") * width).alias("left"),
                         (F.col("__low") + (F.col("bin") + 1) * width).alias("right"), value.alias("value"))
    if not cumulative:
        return out
    running = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("value", F.sum("value").over(running))


def density(rfm: DataFrame, metric: str, func: str = "avg", bins_x: int = 60, bins_y: int = 60,
            x: str = "recency", y: str = "frequency") -> DataFrame:
    """Two-dimensional bins over all customers with one aggregated metric."""
    b = _bounds(rfm, x, y)
    marked = rfm.withColumn("__b", b)
    placed = marked.withColumns({
        "x_bin": _bin(x, F.col(f"__b.{x}.low"), F.col(f"__b.{x}.high"), bins_x),
        "y_bin": _bin(y, F.col(f"__b.{y}.low"), F.col(f"__b.{y}.high"), bins_y)})
    return placed.groupBy("x_bin", "y_bin").agg(AGGREGATES[func](metric).alias("value"), F.count("*").alias("n"))


def exposure_sample(rfm: DataFrame, customer: str, n: int = 100, seed: int = 42) -> DataFrame:
    """A repeatable sample of n customers in the order of recency and tenure (the sampling is the feature)."""
    return rfm.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(customer))), customer).limit(n).orderBy("recency", "tenure")


# ---- correlation --------------------------------------------------------------------------------


def correlation(rfm: DataFrame, x: str, y: str, method: str = "pearson", facet: str | None = None) -> DataFrame:
    keys = [facet] if facet else []
    pairs = rfm.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).dropna(
        subset=["__x", "__y"])
    return {"pearson": _pearson, "spearman": _spearman, "kendall": _kendall}[method](pairs, keys)


def _pearson(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NULL, not an error, where one side is constant."""
    spread = F.stddev_pop("__x") * F.stddev_pop("__y")
    return pairs.groupBy(*keys).agg(ratio(F.covar_pop("__x", "__y"), spread).alias("correlation"))


def _cells(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys, "__x", "__y").agg(F.count("*").alias("__n"))


def _spearman(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pearson correlation of average ranks; the mean rank is known, so no second pass is needed."""
    cuts, cells = cut_points(pairs, ["__x", "__y"]), _cells(pairs, keys)
    for v in ("__x", "__y"):
        ranked = average_ranks(cells, keys, v, "__n", cuts[v]).withColumnRenamed("rank", f"{v}_rank").drop("weight")
        cells = join_on_nullable(cells.drop("total"), ranked, [*keys, v])
    middle = (F.col("total") + 1) / F.lit(2.0)
    a, b, n = F.col("__x_rank") - middle, F.col("__y_rank") - middle, F.col("__n").cast("double")
    sums = cells.groupBy(*keys).agg(F.sum(n * a * b).alias("__ab"), F.sum(n * a * a).alias("__aa"),
                                    F.sum(n * b * b).alias("__bb"))
    return sums.select(*keys, ratio("__ab", F.sqrt(F.col("__aa") * F.col("__bb"))).alias("correlation"))


def _kendall(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kendall's tau-b without forming pairs.

    x is replaced by its dense rank. Two points with different x differ first at one bit of that rank;
    at that bit they share the higher bits and one has 0, the other 1. So each point is entered once
    per bit under (bit, higher bits), and running sums over y count, for the points with bit 1, the
    points with bit 0 that lie below and above. Work grows with points x bits; running sums are cut
    into value buckets, so no group is handled by one task.
    """
    cuts, cells = cut_points(pairs, ["__x", "__y"]), _cells(pairs, keys)
    xs = cells.select(*keys, "__x").distinct().withColumn("__one", F.lit(1).cast("long"))
    ranked = prefix_sums(xs, keys, "__x", ["__one"], cuts["__x"]).select(*keys, "__x", F.col("__one_before").alias("__r"),
                                                            F.col("__one_total").alias("__k"))
    placed = join_on_nullable(cells, ranked, [*keys, "__x"])
    bits = F.ceil(F.log2(F.greatest(F.col("__k"), F.lit(2)).cast("double"))).cast("int")
    per_bit = placed.select(
        *keys, "__y", "__n", "__r",
        F.explode(F.sequence(F.lit(0), bits)).alias("__bit"))
    # shiftright takes a literal count; dividing by a power of two reads the same bits.
    power = F.pow(F.lit(2.0), F.col("__bit").cast("double"))
    per_bit = per_bit.withColumns({
        "__high": F.floor(F.col("__r") / (power * 2)).cast("long"),
        "__set": F.pmod(F.floor(F.col("__r") / power).cast("long"), F.lit(2)),
    })
    group = [*keys, "__bit", "__high"]
    sums = per_bit.groupBy(*group, "__y").agg(
        F.sum(F.when(F.col("__set") == 0, F.col("__n")).otherwise(0)).alias("__zero"),
        F.sum(F.when(F.col("__set") == 1, F.col("__n")).otherwise(0)).alias("__ones"))
    run = prefix_sums(sums, group, "__y", ["__zero"], cuts["__y"])
    ones = F.col("__ones").cast("double")
    below, above = F.col("__zero_before"), F.col("__zero_total") - F.col("__zero_before") - F.col("__zero")
    balance = run.groupBy(*keys).agg(F.sum(ones * (below - above)).alias("__balance"))

    def tied(v: str, name: str) -> DataFrame:
        w = F.col("__w").cast("double")
        return (cells.groupBy(*keys, v).agg(F.sum("__n").alias("__w")).groupBy(*keys)
                .agg(F.sum(w * (w - 1) / 2).alias(name), F.sum(w).alias("__size")))

    if keys:
        joined = join_on_nullable(join_on_nullable(balance, tied("__x", "__tx"), keys),
                                  tied("__y", "__ty").drop("__size"), keys)
    else:
        pack = tied("__x", "__tx").select(F.struct("__tx", "__size")).scalar()
        joined = balance.withColumns({"__p": pack, "__ty": tied("__y", "__ty").select("__ty").scalar()})
        joined = joined.withColumns({"__tx": F.col("__p.__tx"), "__size": F.col("__p.__size")})
    every = F.col("__size") * (F.col("__size") - 1) / 2
    spread = F.sqrt((every - F.col("__tx")) * (every - F.col("__ty")))
    return joined.select(*keys, ratio(F.col("__balance"), spread).alias("correlation"))


# ---- key figures ----------------------------------------------------------------------------------


def totals(rfm: DataFrame, customer: str) -> DataFrame:
    return rfm.agg(count_values(customer).alias("unique_customers"), total("lifetime_value").alias("total_value"))


def yearly_value(aggregates: DataFrame, spec: MetricSpec) -> DataFrame:
    """Value per customer in the last two full years and the current one, with year-over-year change.

    Empty when fewer than three years are known.
    """
    yearly = aggregates.groupBy("Year").agg(
        ratio(F.sum("lifetime_value"), count_values(spec.customer_id_col)).alias("average_value"))
    ordered = Window.partitionBy(F.lit(1)).orderBy("Year")
    ranked = yearly.withColumns({
        "__years": F.count("*").over(Window.partitionBy(F.lit(1))),
        "__n": F.row_number().over(ordered),
        "__before": F.lag("average_value").over(ordered),
    })
    kept = ranked.filter((F.col("__years") >= 3) & (F.col("__n") > F.col("__years") - 3))
    first = F.col("__n") == F.col("__years") - 2
    change = ratio(F.col("average_value") - F.col("__before"), F.col("__before"))
    return kept.select("Year", "average_value", F.when(~first, change).alias("yoy"))
