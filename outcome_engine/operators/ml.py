"""Model and recommender scores: label split score distributions, personalization, novelty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outcome_engine.functions import sketches
from outcome_engine.functions.columns import col, join_on_nullable, ratio, total, weighted_mean
from outcome_engine.operators.filters import apply_where
from outcome_engine.operators.labels import LABEL, keep_best_outcome, keep_groups_with_positive, label_outcomes
from outcome_engine.operators.prefix import cut_points, prefix_sums
from outcome_engine.session import new_folder
from outcome_engine.spec import (ALL, FINAL_PROPENSITY, INTERACTION_ID, INTERACTION_KEYS, NAME, PROPENSITY, SUBJECT_ID,
                                 MetricSpec, unique_in_order)

# Score thresholds of the curves, and the calibration bin edges
# (10 bins of width 0.01 below 0.1, then 16 equal bins up to 1).
THRESHOLDS = [round(i / 100, 4) for i in range(101)]
CALIBRATION_EDGES = [round(i / 100, 4) for i in range(10)] + [round(0.1 + 0.05625 * i, 4) for i in range(17)]
EPS = 1e-10
SKETCHES = {
    "sketch_positives": (PROPENSITY, 1), "sketch_negatives": (PROPENSITY, 0),
    "sketch_final_positives": (FINAL_PROPENSITY, 1), "sketch_final_negatives": (FINAL_PROPENSITY, 0),
}


def scored_rows(ih: DataFrame, spec: MetricSpec) -> DataFrame:
    """Labelled rows of groups with a positive, best outcome per interaction key.

    The group filter drops whole groups without positives, and a key with a positive never loses it,
    so both filters may look at the labelled rows and commute.
    """
    labelled = label_outcomes(apply_where(ih, spec.where), spec.positive, spec.negative)
    return keep_groups_with_positive(keep_best_outcome(labelled), spec.keys, labelled)


def scored_once(ih: DataFrame, spec: MetricSpec, keep: Sequence[str] = ()) -> DataFrame:
    """`scored_rows` written to the shared folder with the columns that scores need: several metrics are made from one labelling.

    The labelled rows are written first: the best outcome and the groups with a positive look at them three times.
    """
    spark = ih.sparkSession
    scores = [c for c in (PROPENSITY, FINAL_PROPENSITY) if c in ih.columns]
    columns = unique_in_order(spec.keys, SUBJECT_ID, INTERACTION_ID, NAME, LABEL, scores, keep)
    first, path = new_folder(spark, "labelled_rows"), new_folder(spark, "scored_rows")
    labelled = label_outcomes(apply_where(ih, spec.where), spec.positive, spec.negative)
    labelled.select(*unique_in_order(columns, INTERACTION_KEYS)).write.parquet(first)
    labelled = spark.read.parquet(first)
    kept = keep_groups_with_positive(keep_best_outcome(labelled), spec.keys, labelled)
    kept.select(*columns).write.parquet(path)
    return spark.read.parquet(path)


# ---- recommender scores -------------------------------------------------------------------


def personalization(df: DataFrame, keys: Sequence[str], customer: str = SUBJECT_ID, item: str = NAME) -> DataFrame:
    """1 - mean cosine similarity of different customers' item-count vectors; 0 for one customer.

    With unit vectors u_c, the sum of all pairwise similarities is |sum_c u_c|^2, so item sums of the
    unit vectors are enough. A customer's vector has at most as many rows as there are items.
    """
    cells = df.groupBy(*keys, customer, item).agg(F.count("*").alias("__n"))
    of_customer = Window.partitionBy(*keys, customer)
    squared = F.sum(F.col("__n").cast("double") * F.col("__n")).over(of_customer)
    first = F.row_number().over(of_customer.orderBy(F.col(item).asc_nulls_first()))
    units = cells.withColumns({"__u": F.col("__n") / F.sqrt(squared), "__first": (first == 1).cast("long")})
    by_item = units.groupBy(*keys, item).agg(F.sum("__u").alias("__s"), F.sum("__first").alias("__c"))
    n, all_pairs = F.sum("__c"), F.sum(F.col("__s") * F.col("__s"))
    score = F.when(n > 1, 1 - ratio(all_pairs - n, n * (n - 1))).otherwise(F.lit(0.0))
    return by_item.groupBy(*keys).agg(score.alias("personalization"))


def novelty(df: DataFrame, keys: Sequence[str], customer: str = SUBJECT_ID, interaction: str = INTERACTION_ID,
            item: str = NAME) -> DataFrame:
    """Self-information of the items, weighted by their counts, per customer and longest list.

    Items, customers and interactions are counted in one pass: each row is turned into three tagged
    values, and the tagged values are counted with map-side combination.
    """
    tagged = df.select(*keys, F.explode(F.array(
        F.struct(F.lit("item").alias("kind"), F.col(item).cast("string").alias("value")),
        F.struct(F.lit("customer").alias("kind"), F.col(customer).cast("string").alias("value")),
        F.struct(F.lit("interaction").alias("kind"), F.col(interaction).cast("string").alias("value")),
    )).alias("__t")).select(*keys, "__t.kind", "__t.value")
    counts = tagged.groupBy(*keys, "kind", "value").agg(F.count("*").alias("__n"))
    kind, n = F.col("kind"), F.col("__n").cast("double")
    sums = counts.groupBy(*keys).agg(
        F.count(F.when(kind == "customer", 1)).alias("__u"),
        F.max(F.when(kind == "interaction", F.col("__n"))).alias("__longest"),
        F.sum(F.when(kind == "item", n)).alias("__rows"),
        F.sum(F.when(kind == "item", n * F.log2(n))).alias("__nlog"),
    )
    # sum n * -(log2(n/u) + eps) = -(sum n*log2(n) - log2(u) * rows) - eps * rows
    info = F.log2(F.col("__u").cast("double")) * F.col("__rows") - F.col("__nlog") - F.lit(EPS) * F.col("__rows")
    return sums.select(*keys, ratio(info, F.col("__u") * F.col("__longest")).alias("novelty"))


def recommender_scores(df: DataFrame, keys: Sequence[str], customer: str = SUBJECT_ID,
                       interaction: str = INTERACTION_ID, item: str = NAME) -> DataFrame:
    """Count, personalization and novelty together: one pass over the rows and no join.

    Each row yields a (customer, item) and an (interaction) cell. Counted cells give item counts,
    customers, unit vectors and list lengths; formulas as in the two functions above.
    """
    pair = F.struct(F.lit("pair").alias("kind"), F.col(customer).cast("string").alias("a"), F.col(item).cast("string").alias("b"))
    seen = F.struct(F.lit("list").alias("kind"), F.col(interaction).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    cells = (df.select(*keys, F.explode(F.array(pair, seen)).alias("__c")).select(*keys, "__c.*")
             .groupBy(*keys, "kind", "a", "b").agg(F.count("*").alias("__n")))
    owner = Window.partitionBy(*keys, "kind", "a")
    n = F.col("__n").cast("double")
    units = cells.withColumns({
        "__u": n / F.sqrt(F.sum(n * n).over(owner)),
        "__first": (F.row_number().over(owner.orderBy(F.col("b").asc_nulls_first())) == 1).cast("long")})
    items = units.groupBy(*keys, "kind", "b").agg(
        F.sum("__n").alias("__n"), F.sum("__u").alias("__s"), F.sum("__first").alias("__c"), F.max("__n").alias("__longest"))
    is_pair = F.col("kind") == "pair"

    def over_items(value: Column) -> Column:
        return F.sum(F.when(is_pair, value))

    sums = items.groupBy(*keys).agg(
        over_items(F.col("__n")).alias("Count"), over_items(F.col("__c")).alias("__users"),
        over_items(F.col("__s") * F.col("__s")).alias("__similar"), over_items(n * F.log2(n)).alias("__nlog"),
        F.max(F.when(~is_pair, F.col("__longest"))).alias("__longest"))
    u, rows = F.col("__users").cast("double"), F.col("Count")
    spread = F.when(u > 1, 1 - ratio(F.col("__similar") - u, u * (u - 1))).otherwise(F.lit(0.0))
    info = F.log2(u) * rows - F.col("__nlog") - F.lit(EPS) * rows
    return sums.select(*keys, "Count", spread.alias("personalization"), ratio(info, u * F.col("__longest")).alias("novelty"))


# ---- score distributions ------------------------------------------------------------------


def threshold_bin(score: Column | str) -> Column:
    """Number of thresholds below the score (0..101), exact at the thresholds themselves."""
    s = col(score).cast("double")
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.01), s))
    up = F.ceil(inside * 100)
    here = up - (inside <= (up - 1) / F.lit(100.0)).cast("int") + (inside > up / F.lit(100.0)).cast("int")
    return F.when(s <= 0, 0).when(s > 1, 101).when(s.isNotNull(), here).cast("int")


def calibration_bin(score: Column | str) -> Column:
    """Number of calibration edges below the score (0..27); bin i is (edge[i-1], edge[i]]."""
    s = col(score).cast("double")
    low = F.least(threshold_bin(s), F.lit(10))
    high = F.lit(0)
    for edge in CALIBRATION_EDGES[10:]:
        high = high + (s > F.lit(edge)).cast("int")
    return (low + high).cast("int")


def score_bins(df: DataFrame, keys: Sequence[str], score: str = PROPENSITY) -> DataFrame:
    """The exact, mergeable score distribution: positives, negatives and score sum per bin."""
    return df.filter(F.col(score).isNotNull()).groupBy(
        *keys, threshold_bin(score).alias("bin"), calibration_bin(score).alias("cal_bin")).agg(
        total(LABEL).alias("pos"), total(1 - F.col(LABEL)).alias("neg"), total(score).alias("score_sum"))


def compact_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    return bins.groupBy(*keys, "bin", "cal_bin").agg(
        *[total(m).alias(m) for m in ("pos", "neg", "score_sum")])


def model_scores_sketch(ih: DataFrame, spec: MetricSpec) -> DataFrame:
    """Count, personalization, novelty and four sketches (two scores, split by label)."""
    rows = scored_once(ih, spec)
    built = rows.groupBy(*spec.keys).agg(
        *[sketches.build(F.when(F.col(LABEL) == label, F.col(score))).alias(name)
          for name, (score, label) in SKETCHES.items()])
    return join_on_nullable(recommender_scores(rows, spec.keys), built, spec.keys, "left")


def model_scores_exact(ih: DataFrame, spec: MetricSpec) -> DataFrame:
    """Count, personalization, novelty, exact AUC and average precision per group."""
    rows = scored_once(ih, spec)
    exact = exact_binary_metrics(rows, spec.keys, cuts=score_cuts(rows))
    return join_on_nullable(recommender_scores(rows, spec.keys), exact, spec.keys, "left")


def model_scores(ih: DataFrame, spec: MetricSpec) -> DataFrame:
    return model_scores_sketch(ih, spec) if spec.use_sketch else model_scores_exact(ih, spec)


def score_cuts(ih: DataFrame, score: str = PROPENSITY) -> list[float]:
    """Cut points from the raw score column: one pruned scan instead of a second run of the labelling."""
    return cut_points(ih, [score])[score]


def exact_binary_metrics(rows: DataFrame, keys: Sequence[str], score: str = PROPENSITY,
                         cuts: Sequence[float] | None = None) -> DataFrame:
    """Rank-sum AUC (ties count half) and AP = sum of recall steps times precision.

    Rows collapse to one per (group, score); the running sums over scores are spread over value
    buckets, so one group may hold any share of the rows.
    """
    counts = rows.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        total(LABEL).alias("pos"), total(1 - F.col(LABEL)).alias("neg"))
    placed = prefix_sums(counts, keys, score, ["pos", "neg"], cuts)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pos_at_least = F.col("pos_total") - F.col("pos_before")
    all_at_least = pos_at_least + F.col("neg_total") - F.col("neg_before")
    measured = placed.groupBy(*keys).agg(
        F.sum(pos * (F.col("neg_before") + neg / 2)).alias("__won"),
        F.sum(pos * ratio(pos_at_least, all_at_least)).alias("__precision"),
        F.sum(pos).alias("__p"), F.sum(neg).alias("__n"))
    return measured.select(
        *keys,
        ratio(F.col("__won"), F.col("__p") * F.col("__n")).alias("roc_auc"),
        ratio(F.col("__precision"), F.col("__p")).alias("average_precision"))


# ---- curves -------------------------------------------------------------------------------


def shares_from_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: pos_count, neg_count and arrays tpr, fpr over falling thresholds, from (0, 0) to (1, 1).

    A group has at most 102 bins, so its list is of fixed size. The last point takes in the scores of 0 as well.
    """
    per_bin = bins.groupBy(*keys, "bin").agg(total("pos").alias("pos"), total("neg").alias("neg"))
    lists = per_bin.groupBy(*keys).agg(
        total("pos").alias("pos_count"), total("neg").alias("neg_count"),
        F.collect_list(F.struct("bin", "pos", "neg")).alias("__bins"))

    def above(name: str, i: Column) -> Column:
        return F.aggregate(F.filter("__bins", lambda b: b["bin"] > i), F.lit(0).cast("long"),
                           lambda acc, b: acc + b[name])

    falling = F.sequence(F.lit(101), F.lit(-1))
    return lists.select(
        *keys, "pos_count", "neg_count",
        F.transform(falling, lambda i: ratio(above("pos", i), F.col("pos_count"))).alias("tpr"),
        F.transform(falling, lambda i: ratio(above("neg", i), F.col("neg_count"))).alias("fpr"))


def shares_from_sketches(df: DataFrame, keys: Sequence[str], positives: str, negatives: str) -> DataFrame:
    """The same shape from two label sketches."""
    def falling(sketch: str) -> Column:
        inner = F.transform(F.reverse(sketches.ranks(sketch, THRESHOLDS)), lambda r: 1 - r)
        return F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0)))

    return df.select(*keys, sketches.size(positives).alias("pos_count"), sketches.size(negatives).alias("neg_count"),
                     falling(positives).alias("tpr"), falling(negatives).alias("fpr"))


def curve_scores(shares: DataFrame, keep: Sequence[str]) -> DataFrame:
    """AUC by trapezoids, average precision over monotone precision, curves, positive fraction.

    Groups without positives or without negatives score 0.
    """
    empty = (F.col("pos_count") == 0) | (F.col("neg_count") == 0)
    zero = F.array(F.lit(0.0))
    points = shares.withColumns({
        "__p": F.col("pos_count").cast("double"), "__n": F.col("neg_count").cast("double"),
        "__steps": F.sequence(F.lit(1), F.size("tpr") - 1),
    })

    def at(name: str, i: Column) -> Column:
        return F.get(F.col(name), i)

    area = F.aggregate("__steps", F.lit(0.0), lambda acc, i: acc + (
        at("fpr", i) - at("fpr", i - 1)) * (at("tpr", i) + at("tpr", i - 1)) / 2)
    raw = F.zip_with("tpr", "fpr", lambda t, f: F.try_divide(
        F.col("__p") * t, F.col("__p") * t + F.col("__n") * f + F.lit(EPS)))
    points = points.withColumns({"roc_auc": area, "__raw": raw})
    monotone = F.transform(F.sequence(F.lit(1), F.size("__raw")),
                           lambda i: F.array_max(F.slice("__raw", i, F.size("__raw") - i + 1)))
    points = points.withColumn("__mono", monotone)
    points = points.withColumns({"recall": F.col("tpr"), "precision": F.col("__mono")})
    area_pr = F.aggregate(F.sequence(F.lit(1), F.size("recall") - 1), F.lit(0.0), lambda acc, i: acc + (
        at("recall", i) - at("recall", i - 1)) * at("precision", i))
    points = points.withColumn("average_precision", area_pr)
    lists = ["tpr", "fpr", "precision", "recall"]
    return points.select(
        *keep,
        *[F.when(empty, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in ("roc_auc", "average_precision")],
        *[F.when(empty, zero).otherwise(F.col(c)).alias(c) for c in lists],
        F.when(empty, F.lit(0.0)).otherwise(ratio(F.col("__p"), F.col("__p") + F.col("__n"))).alias("pos_fraction"))


def calibration(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (bin 1..26): centre, mean score and positive rate; an empty bin has its centre and rate 0.

    The first bin is closed on the left, and what lies outside the edges counts in the first or last bin.
    """
    edges = CALIBRATION_EDGES
    frame = F.array(*[F.struct(F.lit(i + 1).alias("cal_bin"), F.lit((a + b) / 2).alias("calibration_bin"))
                      for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    keys = list(keys)
    groups = bins.select(*keys).distinct() if keys else bins.groupBy().agg(F.lit(1).alias("__one")).drop("__one")
    full = groups.select(*keys, F.explode(frame).alias("__f")).select(*keys, "__f.*")
    inside = F.greatest(F.lit(1), F.least(F.lit(len(edges) - 1), F.col("cal_bin")))
    summed = bins.withColumn("cal_bin", inside).groupBy(*keys, "cal_bin").agg(*[total(m).alias(m) for m in ("pos", "neg", "score_sum")])
    joined = join_on_nullable(full, summed, [*keys, "cal_bin"], "left")
    n = F.col("pos") + F.col("neg")
    return joined.select(
        *keys, "cal_bin", "calibration_bin",
        F.coalesce(ratio(F.col("score_sum"), n), F.col("calibration_bin")).alias("calibration_proba"),
        F.coalesce(ratio(F.col("pos"), n), F.lit(0.0)).alias("calibration_rate"),
        F.coalesce(n, F.lit(0)).alias("n"))


def calibration_from_sketches(df: DataFrame, keys: Sequence[str], positives: str, negatives: str) -> DataFrame:
    """Calibration rows from label sketches: rank differences give the masses and the rate, an even
    grid of quantiles gives the mean score inside a bin (its centre where the grid has no point)."""
    edges = CALIBRATION_EDGES
    shares = [i / sketches.GRID_STEPS for i in range(sketches.GRID_STEPS + 1)]
    marked = df.withColumns({
        "__rp": sketches.ranks(positives, edges), "__rn": sketches.ranks(negatives, edges),
        "__gp": sketches.quantiles(positives, shares), "__gn": sketches.quantiles(negatives, shares),
        "__p": sketches.size(positives).cast("double"), "__n": sketches.size(negatives).cast("double"),
        "__bins": F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(edges, edges[1:])]),
    })
    long = marked.select(*keys, "__rp", "__rn", "__gp", "__gn", "__p", "__n", F.posexplode("__bins").alias("__i", "__bin"))
    low, high = F.col("__bin.a"), F.col("__bin.b")
    centre = (low + high) / 2

    def mass(rank: str, size: str) -> Column:
        last = len(edges) - 2
        below = F.when(F.col("__i") == 0, 0.0).otherwise(F.get(rank, F.col("__i")))
        return F.col(size) * (F.when(F.col("__i") == last, 1.0).otherwise(F.get(rank, F.col("__i") + 1)) - below)

    def mean(grid: str) -> Column:
        first, last = F.col("__i") == 0, F.col("__i") == len(edges) - 2
        inside = F.filter(grid, lambda v: ((v > low) | first) & ((v <= high) | last))
        return F.coalesce(ratio(F.aggregate(inside, F.lit(0.0), lambda acc, v: acc + v), F.size(inside)), centre)

    p, n = mass("__rp", "__p"), mass("__rn", "__n")
    return long.select(*keys, (F.col("__i") + 1).alias("cal_bin"), centre.alias("calibration_bin"),
                       F.coalesce(ratio(mean("__gp") * p + mean("__gn") * n, p + n), centre).alias("calibration_proba"),
                       F.coalesce(ratio(p, p + n), F.lit(0.0)).alias("calibration_rate"), (p + n).alias("n"))


# ---- compaction ---------------------------------------------------------------------------


def _sketch_columns(df: DataFrame) -> list[str]:
    return [c for c in SKETCHES if c in df.columns]


def regroup_model_scores(stored: DataFrame, keys: Sequence[str], spec: MetricSpec) -> DataFrame:
    """Count-weighted means of the scores, summed counts, merged sketches."""
    scores = ("personalization", "novelty") if spec.use_sketch else spec.scores
    return stored.filter(F.col("Count") > 0).groupBy(*keys).agg(
        *[weighted_mean(s, "Count").alias(s) for s in scores],
        *[sketches.merge(c).alias(c) for c in (_sketch_columns(stored) if spec.use_sketch else [])],
        total("Count").alias("Count"))


def compact_model_scores(stored: DataFrame, spec: MetricSpec) -> DataFrame:
    return regroup_model_scores(stored, spec.keys, spec)


def group_model_scores(stored: DataFrame, spec: MetricSpec, group_by) -> DataFrame:
    return regroup_model_scores(stored, unique_in_order(group_by, spec.global_filters), spec)


def with_all_key(df: DataFrame, group_by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Without grouping columns, one group named ALL."""
    keys = unique_in_order(group_by)
    return (df, keys) if keys else (df.withColumn(ALL, F.lit(ALL)), [ALL])
