"""Change records: aggregates of a load that correct those of earlier loads.

An impression in one file and the click on it in a later one are one interaction, of which only the click counts. So the cells of
every load (rows per interaction and dimensions) are kept in a log. A load looks up the earlier cells of its interactions and
writes what has changed: minus one negative where the impression was, plus one positive where the click is. Stored
aggregates stay plain sums, and the sum over all loads is what one load of everything gives. A load touches no interaction
but its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_engine.functions.columns import total
from outcome_engine.operators.conversion import TOUCH_KEYS, touchpoints
from outcome_engine.operators.filters import apply_where
from outcome_engine.operators.labels import LABEL, label_outcomes
from outcome_engine.sources.load_log import KEY, LoadLog, key_digest
from outcome_engine.spec import INTERACTION_KEYS, REVENUE, MetricSpec, unique_in_order

WHEN = ("before", "after")


def interaction_cells(labelled: DataFrame, dims: Sequence[str], sums: Sequence[str], log: LoadLog) -> DataFrame:
    """Rows, positives and sums of each (interaction, dims). Rows go to the buckets of `log` and are counted there, in one shuffle
    instead of one for the groups and one for the buckets; a hot interaction streams through one task that holds its few cells."""
    won = F.col(LABEL) == 1
    keyed = labelled.select(key_digest(INTERACTION_KEYS).alias(KEY), *unique_in_order(dims, LABEL, sums))
    return log.dealt(keyed).groupBy(KEY, *dims).agg(
        F.count("*").alias("all_rows"), F.count(F.when(won, 1)).alias("won_rows"),
        *[total(c).alias(f"all_{c}") for c in sums], *[total(F.when(won, F.col(c))).alias(f"won_{c}") for c in sums])


def before_and_after(rows: DataFrame, load: int, names: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums per (key, names) over the loads before `load`, and with it. Rows of a log stay in their buckets."""
    earlier = F.col("load") < int(load)
    return rows.groupBy(KEY, *names).agg(*[F.sum(F.when(earlier, F.col(m)).otherwise(0)).alias(f"{m}_before") for m in measures],
                                         *[F.sum(m).alias(f"{m}_after") for m in measures])


def changed_cells(met: DataFrame, load: int, dims: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Per (interaction, dims) what the best-outcome rule keeps with the load less what it kept without: Count, Positives, sums.
    `met` has the load's cells and the earlier ones of its interactions."""
    measures = ["all_rows", "won_rows", *[f"{kind}_{c}" for kind in ("all", "won") for c in sums]]
    cells = before_and_after(met, load, dims, measures)
    for when in WHEN:
        cells = cells.withColumn(f"any_{when}", F.max(f"won_rows_{when}").over(Window.partitionBy(KEY)) > 0)

    def kept(measure: str, when: str):
        return F.when(F.col(f"any_{when}"), F.col(f"won_{measure}_{when}")).otherwise(F.col(f"all_{measure}_{when}"))

    def change(measure: str):
        return kept(measure, "after") - kept(measure, "before")

    return cells.select(*dims, change("rows").alias("Count"), (F.col("won_rows_after") - F.col("won_rows_before")).alias("Positives"),
                        *[change(c).alias(c) for c in sums])


class ChangeRecords:
    """Engagement, experiment or conversion aggregates of loads that come one after the other.

    The logs lie below `path`, in tables whose names begin with `name`. `schema` is that of the interactions.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, spec: MetricSpec, schema: T.StructType, buckets: int = 64):
        if spec.family not in ("engagement", "experiment", "conversion"):
            raise ValueError(f"no change records for {spec.family}")
        self.spec, self.touches = spec, spec.family == "conversion"
        self.sums = [REVENUE] if self.touches else []
        self.dims = unique_in_order(spec.keys, TOUCH_KEYS) if self.touches else spec.keys

        def listed(names):
            return "".join(f"`{n}` {schema[n].dataType.simpleString()}, " for n in names)

        amounts = "".join(f", `{kind}_{c}` DOUBLE" for kind in ("all", "won") for c in self.sums)
        self.cells = LoadLog(spark, f"{name}_cells", f"{path}/cells", f"{listed(self.dims)}all_rows BIGINT, won_rows BIGINT{amounts}", buckets)
        if self.touches:
            self.kept = LoadLog(spark, f"{name}_kept", f"{path}/kept", f"{listed(spec.keys)}Count BIGINT, Positives BIGINT, `{REVENUE}` DOUBLE", buckets)
            self.touched = LoadLog(spark, f"{name}_touched", f"{path}/touched", "Touchpoints BIGINT", buckets)

    def changes(self, ih: DataFrame, load: int) -> DataFrame:
        """Aggregates to add for this load: the family's columns, with negative numbers where earlier rows no longer count."""
        labelled = label_outcomes(apply_where(ih, self.spec.where), self.spec.positive, self.spec.negative)
        self.cells.write(load, interaction_cells(labelled, self.dims, self.sums, self.cells))
        cells = changed_cells(self.cells.met_by(load), load, self.dims, self.sums)
        changed = cells.where(" OR ".join(f"`{c}` <> 0" for c in ("Count", "Positives", *self.sums)))
        if not self.touches:
            return self._summed(changed, ())
        per_customer = changed.groupBy(*self.dims).agg(*[total(c).alias(c) for c in ("Count", "Positives", REVENUE)])
        known = F.forall(F.array(*[F.col(k).isNotNull() for k in TOUCH_KEYS]), lambda x: x)
        self.kept.write(load, per_customer.withColumn(KEY, F.when(known, key_digest(TOUCH_KEYS))))
        self.touched.write(load, touchpoints(labelled).dropna(subset=TOUCH_KEYS).withColumn(KEY, key_digest(TOUCH_KEYS)))
        return self._summed(self.kept.of(load).drop(KEY).withColumn("Touchpoints", F.lit(0).cast("long")).unionByName(
            self._touch_changes(load), allowMissingColumns=True), ("Touchpoints", REVENUE))

    def _touch_changes(self, load: int) -> DataFrame:
        """Every kept row carries all touchpoints of its (customer, event): both factors may have changed."""
        affected = self.kept.of(load).select(KEY).union(self.touched.of(load).select(KEY)).dropna()

        rows = before_and_after(self.kept.met_by(load, affected), load, self.spec.keys, ["Count"])
        touches = before_and_after(self.touched.met_by(load, affected), load, (), ["Touchpoints"])
        change = F.col("Count_after") * F.col("Touchpoints_after") - F.col("Count_before") * F.col("Touchpoints_before")
        return rows.join(touches.hint("merge"), KEY).select(*self.spec.keys, change.alias("Touchpoints")).where("Touchpoints <> 0")

    def _summed(self, changed: DataFrame, more: Sequence[str]) -> DataFrame:
        summed = changed.groupBy(*self.spec.keys).agg(*[total(c).alias(c) for c in ("Count", "Positives", *more)])
        return summed.withColumn("Negatives", F.col("Count") - F.col("Positives"))


def merged_changes(stored: DataFrame, spec: MetricSpec) -> DataFrame:
    """The sum of all change records: dimension tuples that nothing is left of are gone, as if they had never been there."""
    measures = [c for c in ("Negatives", "Positives", "Revenue", "Count", "Touchpoints") if c in stored.columns]
    return stored.groupBy(*spec.keys).agg(*[total(m).alias(m) for m in measures]).where("Count <> 0")
