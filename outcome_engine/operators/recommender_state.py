"""Personalization and novelty over loads: counted state per (customer, item), and sums that add up.

Neither score can be averaged over loads: customers, lists and interactions go on from one load into the next. What does add up are
sums per item: rows, the customers' unit vectors, and the number of customers and of lists by length. A load reads
the earlier counts of its own customers and lists only, and writes by how much it changes those sums. Rows that no longer count
(an impression whose click comes in a later load) are taken out in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_engine.functions.columns import ratio
from outcome_engine.operators.changes import before_and_after, changed_cells, interaction_cells
from outcome_engine.operators.filters import apply_where
from outcome_engine.operators.labels import label_outcomes
from outcome_engine.operators.ml import EPS
from outcome_engine.session import written
from outcome_engine.sources.load_log import KEY, LoadLog, key_digest
from outcome_engine.spec import INTERACTION_ID, NAME, SUBJECT_ID, MetricSpec, unique_in_order

ITEM, CUSTOMERS, LISTS, LABELS = "item", "customers", "lists", "labels"
MEASURES = ("rows", "unit", "positives")


def _before_and_after(log: LoadLog, load: int, names: list[str]) -> DataFrame:
    """Rows per (key, names) of what this load touches: without it and with it. They stay in the log's buckets."""
    both = before_and_after(log.met_by(load), load, names, ["rows"])
    return both.withColumnsRenamed({"rows_before": "before", "rows_after": "after"})


class RecommenderRecords:
    """Score sums of loads that come one after the other, at the grain of the spec's keys.

    The logs lie below `path`, in tables whose names begin with `name`; `schema` is that of the interactions.
    A load that is repeated replaces itself.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, spec: MetricSpec, schema: T.StructType, buckets: int = 64):
        if spec.family != "model_ml_scores":
            raise ValueError(f"no recommender scores for {spec.family}")
        self.spec = spec
        self.dims = unique_in_order(spec.keys, SUBJECT_ID, NAME, INTERACTION_ID)

        def listed(names):
            return "".join(f"`{n}` {schema[n].dataType.simpleString()}, " for n in names)

        self.cells = LoadLog(spark, f"{name}_cells", f"{path}/cells", f"{listed(self.dims)}all_rows BIGINT, won_rows BIGINT", buckets)
        self.pairs = LoadLog(spark, f"{name}_pairs", f"{path}/pairs", f"{listed(unique_in_order(spec.keys, NAME))}rows BIGINT", buckets)
        self.lists = LoadLog(spark, f"{name}_lists", f"{path}/lists", f"{listed(spec.keys)}rows BIGINT", buckets)

    def changes(self, ih: DataFrame, load: int) -> DataFrame:
        """(keys, part, item, length, rows, unit, positives) to add for this load."""
        keys = self.spec.keys
        labelled = label_outcomes(apply_where(ih, self.spec.where), self.spec.positive, self.spec.negative)
        self.cells.write(load, interaction_cells(labelled, self.dims, (), self.cells))
        # neither these changes nor the counts below are combined before they go to their buckets: each is one shuffle
        changed = changed_cells(self.cells.met_by(load), load, self.dims, ()).withColumnsRenamed({"Count": "rows", "Positives": "positives"})
        changed = written(changed.where("rows <> 0 OR positives <> 0"), "changed")

        def count(log: LoadLog, owner: list[str], names: list[str]) -> None:
            keyed = changed.where("rows <> 0").select(key_digest(owner).alias(KEY), *names, "rows")
            log.write(load, log.dealt(keyed).groupBy(KEY, *names).agg(F.sum("rows").alias("rows")).where("rows <> 0"))

        count(self.pairs, unique_in_order(keys, SUBJECT_ID), unique_in_order(keys, NAME))
        count(self.lists, unique_in_order(keys, INTERACTION_ID), keys)
        parts = [self._item_changes(load), self._list_changes(load),
                 self._part(changed, LABELS, positives=F.sum("positives"))]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.where("rows <> 0 OR unit <> 0 OR positives <> 0")

    def _part(self, df: DataFrame, part: str, item: str | None = None, length: str | None = None, **sums) -> DataFrame:
        zero = {"rows": F.lit(0).cast("long"), "unit": F.lit(0.0), "positives": F.lit(0).cast("long")}
        item_type = dict(self.pairs.of(0).dtypes)[NAME]
        by = unique_in_order(self.spec.keys, [c for c in (item, length) if c])
        made = df.groupBy(*by).agg(*[sums.get(m, F.max(zero[m])).alias(f"__{m}") for m in MEASURES])
        return made.select(
            *self.spec.keys, F.lit(part).alias("part"), (F.col(item) if item else F.lit(None).cast(item_type)).alias("item"),
            (F.col(length) if length else F.lit(None)).cast("long").alias("length"),
            *[F.coalesce(F.col(f"__{m}"), zero[m]).alias(m) for m in MEASURES])

    def _item_changes(self, load: int) -> DataFrame:
        both = _before_and_after(self.pairs, load, unique_in_order(self.spec.keys, NAME))
        owner = Window.partitionBy(KEY)
        # the ordered window first: its order serves the others, which then need no sort of their own
        both = both.withColumn("first", F.row_number().over(owner.orderBy(F.col(NAME).asc_nulls_first())) == 1)
        for when in ("before", "after"):
            n = F.col(when).cast("double")
            both = both.withColumn(f"norm_{when}", F.sqrt(F.sum(n * n).over(owner)))

        def unit(when: str):
            return F.coalesce(ratio(when, f"norm_{when}"), F.lit(0.0))

        def there(when: str):
            return (F.col("first") & (F.col(f"norm_{when}") > 0)).cast("long")

        both = written(both.select(*unique_in_order(self.spec.keys, NAME), (F.col("after") - F.col("before")).alias("more"),
                                   (unit("after") - unit("before")).alias("turn"), (there("after") - there("before")).alias("come")), "item_changes")
        return self._part(both, ITEM, NAME, rows=F.sum("more"), unit=F.sum("turn")).unionByName(
            self._part(both, CUSTOMERS, rows=F.sum("come")))

    def _list_changes(self, load: int) -> DataFrame:
        """Lists by length: one less of the old length, one more of the new. The longest is then read off, also when lists shrink."""
        both = _before_and_after(self.lists, load, list(self.spec.keys)).where("before <> after")
        moved = both.select(*self.spec.keys, F.explode(F.array(
            F.struct(F.col("before").alias("long"), F.lit(-1).alias("step")),
            F.struct(F.col("after").alias("long"), F.lit(1).alias("step")))).alias("m")).select(*self.spec.keys, "m.*")
        return self._part(moved.where("`long` > 0"), LISTS, length="long", rows=F.sum("step"))


def compact_records(stored: DataFrame, spec: MetricSpec) -> DataFrame:
    """One row per (keys, part, item, length): the sum of all loads, to be stored in their place."""
    return stored.groupBy(*spec.keys, "part", "item", "length").agg(*[F.sum(m).alias(m) for m in MEASURES])


def scores_of_records(stored: DataFrame, spec: MetricSpec) -> DataFrame:
    """(keys, Count, personalization, novelty) of all loads together: what one load of everything gives.

    Groups without a positive drop out. Two combined aggregations, no row of an interaction or a customer is read.
    """
    summed = compact_records(stored, spec)
    is_item, n = F.col("part") == ITEM, F.col("rows").cast("double")
    some = is_item & (F.col("rows") > 0)
    sums = summed.groupBy(*spec.keys).agg(
        F.sum(F.when(is_item, F.col("rows"))).alias("Count"), F.sum("positives").alias("__positives"),
        F.sum(F.when(F.col("part") == CUSTOMERS, F.col("rows"))).alias("__users"),
        F.sum(F.when(some, F.col("unit") * F.col("unit"))).alias("__similar"), F.sum(F.when(some, n * F.log2(n))).alias("__nlog"),
        F.max(F.when((F.col("part") == LISTS) & (F.col("rows") > 0), F.col("length"))).alias("__longest"))
    u, rows = F.col("__users").cast("double"), F.col("Count")
    # sums that grew by differences may miss 0 by a rounding error
    spread = F.when(u > 1, F.greatest(F.lit(0.0), 1 - ratio(F.col("__similar") - u, u * (u - 1)))).otherwise(F.lit(0.0))
    info = F.log2(u) * rows - F.col("__nlog") - F.lit(EPS) * rows
    return sums.where("__positives > 0 AND Count > 0").select(
        *spec.keys, "Count", spread.alias("personalization"), ratio(info, u * F.col("__longest")).alias("novelty"))
