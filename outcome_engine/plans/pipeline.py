"""From raw records to stored aggregates, and from stored aggregates to reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from outcome_engine.operators import clv as clv_ops
from outcome_engine.operators.clean import CleaningConfig, clean_holdings, clean_interactions
from outcome_engine.operators.filters import filter_dimensions
from outcome_engine.operators.merge import aggregate, compact, merge_loads
from outcome_engine.plans.reports import report_scores
from outcome_engine.session import new_folder
from outcome_engine.sources.store import AggregateStore
from outcome_engine.spec import MetricSpec, ReportSpec


def store_metrics(ih: DataFrame, specs: Sequence[MetricSpec], store: AggregateStore) -> None:
    """Aggregate a cleaned frame for every metric, merge with what is stored, write the next version.

    Several metrics read the frame, so it is written once to the shared folder; each metric then reads its columns.
    """
    if len(specs) > 1:
        path = new_folder(ih.sparkSession, "cleaned")
        ih.write.parquet(path)
        ih = ih.sparkSession.read.schema(ih.schema).parquet(path)
    for spec in specs:
        stored = store.read(spec.name) if store.exists(spec.name) else None
        store.replace(spec.name, merge_loads(stored, aggregate(ih, spec), spec))


def compact_table(store: AggregateStore, spec: MetricSpec) -> None:
    """Merge the batches of a table into its next version (between stream runs, not during one). Of change records, tuples
    that nothing is left of stay as rows of 0."""
    store.replace(spec.name, compact(store.read(spec.name), spec))


def load_interactions(raw: DataFrame, config: CleaningConfig, specs: Sequence[MetricSpec],
                      store: AggregateStore) -> None:
    store_metrics(clean_interactions(raw, config), specs, store)


def load_holdings(raw: DataFrame, config: CleaningConfig, spec: MetricSpec, store: AggregateStore, as_of) -> None:
    """Purchase aggregates are appended, not compacted."""
    store.append(spec.name, clv_ops.clv(clean_holdings(raw, config), spec, as_of))


def report(store: AggregateStore, spec: ReportSpec, selected: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Score a stored table; dimension filters come before scoring. Batches and loads are merged first, so what only one
    side of was seen in one load counts with the other side from another."""
    stored = filter_dimensions(store.read(spec.metric.name), selected or {})
    return report_scores(compact(stored, spec.metric), spec)
