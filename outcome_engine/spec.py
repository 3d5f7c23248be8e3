"""Metric and report descriptions. A spec is data: column names, outcome lists, filters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column

# Canonical column names of the input model.
INTERACTION_ID = "InteractionID"
SUBJECT_ID = "SubjectID"
ACTION_ID = "ActionID"
ISSUE, GROUP, NAME, RANK = "Issue", "Group", "Name", "Rank"
OUTCOME = "Outcome"
OUTCOME_TIME, DECISION_TIME = "OutcomeTime", "DecisionTime"
CONTROL_GROUP = "ModelControlGroup"
CONVERSION_EVENT_ID = "ConversionEventID"
REVENUE, PROPENSITY, FINAL_PROPENSITY = "Revenue", "Propensity", "FinalPropensity"
CONTROL, TEST, ALL = "Control", "Test", "ALL"

INTERACTION_KEYS = [INTERACTION_ID, ACTION_ID, RANK]
DEDUP_KEYS = INTERACTION_KEYS + [OUTCOME]

FAMILIES = ("engagement", "conversion", "experiment", "descriptive", "model_ml_scores", "clv")


def unique_in_order(*names) -> list[str]:
    """Flatten names and lists of names, keep the first of each, keep the order."""
    flat: list[str] = []
    for item in names:
        flat.extend([item] if isinstance(item, str) else list(item or ()))
    return list(dict.fromkeys(n for n in flat if n))


@dataclass(frozen=True)
class MetricSpec:
    name: str
    group_by: tuple[str, ...] = ()
    global_filters: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    where: Column | str | None = None
    columns: tuple[str, ...] = ()
    scores: tuple[str, ...] = ()
    use_sketch: bool = True
    experiment_name: str = "ExperimentName"
    experiment_group: str = "ExperimentGroup"
    order_id_col: str = "HoldingID"
    customer_id_col: str = SUBJECT_ID
    monetary_value_col: str = "OneTimeCost"
    purchase_date_col: str = "PurchasedDate"
    model: str = "non-contractual"
    recurring_cost_col: str = "RecurringCost"
    recurring_period_col: str = "RecurringPeriod"
    lifespan: int = 2000
    segment_map: str | None = None

    @property
    def family(self) -> str:
        for family in FAMILIES:
            if self.name.startswith(family):
                return family
        raise ValueError(f"no metric family for {self.name!r}")

    @property
    def keys(self) -> list[str]:
        """Grouping columns of the first-level aggregate."""
        if self.family == "engagement":
            return unique_in_order(self.group_by, self.global_filters, CONTROL_GROUP)
        if self.family == "experiment":
            return unique_in_order(self.global_filters, self.group_by,
                                   self.experiment_name, self.experiment_group)
        if self.family == "clv":
            return unique_in_order(self.group_by, self.customer_id_col, "Year", "Quarter")
        return unique_in_order(self.group_by, self.global_filters)

    def but(self, **changes) -> "MetricSpec":
        return replace(self, **changes)


@dataclass(frozen=True)
class ReportSpec:
    metric: MetricSpec
    group_by: tuple[str, ...] = ()
    x: str | None = None
    y: str | None = None
    color: str | None = None
    facet_row: str | None = None
    facet_column: str | None = None
    value: str | None = None
    score_column: str = PROPENSITY
    stages: tuple[str, ...] = ()
    reference: dict = field(default_factory=dict)

    @property
    def dimensions(self) -> list[str]:
        """Dimensions chosen for a chart: x, facets, then colour."""
        return unique_in_order(self.x, self.facet_column, self.facet_row, self.color)

    def but(self, **changes) -> "ReportSpec":
        return replace(self, **changes)
