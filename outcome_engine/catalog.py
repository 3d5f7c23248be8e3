"""Registered queries: every operator run over the given tables. Keys are the operator ids."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcome_engine import fixtures
from outcome_engine.functions import sketches, stats
from outcome_engine.functions.columns import ratio, round_columns, total, weighted_mean
from outcome_engine.operators import (changes, clean, conversion, descriptive, engagement, event_index, filters, labels,
                                      merge, ml, recommender_state)
from outcome_engine.operators import clv as clv_ops
from outcome_engine.plans import customers, pipeline, profile, purchase_models, reports, tables
from outcome_engine.session import new_folder
from outcome_engine.sources import files, store
from outcome_engine.spec import MetricSpec, ReportSpec
from outcome_engine.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FILTERS = ("Channel", "Year", "CustomerType")
CLICKS = {"positive": ("Clicked",), "negative": ("Impression", "Pending"), "global_filters": FILTERS}
ENGAGEMENT = MetricSpec("engagement", ("Month", "Year", "Quarter", "Channel", "CustomerType", "Issue"), **CLICKS)
CONVERSION = MetricSpec("conversion", ("Month", "Year", "Quarter", "Channel", "CustomerType", "Issue"),
                        positive=("Conversion",), negative=("Impression",), global_filters=FILTERS)
EXPERIMENT = MetricSpec("experiment", ("Year", "Channel", "CustomerType"), **CLICKS)
EXPERIMENT3 = EXPERIMENT.but(experiment_group="ExperimentGroup3")
DESCRIPTIVE = MetricSpec(
    "descriptive", ("Year", "Quarter", "Channel", "CustomerType", "Issue", "Outcome"), FILTERS,
    columns=("Outcome", "Propensity", "FinalPropensity", "Priority", "ResponseYears"),
    scores=("Count", "Sum", "Mean", "Median", "p25", "p75", "p90", "p95", "Std", "Var", "Skew"))
EXACT = DESCRIPTIVE.but(use_sketch=False)
MODEL = MetricSpec("model_ml_scores", ("Month", "Year", "Quarter", "Channel", "CustomerType"),
                   scores=("roc_auc", "average_precision", "personalization", "novelty"), **CLICKS)
PURCHASES = MetricSpec("clv", ("ControlGroup",), customer_id_col="CustomerID", purchase_date_col="PurchasedDateTime",
                       lifespan=9, segment_map="retail_banking")
AS_OF = "2002-01-01"
BGNBD_PARAMS = (0.8, 120.0, 0.9, 2.4)
GAMMA_PARAMS = (2.5, 3.5, 900.0)
EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def as_int(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("int") for n in names})


def plain_year(df: DataFrame) -> DataFrame:
    return as_int(df, "Year") if "Year" in df.columns else df


def ih(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.interactions(spark, folder)


def described(spark: SparkSession, folder: str) -> DataFrame:
    return clean.with_calculated(ih(spark, folder), {"ResponseYears": "ResponseTime / 31536000.0D"})


def stored(spark: SparkSession, aggregates: DataFrame) -> DataFrame:
    """First-level aggregates as a written table: what reports read, once or several times."""
    target = new_folder(spark, "aggregates")
    aggregates.write.parquet(target)
    return spark.read.parquet(target)


def skilled(spark: SparkSession, folder: str) -> DataFrame:
    """Interactions whose propensity carries information."""
    return ih(spark, folder).withColumn("Propensity", F.col("SkilledPropensity"))


def labelled(spark: SparkSession, folder: str, spec: MetricSpec = ENGAGEMENT) -> DataFrame:
    return labels.label_outcomes(ih(spark, folder), spec.positive, spec.negative)


# ---- sources and sinks --------------------------------------------------------------------------


@query
def src_parquet(spark, folder):
    target = new_folder(spark, "parquet")
    orders = fixtures.table(spark, folder, "orders")
    orders.select("o_orderkey", "o_custkey").write.parquet(f"{target}/first")
    orders.select("o_orderkey", "o_totalprice", "o_orderpriority").write.parquet(f"{target}/second")
    both = files.read_parquet(spark, [f"{target}/first", f"{target}/second"],
                              "o_orderkey long, o_custkey long, o_totalprice double")
    missing = {"no_customer": F.col("o_custkey").isNull(), "no_price": F.col("o_totalprice").isNull()}
    return both.groupBy(*[c.alias(n) for n, c in missing.items()]).agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query
def src_hive(spark, folder):
    target = new_folder(spark, "hive")
    fixtures.table(spark, folder, "events").write.partitionBy("event_type").parquet(target)
    read = files.read_parquet(spark, target, base_path=target)
    return read.filter(F.col("event_type").isin("click", "view")).groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def _customers_by_segment(df: DataFrame) -> DataFrame:
    return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


CUSTOMER_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query
def src_ndjson(spark, folder):
    target = new_folder(spark, "json")
    fixtures.table(spark, folder, "customer").write.json(target)
    return _customers_by_segment(files.read_records(spark, target, "json", CUSTOMER_SCHEMA))


@query
def src_gzip(spark, folder):
    target = new_folder(spark, "gzip")
    fixtures.table(spark, folder, "customer").write.option("compression", "gzip").json(target)
    return _customers_by_segment(files.read_json(spark, target, CUSTOMER_SCHEMA))


def write_zips(lines: DataFrame, target: str) -> None:
    """Each Arrow batch becomes a zip file with two JSON members without final newline, named by its content."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage, place = files.open_storage(target)
        storage.create_dir(place, recursive=True)
        for pdf in frames:
            rows = list(pdf["line"])
            half = len(rows) // 2
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                for name, text in (("b.json", "\n".join(rows[half:])), ("a.json", "\n".join(rows[:half])), ("readme.txt", "not data")):
                    archive.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
            name = f"export-{hashlib.md5(chr(10).join(rows).encode()).hexdigest()}.zip"
            with storage.open_output_stream(f"{place}/{name}") as out:
                out.write(buffer.getvalue())
            yield pd.DataFrame({"name": [name]})

    lines.mapInPandas(pack, "name string").write.format("noop").mode("overwrite").save()


@query
def src_archive(spark, folder):
    """Zip files in the shared folder, their members read in parallel."""
    rows = fixtures.table(spark, folder, "customer")
    target = new_folder(spark, "archives")
    write_zips(rows.select(F.to_json(F.struct(*rows.columns)).alias("line")), target)
    return _customers_by_segment(files.read_archives(spark, f"{target}/*.zip", CUSTOMER_SCHEMA))


@query
def src_csv(spark, folder):
    target = new_folder(spark, "csv")
    fixtures.table(spark, folder, "customer").write.option("header", True).option("sep", ";").csv(target)
    return _customers_by_segment(files.read_records(spark, target, "csv", CUSTOMER_SCHEMA))


@query
def src_discover(spark, folder):
    target = new_folder(spark, "discover")
    fixtures.table(spark, folder, "customer").write.json(f"{target}/deep/er")
    found = files.list_files(spark, target, "*.parquet")
    kind = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    read = spark.read.schema(CUSTOMER_SCHEMA).option("recursiveFileLookup", True).json(target)
    endings = found.select(kind.alias("kind")).distinct()
    return _customers_by_segment(read).withColumn("kind", endings.scalar())


@query
def src_group(spark, folder):
    target = new_folder(spark, "groups")
    orders = fixtures.table(spark, folder, "orders").withColumn("Year", F.year("o_orderdate"))
    orders.write.partitionBy("Year").parquet(target)
    tagged = files.with_file_group(spark.read.parquet(target), "Year=([0-9]+)/")
    return tagged.groupBy("file_group").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query
def src_incremental(spark, folder):
    target, ledger = new_folder(spark, "loaded"), new_folder(spark, "ledger")
    for _ in range(2):
        stream = incremental.file_stream(spark, folder, EVENT_SCHEMA, "events.parquet")
        incremental.load_new_files(stream, target, ledger).awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query
def src_sample(spark, folder):
    return files.stable_sample(fixtures.table(spark, folder, "customer"), 1000, 42, ["c_custkey"])


@query
def union_diagonal(spark, folder):
    buyers = fixtures.table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    sellers = fixtures.table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return merge.union_diagonal(buyers, sellers).groupBy("nation").agg(
        F.count("*").alias("n"), F.count("segment").alias("with_segment"), F.count("name").alias("with_name"),
        F.round(F.sum("balance"), 2).alias("balance"))


@query
def snk_agg_table(spark, folder):
    kept = store.AggregateStore(spark, new_folder(spark, "tables"))
    counts = engagement.engagement(ih(spark, folder), ENGAGEMENT)
    kept.append("engagement", counts)
    kept.append("engagement", kept.read("engagement"))
    kept.replace("engagement", merge.compact(kept.read("engagement"), ENGAGEMENT))
    return engagement.sum_counts(kept.read("engagement"), ["Channel", "CustomerType"])


@query
def snk_agg_json(spark, folder):
    target = new_folder(spark, "export")
    counts = engagement.engagement(ih(spark, folder), ENGAGEMENT)
    sketched = descriptive.descriptive_sketch(described(spark, folder), DESCRIPTIVE)
    store.export_json({"engagement": counts, "descriptive": sketched}, target)
    read = store.import_json(spark, target, {"engagement": counts.schema, "descriptive": sketched.schema})
    summed = engagement.sum_counts(read["engagement"], ["Channel"])
    values = read["descriptive"].groupBy("Channel").agg(
        sketches.size(sketches.merge("Priority_sketch")).alias("sketched_values"))
    return summed.join(values, "Channel")


@query
def snk_rfm_csv(spark, folder):
    target = new_folder(spark, "rfm")
    summary = rfm(spark, folder)
    store.write_csv(summary, target)
    return _rfm_out(spark.read.schema(summary.schema).option("header", True).csv(target))


# ---- projections, filters, cleaning ---------------------------------------------------------------


@query
def prj_drop_technical(spark, folder):
    e = fixtures.table(spark, folder, "events")
    raw = e.select("event_id", "event_type", "value", F.col("user_id").alias("pyOperator"),
                   F.col("props").alias("pxFactID"), F.col("ts").cast("string").alias("pxUpdateDateTime"))
    return clean.drop_technical(raw)


@query
def prj_canonical_names(spark, folder):
    raw = fixtures.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pxOrderKey"), F.col("o_custkey").alias("pyCustomer"),
        F.col("o_orderstatus").alias("pyStatus"), F.col("o_orderpriority").alias("Status"),
        F.col("o_totalprice").alias("totalPrice"))
    return clean.with_canonical_names(raw)


@query
def prj_defaults(spark, folder):
    raw = fixtures.table(spark, folder, "events").select(
        F.expr("nullif(event_type, 'error')").alias("Kind"),
        F.expr("CASE WHEN event_type <> 'view' THEN value END").alias("Value"))
    filled = clean.with_defaults(raw, {"Kind": "N/A", "Value": "0.5", "Weight": "1.5", "Source": "none"})
    return filled.groupBy("Kind", "Weight", "Source").agg(
        F.count("*").alias("n"), F.round(F.sum("Value"), 2).alias("Value"))


@query
def flt_global(spark, folder):
    kept = filters.apply_where(ih(spark, folder),
                               "Outcome IN ('Clicked', 'Conversion') AND Channel IN ('1-URGENT', '2-HIGH')")
    return kept.groupBy("Channel", "Outcome").agg(F.count("*").alias("n"))


@query
def flt_metric(spark, folder):
    spec = ENGAGEMENT.but(where=~F.col("ExperimentName").startswith("ECONOMY"))
    return engagement.sum_counts(engagement.engagement(ih(spark, folder), spec), ["Issue"])


RULE_ROWS = {
    "eq": ("Status", "==", "F"), "ne": ("Status", "!=", "F"), "gt": ("Price", ">", "200000"),
    "ge": ("Price", ">=", "200000"), "lt": ("Price", "<", "100000.5"), "le": ("Price", "<=", "100000.5"),
    "contains": ("Priority", "contains", "[12]-"), "starts": ("Priority", "starts with", "3-"),
    "inside": ("Priority", "in", "1-URGENT,2-HIGH"), "outside": ("Priority", "not in", "1-URGENT,2-HIGH"),
    "missing": ("Maybe", "is null", ""), "present": ("Maybe", "is not null", ""),
}


@query
def flt_rules(spark, folder):
    rows = fixtures.table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("Status"), F.col("o_totalprice").alias("Price"),
        F.col("o_orderpriority").alias("Priority"), F.expr("nullif(o_orderstatus, 'P')").alias("Maybe"))

    def rule(*names):
        return [{"Field": f, "Operator": o, "Value": v, "Enabled": True} for f, o, v in (RULE_ROWS[n] for n in names)]

    both = filters.rules_to_column(rule("ne", "gt", "outside"))
    counted = [F.count_if(filters.rules_to_column(rule(n))).alias(n) for n in RULE_ROWS]
    return rows.agg(*counted, F.count_if(both).alias("combined"))


@query
def flt_interactive(spark, folder):
    kept = filters.filter_interactive(
        ih(spark, folder), values={"Channel": ["1-URGENT", "3-MEDIUM"]}, ranges={
            "Priority": (10, 40), "OutcomeTime": (pd.Timestamp("1997-01-01").to_pydatetime(),
                                                  pd.Timestamp("2000-12-31").to_pydatetime())},
        patterns={"CustomerType": "^(auto|build)"}, case=False)
    return kept.groupBy("Channel", "CustomerType").agg(F.count("*").alias("n"))


@query
def flt_dimension(spark, folder):
    first_level = engagement.engagement(ih(spark, folder), ENGAGEMENT)
    kept = filters.filter_dimensions(first_level, {"Channel": ["1-URGENT", "5-LOW"], "Year": [1997, 1998],
                                              "CustomerType": [], "Absent": ["x"]})
    return plain_year(engagement.sum_counts(kept, ["Channel", "Year"]))


@query
def prj_calculated(spark, folder):
    made = clean.with_calculated(ih(spark, folder), {
        "Value": "CASE WHEN Outcome = 'Conversion' THEN Revenue ELSE 0.0 END", "Late": "ResponseTime > 86400", "Skip": " "})
    return made.groupBy("Late").agg(F.count("*").alias("n"), F.round(F.sum("Value"), 4).alias("Value"))


@query
def prj_time_alias(spark, folder):
    raw = fixtures.table(spark, folder, "orders").withColumn("When", F.col("o_orderdate"))
    aliased = clean.with_time_aliases(raw, "When", "o_orderdate")
    return aliased.groupBy(F.year("OutcomeTime").alias("outcome_year"), F.year("DecisionTime").alias("decision_year")
                           ).agg(F.count("*").alias("n"))


@query
def prj_time_parse(spark, folder):
    e = fixtures.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss.SSS"), F.lit(" GMT"))
    raw = e.select("event_type", text.alias("strict"),
                   F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(text).alias("lenient"))
    parsed = raw.select("event_type", clean.parse_time("strict").alias("a"), clean.parse_time("lenient", True).alias("b"))
    return parsed.groupBy("event_type").agg(
        F.sum(F.unix_millis("a")).alias("strict_millis"), F.count("b").alias("lenient_known"))


@query
def prj_action_id(spark, folder):
    raw = ih(spark, folder).drop("ActionID").withColumn("Issue", F.expr("nullif(Issue, 'PROMO')"))
    return clean.with_action_id(raw).groupBy("ActionID").agg(F.count("*").alias("n"))


@query
def prj_calendar(spark, folder):
    dated = clean.with_calendar(fixtures.table(spark, folder, "orders"), "o_orderdate")
    return plain_year(dated.groupBy("Day", "Month", "Year", "Quarter").agg(F.count("*").alias("n")))


@query
def prj_response_time(spark, folder):
    return ih(spark, folder).groupBy("Channel", "Outcome").agg(
        F.sum("ResponseTime").alias("total_seconds"), F.min("ResponseTime").alias("shortest"),
        F.max("ResponseTime").alias("longest"))


@query
def dedup_event(spark, folder):
    return _dedup_sums(clean.dedup_events(ih(spark, folder)))


def _dedup_sums(kept: DataFrame) -> DataFrame:
    return kept.groupBy("Channel", "Outcome", "ModelControlGroup").agg(
        F.count("*").alias("n"), F.sum(F.col("Priority").cast("long")).alias("priority"),
        F.round(F.sum("Propensity"), 4).alias("propensity"), F.round(F.sum("Revenue"), 4).alias("revenue"))


# ---- labels and first-level aggregates --------------------------------------------------------------


@query
def lab_restrict(spark, folder):
    kept = labels.restrict_outcomes(ih(spark, folder), ["Clicked"], ["Impression", "Pending"])
    return kept.groupBy("Outcome").agg(F.count("*").alias("n"))


@query
def lab_binary(spark, folder):
    return labels.with_label(ih(spark, folder), ["Clicked", "Conversion"]).groupBy("Outcome", labels.LABEL).agg(
        F.count("*").alias("n"))


@query
def lab_best_outcome(spark, folder):
    kept = labels.keep_best_outcome(labelled(spark, folder))
    return kept.groupBy("Outcome", "Channel").agg(
        F.count("*").alias("n"), F.sum(F.col("Priority").cast("long")).alias("priority"))


@query
def lab_group_keys(spark, folder):
    return plain_year(ih(spark, folder).groupBy(*ENGAGEMENT.but(group_by=("Year", "Issue", "Year")).keys).agg(
        F.count("*").alias("n")))


@query
def eng_agg(spark, folder):
    return plain_year(engagement.engagement(ih(spark, folder), ENGAGEMENT))


@query
def eng_compact(spark, folder):
    first_level = engagement.engagement(ih(spark, folder), ENGAGEMENT)
    return plain_year(engagement.compact_engagement(first_level, ENGAGEMENT.but(group_by=("Issue",))))


@query
def conv_touchpoints(spark, folder):
    return conversion.touchpoints(labelled(spark, folder, CONVERSION))


def _conversion(spark, folder) -> DataFrame:
    return conversion.conversion(ih(spark, folder), CONVERSION)


@query
def conv_agg(spark, folder):
    return round_columns(plain_year(_conversion(spark, folder)), 4, "Revenue")


@query
def conv_compact(spark, folder):
    spec = CONVERSION.but(group_by=("Issue",))
    return round_columns(plain_year(conversion.compact_conversion(_conversion(spark, folder), spec, drop_one_sided=True)), 4, "Revenue")


@query
def exp_agg(spark, folder):
    return plain_year(engagement.experiment(ih(spark, folder), EXPERIMENT))


@query
def exp_compact(spark, folder):
    first_level = engagement.experiment(ih(spark, folder), EXPERIMENT)
    return engagement.compact_experiment(first_level, EXPERIMENT.but(group_by=(), global_filters=("Channel",)), drop_one_sided=True)


@query
def desc_numeric_select(spark, folder):
    items = fixtures.table(spark, folder, "lineitem")
    numbers = descriptive.numeric_columns(items, ["l_quantity", "l_returnflag", "l_tax", "absent"])
    return items.groupBy("l_returnflag").agg(*[F.round(F.avg(c), 9).alias(f"{c}_Mean") for c in numbers])


STATS = ("Sum", "Mean", "Var", "Min", "Max", "Skew", "Median", "p25", "p75", "p90", "p95", "Std")


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    names = [n for n in df.columns if n.rsplit("_", 1)[-1] in STATS]
    return plain_year(round_columns(df, digits, *names))


@query
def desc_agg_exact(spark, folder):
    spec = EXACT.but(group_by=("Year", "Channel", "Outcome"), global_filters=())
    return _rounded(descriptive.descriptive_exact(described(spark, folder), spec))


@query
def desc_agg_sketch(spark, folder):
    first_level = descriptive.descriptive_sketch(described(spark, folder), DESCRIPTIVE)
    return _rounded(first_level.withColumns({
        f"{c}_n": sketches.size(f"{c}_sketch") for c in ("Propensity", "Priority")
    }).drop(*[c for c in first_level.columns if c.endswith("_sketch")]))


@query
def desc_compact_moments(spark, folder):
    spec = EXACT.but(group_by=("Outcome",), global_filters=("Channel",))
    return _rounded(descriptive.pooled(_descriptive_exact(spark, folder), spec, spec.keys))


@query
def desc_compact_quantiles_exact(spark, folder):
    fine = _descriptive_exact(spark, folder)
    spec = EXACT.but(group_by=("Outcome",), global_filters=("Channel",))
    quantiles = fine.groupBy(*spec.keys).agg(*descriptive.averaged_quantiles(fine, spec))
    return _rounded(quantiles)


@query
def desc_compact_sketch(spark, folder):
    spec = DESCRIPTIVE.but(group_by=("Outcome",), global_filters=("Channel",))
    merged = descriptive.compact_descriptive(_sketched(spark, folder), spec)
    return merged.select("Outcome", "Channel", sketches.size("Priority_sketch").alias("n"),
                         sketches.quantile("Priority_sketch", 0.5).alias("median"))


@query
def ml_any_positive(spark, folder):
    rows = labelled(spark, folder, ENGAGEMENT)
    kept = labels.keep_groups_with_positive(rows, ["SubjectID", "Issue"])
    return kept.groupBy("Issue", "Outcome").agg(F.count("*").alias("n"))


@query
def ml_personalization(spark, folder):
    rows = ml.scored_rows(ih(spark, folder), MODEL)
    return round_columns(plain_year(ml.personalization(rows, ["Year", "Channel"])), 8, "personalization")


@query
def ml_personalization_full(spark, folder):
    return round_columns(ml.personalization(ih(spark, folder), ["Channel"]), 8, "personalization")


@query
def ml_novelty(spark, folder):
    rows = ml.scored_rows(ih(spark, folder), MODEL)
    return round_columns(plain_year(ml.novelty(rows, ["Year", "Channel"])), 8, "novelty")


def _bins(spark, folder, keys=("Month", "Channel")) -> DataFrame:
    rows = ml.scored_rows(skilled(spark, folder), MODEL)
    return ml.score_bins(rows, keys)


@query
def ml_agg_sketch(spark, folder):
    return round_columns(_bins(spark, folder, ("Channel", "CustomerType")), 4, "score_sum")


@query
def ml_agg_exact(spark, folder):
    rows = ml.scored_once(skilled(spark, folder), MODEL)
    exact = ml.exact_binary_metrics(rows, ["Year", "Channel"], cuts=ml.score_cuts(rows))
    return round_columns(plain_year(exact), 8, "roc_auc", "average_precision")


def _model(spark, folder) -> DataFrame:
    """Count, personalization and novelty; the score distributions come from the bins."""
    return ml.recommender_scores(ml.scored_rows(skilled(spark, folder), MODEL), MODEL.keys)


@query
def ml_compact(spark, folder):
    merged = ml.compact_model_scores(_model(spark, folder), MODEL.but(group_by=(), global_filters=("Channel", "Year")))
    return round_columns(plain_year(merged), 8, "personalization", "novelty")


@query
def clv_agg(spark, folder):
    return _clv_out(purchases(spark, folder))


def _clv_out(df: DataFrame) -> DataFrame:
    dates = {c: F.date_format(c, "yyyy-MM-dd") for c in ("MinPurchasedDate", "MaxPurchasedDate")}
    return round_columns(df.withColumns(dates), 4, "lifetime_value")


def purchases(spark, folder, spec: MetricSpec = PURCHASES) -> DataFrame:
    return clv_ops.clv(fixtures.holdings(spark, folder), spec, AS_OF)


@query
def clv_contractual(spark, folder):
    made = purchases(spark, folder, PURCHASES.but(model="contractual", group_by=()))
    return round_columns(_clv_out(made), 4, "recurring_costs")


@query
def merge_loads(spark, folder):
    first = ih(spark, folder).filter(F.col("Year") < 1998)
    second = ih(spark, folder).filter(F.col("Year") >= 1998)
    spec = ENGAGEMENT.but(group_by=("Issue",), global_filters=("Channel",))
    first_level = engagement.engagement(first, spec)
    return merge.merge_loads(first_level, engagement.engagement(second, spec), spec)


def _weighted_mean(spark, folder):
    items = fixtures.table(spark, folder, "lineitem").withColumn(
        "maybe", F.when(F.col("l_linenumber") > 2, F.col("l_discount")))
    return items.groupBy("l_returnflag").agg(F.round(weighted_mean("maybe", "l_quantity"), 8).alias("mean_discount"))


QUERIES["weighted_mean"] = _weighted_mean


# ---- report scores ------------------------------------------------------------------------------------

ENG_SCORES = ("Lift", "CTR", "StdErr", "Lift_Z_Score", "Lift_P_Val")
CONV_SCORES = ("ConversionRate", "AvgTouchpoints", "StdErr")
EXP_SCORES = ("chi2_stat", "chi2_p_val", "chi2_odds_ratio_stat", "chi2_odds_ratio_ci_low", "chi2_odds_ratio_ci_high",
              "g_stat", "g_p_val", "g_odds_ratio_stat", "g_odds_ratio_ci_low", "g_odds_ratio_ci_high",
              "z_score", "z_p_val")
MODEL_SCORES = ("roc_auc", "average_precision", "personalization", "novelty", "pos_fraction")


def _engagement(spark, folder) -> DataFrame:
    return engagement.engagement(ih(spark, folder), ENGAGEMENT)


def _experiment(spark, folder, spec: MetricSpec = EXPERIMENT) -> DataFrame:
    return engagement.experiment(ih(spark, folder), spec)


def _experiment_table(spark, folder) -> DataFrame:
    """Charts sort their rows, which reads the aggregates twice."""
    return stored(spark, _experiment(spark, folder))


@query
def rpt_route(spark, folder):
    report = ReportSpec(ENGAGEMENT, ("CustomerType",))
    return round_columns(reports.report_scores(_engagement(spark, folder), report), 7, *ENG_SCORES)


@query
def rpt_eng(spark, folder):
    scored = reports.engagement_scores(_engagement(spark, folder), ["Channel", "Month"])
    return round_columns(scored, 7, *ENG_SCORES)


@query
def rpt_conv(spark, folder):
    scored = reports.conversion_scores(_conversion(spark, folder), ["Channel", "Issue"])
    return round_columns(round_columns(scored, 4, "Revenue"), 8, *CONV_SCORES)


@query
def rpt_exp(spark, folder):
    scored = reports.experiment_scores(_experiment(spark, folder), EXPERIMENT, ["ExperimentName", "Channel"])
    return as_int(round_columns(scored, 7, *EXP_SCORES), "chi2_dof", "g_dof")


@query
def rpt_exp_arms(spark, folder):
    scored = reports.experiment_scores(_experiment(spark, folder, EXPERIMENT3), EXPERIMENT3, ["ExperimentName", "Channel"])
    return as_int(round_columns(scored, 7, *EXP_SCORES), "chi2_dof", "g_dof")


@query
def rpt_ml(spark, folder):
    rows = ml.scored_once(skilled(spark, folder), MODEL)
    bins = ml.score_bins(rows, ("Channel", "Year"))
    scored = reports.model_scores_from_bins(ml.recommender_scores(rows, MODEL.keys), bins, ["Channel", "Year"])
    return plain_year(round_columns(scored, 8, *MODEL_SCORES))


@query
def rpt_ml_sketch(spark, folder):
    fine = stored(spark, ml.model_scores_sketch(skilled(spark, folder), MODEL))
    return reports.model_scores_from_sketches(fine, ["Channel"])


@query
def rpt_desc_sketch(spark, folder):
    return reports.descriptive_scores(_sketched(spark, folder), DESCRIPTIVE, ["Channel"])


def _descriptive_exact(spark, folder, spec: MetricSpec = EXACT) -> DataFrame:
    return stored(spark, descriptive.descriptive_exact(described(spark, folder), spec))


@query
def rpt_desc_exact(spark, folder):
    return _rounded(reports.descriptive_scores(_descriptive_exact(spark, folder), EXACT, ["Channel"]))


@query
def rpt_desc_merge(spark, folder):
    merged = descriptive.merge_sketches_by(_sketched(spark, folder), DESCRIPTIVE, ["Channel"])
    return merged.select("Channel", *[sketches.size(f"{c}_sketch").alias(f"{c}_n")
                                      for c in DESCRIPTIVE.columns if c != "Outcome"])


def rfm(spark, folder) -> DataFrame:
    return clv_ops.rfm_summary(purchases(spark, folder), PURCHASES)


def stored_rfm(spark, folder) -> DataFrame:
    """The summary as a written table, for plans that read it several times."""
    return stored(spark, rfm(spark, folder))


def _rfm_out(df: DataFrame) -> DataFrame:
    return round_columns(df, 6, *[c for c in ("monetary_value", "lifetime_value") if c in df.columns])


@query
def rpt_clv(spark, folder):
    return _rfm_out(reports.clv_scores(purchases(spark, folder), PURCHASES))


@query
def grp_eng(spark, folder):
    return plain_year(engagement.group_engagement(_engagement(spark, folder), ENGAGEMENT, ["Issue"]))


@query
def grp_conv(spark, folder):
    return round_columns(plain_year(conversion.group_conversion(_conversion(spark, folder), CONVERSION, ["Issue"])), 4, "Revenue")


@query
def grp_exp(spark, folder):
    return plain_year(engagement.group_experiment(_experiment(spark, folder), EXPERIMENT, []))


@query
def grp_ml(spark, folder):
    grouped = ml.group_model_scores(_model(spark, folder), MODEL, ["Quarter"])
    return round_columns(plain_year(grouped), 8, "personalization", "novelty")


@query
def grp_desc(spark, folder):
    spec = EXACT.but(group_by=("Year", "Channel"), global_filters=(), columns=("Outcome", "Priority"))
    first_level = descriptive.descriptive_exact(described(spark, folder), spec)
    return _rounded(descriptive.group_descriptive(first_level, spec, ["Channel"]), 7)


@query
def rfm_features(spark, folder):
    return _rfm_out(clv_ops.rfm_features(purchases(spark, folder), PURCHASES))


@query
def rfm_quartiles(spark, folder):
    return _rfm_out(clv_ops.rfm_quartiles(clv_ops.rfm_features(purchases(spark, folder), PURCHASES)))


@query
def rfm_segment(spark, folder):
    ranked = clv_ops.rfm_quartiles(clv_ops.rfm_features(purchases(spark, folder), PURCHASES))
    maps = {"default": None, "retail_banking": "retail_banking", "telco": "telco", "ecommerce": "e-commerce"}
    return ranked.select("CustomerID", *[clv_ops.segment(m).alias(n) for n, m in maps.items()])


@query
def rfm_score(spark, folder):
    return rfm(spark, folder).groupBy("rfm_score").agg(F.count("*").alias("n"))


# ---- statistics and sketches ----------------------------------------------------------------------------


def _two_arms(spark, folder) -> DataFrame:
    arm = F.col("ModelControlGroup") == "Control"
    return _engagement(spark, folder).groupBy("Month").agg(*[
        total(F.when(arm if a == "c" else ~arm, F.col(m))).alias(f"{a}_{n}")
        for a in "tc" for m, n in (("Positives", "pos"), ("Count", "n"))])


@query
def stat_ztest_prop(spark, folder):
    counts = ("t_pos", "c_pos", "t_n", "c_n")
    two = stats.with_ztest(_two_arms(spark, folder), *counts, p_name="p_two")
    both = stats.with_ztest(two, *counts, p_name="p_one", two_tailed=False)
    return round_columns(both.select("Month", "z_score", "p_two", "p_one"), 7, "z_score", "p_two", "p_one")


@query
def stat_ztest_table(spark, folder):
    scored = reports.experiment_scores(_experiment(spark, folder), EXPERIMENT, ["Channel", "Year"])
    return round_columns(plain_year(scored.select("Channel", "Year", "z_score", "z_p_val")), 7, "z_score", "z_p_val")


@query
def stat_gtest_prop(spark, folder):
    tested = stats.with_gtest(_two_arms(spark, folder), "t_pos", "c_pos", "t_n", "c_n")
    return round_columns(tested.select("Month", "g_stat", "g_p_val"), 6, "g_stat", "g_p_val")


def _tests(spark, folder, *names) -> DataFrame:
    scored = reports.experiment_scores(_experiment(spark, folder, EXPERIMENT3), EXPERIMENT3, ["Channel", "Year"])
    return plain_year(as_int(round_columns(scored, 6, *[n for n in names if not n.endswith("dof")]),
                             *[n for n in names if n.endswith("dof")]).select("Channel", "Year", *names))


@query
def stat_chi2(spark, folder):
    return _tests(spark, folder, "chi2_stat", "chi2_dof", "chi2_p_val")


@query
def stat_gtest(spark, folder):
    return _tests(spark, folder, "g_stat", "g_dof", "g_p_val")


@query
def stat_odds_ratio(spark, folder):
    scored = reports.experiment_scores(_experiment(spark, folder), EXPERIMENT, ["ExperimentName"])
    names = [f"g_odds_ratio_{s}" for s in ("stat", "ci_low", "ci_high")]
    return round_columns(scored.select("ExperimentName", *names), 7, *names)


def _sketched(spark, folder) -> DataFrame:
    return stored(spark, descriptive.descriptive_sketch(described(spark, folder), DESCRIPTIVE))


@query
def sk_build(spark, folder):
    built = ih(spark, folder).groupBy("Channel").agg(sketches.build("Priority").alias("s"))
    return built.select("Channel", sketches.size("s").alias("n"))


@query
def sk_merge(spark, folder):
    merged = _sketched(spark, folder).groupBy("Channel").agg(sketches.merge("Priority_sketch").alias("s"))
    return merged.select("Channel", sketches.size("s").alias("n"))


@query
def sk_quantile(spark, folder):
    merged = _sketched(spark, folder).groupBy("Channel").agg(sketches.merge("ResponseYears_sketch").alias("s"))
    shares = list(descriptive.SKETCH_QUANTILES.values())
    return merged.select("Channel", sketches.quantile("s", 0.5).alias("median"), sketches.quantiles("s", shares).alias("quantiles"))


@query
def sk_histogram(spark, folder):
    merged = _sketched(spark, folder).groupBy("Channel").agg(sketches.merge("Priority_sketch").alias("s"))
    return sketches.histogram(merged, "s", 30, (0.0, 60.0))


@query
def ml_roc_pr(spark, folder):
    bins = _bins(spark, folder, ("CustomerType",))
    scored = ml.curve_scores(ml.shares_from_bins(bins, ["CustomerType"]), ["CustomerType"])
    return round_columns(scored.drop(*reports.CURVES), 8, "roc_auc", "average_precision", "pos_fraction")


@query
def ml_calibration(spark, folder):
    made = ml.calibration(_bins(spark, folder, ("CustomerType",)), ["CustomerType"])
    return round_columns(made, 8, "calibration_bin", "calibration_proba", "calibration_rate")


# ---- report tables ------------------------------------------------------------------------------------------


@query
def tab_line(spark, folder):
    report = ReportSpec(ENGAGEMENT, x="Month", y="CTR", color="Channel", facet_row="CustomerType")
    return round_columns(tables.line(stored(spark, _engagement(spark, folder)), report), 7, *ENG_SCORES)


@query
def tab_heatmap(spark, folder):
    scored = reports.conversion_scores(_conversion(spark, folder), ["Channel", "CustomerType"])
    made = tables.heatmap(scored, "Channel", "CustomerType", "ConversionRate")
    return round_columns(made, 8, *made.columns[1:])


@query
def tab_treemap(spark, folder):
    made = tables.treemap(_engagement(spark, folder), "engagement", ["Channel", "CustomerType", "Issue"])
    return round_columns(made, 8, "CTR", "StdErr")


@query
def tab_polar(spark, folder):
    report = ReportSpec(ENGAGEMENT, ("Issue",), color="Channel")
    return round_columns(tables.polar(_engagement(spark, folder), report, "Issue"), 7, *ENG_SCORES)


@query
def tab_scatter(spark, folder):
    scored = stored(spark, reports.engagement_scores(_engagement(spark, folder), ["Month", "Channel"]))
    made = tables.scatter(scored, "CTR", "Lift", "Count", ["Month", "Channel"])
    return round_columns(made, 7, "CTR", "Lift", "x_min", "x_max", "y_min", "y_max")


REFERENCE = {"1-URGENT_AUTOMOBILE": 0.4, "1-URGENT_BUILDING": 0.6, "2-HIGH_FURNITURE": 0.3, "5-LOW_HOUSEHOLD": 0.42}


@query
def tab_gauge(spark, folder):
    dims = ["Channel", "CustomerType"]
    made = tables.gauge(reports.engagement_scores(_engagement(spark, folder), dims), dims, "CTR", REFERENCE)
    return round_columns(made, 8, "CTR", "delta", "axis_max")


@query
def tab_cards(spark, folder):
    made = tables.cards(stored(spark, _engagement(spark, folder)), "engagement", ["CustomerType"])
    return round_columns(made, 8, "CTR", "delta")


@query
def kpi_engagement(spark, folder):
    return round_columns(tables.kpi_engagement(stored(spark, _engagement(spark, folder))), 7, "CTR", "Lift", "Lift_P_Val")


@query
def kpi_conversion(spark, folder):
    made = tables.kpi_conversion(stored(spark, _conversion(spark, folder)))
    return round_columns(round_columns(made, 8, "ConversionRate"), 4, "Revenue")


@query
def kpi_touchpoints(spark, folder):
    return round_columns(tables.kpi_touchpoints(stored(spark, _conversion(spark, folder))), 8, "AvgTouchpoints")


@query
def kpi_ml(spark, folder):
    rows = ml.scored_once(skilled(spark, folder), MODEL)
    made = tables.kpi_model(stored(spark, ml.recommender_scores(rows, MODEL.keys)), stored(spark, ml.score_bins(rows, ("Month",))))
    return round_columns(made, 8, *MODEL_SCORES[:4])


@query
def kpi_clv(spark, folder):
    bought = stored(spark, purchases(spark, folder))
    whole = customers.totals(clv_ops.rfm_summary(bought, PURCHASES), "CustomerID")
    yearly = customers.yearly_value(bought, PURCHASES)
    made = yearly.withColumn("__t", whole.select(F.struct("*")).scalar()).select("Year", "average_value", "yoy", "__t.*")
    return round_columns(round_columns(made, 6, "average_value", "yoy"), 2, "total_value")


@query
def tab_boxplot(spark, folder):
    spec = EXACT.but(columns=("Priority",))
    scored = reports.descriptive_scores(_descriptive_exact(spark, folder, spec), spec, ["Channel"])
    made = tables.boxplot(scored, "Priority", ["Channel"])
    return round_columns(made, 9, *[c for c in made.columns if c != "Channel"])


@query
def tab_funnel(spark, folder):
    spec = EXACT.but(columns=("Outcome",))
    return tables.funnel(_descriptive_exact(spark, folder, spec), "Outcome", ["Pending", "Impression", "Clicked", "Conversion", "Refund"],
                         ["Channel", "CustomerType"])


@query
def tab_histogram(spark, folder):
    return reports.sketch_histogram(_sketched(spark, folder), DESCRIPTIVE, "ResponseYears", ["Channel"], 100)


@query
def tab_curves(spark, folder):
    bins = _bins(spark, folder, ("CustomerType",))
    roc = tables.roc_curve(bins, ["CustomerType"])
    pr = tables.precision_recall_curve(bins, ["CustomerType"])
    joined = roc.join(pr, ["CustomerType", "point"])
    return round_columns(as_int(joined, "point"), 8, "fpr", "tpr", "recall", "precision")


@query
def tab_calibration(spark, folder):
    made = tables.calibration_curve(_bins(spark, folder, ("CustomerType",)))
    return round_columns(made, 8, "calibration_bin", "calibration_proba", "calibration_rate")


@query
def tab_gain(spark, folder):
    made = tables.gain_and_lift(_bins(spark, folder, ("CustomerType",)), ["CustomerType"])
    return round_columns(as_int(made, "point"), 8, "sample_fraction", "gain").drop("lift")


@query
def tab_lift(spark, folder):
    made = tables.gain_and_lift(_bins(spark, folder, ("CustomerType",)))
    return round_columns(as_int(made, "point"), 8, "sample_fraction", "lift").drop("gain")


@query
def tab_exp_bars(spark, folder):
    scored = reports.experiment_scores(_experiment_table(spark, folder), EXPERIMENT, ["ExperimentName", "Channel"])
    made = tables.experiment_bars(scored, "chi2_stat", ["Channel"])
    return round_columns(made.select("ExperimentName", "Channel", "chi2_stat"), 7, "chi2_stat")


@query
def tab_odds(spark, folder):
    scored = reports.experiment_scores(_experiment_table(spark, folder), EXPERIMENT, ["ExperimentName", "Channel"])
    made = tables.odds_table(scored, "g", ["Channel"])
    return round_columns(made.select("ExperimentName", "Channel", "g_odds_ratio_stat", "x_plus", "x_minus", "winner"),
                         7, "g_odds_ratio_stat", "x_plus", "x_minus")


# ---- customer value tables ------------------------------------------------------------------------------------


@query
def clv_hist(spark, folder):
    made = customers.histogram(rfm(spark, folder), "tenure", 20, norm="percent", cumulative=True, group_by=["ControlGroup"])
    return round_columns(made, 6, "left", "right", "value")


SEGMENT_AVERAGES = ("avg_frequency", "avg_rfm_score")


@query
def clv_polar(spark, folder):
    made = clv_ops.segments_by(rfm(spark, folder), ["ControlGroup"])
    return round_columns(round_columns(round_columns(made, 2, "lifetime_value"), 6, "monetary_value"), 9, *SEGMENT_AVERAGES)


@query
def clv_treemap(spark, folder):
    return round_columns(clv_ops.segments_by(rfm(spark, folder), []), 2, "lifetime_value", "monetary_value", *SEGMENT_AVERAGES)


@query
def clv_exposure(spark, folder):
    return customers.exposure_sample(rfm(spark, folder), "CustomerID").select("CustomerID", "recency", "tenure")


@query
def clv_corr(spark, folder):
    values = stored_rfm(spark, folder)
    made = None
    for x, y, method, facet in (("frequency", "tenure", "pearson", "rfm_segment"),
                                ("frequency", "monetary_value", "spearman", "rfm_segment"),
                                ("frequency", "recency", "kendall", "rfm_segment")):
        part = customers.correlation(values, x, y, method, facet).withColumn("method", F.lit(method))
        made = part if made is None else made.unionByName(part)
    return round_columns(made, 7, "correlation")


@query
def clv_density(spark, folder):
    return round_columns(customers.density(rfm(spark, folder), "lifetime_value", "sum"), 2, "value")


@query
def clv_bgnbd(spark, folder):
    return purchase_models.purchases_by_segment(stored_rfm(spark, folder), "bgnbd", 1)


@query
def clv_pareto(spark, folder):
    return purchase_models.purchases_by_segment(stored_rfm(spark, folder), "pareto", 1)


@query
def clv_gammagamma(spark, folder):
    return purchase_models.value_by_segment(stored_rfm(spark, folder), 1)


@query
def clv_bgnbd_loglik(spark, folder):
    """Log-likelihood of given BG/NBD parameters."""
    made = purchase_models.loglik_by_segment(rfm(spark, folder), "bgnbd", BGNBD_PARAMS)
    return round_columns(made, 5, "loglik")


@query
def clv_gammagamma_loglik(spark, folder):
    """Log-likelihood of given Gamma-Gamma parameters."""
    made = purchase_models.loglik_by_segment(rfm(spark, folder), "gamma_gamma", GAMMA_PARAMS)
    return round_columns(made, 5, "loglik")


# ---- profiling ----------------------------------------------------------------------------------------------------


def _profile(spark, folder, approximate: bool = False) -> DataFrame:
    return profile.schema_profile(fixtures.table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "order_id"), approximate=approximate)


@query
def prof_schema(spark, folder):
    made = _profile(spark, folder)
    return round_columns(made.select("column", "unique_count", "most_occurring", "min", "max", "mean", "median"),
                         8, "min", "max", "mean", "median")


@query
def prof_sketch(spark, folder):
    """The profile of one scan: what is exact in it, and whether each estimate lies within its bound of the exact value."""
    near, exact = _profile(spark, folder, approximate=True), _profile(spark, folder).select(
        "column", F.col("unique_count").alias("__n"))
    lines = fixtures.table(spark, folder, "lineitem")
    names = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    middle = near.where(F.col("column").isin(names)).groupBy().pivot("column", names).agg(F.first("median"))
    at = middle.select(F.struct(*names)).scalar()
    ranks = lines.select(*names, at.alias("__m")).agg(*[
        F.struct(F.avg((F.col(n) < F.col(f"__m.{n}")).cast("double")).alias("low"),
                 F.avg((F.col(n) <= F.col(f"__m.{n}")).cast("double")).alias("high")).alias(n) for n in names])
    held = ranks.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"{n}.low"), F.col(f"{n}.high")) for n in names])).alias("r")).select("r.*")
    made = near.join(exact, "column").join(held, "column", "left")
    return round_columns(made.select(
        "column", "most_occurring", "min", "max", "mean",
        (F.abs(F.col("unique_count") - F.col("__n")) <= F.greatest(F.lit(1.0), 0.2 * F.col("__n"))).alias("unique_close"),
        ((F.col("low") <= 0.51) & (F.col("high") >= 0.49)).alias("median_close")), 8, "min", "max", "mean")


@query
def prof_classify(spark, folder):
    return profile.classify_fields(_profile(spark, folder)).select("column", "field_tags")


# ---- incremental ----------------------------------------------------------------------------------------------------


def _event_stream(spark, folder) -> DataFrame:
    return incremental.file_stream(spark, folder, EVENT_SCHEMA, "events.parquet")


@query
def inc_load(spark, folder):
    target = new_folder(spark, "inc_load")
    incremental.load_new_files(_event_stream(spark, folder), target, new_folder(spark, "ledger")).awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


EVENT_SPEC = MetricSpec("engagement", ("Day",), ("Kind",), ("Clicked",), ("Impression",))


def _event_interactions(batch: DataFrame) -> DataFrame:
    """Events as interactions: one interaction per user and hour."""
    shaped = fixtures.event_outcomes(batch).select(
        "Outcome", F.col("ts").alias("OutcomeTime"), F.lit("Test").alias("ModelControlGroup"),
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMddHH")).alias("InteractionID"),
        F.lit("a").alias("ActionID"), F.lit(1).alias("Rank"), F.col("event_type").alias("Kind"), "event_id")
    return clean.with_calendar(shaped)


@query
def inc_merge(spark, folder):
    kept = store.AggregateStore(spark, new_folder(spark, "inc_tables"))
    incremental.merge_new_files(_event_stream(spark, folder), {"engagement": EVENT_SPEC}, kept,
                                new_folder(spark, "ledger"), _event_interactions).awaitTermination()
    return incremental.read_merged(kept, "engagement", EVENT_SPEC).drop("ModelControlGroup").withColumn(
        "Day", F.date_format("Day", "yyyy-MM-dd"))


def _in_loads(spark, folder, when, loads: int) -> list[DataFrame]:
    """Interactions in `loads` parts by the column `when`, written once."""
    target = new_folder(spark, "loads")
    ih(spark, folder).withColumn("part", when).write.option("compression", "zstd").parquet(target)
    read = spark.read.parquet(target)
    return [read.where(F.col("part") == n).drop("part") for n in range(loads)]


def _spread_interactions(spark, folder) -> list[DataFrame]:
    """Three loads: each interaction's rows are spread over them, impressions mostly before clicks."""
    late = F.when(F.col("Outcome").isin("Clicked", "Conversion"), 1).otherwise(0)
    return _in_loads(spark, folder, F.pmod(F.crc32(F.concat_ws("|", "InteractionID", "Outcome")), F.lit(2)).cast("int") + late, 3)


def _changes_of_loads(spark, folder, spec: MetricSpec) -> DataFrame:
    """Change records of three loads."""
    parts = _spread_interactions(spark, folder)
    records = changes.ChangeRecords(spark, f"changes_{uuid.uuid4().hex}", new_folder(spark, "changes"), spec, parts[0].schema, buckets=16)
    kept = store.AggregateStore(spark, new_folder(spark, "tables"))
    for load, rows in enumerate(parts):
        kept.write_batch(spec.name, load, records.changes(rows, load), stream="loads")
    return changes.merged_changes(kept.read(spec.name), spec)


@query
def lab_best_outcome_loads(spark, folder):
    """Impressions and clicks in different loads: the counts of one load."""
    return plain_year(_changes_of_loads(spark, folder, ENGAGEMENT))


@query
def conv_touchpoints_loads(spark, folder):
    """Conversions in different loads: counts, revenue and touchpoints of one load."""
    return round_columns(plain_year(_changes_of_loads(spark, folder, CONVERSION)), 4, "Revenue")


@query
def ml_recommender_loads(spark, folder):
    """Personalization and novelty from the sums of three loads: those of one load."""
    parts = _spread_interactions(spark, folder)
    records = recommender_state.RecommenderRecords(spark, f"recommender_{uuid.uuid4().hex}", new_folder(spark, "recommender"), MODEL, parts[0].schema, buckets=16)
    kept = store.AggregateStore(spark, new_folder(spark, "tables"))
    for load, rows in enumerate(parts):
        kept.write_batch(MODEL.name, load, records.changes(rows, load), stream="loads")
    made = recommender_state.scores_of_records(kept.read(MODEL.name), MODEL)
    return round_columns(plain_year(made), 8, "personalization", "novelty")


@query
def dedup_event_loads(spark, folder):
    """Every event comes in two of three loads; the index lets its first one through."""
    number = F.pmod(F.crc32("InteractionID"), F.lit(3)).cast("int")
    parts = _in_loads(spark, folder, number, 3)
    index = event_index.EventIndex(spark, f"events_{uuid.uuid4().hex}", new_folder(spark, "event_index"), buckets=16)
    target = new_folder(spark, "deduplicated")
    for load in range(4):
        rows = [parts[n] for n in (load - 1, load) if 0 <= n < 3]
        index.dedup(merge.union_diagonal(*rows), load).write.parquet(f"{target}/load={load}")
    return _dedup_sums(spark.read.parquet(target))


@query
def inc_merge_files(spark, folder):
    """Several files, one a micro-batch: views first, then clicks, and a file that repeats events. Change records and the
    event index make them one load; the table is compacted on the way."""
    source, ledger = new_folder(spark, "inc_source"), new_folder(spark, "ledger")
    kept = store.AggregateStore(spark, new_folder(spark, "inc_tables"))
    raw = spark.read.schema(EVENT_SCHEMA).parquet(f"{folder}/events.parquet")
    schema = _event_interactions(raw).schema
    name = uuid.uuid4().hex
    records = changes.ChangeRecords(spark, f"inc_changes_{name}", new_folder(spark, "changes"), EVENT_SPEC, schema, buckets=16)
    index = event_index.EventIndex(spark, f"inc_events_{name}", new_folder(spark, "event_index"), keys=["event_id"], buckets=16)

    def run() -> None:
        stream = incremental.file_stream(spark, source, EVENT_SCHEMA, files_per_trigger=1)
        incremental.merge_new_files(stream, {"engagement": EVENT_SPEC}, kept, ledger, _event_interactions,
                                    {"engagement": records}, index).awaitTermination()

    views = F.col("event_type") == "view"
    for part in (raw.where(views), raw.where(~views & (F.col("event_id") % 2 == 0)), raw.where(F.col("event_id") % 2 == 1)):
        part.coalesce(1).write.mode("append").parquet(source)
        run()
        pipeline.compact_table(kept, EVENT_SPEC)
    return incremental.read_merged(kept, "engagement", EVENT_SPEC, changes=True).drop("ModelControlGroup").withColumn(
        "Day", F.date_format("Day", "yyyy-MM-dd"))


@query
def inc_dedup(spark, folder):
    target = new_folder(spark, "inc_dedup")
    doubled = _event_stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = incremental.dedup_stream(doubled, "ts", ["event_id"], "60 days").drop("copy")
    incremental.load_new_files(kept, target, new_folder(spark, "ledger")).awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query
def inc_windowed_ctr(spark, folder):
    target = new_folder(spark, "inc_ctr")
    stream = fixtures.event_outcomes(_event_stream(spark, folder))
    counted = incremental.windowed_ctr(stream, "ts", "2 days", ["Clicked"], ["Impression"])
    incremental.write_windows(counted, target, new_folder(spark, "ledger")).awaitTermination()
    made = incremental.read_windows(spark, target).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
    return round_columns(made, 8, "CTR")
