"""Loads that come one after the other: change records, the event index, exactly-once tables, one-sided loads."""

import random
import shutil

import pytest
from conftest import rows
from pyspark.sql import functions as F

from outcome_engine import fixtures
from outcome_engine.operators import changes, clean, conversion, engagement, event_index, ml, recommender_state
from outcome_engine.operators.labels import label_outcomes
from outcome_engine.operators.merge import compact, regroup
from outcome_engine.plans import pipeline
from outcome_engine.sources.load_log import LoadLog
from outcome_engine.sources.store import AggregateStore
from outcome_engine.spec import MetricSpec, ReportSpec
from outcome_engine.streaming import incremental

IH = ("InteractionID string, ActionID string, Rank int, Outcome string, Channel string, ModelControlGroup string, "
      "SubjectID string, ConversionEventID string, Revenue double")
CLICKS = MetricSpec("engagement", ("Channel",), positive=("Clicked",), negative=("Impression",))
BUYS = MetricSpec("conversion", ("Channel",), positive=("Clicked",), negative=("Impression",))


def made(seed, n=400):
    """Interactions with several rows each, null keys and dimensions, one interaction with a third of all rows."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        hot = rng.random() < 1 / 3
        out.append(("hot" if hot else rng.choice([None, *map(str, range(60))]), rng.choice(["a", None]), 1,
                    rng.choice(["Impression", "Impression", "Clicked", "Other"]), rng.choice(["web", "mail", None]), rng.choice(["Test", "Control"]),
                    rng.choice([None, "s1", "s2", "s3"]), rng.choice([None, "e1", "e2"]), float(rng.randint(0, 9))))
    return out


@pytest.mark.parametrize("spec, one_load", [(CLICKS, engagement.engagement), (BUYS, conversion.conversion)])
def test_change_records_add_up_to_one_load(spark, tmp_path, spec, one_load):
    data = made(3)
    ih = spark.createDataFrame(data, IH)
    records = changes.ChangeRecords(spark, f"rec_{spec.name}", f"file://{tmp_path}/rec", spec, ih.schema, buckets=4)
    bounds = [0, 150, 150, 290, 400]  # the second load is empty
    for load, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = spark.createDataFrame(data[a:b], IH)
        for _ in range(2 if load == 2 else 1):  # a load that is repeated changes nothing
            records.changes(part, load).write.mode("overwrite").parquet(f"{tmp_path}/out/load={load}")
        so_far = changes.merged_changes(spark.read.parquet(f"{tmp_path}/out"), spec)
        whole = one_load(spark.createDataFrame(data[:b], IH), spec)
        assert rows(so_far.select(whole.columns)) == rows(whole)
    # a repeated old load still sees only what came before it
    again = rows(records.changes(spark.createDataFrame(data[150:290], IH), 2))
    assert again == rows(spark.read.parquet(f"{tmp_path}/out/load=2").select(*again[0]))


def test_a_click_takes_the_place_of_an_impression(spark, tmp_path):
    records = changes.ChangeRecords(spark, "one_click", f"file://{tmp_path}/r", BUYS, spark.createDataFrame([], IH).schema, buckets=2)

    def change(load, *data):
        made_ = records.changes(spark.createDataFrame(list(data), IH), load)
        return [(r.Channel, r.Count, r.Positives, r.Negatives, r.Touchpoints, r.Revenue) for r in made_.orderBy("Channel").collect()]

    assert change(0, ("1", "a", 1, "Impression", "web", "Test", "s", "e", 2.0)) == [("web", 1, 0, 1, 0, 2.0)]
    assert change(1, ("1", "a", 1, "Clicked", "mail", "Test", "s", "e", 5.0)) == [("mail", 1, 1, 0, 1, 5.0), ("web", -1, 0, -1, 0, -2.0)]
    # another click of the customer on the event: the first click's row carries both
    assert change(2, ("2", "a", 1, "Clicked", "app", "Test", "s", "e", 1.0)) == [("app", 1, 1, 0, 2, 1.0), ("mail", 0, 0, 0, 1, 0.0)]
    assert change(3, ("1", "a", 1, "Impression", "web", "Test", "s", "e", 2.0)) == []


def test_the_log_is_not_shuffled_and_opens_again(spark, tmp_path):
    log = LoadLog(spark, "plan_log", f"file://{tmp_path}/log", "n BIGINT", buckets=4)
    for load in range(3):
        log.write(load, spark.range(10 * load, 10 * load + 10).select(F.md5(F.col("id").cast("string")).cast("binary").alias("key"), F.col("id").alias("n")))
    plan = log.before_with_keys_of(2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    reopened = LoadLog(spark, "plan_log_again", f"file://{tmp_path}/log", "n BIGINT", buckets=4)
    assert reopened.before(2).count() == 20 and reopened.of(2).count() == 10


def test_event_index_across_loads(spark, tmp_path):
    data = made(5, 300)
    index = event_index.EventIndex(spark, "ev", f"file://{tmp_path}/ev", buckets=4)
    parts = [data[:150], data[100:250], [], data]
    kept = []
    for load, part in enumerate(parts):
        df = spark.createDataFrame(part, IH)
        found = rows(index.dedup(df, load))
        assert found == rows(index.dedup(df, load))
        kept += found
    first = {}
    for part in parts:
        for r in rows(clean.dedup_events(spark.createDataFrame(part, IH))):
            first.setdefault((r["InteractionID"], r["ActionID"], r["Rank"], r["Outcome"]), r)
    assert sorted(map(str, kept)) == sorted(map(str, first.values()))
    plan = index.unseen(spark.createDataFrame(data, IH), 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


# ---- tables -----------------------------------------------------------------------------------------


def batch(spark, channel, positives, negatives):
    return spark.createDataFrame([(channel, "Test", positives + negatives, positives, negatives)],
                                 "Channel string, ModelControlGroup string, Count long, Positives long, Negatives long")


def test_a_batch_counts_once_after_compaction(spark, tmp_path):
    kept = AggregateStore(spark, f"file://{tmp_path}/t")
    for number in range(2):
        kept.write_batch("engagement", number, batch(spark, "web", 1, number), stream="a")
    kept.write_batch("engagement", 0, batch(spark, "web", 5, 5), stream="b")
    for _ in range(2):
        pipeline.compact_table(kept, CLICKS)
        kept.write_batch("engagement", 1, batch(spark, "web", 1, 1), stream="a")  # replayed: version 1 and 2 have it
        assert kept.read("engagement").first().Count == 13 and kept.read("engagement").count() == 1
    kept.write_batch("engagement", 2, batch(spark, "web", 1, 0), stream="a")
    kept.write_batch("engagement", 2, batch(spark, "web", 1, 0), stream="a")
    assert sum(r.Count for r in kept.read("engagement").collect()) == 14


def test_readers_keep_the_version_they_read(spark, tmp_path):
    kept = AggregateStore(spark, f"file://{tmp_path}/t")
    kept.append("engagement", batch(spark, "web", 1, 1))
    reader = kept.read("engagement")
    kept.replace("engagement", kept.read("engagement"))
    assert reader.first().Count == 2


def test_half_written_folders_are_not_read(spark, tmp_path):
    kept = AggregateStore(spark, f"file://{tmp_path}/t")
    kept.write_batch("engagement", 0, batch(spark, "web", 1, 1), stream="a")
    (tmp_path / "t" / "engagement" / "version=0" / "batch=a.000000000000" / "_SUCCESS").unlink()
    assert not kept.exists("engagement")
    kept.write_batch("engagement", 1, batch(spark, "web", 2, 1), stream="a")
    assert [r.Count for r in kept.read("engagement").collect()] == [3]


def test_a_new_checkpoint_is_another_stream(spark, tmp_path):
    source, kept = f"{tmp_path}/in", AggregateStore(spark, f"file://{tmp_path}/t")

    def run(low, high, ledger):
        part = [(str(i), "a", 1, "Clicked" if i % 3 else "Impression", "web", "Test", "s", "e", 0.0) for i in range(low, high)]
        folder = f"{source}_{ledger}"
        spark.createDataFrame(part, IH).coalesce(1).write.mode("append").parquet(folder)
        stream = incremental.file_stream(spark, folder, IH)
        incremental.merge_new_files(stream, {"engagement": CLICKS}, kept, f"{tmp_path}/{ledger}").awaitTermination()
        return sum(r.Count for r in kept.read("engagement").collect())

    assert run(0, 10, "one") == 10
    assert run(10, 25, "two") == 25  # batch 0 of another stream
    pipeline.compact_table(kept, CLICKS)
    assert run(25, 30, "one") == 30
    shutil.rmtree(tmp_path / "two")
    shutil.rmtree(f"{source}_two")
    assert run(30, 35, "two") == 35  # begun anew: batch 0 again, but not the one that was merged


def test_late_clicks_in_a_stream(spark, tmp_path):
    source, kept = f"{tmp_path}/in", AggregateStore(spark, f"file://{tmp_path}/t")
    data = made(8, 200)
    schema = spark.createDataFrame([], IH).schema
    records = changes.ChangeRecords(spark, "stream_rec", f"file://{tmp_path}/rec", CLICKS, schema, buckets=4)
    index = event_index.EventIndex(spark, "stream_ev", f"file://{tmp_path}/ev", buckets=4)
    for a, b in ((0, 90), (60, 140), (120, 200)):  # files overlap
        spark.createDataFrame(data[a:b], IH).coalesce(1).write.mode("append").parquet(source)
        stream = incremental.file_stream(spark, source, IH, files_per_trigger=1)
        incremental.merge_new_files(stream, {"engagement": CLICKS}, kept, f"{tmp_path}/ck", None, {"engagement": records}, index).awaitTermination()
    seen, distinct = set(), []
    for a, b in ((0, 90), (60, 140), (120, 200)):
        for r in rows(clean.dedup_events(spark.createDataFrame(data[a:b], IH))):
            name = (r["InteractionID"], r["ActionID"], r["Rank"], r["Outcome"])
            if name not in seen:
                seen.add(name)
                distinct.append(tuple(r[c] for c in schema.names))
    whole = engagement.engagement(spark.createDataFrame(distinct, IH), CLICKS)
    assert rows(incremental.read_merged(kept, "engagement", CLICKS, changes=True).select(whole.columns)) == rows(whole)


def test_one_sided_loads_are_kept(spark, tmp_path):
    columns = "Channel string, Negatives long, Positives long, Revenue double, Count long, Touchpoints long"
    first, second = [spark.createDataFrame([r], columns) for r in (("web", 0, 5, 10.0, 5, 5), ("web", 3, 0, 0.0, 3, 0))]
    merged = compact(compact(first, BUYS).unionByName(compact(second, BUYS)), BUYS).first()
    assert (merged.Positives, merged.Negatives, merged.Revenue, merged.Touchpoints) == (5, 3, 10.0, 5)
    grouped = regroup(first.unionByName(second), BUYS, ["Channel"]).first()
    assert (grouped.Positives, grouped.Negatives) == (5, 3)
    assert regroup(first, BUYS, ["Channel"]).count() == 0  # scored only with both sides
    assert conversion.compact_conversion(first.unionByName(second), BUYS, drop_one_sided=True).first().Positives == 0
    kept = AggregateStore(spark, f"file://{tmp_path}/t")
    kept.append("engagement", batch(spark, "web", 4, 0))
    kept.append("engagement", batch(spark, "web", 0, 4))
    assert pipeline.report(kept, ReportSpec(CLICKS, ("Channel",))).first().CTR == 0.5


# ---- recommender scores -----------------------------------------------------------------------------

SCORED = MetricSpec("model_ml_scores", ("Channel",), positive=("Clicked",), negative=("Impression",))


def test_recommender_records_add_up_to_one_load(spark, tmp_path):
    names = F.concat(F.lit("offer"), F.pmod(F.crc32(F.concat_ws("|", "InteractionID", "Revenue")), F.lit(7)))
    data = made(11)
    whole = spark.createDataFrame(data, IH).withColumn("Name", F.when(F.col("Revenue") > 0, names))
    records = recommender_state.RecommenderRecords(spark, "rec_scores", f"file://{tmp_path}/rec", SCORED, whole.schema, buckets=4)
    bounds = [0, 130, 130, 400]  # the second load is empty
    for load, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = spark.createDataFrame(data[a:b], IH).withColumn("Name", F.when(F.col("Revenue") > 0, names))
        for _ in range(2 if load == 2 else 1):  # a load that is repeated changes nothing
            records.changes(part, load).write.mode("overwrite").parquet(f"{tmp_path}/out/load={load}")
        stored = spark.read.parquet(f"{tmp_path}/out").drop("load")
        so_far = spark.createDataFrame(data[:b], IH).withColumn("Name", F.when(F.col("Revenue") > 0, names))
        expected = rows(ml.recommender_scores(ml.scored_rows(so_far, SCORED), SCORED.keys), "Channel")
        for found in (stored, recommender_state.compact_records(stored, SCORED)):
            got = rows(recommender_state.scores_of_records(found, SCORED), "Channel")
            assert [(r["Channel"], r["Count"]) for r in got] == [(r["Channel"], r["Count"]) for r in expected]
            for g, e in zip(got, expected):
                assert (g["personalization"], g["novelty"]) == pytest.approx((e["personalization"], e["novelty"]), abs=1e-12)


def test_recommender_records_shrink_lists_and_customers(spark, tmp_path):
    schema = IH + ", Name string"
    empty = spark.createDataFrame([], schema)
    records = recommender_state.RecommenderRecords(spark, "rec_small", f"file://{tmp_path}/r", SCORED, empty.schema, buckets=2)

    def load(number, *data):
        spark_rows = spark.createDataFrame([(i, a, 1, o, "web", "Test", s, None, 0.0, n) for i, a, o, s, n in data], schema)
        records.changes(spark_rows, number).write.parquet(f"{tmp_path}/out/load={number}")
        return [(r.Count, round(r.personalization, 9), round(r.novelty, 9)) for r in recommender_state.scores_of_records(
            spark.read.parquet(f"{tmp_path}/out").drop("load"), SCORED).collect()]

    assert load(0, ("1", "a", "Impression", "s", "x"), ("1", "a", "Impression", "t", "x")) == []  # no positive as yet
    # the click takes the place of both impressions: customers s and t go, u comes, the list has one row
    assert load(1, ("1", "a", "Clicked", "u", "y")) == [(1, 0.0, 0.0)]
    # two customers with different items: nothing in common
    assert load(2, ("2", "a", "Impression", "v", "z")) == [(2, 1.0, 1.0)]


def test_recommender_records_take_no_other_family(spark, tmp_path):
    with pytest.raises(ValueError, match="no recommender scores"):
        recommender_state.RecommenderRecords(spark, "none", f"file://{tmp_path}/n", CLICKS, spark.createDataFrame([], IH).schema)


def test_event_index_shuffles_whole_rows_once(spark, tmp_path):
    index = event_index.EventIndex(spark, "ev_once", f"file://{tmp_path}/ev", buckets=4)
    first, second = (spark.createDataFrame(made(seed), IH) for seed in (11, 12))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index.dedup(first, 0).count()
        lines = index.dedup(second, 1)._jdf.queryExecution().executedPlan().toString().splitlines()
        assert "Exchange" not in index.new_keys(1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    join, window = (next(i for i, line in enumerate(lines) if name in line) for name in ("SortMergeJoin", "Window ["))
    assert join < window and not any("Exchange" in line for line in lines[join:window])


def test_item_changes_sort_once(spark, tmp_path, monkeypatch):
    spec = MetricSpec("model_ml_scores", ("Channel",), positive=("Clicked",), negative=("Impression",))
    data = [(str(i % 30), "a", 1, "Clicked" if i % 6 == 0 else "Impression", "web", f"c{i % 11}", f"item{i % 4}") for i in range(120)]
    df = spark.createDataFrame(data, "InteractionID string, ActionID string, Rank int, Outcome string, Channel string, SubjectID string, Name string")
    plans = {}

    def written(made, label):
        plans[label] = made._jdf.queryExecution().executedPlan().toString()
        return made

    monkeypatch.setattr(recommender_state, "written", written)
    records = recommender_state.RecommenderRecords(spark, "rec_sorts", f"file://{tmp_path}/rec", spec, df.schema, buckets=4)
    records.changes(df, 0).count()
    windows = plans["item_changes"].split("Window [", 1)[1]
    assert windows.split("HashAggregate")[0].count("Sort [") == 1


def test_changes_of_cells_and_touchpoints_stay_in_their_buckets(spark, tmp_path):
    data = made(7, 200)
    records = changes.ChangeRecords(spark, "bucketed", f"file://{tmp_path}/b", BUYS, spark.createDataFrame([], IH).schema, buckets=4)
    for load in range(2):
        records.changes(spark.createDataFrame(data[100 * load:100 * load + 100], IH), load).collect()
    cells = changes.changed_cells(records.cells.met_by(1), 1, records.dims, records.sums)
    for plan in (df._jdf.queryExecution().executedPlan().toString() for df in (cells, records._touch_changes(1))):
        assert "SortMergeJoin" in plan and "hashpartitioning(key" not in plan
    met = records.kept.met_by(1).collect()
    new = {bytes(r.key) for r in met if r.load == 1}
    assert new and {r.load for r in met} == {0, 1} and all(bytes(r.key) in new for r in met)


def test_the_log_has_the_sessions_partitions_as_buckets_and_keeps_them(spark, tmp_path):
    def log(name, partitions):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            return LoadLog(spark, name, f"file://{tmp_path}/log", "n BIGINT", buckets=2)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    first = log("buckets_first", 5)
    first.write(0, spark.range(40).select(F.md5(F.col("id").cast("string")).cast("binary").alias("key"), F.col("id").alias("n")))
    again = log("buckets_again", 3)
    assert (first.buckets, again.buckets) == (5, 5)
    assert again.of(0).groupBy("key").count().where("count = 1").count() == 40


def test_rows_of_a_log_move_once(spark, tmp_path):
    schema = IH + ", Name string"
    df = spark.createDataFrame([(*r, f"offer{i % 5}") for i, r in enumerate(made(13, 200))], schema)
    records = recommender_state.RecommenderRecords(spark, "rec_once", f"file://{tmp_path}/rec", SCORED, df.schema, buckets=4)
    for load in range(2):
        records.changes(df, load).collect()

    def exchanges(frame):
        return frame._jdf.queryExecution().executedPlan().toString().count("Exchange")

    cells = changes.interaction_cells(label_outcomes(df, SCORED.positive, SCORED.negative), records.dims, (), records.cells)
    assert exchanges(records.cells.dealt(cells)) == 1
    for log, names in ((records.pairs, ["Channel", "Name"]), (records.lists, ["Channel"])):
        assert exchanges(recommender_state._before_and_after(log, 1, names)) == 0


def test_event_index_moves_only_rows_that_share_their_key(spark, tmp_path):
    def row(i, revenue, channel="web"):
        return (None if i < 0 else str(i), "a", 1, "Clicked", channel, "Test", None, None, revenue)

    first = [row(i, 1.0) for i in range(50)] + [row(-1, 2.0), row(-1, 1.0)]
    second = ([row(i, 5.0) for i in range(40, 300)] + [row(i, 3.0, None) for i in range(45, 60)] + [row(i, 4.0) for i in range(55, 60)]
              + [row(-1, 0.0)] + [row(400, 7.0)] * 4)
    index = event_index.EventIndex(spark, "ev_marks", f"file://{tmp_path}/ev", buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = [rows(index.dedup(spark.createDataFrame(first, IH).repartition(3), 0))]
        found = index.dedup(spark.createDataFrame(second, IH).repartition(5), 1)
        plan = found._jdf.queryExecution().executedPlan().toString()
        kept.append(rows(found))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan[:plan.index("SortMergeJoin")]  # rows that are alone are read and marked in place
    assert [len(k) for k in kept] == [51, 251]
    assert {r["InteractionID"]: (r["Channel"], r["Revenue"]) for r in kept[0]} == {**{str(i): ("web", 1.0) for i in range(50)}, None: ("web", 1.0)}
    best = {str(i): ("web", 5.0) for i in range(50, 300)} | {str(i): (None, 3.0) for i in range(50, 60)} | {"400": ("web", 7.0)}
    assert {r["InteractionID"]: (r["Channel"], r["Revenue"]) for r in kept[1]} == best


def test_interactions_join_parts_before_orders(spark, folder):
    found = fixtures.interactions(spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "l_orderkey" in joins[0] and "l_partkey" in joins[1] and "o_custkey" in joins[2]
    assert found.count() == fixtures.table(spark, folder, "lineitem").count()
    counted = {r["Outcome"]: r["count"] for r in found.groupBy("Outcome").count().collect()}
    raw = fixtures.table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").count().collect()
    named = {"R": "Clicked", "A": "Impression"}
    expected = {}
    for r in raw:
        name = named.get(r.l_returnflag) or ("Pending" if r.l_linestatus == "F" else "Conversion")
        expected[name] = expected.get(name, 0) + r["count"]
    assert counted == expected
