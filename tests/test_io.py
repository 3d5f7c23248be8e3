"""Files, stores, profiling and streams."""

import gzip
import io
import json
import re
import tarfile
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from outcome_engine.operators import engagement
from outcome_engine.operators.clean import CleaningConfig
from outcome_engine.plans import pipeline, profile
from outcome_engine.sources import files
from outcome_engine.sources.store import AggregateStore, export_json, import_json, write_csv
from outcome_engine.spec import MetricSpec, ReportSpec
from outcome_engine.streaming import incremental

LINES = [json.dumps({"a": i, "b": f"v{i}"}) for i in range(6)]
SCHEMA = "a long, b string"


@pytest.fixture
def archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("z.ndjson", "\n".join(LINES[2:4]))
        z.writestr("a.json", "\n".join(LINES[:2]))
        z.writestr("notes.txt", "ignore me")
    for name in ("two.tar.gz", "three.tgz"):
        with tarfile.open(tmp_path / name, "w:gz") as t:
            data = "\n".join(LINES[4:]).encode()
            info = tarfile.TarInfo("x/y.json")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with gzip.open(tmp_path / "four.gzip", "wt") as g:
        g.write("\n".join(LINES[:1]))
    with gzip.open(tmp_path / "five.json.gz", "wt") as g:
        g.write("\n".join(LINES[:3]))
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("notes.txt", "nothing here")
    return tmp_path


def test_archives(spark, archives):
    def read(*names):
        return sorted(r.a for r in files.read_records(spark, [str(archives / n) for n in names], "json", SCHEMA).collect())

    assert read("one.zip") == [0, 1, 2, 3] and read("two.tar.gz") == [4, 5] and read("three.tgz") == [4, 5]
    assert read("four.gzip") == [0] and read("five.json.gz") == [0, 1, 2]
    assert read("one.zip", "two.tar.gz", "five.json.gz") == [0, 0, 1, 1, 2, 2, 3, 4, 5]
    inferred = files.read_records(spark, str(archives / "one.zip"), "json")
    assert inferred.count() == 4 and set(inferred.columns) == {"a", "b"}
    with pytest.raises(Exception, match="no JSON member"):
        read("bad.zip")


def test_archives_by_member(spark, tmp_path):
    many = files.LINES_PER_BATCH * 2 + 7
    with zipfile.ZipFile(tmp_path / "big one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for m in range(4):
            z.writestr(f"{m}.json", "\n".join(json.dumps({"a": i, "b": str(m)}) for i in range(many if m == 0 else 5)))
        z.writestr("empty.json", "")
    lines = files.archive_lines(spark, str(tmp_path / "big one.zip"), parts=5)
    assert lines.rdd.getNumPartitions() == 5 and lines.select(F.spark_partition_id()).distinct().count() == 4
    read = files.read_archives(spark, str(tmp_path / "big one.zip"), SCHEMA)
    assert {r.b: r["count"] for r in read.groupBy("b").count().collect()} == {"0": many, "1": 5, "2": 5, "3": 5}
    listed = files.archive_members(spark.createDataFrame([(str(tmp_path / "big one.zip"),)], "path string"))
    assert sorted(r.member for r in listed.collect()) == ["0.json", "1.json", "2.json", "3.json", "empty.json"]
    whole = spark.read.format("binaryFile").load(str(tmp_path / "big one.zip"))
    assert files.expand_archives(whole).count() == many + 15


def test_broken_lines_raise(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "broken.zip", "w") as z:
        z.writestr("a.json", LINES[0] + "\n{broken")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        files.read_archives(spark, str(tmp_path / "broken.zip"), SCHEMA).collect()
    lines = files.archive_lines(spark, str(tmp_path / "broken.zip"))
    assert sorted((r.a is None, r.b) for r in files.parse_lines(lines, SCHEMA, "PERMISSIVE").collect()) == [(False, "v0"), (True, None)]
    with tarfile.open(tmp_path / "none.tgz", "w:gz") as t:
        t.addfile(tarfile.TarInfo("notes.txt"))
    with pytest.raises(Exception, match="no JSON member"):
        files.read_archives(spark, str(tmp_path / "none.tgz"), SCHEMA).collect()


def test_storage_of_paths():
    for path in ("/tmp/a b/c.zip", "file:/tmp/a b/c.zip", "file:///tmp/a b/c.zip"):
        assert files.open_storage(path)[1] == "/tmp/a b/c.zip"


def test_unsupported(spark):
    with pytest.raises(ValueError, match="not supported"):
        files.read_records(spark, "x.xlsx", "xlsx")
    with pytest.raises(ValueError):
        files.read_records(spark, [], "json")


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_delimiters(spark, tmp_path, sep):
    path = tmp_path / "d.csv"
    path.write_text(sep.join(["id", "name", "day"]) + "\n" + sep.join(["1", "x", "2024-01-02"]) + "\n")
    row = files.read_csv(spark, str(path)).first()
    assert row.id == 1 and row.name == "x" and str(row.day) == "2024-01-02"


def test_delimiter_rule():
    assert files.delimiter_of(["a,b;c", "d,e"]) == "," and files.delimiter_of(["abc", "def"]) == ","
    assert files.delimiter_of(["a;b", "c;d"]) == ";"


def test_evolving_parquet(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "a"))
    spark.range(3).select("id", F.lit("x").alias("extra")).write.parquet(str(tmp_path / "b"))
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert files.read_parquet(spark, paths).filter("extra IS NULL").count() == 2
    fixed = files.read_parquet(spark, paths, "id long, later double")
    assert fixed.columns == ["id", "later"] and fixed.count() == 5


def test_listing_grouping_ledger(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        (tmp_path / f"Day={day}").mkdir()
        (tmp_path / f"Day={day}" / "x.json").write_text(LINES[0] + "\n")
    (tmp_path / "loose.json").write_text(LINES[1] + "\n")
    found = files.list_files(spark, str(tmp_path), "*.parquet")
    assert found.count() == 3
    groups = [r.file_group for r in files.group_files(found, "Day=(.*)/").collect()]
    assert groups == ["loose.json", "2024-01-02", "2024-01-01"]
    ledger = files.ledger_rows(found.filter(F.col("path").contains("2024-01-01")))
    assert files.unprocessed(found, ledger).count() == 2 and files.unprocessed(found, None).count() == 3


def test_stable_sample(spark):
    df = spark.range(200)
    a, b = (sorted(r.id for r in files.stable_sample(df.repartition(n), 20).collect()) for n in (2, 9))
    assert a == b and len(a) == 20 and files.stable_sample(df, 0).count() == 200


SPEC = MetricSpec("engagement", ("Channel",), positive=("Clicked",), negative=("Impression",))


def ih(spark, start, stop):
    return spark.range(start, stop).select(
        F.col("id").cast("string").alias("InteractionID"), F.lit("a").alias("ActionID"), F.lit(1).alias("Rank"),
        F.when(F.col("id") % 4 == 0, "Clicked").otherwise("Impression").alias("Outcome"),
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("Channel"), F.lit("Test").alias("ModelControlGroup"))


def test_store(spark, tmp_path):
    store = AggregateStore(spark, str(tmp_path / "s"))
    assert not store.exists("engagement")
    with pytest.raises(ValueError):
        store.read("engagement")
    with pytest.raises(ValueError):
        store.append("bad name; drop", spark.range(1))
    pipeline.store_metrics(ih(spark, 0, 50), [SPEC], store)
    pipeline.store_metrics(ih(spark, 50, 120), [SPEC], store)
    whole = engagement.engagement(ih(spark, 0, 120), SPEC)
    assert rows(store.read("engagement").select(whole.columns), "Channel") == rows(whole, "Channel")
    scored = pipeline.report(store, ReportSpec(SPEC, ("Channel",)), {"Channel": ["c1"]})
    assert [r.Channel for r in scored.collect()] == ["c1"]
    store.append("engagement", whole)
    assert store.read("engagement").count() == 6 and store.names() == ["engagement"]
    store.drop_all()
    assert store.names() == []


def test_export_import_and_csv(spark, tmp_path):
    df = spark.range(10).groupBy((F.col("id") % 2).alias("k")).agg(F.kll_sketch_agg_double(F.col("id").cast("double")).alias("s"))
    export_json({"t": df}, str(tmp_path / "e"))
    back = import_json(spark, str(tmp_path / "e"), {"t": df.schema})["t"]
    assert sorted(bytes(r.s) for r in back.collect()) == sorted(bytes(r.s) for r in df.collect())
    write_csv(spark.range(3), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def test_load_from_raw(spark, tmp_path):
    t = "20240710T145658.123 GMT"
    raw = spark.createDataFrame([("1", "I", "G", "N", 1, "Clicked", t, t), ("2", "I", "G", "N", 1, "Impression", t, t)],
                                "pxInteractionID string, pyIssue string, pyGroup string, pyName string, pxRank int, pyOutcome string, "
                                "pxDecisionTime string, pxOutcomeTime string")
    store = AggregateStore(spark, str(tmp_path / "s"))
    config = CleaningConfig({"Channel": "Web", "ModelControlGroup": "Test"})
    pipeline.load_interactions(raw, config, [SPEC], store)
    assert store.read("engagement").first()["Count"] == 2
    bought = spark.createDataFrame([("c", "h", 5.0, "2024-01-01")], "pyCustomerID string, HoldingID string, OneTimeCost double, When string")
    spec = MetricSpec("clv", customer_id_col="CustomerID", purchase_date_col="Bought")
    pipeline.load_holdings(bought, CleaningConfig(calculated={"Bought": "to_date(When)"}), spec, store, "2024-06-01")
    assert store.read("clv").first().lifetime_value == 5.0


def test_profile_and_tags(spark):
    data = [(i, "x" if i < 6 else "y", float("nan") if i == 0 else float(i), None, f"2024-01-0{1 + i % 2}") for i in range(10)]
    df = spark.createDataFrame(data, "order_id int, Channel string, Revenue double, empty string, d string").withColumn("PurchaseDate", F.to_date("d")).drop("d")
    got = {r["column"]: r for r in rows(profile.classify_fields(profile.schema_profile(df, approximate=False), 10))}
    assert got["Channel"]["most_occurring"] == "x" and got["Channel"]["unique_count"] == 2 and got["Channel"]["samples"] == ["x", "y"]
    assert (got["Revenue"]["min"], got["Revenue"]["median"], got["Revenue"]["mean"]) == (1.0, 5.0, 5.0)
    assert got["Revenue"]["shown"] == "Min = 1.0000 Max = 9.0000 Mean = 5.0000 Median = 5.0000"
    assert got["empty"]["unique_count"] == 1 and got["order_id"]["most_occurring"] == "N/A"
    assert got["PurchaseDate"]["shown"] == "Min = 2024-01-01 Max = 2024-01-02"
    assert got["Channel"]["field_tags"] == "Required, Business dimension" and got["order_id"]["field_tags"] == "Likely ID"
    assert got["Revenue"]["field_tags"] == "Required, Numeric measure" and got["PurchaseDate"]["field_tags"] == "Time"
    assert profile.schema_profile(df, ["Channel", "absent"]).count() == 1
    near = {r["column"]: r for r in rows(profile.schema_profile(df, approximate=True))}
    assert near["Channel"]["samples"] == ["x", "y"] and near["empty"]["most_occurring"] is None
    assert set(near) == set(got) and near["Channel"]["most_occurring"] == "x"
    for name in got:
        assert near[name]["unique_count"] == pytest.approx(got[name]["unique_count"], abs=1)
    assert near["Revenue"]["median"] == pytest.approx(5.0, abs=1) and near["Revenue"]["mean"] == 5.0
    assert profile.schema_profile(df.select("Revenue"), approximate=True).first()["unique_count"] == 10


def test_profile_of_one_scan(spark):
    data = [(i, "often" if i % 3 == 0 else f"t{i}", float(i), None if i % 2 else {"a": i}) for i in range(20_000)]
    df = spark.createDataFrame(data, "n int, text string, amount double, tags map<string,int>")
    made = profile.schema_profile(df)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert all(re.fullmatch(r"column#\d+, \d+", keys) for keys in re.findall(r"hashpartitioning\(([^)]*?)(?:, ENSURE[^)]*)?\)", plan))
    got = {r["column"]: r for r in rows(made)}
    assert got["text"]["most_occurring"] == "often" and got["text"]["unique_count"] == pytest.approx(13_334, rel=0.15)
    assert len(got["text"]["samples"]) == profile.SAMPLES and set(got["text"]["samples"]) <= {d[1] for d in data}
    assert got["amount"]["median"] == pytest.approx(9_999.5, abs=200) and (got["amount"]["min"], got["amount"]["max"]) == (0.0, 19_999.0)
    assert got["tags"]["unique_count"] == pytest.approx(10_001, rel=0.15)
    nothing = {r["column"]: r for r in rows(profile.schema_profile(df.limit(0)))}
    assert nothing["text"]["most_occurring"] is None and nothing["text"]["samples"] == [] and nothing["amount"]["median"] is None


# ---- streams --------------------------------------------------------------------------------------------

EVENTS = "InteractionID string, ActionID string, Rank int, Outcome string, Channel string, ModelControlGroup string"


def test_files_one_by_one_equal_one_batch(spark, tmp_path):
    source, ledger = str(tmp_path / "in"), str(tmp_path / "ck")
    store = AggregateStore(spark, str(tmp_path / "s"))

    def run():
        stream = incremental.file_stream(spark, source, EVENTS, files_per_trigger=1)
        incremental.merge_new_files(stream, {"engagement": SPEC}, store, ledger).awaitTermination()

    for low, high in ((0, 40), (40, 100)):
        ih(spark, low, high).coalesce(2).write.mode("append").parquet(source)
        run()
    run()
    whole = engagement.engagement(ih(spark, 0, 100), SPEC)
    assert len(store.read("engagement").select("Channel").collect()) > 3
    assert rows(incremental.read_merged(store, "engagement", SPEC).select(whole.columns), "Channel") == rows(whole, "Channel")
    pipeline.compact_table(store, SPEC)
    assert rows(store.read("engagement").select(whole.columns), "Channel") == rows(whole, "Channel")


def test_late_rows_and_repeats(spark, tmp_path):
    source = str(tmp_path / "in")

    def put(*data):
        spark.createDataFrame(list(data), "ts string, Outcome string, k int").select(
            F.to_timestamp("ts").alias("ts"), "Outcome", "k").coalesce(1).write.mode("append").parquet(source)

    schema = "ts timestamp, Outcome string, k int"

    def ctr():
        stream = incremental.file_stream(spark, source, schema)
        counted = incremental.windowed_ctr(stream, "ts", "1 hour", ["Clicked"], ["Impression"])
        incremental.write_windows(counted, str(tmp_path / "ctr"), str(tmp_path / "ck1")).awaitTermination()

    def dedup():
        stream = incremental.dedup_stream(incremental.file_stream(spark, source, schema), "ts", ["k"], "10 days")
        incremental.load_new_files(stream, str(tmp_path / "dd"), str(tmp_path / "ck2")).awaitTermination()

    put(("2024-01-01 10:00:00", "Clicked", 1), ("2024-01-01 11:00:00", "Impression", 2), ("2024-01-03 12:00:00", "Impression", 3))
    ctr(), dedup()
    put(("2024-01-01 12:00:00", "Clicked", 4), ("2024-01-03 13:00:00", "Clicked", 3), ("2024-01-05 00:00:00", "Impression", 5))
    ctr(), dedup()
    got = rows(incremental.read_windows(spark, str(tmp_path / "ctr")), "window_start")
    assert [(str(r["window_start"])[:10], r["Count"], r["Positives"], r["CTR"]) for r in got] == [
        ("2024-01-01", 2, 1, 0.5), ("2024-01-03", 2, 1, 0.5), ("2024-01-05", 1, 0, 0.0)]
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "dd")).collect()) == [1, 2, 3, 4, 5]
