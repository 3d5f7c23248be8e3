"""Column profiles of any table, and tags for its fields."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_engine.functions import sketches
from outcome_engine.operators.prefix import exact_quantiles

# Name fragments by which fields are tagged.
REQUIRED_FIELDS = ("Name", "Issue", "Group", "Rank", "Channel", "SubjectID", "Outcome", "Propensity",
                   "FinalPropensity", "Priority", "InteractionID", "ModelControlGroup", "Revenue")
BUSINESS_HINTS = ("action", "channel", "category", "control", "customer", "group", "issue", "model", "name",
                  "outcome", "placement", "product", "segment", "source", "status", "treatment", "type", "variant")
ID_ENDINGS = ("id", "key", "guid", "uuid")
ID_PARTS = (" id", "_id", "-id")
MEASURE_HINTS = ("amount", "count", "cost", "duration", "finalpropensity", "lift", "priority", "propensity",
                 "rate", "response", "revenue", "score", "value", "weight")
TECHNICAL_HINTS = ("application", "component", "division", "fact", "internal", "operator", "organization",
                   "partition", "stream", "unit", "version", "work")
TIME_HINTS = ("date", "day", "month", "quarter", "time", "year")
NUMERIC_TYPES = ("int", "float", "double", "decimal", "long", "short", "byte")
TIME_TYPES = ("date", "time")
SAMPLES = 10
TRACKED = 10_000  # items that the heavy-hitter sketch keeps a column


def _is_id(name: str) -> bool:
    return name.lower().endswith("id")


def _sketched_profile(df: DataFrame, texts: Sequence[str], numbers: Sequence[str], others: Sequence[str]) -> DataFrame:
    """(column, unique_count, __mode, samples, min, max, mean, first, last, median) from one aggregate without a shuffle by value.

    Per column a HyperLogLog; for texts also a heavy-hitter sketch and the values of least hash under `SAMPLES` different hashes,
    for numbers a quantile sketch. A column with up to `SAMPLES` values shows them all, since they are its heavy hitters.
    """
    slots: dict[str, Column] = {}
    for i, n in enumerate(df.columns):
        c = F.col(f"`{n}`")
        slots[f"u{i}"] = F.approx_count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))
        if n in texts:
            text = c.cast("string")
            slots[f"t{i}"] = F.expr(f"approx_top_k(CAST(`{n}` AS STRING), {SAMPLES}, {TRACKED}) FILTER (WHERE `{n}` IS NOT NULL)")
            slots[f"s{i}"] = F.array(*[F.min_by(text, F.when(c.isNotNull(), F.xxhash64(text, F.lit(seed)))) for seed in range(SAMPLES)])
        elif n in numbers:
            v = c.cast("double")
            clean = F.when(~F.isnan(v), v)
            slots |= {f"a{i}": F.min(clean), f"z{i}": F.max(clean), f"m{i}": F.avg(clean), f"q{i}": sketches.build(clean)}
        elif n in others:
            slots |= {f"a{i}": F.min(c).cast("string"), f"z{i}": F.max(c).cast("string")}
    one = df.agg(*[c.alias(k) for k, c in slots.items()])
    none, number, text = F.lit(None), "double", "string"
    found = []
    for i, n in enumerate(df.columns):
        mode, samples = none.cast(text), none.cast("array<string>")
        low = high = mean = median = none.cast(number)
        first = last = none.cast(text)
        if n in texts:
            top = F.transform(f"t{i}", lambda x: F.struct((-x["count"]).alias("n"), x["item"].alias("item")))
            mode = F.when(F.size(f"t{i}") > 0, F.array_min(top)["item"])
            seen = F.array_distinct(F.concat(F.filter(f"s{i}", lambda x: x.isNotNull()), F.transform(f"t{i}", lambda x: x["item"])))
            samples = F.sort_array(F.slice(seen, 1, SAMPLES))
        elif n in numbers:
            low, high, mean = F.col(f"a{i}"), F.col(f"z{i}"), F.col(f"m{i}")
            median = F.when(sketches.size(f"q{i}") > 0, sketches.quantile(f"q{i}", 0.5))
        elif n in others:
            first, last = F.col(f"a{i}"), F.col(f"z{i}")
        values = {"unique_count": F.col(f"u{i}"), "__mode": mode, "samples": samples, "min": low, "max": high, "mean": mean,
                  "first": first, "last": last, "median": median}
        found.append(F.struct(F.lit(n).alias("column"), *[c.alias(k) for k, c in values.items()]))
    return one.select(F.explode(F.array(*found)).alias("__p")).select("__p.*")


def schema_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = True) -> DataFrame:
    """Per column: type, number of different values (NULL is one), most frequent text, sample texts,
    and min / max / mean / median of numbers (NULL and NaN left out), min / max of the rest.

    By default one scan with sketches: distinct counts, medians and, in columns of very many texts, the most frequent one are
    estimates. With approximate=False all is exact: values are counted per (column, value) in one shuffle with map-side
    combination, and sample values are those with the smallest hashes. Of equally frequent texts the smallest is shown.
    """
    if columns:
        df = df.select(*[c for c in columns if c in df.columns])
    fields = {f.name: f.dataType for f in df.schema.fields}
    numbers = [n for n, t in fields.items() if isinstance(t, T.NumericType) and not _is_id(n)]
    texts = [n for n, t in fields.items() if isinstance(t, (T.StringType, T.NullType)) and not _is_id(n)]
    others = [n for n in fields if n not in numbers and n not in texts and not _is_id(n)
              and not isinstance(fields[n], (T.ArrayType, T.MapType, T.StructType))]
    types = df.sparkSession.createDataFrame(
        [(n, t.simpleString(), _is_id(n)) for n, t in fields.items()], "column string, data_type string, is_id boolean")
    if approximate:
        # a sketch takes no value that has no order or hash, so maps are counted as text
        plain = df.select(*[F.to_json(f"`{n}`").alias(n) if isinstance(t, T.MapType) else F.col(f"`{n}`") for n, t in fields.items()])
        return _shown(types.join(_sketched_profile(plain, texts, numbers, others), "column", "left"), texts, numbers)

    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in fields])
    counts = (df.select(F.explode(cells).alias("__c")).select("__c.*")
              .groupBy("column", "value").agg(F.count("*").alias("n")))
    known = F.col("value").isNotNull()
    found = counts.groupBy("column").agg(
        F.count("*").alias("unique_count"),
        F.min_by("value", F.when(known, F.struct(-F.col("n"), F.col("value")))).alias("__mode"))

    by_hash = Window.partitionBy("column").orderBy(F.xxhash64("value"), "value")
    sampled = (counts.filter(F.col("column").isin(texts) & known).withColumn("__r", F.row_number().over(by_hash))
               .filter(F.col("__r") <= SAMPLES)
               .groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("samples")))

    aggs = []
    for n in numbers:
        v = F.col(f"`{n}`").cast("double")
        clean = F.when(~F.isnan(v), v)
        aggs.append(F.struct(F.lit(n).alias("column"), F.min(clean).alias("min"), F.max(clean).alias("max"),
                             F.avg(clean).alias("mean"), F.lit(None).cast("string").alias("first"),
                             F.lit(None).cast("string").alias("last")).alias(f"__{n}"))
    for n in others:
        none = F.lit(None).cast("double")
        aggs.append(F.struct(F.lit(n).alias("column"), none.alias("min"), none.alias("max"), none.alias("mean"),
                             F.min(F.col(f"`{n}`")).cast("string").alias("first"),
                             F.max(F.col(f"`{n}`")).cast("string").alias("last")).alias(f"__{n}"))
    out = types.join(found, "column", "left").join(sampled, "column", "left")
    if aggs:
        summary = df.agg(F.array(*aggs).alias("__a")).select(F.explode("__a").alias("__s")).select("__s.*")
        out = out.join(summary, "column", "left")
    else:
        none = F.lit(None)
        out = out.withColumns({**{c: none.cast("double") for c in ("min", "max", "mean")},
                               **{c: none.cast("string") for c in ("first", "last")}})
    out = out.withColumn("median", F.lit(None).cast("double"))
    if numbers:
        clean = df.select(*[F.when(~F.isnan(F.col(f"`{n}`").cast("double")), F.col(f"`{n}`").cast("double"))
                            .alias(f"v{i}") for i, n in enumerate(numbers)])
        names = [f"v{i}" for i in range(len(numbers))]
        middle = exact_quantiles(clean, [], names, {"m": 0.5})
        medians = middle.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("column"), F.col(f"v{i}_m").alias("median")) for i, n in enumerate(numbers)
        ])).alias("__m")).select("__m.*")
        out = out.drop("median").join(medians, "column", "left")
    return _shown(out, texts, numbers)


def _shown(out: DataFrame, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """The profile's columns, with a line of text for each field."""
    four = "%.4f"
    shown = (F.when(F.col("is_id"), "")
             .when(F.col("column").isin(texts), F.concat(F.lit("["), F.concat_ws(", ", "samples"), F.lit("]")))
             .when(F.col("column").isin(numbers), F.format_string(
                 f"Min = {four} Max = {four} Mean = {four} Median = {four}",
                 *[F.coalesce(c, F.lit(0.0)) for c in ("min", "max", "mean", "median")]))
             .otherwise(F.format_string("Min = %s Max = %s", F.coalesce("first", F.lit("")), F.coalesce("last", F.lit("")))))
    mode = F.when(F.col("column").isin(texts) & ~F.col("is_id"), F.col("__mode")).otherwise("N/A")
    return out.select("column", "data_type", F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
                      mode.alias("most_occurring"), shown.alias("shown"), "min", "max", "mean", "median",
                      "first", "last", "samples")


def _any(text: Column, hints: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(h) for h in hints])


def classify_fields(profile: DataFrame, row_count: int | None = None,
                    required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Tags per field, joined by ', '. `row_count` refines the high-cardinality rule."""
    name, kind = F.lower("column"), F.lower("data_type")
    unique = F.col("unique_count")
    time = _any(name, TIME_HINTS) | _any(kind, TIME_TYPES)
    identifier = reduce(lambda a, b: a | b, [name.endswith(e) for e in ID_ENDINGS]) | _any(name, ID_PARTS)
    technical = name.startswith("px") | name.startswith("py") | _any(name, TECHNICAL_HINTS)
    measure = (_any(kind, NUMERIC_TYPES) & ~identifier & ~time) | _any(name, MEASURE_HINTS)
    high = unique >= 50
    if row_count:
        high = high | ((unique >= 20) & (unique / F.lit(float(row_count)) >= 0.2))
    business = ~technical & ~identifier & ~measure & ~time & (_any(name, BUSINESS_HINTS) | ~high)
    rules = {"Required": F.col("column").isin(list(required)), "Time": time, "Business dimension": business,
             "Numeric measure": measure, "Likely ID": identifier, "Technical": technical, "High-cardinality": high}
    tags = F.concat_ws(", ", *[F.when(cond, F.lit(tag)) for tag, cond in rules.items()])
    return profile.withColumn("field_tags", F.when(tags == "", "Review").otherwise(tags))
