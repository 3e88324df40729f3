"""Retrieval and answer quality: per-row measures, aggregates and breakdowns in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.answers import DIMENSIONS
from loomspark.functions.text import normalize_name
from loomspark.operators.quantiles import exact_quantiles
from loomspark.storage import written


def _words(c: Column) -> Column:
    return F.array_distinct(F.split(c, " "))


def entity_overlap(expected: Column, retrieved: Column) -> Column:
    """struct<matched, precision, recall, f1>: an expected name is found if it shares two words (or its only one) with a retrieved one, or one is part of the other."""
    e = F.array_distinct(F.transform(expected, normalize_name))
    r = F.transform(retrieved, normalize_name)
    hit = lambda x: F.exists(r, lambda y: (F.size(F.array_intersect(_words(x), _words(y))) >= F.least(F.lit(2), F.size(_words(x)))) | F.contains(y, x) | F.contains(x, y))
    matched = F.size(F.filter(e, hit)).cast("double")
    p = F.coalesce(F.try_divide(matched, F.size(retrieved)), F.lit(0.0))
    q = F.coalesce(F.try_divide(matched, F.size(expected)), F.lit(0.0))
    return F.struct(matched.cast("int").alias("matched"), p.alias("precision"), q.alias("recall"), F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0)).alias("f1"))


def found_keywords(answer: Column, keywords: Column) -> Column:
    """Keywords that occur in the answer, whole or word by word."""
    a = F.lower(answer)
    return F.filter(keywords, lambda k: F.contains(a, F.lower(k)) | F.forall(F.split(F.lower(k), " "), lambda w: F.contains(a, w)))


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """Share of keywords that occur in the answer; no keywords: 0."""
    return F.coalesce(F.try_divide(F.size(found_keywords(answer, keywords)).cast("double"), F.size(keywords)), F.lit(0.0))


def _with_quantiles(row: DataFrame, rows: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """row with exact_quantiles() of rows as columns."""
    rows = written(rows.select(*{c: None for c, _ in wanted.values()}), "measures")
    return row.withColumns({name: F.lit(v).cast("double") for name, v in exact_quantiles(rows, wanted).items()})


def aggregate(results: DataFrame) -> DataFrame:
    """One row over results(success, precision, recall, f1, coverage, latency_ms, judge); only successes count."""
    ok = results.filter("success")
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    a = ok.agg(
        F.count("*").alias("successes"), F.avg("precision").alias("precision_mean"), F.avg("recall").alias("recall_mean"), F.avg("f1").alias("f1_mean"), sd("recall").alias("recall_std"),
        F.avg("coverage").alias("coverage_mean"), sd("coverage").alias("coverage_std"), F.avg("latency_ms").alias("latency_mean"), F.min("latency_ms").alias("latency_min"), F.max("latency_ms").alias("latency_max"),
        F.count("judge").alias("judged"), F.avg("judge").alias("judge_mean"),
    )
    a = _with_quantiles(a, ok, {"recall_median": ("recall", "median"), "coverage_median": ("coverage", "median"), "latency_median": ("latency_ms", "median"), "latency_p95": ("latency_ms", "p95")})
    return a.join(results.agg(F.count("*").alias("total"), F.avg(F.col("success").cast("double")).alias("success_rate")), how="cross")  # one row each


def breakdowns(results: DataFrame, by: tuple[str, ...] = ("category", "difficulty", "question_type")) -> DataFrame:
    """(dimension, value, count, success_rate, means) for each dimension, by grouping sets; groups without a success go."""
    results.createOrReplaceTempView("__ls_results")
    sets = ", ".join(f"({c})" for c in by)
    dimension = " ".join(f"when grouping({c}) = 0 then '{c}'" for c in by)
    return results.sparkSession.sql(f"""select case {dimension} end as dimension, coalesce({", ".join(by)}) as value, count(*) as n, avg(cast(success as double)) as success_rate,
        avg(recall) filter (where success) as recall_mean, avg(coverage) filter (where success) as coverage_mean, avg(latency_ms) filter (where success) as latency_mean, avg(judge) filter (where success) as judge_mean
        from __ls_results group by grouping sets ({sets}) having count_if(success) > 0""")


def judge_summary(verdicts: DataFrame) -> DataFrame:
    """One row over verdicts(overall, four dimensions): how many have an overall score, its mean and median, mean of each dimension among them."""
    judged = verdicts.filter("overall is not null")
    row = judged.agg(F.count("*").alias("judged"), F.avg("overall").alias("overall_mean"), *[F.avg(d).alias(f"{d}_mean") for d in DIMENSIONS])
    return _with_quantiles(row, judged, {"overall_median": ("overall", "median")})


def dataset_summary(questions: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """(dimension, value, n): questions of each listed value of each column; values without questions count 0."""
    listed = questions.sparkSession.createDataFrame([(d, v) for d, vs in values.items() for v in vs], "dimension string, value string")
    each = questions.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in values])).alias("x"))
    counts = each.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    return listed.join(counts, ["dimension", "value"], "left").select("dimension", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
