"""Evaluation of answers to a table of questions, and their judgement by a model."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.answers import DIMENSIONS, verdict
from loomspark.functions.text import JUDGE_PROMPT, clamp_score, overall_score, prompt
from loomspark.operators.evaluation import entity_overlap, found_keywords, keyword_coverage
from loomspark.plans import providers
from loomspark.plans.search import Corpus, searches
from loomspark.storage import written

def answer_all(corpus: Corpus, questions: DataFrame, mode: str = "combined", answer=providers.answer) -> DataFrame:  # noqa: ANN001
    """questions(id, question) -> (id, answer, resolved_mode, matched_entities, matched_nodes, source_chunks_loaded, latency_ms, error): all questions searched and answered in one batch of jobs, whose number does not grow with them.

    latency_ms is the batch's time shared out over its questions. If the search fails, all have its error; a
    question that the provider does not answer (null) has one of its own.
    """
    asked, began = questions.select(F.col("id").alias("question_id"), "question"), time.perf_counter()
    failed = lambda why: asked.select(F.col("question_id").alias("id"), F.lit(None).cast("string").alias("answer"), F.lit("error").alias("resolved_mode"), *[F.array().cast("array<string>").alias(n) for n in ("matched_entities", "matched_nodes")], F.lit(0).cast("long").alias("source_chunks_loaded"), F.lit(0.0).alias("latency_ms"), F.lit(why).alias("error"))
    try:
        found = searches(corpus, asked, mode).join(asked, "question_id").select(F.col("question_id").alias("id"), answer(F.col("context"), F.col("question")).alias("answer"), F.col("mode").alias("resolved_mode"), "matched_entities", "matched_nodes", "source_chunks_loaded")
        found = written(found, "answers")
    except Exception as e:  # noqa: BLE001  a failing search is a result, not the end of the evaluation
        return failed(str(e)[:500])
    each = (time.perf_counter() - began) * 1000 / max(1, found.count())
    return found.withColumns({"latency_ms": F.lit(each), "error": F.when(F.col("answer").isNull(), "no answer")})


def evaluate(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions(id, question, category, question_type, difficulty, expected_entities, answer_keywords) with answers (see answer_all) -> one result for each question.

    A question without an answer, or with an error, is no success: its measures are 0 and all its keywords are missing.
    """
    none = F.array().cast("array<string>")
    rows = questions.join(answers, "id", "left")
    rows = rows.withColumn("success", F.col("resolved_mode").isNotNull() & F.col("error").isNull())
    rows = rows.withColumn("nodes", F.when(F.col("success"), F.coalesce("matched_nodes", none)).otherwise(none)).withColumn("answer", F.when(F.col("success"), F.coalesce("answer", F.lit(""))).otherwise(""))
    expected, keywords = F.coalesce("expected_entities", none), F.coalesce("answer_keywords", none)
    rows = rows.withColumn("overlap", entity_overlap(expected, F.col("nodes"))).withColumn("found", F.when(F.col("success"), found_keywords(F.col("answer"), keywords)).otherwise(none))
    return rows.select(
        "id", "question", "category", "question_type", "difficulty", "success", F.coalesce("resolved_mode", F.lit("error")).alias("resolved_mode"), "error",
        expected.alias("expected_entities"), F.col("nodes").alias("matched_nodes"), F.col("overlap.precision").alias("precision"), F.col("overlap.recall").alias("recall"), F.col("overlap.f1").alias("f1"),
        F.coalesce("source_chunks_loaded", F.lit(0)).cast("long").alias("source_chunks_loaded"),
        "answer", keywords.alias("answer_keywords"), F.col("found").alias("keywords_found"), F.filter(keywords, lambda k: ~F.array_contains(F.col("found"), k)).alias("keywords_missing"),
        F.when(F.col("success"), keyword_coverage(F.col("answer"), keywords)).otherwise(0.0).alias("coverage"), F.length("answer").alias("answer_length"), "latency_ms",
    )


def judge(results: DataFrame, model=None) -> DataFrame:  # noqa: ANN001
    """results with one score for each dimension (1 to 5, a missing one is 1), overall and judge_error; model: a Column -> Column provider.

    Without a model, for results that are no success, and for answers of it that cannot be read, all scores are null.
    """
    if model is None:
        out = results
        for name in DIMENSIONS:
            out = out.withColumn(name, F.lit(None).cast("int"))
        return out.withColumn("overall", F.lit(None).cast("double")).withColumn("judge_error", F.lit(None).cast("string"))
    asked = prompt(JUDGE_PROMPT, question=F.col("question"), answer=F.col("answer"), entities=F.array_join("expected_entities", ", "), keywords=F.array_join("answer_keywords", ", "))
    # the provider sees only the rows it judges: one that is paid is not asked for the others
    said = results.filter("success").select("id", verdict(model(asked)).alias("v"))
    said = said.select("id", *[F.when(F.col("v.error").isNull(), clamp_score(F.col(f"v.{name}"))).alias(name) for name in DIMENSIONS], F.col("v.error").alias("judge_error"))
    out = results.join(said, "id", "left")
    return out.withColumn("overall", overall_score(*[F.col(name) for name in DIMENSIONS]))
