"""Conversations as an append-only message table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.text import ANSWER_PROMPT, prompt, strip_think
from loomspark.plans import providers
from loomspark.plans.search import Corpus, search

CLEARED = "cleared"


def visible(messages: DataFrame) -> DataFrame:
    """Messages after each session's last tombstone (role ``cleared``)."""
    last = messages.filter(F.col("role") == CLEARED).groupBy("session_id").agg(F.max("turn").alias("cut"))
    return messages.join(last, "session_id", "left").filter((F.col("role") != CLEARED) & (F.col("cut").isNull() | (F.col("turn") > F.col("cut")))).drop("cut")


def history(messages: DataFrame, n: int = 10) -> DataFrame:
    """(session_id, history): the n messages before the current one as lines, oldest first."""
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    recent = messages.withColumn("r", r).filter(F.col("r").between(2, n + 1))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("content"))
    text = recent.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))
    return messages.select("session_id").distinct().join(text, "session_id", "left").select("session_id", F.coalesce("history", F.lit("(No previous conversation)")).alias("history"))


def latest_question(messages: DataFrame) -> DataFrame:
    return messages.filter("role = 'user'").groupBy("session_id").agg(F.max_by("content", "turn").alias("question"), F.max("turn").alias("turn"))


def clear(messages: DataFrame, session_id: str) -> DataFrame:
    """messages with a tombstone at the session's end."""
    end = messages.filter(F.col("session_id") == session_id).groupBy("session_id").agg((F.max("turn") + 1).alias("turn"))
    return messages.unionByName(end.select("session_id", "turn", F.lit(CLEARED).alias("role"), F.lit("").alias("content")).select(messages.columns))


def ask(spark: SparkSession, corpus: Corpus, messages: DataFrame, session_id: str, question: str, mode: str = "combined", answer=providers.answer) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(messages with the question and its answer, the search result)."""
    own = visible(messages).filter(F.col("session_id") == session_id)
    turn = own.agg(F.coalesce(F.max("turn"), F.lit(-1))).first()[0] + 1
    asked = own.unionByName(spark.createDataFrame([(session_id, turn, "user", question)], "session_id string, turn long, role string, content string").select(own.columns))
    found = search(corpus, question, mode)
    text = found.select("context").join(history(asked).select("history"), how="cross")
    said = text.select(strip_think(answer(prompt(ANSWER_PROMPT, history=F.col("history"), context=F.col("context"), question=F.lit(question)), F.lit(question))).alias("content"))
    reply = said.select(F.lit(session_id).alias("session_id"), F.lit(turn + 1).cast("long").alias("turn"), F.lit("assistant").alias("role"), "content")
    new = asked.filter(F.col("turn") == turn).unionByName(reply.select(asked.columns))
    return messages.unionByName(new.select(messages.columns)), found
