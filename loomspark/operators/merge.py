"""Extraction rows and their merges: keyed folds in the order of first appearance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import normalize_name, strip

#: Descriptions of a key that are folded by plain search; characters of a block of the text, the first that fits; places from which on plain search is as good.
FEW, SIZES, MANY_PLACES = 200, (16, 4), 1000


def entity_rows(parsed: DataFrame) -> DataFrame:
    """(chunk_id, parsed) -> name, type, description, source_chunk, item: stripped; no type: Concept; empty names go."""
    rows = parsed.select("chunk_id", F.posexplode("parsed.entities").alias("item", "e"))
    out = rows.select(strip(F.col("e.name")).alias("name"), F.coalesce(F.nullif(strip(F.col("e.type")), F.lit("")), F.lit("Concept")).alias("type"), strip(F.coalesce("e.description", F.lit(""))).alias("description"), F.col("chunk_id").alias("source_chunk"), "item")
    return out.filter("name <> ''")


def relationship_rows(parsed: DataFrame) -> DataFrame:
    """Relationships whose ends are both among the same chunk's entities (lower-cased names), in the row, without a join."""
    names = F.transform("parsed.entities", lambda e: F.lower(strip(e["name"])))
    rows = parsed.select("chunk_id", names.alias("names"), F.posexplode("parsed.relationships").alias("item", "r"))
    source, target = strip(F.col("r.source")), strip(F.col("r.target"))
    kept = rows.filter(F.array_contains("names", F.lower(source)) & F.array_contains("names", F.lower(target)))
    kind = F.upper(F.coalesce(F.nullif(strip(F.col("r.relation_type")), F.lit("")), F.lit("RELATED_TO")))
    return kept.select(source.alias("source"), target.alias("target"), kind.alias("relation_type"), strip(F.coalesce("r.description", F.lit(""))).alias("description"), F.lit(1.0).alias("weight"), F.col("chunk_id").alias("source_chunk"), "item")


def _within(text: str, part: str, blocks: dict[int, dict[str, list[int]]]) -> bool:
    """Whether the text, which grows from call to call, contains the part, by blocks of its characters.

    The text is cut every g characters. Where the part occurs, those of its pieces of g characters that lie on cuts
    are blocks of the text; the rarest of them gives the few places to compare.
    """
    g = next((g for g in SIZES if len(part) >= 2 * g - 1), 0)
    if not g:
        return part in text
    index = blocks.setdefault(g, {})
    for at in range(blocks.setdefault(-g, {}).get("end", 0), len(text) - g + 1, g):
        index.setdefault(text[at : at + g], []).append(at)
    blocks[-g]["end"] = len(text) // g * g
    for shift in range(g):
        found = [(len(index.get(part[at : at + g], ())), at) for at in range(shift, len(part) - g + 1, g)]
        count, at = min(found)
        if count > MANY_PLACES:
            return part in text
        if any(place >= at and text.startswith(part, place - at) for place in index.get(part[at : at + g], ())):
            return True
    return False


def fold_many(descriptions: list[str]) -> str:
    """The fold of folded() for many descriptions."""
    acc, blocks = "", {}
    for d in descriptions:
        if d and not _within(acc, d, blocks):
            acc += " " + d
            acc = acc.strip(" ")
    return acc


def folded(description: Column, order: Column) -> Column:
    """Descriptions in order, each appended with a space unless empty or part of what is there.

    More than FEW descriptions of one key are folded with an index of the text so far, so that the time grows with
    their length, not with its square. The result is one text, so a key's distinct descriptions are held in one row.
    """
    found = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(description, F.lit("")).alias("d"))))
    few = F.size(found) <= FEW

    @F.pandas_udf("string")
    def many(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fold_many(list(x)) for x in rows], dtype=object)

    plain = F.aggregate(F.when(few, found), F.lit(""), lambda acc, x: F.when((x["d"] == "") | F.contains(acc, x["d"]), acc).otherwise(F.trim(F.concat(acc, F.lit(" "), x["d"]))))
    return F.coalesce(plain, many(F.when(~few, F.transform(found, lambda x: x["d"]))))


def told_once(rows: DataFrame, key: list[str], order: str, firsts: list[str], sums: list[str] | None = None) -> DataFrame:
    """rows with equal descriptions of a key as one: the columns ``firsts`` of the first, ``sums`` added up.

    A description that was folded in once is part of the text from then on, so a repeat adds nothing; it is
    combined before the shuffle, and a hot key reaches one task with its distinct descriptions only. One
    with outer white space may lose it in the fold, so it is no repeat. Texts among the results make Spark sort
    by the keys; a hash before them decides nearly every comparison.
    """
    d = F.coalesce("description", F.lit(""))
    slim = rows.withColumn("description", d).withColumn("__ls_own", F.when(d != F.trim(d), F.col(order)))
    first = F.min(F.struct(F.col(order).alias("__ls_o"), *firsts)).alias("x")
    return slim.groupBy(F.xxhash64(*key, "description").alias("__ls_h"), *key, "description", "__ls_own").agg(first, *[F.sum(c).alias(c) for c in sums or []]).select(*key, "description", *(sums or []), F.col("x.__ls_o").alias(order), *[f"x.{c}" for c in firsts])


def merge_entities(entities: DataFrame, order: str = "ord") -> DataFrame:
    """One row per (normalised name, lower-cased type): first spelling, type and chunk; folded description; first order."""
    o = F.col(order)
    keyed = entities.withColumn("node_id", normalize_name(F.col("name"))).withColumn("type_key", F.lower("type"))
    keyed = told_once(keyed, ["node_id", "type_key"], order, ["name", "type", "source_chunk"]).groupBy("node_id", "type_key")
    return keyed.agg(F.min_by("name", o).alias("name"), F.min_by("type", o).alias("type"), folded(F.col("description"), o).alias("description"), F.min_by("source_chunk", o).alias("source_chunk"), F.min(o).alias("ord")).drop("type_key")


def merge_relationships(relationships: DataFrame, order: str = "ord") -> DataFrame:
    """One row per (normalised ends, lower-cased relation): summed weight, folded description, first spelling."""
    o = F.col(order)
    keyed = relationships.withColumn("src", normalize_name(F.col("source"))).withColumn("dst", normalize_name(F.col("target"))).withColumn("rel_key", F.lower("relation_type"))
    keyed = told_once(keyed, ["src", "dst", "rel_key"], order, ["source", "target", "relation_type", "source_chunk"], ["weight"]).groupBy(F.xxhash64("src", "dst", "rel_key").alias("__ls_h"), "src", "dst", "rel_key")
    return keyed.agg(F.min_by("source", o).alias("source"), F.min_by("target", o).alias("target"), F.min_by("relation_type", o).alias("relation_type"), folded(F.col("description"), o).alias("description"), F.sum("weight").alias("weight"), F.min_by("source_chunk", o).alias("source_chunk"), F.min(o).alias("ord")).drop("rel_key", "__ls_h")
