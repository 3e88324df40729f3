"""String expressions over names, model answers, chunks and prompts. All are built-in functions but the splitter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (SQL trim() removes U+0020 only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: Unicode white space, as strip() removes it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normalize_name(c: Column) -> Column:
    """Node identity of a name: stripped, lower-cased, ``_`` and ``-`` as spaces; runs are not collapsed.

    Every row of a merge has its names normalised, and a search for an expression costs several times what a trim of short texts does.
    """
    return F.translate(F.lower(F.btrim(c, F.lit(SPACES))), "_-", "  ")


def strip_think(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def split_reasoning(c: Column) -> Column:
    """struct<chain, final>: the first reasoning block, and the text without any. No closed block: chain is null."""
    has = c.rlike(r"(?s)<think>.*?</think>")
    return F.struct(F.when(has, strip(F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1))).alias("chain"), F.when(has, strip_think(c)).otherwise(c).alias("final"))


def clamp_score(c: Column) -> Column:
    """1..5 after rounding half to even; a missing score is 1."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.bround(F.coalesce(c.cast("double"), F.lit(1.0))).cast("int")))


def overall_score(*scores: Column) -> Column:
    """Mean of the scores that are present; null if none is."""
    present = F.filter(F.array(*[s.cast("double") for s in scores]), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))


def entity_lines(c: Column) -> Column:
    """array<string> of a model's list answer: one entry a line, list marks removed once each in order, longer than one character."""

    def clean(line: Column) -> Column:
        line = strip(line)
        for mark in (r"-", r"\*", "•", r"1\.", r"2\.", r"3\."):
            line = F.regexp_replace(line, rf"^{mark}\s*", "")
        return strip(line)

    return F.filter(F.transform(F.split(c, "\n"), clean), lambda x: F.length(x) > 1)


def truncate(c: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def clean_text(c: Column) -> Column:
    """Collapse blank lines (white space in them too) and spaces and drop two phrases of page boilerplate."""
    c = F.regexp_replace(c, r"(?U)\n\s*\n\s*\n+", "\n\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"(?i)(skip to main content|back to top)", "")
    return strip(c)


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("_chunk_"), index.cast("string"))


def window_chunks(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """array<string> of fixed windows; the SQL form of the splitter."""
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / float(size - overlap)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * (size - overlap) + 1, F.lit(size)))


def split_text(text: str, size: int = 1500, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Recursive character split: by the coarsest separator present, pieces joined up to size with at most overlap repeated."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    pieces = list(text) if sep == "" else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    pieces = [p for p in pieces if p]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        joined = "".join(held).strip()
        if joined:
            out.append(joined)

    for p in pieces:
        if len(p) > size:
            flush()
            held, length = [], 0
            out.extend(split_text(p, size, overlap, finer) if finer else [p[i : i + size] for i in range(0, len(p), size)])
            continue
        if length + len(p) > size:
            flush()
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    flush()
    return out


def recursive_chunks(size: int = 1500, overlap: int = 200):  # noqa: ANN201
    """A pandas UDF string -> array<string> of the recursive splitter."""

    @F.pandas_udf("array<string>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_text(t or "", size, overlap))

    return chunks


def entity_line(name: Column, kind: Column, description: Column) -> Column:
    return F.concat(F.lit("- "), name, F.lit(" ("), F.coalesce(kind, F.lit("Unknown")), F.lit("): "), F.left(F.coalesce(description, F.lit("")), F.lit(200)))


def relation_line(source: Column, relation: Column, target: Column, description: Column | None = None) -> Column:
    line = F.concat(F.lit("- ("), source, F.lit(") --["), relation, F.lit("]--> ("), target, F.lit(")"))
    return line if description is None else F.when(F.coalesce(description, F.lit("")) != "", F.concat(line, F.lit(": "), description)).otherwise(line)


def lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


#: Prompts are plain templates: ``{name}`` is replaced by the column of that name.
EXTRACT_PROMPT = "List the entities (types: {types}) and their relationships in this text as JSON with the arrays entities and relationships.\n\n{text}"
SUMMARY_PROMPT = "Summarise this community of entities in one paragraph.\n\n{context}"
TERMS_PROMPT = "Name the entities this question asks about, one a line.\n\n{question}"
ANSWER_PROMPT = "Earlier turns:\n{history}\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer from the context only."
JUDGE_PROMPT = "Score relevance, accuracy, completeness and coherence (1-5, with justification) as JSON.\n\nQuestion: {question}\nAnswer: {answer}\nExpected entities: {entities}\nExpected keywords: {keywords}"


def prompt(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out
