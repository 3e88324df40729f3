"""Language identification as inference of a multilingual mixture.

Each text is a mixture of languages. Expectation-maximisation estimates the proportions from the
likelihoods of hashed letter trigrams under each language; the set of languages is the prefix of the
ranked proportions with the best penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.textbytes import as_bytes, slices
from loomspark.storage import bounded_batches

#: Trigram buckets.
BUCKETS = 4096
#: Trigrams of texts times languages that are worked on at once.
CELLS = 1 << 22
ROUNDS, REFIT_ROUNDS = 12, 4
UNDETERMINED = "und"
SMOOTHING = 0.5

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _trigram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts [texts, BUCKETS], texts that have a byte that may be of a letter)."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, BUCKETS), np.int32), np.array([bool((_LETTER[data[a:b]] != 32).any()) for a, b in zip(offsets, offsets[1:], strict=False)], bool)
    b = _LETTER[data]
    big = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)  # É etc. as é
    b[1:][big] += 32
    x = b.astype(np.uint32)
    h = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    whole = (doc[:-2] == doc[2:]) & (x[1:-1] != 32)
    key = doc[:-2][whole] * BUCKETS + (h[whole] >> np.uint32(20)).astype(np.int64)
    counts = np.bincount(key, minlength=n * BUCKETS).reshape(n, BUCKETS)
    letters = np.bincount(doc[b != 32], minlength=n) > 0
    return counts, letters


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, trigram probabilities [BUCKETS, languages]) from all rows with a language.

    The driver gets at most one count for each language and bucket. Null text counts as empty.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for i, j, data, off in slices(*as_bytes(batch.column(0)), texts=512):
                counts, _ = _trigram_counts(data, off)
                for lang in set(langs[i:j]):
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    sums[lang] += counts[langs[i:j] == lang].sum(0)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], names=["lang", "bucket", "n"])

    bounded_batches(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col))
    rows = known.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    for k, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        counts[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return languages, counts / counts.sum(0) if languages else counts


def _em(p: np.ndarray, c: np.ndarray, doc: np.ndarray, first: np.ndarray, total: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihoods) after some rounds; zero proportions stay zero."""
    for r in range(rounds + 1):
        mass = np.einsum("ij,ij->i", p, pi[doc])
        if r == rounds:
            return pi, np.add.reduceat(c * np.log(mass), first)
        pi = pi * np.add.reduceat(p * (c / mass)[:, None], first) / total[:, None]


def mixtures(counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Language proportions [texts, languages] of texts that each have a trigram, in slices of texts."""
    probs = probs.astype(np.float32)
    cells = np.cumsum((counts > 0).sum(1)) * probs.shape[1]
    out, i = [], 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(cells, (cells[i - 1] if i else 0) + CELLS, "right")))
        out.append(_mixtures(counts[i:j], probs))
        i = j
    return np.concatenate(out)


def _mixtures(counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    n, k = len(counts), probs.shape[1]
    row, bucket = np.nonzero(counts)
    c = counts[row, bucket].astype(np.float32)
    first = np.searchsorted(row, np.arange(n))
    total = np.add.reduceat(c, first)
    single = np.add.reduceat(c[:, None] * np.log(probs)[bucket], first)
    p = probs[bucket]
    pi, ll = _em(p, c, row, first, total, np.full((n, k), 1 / k, np.float32), ROUNDS)
    best = np.zeros((n, k), np.float32)
    best[np.arange(n), single.argmax(1)] = 1
    penalty = 1.5 * np.log(np.maximum(total, 2))  # trigrams overlap: a third of them counts as independent
    value = single.max(1)
    order = np.argsort(-pi, axis=1, kind="stable")
    # the likelihood is concave: no mixture exceeds this, with some room for rounding
    slope = np.add.reduceat(p * (c / np.einsum("ij,ij->i", p, pi[row]))[:, None], first).max(1) - total
    most = ll + slope + 1e-5 * np.abs(ll) + 1
    for size in range(2, k + 1):
        if (most - (size - 1) * penalty <= value).all():
            break
        member = np.zeros((n, k), bool)
        np.put_along_axis(member, order[:, :size], True, 1)
        start = np.where(member, np.maximum(pi, 1e-6), 0)
        fit, fit_ll = _em(p, c, row, first, total, (start / start.sum(1, keepdims=True)).astype(np.float32), REFIT_ROUNDS) if size < k else (pi, ll)
        gain = fit_ll - (size - 1) * penalty
        better = gain > value
        value = np.where(better, gain, value)
        best[better] = fit[better]
    return best


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score, languages (array<struct<lang, share>>).

    lang_pred: the language of the largest share, ties by name; score: that share. Null text, text
    without a letter, or an empty model: ``und`` with score 0. A text too short for a trigram gets
    the first language with score 1 over the number of languages. Rows are judged alone.
    """
    languages, probs = model
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for i, j, data, off in slices(*as_bytes(texts), texts=512):
                counts, letters = _trigram_counts(data, off)
                own = texts.slice(i, j - i)
                for t in np.flatnonzero(letters):  # bytes over 0x7F may also be signs: look at the characters
                    if not counts[t].any() or not ((_LETTER[data[off[t] : off[t + 1]]] >= 97) & (_LETTER[data[off[t] : off[t + 1]]] < 123)).any():
                        letters[t] = any(ch.isalpha() for ch in own[int(t)].as_py())
                pred, score, shares = [UNDETERMINED] * (j - i), np.zeros(j - i), [[] for _ in range(j - i)]
                some = np.flatnonzero(letters & counts.any(1)) if languages else []
                if len(some):
                    pi = mixtures(counts[some], probs)
                    for t, row in zip(some, pi, strict=True):
                        order = np.argsort(-row, kind="stable")
                        pred[t], score[t] = languages[order[0]], min(1.0, float(row[order[0]]))
                        shares[t] = [{"lang": languages[x], "share": float(row[x])} for x in order if row[x] > 0.001]
                for t in np.flatnonzero(letters & ~counts.any(1)) if languages else []:
                    pred[t], score[t] = languages[0], 1 / len(languages)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(pred), pa.array(score), pa.array(shares, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], names=["id", "lang_pred", "score", "languages"])

    bounded_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(predict, f"id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "languages")
