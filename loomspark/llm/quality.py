"""Quality classification from weak labels.

Overlapping heuristic labellers vote junk, good or abstain. Expectation-maximisation over the counts
of all vote patterns estimates how often each labeller votes what on junk and on good documents; the
posterior labels train a linear scorer on hashed shape features, which judges every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.textbytes import LOWER, as_bytes, mix64, slices, word_hashes, words
from loomspark.storage import bounded_batches, written

#: (name, statistic, good up to, junk from): between the two a labeller abstains.
LABELLERS = (
    ("symbols", "symbol_share", 0.03, 0.12),
    ("capitals", "upper_share", 0.25, 0.6),
    ("cells", "bar_words", 0.02, 0.15),
    ("shouting", "bang_words", 0.1, 0.3),
    ("stutter", "repeated_words", 0.08, 0.3),
    ("few_words", "lost_variety", 0.75, 0.9),
    ("word_length", "odd_length", 5.0, 15.0),
    ("digits", "digit_share", 0.35, 0.7),
)
#: Hashed features of the scorer, and the bound on the sample of documents it is fitted on.
FEATURES, SAMPLE = 1024, 6000
EM_ROUNDS = 100
#: The labellers' limits are set so that good documents stay far from them: their rate of junk votes
#: on good documents is held under this, which also tells the two classes apart.
FALSE_ALARMS = 0.001

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = _LETTERS[65:91] = _LETTERS[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL[[*range(48, 58), *range(65, 91), *range(97, 123), *b".,;:'\"?!()-"]] = False


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers the labellers read, one for each text; 0 words: all 0."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n).astype(float)

    start, end, first = words(data, offsets)
    n_words = np.diff(first).astype(float)
    w_doc = np.repeat(np.arange(n), np.diff(first))
    h = word_hashes(LOWER[data], start, end)
    letters, upper = count(_LETTERS[data]), count((data >= 65) & (data <= 90))
    upper += count((data == 0xC3) & (np.append(data[1:], 0) >= 0x80) & (np.append(data[1:], 0) <= 0x9E)) if len(data) else 0
    shown = np.maximum(count((data >= 33) & (data < 128)) + count(data >= 0xC0), 1)
    least = np.maximum(n_words, 1)
    same = np.bincount(w_doc[1:][(h[1:] == h[:-1]) & (w_doc[1:] == w_doc[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    order = np.lexsort((h, w_doc))
    hs, ds = h[order], w_doc[order]
    new = np.append(True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])) if len(hs) else np.zeros(0, bool)
    distinct = np.bincount(ds[new], minlength=n)
    # in good prose the number of distinct words grows about as the power 0.75 of the length
    expected = np.maximum(np.minimum(least, 4 * least**0.75), 1)
    return {
        "words": n_words,
        "symbol_share": count(_SYMBOL[data]) / shown,
        "upper_share": np.where(letters >= 8, upper / np.maximum(letters, 1), 0),
        "bar_words": count(data == 124) / least,
        "bang_words": count(data == 33) / least,
        "repeated_words": np.where(n_words >= 4, same / least, 0),
        "lost_variety": np.where(n_words >= 20, 1 - distinct / expected, 0),
        "odd_length": np.where(n_words > 0, np.abs(letters / least - 6), 0),
        "digit_share": count((data >= 48) & (data <= 57)) / shown,
    }


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """[texts, labellers]: 0 abstains, 1 good, 2 junk. A text without words is left to the others: all abstain."""
    out = np.stack([np.where(stats[s] >= junk, 2, np.where(stats[s] <= good, 1, 0)) for _, s, good, junk in LABELLERS], 1)
    out[stats["words"] == 0] = 0
    return out


def features(data: np.ndarray, offsets: np.ndarray, stats: dict[str, np.ndarray]) -> np.ndarray:
    """[texts, FEATURES]: square roots of the shares of hashed 4-grams of character classes, and hashed repetition levels."""
    n = len(offsets) - 1
    out = np.zeros(n * FEATURES)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    if len(data) >= 4:
        c = _CLASS[data]
        h = mix64(c[:-3] | (c[1:-2] << np.uint64(8)) | (c[2:-1] << np.uint64(16)) | (c[3:] << np.uint64(24))) % np.uint64(FEATURES)
        own = doc[:-3] == doc[3:]
        out = np.bincount(doc[:-3][own] * FEATURES + h[own].astype(np.int64), minlength=n * FEATURES).astype(float)
    x = out.reshape(n, FEATURES)
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1)).astype(np.float32)
    for name in ("repeated_words", "lost_variety", "symbol_share", "upper_share", "bar_words", "bang_words"):
        level = np.minimum(np.floor(np.clip(stats[name], 0, 1) * 10), 9).astype(np.uint64)
        at = mix64(level + np.uint64(sum(name.encode()) * 16 + 7)) % np.uint64(FEATURES)
        x[np.arange(n), at.astype(np.int64)] += 0.5
    return x


@dataclass(frozen=True)
class QualityModel:
    """prior: share of junk. accuracies: [class (good, junk), labeller, vote]. weights: FEATURES and a bias."""

    prior: float
    accuracies: np.ndarray
    weights: np.ndarray


def posterior(v: np.ndarray, prior: float, acc: np.ndarray) -> np.ndarray:
    """P(junk) of vote rows."""
    at = np.arange(v.shape[1])
    good, junk = (np.log(acc[k][at, v]).sum(1) for k in (0, 1))
    return 1 / (1 + np.exp(np.clip(good + np.log1p(-prior) - junk - np.log(prior), -50, 50)))


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """(prior of junk, accuracies) by expectation-maximisation over vote patterns and their counts.

    It starts from the noisy-or of the junk votes: what one labeller calls junk is junk until the
    others' records say otherwise.
    """
    post = np.clip(1 - 0.25 ** (patterns == 2).sum(1), 0.02, 0.98)
    for _ in range(EM_ROUNDS):
        prior = float(np.clip((post * counts).sum() / max(counts.sum(), 1), 0.001, 0.999))
        acc = np.empty((2, patterns.shape[1], 3))
        for k, weight in enumerate(((1 - post) * counts, post * counts)):
            for vote in range(3):
                acc[k, :, vote] = ((patterns == vote) * weight[:, None]).sum(0) + 0.5
            acc[k] /= acc[k].sum(1, keepdims=True)
        acc[0, :, 2] = np.minimum(acc[0, :, 2], FALSE_ALARMS)
        acc[1, :, 2] = np.maximum(acc[1, :, 2], 10 * FALSE_ALARMS)
        new = posterior(patterns, prior, acc)
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return prior, acc


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels; both classes weigh the same. Adam steps."""
    x = np.ascontiguousarray(np.hstack([x, np.ones((len(x), 1), np.float32)]))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    row = ((y / share + (1 - y) / (1 - share)) / (2 * len(y))).astype(np.float32)
    y = y.astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))  # one precision, or every step converts the sample
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = ((p - y) * row) @ x + np.float32(decay) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= np.float32(rate) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return w


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Accuracies from the votes on all documents, the scorer from at most ``sample`` posterior labels.

    The sample are the documents of the smallest identifier hashes. Texts without words take no part.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(*as_bytes(batch.column(1)), texts=2048):
                s = statistics(data, off)
                some = np.flatnonzero(s["words"] > 0)
                code = (votes(s)[some] * 3 ** np.arange(len(LABELLERS))).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(some)), pa.array(code.astype(np.int32))], names=["h", "code"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.length(text_col)).alias("h"), F.col(text_col).alias("text"))
    coded = written(rows.mapInArrow(vote, "h bigint, code int"), "quality-votes")
    counted = coded.groupBy("code").count().toPandas()
    code = counted["code"].to_numpy()
    patterns = np.stack([code // 3**i % 3 for i in range(len(LABELLERS))], 1) if len(code) else np.zeros((0, len(LABELLERS)), int)
    prior, acc = estimate(patterns, counted["count"].to_numpy())
    n = int(counted["count"].sum())
    cut = min(2**63 - 1, -(2**63) + int(min(1.0, 1.2 * sample / max(n, 1)) * 2**64))

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(*as_bytes(batch.column(1)), texts=512):
                s = statistics(data, off)
                x, y = features(data, off, s), posterior(votes(s), prior, acc)
                some = np.flatnonzero(s["words"] > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(some)), pa.array(y[some]), pa.array([r.tobytes() for r in x[some]], pa.binary())], names=["h", "y", "x"])

    picked = rows.filter(F.col("h") <= cut).mapInArrow(shaped, "h bigint, y double, x binary").orderBy("h").limit(sample).toPandas()
    x = np.stack([np.frombuffer(b, np.float32) for b in picked["x"]]) if len(picked) else np.zeros((0, FEATURES), np.float32)
    weights = _fit(x, picked["y"].to_numpy()) if len(picked) else np.zeros(FEATURES + 1)
    return QualityModel(prior, acc, weights)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs with columns quality_score (0..1, high is good), weak_label (posterior of good), quality_keep.

    Kept: a score of 0.5 or more. Null, empty or blank text scores 0 and is not kept. Rows are judged
    alone; columns of the same names are replaced.
    """
    weights = model.weights

    @F.pandas_udf("quality_score double, weak_label double")
    def judged(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            out = np.zeros((len(texts), 2))
            for i, j, data, off in slices(*as_bytes(pa.array(texts, pa.large_string(), from_pandas=True)), texts=512):
                s = statistics(data, off)
                z = features(data, off, s) @ weights[:-1] + weights[-1]
                out[i:j, 0] = np.where(s["words"] > 0, 1 / (1 + np.exp(np.clip(z, -50, 50))), 0)
                out[i:j, 1] = np.where(s["words"] > 0, 1 - posterior(votes(s), model.prior, model.accuracies), 0)
            yield pd.DataFrame(out, columns=["quality_score", "weak_label"])

    bounded_batches(docs.sparkSession)
    judged_docs = docs.withColumn("__ls_judged", judged(text_col))
    for name in ("quality_score", "weak_label"):
        judged_docs = judged_docs.withColumn(name, F.col(f"__ls_judged.{name}"))
    return judged_docs.withColumn("quality_keep", F.col("quality_score") >= 0.5).drop("__ls_judged")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """docs without those that a model fitted on docs rejects; columns stay as they are."""
    model = fit(docs, id_col, text_col, sample)
    judged = score(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__ls_row"), F.col(text_col).alias("__ls_body")), model, "__ls_body")
    return judged.filter("quality_keep").select("__ls_row.*")
