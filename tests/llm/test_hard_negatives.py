"""Hard negatives against all inner products in plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import hard_negatives as hn
from loomspark.llm import queries
from tests.conftest import DATA


def brute(rows, is_anchor, positives=5, negatives=5):
    """rows: (id, label, integer vector)."""
    out = set()
    for i, label, v in rows:
        if is_anchor(i):
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in rows if j != i and len(w) == len(v)), key=lambda x: x[:2])
            for ps, p, _ in [x for x in scored if x[2] == label][:positives]:
                found = [x for x in scored if x[2] != label and 80 * -ps <= 100 * -x[0] <= 100 * -ps][:negatives]
                out |= {(i, p, r, n, -ps, -s) for r, (s, n, _) in enumerate(found, 1)}
    return out


def mined(df):
    rows = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()]
    assert mined(queries.op13_hard_negatives(spark, f"{DATA}/sf0.001")) == brute(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("block", [16_384, 90])
def test_ties_copies_and_broken_rows(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "ANCHORS", 8)
    monkeypatch.setattr(hn, "LEAF", 4)
    r = random.Random(3)
    one = [0.5, -0.25, 0.125]
    rows = [(i, r.randint(0, 3), one if i % 3 == 0 else [r.choice((-1, 1)) * r.random() for _ in range(3)]) for i in range(400)]
    rows += [(400, 1, None), (401, None, one), (402, 1, [0.1, None, 0.2]), (403, 1, [0.1, float("nan"), 0.2]), (404, 2, [float("inf"), 0.0, 0.0]), (None, 1, one), (405, 1, [0.5, 0.5]), (410, 2, [0.5, 0.25])]
    good = [(i, m, [int(np.floor(256 * x)) for x in v]) for i, m, v in rows if i is not None and m is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    df = spark.createDataFrame([(*x, "clash") for x in rows + rows[:50]], "vec_id long, label int, embedding array<double>, score string")
    ready = hn.prepared(df, F.col("label"))
    assert mined(hn.mine(ready, ready.filter("id % 10 = 0"))) == brute(good, lambda i: i % 10 == 0)
    assert hn.mine(ready.limit(0), ready.limit(0)).count() == 0


def test_large_integers_are_exact(spark):
    rows = [(i, i % 2, [2**27 + 31 * i, -(2**27) + i * i]) for i in range(0, 60)]
    df = spark.createDataFrame(rows, "id long, label long, v array<long>")
    assert mined(hn.mine(df, df.filter("id % 10 = 0"))) == brute(rows, lambda i: i % 10 == 0)


def test_bounds_prune():
    """On clustered vectors a search scores a small part of the rows, and finds what a full scan does."""
    g = np.random.default_rng(1)
    centers = g.normal(size=(40, 16)) * 400
    rows = np.floor(centers[np.arange(8000) % 40] + g.normal(size=(8000, 16)) * 20).astype(np.int64)
    ids, labels = np.arange(8000), np.arange(8000) % 2
    at = np.arange(0, 8000, 400)
    s = rows[at] @ rows.T
    hi = np.sort(s, 1)[:, -500]
    best, who, scored = hn.search(hn.Tree(ids, labels, rows), 5, False, at, labels[at], rows[at], hi * 9 // 10, hi)
    for n in range(len(at)):
        want = sorted((-x, i) for i, x in enumerate(s[n]) if labels[i] != labels[at[n]] and hi[n] * 9 // 10 <= x <= hi[n])[:5]
        assert [(-x, i) for x, i in zip(best[n], who[n], strict=True) if x != hn.LEAST] == want
    assert scored < 0.35 * len(at) * len(rows)
