"""Lexical search and whitening against brute force."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siliscope.llm import lexical_search as ls
from siliscope.llm import whitening as wh

COMMENT = "review_case_id long, safe_comment string"
REQUEST = "line_no long, safe_comment string"


def fold(text):
    return re.findall(ls.TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def by_hand(comments, requests, k):
    rows = [(i, Counter(fold(t))) for i, t in comments if i is not None]
    texts = [c for _, c in rows if c]
    n_all, l_all = len(texts), sum(c.total() for c in texts)
    df = Counter(t for c in texts for t in c)
    asked = {}
    for line, text in requests:
        if line is not None:
            asked.setdefault(line, set()).update(fold(text))
    out = []
    for line, terms in asked.items():
        scored = []
        for i, c in rows:
            n = c.total()
            m = 100 - 50 + (50 * n * n_all) // l_all if l_all else 50
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in terms if t in c)
            if score > 0:
                scored.append((-score, i))
        out += [(line, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r.line_no, r.rank, r.review_case_id, r.score) for r in df.collect())


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("slice_size, leaf", [(4096, 32), (40, 4)])
def test_search_equals_brute_force(spark, monkeypatch, slice_size, leaf):
    monkeypatch.setattr(ls, "SLICE", slice_size)
    monkeypatch.setattr(ls, "BLOCK_TERMS", 64)
    comments = list(enumerate(texts(700, 3)))
    comments += [(1000 + i, comments[5][1]) for i in range(90)]  # copies: ties go to the smaller id
    comments += [(2000, None), (2001, ""), (2002, "W1 Ünï w1;W2"), (2003, "w3 " * 4000), (None, "w1 w2"), (7, "w1 w5 w9"), (7, "w1 w5 w9")]
    requests = [(i, t) for i, t in enumerate(texts(30, 4))] + [(40, comments[5][1]), (41, None), (42, "..."), (43, "nowhere"), (44, "Ünï"),
                                                             (45, "w1 w1 w2"), (45, "w7"), (None, "w1")]
    got = ls.search(spark.createDataFrame([(*c, "x") for c in comments], COMMENT + ", score string"),
                    spark.createDataFrame([(*r, 1) for r in requests], REQUEST + ", `a.b` int"), k=7)
    assert got.columns == ["line_no", "rank", "review_case_id", "score"]
    assert found(got) == by_hand(comments, requests, 7)


def test_search_with_text_ids_and_empty_tables(spark):
    comments = spark.createDataFrame([("w1__rank1", "ring edge"), ("w2__rank1", "ring edge"), ("w0__rank2", "ring")], "review_case_id string, safe_comment string")
    requests = spark.createDataFrame([("q", "ring edge")], "line_no string, safe_comment string")
    got = ls.search(comments, requests, k=2)
    assert [(r.rank, r.review_case_id) for r in got.orderBy("rank").collect()] == [(1, "w1__rank1"), (2, "w2__rank1")]
    assert ls.search(comments.limit(0), requests).count() == 0
    assert ls.search(comments, requests.limit(0)).count() == 0


def test_ball_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 12, 600)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    cols = np.concatenate([rng.choice(np.arange(40) + 40 * (i % 5), n, replace=False) for i, n in enumerate(lengths)])
    parts = rng.integers(1, 900_000, len(cols))
    tree = ls.BallTree(cols, parts, starts, np.ones(200))
    dense = np.zeros((600, 200), np.int64)
    dense[np.repeat(np.arange(600), lengths), cols] = parts
    requests = [(rng.choice(np.arange(40) + 40 * (i % 5), 6, replace=False), rng.integers(1, 9000, 6)) for i in range(20)]
    bounds = tree.bounds([(c, w.astype(float)) for c, w in requests])
    left_out = 0
    for (c, w), bound in zip(requests, bounds):
        true = dense[tree.members][:, c] @ w
        for (lo, hi), b in zip(tree.spans, bound):
            assert true[lo:hi].max() <= b
        scores, places = tree.best(c, w, bound, 1, 5, np.arange(600), np.zeros(200, np.int64))
        assert sorted(scores.tolist()) == np.sort(true)[-5:].tolist() and (true[places] == scores).all()
        left_out += (bound < scores.min()).sum()
    assert left_out > 0


FEATURES = "sample_id long, features array<bigint>"


def whitened(df):
    rows = df.orderBy("sample_id", "component").collect()
    width = max((r.component for r in rows), default=0)
    return rows, np.array([r.whitened for r in rows]).reshape(-1, width) if width else np.zeros((0, 0))


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(5)
    x = np.floor(64 * rng.standard_normal((300, 12)) @ np.diag(np.linspace(1, 3, 12)) @ rng.standard_normal((12, 12))).astype(int) + 1_000_000
    table = spark.createDataFrame([(i, row.tolist(), "c") for i, row in enumerate(x)] + [(900, None, "c"), (901, [1, None], "c"), (902, [5], "c")],
                                  FEATURES + ", component string")
    rows, got = whitened(wh.whiten(table.repartition(5), components_kept=7))
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    want = centred @ vectors[:, ::-1][:, :7] / np.sqrt(values[::-1][:7])
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-9
    assert [r.deviation for r in rows[::7]] == ((n * x - sums) ** 2).sum(1).tolist()
    assert {r.n for r in rows} == {300} and max(r.identity_error for r in rows) < 1e-9
    assert np.allclose([r.explained for r in rows[:7]], values[::-1][:7] / values.sum(), rtol=1e-10)


def test_whitening_with_lost_rank_and_equal_deviations(spark):
    # four dimensions: two of equal variance, one a copy, one constant
    x = [(a, b, a, 7) for a in (-1, 1) for b in (-1, 1)] * 3
    rows, got = whitened(wh.whiten(spark.createDataFrame([(i, list(v)) for i, v in enumerate(x)], FEATURES)))
    assert got.shape == (12, 2) and np.abs(got.T @ got / 12 - np.eye(2)).max() < 1e-12
    assert [round(r.explained, 12) for r in rows[:2]] == [round(2 / 3, 12), round(1 / 3, 12)]
    x = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]  # all deviations equal
    rows, got = whitened(wh.whiten(spark.createDataFrame([(i, list(v)) for i, v in enumerate(x)], FEATURES)))
    assert got.shape == (6, 3) and np.abs(got.T @ got / 6 - np.eye(3)).max() < 1e-12


def test_whitening_of_little_or_nothing(spark):
    empty = spark.createDataFrame([], FEATURES)
    assert wh.whiten(empty).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, [4, 5])], FEATURES)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, [4, 5]), (1, [4, 5]), (None, [4, 5]), (2, [])], FEATURES)).count() == 0
    text = wh.whiten(spark.createDataFrame([("a", [0, 1]), ("a", [2, 3]), (None, [4, 5])], "sample_id string, features array<bigint>"))
    assert sorted((str(r.sample_id), round(r.whitened, 9)) for r in text.collect()) == [("None", 1.224744871), ("a", -1.224744871), ("a", 0.0)]
    vast = wh.whiten(spark.createDataFrame([(1, [2 ** 52]), (2, [-(2 ** 52)])], FEATURES)).collect()
    assert [r.deviation for r in vast] == [None, None] and sorted(round(r.whitened, 9) for r in vast) == [-1.0, 1.0]


def test_quantised_vectors(spark):
    table = spark.createDataFrame([([0.5, -0.01],), ([None, 1.0],), ([float("nan")],), ([float("inf")],), (None,), ([1e20],), ([],)], "v array<double>")
    assert [r[0] for r in table.select(wh.quantised(F.col("v"))).collect()] == [[1000032, 999999], None, None, None, None, None, []]
