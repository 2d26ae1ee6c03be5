import numpy as np
import pytest

from touchline.llm import ranker


def _rows(n, share, seed):
    """Featured rows with labels; the classes overlap."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(ranker.FEATURES))).astype(np.float32)
    good = x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=n) > np.quantile(x[:, 0], share)
    ids = [k for k in range(3 * n) if not _out(k)][:n]
    return x, good, ids


def _out(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 5 == 0


def _learnt(spark, x, good, ids):
    rows = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in zip(ids, x)], "doc_id long, features array<float>")
    labels = spark.createDataFrame([(k, int(g)) for k, g in zip(ids, good)], "doc_id long, quality int")
    return ranker.learn(rows, labels)


def test_the_model_is_that_of_all_pairs_and_all_quantiles(spark):
    x, good, ids = _rows(260, 0.4, 5)
    x, good, ids = np.vstack([x, x[:40]]), np.append(good, good[:40]), ids + [10_000 + k for k in range(200) if not _out(10_000 + k)][:40]
    weights, offset = _learnt(spark, x, good, ids)
    expected, at = ranker.fit(x.astype(np.float64), good, 0.3)
    assert np.allclose(weights, expected, atol=1e-5) and offset == pytest.approx(at, abs=1e-5)


def test_every_labelled_document_meets_the_other_class(spark, monkeypatch):
    monkeypatch.setattr(ranker, "GROUP", 32)
    monkeypatch.setattr(ranker, "LEAST", 8)
    x, good, ids = _rows(600, 0.95, 6)
    seen = []
    sums = ranker._group_sums

    def watched(groups, w, middle, spread):
        if not seen:
            seen.extend(groups.selectExpr("group", "inline(rows)").collect())
        return sums(groups, w, middle, spread)

    monkeypatch.setattr(ranker, "_group_sums", watched)
    weights, offset = _learnt(spark, x, good, ids)
    classes = {}
    for r in seen:
        classes.setdefault(r["group"], set()).add(r["good"])
    assert len(classes) > 10 and all(c == {True, False} for c in classes.values())
    assert {(tuple(r["features"]), r["good"]) for r in seen} == {(tuple(float(v) for v in row), bool(g)) for row, g in zip(x, good)}
    full = np.hstack([x, x**2]).astype(np.float64)
    expected, at = ranker.fit(x.astype(np.float64), good, 0.3)
    assert np.corrcoef(full @ weights, full @ expected)[0, 1] > 0.97
