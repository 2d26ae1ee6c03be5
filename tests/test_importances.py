"""Importance of an input on held-out rows, against a plain loop."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from touchline.plans.models import permutation_importances

FEATURES = ["a", "b", "unused", "kind"]


def _score(df):
    return df.withColumn("p", F.expr("1 / (1 + exp(-(2 * coalesce(a, 0) - b + if(kind = 'x', 1, 0))))"))


def _loss(row):
    p = 1 / (1 + math.exp(-(2 * (row["a"] or 0) - row["b"] + (1 if row["kind"] == "x" else 0))))
    return -math.log(p if row["label"] else 1 - p)


def test_against_a_plain_loop(spark):
    rng = random.Random(2)
    rows = []
    for k in range(200):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append({"event_id": k, "a": None if k % 9 == 0 else a, "b": b, "unused": rng.random(), "kind": rng.choice("xy"), "label": int(2 * a > b)})
    df = spark.createDataFrame(rows, "event_id int, a double, b double, unused double, kind string, label int")
    loss = F.expr("-ln(if(label = 1, p, 1 - p))")
    got = {r["feature"]: r for r in permutation_importances(df.repartition(5), _score, FEATURES, loss, seed=3).collect()}
    order = sorted(rows, key=lambda r: hashlib.md5(f"3:{r['event_id']}".encode()).hexdigest())
    base = sum(map(_loss, rows)) / len(rows)
    for name in FEATURES:
        shift = 1 + int(hashlib.md5(f"3:{name}".encode()).hexdigest()[:8], 16) % (len(rows) - 1)
        mixed = [r | {name: order[(i + shift) % len(rows)][name]} for i, r in enumerate(order)]
        want = sum(map(_loss, mixed)) / len(rows)
        assert abs(got[name]["permuted_loss"] - want) < 1e-9 and abs(got[name]["loss"] - base) < 1e-9
    assert abs(got["unused"]["importance"]) < 1e-12 and got["a"]["importance"] > got["kind"]["importance"]


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5, 0.1, "x", 1)], "event_id int, a double, b double, unused double, kind string, label int")
    loss = F.expr("-ln(if(label = 1, p, 1 - p))")
    assert {r["importance"] for r in permutation_importances(df, _score, FEATURES, loss).collect()} == {0.0}
    assert permutation_importances(df.limit(0), _score, FEATURES, loss).count() == 0
