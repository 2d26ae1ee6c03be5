"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents count as labelled; all others, whatever their label, are unlabelled text that may hold
toxic documents. With the class prior p, the risk of calling unlabelled text negative is corrected by what its toxic
share adds: R = p * R(toxic, +) + max(0, R(unlabelled, -) - p * R(toxic, -)). Where the corrected part falls below zero,
the step goes the other way, so the classifier cannot fit unlabelled toxic text as negative.

Features are the beginnings of words (4 to 8 bytes, A-Z lower-cased) and whole words, present or not. Those that are
``RATIO`` times as frequent in toxic as in unlabelled documents of the sample, or the reverse, enter the model.

The fit takes at most ``most_toxic`` confirmed and ``most_unlabelled`` other documents, least in the order of a hash of
their id. Defined results: null and empty texts have no features and score by the offset alone; repeated rows score
alike; without confirmed examples every score is 0; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.ranker import held_out
from touchline.llm.spread import keep, least_by_hash
from touchline.llm.words import LOWER, U64, mix, powers, slices, spans, text_bytes

MOST_TOXIC = 4_000
MOST_UNLABELLED = 8_000
MOST_FEATURES = 1_000
RATIO = 3.0
LENGTHS = (4, 5, 6, 7, 8)
STEPS = 300


def beginnings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word beginning and every whole word."""
    starts, ends = spans(data, offsets) if len(data) else (np.zeros(0, dtype=np.int64),) * 2
    forward, back = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((LOWER[data].astype(U64) + U64(1)) * forward[: len(data)], out=total[1:])
    rows = np.searchsorted(offsets, starts, side="right") - 1
    found_rows, found = [rows], [mix((total[ends] - total[starts]) * back[starts])]
    for n in LENGTHS:
        long = ends - starts >= n
        at = starts[long]
        found_rows.append(rows[long])
        found.append(mix((total[at + n] - total[at]) * back[at] + U64(n)))
    return np.concatenate(found_rows), np.concatenate(found)


def _presence(column: pa.Array):
    """(first row, end row, rows, features), each pair once, slice by slice."""
    data, offsets = text_bytes(column)
    for first, last in slices(offsets):
        at = offsets[first : last + 1]
        rows, found = beginnings(data[at[0] : at[-1]], at - at[0])
        order = np.lexsort((found, rows))
        rows, found = rows[order], found[order]
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
        yield first, last, rows[fresh], found[fresh]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and offset of the non-negative corrected risk, by Adam on all rows."""
    w, b = np.zeros(positive.shape[1], dtype=np.float32), -1.0
    slope, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-(positive @ w + b))), 1 / (1 + np.exp(-(unlabelled @ w + b)))
        # Sigmoid loss: the loss of calling x negative is its score, of calling it positive one minus it.
        dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        corrected = su.mean() - prior * sp.mean()
        gp, gu = np.append(positive.T @ dp, dp.sum()), np.append(unlabelled.T @ du, du.sum())
        gradient = -prior * gp + (gu - prior * gp) if corrected >= 0 else -(gu - prior * gp)
        gradient[:-1] += 1e-5 * w
        slope = 0.9 * slope + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = 0.05 * (slope / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return w, b


def score_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_unlabelled: int = MOST_UNLABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of the held-out part are never read."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = own.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    confirmed = least_by_hash(own.where("toxic = 1"), most_toxic).select("doc_id", F.lit(1).alias("y"))
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rest = known.where(~held_out()).join(own.where("toxic = 1"), "doc_id", "left_anti").select("doc_id").distinct()
    others = least_by_hash(rest, most_unlabelled, docs.count()).select("doc_id", F.lit(0).alias("y"))
    # At most most_toxic + most_unlabelled ids: a bounded table.
    sample = known.join(F.broadcast(confirmed.unionByName(others)), "doc_id").select("y", F.coalesce("text", F.lit("")).alias("text"))

    def present(batches):
        for batch in batches:
            texts = batch.column("text")
            for first, last, rows, found in _presence(texts):
                at = np.searchsorted(rows, np.arange(last - first + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("y").slice(first, last - first),
                     pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.view(np.int64)))], ["y", "found"]
                )

    counts = sample.mapInArrow(present, "y int, found array<long>")
    chosen, weights, offset = _fitted(counts, shares or 0.0)
    score = score_rows(known, chosen, weights, offset)
    return score.select("doc_id", held_out().alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _fitted(counts: DataFrame, prior: float, most: int = MOST_FEATURES):
    """Choose features in Spark, then bring the bounded sample's chosen features to the driver and fit."""
    counts = keep(counts, "presence")
    sizes = {r["y"]: r["n"] for r in counts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not prior:
        return np.zeros(0, dtype=U64), np.zeros(0), -1e9
    each = counts.select("y", F.explode("found").alias("f")).groupBy("f").agg(
        F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("u")
    )
    a = (F.col("p") + 0.5) / (sizes[1] + 1)
    b = (F.col("u") + 0.5) / (sizes.get(0, 0) + 1)
    gain = F.abs(a - b) * F.abs(F.log(a / b))
    best = each.where("p + u >= 8").where(F.greatest(a, b) >= RATIO * F.least(a, b)).withColumn("gain", gain).orderBy(F.desc("gain"), "f").limit(most)
    chosen = np.sort(np.array([r["f"] for r in best.select("f").collect()], dtype=np.int64).view(U64))

    def only(batches):
        for batch in batches:
            lists = batch.column("found")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
            hit = np.isin(values, chosen)
            total = np.concatenate([[0], np.cumsum(hit)])
            at = np.searchsorted(chosen, values[hit]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.ListArray.from_arrays(pa.array(total[offsets].astype(np.int32)), pa.array(at))], ["y", "at"]
            )

    rows = counts.mapInArrow(only, "y int, at array<int>").collect()
    dense = {y: np.zeros((sizes.get(y, 0), len(chosen)), dtype=np.float32) for y in (0, 1)}
    seen = {0: 0, 1: 0}
    for r in rows:
        dense[r["y"]][seen[r["y"]], r["at"]] = 1
        seen[r["y"]] += 1
    weights, offset = fit(dense[1], dense[0], prior) if len(dense[0]) else (np.zeros(len(chosen)), 0.0)
    return chosen, weights.astype(np.float64), offset


def score_rows(docs: DataFrame, chosen: np.ndarray, weights: np.ndarray, offset: float) -> DataFrame:
    """doc_id and score of every whole text."""
    filter_bits = np.zeros(1 << 20, dtype=bool)
    filter_bits[(chosen & U64((1 << 20) - 1)).astype(np.int64)] = True

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for first, last in slices(offsets):
                at = offsets[first : last + 1]
                sums = np.full(last - first, offset)
                if len(chosen):
                    rows, found = beginnings(data[at[0] : at[-1]], at - at[0])
                    maybe = filter_bits[(found & U64((1 << 20) - 1)).astype(np.int64)]
                    rows, found = rows[maybe], found[maybe]
                    place = np.minimum(np.searchsorted(chosen, found), len(chosen) - 1)
                    hit = chosen[place] == found
                    once = np.unique(rows[hit] * len(chosen) + place[hit])
                    np.add.at(sums, once // len(chosen), weights[once % len(chosen)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(1 / (1 + np.exp(-np.clip(sums, -500, 500))))], ["doc_id", "score"]
                )

    return docs.mapInArrow(run, "doc_id long, score double")
