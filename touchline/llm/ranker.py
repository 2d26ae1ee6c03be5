"""Quality scores by Bradley-Terry pairwise ranking.

A preference pair is a good and a bad document; the model is a linear score, fitted by logistic loss on the feature
difference of pairs, and a document's strength does not depend on where the classes split. The split comes last: a
quantile of scores, shifted to the wanted cut, so the result is a number from 0 to 1.

Features describe a whole text (case, symbols, repetition, line and word shape); they are computed once for all
documents. The fit takes every labelled document: scales and quantiles are those of all of them, and by a hash of its
features each one, equal ones once with their number, goes to a group of about ``GROUP``, within which all pairs are
compared. So pairs grow with the documents and not with their square. Documents of the rarer class go to several
groups where ``LEAST`` would not meet in one. Newton steps sum the groups' slopes and curvatures in Spark.

Defined results: null and empty texts have all-zero shares and get the score of such a text; repeated rows score alike;
documents without a label are scored and never learnt from; of contradictory labels the lower one counts; only the
named columns are read, so extra columns with clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.spread import keep
from touchline.llm.words import U64, hashed_words, slices, text_bytes
from touchline.operators.ordered import quantiles_of_counts

GROUP = 512  # different labelled documents in a group
LEAST = 32  # those of the rarer class in a group
STEPS = 40
RIDGE = 1e-3
LOW, HIGH = 0.02, 0.98
CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789",
    "exclaim": "!", "bar": "|", "mark": "#$%&*<>@^~=+_\\{}[]", "stop": ".", "comma": ",", "line": "\n", "other": "?;:'\"()/-",
}
FEATURES = [*CLASSES, "beyond_ascii", "shift_case", "words", "mean_word", "same_word", "distinct", "same_pair", "per_line"]


def _tables() -> np.ndarray:
    out = np.zeros((len(CLASSES) + 2, 256), dtype=bool)
    for k, chars in enumerate(CLASSES.values()):
        out[k, list(chars.encode())] = True
    out[-2, 128:] = True
    out[-1, 0x80:0x9F] = True  # second bytes of accented capitals
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = np.zeros((n, len(CLASSES) + 2))
    total = np.zeros(len(data) + 1, dtype=np.int64)
    for k, table in enumerate(_tables()):
        inside = table[data]
        if k == len(CLASSES) + 1:
            inside[1:] &= data[:-1] == 0xC3
            inside[:1] = False
        np.cumsum(inside, out=total[1:])
        counts[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    hashes, at = hashed_words(data, offsets)
    words = np.diff(at)
    repeats = np.zeros((n, 3))
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        own = hashes[a:b]
        if b - a > 1:
            pairs = own[1:] * U64(3) + own[:-1]
            repeats[row] = (own[1:] == own[:-1]).mean(), len(np.unique(own)) / (b - a), 1 - len(np.unique(pairs)) / (b - a - 1)
        elif b > a:
            repeats[row, 1] = 1
    shares = np.log1p(100 * counts / np.maximum(sizes, 1)[:, None])
    case = counts[:, 0] + counts[:, -1]
    spaces = np.maximum(words, 1)
    return np.column_stack(
        [shares[:, :-1], np.log1p(100 * case / np.maximum(case + counts[:, 1], 1)), np.log1p(words), sizes / spaces, repeats,
         np.log1p(words / (1 + counts[:, list(CLASSES).index("line")]))]
    ).astype(np.float32)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every whole text."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for first, last in slices(offsets):
                at = offsets[first : last + 1]
                rows = features(data[at[0] : at[-1]], at - at[0])
                bounds = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.ListArray.from_arrays(bounds, pa.array(rows.reshape(-1)))],
                    ["doc_id", "features"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, features array<float>")


def held_out(doc_id: str | Column = "doc_id", parts: int = 5, remainder: int = 0) -> Column:
    """Whether a document belongs to the part that is never learnt from; a null id counts as an empty one."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts == remainder


def expanded(x: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Scaled features and their squares."""
    z = (x - middle) / spread
    return np.hstack([z, z**2])


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray, n_good: np.ndarray | None = None, n_bad: np.ndarray | None = None) -> np.ndarray:
    """Number, loss, slope and curvature of all pairs of a good and a bad row, which stand for so many equal rows, in one vector."""
    margin = (good @ w)[:, None] - (bad @ w)[None, :]
    times = np.multiply.outer(np.ones(len(good)) if n_good is None else n_good, np.ones(len(bad)) if n_bad is None else n_bad)
    chance = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
    slope = times * chance
    bend = slope * (1 - chance)
    cross = good.T @ bend @ bad
    curvature = (good.T * bend.sum(axis=1)) @ good + (bad.T * bend.sum(axis=0)) @ bad - cross - cross.T
    gradient = slope.sum(axis=0) @ bad - slope.sum(axis=1) @ good
    return np.concatenate([[times.sum(), (times * np.logaddexp(0, -margin)).sum()], gradient, curvature.reshape(-1)])


def newton(sums, size: int, steps: int = STEPS) -> np.ndarray:
    """Weights of the least mean loss and ridge; ``sums`` gives the ``pair_sums`` at some weights. A step that goes too far is halved."""
    at, move, best = np.zeros(size), np.zeros(size), np.inf
    for _ in range(steps):
        w = at + move
        total = sums(w)
        total = total[1:] / total[0]
        loss = total[0] + 0.5 * RIDGE * w @ w
        if loss > best + 1e-12:
            move = move / 2
            continue
        at, best = w, loss
        gradient = total[1 : size + 1] + RIDGE * w
        move = -np.linalg.solve(total[size + 1 :].reshape(size, size) + RIDGE * np.eye(size), gradient)
        if -gradient @ move < 1e-12:
            break
    return at


def unscaled(w: np.ndarray, middle: np.ndarray, spread: np.ndarray, split: float, cut: float) -> tuple[np.ndarray, float]:
    """Undo the scaling, so that a score is one sum over the features and their squares, and is ``cut`` at the split."""
    linear, squared = w[: len(middle)], w[len(middle) :]
    weights = np.concatenate([linear / spread - 2 * squared * middle / spread**2, squared / spread**2])
    offset = -(linear * middle / spread).sum() + (squared * middle**2 / spread**2).sum() - split + np.log(cut / (1 - cut))
    return weights, float(offset)


def fit(x: np.ndarray, good: np.ndarray, cut: float) -> tuple[np.ndarray, float]:
    """Weights and offset over all pairs of rows at hand: the score of ``x`` is the logistic function of ``x @ weights + offset``."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = expanded(x, middle, spread)
    w = newton(lambda w: pair_sums(z[good], z[~good], w), z.shape[1])
    # The split lies between the upper scores of bad documents and the lower ones of good documents.
    split = (np.quantile(z[~good] @ w, HIGH) + np.quantile(z[good] @ w, LOW)) / 2
    return unscaled(w, middle, spread, split, cut)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


def _scales(different: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every feature over all labelled documents."""
    value = [F.col("features")[i].cast("double") for i in range(len(FEATURES))]
    mean = different.agg(*[F.sum(v * F.col("n")) / F.sum("n") for v in value]).first()
    square = different.agg(*[F.sum((v - F.lit(m)) ** 2 * F.col("n")) / F.sum("n") for v, m in zip(value, mean, strict=True)]).first()
    return np.array(mean, dtype=float), np.sqrt(np.array(square, dtype=float)) + 1e-6


def _groups(different: DataFrame, rare: bool, n_rare: int, total: int) -> DataFrame:
    """(group, rows): the labelled documents that are compared with each other, kept."""
    groups = max(1, total // GROUP)
    copies = min(groups, -(-LEAST * groups // n_rare))
    places = F.when(F.col("good") == rare, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    dealt = different.withColumn("copy", F.explode(places)).select(
        F.pmod(F.xxhash64("features") + F.col("copy"), F.lit(groups)).alias("group"), F.struct("features", "good", "n").alias("row")
    )
    # A group is little to read and much to compute: AQE would put all of them in a few tasks.
    tasks = int(different.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(dealt.repartition(tasks, "group").groupBy("group").agg(F.collect_list("row").alias("rows")), "pairs")


def _group_sums(groups: DataFrame, w: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """``pair_sums`` over all groups, added up in Spark."""

    def run(batches):
        total = 0.0
        for batch in batches:
            for rows in batch.column("rows"):
                rows = rows.values
                z = expanded(_matrix(rows.field("features")), middle, spread)
                good, n = rows.field("good").to_numpy(zero_copy_only=False), rows.field("n").to_numpy().astype(np.float64)
                total = total + pair_sums(z[good], z[~good], w, n[good], n[~good])
        if not isinstance(total, float):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"])

    added = groups.select("rows").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(2 + len(w) + len(w) ** 2)
    for row in added.collect():  # a number for each pair of weights, whatever the input
        out[row["at"]] = row["value"]
    return out


def _split(different: DataFrame, w: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> float:
    """Halfway between the upper scores of all bad and the lower scores of all good documents."""

    def run(batches):
        for batch in batches:
            score = expanded(_matrix(batch.column("features")), middle, spread) @ w
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(score), batch.column("n")], ["good", "score", "n"])

    counts = different.mapInArrow(run, "good boolean, score double, n long").groupBy("good", "score").agg(F.sum("n").alias("n"))
    # A class at a time: grouped by class, all scores of one would meet in one task.
    ends = [quantiles_of_counts(counts.where(F.col("good") == good).drop("good"), [], "score", "n", [share]).first()["quantiles"][0]
            for good, share in ((False, HIGH), (True, LOW))]
    return sum(ends) / 2


def scored(rows: DataFrame, weights: np.ndarray, offset: float) -> Column:
    n = len(weights) // 2
    linear, squared = (F.array(*(F.lit(float(v)) for v in part)) for part in (weights[:n], weights[n:]))
    terms = F.zip_with(F.zip_with("features", linear, lambda f, w: F.struct(f.cast("double").alias("f"), w.alias("w"))), squared,
                       lambda p, s: p["f"] * p["w"] + p["f"] * p["f"] * s)
    return 1 / (1 + F.exp(-(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) + offset)))


def learn(rows: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and offset from all labelled documents among the featured ``rows``; held-out labels are not read."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("y"))
    labelled = rows.join(known, "doc_id").select("features", (F.col("y") == 1).alias("good"))
    different = keep(labelled.groupBy("features", "good").agg(F.count(F.lit(1)).alias("n")), "labelled")
    sizes = {r["good"]: r["n"] for r in different.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        # Nothing to prefer: every document gets the same score, on the side of the only class.
        return np.zeros(2 * len(FEATURES)), -3.0 if False in sizes else 1.0
    rare = sizes[True] < sizes[False]
    middle, spread = _scales(different)
    groups = _groups(different, rare, sizes[rare], sum(sizes.values()))
    w = newton(lambda w: _group_sums(groups, w, middle, spread), 2 * len(FEATURES))
    return unscaled(w, middle, spread, _split(different, w, middle, spread), cut)


def rank_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``cut`` on) of every document."""
    rows = keep(featured(docs), "features")
    score = scored(rows, *learn(rows, labels, label, cut))
    return rows.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int")
    )


def with_quality(docs: DataFrame, weights: np.ndarray, offset: float, name: str = "quality_score") -> DataFrame:
    """Add the score of a learnt model to every document, whatever its id, without moving texts."""
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for first, last in slices(offsets):
                at = offsets[first : last + 1]
                x = features(data[at[0] : at[-1]], at - at[0]).astype(np.float64)
                score = 1 / (1 + np.exp(-np.clip(np.hstack([x, x**2]) @ weights + offset, -500, 500)))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, name])

    return kept.mapInArrow(run, schema)
