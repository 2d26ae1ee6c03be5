"""Language identification by nearest centroid.

A text is a bag of character n-grams of its letters (``SIZES``, within words and with their edges), hashed to ``DIMS``
places, weighted by ``log(1 + count)`` and inverse document frequency and scaled to length one. Each language has up to
``CENTROIDS`` centroids, since one language may hold several kinds of text. The language of the centroid with the largest
cosine wins; a text farther from it than all but ``REJECT`` of the centroid's own training texts is marked as rejected.

1. Document frequencies are counted over all training texts.
2. Spherical k-means starts the centroids from at most ``SAMPLE`` training texts of each language, one task for each language.
3. One more round runs over all training texts: each task adds its texts up by centroid, the sums are added in Spark.
4. A last pass over all training texts counts cosines to the final centroids in bins; the radius is read from these.

The model is ``DIMS`` numbers for each centroid, with at most ``MOST_LANGUAGES`` languages; texts are never shuffled.

Defined results: null texts and texts without a letter get ``und`` with score 0 and take no part in training; rows with a null
language only get predictions; ties between centroids go to the language that is first by name; without training rows all
is ``und``; repeated rows are separate texts with equal results; long texts go in slices and are read whole; extra columns
pass through, those called like a new one are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.words import SLICE_BYTES, slices, text_bytes

DIMS = 1 << 12
SIZES = (1, 2, 3)
CENTROIDS = 4
SAMPLE = 1000  # training texts of each language that the first clusters are made from
STEPS = 12  # steps of k-means on the sample
REJECT = 0.002
BINS = 1000
MOST_LANGUAGES = 1000
ROWS = 256  # texts whose vectors a task holds at once
UNDETERMINED = "und"
COLUMNS = ("lang_pred", "lang_score", "lang_rejected")


@dataclass
class Model:
    languages: list[str]  # sorted
    owner: np.ndarray  # place of each centroid's language, ascending
    centroids: np.ndarray  # of length one
    idf: np.ndarray
    least: np.ndarray  # the smallest cosine that is not rejected, by centroid


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case form (0 unless a letter or a mark), and whether it is a letter."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
            letter[c] = kind == "L"
    return lower, letter


def _points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _cells(small: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the places of the grams that start at the first ``size`` points, and which of them count."""
    for k in SIZES:
        mixed = np.full(size, k, dtype=np.uint32)
        for i in range(k):
            mixed = (mixed ^ small[i : i + size]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        # A gram has no edge inside it, and a letter at least.
        if k < 3:
            real = small[:size] != 0
            if k == 2:
                real |= small[1 : 1 + size] != 0
        else:
            real = np.ones(size, dtype=bool)
            for i in range(1, k - 1):
                real &= small[i : i + size] != 0
        yield mixed * np.uint32(0x85EBCA77) >> np.uint32(33 - DIMS.bit_length()), real


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (texts x DIMS) of a few consecutive texts, and whether each has a letter."""
    lower, letter = _characters()
    n = len(offsets) - 1
    points = _points(data)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    has = np.concatenate([[0], np.cumsum(letter[points])])[begins]
    small = np.insert(lower[points], begins[:-1], 0)  # each text begins with an edge
    small = np.append(small, np.zeros(max(SIZES), dtype=np.uint32))
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(begins) + 1) * DIMS
    cells = [(owner + place)[real] for place, real in _cells(small, len(points) + n)]
    return np.bincount(np.concatenate(cells), minlength=n * DIMS).reshape(n, DIMS), has[1:] > has[:-1]


def counted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, gram counts, has a letter) for a few texts after the other."""
    data, offsets = text_bytes(column)
    for first, last in slices(offsets):
        for a in range(first, last, ROWS):
            b = min(last, a + ROWS)
            at = offsets[a : b + 1]
            if at[-1] - at[0] <= 2 * SLICE_BYTES:
                yield a, b, *gram_counts(data[at[0] : at[-1]], at - at[0])
            else:
                yield a, b, *_long_counts(data[at[0] : at[-1]])


def _long_counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of one long text, piece by piece; a piece sees as many points of the next one as its last grams need."""
    lower, letter = _characters()
    total, has, at = np.zeros((1, DIMS), dtype=np.int64), np.zeros(1, dtype=bool), 0
    while at < len(data):
        to = min(len(data), at + SLICE_BYTES)
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to += 1
        own = _points(data[at:to])
        after = _points(data[to : to + 4 * max(SIZES)])[: max(SIZES)]  # a last point cut in two is not among these
        front = np.zeros(1 if at == 0 else 0, dtype=np.uint32)
        behind = np.zeros(max(SIZES) - len(after), dtype=np.uint32)
        small = np.concatenate([front, lower[own], lower[after], behind])
        for place, real in _cells(small, len(front) + len(own)):
            total[0] += np.bincount(place[real], minlength=DIMS)
        has |= letter[own].any()
        at = to
    return total, has


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts, dtype=np.float32)
    out *= idf
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-12)[:, None]
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def clustered(vectors: np.ndarray, k: int = CENTROIDS, steps: int = STEPS) -> np.ndarray:
    """Spherical k-means: starts far apart (largest distance to those chosen), the first is the text nearest to the mean."""
    mean = unit_rows(vectors.mean(axis=0, keepdims=True))
    chosen = [int(np.argmax(vectors @ mean[0]))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        following = int(np.argmin(nearest))
        if nearest[following] > 1 - 1e-6:
            break
        chosen.append(following)
        nearest = np.maximum(nearest, vectors @ vectors[following])
    centroids = vectors[chosen]
    for _ in range(steps):
        label = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, label, vectors)
        filled = np.bincount(label, minlength=len(centroids)) > 0
        centroids = np.where(filled[:, None], unit_rows(sums), centroids)
    return centroids


def _summed(rows: DataFrame, make) -> list:
    """Rows (slot, place, value) of every task, added up by slot and place."""
    return rows.mapInArrow(make, "slot int, place int, value double").groupBy("slot", "place").agg(F.sum("value").alias("value")).collect()


def _cell_rows(table: np.ndarray) -> pa.RecordBatch:
    slot, place = np.nonzero(table)
    return pa.RecordBatch.from_arrays(
        [pa.array(slot, pa.int32()), pa.array(place, pa.int32()), pa.array(table[slot, place].astype(np.float64))], ["slot", "place", "value"]
    )


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id_: str = "doc_id") -> Model | None:
    """Fit on all rows that have a language; None if no such row has a letter."""
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull()).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(id_, text).alias("key")
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def frequencies(batches):
        found = np.zeros((1, DIMS + 1))
        for batch in batches:
            for _, _, counts, has in counted(batch.column("text")):
                found[0, :DIMS] += (counts[has] > 0).sum(axis=0)
                found[0, DIMS] += has.sum()
        yield _cell_rows(found)

    frequency = np.zeros(DIMS + 1)
    for _, place, value in _summed(known.select("text"), frequencies):
        frequency[place] = value
    if not frequency[DIMS]:
        return None
    idf = (np.log((1 + frequency[DIMS]) / (1 + frequency[:DIMS])) + 1).astype(np.float32)

    # About half as many texts again as the sample needs are looked at, chosen by their hash. At most MOST_LANGUAGES rows go out.
    span = 1 << 30
    shares = spark.createDataFrame([(k, int(min(1.0, (1.5 * SAMPLE + 100) / n) * span)) for k, n in sizes.items()], "lang string, share long")
    some = known.join(F.broadcast(shares), "lang").where(F.pmod("key", F.lit(span)) < F.col("share")).select("lang", "key", "text")

    def vectors(batches):
        for batch in batches:
            for first, last, counts, has in counted(batch.column("text")):
                rows = np.flatnonzero(has)
                part = batch.slice(first, last - first).take(pa.array(rows))
                packed = [x.tobytes() for x in weighted(counts[rows], idf)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("key"), pa.array(packed, pa.binary())], ["lang", "key", "vector"]
                )

    def start(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("vector", "ascending")]).slice(0, SAMPLE)
        rows = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.float32).reshape(-1, DIMS)
        found = clustered(rows)
        name = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([name] * len(found), pa.string()), "centroid": pa.array([x.tobytes() for x in found], pa.binary())})

    begun = some.mapInArrow(vectors, "lang string, key long, vector binary").groupBy("lang").applyInArrow(start, "lang string, centroid binary")
    begun = sorted((r["lang"], bytes(r["centroid"])) for r in begun.collect())
    languages = sorted({name for name, _ in begun})
    owner = np.array([languages.index(name) for name, _ in begun])
    centroids = np.frombuffer(b"".join(c for _, c in begun), dtype=np.float32).reshape(-1, DIMS)
    place = {name: k for k, name in enumerate(languages)}

    def nearest_own(batches, centroids):
        """Vectors of training texts, the nearest centroid of the text's language, and the cosine."""
        for batch in batches:
            named = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()])
            for first, last, counts, has in counted(batch.column("text")):
                rows = np.flatnonzero(has & (named[first:last] >= 0))
                x = weighted(counts[rows], idf)
                cosine = np.where(owner[None, :] == named[first:last][rows][:, None], x @ centroids.T, -1)
                best = np.argmax(cosine, axis=1)
                yield x, best, cosine[np.arange(len(rows)), best]

    def sums(batches):
        total = np.zeros((len(centroids), DIMS))
        for x, best, _ in nearest_own(batches, centroids):
            for c in np.unique(best):
                total[c] += x[best == c].sum(axis=0, dtype=np.float64)
        yield _cell_rows(total)

    added = np.zeros((len(centroids), DIMS))
    for slot, at, value in _summed(known.select("text", "lang"), sums):
        added[slot, at] = value
    filled = added.any(axis=1)
    moved = np.where(filled[:, None], unit_rows(added), centroids).astype(np.float32)

    def distances(batches):
        total = np.zeros((len(moved), BINS))
        for _, best, cosine in nearest_own(batches, moved):
            np.add.at(total, (best, np.clip((cosine * BINS).astype(int), 0, BINS - 1)), 1)
        yield _cell_rows(total)

    bins = np.zeros((len(moved), BINS))
    for slot, at, value in _summed(known.select("text", "lang"), distances):
        bins[slot, at] = value
    share = np.cumsum(bins, axis=1) / np.maximum(bins.sum(axis=1, keepdims=True), 1)
    least = (share > REJECT).argmax(axis=1) / BINS
    return Model(languages, owner, moved, idf, least)


def identify(docs: DataFrame, model: Model | None, text: str = "text", reject: bool = False) -> DataFrame:
    """Add the language, the cosine to its nearest centroid (0 to 1), and whether the text is rejected as too far from it.

    With ``reject`` the language of rejected texts is ``und``.
    """
    kept = docs.drop(*COLUMNS)
    types = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, t) for c, t in zip(COLUMNS, types, strict=True))])
    sent = None if model is None else docs.sparkSession.sparkContext.broadcast(model)
    columns = [*kept.columns, *COLUMNS]

    def run(batches):
        for batch in batches:
            for first, last, counts, has in counted(batch.column(text)):
                names = [UNDETERMINED] * (last - first)
                score, far = np.zeros(last - first), np.zeros(last - first, dtype=bool)
                rows = np.flatnonzero(has)
                if sent is not None and len(rows):
                    known = sent.value
                    cosine = weighted(counts[rows], known.idf) @ known.centroids.T
                    best = np.argmax(cosine, axis=1)
                    score[rows] = np.clip(cosine[np.arange(len(rows)), best], 0, 1)
                    far[rows] = score[rows] < known.least[best]
                    for row, c in zip(rows.tolist(), best.tolist(), strict=True):
                        if not (reject and far[row]):
                            names[row] = known.languages[known.owner[c]]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, last - first).columns, pa.array(names, pa.string()), pa.array(score), pa.array(far)],
                    columns,
                )

    return kept.mapInArrow(run, schema)
