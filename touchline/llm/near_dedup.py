"""Near duplicates by SuperMinHash signatures, banding, exact verification and star components.

1. Each distinct shingle ranks the slots by a random permutation of its own; a slot keeps the smallest rank plus
   fraction. A rank is looked at only while some slot of the document is still unfilled (early stopping).
2. Documents with the same shingle set form one class. Classes that share a band form candidate groups.
3. Candidate groups are compared on full sets. A large group is split into blocks, and each task gets two of them,
   so no task holds a whole group. A task returns a spanning forest of its links, never all pairs.
4. Components of the verified links, spread over all members of each class.

Defined results: texts without words have an empty set, no links, and stay; null ids are allowed; repeated rows are in
one class; ties go to the smallest id; extra columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.spread import components, keep, runs
from touchline.llm.words import U64, mix, signed, word_slices

WORDS = 5
BAND_ROWS = 8
BLOCK = 512  # classes of a candidate group in one block
MISSES = 1e-5  # chance that a pair just at the threshold shares no band
_STEP = U64(0xD1342543DE82EF95)
_WRAP = (1 << 64) - 1


def bands_for(percent: int, rows: int = BAND_ROWS, misses: float = MISSES) -> int:
    return math.ceil(math.log(misses) / math.log(1 - (percent / 100) ** rows))


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, and where each row's set starts."""
    windows = np.zeros(max(0, len(hashes) - words + 1), dtype=U64)
    for k in range(words):
        windows *= _STEP
        windows += hashes[k : k + len(windows)]
    windows = mix(windows)
    sets, sizes = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(windows[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=U64)
            for k in range(a, b):
                whole = mix(whole * _STEP + hashes[k])
            sets.append(whole)
        else:
            sets.append(np.zeros(0, dtype=U64))
        sizes.append(len(sets[-1]))
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=U64)
    return flat, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def super_minhash(flat: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """One signature per set: per slot the least (rank of the slot + fraction) over its elements."""
    n = len(offsets) - 1
    signature = np.full((n, slots), np.inf)
    sizes = np.diff(offsets)
    first = 0
    while first < n:
        last = first + 1
        while last < n and offsets[last + 1] - offsets[first] <= 16384:
            last += 1
        # A long document goes on in pieces: minima combine in any order.
        for at in range(int(offsets[first]), int(offsets[last]), 16384):
            to = min(int(offsets[last]), at + 16384)
            owners = np.searchsorted(offsets, np.arange(at, to), side="right") - 1
            _ranks(flat[at:to], owners, signature, slots)
        first = last
    signature[sizes == 0] = np.inf
    return signature


def _ranks(elements: np.ndarray, owners: np.ndarray, signature: np.ndarray, slots: int) -> None:
    flat = signature.reshape(-1)
    order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
    rows = np.arange(len(elements))
    for rank in range(slots):
        draw = mix(elements + U64((rank + 1) * int(_STEP) & _WRAP))
        swap = rank + ((draw & U64(0xFFFFFFFF)) * U64(slots - rank) >> U64(32)).astype(np.int64)
        slot = order[rows, swap]
        order[rows, swap] = order[rows, rank]
        order[rows, rank] = slot
        value = rank + (mix(draw) >> U64(11)).astype(np.float64) * 2.0**-53
        np.minimum.at(flat, owners * slots + slot, value)
        docs = np.unique(owners)
        open_docs = docs[(signature[docs] >= rank + 1).any(axis=1)]
        if not len(open_docs):
            return
        if len(open_docs) < len(docs):
            still = np.isin(owners, open_docs)
            elements, owners, order = elements[still], owners[still], order[still]
            rows = np.arange(len(elements))


def set_key(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set: two sums of scrambled elements."""
    out = []
    for salt in (U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)):
        total = np.zeros(len(flat) + 1, dtype=U64)
        np.cumsum(mix(flat ^ salt), out=total[1:])
        out.append(total[offsets[1:]] - total[offsets[:-1]])
    return out[0], out[1]


def signatures(docs: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """doc_id, set size, set key and one hash per band."""
    bands = bands_for(percent)

    def run(batches):
        for batch in batches:
            for first, last, hashes, at in word_slices(batch.column("text")):
                flat, offsets = shingle_sets(hashes, at, words)
                key1, key2 = set_key(flat, offsets)
                sizes = np.diff(offsets)
                slots = super_minhash(flat, offsets, bands * BAND_ROWS).view(U64).reshape(last - first, bands, BAND_ROWS)
                values = np.arange(bands, dtype=U64)[None, :] + np.zeros((last - first, 1), dtype=U64)
                for k in range(BAND_ROWS):
                    values = mix(values * _STEP + slots[:, :, k])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (last - first) * bands + 1, bands, dtype=np.int32)), pa.array(signed(values.reshape(-1)))
                )
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, last - first) for c in ("doc_id", "text_key")),
                     pa.array(sizes), pa.array(signed(key1)), pa.array(signed(key2)), lists],
                    ["doc_id", "text_key", "n_shingles", "key1", "key2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key")).mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, key1 long, key2 long, bands array<long>"
    )


def candidate_links(classes: DataFrame) -> DataFrame:
    """(a, b): each class with the first class of every band it shares."""
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    return banded.join(shared.select("band", "first"), "band").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))


def linked_forest(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that join every verified component of a few sets; exact counts on full sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = 100 * common >= percent * (sizes.sum() - common)
        return [(int(nodes[0]), int(nodes[1]))] if linked and nodes[0] != nodes[1] else []
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((n, n), dtype=np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    for at in range(0, width, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((n, min(4096, width - at)), dtype=np.float32)
        part[row[a:b], column[a:b] - at] = 1
        common += part @ part.T
    common = np.rint(common).astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    label = np.arange(n)
    while True:
        lower = np.where(linked, label[None, :], n).min(axis=1)
        lower = np.minimum(label, lower)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    return [(int(nodes[label[i]]), int(nodes[i])) for i in range(n) if label[i] != i and nodes[label[i]] != nodes[i]]


def verified_links(docs: DataFrame, members: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Links between candidate classes, confirmed on full sets.

    ``members``: node, rep (a document of the class), key1, key2, root, blocks.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    known = texts.join(members, F.col("_id").eqNullSafe(F.col("rep"))).select("text", "node", "key1", "key2", "root", "blocks")

    def full(batches):
        for batch in batches:
            for first, last, hashes, at in word_slices(batch.column("text")):
                flat, offsets = shingle_sets(hashes, at, words)
                key1, key2 = set_key(flat, offsets)
                part = batch.slice(first, last - first)
                own = (signed(key1) == part.column("key1").to_numpy()) & (signed(key2) == part.column("key2").to_numpy())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(flat)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("root"), part.column("blocks"), lists], ["node", "root", "blocks", "shingles"]
                ).filter(pa.array(own))

    sets = known.mapInArrow(full, "node long, root long, blocks int, shingles array<long>")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = sets.withColumn("_own", own).withColumn("_other", other).select(
        "root", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "node", "shingles"
    )
    key = ["root", "i", "j"]

    def compare(batches):
        for table in runs(batches, key):
            nodes = table.column("node").to_numpy()
            if len(nodes) < 2:
                continue
            lists = table.column("shingles").combine_chunks()
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
            edges = linked_forest(nodes, [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], percent)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], ["a", "b"])

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept and a hash of the text, one row per document.

    A document without an id is kept only if no document with one is in its component.
    """
    return components_of(docs, percent, words).drop("root")


def components_of(docs: DataFrame, percent: int = 85, words: int = WORDS) -> DataFrame:
    """``near_duplicates`` and a number of the component (``root``), null for a text without words."""
    signed_docs = keep(signatures(docs, percent, words), "signatures")
    grouped = signed_docs.where("n_shingles > 0").groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = keep(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = components(candidate_links(classes))
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = classes.select("node", "rep", "key1", "key2").join(groups, "node").join(sizes, "root")
    found = components(verified_links(docs, members, percent, words))
    rooted = classes.select("node", "rep", "key1", "key2").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = rooted.join(lowest, "root").select("key1", "key2", "component_id", "root")
    named = signed_docs.select("doc_id", "text_key", "n_shingles", "key1", "key2").join(known, ["key1", "key2"], "left")
    # An empty set shares no key with a class, but its own may; it stays alone either way.
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    root = F.when(F.col("n_shingles") > 0, F.col("root"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), "text_key", root.alias("root")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
