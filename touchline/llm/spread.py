"""Helpers that several operators share: connected components, kept tables, grouped Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import fresh_path, shared_dir


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: fixed rows that outlive executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def least_by_hash(df: DataFrame, most: int, rows: int | None = None) -> DataFrame:
    """At most ``most`` rows, those whose hash of doc_id is least.

    A share of the hash range that holds somewhat more rows is cut out first, so tasks don't each
    hand over as many rows as the whole sample. ``rows`` is the number of rows, if known.
    """
    span = 1 << 30
    place = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    rows = df.count() if rows is None else rows
    some = df.where(place < int(min(1.0, 1.5 * most / max(rows, 1) + 100 / max(rows, 1)) * span))
    return some.orderBy(place, "doc_id").limit(most)


def _fixed(df: DataFrame) -> tuple[DataFrame, tuple]:
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    return out, tuple(out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge list of longs.

    Union-find by stars over the whole edge list: each round points all larger
    neighbours of a node at its smallest one, then the smaller ones, until no edge
    changes. Edges stay in Spark; the driver sees a count and a checksum per round.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current, state = _fixed(pairs)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = small.unionByName(low.withColumnRenamed("m", "v")).where("u != v").distinct()
        following, reached = _fixed(step)
        if reached == state:
            roots = following.select(F.col("v").alias("u"), "v").distinct()
            return following.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
        current, state = following, reached


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with one key of a sorted partition, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
        start = 0
        for at in range(len(keys)):
            if keys[at] != last:
                if at > start:
                    held.append(batch.slice(start, at - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], at, keys[at]
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
