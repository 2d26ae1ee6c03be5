"""Token ids packed into rows of one length, by best-fit decreasing.

Each document becomes its ids and an end id. A document longer than a row is cut
into consecutive parts, none dropped. Parts go, longest first, into the open row
with the least room that still holds them; a segment tree over the room values
finds it. A row has its ids as one fixed-width binary matrix row, the cumulative
segment lengths, positions that restart in each segment, and the document,
occurrence and part number of each segment, so ``unpack`` gives back every
document exactly.

Documents are packed in windows of ``window_ids`` ids within a Spark partition:
nothing is shuffled, and memory does not grow with the data. Defined results:
null and empty texts are one end id; repeated rows are packed each for itself;
other columns are not carried.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_IDS = 2048
WINDOW_IDS = 1 << 21
SCHEMA = (
    "row_id long, n_ids int, ids binary, cu_seqlens array<int>, positions binary, "
    "doc_ids array<long>, occurrences array<long>, parts array<int>"
)


class Rooms:
    """Open rows by the room left in them, with a segment tree over the room values."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _count(self, room: int, step: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += step
            at >>= 1

    def add(self, row: int, room: int) -> None:
        if room:
            self.rows.setdefault(room, []).append(row)
            self._count(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``need``."""
        tree, at = self.tree, need + self.leaves
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):  # up until a right neighbour has rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not tree[at]:
                    at += 1
        room = at - self.leaves
        self._count(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers; every item fits, none is lost. Equal lengths keep their order."""
    rooms, rows = Rooms(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[item])
        row, room = found or (len(rows), capacity)
        if found is None:
            rows.append([])
        rows[row].append(item)
        rooms.add(row, room - lengths[item])
    return rows


@lru_cache(maxsize=2)
def ranks_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def pack(docs: DataFrame, ranks: str, pattern: str, row_ids: int = ROW_IDS, window_ids: int = WINDOW_IDS) -> DataFrame:
    """Packed rows of ``docs`` (doc_id, text)."""

    def rows_of(window, end, width, first_row):
        parts = []  # document number, part number, from, to
        for k, (_, _, ids) in enumerate(window):
            parts += [(k, p, at, min(at + row_ids, len(ids))) for p, at in enumerate(range(0, len(ids), row_ids))]
        out = []
        for n, items in enumerate(best_fit([b - a for _, _, a, b in parts], row_ids)):
            matrix, places, bounds = np.full(row_ids, end, dtype=width), np.zeros(row_ids, dtype=width), [0]
            for k, _, a, b in (parts[i] for i in items):
                to = bounds[-1] + b - a
                matrix[bounds[-1] : to] = window[k][2][a:b]
                places[bounds[-1] : to] = np.arange(b - a)
                bounds.append(to)
            chosen = [parts[i] for i in items]
            out.append(
                {
                    "row_id": first_row + n, "n_ids": bounds[-1], "ids": matrix.tobytes(), "cu_seqlens": bounds,
                    "positions": places.tobytes(), "doc_ids": [window[k][0] for k, *_ in chosen],
                    "occurrences": [window[k][1] for k, *_ in chosen], "parts": [p for _, p, *_ in chosen],
                }
            )
        return out

    def run(batches):
        encoding, end = ranks_encoding(ranks, pattern)
        width = np.dtype("<u2") if max(end, row_ids) < 1 << 16 else np.dtype("<u4")
        schema = pa.schema([
            ("row_id", pa.int64()), ("n_ids", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
            ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("occurrences", pa.list_(pa.int64())),
            ("parts", pa.list_(pa.int32())),
        ])
        base = TaskContext.get().partitionId() << 36
        window, held, row, seen = [], 0, base, base
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    window.append((doc, seen, np.array([*(encoding.encode_ordinary(text) if text else ()), end], dtype=width)))
                    held, seen = held + len(window[-1][2]), seen + 1
                    if held >= window_ids:
                        out = rows_of(window, end, width, row)
                        row, window, held = row + len(out), [], 0
                        yield from pa.Table.from_pylist(out, schema).to_batches(1024)
        if window:
            yield from pa.Table.from_pylist(rows_of(window, end, width, row), schema).to_batches(1024)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def write_packed(rows: DataFrame, path: str) -> None:
    """Binary id and position matrices with their segment tables, as Parquet."""
    rows.write.mode("errorifexists").parquet(path)


def unpack(rows: DataFrame, row_ids: int = ROW_IDS) -> DataFrame:
    """Every document occurrence with its ids, as hex of the fixed-width matrix, end id included."""
    width = F.octet_length("ids") / F.lit(row_ids)
    segments = rows.select(
        "ids", width.cast("int").alias("_w"), "cu_seqlens",
        F.posexplode(F.arrays_zip("doc_ids", "occurrences", "parts")).alias("_k", "_s"),
    )
    start, stop = F.get("cu_seqlens", F.col("_k")), F.get("cu_seqlens", F.col("_k") + 1)
    cut = F.hex(F.col("ids").substr(start * F.col("_w") + 1, (stop - start) * F.col("_w")))
    pieces = segments.select(
        F.col("_s.doc_ids").alias("doc_id"), F.col("_s.occurrences").alias("occurrence"), F.struct(F.col("_s.parts").alias("part"), cut.alias("hex")).alias("p")
    )
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["hex"]), "")
    return pieces.groupBy("doc_id", "occurrence").agg(whole.alias("ids_hex"))
