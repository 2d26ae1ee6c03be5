"""Removal of long byte strings that occur anywhere else, by two-stage suffix sorting.

Dealing. Each window of ``WIDTH`` bytes belongs to the leftmost of its least ``GRAM``-byte hashes, its anchor. Equal
windows have equal anchors, so windows go to tasks by the anchor's hash and no suffix needs to meet all others. A run
of windows with one anchor hash is a segment of text; in a run of one character or a short period the hash stays while
its place moves on, and the segment ends after ``MOST_WINDOWS``. Anchors that occur once in the corpus are left behind
before any text moves. Equal segments travel once with a count. An anchor that occurs very often is dealt by a longer
string inside its windows instead, so no anchor fills a task.

Sorting. In a task the segments of several anchors form one text. Suffixes smaller than their successor are sorted
directly; the others are induced by one scan of the buckets of first bytes, each bucket as one array operation. Then
adjacent common prefixes are computed; a window with a common prefix of ``WIDTH`` bytes or more is repeated.

Defined results: null and empty texts, and texts shorter than the width, stay as they are; matches never cross
documents; a row that occurs twice counts as two documents; strings are judged on the input, not on what is left;
null ids are allowed; extra columns pass through (one called like an output column is replaced).
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.spread import runs
from touchline.llm.words import SLICE_BYTES, U64, mix, powers, signed, slices, text_bytes

WIDTH = 200
GRAM = 74
OFTEN = 20_000  # an anchor with more occurrences is dealt by a longer string
STEP = 8  # window starts that such a string serves
TASK_BYTES = 1 << 20
_PLACE = (1 << 24) - 1
MOST_WINDOWS = 127
_OFTEN = 1 << 15  # in a place: the anchor is dealt by a longer string
_MOVES = 1 << 7  # in a place: the anchor's hash occurs at several places of the segment
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
SEGMENT = "key long, segment binary, times long"
OWNER = "g1 long, g2 long, block long, n int, places array<struct<id:long,th:int,start:long>>"
RUNS = "id long, th int, runs array<struct<start:long,stop:long>>"


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    forward, back = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * forward[: len(data)], out=total[1:])
    n = max(0, len(data) - gram + 1)
    return mix((total[gram : gram + n] - total[:n]) * back[:n])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=U64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _chosen(hashes: np.ndarray, windows: int) -> np.ndarray:
    """The place of each window's anchor: the leftmost of its least hashes."""
    least = _sliding_min((hashes & ~U64(_PLACE)) | np.arange(len(hashes), dtype=U64), windows)
    return (least & U64(_PLACE)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Segments of consecutive windows with one anchor hash: (row, first start, windows, anchor - start, moves, hash).

    ``moves`` tells that the hash occurs at several places of the segment, so that its windows may repeat each other.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < width:
        return none, none, none, none, none.astype(bool), none.view(U64)
    hashes = _gram_hashes(data, gram)
    chosen = _chosen(hashes, width - gram + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(chosen)]
    valid = np.arange(len(chosen)) + width <= ends
    keys = hashes[chosen]
    fresh = valid.copy()
    fresh[1:] &= (keys[1:] != keys[:-1]) | ~valid[:-1]
    begin, at = np.flatnonzero(fresh), np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none, none.astype(bool), none.view(U64)
    # A long run goes on in a new segment every MOST_WINDOWS windows.
    since = at - begin[np.searchsorted(begin, at, side="right") - 1]
    first = at[since % MOST_WINDOWS == 0]
    follows = np.append(first[1:], len(valid))
    last = at[np.searchsorted(at, follows) - 1]
    rows = np.searchsorted(offsets, first, side="right") - 1
    return rows, first - offsets[rows], last - first + 1, chosen[first] - first, chosen[last] != chosen[first], keys[first]


def _parts(data: np.ndarray, offsets: np.ndarray, width: int):
    """(first row, bytes, row starts, start of the piece): rows in slices, a long row in overlapping pieces."""
    for first, last in slices(offsets):
        at = offsets[first : last + 1]
        if last - first > 1 or at[-1] - at[0] <= 2 * SLICE_BYTES:
            yield first, data[at[0] : at[-1]], at - at[0], 0
            continue
        for start in range(0, int(at[1] - at[0]) - width + 1, SLICE_BYTES):
            part = data[at[0] + start : min(at[1], at[0] + start + SLICE_BYTES + width - 1)]
            yield first, part, np.array([0, len(part)]), start


def anchor_rows(texts: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per segment; ``place`` holds its start, number of windows, distance to the anchor and whether that moves."""
    if width - gram + 1 > MOST_WINDOWS:
        raise ValueError(f"at most {MOST_WINDOWS} windows share an anchor: choose a longer gram")

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids, keys = batch.column("id"), batch.column("th")
            for first, part, at, base in _parts(data, offsets, width):
                rows, start, n, away, moves, hashes = anchors(part, at, width, gram)
                place = (start + base) << 16 | n << 8 | away | np.where(moves, _MOVES, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(hashes)), ids.take(pa.array(first + rows)), keys.take(pa.array(first + rows)), pa.array(place)],
                    ["h", "id", "th", "place"],
                )

    return texts.mapInArrow(run, "h long, id long, th int, place long")


def _finer(raw: bytes, start: int, stop: int, anchor: int, moves: bool, width: int, gram: int):
    """(key, first start, stop) of a segment's windows, dealt by a longer string next to their anchors."""
    if moves:
        part = np.frombuffer(raw[start : stop - 1 + width], dtype=np.uint8)
        places = (start + _chosen(_gram_hashes(part, gram), width - gram + 1)).tolist()
    else:
        places = [anchor] * (stop - start)
    out: list[list[int]] = []
    begin, core = -1, None
    for at, place in enumerate(places, start):
        block = (place - at) // STEP * STEP  # windows that start block..block+STEP-1 bytes before the anchor
        if place - block != begin:
            begin, before = place - block, core
            core = raw[begin : begin + width - STEP + 1]
            fresh = core != before
        if not fresh:
            out[-1][2] = at + 1
            continue
        fresh = False
        out.append([int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True), at, at + 1])
    return out


def _cut(batches, width: int, gram: int):
    """(batch, row, key, start, windows, bytes) of every candidate segment, often repeated anchors cut finer."""
    for batch in batches:
        texts, lists = batch.column("text"), batch.column("places")
        offsets = lists.offsets.to_numpy()
        flat = lists.values
        places, hashes = flat.field("place").to_numpy(), flat.field("h").to_numpy()
        found = []
        for row in range(batch.num_rows):
            a, b = offsets[row], offsets[row + 1]
            if a == b or not texts[row].is_valid:
                continue
            raw = texts[row].as_py().encode()
            for place, key in zip(places[a:b].tolist(), hashes[a:b].tolist(), strict=True):
                start, n, away = place >> 16, place >> 8 & 127, place & 127
                if not place & _OFTEN:
                    found.append((row, key, start, n, raw[start : start + n - 1 + width]))
                    continue
                for fine, at, to in _finer(raw, start, start + n, start + away, bool(place & _MOVES), width, gram):
                    found.append((row, fine, at, to - at, raw[at : to - 1 + width]))
        if found:
            yield batch, found


def _packed(segment: bytes) -> bytes:
    """Raw deflate: equal segments stay equal, and short ones carry no header."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    return pack.compress(segment) + pack.flush()


def _names(segments):
    """128-bit names of segments: they travel only with places and marks, a segment itself is sorted by its bytes."""
    digests = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in segments)
    both = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def segments(candidates: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Candidate segments, equal ones of a batch as one row with a count."""

    def run(batches):
        for _, found in _cut(batches, width, gram):
            times = Counter((key, segment) for _, key, _, _, segment in found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key for key, _ in times], pa.int64()), pa.array([_packed(x) for _, x in times], pa.binary()),
                 pa.array(list(times.values()), pa.int64())],
                ["key", "segment", "times"],
            )

    return candidates.mapInArrow(run, SEGMENT)


def owners(candidates: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The documents and places of each candidate segment, equal segments of a batch as one row with the batch's number.

    The number only brings places of a document together again; a batch that is dealt otherwise after a loss does no harm.
    """

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch, found in _cut(batches, width, gram):
            block += 1
            g1, g2 = _names(x[4] for x in found)
            order = np.lexsort((g2, g1))
            g1, g2 = g1[order], g2[order]
            first = np.flatnonzero(np.concatenate([[True], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])]))
            rows = pa.array([found[i][0] for i in order])
            places = pa.StructArray.from_arrays(
                [batch.column("id").take(rows), batch.column("th").take(rows), pa.array([found[i][2] for i in order], pa.int64())],
                ["id", "th", "start"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(g1[first]), pa.array(g2[first]), pa.array(np.full(len(first), block)),
                 pa.array([found[i][3] for i in order[first]], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), places)],
                ["g1", "g2", "block", "n", "places"],
            )

    return candidates.mapInArrow(run, OWNER)


def document_runs(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, th, runs): what repeated windows cover in each document of a block; a block is a batch of documents."""

    def run(batches):
        for table in runs(batches, ["block"]):
            lists = table.column("places").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            ids, keys, starts = flat.field("id").to_pylist(), flat.field("th").to_pylist(), flat.field("start").to_pylist()
            windows: dict[tuple, list] = {}
            at = 0
            for n, marks, size in zip(table.column("n").to_pylist(), table.column("marks").to_pylist(), sizes.tolist(), strict=True):
                marked = np.flatnonzero(np.unpackbits(np.frombuffer(marks, dtype=np.uint8), count=n))
                for k in range(at, at + size):
                    windows.setdefault((ids[k], keys[k]), []).append(starts[k] + marked)
                at += size
            covered = [_covered(np.concatenate(x), width) for x in windows.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in windows], pa.int64()), pa.array([k for _, k in windows], pa.int32()),
                 pa.array([[{"start": a, "stop": b} for a, b in x] for x in covered], SPANS)],
                ["id", "th", "runs"],
            )

    dealt = found.select("block", "n", "marks", "places").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, RUNS)


def two_stage_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Wanted suffixes of ``text`` (0 ends a segment, bytes are 1..256), ordered by their first ``depth`` bytes.

    A wanted suffix that is larger than its successor needs that successor wanted, too.
    """
    n = len(text)
    step = np.sign(text[1:].astype(np.int32) - text[:-1])
    # Equal neighbours take the type of the first unequal pair to their right.
    nearest = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    smaller = np.zeros(n, dtype=bool)  # smaller than its successor
    smaller[:-1] = step[np.minimum(nearest, n - 2)] > 0
    smaller |= text == 0
    raw = np.concatenate([np.maximum(text, 1) - 1, np.zeros(depth, dtype=text.dtype)]).astype(np.uint8)
    direct = np.flatnonzero(wanted & smaller)
    keys = np.lib.stride_tricks.sliding_window_view(raw, depth)[direct]
    direct = direct[np.argsort(keys.view(f"S{depth}").reshape(-1), kind="stable")]
    direct = direct[np.argsort(text[direct], kind="stable")]  # only moves segment ends in front of NUL bytes
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(258))
    induced = wanted & ~smaller
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    order = []
    for c in range(257):
        front = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        bucket = []
        while len(front):
            bucket.append(front)
            before = front - 1
            front = before[induced[before] & (text[before] == c)]
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(bucket)
        order.append(bucket)
        before = bucket - 1
        before = before[induced[before]]
        before = before[text[before] > c]
        if len(before):
            chars = text[before]
            by = np.argsort(chars, kind="stable")
            before, chars = before[by], chars[by]
            at = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
            for d, part in zip(chars[at].tolist(), np.split(before, at[1:]), strict=True):
                waiting[d].append(part)
    return np.concatenate(order)


def repeated_starts(parts: list[bytes], times: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """Per segment, which of its windows occur more than once among the segments."""
    lengths = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"\0" + b"\0".join(parts) + b"\0", dtype=np.uint8)
    begin = np.concatenate([[1], 1 + np.cumsum(lengths + 1)[:-1]])
    text = raw.astype(np.uint16) + 1
    text[0] = 0
    text[begin + lengths] = 0
    counts = lengths - width + 1
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    edge[begin] += 1
    np.add.at(edge, begin + counts, -1)
    owned = np.cumsum(edge)[:-1] > 0
    # Behind the last window, go on to the first suffix that is sorted directly: it starts the induction.
    wanted = owned.copy()
    rising = np.zeros(len(text), dtype=bool)
    step = np.sign(text[1:].astype(np.int32) - text[:-1])
    nearest = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    rising[:-1] = step[nearest] > 0
    rising |= text == 0
    following = np.minimum.accumulate(np.where(rising, np.arange(len(text)), len(text) - 1)[::-1])[::-1]
    tail = following[begin + counts - 1]
    edge[:] = 0
    np.add.at(edge, begin, 1)
    np.add.at(edge, tail + 1, -1)
    wanted |= np.cumsum(edge)[:-1] > 0
    order = two_stage_order(text, wanted, width)
    order = order[owned[order]]
    windows = np.lib.stride_tricks.sliding_window_view(raw, width)
    again = np.zeros(len(text), dtype=bool)
    for at in range(0, len(order) - 1, 1 << 15):
        some = order[at : at + (1 << 15) + 1]
        rows = windows[some]
        different = rows[1:] != rows[:-1]
        prefix = np.where(different.any(axis=1), different.argmax(axis=1), width)  # adjacent common prefixes
        same = prefix >= width
        again[some[1:][same]] = True
        again[some[:-1][same]] = True
    return [again[a : a + n] if t < 2 else np.ones(n, dtype=bool) for a, n, t in zip(begin.tolist(), counts.tolist(), times, strict=True)]


def repeated_segments(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(g1, g2, marks): for every segment with a repeated window, one bit per window."""

    def solve(batch):
        marks = repeated_starts([x[1] for x in batch], [x[2] for x in batch], width)
        found = [(x[1], np.packbits(m).tobytes()) for x, m in zip(batch, marks, strict=True) if m.any()]
        if found:
            g1, g2 = _names(x for x, _ in found)
            yield pa.RecordBatch.from_arrays([pa.array(g1), pa.array(g2), pa.array([b for _, b in found], pa.binary())], ["g1", "g2", "marks"])

    def run(batches):
        done, group, held, key = [], [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "segment", "times")]
            for k, packed, times in zip(*columns, strict=True):
                if k != key:
                    done += group
                    group, key = [], k
                    if held >= TASK_BYTES:
                        yield from solve(done)
                        done, held = [], 0
                if group and group[-1][0] == packed:
                    group[-1][2] += times
                else:
                    group.append([packed, zlib.decompress(packed, -15), times])
                    held += len(group[-1][1])
        done += group
        if done:
            yield from solve(done)

    dealt = rows.repartition("key").sortWithinPartitions("key", "segment")
    return dealt.mapInArrow(run, "g1 long, g2 long, marks binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, often: int = OFTEN) -> DataFrame:
    """Add ``spans`` (removed byte ranges), ``kept`` (the remaining bytes) and ``kept_text`` to every document.

    A cut may fall inside a character; ``kept_text`` leaves such half characters out, and is null for a null text.
    """
    kept = docs.drop("spans", "kept", "kept_text")
    names = kept.columns
    # Both joins below take this one shuffled copy of the documents, so it keeps all columns.
    keyed = kept.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_th", F.hash("text"))
    texts = keyed.select(F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("text").cast("string").alias("text"))
    rows = anchor_rows(texts, width, gram)
    moves = F.max(F.col("place").bitwiseAND(F.lit(_MOVES)))
    counted = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), moves.alias("moves")).where("c > 1 or moves > 0")
    repeated = counted.select("h", (F.col("c") > often).alias("often"))
    # Under another key the counts get an exchange of their own, which lets the join split a frequent anchor.
    other = F.col("h").bitwiseXOR(F.lit(_PLACE))
    repeated, rows = repeated.select(other.alias("_k"), "often"), rows.select("id", "th", "place", other.alias("_k"))
    place = F.col("place").bitwiseOR(F.when(F.col("often"), F.lit(_OFTEN)).otherwise(F.lit(0)).cast("long"))
    # Plain rows travel lighter than the sets they become.
    anchor = F.col("_k").bitwiseXOR(F.lit(_PLACE)).alias("h")
    some = rows.join(repeated, "_k").select("id", "th", place.alias("place"), anchor).repartition("id", "th")
    placed = some.groupBy("id", "th").agg(F.collect_set(F.struct("place", "h")).alias("places"))
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th"))
    candidates = keyed.join(placed, same)
    marked = repeated_segments(segments(candidates, width, gram), width)
    found = owners(candidates, width, gram).join(marked, ["g1", "g2"])
    by_document = document_runs(found, width).groupBy("id", "th").agg(F.flatten(F.collect_set("runs")).alias("_found"))
    joined = keyed.join(by_document, same, "left").select(*names, "_found")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([*kept.schema.fields, T.StructField("spans", span), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])
    def apply(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                spans, left, readable = [], [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("_found").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    cut = _merged(found or [])
                    spans.append([{"start": a, "stop": b} for a, b in cut])
                    bounds = [0, *(x for span in cut for x in span), len(raw)]
                    left.append(b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
                    readable.append(None if text is None else text if not cut else left[-1].decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(spans, SPANS), pa.array(left, pa.binary()), pa.array(readable, pa.string())],
                    [*names, "spans", "kept", "kept_text"],
                )

    return joined.mapInArrow(apply, schema)


def _covered(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal byte runs that windows at these places cover."""
    at = np.sort(starts)
    if not len(at):
        return []
    gap = np.flatnonzero(at[1:] > at[:-1] + width)
    return list(zip([int(at[0]), *at[gap + 1].tolist()], [*(at[gap] + width).tolist(), int(at[-1]) + width], strict=True))


def _merged(found: list[dict]) -> list[tuple[int, int]]:
    """Runs of all blocks a document was in, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["stop"]) for x in found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
