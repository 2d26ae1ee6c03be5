"""Benchmark passages in documents, found in a latent space and confirmed word by word.

Fit. Passages of ``PASSAGE`` words of all documents are rows of a TF-IDF matrix A over hashed words. One pass gives the
document frequencies and the sketch A'A X for a random X; with the frequencies known afterwards, a Nystrom step turns it
into the leading singular vectors, which are then centred and whitened over the corpus. The rest of the row, mostly rare
words, is kept as a random projection: the singular vectors alone can't tell passages of one topic apart. A task sends
its sums once; sums are added in two levels and have a fixed size.

Search. Windows of ``WINDOW`` words, at every word of a document and of each benchmark item, are projected; every pair with
a cosine of ``COSINE`` or more is a candidate. Only places where the check could succeed are projected: it needs
``PARAPHRASE`` of the item, so of any larger share of the item's words (the rarest are taken) a known number must stand
in the run of words that is checked. Nothing that the cosine and the check accept is left out by that.

Check. The longest common subsequence of the item and the words around the window must hold ``COMMON`` of the item, or
``PARAPHRASE`` of it and the item's whole answer (its last sentence, or last third) in order.

The benchmark is the stated query set; it is taken in blocks of ``BLOCK_ITEMS`` items. Defined results: null and empty
texts match nothing, nor do items without id or text; repeated rows match alike; of the matches of one item the one with
most in common counts, of equal ones the first; extra columns pass through (one called like an output column is replaced).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.words import U64, hashed_words, mix, text_bytes, word_slices

TERMS = 1 << 14
RANK, SKETCH, REST = 16, 32, 24
PASSAGE = 64
WINDOW = 7
COSINE = 0.75
COMMON, PARAPHRASE = 0.8, 0.5
BLOCK_ITEMS = 20_000
ROWS_BLOCK = 256
GROUP_ITEMS = 1_000  # items that are looked up together
STRETCH, RANGE = 2_048, 1 << 18  # words that are projected, and looked up, at a time
MATCH = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("common", T.DoubleType()), T.StructField("answer", T.BooleanType()),
    T.StructField("cosine", T.DoubleType()), T.StructField("word", T.LongType()),
])


def _test_matrix() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((TERMS, SKETCH)).astype(np.float32)


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> U64(64 - 14)).astype(np.int64)


def sketch_sums(docs: DataFrame) -> DataFrame:
    """(block, sums): per block of terms its sketch rows and, last, its passage frequencies, summed over all documents."""

    def run(batches):
        test, sums, passages = _test_matrix(), np.zeros((TERMS, SKETCH + 1)), 0
        for batch in batches:
            for _, _, hashes, at in word_slices(batch.column("text")):
                if not len(hashes):
                    continue
                sizes = np.diff(at)
                inside = np.arange(len(hashes)) - np.repeat(at[:-1], sizes)
                first = inside % PASSAGE == 0
                passage = np.cumsum(first) - 1
                pair, times = np.unique(passage * TERMS + _terms(hashes), return_counts=True)
                row, term, times = pair // TERMS, pair % TERMS, times.astype(np.float32)[:, None]
                latent = np.add.reduceat(test[term] * times, np.flatnonzero(np.diff(row, prepend=-1)), axis=0)
                order = np.argsort(term.astype(np.uint16), kind="stable")
                row, term, times = row[order], term[order], times[order]
                begin = np.flatnonzero(np.diff(term, prepend=-1))
                sums[term[begin], :SKETCH] += np.add.reduceat(latent[row] * times, begin, axis=0)
                sums[term[begin], SKETCH] += np.diff(np.append(begin, len(term)))
                passages += int(first.sum())
        if passages:
            blocks = range(0, TERMS, ROWS_BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*(b // ROWS_BLOCK for b in blocks), -1], pa.int32()),
                 pa.array([*(sums[b : b + ROWS_BLOCK].tobytes() for b in blocks), np.array([float(passages)]).tobytes()], pa.binary())],
                ["block", "sums"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = None
        for value in table.column("sums"):
            part = np.frombuffer(value.as_py())
            total = part if total is None else total + part
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    def add_part(key, table):
        return add(table)

    schema = "block int, sums binary"
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema).withColumn("salt", F.spark_partition_id() % 64)
    first = parts.groupBy("block", "salt").applyInArrow(add_part, schema)
    return first.groupBy("block").applyInArrow(add_part, schema)


def fit(docs: DataFrame) -> np.ndarray:
    """The projection of a term count vector to the scaled latent space, TERMS x (RANK + REST)."""
    sums = {r["block"]: np.frombuffer(r["sums"]) for r in sketch_sums(docs).collect()}  # a fixed number of rows of fixed size
    if not sums:
        return np.zeros((TERMS, RANK + REST), dtype=np.float32)
    whole = np.concatenate([sums[b].reshape(-1, SKETCH + 1) for b in range(TERMS // ROWS_BLOCK)])
    passages, frequency = float(sums[-1][0]), whole[:, SKETCH]
    inverse = np.log((passages + 1) / (frequency + 1)) + 1e-3
    core = _test_matrix().astype(np.float64).T @ whole[:, :SKETCH]
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    values = np.maximum(values, values.max() * 1e-9)
    image = inverse[:, None] * whole[:, :SKETCH]
    left, strength, _ = np.linalg.svd(image @ (vectors / np.sqrt(values)), full_matrices=False)
    rows = inverse[:, None] * left[:, :RANK] / np.maximum(strength[:RANK], strength[0] * 1e-6)
    # Centre and whiten over the corpus, so that common words and the strongest topics don't decide a cosine.
    share = frequency / frequency.sum()
    rows = rows - share @ rows
    spread, axes = np.linalg.eigh((rows * share[:, None]).T @ rows)
    rows = rows @ (axes / np.sqrt(np.maximum(spread, spread.max() * 1e-12)))
    # What the singular vectors leave out is mostly rare words: a random projection of it makes up the other coordinates.
    rest = np.random.default_rng(21).standard_normal((TERMS, REST)) * inverse[:, None]
    rest -= left[:, :RANK] @ (left[:, :RANK].T @ rest)
    rest *= np.sqrt(3 * RANK / (share @ (rest**2).sum(axis=1)))
    return np.hstack([rows, rest]).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _windows(latent: np.ndarray, width: int) -> np.ndarray:
    """Unit sums over each run of ``width`` rows."""
    n = len(latent) - width + 1
    sums = latent[:n].copy()
    for k in range(1, width):
        sums += latent[k : k + n]
    return _unit(sums)


def common_words(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, 64 or more item words at a time in one integer."""
    masks: dict[int, int] = {}
    for k, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for word in words:
        match = row & masks.get(word, 0)
        row = ((row + match) | (row - match)) & full
    return len(item) - row.bit_count()


class Anchors:
    """The items, of a few of them, that hold each of their rarer words."""

    def __init__(self, items: list[int], words: list[np.ndarray]):
        word = np.concatenate(words)
        item = np.repeat(np.array(items, dtype=np.int64), [len(w) for w in words])
        order = np.argsort(word, kind="stable")
        self.items = item[order]
        self.keys, self.begin, self.times = np.unique(word[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.keys >> U64(44)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (item, place of one of its words), in order."""
        at = np.flatnonzero(self.maybe[hashes >> U64(44)])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        own = self.keys[key] == hashes[at]
        at, key = at[own], key[own]
        times = self.times[key]
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        both = np.sort(self.items[np.repeat(self.begin[key], times) + nth] << 32 | np.repeat(at, times))
        return both >> 32, both & 0xFFFFFFFF


class Items:
    """A block of benchmark items as windows in the latent space."""

    def __init__(self, ids: list[int], texts: list[str], projection: np.ndarray):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        hashes, at = hashed_words(data, offsets)
        self.ids, self.projection = ids, projection
        self.words = [hashes[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        self.widths = np.minimum(np.diff(at), WINDOW)
        self.slack = np.maximum(4, np.diff(at) // 4)
        self.reach = np.diff(at) + 2 * self.slack
        own = [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.rows = [_windows(projection[_terms(w)], int(n)) if n else None for w, n in zip(own, self.widths, strict=True)]
        self.sought = [np.unique(w) for w in own]
        self.vocabulary = np.unique(hashes)
        self.numbers = [np.searchsorted(self.vocabulary, w) for w in own]
        self.seen, self.slices = np.zeros(len(self.vocabulary), dtype=np.int64), 0
        self.answers = [self._answer(text, words) for text, words in zip(texts, self.words, strict=True)]

    @staticmethod
    def _answer(text: str, words: list[int]) -> list[int]:
        last = text.strip().rstrip(".!?").replace("?", ".").replace("!", ".").rpartition(".")[2].encode().split()
        n = len(last) if 3 <= len(last) <= len(words) // 2 else max(1, len(words) // 3)
        return words[-n:]

    def _choose(self, hashes: np.ndarray) -> None:
        """Take the words for the look-up that are rare in the texts so far; any choice finds the same."""
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        self.seen += np.bincount(place[self.vocabulary[place] == hashes], minlength=len(self.vocabulary))
        self.slices += 1
        if self.slices & (self.slices - 1):
            return
        self.hits = np.ones(len(self.words), dtype=np.int64)
        anchors = []
        for k, numbers in enumerate(self.numbers):
            # At most n - least words of a confirmed item are missing, so of ``hits`` words more than that ``hits`` are there.
            n, least = len(numbers), math.ceil(PARAPHRASE * len(numbers))
            self.hits[k] = max(1, min(least, n // 4))
            rarest = np.argsort(self.seen[numbers], kind="stable")[: n - least + int(self.hits[k])]
            anchors.append(self.vocabulary[np.unique(numbers[rarest])])
        filled = [k for k, words in enumerate(self.words) if words]
        parts = [filled[k : k + GROUP_ITEMS] for k in range(0, len(filled), GROUP_ITEMS)]
        self.groups = [Anchors(part, [anchors[k] for k in part]) for part in parts]

    def search(self, hashes: np.ndarray, at: np.ndarray) -> list[dict[int, dict]]:
        """Confirmed items of each text."""
        found: list[dict[int, dict]] = [{} for _ in range(len(at) - 1)]
        if not len(hashes) or not len(self.vocabulary):
            return found
        self._choose(hashes)
        most = int(self.reach.max(initial=0))
        for first in range(0, len(hashes), RANGE):
            for group in self.groups:
                for item, text, low, high in self._stretches(group, hashes[first : first + RANGE + most], first, at):
                    self._compare(hashes, int(at[text]), int(at[text + 1]), low, high, item, found[text])
        return found

    def _stretches(self, group: Anchors, hashes: np.ndarray, first: int, at: np.ndarray):
        """(item, text, first word, end) of all stretches with a run of words that may hold enough of an item."""
        item, place = group.places(hashes)
        last = np.arange(len(item)) + self.hits[item] - 1
        some = np.flatnonzero(last < len(item))
        last = last[some]
        some, last = (x[(item[last] == item[some]) & (place[last] - place[some] < self.reach[item[some]])] for x in (some, last))
        item, begin, end = item[some], place[some] + first, place[last] + first
        text = np.searchsorted(at, begin, side="right") - 1
        one = end < at[text + 1]
        item, begin, end, text = item[one], begin[one], end[one], text[one]
        low = np.maximum(at[text], end - self.reach[item] + 1)
        high = np.minimum(at[text + 1], begin + self.reach[item])
        held = None
        for now in zip(item.tolist(), text.tolist(), low.tolist(), high.tolist(), strict=True):
            if held and now[:2] == held[:2] and now[2] <= held[3] and now[3] - held[2] <= STRETCH:
                held = (*held[:3], max(held[3], now[3]))
                continue
            if held:
                yield held
            held = now
        if held:
            yield held

    def _compare(self, hashes: np.ndarray, begin: int, end: int, low: int, high: int, item: int, found: dict[int, dict]) -> None:
        """Put the best match of an item in a stretch of a text into ``found``."""
        width = int(self.widths[item])
        if high - low < width:
            return
        # No more words can be common to a run and the item than words of the run are in the item: cheaper to know.
        sought, words = self.sought[item], hashes[low:high]
        own = sought[np.minimum(np.searchsorted(sought, words), len(sought) - 1)] == words
        before = np.concatenate([[0], np.cumsum(own)])
        reach, least = int(self.reach[item]), math.ceil(PARAPHRASE * len(self.words[item]))
        if (before[-1] if high - low <= reach else (before[reach:] - before[:-reach]).max()) < least:
            return
        cosine = _windows(self.projection[_terms(words)], width) @ self.rows[item].T
        word, place = np.nonzero(cosine >= COSINE)
        shifts: dict[int, float] = {}
        for shift, value in zip((low + word - place).tolist(), cosine[word, place].tolist(), strict=True):
            shifts[shift] = max(value, shifts.get(shift, -1.0))
        for shift in sorted(shifts):
            a = shift - int(self.slack[item]) - low
            if before[min(high - low, a + reach)] - before[max(0, a)] < least and a >= 0 and a + reach <= high - low:
                continue
            match = self._confirm(hashes, begin, end, shift, item)
            if match and (item not in found or match["common"] > found[item]["common"]):
                found[item] = match | {"cosine": shifts[shift]}

    def _confirm(self, hashes: np.ndarray, low: int, high: int, shift: int, item: int) -> dict | None:
        own = self.words[item]
        slack = int(self.slack[item])
        a, b = max(low, shift - slack), min(high, shift + len(own) + slack)
        around = hashes[a:b].tolist()
        share = common_words(own, around) / len(own)
        answer = self.answers[item]
        given = common_words(answer, around) == len(answer)
        if share >= COMMON or (share >= PARAPHRASE and given):
            return {"item_id": self.ids[item], "common": share, "answer": given, "word": a - low}
        return None


def find_leaks(docs: DataFrame, benchmark: DataFrame, projection: np.ndarray | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Add ``matches`` and ``contaminated`` to every document."""
    projection = fit(docs) if projection is None else projection
    queries = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and length(trim(text)) > 0")
    kept = docs.drop("matches", "contaminated")
    names = kept.columns
    found = kept.withColumn("matches", F.lit(None).cast(T.ArrayType(MATCH)))
    last = None
    while True:  # one pass over the documents for each block of the query set
        rest = queries if last is None else queries.where(
            (F.col("item_id") > last[0]) | ((F.col("item_id") == last[0]) & (F.col("text") > last[1]))
        )
        block = [tuple(r) for r in rest.orderBy("item_id", "text").limit(block_items).collect()]
        if not block:
            break
        found = _search(found, names, block, projection)
        last = block[-1]
    matches = F.coalesce("matches", F.array().cast(T.ArrayType(MATCH)))
    return found.select(*names, matches.alias("matches"), (F.size(matches) > 0).alias("contaminated"))


def _search(docs: DataFrame, names: list[str], block: list[tuple], projection: np.ndarray) -> DataFrame:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("common", pa.float64()), ("answer", pa.bool_()), ("cosine", pa.float64()), ("word", pa.int64())]))

    def run(batches):
        items = Items([i for i, _ in block], [t for _, t in block], projection)
        for batch in batches:
            for first, last, hashes, at in word_slices(batch.column("text")):
                part = batch.slice(first, last - first)
                new = [list(x.values()) for x in items.search(hashes, at)]
                old = part.column("matches").to_pylist()
                both = [(a or []) + b for a, b in zip(old, new, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(both, kind)], [*names, "matches"])

    return docs.mapInArrow(run, docs.schema)
