"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search holds scores for the positions within one piece length only, and the back pointers of the paths that still
compete. Ids are committed as soon as all of these run through one boundary. In prose that is a few words; where paths
compete for long, as in a run of one character (one path for each remainder), their pointers are held to the end of the
run. Time is linear in any text. A text, its ids and the batch it came in (about 8 MB, or one longer text) are in memory.

Model files are public vocabularies and are never trained here. A unigram model
brings its own scores. A merge-ranked model has merge ranks in their place; its
pieces then get ``-log(rank + 2)``, the log probability by Zipf's law up to a
constant. Characters outside the vocabulary become their UTF-8 byte pieces.

Defined results: null text gives null ids, an empty text gives none. A text's
own U+2581 is written as bytes and so comes back as it was. Every text decodes
to itself. Extra columns pass through; repeated rows are encoded alike; of equal
paths the one whose last piece is longest wins.
"""

from __future__ import annotations

import math
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
LETTER, NOT_LETTER = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]")
MEMO_WORDS = 1 << 19  # memory for texts already segmented; cleared when full, which changes no result
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        raw = {i: model.get_score(i) for i in plain}
        ranked = bool(raw) and all(float(s).is_integer() for s in raw.values())
        self.size = n
        self.scores = {pieces[i]: (i, -math.log(2.0 - s) if ranked else s) for i, s in raw.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.scores), default=1)
        self.worst = min((s for _, s in self.scores.values()), default=0.0) - UNKNOWN_PENALTY
        self.trie = self._tree()
        # A cut where no piece crosses is a boundary of every path: texts are cut there and repeated parts looked up.
        bare = [p.lstrip(MARK) for p in self.scores]
        marked = any(MARK in p for p in bare) or any("\n" in p for p in bare)
        mixed = any(LETTER.search(p) and NOT_LETTER.search(p) for p in bare)
        whole, by_mark = re.compile(r"(?s).+"), re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        by_kind = re.compile(rf"{MARK}*[^\W\d_]+|{MARK}*(?:(?!{MARK}|\n)[\W\d_])+|{MARK}+|\n")
        self.cuts = whole if marked else by_mark if mixed else by_kind
        by_id = [b""] * n
        for piece, (i, _) in self.scores.items():
            by_id[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            by_id[i] = bytes([b])
        self.lengths = np.array([len(x) for x in by_id], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.joined = np.frombuffer(b"".join(by_id) or b"\0", dtype=np.uint8)
        self.memo: dict[str, bytes] = {}

    def _tree(self) -> list:
        """Pieces by character: a node is [next nodes, id or -1, score]."""
        root: list = [{}, -1, 0.0]
        for piece, (i, score) in self.scores.items():
            node = root
            for c in piece:
                node = node[0].setdefault(c, [{}, -1, 0.0])
            node[1], node[2] = i, score
        return root

    def search(self, text: str, commit) -> None:
        """Best segmentation of ``text``; ``commit`` gets ids in order, as soon as they are certain.

        Scores are needed for the positions that a piece from here can reach. The back pointers form a tree. A position
        that no later piece can start from and that no path uses leaves it, and so may the one it came from; while the
        root has one child left, that child is certain and becomes the root. Each position enters and leaves once.
        """
        trie, worst, longest = self.trie, self.worst, self.longest
        none, n, root, at = -math.inf, len(text), 0, 0  # root and at: places in the lists, which begin at position ``base``
        base, width = 0, min(n, longest) + 1
        best, origin, chosen = [none] * width, [0] * width, [-1] * width
        uses, heirs = [0] * width, [0] * width  # paths that go on from a position, and the sum of the positions they go to
        best[0] = 0.0
        long = n > 2 * longest
        for start in range(n):
            # Every path to ``start`` is known: extend the best one by each piece that begins here.
            score, to, node = best[at], at, trie
            for c in text[start : start + longest]:
                node = node[0].get(c)
                if node is None:
                    break
                to += 1
                if node[1] >= 0 and (value := score + node[2]) > best[to]:
                    best[to], origin[to], chosen[to] = value, at, node[1]
            at += 1
            if score + worst > best[at]:
                best[at], origin[at], chosen[at] = score + worst, at - 1, -1
            if start + 1 + longest <= n:
                best.append(none)
                origin.append(0)
                chosen.append(-1)
                uses.append(0)
                heirs.append(0)
            if not long:
                continue
            uses[origin[at]] += 1
            heirs[origin[at]] += start + 1
            ended = at - longest  # the last position that no later piece starts from
            k = ended
            while k > root and not uses[k]:
                uses[origin[k]] -= 1
                heirs[origin[k]] -= base + k
                k = origin[k]
            certain = root
            while certain <= ended and uses[certain] == 1:
                certain = heirs[certain] - base
            if certain > root:
                self._commit(text, base, root, certain, origin, chosen, commit)
                root = certain
            if root > 4 * longest and 2 * root > len(best):
                best, chosen, uses, heirs = best[root:], chosen[root:], uses[root:], heirs[root:]
                origin = [k - root for k in origin[root:]]
                base, at, root = base + root, at - root, 0
        self._commit(text, base, root, n - base, origin, chosen, commit)

    def _commit(self, text: str, base: int, root: int, to: int, origin, chosen, commit) -> None:
        path = []
        while to > root:
            start = origin[to]
            path.append([chosen[to]] if chosen[to] >= 0 else [self.bytes[b] for b in text[base + start : base + to].encode()])
            to = start
        for ids in reversed(path):
            commit(ids)

    def part(self, text: str) -> bytes:
        ids = array("i")
        self.search(text, ids.extend)
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as 32-bit integers in native order."""
        if not text:
            return b""
        first, *rest = text.split(MARK)
        out = [self._encode(first, True)]
        own = np.array([self.bytes[b] for b in MARK.encode()], dtype=np.int32).tobytes()
        for part in rest:
            out += [own, self._encode(part, False)]
        return b"".join(out)

    def _encode(self, text: str, first: bool) -> bytes:
        marked = text.replace(" ", MARK)
        parts = self.cuts.findall(MARK + marked if first else marked)
        memo = self.memo
        try:
            return b"".join([memo[x] for x in parts])
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            out = []
            for x in parts:
                ids = memo.get(x)
                if ids is None:
                    ids = self.part(x)
                    if len(x) <= 64:
                        memo[x] = ids
                out.append(ids)
            return b"".join(out)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of consecutive id sequences, and where each text starts."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        at += np.arange(total)
        data = self.joined[at]
        bounds = np.concatenate([[0], ends])[offsets]
        filled = bounds[1:] > bounds[:-1]
        keep = np.ones(total, dtype=bool)
        keep[bounds[:-1][filled]] = False  # the dummy space in front of each text
        return data[keep], bounds - np.concatenate([[0], np.cumsum(filled)])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encoded(column: pa.Array, vocab: Vocabulary) -> pa.Array:
    texts = column.to_pylist()
    parts = [vocab.encode(t) if t else b"" for t in texts]
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    ids = pa.array(np.frombuffer(b"".join(parts), dtype=np.int32))
    missing = pa.array(np.array([t is None for t in texts], dtype=bool))
    return pa.ListArray.from_arrays(pa.array(offsets), ids, mask=missing)


def bounded(batches, column: str, most: int = 8 << 20):
    """Batches cut so that one text column holds about ``most`` bytes in each."""
    from touchline.llm.words import slices, text_bytes

    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        for first, last in slices(offsets, most):
            yield batch.slice(first, last - first)


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of each text; a column called like the new one is replaced."""
    kept = docs.drop(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        vocab = vocabulary(model)
        for batch in bounded(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, _encoded(batch.column(text), vocab)], [*batch.schema.names, ids])

    return kept.mapInArrow(run, schema)


def decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of each id sequence; null ids give null."""
    kept = docs.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            column = batch.column(ids)
            offsets = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                at = offsets[first : first + part.num_rows + 1]
                data, bounds = vocab.decode(values[at[0] - offsets[0] : at[-1] - offsets[0]], at - at[0])
                texts = pa.Array.from_buffers(
                    pa.large_string(), part.num_rows,
                    [part.column(ids).is_valid().buffers()[1] if part.column(ids).null_count else None,
                     pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
                ) if not part.column(ids).null_count else pa.array(
                    [None if not ok.as_py() else bytes(data[a:b]).decode() for ok, a, b in zip(part.column(ids).is_valid(), bounds, bounds[1:], strict=False)]
                )
                yield pa.RecordBatch.from_arrays([*part.columns, texts.cast(pa.string())], [*part.schema.names, text])

    return kept.mapInArrow(run, schema)
