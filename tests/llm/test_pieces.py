import random
import struct
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import awkward, documents, prose

from touchline.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data):
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        start = at
        if tag & 7 == 0:
            _, at = _varint(data, at)
        elif tag & 7 == 5:
            at += 4
        elif tag & 7 == 1:
            at += 8
        else:
            size, at = _varint(data, at)
            start, at = at, at + size
        yield tag, data[start:at]


def _field(tag, body):
    out = bytearray()
    for value in ([tag, len(body)] if tag & 7 == 2 else [tag]):
        while value > 127:
            out.append(value & 127 | 128)
            value >>= 7
        out.append(value)
    return bytes(out) + body


@pytest.fixture(scope="module")
def unigram():
    """The public pieces with our scores, as a unigram model of the SentencePiece library."""
    vocab = pieces.vocabulary(MODEL)
    out = b""
    for tag, body in _fields(open(MODEL, "rb").read()):
        if tag == 10:
            inner = dict(_fields(body))
            known = vocab.scores.get(inner[10].decode())
            if known and inner.get(24, b"\x01") == b"\x01":
                body = b"".join(_field(t, struct.pack("<f", known[1]) if t == 21 else v) for t, v in _fields(body))
        if tag == 18:
            body = b"".join(_field(t, b"\x01" if t == 24 else v) for t, v in _fields(body) if t != 24) + _field(24, b"\x01")
        out += _field(tag, body)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_same_paths_as_the_library(unigram):
    vocab, rng = pieces.vocabulary(MODEL), random.Random(1)
    scores = {i: s for i, s in vocab.scores.values()}
    for k in range(200):
        text = prose(rng, rng.randint(1, 30)) if k % 3 else "".join(rng.choice("abc théñ.,\n12") for _ in range(40))
        mine = np.frombuffer(vocab.encode(text), dtype=np.int32).tolist()
        theirs = unigram.encode(text)
        if mine != theirs:  # equally good paths may differ
            assert sum(scores.get(i, 0) for i in mine) == pytest.approx(sum(scores.get(i, 0) for i in theirs), abs=1e-3)


def test_ids_are_committed_before_the_text_ends():
    vocab = pieces.vocabulary(MODEL)
    sizes = []
    vocab.search("▁the▁cat" * 500, lambda ids: sizes.append(len(ids)))
    assert len(sizes) > 500
    whole = []
    vocab.search("x" * 3000, whole.extend)
    assert b"".join(vocab.joined[vocab.starts[i] : vocab.starts[i] + vocab.lengths[i]].tobytes() for i in whole) == b"x" * 3000


@pytest.mark.parametrize("run", ["-", "=", "a", " ", "-. ", "abcdefgh"])
def test_time_of_long_runs_is_linear(unigram, run):
    vocab = pieces.Vocabulary(MODEL)
    scores = {i: s for i, s in vocab.scores.values()}
    text = run * (3000 // len(run))
    mine, theirs = np.frombuffer(vocab.encode(text), dtype=np.int32).tolist(), unigram.encode(text)
    assert sum(scores.get(i, 0) for i in mine) == pytest.approx(sum(scores.get(i, 0) for i in theirs), abs=0.05)
    begun = time.process_time()
    ids = np.frombuffer(vocab.encode(run * (200_000 // len(run))), dtype=np.int32)
    assert time.process_time() - begun < 15  # an hour if every step looked back over the run
    assert 0 < len(ids) < 200_000


def test_committed_paths_are_best_paths():
    """Against a search that keeps everything, on a small vocabulary in which paths compete for long."""
    vocab = pieces.Vocabulary(MODEL)
    rng = random.Random(7)
    vocab.scores = {p: (k, -rng.random() * 3 - 1) for k, p in enumerate(["a", "aa", "aaa", "ab", "ba", "bab", "aabaa", "b", "abaab"])}
    vocab.longest, vocab.worst, vocab.trie = 5, -20.0, None
    vocab.trie = vocab._tree()
    for _ in range(300):
        text = "".join(rng.choice("aaaab" if rng.random() < 0.9 else "c") for _ in range(rng.randint(1, 120)))
        best = [0.0] + [-1e9] * len(text)
        for t in range(1, len(text) + 1):
            best[t] = max([best[t - 1] + vocab.worst] + [
                best[s] + vocab.scores[text[s:t]][1] for s in range(max(0, t - 5), t) if text[s:t] in vocab.scores
            ])
        ids = []
        vocab.search(text, ids.extend)
        by_id = {k: s for k, s in vocab.scores.values()}
        letters = {vocab.bytes[ord(c)]: vocab.worst for c in "abc"}
        assert sum(by_id.get(i, letters.get(i, 0)) for i in ids) == pytest.approx(best[-1])


def test_every_text_comes_back(spark):
    rows = awkward(random.Random(2))
    coded = pieces.decode(pieces.encode(documents(spark, rows, extra=True), MODEL).withColumnRenamed("text", "given"), MODEL)
    got = coded.collect()
    assert len(got) == len(rows) and all(r["text"] == r["given"] for r in got)
    assert [r["ids"] for r in got if r["given"] is None] == [None, None]
    assert [r["ids"] for r in got if r["given"] == ""] == [[]]
    assert {r["kept"] for r in got} == {"own"}


def test_an_empty_table(spark):
    assert pieces.encode(documents(spark, []), MODEL).count() == 0
