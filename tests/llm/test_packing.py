import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, empty, table

from trailstat.llm import packing as p
from trailstat.llm.textkit import pieces

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PARTS = ["a", "b", "é", " ", "  ", "\n", "\t", " ", " ", " ", "　", "'s", "'ll", "1", "23", "!", "—", "日本", "\x1c", "\x85", " the", "Z", "\r\n", "😀", "<|endoftext|>", "\x00"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_equal_the_tokenizer(reference):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(1500)] + [r[1] for r in awkward()]
    encoder, at = p.Encoder(), 0
    for _, data, offsets in pieces(iter([pa.record_batch([pa.array(texts)], names=["text"])]), max_bytes=2000):
        ids, begin = encoder.batch(data, offsets)
        for a, b in zip(begin, begin[1:]):
            assert ids[a:b].tolist() == reference(texts[at]), repr(texts[at])
            at += 1
    assert at == len(texts)


def test_the_string_of_a_special_token():
    def ids(encoder, text):
        data = np.frombuffer(text.encode(), np.uint8)
        return encoder.batch(data, np.array([0, len(data)]))[0].tolist()

    assert ids(p.Encoder(), "a<|endoftext|>b") == [64, 50256, 65, 1]
    assert ids(p.Encoder(), "a <|endoftext|> b") == [64, 220, 50256, 275, 1]
    assert 50256 not in ids(p.Encoder(special={}), "a <|endoftext|> b")


def check_packing(rows, window):
    for _, group in _by(rows, "sequence_id").items():
        group.sort(key=lambda r: r["offset"])
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= window


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_pieces_round_trip(spark, reference):
    rows = [r.asDict() for r in p.pack_documents(table(spark), window=256, unit=4).collect()]
    check_packing(rows, 256)
    want = Counter()
    for r in awkward():
        ids = np.array(reference(r[1]), "<u4")
        for a in range(0, len(ids), 256):
            want[(r[0], a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    assert set(_by(rows, "sequence_id")) == set(range(len(_by(rows, "sequence_id"))))


@pytest.mark.parametrize("seed,n", [(0, 0), (1, 1), (2, 50), (3, 5000), (4, 80_000)])
def test_plan_places_all_pieces_with_little_padding(seed, n):
    rng = np.random.default_rng(seed)
    histogram = np.bincount(np.minimum(63, rng.gamma(1.2, 20, n).astype(int)) + 1, minlength=65)
    found = p.plan(histogram, 64)
    used = np.zeros(65, int)
    for need, repeats in found:
        assert repeats > 0 and sum(k * m for k, m in need.items()) <= 64
        for k, m in need.items():
            used[k] += repeats * m
    assert (used == histogram).all()
    if n >= 5000:
        units = int((np.arange(65) * histogram).sum())
        assert units / 64 / sum(r for _, r in found) > 0.98


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(5)
    columns = np.array([sorted(rng.choice(12, rng.integers(1, 4), replace=False)) + [-1] * 0 for _ in range(0)] or [[i, j, k] for i in range(12) for j in range(i, 12) for k in range(j, 12) if (i + j + k) % 7 == 0])
    a = np.zeros((12, len(columns)))
    for j, c in enumerate(columns):
        for i in c:
            a[i, j] += 1
    target = rng.random(12)
    x = p.nnls(columns, target)
    gradient = a.T @ (target - a @ x)
    assert (x >= 0).all() and gradient.max() < 1e-6 and np.abs(gradient[x > 0]).max() < 1e-6


def test_empty_table(spark):
    assert p.pack_documents(empty(spark)).count() == 0
