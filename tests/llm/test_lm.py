import math
import zlib
from collections import Counter

import numpy as np
from helpers import awkward, empty, table, words

from trailstat.llm import lm
from trailstat.llm.eliasfano import EliasFano, Level


def test_sequences_access_and_successor():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (1, 10**6), (5, 3), (1000, 500), (1000, 10**6), (5000, 10**12), (300, 64 * 300)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        e = EliasFano.of(values)
        assert (e.access(np.arange(n)) == values).all()
        asked = np.concatenate([rng.integers(0, top + 5, 500).astype(np.uint64), values, values + np.uint64(1)])
        assert (e.successor(asked) == np.searchsorted(values, asked)).all()
    assert (EliasFano.of([]).successor(np.array([0, 7])) == 0).all()


def test_trie_finds_its_pairs_and_no_others():
    rng = np.random.default_rng(1)
    n = 300
    keys = np.unique(rng.integers(0, n * n, 4000))
    codes = rng.integers(1, 60_000, len(keys)).astype(np.uint16)
    level = Level.mapped(Level.build(keys // n, keys % n, n, codes).pack())
    asked = rng.integers(0, n * n, 20_000)
    want = {k: i for i, k in enumerate(keys)}
    assert level.places(asked // n, asked % n).tolist() == [want.get(k, -1) for k in asked]
    assert level.look_up(asked // n, asked % n).tolist() == [codes[want[k]] if k in want else 0 for k in asked]
    bits = 8 * (level.keys.low.nbytes + level.keys.high.nbytes) / len(keys)
    assert bits < 14


def test_packing_of_numbers():
    rng = np.random.default_rng(2)
    for x in (np.zeros(0, np.uint64), np.zeros(3, np.uint16), rng.integers(0, 2**48, 1000).astype(np.uint64), np.array([2**32 - 1], np.uint32)):
        assert (lm._unpack(lm._pack(x)) == x).all()
        assert (lm._unpack_sorted(lm._pack_sorted(np.sort(x.astype(np.uint64)))) == np.sort(x)).all()


def test_a_stored_model_scores_as_its_own_corpus(spark):
    docs = table(spark).repartition(2)
    key = lambda r: (str(r[0]), *r[1:])
    model = lm.lm_model(docs, mu=7.0)
    assert sorted(map(key, lm.lm_scores(docs, model=model).collect())) == sorted(map(key, lm.lm_scores(docs, mu=7.0).collect()))
    # Without its pairs the model knows words alone: the scores come from the stored levels.
    text = [(900, "one two three four", None, None, None, None, None, None), (901, "never seen", None, None, None, None, None, None)]
    whole, words_only = (lm.lm_scores(table(spark, text), model=m).orderBy("doc_id").collect() for m in (model, model.filter("order = 1")))
    assert whole[0]["score"] > words_only[0]["score"] and whole[0]["base_score"] == words_only[0]["base_score"]
    assert whole[1]["n_known"] == 1
    assert lm.lm_scores(table(spark, text), model=lm.lm_model(empty(spark))).count() == 2


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 3000)
    rows = awkward()
    got = lm.lm_scores(table(spark).repartition(3), mu=7.0).collect()
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    tokens = [[*words(r[1]), None] for r in rows]
    one, two = Counter(), Counter()
    for h, t in zip(held, tokens):
        if not h:
            one.update(t)
            two.update(zip(t, t[1:]))
    n, v = sum(one.values()), len(one)
    base = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    want = []
    for r, h, t in zip(rows, held, tokens):
        model = math.log10(base(t[0])) + sum(math.log10((two[a, b] + 7.0 * base(b)) / (one[a] + 7.0)) for a, b in zip(t, t[1:]))
        want.append((str(r[0]), h, len(t), sum(one[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), model))
    key = lambda x: (x[0], x[2], x[5])
    for a, b in zip(sorted(map(tuple, ((str(r[0]), *r[1:]) for r in got)), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and abs(a[6] - b[6]) <= len(words("x")) * a[2] / 2000


def test_empty_table(spark):
    assert lm.lm_scores(empty(spark)).count() == 0
