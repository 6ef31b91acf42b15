import zlib

import numpy as np
import pytest
from helpers import awkward, empty, table

from trailstat.llm import langid, toxicity

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_mixture_weights_are_recovered():
    rng = np.random.default_rng(0)
    table_ = rng.dirichlet(np.full(200, 0.1), 3) + 1e-9
    table_ /= table_.sum(axis=1, keepdims=True)
    draws = np.concatenate([rng.choice(200, 7000, p=table_[0]), rng.choice(200, 3000, p=table_[2])])
    got = langid.infer(table_, draws)
    assert abs(got[0] - 0.7) < 0.03 and got[1] == 0 and abs(got[2] - 0.3) < 0.03
    assert langid.infer(table_, rng.choice(200, 3000, p=table_[1])).tolist() == [0, 1, 0]


def test_held_out_languages(spark, documents):
    got = langid.languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    fold = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in fold} == {r["doc_id"] for r in got if held(r["doc_id"])}
    assert sum(r["lang_pred"] == r["lang"] for r in fold) / len(fold) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_awkward_rows(spark):
    got = langid.languages(table(spark)).collect()
    assert len(got) == len(awkward())
    nothing = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {0, 1, 2, 11} <= nothing and 7 not in nothing
    assert langid.languages(empty(spark)).count() == 0
    unlabelled = table(spark, [(1, "some text", None, None, None, "", "", "")])
    assert [r["lang_pred"] for r in langid.languages(unlabelled).collect()] == ["und"]


def test_network_gradients(monkeypatch):
    monkeypatch.setattr(toxicity.np, "float32", np.float64)
    net = toxicity.Network(np.arange(5, dtype=np.uint64))
    rng = np.random.default_rng(1)
    n = 6
    rows, size = rng.integers(0, 6, n), rng.integers(1, 4, n)
    owner, grams = np.repeat(np.arange(n), size), rng.integers(0, toxicity.TRIGRAMS, size.sum())
    ids, labels, weights = rng.integers(0, n, (5, 3)), np.array([1.0, 0, 1]), np.array([0.5, 1, 2])
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)

    def loss():
        p, sums = net.p, np.zeros((n, toxicity.CHAR_DIM))
        np.add.at(sums, owner, p["gram"][grams])
        v = np.concatenate([p["word"][rows], sums / size[:, None]], axis=1)
        states = np.concatenate([net._states((v @ p[f"w{s}"] + p[f"c{s}"])[ids], mask, s) for s in "fb"], axis=2)
        q = toxicity._sigmoid(net._pool(states, mask)[2] @ p["out"] + p["bias"])
        return -(weights * (labels * np.log(q) + (1 - labels) * np.log(1 - q))).sum()

    g = net.gradients(rows, grams, owner, size.astype(float), ids, mask, labels, weights)
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old = v[at]
        v[at] = old + 1e-5
        high = loss()
        v[at] = old - 1e-5
        low = loss()
        v[at] = old
        assert abs((high - low) / 2e-5 - g[k][at]) < 1e-6, k


def test_every_trigram_of_a_long_word_is_read():
    rng = np.random.default_rng(3)
    for n in (63, 64, 65, 126, 127, 128, 5000):
        text = b"one " + rng.integers(0x80, 0x100, n).astype(np.uint8).tobytes() + b" two"
        got = toxicity.Inputs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        here = np.frombuffer(text, np.uint8)[4:-4].astype(np.uint64)
        grams = toxicity.mix((here[:-2] << np.uint64(16)) | (here[1:-1] << np.uint64(8)) | here[2:]) % np.uint64(toxicity.TRIGRAMS)
        assert set(grams.tolist()) <= set(got.grams.tolist())
        assert got.first.tolist() == [0, len(got.number)] and got.gram_size.max() <= 64


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        _, start, length = toxicity.windows(np.array([0, n]))
        assert set(i for a, k in zip(start, length) for i in range(a, a + k)) == set(range(n))
        assert all(b - a == toxicity.STRIDE for a, b in zip(start, start[1:]))


def test_planted_toxic_words_are_caught():
    rng = np.random.default_rng(2)
    plain, bad = [f"word{i}" for i in range(300)], ["vileone", "viletwo", "vilethree"]

    def text(toxic):
        w = [plain[i] for i in rng.integers(0, 300, rng.integers(20, 200))]
        for i in range(0, len(w), 15) if toxic else ():
            w[i] = bad[rng.integers(0, 3)] + rng.choice(["", ",", "."])
        return " ".join(w)

    labels = (rng.random(900) < 0.25).astype(int)
    texts = [text(y) for y in labels]
    model = toxicity.Model(texts[:600], labels[:600])
    data = [t.encode() for t in texts[600:]]
    found = model.score(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    assert ((found >= 0.5) == (labels[600:] == 1)).mean() > 0.95


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(13)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark), labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == held(r["doc_id"]) for r in got)
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.toxicity(table(spark), none).collect()} == {0.0}
    assert toxicity.toxicity(empty(spark), labels).count() == 0
