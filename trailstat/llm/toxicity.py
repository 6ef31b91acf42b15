"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word's input joins an embedding of the word (of a vocabulary from the training sample) with the
mean embedding of its character trigrams. A forward and a backward GRU read windows of WINDOW words
that overlap by WINDOW - STRIDE, attention pools their states, and a logistic unit scores the window.
A word of more than PIECE bytes is read as several inputs, pieces that share two bytes.
All windows of a whole text are scored; a logistic regression on their summary scores the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, remainder
from .textkit import Words, mix, pieces, segment_hashes

WINDOW, STRIDE = 32, 24
WORDS, TRIGRAMS = 4096, 4096
PIECE = 64
WORD_DIM, CHAR_DIM, HIDDEN = 12, 8, 8
#: The sample that the model is fitted on: about so many labelled documents by a hash of the id, of at
#: most so many characters each, and so many windows of each.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_WINDOWS = 4000, 20_000, 12
#: Words seen fewer times in the sample are outside the vocabulary; in training, so is this share of all words' draws.
LEAST_COUNT, DROPPED = 4, 0.2
#: One document in so many of the sample is left to the logistic regression, given so many of each kind in all.
CALIBRATION, LEAST_SPLIT = 3, 60
#: Epochs over the sample, more where they would make fewer than so many steps.
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 5, 150, 256, 0.01, 0.01
SEED = 7

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trimmed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each word without ASCII punctuation around it; a word of punctuation alone stays whole."""
    if not len(words):
        return words.start, words.end
    places = np.arange(len(words.data))
    solid = _ALNUM[words.data]
    first = np.minimum.reduceat(np.where(solid, places, len(places)), words.start)
    last = np.maximum.reduceat(np.where(solid, places, -1), words.start)
    alone = last < 0
    return np.where(alone, words.start, first), np.where(alone, words.end, last + 1)


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, first: np.ndarray, chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, hashes and first with each word of more than PIECE bytes as its pieces; all its trigrams of bytes are in one of them."""
    n = np.maximum(1, -(-(end - start - 2) // (PIECE - 2)))
    before = np.concatenate([[0], np.cumsum(n)])
    if before[-1] == len(n):
        return start, end, hashes, first
    owner = np.repeat(np.arange(len(n)), n)
    low = start[owner] + (np.arange(before[-1]) - before[owner]) * (PIECE - 2)
    high = np.minimum(low + PIECE, end[owner])
    names = hashes[owner]
    long = np.flatnonzero(n[owner] > 1)
    for at in range(0, len(long), chunk):
        some = long[at : at + chunk]
        place = low[some, None] + np.arange(PIECE)
        codes = np.where(place < high[some, None], _TRIM_CODES[data[np.minimum(place, len(data) - 1)]], np.uint64(0))
        names[some] = mix((codes * _PIECE_WEIGHTS).sum(axis=1, dtype=np.uint64))
    return low, high, names, before[first]


class Inputs:
    """Distinct words (and pieces of long ones) of a batch, their character trigrams, and each word's number among them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LOWER[data]
        words = Words(data, offsets)
        start, end = trimmed(words)
        hashes = segment_hashes(data, start, end, _TRIM_CODES) if len(start) else np.zeros(0, np.uint64)
        start, end, hashes, self.first = cut(data, start, end, hashes, words.first)
        self.names, where, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        low, size = start[where], end[where] - start[where]
        # Trigrams of the bytes with a mark before and after: as many as bytes.
        row = np.repeat(np.arange(len(low)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = low[row] + at
        here = data[place].astype(np.uint64) if len(place) else np.zeros(0, np.uint64)
        before = np.where(at > 0, data[np.maximum(place - 1, 0)], 1).astype(np.uint64) if len(place) else here
        after = np.where(at + 1 < size[row], data[np.minimum(place + 1, len(data) - 1)], 2).astype(np.uint64) if len(place) else here
        self.grams = (mix((before << np.uint64(16)) | (here << np.uint64(8)) | after) % np.uint64(TRIGRAMS)).astype(np.int64)
        self.gram_first = np.cumsum(size) - size
        self.gram_size = size


#: As for whole words; punctuation between trimmed words has to weigh nothing in a segment's sum.
_TRIM_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
_PIECE_WEIGHTS = mix(np.arange(1, PIECE + 1, dtype=np.uint64)) | np.uint64(1)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, length) of all windows of documents whose words begin at ``first``; none without words."""
    counts = np.diff(first)
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(counts)), n)
    step = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return doc, first[doc] + step, np.minimum(WINDOW, counts[doc] - step)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights, and the forward and backward passes by hand."""

    def __init__(self, vocabulary: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary
        self.p = {
            "word": normal(len(vocabulary) + 1, WORD_DIM, scale=0.1),
            "gram": normal(TRIGRAMS, CHAR_DIM, scale=0.1),
            "attend": normal(2 * HIDDEN, HIDDEN, scale=0.3),
            "query": normal(HIDDEN, scale=0.3),
            "out": normal(2 * HIDDEN, scale=0.3),
            "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.p[f"w{side}"] = normal(d, 3 * HIDDEN, scale=d**-0.5)
            self.p[f"u{side}"] = normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            self.p[f"c{side}"] = np.zeros(3 * HIDDEN, np.float32)

    def word_rows(self, names: np.ndarray) -> np.ndarray:
        """Row of each word in the embedding; 0 stands for words outside the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, names), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == names, at + 1, 0)

    def embed(self, inputs: Inputs) -> np.ndarray:
        """Input vector of each distinct word."""
        grams = np.add.reduceat(self.p["gram"][inputs.grams], inputs.gram_first, axis=0) / inputs.gram_size[:, None].astype(np.float32) if len(inputs.names) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][self.word_rows(inputs.names)], grams], axis=1).astype(np.float32)

    def _states(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """GRU states of projected inputs x (steps, windows, 3 H); padded steps pass the state on."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
        u = self.p[f"u{side}"]
        for t in range(x.shape[0]) if side == "f" else range(x.shape[0] - 1, -1, -1):
            a = h @ u
            gates = _sigmoid(x[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            new = h + m * z * (c - h)
            if keep is not None:
                keep.append((t, h, a, z, r, c))
            h = out[t] = new
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray):
        tanh = np.tanh(states @ self.p["attend"])
        score = np.where(mask > 0, tanh @ self.p["query"], -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        return tanh, weight, (weight[:, :, None] * states).sum(axis=0)

    def logits(self, inputs: Inputs, start: np.ndarray, length: np.ndarray, chunk: int = 2048) -> np.ndarray:
        vectors = self.embed(inputs)
        projected = {s: vectors @ self.p[f"w{s}"] + self.p[f"c{s}"] for s in "fb"}
        out = np.empty(len(start), np.float32)
        for at in range(0, len(start), chunk):
            ids, mask = _ids(inputs, start[at : at + chunk], length[at : at + chunk])
            states = np.concatenate([self._states(projected[s][ids], mask, s) for s in "fb"], axis=2)
            out[at : at + chunk] = self._pool(states, mask)[2] @ self.p["out"] + self.p["bias"]
        return out

    def gradients(self, rows: np.ndarray, grams: np.ndarray, gram_owner: np.ndarray, gram_size: np.ndarray, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
        """Gradients of the weighted log loss over windows ``ids`` (steps, windows) of words with embedding ``rows`` and ``grams``."""
        p, n = self.p, len(rows)
        sums = np.zeros((n, CHAR_DIM), np.float32)
        np.add.at(sums, gram_owner, p["gram"][grams])
        vectors = np.concatenate([p["word"][rows], sums / gram_size[:, None]], axis=1)
        keeps = {"f": [], "b": []}
        states = np.concatenate([self._states((vectors @ p[f"w{s}"] + p[f"c{s}"])[ids], mask, s, keeps[s]) for s in "fb"], axis=2)
        tanh, weight, pooled = self._pool(states, mask)
        error = ((_sigmoid(pooled @ p["out"] + p["bias"]) - labels) * weights).astype(np.float32)
        g = {"out": pooled.T @ error, "bias": error.sum(keepdims=True)}
        d_pooled = error[:, None] * p["out"]
        d_weight = (states * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["query"] = (tanh * d_score[:, :, None]).sum(axis=(0, 1))
        d_tanh = d_score[:, :, None] * p["query"] * (1 - tanh**2)
        g["attend"] = np.einsum("tbi,tbj->ij", states, d_tanh)
        d_states = weight[:, :, None] * d_pooled + d_tanh @ p["attend"].T
        d_vectors = np.zeros_like(vectors)
        for k, s in enumerate("fb"):
            d_x = np.zeros((*ids.shape, 3 * HIDDEN), np.float32)
            d_u = np.zeros_like(p[f"u{s}"])
            d_h = np.zeros((ids.shape[1], HIDDEN), np.float32)
            for t, h, a, z, r, c in reversed(keeps[s]):
                d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[t][:, None]
                d_c = d_h * m * z * (1 - c**2)
                d_z = d_h * m * (c - h) * z * (1 - z)
                d_r = d_c * a[:, 2 * HIDDEN :] * r * (1 - r)
                d_x[t] = np.concatenate([d_z, d_r, d_c], axis=1)
                d_a = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_u += h.T @ d_a
                d_h = d_h * (1 - m * z) + d_a @ p[f"u{s}"].T
            flat = np.zeros((n, 3 * HIDDEN), np.float32)
            np.add.at(flat, ids.ravel(), d_x.reshape(-1, 3 * HIDDEN))
            g[f"u{s}"], g[f"w{s}"], g[f"c{s}"] = d_u, vectors.T @ flat, flat.sum(axis=0)
            d_vectors += flat @ p[f"w{s}"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], rows, d_vectors[:, :WORD_DIM])
        g["gram"] = np.zeros_like(p["gram"])
        np.add.at(g["gram"], grams, (d_vectors[:, WORD_DIM:] / gram_size[:, None])[gram_owner])
        return g


def _ids(inputs: Inputs, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(WINDOW)[:, None]
    mask = steps < length
    ids = inputs.number[np.where(mask, start + steps, start)]
    return ids, mask.astype(np.float32)


def _train_network(inputs: Inputs, start: np.ndarray, length: np.ndarray, labels: np.ndarray, seed: int = SEED) -> Network:
    counts = np.bincount(inputs.number, minlength=len(inputs.names))
    top = np.argsort(-counts, kind="stable")[:WORDS]
    net = Network(np.sort(inputs.names[top[counts[top] >= LEAST_COUNT]]), seed)
    rng = np.random.default_rng(seed)
    share = np.ones(len(labels), np.float32)
    rows = net.word_rows(inputs.names)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, -(-len(start) // BATCH))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(start))
        if epoch > epochs // 4:
            # A toxic document has clean windows too: its windows count by how toxic they look so far.
            share = np.where(labels > 0, 0.02 + _sigmoid(net.logits(inputs, start, length)), 1.0)
        balance = np.where(labels > 0, share * len(labels) / (2 * max(1e-6, (share * (labels > 0)).sum())), len(labels) / (2 * max(1.0, (labels <= 0).sum())))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            ids, mask = _ids(inputs, start[chosen], length[chosen])
            used, ids = np.unique(ids, return_inverse=True)
            ids = ids.reshape(mask.shape)
            size = inputs.gram_size[used]
            owner = np.repeat(np.arange(len(used)), size)
            gram = inputs.grams[np.repeat(inputs.gram_first[used] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            drawn = np.where(rng.random(len(used)) < DROPPED, 0, rows[used])
            g = net.gradients(drawn, gram, owner, size.astype(np.float32), ids, mask, labels[chosen], balance[chosen] / len(chosen))
            step += 1
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                if k in ("word", "gram"):
                    net.p[k] *= 1 - rate * DECAY
                net.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def summary(doc: np.ndarray, logits: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document: highest and second highest window score, their mean and the share of windows above even."""
    out = np.zeros((n_docs, 4))
    if len(doc):
        score = _sigmoid(logits.astype(np.float64))
        order = np.lexsort((-score, doc))
        begin = np.searchsorted(doc, np.arange(n_docs + 1))
        n = np.diff(begin)
        has, two = n > 0, n > 1
        ranked = score[order]
        out[has, 0] = ranked[begin[:-1][has]]
        out[:, 1] = out[:, 0] ** 2
        out[two, 1] = ranked[begin[:-1][two] + 1]
        out[has, 2] = np.add.reduceat(score, begin[:-1][has]) / n[has]
        out[has, 3] = np.add.reduceat((score > 0.5).astype(float), begin[:-1][has]) / n[has]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return w


class Model:
    def __init__(self, texts: list[str], labels: np.ndarray):
        self.network = self.weights = None
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.0
            return
        data = [t.encode() for t in texts]
        buffer, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
        inputs = Inputs(buffer, offsets)
        doc, start, length = windows(inputs.first)
        rng = np.random.default_rng(SEED)
        place = np.empty(len(doc), np.int64)
        order = np.lexsort((rng.random(len(doc)), doc))
        place[order] = np.arange(len(doc)) - np.searchsorted(doc, doc)
        judged = np.arange(len(texts)) % CALIBRATION == 0
        if min(labels.sum(), (1 - labels).sum()) < LEAST_SPLIT or len(set(labels[judged].tolist())) < 2 or len(set(labels[~judged].tolist())) < 2:
            judged[:] = True
            fitted = judged
        else:
            fitted = ~judged
        chosen = np.flatnonzero((place < TRAIN_WINDOWS) & fitted[doc])
        self.network = _train_network(inputs, start[chosen], length[chosen], labels[doc[chosen]].astype(np.float32))
        mine = np.flatnonzero(judged[doc])
        found = summary(doc[mine], self.network.logits(inputs, start[mine], length[mine]), len(texts))
        self.weights = _logistic(found[judged], labels[judged])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(offsets) - 1, self.constant)
        inputs = Inputs(data, offsets)
        doc, start, length = windows(inputs.first)
        x = summary(doc, self.network.logits(inputs, start, length), len(offsets) - 1)
        return _sigmoid(x @ self.weights[:-1] + self.weights[-1])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out fold."""
    marked = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    marked = marked.filter(F.coalesce(remainder("_id", 5), F.lit(0)) != 0)
    n = marked.count()
    place = F.pmod(F.xxhash64("_id", F.lit(10)), F.lit(1 << 20)) / (1 << 20)
    marked = marked.filter(place < min(1.0, train_docs / max(1, n)))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").filter(F.length("text") <= TRAIN_CHARS).join(F.broadcast(marked), "_id")
    rows = rows.orderBy("_id", "text").limit(2 * train_docs).collect()
    return Model([r["text"] for r in rows], np.array([int(r["_toxic"] > 0) for r in rows]))


def toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    held_out: crc32 of the id as text is 0 modulo 5 (a null id isn't held out). Every text is scored
    whole; a null or empty one, or one without words, has no window and gets the score of none. Without
    labels of both kinds the score is the share of toxic labels (0 without any). Repeated rows are
    scored alike; an empty table gives no rows; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_docs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, max_bytes=2 << 20):
            found = np.clip(model.value.score(data, offsets), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op10_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
