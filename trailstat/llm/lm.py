"""Scores of a bigram language model of the whole corpus, read from an Elias-Fano trie that is stored by shards.

Texts are read once into blocks of tokens. Each block sends its distinct words and word pairs with
their training counts to shards by hash. A shard adds up the counts of all blocks, lays its n-grams out
as the levels of a trie (by context, then by word), stores them, and answers each block from the mapped
levels. So the model grows with the corpus, no executor holds it whole, a frequent word or context is
spread over all shards, and costs a shard one entry a block. With its answers a block scores its documents.

Smoothing (Dirichlet prior): p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU), with p(w) =
(c(w) + 0.5) / (N + 0.5 (V + 1)); the first token of a text has p(w). A pair's code is the logarithm of
c(v w) / MU, its weight against the prior, in steps of ``STEP``: with b(v) = MU / (c(v) + MU), the weight
of backing off from v, p(w | v) = b(v) (10 ** code + p(w)). A word's code is its count: base scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, remainder, spool
from .eliasfano import Level
from .textkit import Words, mix, pieces

MU = 500.0
#: Tokens of a block, and distinct words and pairs that one shard should add up.
BLOCK_TOKENS, SHARD_ENTRIES = 1 << 20, 1 << 20
#: The token that ends a text.
END = np.uint64(0x5851F42D4C957F2D)
#: Step of a pair's code, and the weight's logarithm at code 1 (0: a pair not in the model).
STEP, LEAST = 1 / 4096, -6.0
#: A name has 48 bits: those of the context, then those of the n-gram under it.
CONTEXT_BITS, KEY_BITS = 16, 32

_BLOCK = "block long, n_tokens long, doc_ids array<long>, held_out array<boolean>, lengths binary, tokens binary, vocabulary binary"
_ANSWER = "block long, shard int, order int, codes binary, tokens long, words long, shards int, mu double, level binary"
_MODEL = ["shard", "order", "tokens", "words", "shards", "mu", "level"]


def _pack(x: np.ndarray) -> bytes:
    """By byte planes, without the empty upper ones; the first two bytes are the width and the planes kept."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    kept = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([x.itemsize, kept]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:, :kept].T).tobytes())


def _unpack(x: bytes) -> np.ndarray:
    width, kept = x[0], x[1]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[2:]), np.uint8).reshape(kept, -1)
    out = np.zeros((planes.shape[1], width), np.uint8)
    out[:, :kept] = planes.T
    return out.view(f"u{width}").ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x), dtype=np.uint64)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    partition, number, held, total = TaskContext.get().partitionId(), 0, [], 0

    def block() -> pa.RecordBatch:
        ids = pa.concat_arrays([x[0] for x in held])
        out = pa.concat_arrays([x[1] for x in held])
        lengths = np.concatenate([x[2] for x in held])
        vocabulary, tokens, counts = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True, return_counts=True)
        # Frequent words get small numbers, which pack well.
        by_count = np.argsort(-counts, kind="stable")
        numbers = np.empty(len(by_count), np.uint32)
        numbers[by_count] = np.arange(len(by_count), dtype=np.uint32)
        row = [(partition << 24) | number, len(tokens), ids.to_pylist(), out.to_pylist(), _pack(lengths.astype(np.uint64)), _pack(numbers[tokens]), vocabulary[by_count].tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in _BLOCK.split(", ")])

    for batch, data, offsets in pieces(batches, max_bytes=2 << 20):
        words = Words(data, offsets)
        hashes = np.insert(words.hashes(lower=True), words.first[1:], END)
        held.append((batch.column("doc_id"), batch.column("held_out"), np.diff(words.first) + 1, hashes))
        total += len(hashes)
        if total >= BLOCK_TOKENS:
            yield block()
            held, total, number = [], 0, number + 1
    if held:
        yield block()


class _Block:
    """A block's tokens, training flags, distinct words and distinct pairs."""

    def __init__(self, row: dict):
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.tokens = _unpack(row["tokens"]).astype(np.int64)
        self.lengths = _unpack(row["lengths"]).astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.train = np.repeat(~np.array(row["held_out"], bool), self.lengths)
        self.n_words = len(self.vocabulary)
        inner = np.ones(len(self.tokens), bool)
        inner[self.ends - self.lengths] = False
        self.second_places = np.flatnonzero(inner)
        keys = self.tokens[self.second_places - 1] * self.n_words + self.tokens[self.second_places]
        pairs, self.pair_of = np.unique(keys, return_inverse=True)
        self.first, self.second = pairs // self.n_words, pairs % self.n_words

    def training_counts(self) -> list[np.ndarray]:
        """Of each word, and of each pair."""
        return [np.bincount(self.tokens[self.train], minlength=self.n_words), np.bincount(self.pair_of[self.train[self.second_places]], minlength=len(self.first))]

    def asks(self, n_shards: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Order, shard, numbers and sorted names of the n-grams that the block asks each shard for."""
        word = self.vocabulary
        pair = mix(word[self.first] * np.uint64(0x9E3779B97F4A7C15) + mix(word[self.second]))
        contexts = (mix(word) >> np.uint64(64 - CONTEXT_BITS))[self.first]
        names = [word >> np.uint64(64 - CONTEXT_BITS - KEY_BITS), (contexts << np.uint64(KEY_BITS)) | (pair >> np.uint64(64 - KEY_BITS))]
        for order, (name, whole) in enumerate(zip(names, (word, pair)), 1):
            # The lower bits too, so that a shard's number and a name tell more together than a name.
            shards = (mix(whole ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(n_shards)).astype(np.int64)
            places = np.lexsort((name, shards))
            begin = np.searchsorted(shards[places], np.arange(n_shards + 1))
            for s in np.flatnonzero(np.diff(begin)):
                mine = places[begin[s] : begin[s + 1]]
                yield order, int(s), mine, name[mine]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows, one at a time: each is a block of some megabytes."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _ask(n_shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = _Block(row)
                counts = b.training_counts()
                out = [(shard, row["block"], order, _pack_sorted(names), _pack(_small(counts[order - 1][mine]))) for order, shard, mine, names in b.asks(n_shards)]
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "block", "order", "names", "counts"])

    return ask


def _split(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and key of each name."""
    return (names >> np.uint64(KEY_BITS)).astype(np.int64), names & np.uint64((1 << KEY_BITS) - 1)


def _level(order: int, names: list[np.ndarray], counts: list[np.ndarray], mu: float) -> tuple[bytes, int, int]:
    """The level of all n-grams with a training count, packed; the sum of the counts, and how many there are."""
    distinct, which = np.unique(np.concatenate(names), return_inverse=True)
    totals = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)
    distinct, totals = distinct[totals > 0], totals[totals > 0]
    codes = _small(totals) if order == 1 else np.clip(np.rint((np.log10(totals / mu) - LEAST) / STEP), 0, 65534).astype(np.uint16) + np.uint16(1)
    return Level.build(*_split(distinct), 1 << CONTEXT_BITS, codes).pack(), int(totals.sum()), len(totals)


def _weights(codes: np.ndarray) -> np.ndarray:
    """What the codes of pairs stand for."""
    return np.where(codes > 0, 10.0 ** ((codes.astype(np.float64) - 1) * STEP + LEAST), 0.0)


def _answers(level: bytes, blocks, names: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    mapped = Level.mapped(level)
    for block, asked in zip(blocks, names):
        yield block, _pack(mapped.look_up(*_split(asked)))


def _learn(n_shards: int, mu: float, answer: bool):
    """Adds a shard's counts up to levels of the trie, stored as block -1; and answers the blocks from them."""

    def learn(asked: pd.DataFrame) -> pd.DataFrame:
        out, shard = [], int(asked["shard"].iloc[0])
        for order, group in asked.groupby("order"):
            names = [_unpack_sorted(x) for x in group["names"]]
            level, total, n = _level(order, names, [_unpack(x) for x in group["counts"]], mu)
            out.append((-1, shard, order, b"", total, n, n_shards, mu, level))
            if answer:
                out += [(block, shard, order, codes, 0, 0, 0, 0.0, None) for block, codes in _answers(level, group["block"], names)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _ANSWER.split(", ")])

    return learn


def _consult(key: tuple, asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """Answers the blocks from a stored shard."""
    levels, out = dict(zip(model["order"], model["level"])), []
    for order, group in asked.groupby("order"):
        names = [_unpack_sorted(x) for x in group["names"]]
        level = levels.get(order) or Level.build(np.zeros(0, np.int64), np.zeros(0, np.uint64), 1 << CONTEXT_BITS, np.zeros(0, np.uint16)).pack()
        out += [(block, key[0], order, codes) for block, codes in _answers(level, group["block"], names)]
    return pd.DataFrame(out, columns=["block", "shard", "order", "codes"])


def _score(n_shards: int, n_train: int, n_words: int, mu: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = _Block(row)
                codes = [np.zeros(b.n_words, np.int64), np.zeros(len(b.first), np.int64)]
                given = {(x["order"], x["shard"]): x["codes"] for x in row["answers"]}
                for order, shard, mine, _ in b.asks(n_shards):
                    codes[order - 1][mine] = _unpack(given[order, shard])
                words, pairs = codes
                base = (words + 0.5) / (n_train + 0.5 * (n_words + 1))
                smooth = mu / (words[b.first] + mu) * (_weights(pairs) + base[b.second])
                opening = b.ends - b.lengths
                model = np.empty(len(b.tokens))
                model[b.second_places] = np.log10(smooth)[b.pair_of]
                model[opening] = np.log10(base)[b.tokens[opening]]
                per = lambda x: np.add.reduceat(x, opening)
                n = len(b.lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["held_out"], pa.bool_()),
                        pa.array(b.lengths),
                        pa.array(per((words > 0)[b.tokens].astype(np.int64))),
                        pa.array(np.full(n, n_train, np.int64)),
                        pa.array(per(np.log10(base)[b.tokens])),
                        pa.array(per(model)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


def _asked(docs: DataFrame, n_shards: int | None) -> tuple[DataFrame, DataFrame, int]:
    """The blocks, what they ask for, and the number of shards."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "text")
    blocks = spool(rows.mapInArrow(_blocks, _BLOCK), "lm-blocks")
    if n_shards is None:
        tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
        n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SHARD_ENTRIES))
    asked = blocks.drop("n_tokens", "doc_ids").mapInArrow(_ask(n_shards), "shard int, block long, order int, names binary, counts binary")
    return blocks, asked, n_shards


def lm_model(docs: DataFrame, mu: float = MU) -> DataFrame:
    """The trie of a corpus as a stored table, one row for each shard and order, for ``lm_scores`` of any documents.

    Learns from the documents that ``lm_scores`` names. A table without training tokens gives an empty model.
    """
    _, asked, n_shards = _asked(docs, None)
    return spool(asked.groupBy("shard").applyInPandas(_learn(n_shards, mu, answer=False), _ANSWER).select(*_MODEL), "lm-model")


def lm_scores(docs: DataFrame, mu: float = MU, model: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (A-Z as a-z) and one end. Without a ``model`` (of ``lm_model``, whose mu then holds) it
    learns from the documents themselves, whose crc32 of the id as text is not 1 modulo 5 (a null id is
    learned from). base_score: log10 probability by words alone. score: by the bigram model, its codes exact
    to 1/8192. A null or empty text is one token; long texts count whole; repeated rows are counted and
    scored each on its own; an empty table gives no rows; other columns are ignored. N-grams are known by
    their shard and 48 bits of a hash.
    """
    if model is None:
        blocks, asked, n_shards = _asked(docs, None)
        answers = spool(asked.groupBy("shard").applyInPandas(_learn(n_shards, mu, answer=True), _ANSWER), "lm-answers")
        stored, answers = answers.filter("block = -1"), answers.filter("block >= 0")
    else:
        stored, known = model, model.agg(F.max("shards"), F.max("mu")).first()
        n_shards, mu = known[0] or 1, known[1] or mu
        blocks, asked, _ = _asked(docs, n_shards)
        answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInPandas(_consult, "block long, shard int, order int, codes binary")
    whole = stored.filter("order = 1").agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    given = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "order", "codes")).alias("answers"))
    ready = blocks.drop("n_tokens").join(given, "block")
    return ready.mapInArrow(_score(n_shards, whole["n"] or 0, whole["v"] or 0, mu), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
