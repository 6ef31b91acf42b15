"""Packing token sequences by non-negative least squares over shallow length combinations (Krell et al., 2021).

Documents become token ids and are cut into pieces of at most a window. Piece lengths are counted in
bins of UNIT tokens; every combination of up to three bins that fills the window exactly is
enumerated, repeat counts are solved against the histogram by non-negative least squares and rounded,
and what is left over is packed greedily, longest first. Only the histogram reaches the driver.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import documents, passing, place, slots, spool, stored
from .textkit import pieces, segment_hashes

WINDOW = 2048
UNIT = 8
END = 1


class Encoder:
    """Byte-level BPE ids of many texts; each distinct chunk of a batch is encoded once.

    A chunk starts at a lone ASCII space between characters that are surely no white space: the
    vocabulary's splitting pattern always cuts there, and no special token holds a space, so a text's
    ids are those of its chunks. The vocabulary comes as ranks, its special tokens from the JSON file: the
    string of a special token gets that token's id. ``special`` takes other ones (or none).
    """

    def __init__(self, ranks_path: str | None = None, special: Mapping[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        if special is None:
            with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
                special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))
        self.encode = lambda text: own.encode(text, allowed_special="all") if any(x in text for x in special) else own.encode_ordinary(text)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by END, and where each text's begin."""
        n = len(offsets) - 1
        starts = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        names = segment_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        _, where, which = np.unique(names, return_index=True, return_inverse=True)
        raw = data.tobytes()
        ids = [self.encode(raw[a:b].decode()) for a, b in zip(starts[where].tolist(), ends[where].tolist())]
        ids.append([END])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        known = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        places = np.cumsum(sizes) - sizes
        which = np.insert(which, np.searchsorted(starts, offsets[1:]), len(ids) - 1)
        lengths = sizes[which]
        first = np.cumsum(lengths) - lengths
        flat = known[np.repeat(places[which] - first, lengths) + np.arange(lengths.sum())]
        ends_at = (first + lengths)[which == len(ids) - 1]
        return flat, np.concatenate([[0], ends_at]) if n else np.zeros(1, np.int64)


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where chunks begin: every non-empty text's first byte, and safe spaces."""
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    if len(data) < 3:
        return edge
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    before, after = data[at - 1], data[at + 1]
    # A character of several bytes that may be white space starts with C2, E1, E2 or E3.
    wide = lambda b: (b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3))
    safe = (before > 0x20) & (after > 0x20) & ~wide(after)
    safe &= (before < 0x80) | ~(wide(data[np.maximum(at - 2, 0)]) | wide(data[np.maximum(at - 3, 0)]))
    at = at[safe]
    text = np.searchsorted(offsets, at, "right")
    inside = (at > offsets[text - 1]) & (at + 1 < offsets[text])
    return np.sort(np.concatenate([edge, at[inside]]))


_encoders: dict = {}


def _cut(ranks_path: str | None, window: int, extra: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(ranks_path, None) or Encoder(ranks_path)
        _encoders[ranks_path] = encoder
        for batch, data, offsets in pieces(batches, max_bytes=4 << 20):
            ids, begin = encoder.batch(data, offsets)
            tokens = np.diff(begin)
            n = -(-tokens // window)
            row = np.repeat(np.arange(len(n)), n)
            start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(window, tokens[row] - start)
            low = begin[row] + start
            ids = np.ascontiguousarray(ids, "<u4")
            sums = [zlib.crc32(ids[a : a + k]) for a, k in zip(low.tolist(), length.tolist())]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(tokens[row]), *[batch.column(c).take(take) for c in extra]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *extra],
            )

    return cut


def token_pieces(docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, file, row: each document's pieces of at most ``window`` ids."""
    docs = stored(docs, ["doc_id", "text"], "pack-docs")
    file, row = place(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", file.alias("file"), row.alias("row"))
    return rows.mapInArrow(_cut(ranks_path, window, ["file", "row"]), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, file string, row long")


def combinations(units: int, present: np.ndarray) -> np.ndarray:
    """All (a <= b <= c) with a + b + c = units over lengths that are present; 0 stands for no piece."""
    have = np.zeros(units + 1, bool)
    have[present] = True
    have[0] = True
    a, b = np.meshgrid(np.arange(units + 1), np.arange(units + 1), indexing="ij")
    c = units - a - b
    ok = (a <= b) & (b <= c)
    a, b, c = a[ok], b[ok], c[ok]
    ok = have[a] & have[b] & have[c]
    return np.stack([a[ok], b[ok], c[ok]], 1)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with the least |A x - target| by Lawson and Hanson's active sets.

    Column j of A counts the entries of ``columns[j]`` (places in ``target``; -1 stands for none). The
    systems of the active columns are solved by their normal equations, with a trace on the diagonal.
    """
    n, m = len(columns), len(target)
    x, active = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, np.abs(target).max(initial=0))
    padded = np.where(columns < 0, m, columns)

    def dense(chosen: np.ndarray) -> np.ndarray:
        out = np.zeros((m + 1, len(chosen)))
        np.add.at(out, (padded[chosen], np.arange(len(chosen))[:, None]), 1.0)
        return out[:m]

    rest = target.astype(float)
    for _ in range(rounds or 3 * m):
        gradient = np.append(rest, 0.0)[padded].sum(axis=1)
        gradient[active] = -np.inf
        if not n or gradient.max() <= slack:
            break
        active[int(gradient.argmax())] = True
        while True:
            chosen = np.flatnonzero(active)
            a = dense(chosen)
            gram = a.T @ a
            gram[np.diag_indices(len(chosen))] += 1e-9
            s = np.linalg.solve(gram, a.T @ target)
            low = s <= slack
            if not low.any():
                break
            old = x[chosen]
            step = np.min(old[low] / np.maximum(old[low] - s[low], 1e-300))
            old = old + step * (s - old)
            old[(old <= slack) | (low & (old <= old[low].min()))] = 0
            x[chosen] = old
            active[chosen[old <= 0]] = False
            if not active.any():
                return np.zeros(n)
        x[:] = 0
        x[chosen] = s
        rest = target - a @ s
    return x


def plan(histogram: np.ndarray, units: int) -> list[tuple[dict[int, int], int]]:
    """(bins and how many of each, repeats) so that every piece of the histogram has a place.

    ``histogram[k]``: pieces of k units, k from 1 to ``units``.
    """
    left = histogram.astype(np.int64).copy()
    out = []
    if left[units]:
        out.append(({units: 1}, int(left[units])))
        left[units] = 0
    present = np.flatnonzero(left)
    if len(present):
        combos = combinations(units, present)
        combos = combos[(combos[:, 2] < units)]
        place = np.full(units + 1, -1)
        place[present] = np.arange(len(present))
        scale = float(left.max())
        counts = np.rint(nnls(place[combos], left[present] / scale) * scale).astype(np.int64)
        for j in np.argsort(-counts, kind="stable"):
            need = {int(k): int((combos[j] == k).sum()) for k in set(combos[j]) if k}
            n = min([int(counts[j]), *(int(left[k]) // m for k, m in need.items())])
            if n > 0:
                out.append((need, n))
                for k, m in need.items():
                    left[k] -= n * m
    while left.any():
        room, need = units, {}
        while room and (fit := np.flatnonzero(left[1 : room + 1] > [need.get(k, 0) for k in range(1, room + 1)])).size:
            k = int(fit[-1]) + 1
            m = min(room // k, int(left[k]) - need.get(k, 0))
            need[k] = need.get(k, 0) + m
            room -= k * m
        n = min(int(left[k]) // m for k, m in need.items())
        out.append((need, n))
        for k, m in need.items():
            left[k] -= n * m
    return out


def _placer(found: list[tuple[dict[int, int], int]]):
    """A UDF from (bin, rank in bin) to sequence_id and place in the sequence."""
    by_bin: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for need, n in found:
        place = 0
        for k in sorted(need, reverse=True):
            by_bin.setdefault(k, []).append((used.get(k, 0), base, need[k], place))
            used[k] = used.get(k, 0) + n * need[k]
            place += need[k]
        base += n
    table = {k: np.array(v, np.int64) for k, v in by_bin.items()}

    @pandas_udf("struct<sequence_id:long,place:long>")
    def place_of(bins: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(bins), 2), np.int64)
        bins, ranks = bins.to_numpy(), ranks.to_numpy()
        for k in np.unique(bins):
            rows = np.flatnonzero(bins == k)
            steps = table[int(k)]
            step = steps[np.searchsorted(steps[:, 0], ranks[rows], "right") - 1]
            ahead = ranks[rows] - step[:, 0]
            out[rows, 0] = step[:, 1] + ahead // step[:, 2]
            out[rows, 1] = step[:, 3] + ahead % step[:, 2]
        return pd.DataFrame({"sequence_id": out[:, 0], "place": out[:, 1]})

    return place_of


def pack_documents(docs: DataFrame, window: int = WINDOW, unit: int = UNIT, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text and then END; a null or empty text is the one id END.
    Documents longer than the window are cut at its multiples, so each id lies in one piece. Pieces of
    equal length fill places in the order of files and rows. Repeated rows are packed each on its own;
    an empty table gives no rows; other columns are ignored.
    """
    units = window // unit
    if units * unit != window:
        raise ValueError("unit must divide window")
    with passing(docs.sparkSession) as keep:
        cut = spool(token_pieces(docs, window, ranks_path).withColumn("bin", F.ceil(F.col("length") / unit).cast("int")), "pack-pieces")
        histogram = np.zeros(units + 1, np.int64)
        for row in cut.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect():
            histogram[row["bin"]] = row["n"]
        place_of = _placer(plan(histogram, units))
        ranked = slots(cut, ["bin"], ["file", "row", "start"], "rank", "pack-slots", keep)
    placed = ranked.withColumn("at", place_of("bin", "rank")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.place")
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
