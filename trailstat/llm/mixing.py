"""Mixing sources to target weights by Pfair scheduling (Baruah et al., 1996).

Each source's documents form blocks, one a slot. When all sources with rows left are served side by side
in proportion to their weights, T(v) = sum over sources of min(weight * v, blocks) slots have passed when
one of weight w has had w * v blocks; a source that runs out leaves its slots to the others. Block i
(from 0) is released at floor(T(i / w)) and due by ceil(T((i + 1) / w)), from the exact weights as whole
numbers. Earliest-deadline-first over released blocks fills every slot and meets every deadline, so after
any number of slots a source has had its share to within less than one block. No row is dropped. The
driver computes the slots, one by one, and writes them in pieces to the shared folder.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_path, passing, place, slots, spool, stored, whole_row

#: The plan is written in pieces of so many blocks.
PLAN_BLOCKS = 1 << 18
BLOCK_ROWS = 16
#: Where no weights are given, a source weighs its number of rows to this power.
FLATTENING = 0.7

PLAN = "source string, block long, slot long, release long, deadline long, first long"


def whole_weights(weights: Mapping) -> dict:
    """The weights times one number that makes all of them whole."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    scale = math.lcm(*{w.denominator for w in exact.values()})
    return {s: w.numerator * (scale // w.denominator) for s, w in exact.items()}


def pfair(blocks: Mapping, weights: Mapping) -> Iterator[tuple]:
    """(source, block, release, deadline) of slots 0, 1, and so on; equal deadlines by name."""
    names = sorted((s for s, n in blocks.items() if n), key=lambda s: (s is None, s or ""))
    weight = whole_weights({s: weights[s] for s in names})
    weight, left = [weight[s] for s in names], [blocks[s] for s in names]
    # Where sources run out, in order: the sources before number k of them are done, with done[k] blocks, and the others weigh active[k].
    ends = sorted(Counter(zip(left, weight)).items(), key=lambda x: (x[0][0] / x[0][1], Fraction(*x[0])))
    near = [n / w for (n, w), _ in ends]
    done, active = [0], [sum(weight)]
    for (n, w), many in ends:
        done.append(done[-1] + n * many)
        active.append(active[-1] - w * many)

    def passed(i: int, w: int) -> int:
        """w * T(i / w)"""
        k = bisect_right(near, i / w)
        while k and ends[k - 1][0][0] * w > i * ends[k - 1][0][1]:
            k -= 1
        return done[k] * w + i * active[k]

    waiting = [(0, k, 0) for k in range(len(names))]
    ready = []
    for t in range(sum(left)):
        while waiting and waiting[0][0] <= t:
            release, k, i = heapq.heappop(waiting)
            due = passed(i + 1, weight[k])
            heapq.heappush(ready, (-(-due // weight[k]), k, i, release, due // weight[k]))
        deadline, k, i, release, following = heapq.heappop(ready)
        yield names[k], i, release, deadline
        if i + 1 < left[k]:
            heapq.heappush(waiting, (following, k, i + 1))


def mix(rows: DataFrame, counts: Mapping, weights: Mapping | None = None, block_rows: int = BLOCK_ROWS, keep=lambda plan: plan) -> DataFrame:
    """``rows`` have source and source_row (place in the source); adds block, slot, release, deadline and position.

    release and deadline: the slots between which the block's weight wants it.
    """
    spark = rows.sparkSession
    plan = keep(_written(spark, _placed(counts, weights or {s: n**FLATTENING for s, n in counts.items()}, block_rows)))
    at = (F.col("r.source").eqNullSafe(F.col("p.source"))) & (F.col("r.block") == F.col("p.block"))
    joined = rows.withColumn("block", F.expr(f"source_row div {block_rows}")).alias("r").join(plan.alias("p"), at)
    return joined.select("r.*", "p.slot", "p.release", "p.deadline", (F.col("p.first") + F.expr(f"r.source_row % {block_rows}")).alias("position"))


def _placed(counts: Mapping, weights: Mapping, block_rows: int) -> Iterator[tuple]:
    """Rows of PLAN; first is the position of the block's first row."""
    first = 0
    for slot, (s, block, release, deadline) in enumerate(pfair({s: -(-n // block_rows) for s, n in counts.items()}, weights)):
        yield s, block, slot, release, deadline, first
        first += min(block_rows, counts[s] - block * block_rows)


def _written(spark: SparkSession, plan: Iterator[tuple]) -> DataFrame:
    path, kinds = new_path(spark, "mix-plan"), [pa.string()] + [pa.int64()] * 5
    names = [c.split()[0] for c in PLAN.split(", ")]
    empty = spark.createDataFrame([], PLAN)
    empty.write.parquet(path)
    while piece := list(islice(plan, PLAN_BLOCKS)):
        columns = [pa.array(c, kind) for c, kind in zip(zip(*piece), kinds)]
        spark.createDataFrame(pa.table(columns, names=names)).write.mode("append").parquet(path)
    return spark.read.schema(PLAN).parquet(path)


def _counts(rows: DataFrame) -> dict:
    found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).toArrow()
    return dict(zip(found["source"].to_pylist(), found["n"].to_pylist()))


def mix_positions(docs: DataFrame, weights: Mapping | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, source, source_row, block, slot, release, deadline, position.

    ``weights``: target weight by source; a source of the table without one is an error. Within a
    source documents come in the order of a hash of their id, so blocks are fair samples; equal ids
    come in the order of files and rows. A null source is a source of its own; texts (null, empty, very
    long) aren't read; an empty table gives no rows; other columns are ignored.
    """
    docs = stored(docs, ["doc_id", "source"], "mix-docs")
    with passing(docs.sparkSession) as keep:
        rows = _mixed(docs, weights, block_rows, keep)
    return rows.select("doc_id", "source", "source_row", "block", "slot", "release", "deadline", "position")


def _mixed(docs: DataFrame, weights: Mapping | None, block_rows: int, keep) -> DataFrame:
    """As ``mix_positions``, with file and row; the tables that the result reads are given to ``keep``."""
    file, row = place(docs)
    doc_id = F.col("doc_id").cast("long")
    narrow = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(doc_id).alias("h"), file.alias("file"), row.alias("row"))
    narrow = spool(narrow, "mix")
    counts = _counts(narrow)
    if weights and (missing := set(counts) - set(weights)):
        raise ValueError(f"no weight for {sorted(map(str, missing))}")
    ranked = slots(narrow, ["source"], ["h", "doc_id", "file", "row"], "source_row", "mix-slots", keep)
    return mix(ranked, counts, weights, block_rows, keep)


def mixed_documents(docs: DataFrame, weights: Mapping | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of ``docs`` as they came, whatever their columns are called, in mixed order: partitions, and rows within them, follow the position."""
    spark = docs.sparkSession
    docs = stored(docs, docs.columns, "mix-docs")
    with passing(spark) as keep:
        places = _mixed(docs, weights, block_rows, keep).select(F.col("file").alias("_file"), F.col("row").alias("_at"), F.col("position").alias("_position"))
    file, row = place(docs)
    whole = docs.select(whole_row(docs).alias("_row"), file.alias("_file"), row.alias("_at")).join(places, ["_file", "_at"])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return whole.repartitionByRange(n, "_position").sortWithinPartitions("_position").select("_row.*")


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_positions(documents(spark, sf_dir))
