"""Shared folder, spooled tables and distributed numbering for the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six characters that separate words and that normalised text folds into one space.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in tests a folder of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trailstat-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


#: Folders made here, and for each open ``passing`` those made in it.
_ours: set[str] = set()
_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/trailstat/{name}-{uuid.uuid4().hex}"
    _ours.add(_plain(path))
    if _open:
        _open[-1].append(path)
    return path


def _plain(path: str) -> str:
    """Without the ways of writing the root of a local path."""
    return re.sub("^(file:)?/+", "/", path).rstrip("/")


def _delete(spark: SparkSession, root: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    _ours.discard(_plain(root))


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables and folders made inside are deleted at the end, all but the tables given to the yielded function.

    Those belong to the enclosing ``passing``, if there is one. What is kept is read by the lazy result.
    """
    _open.append([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(map(_plain, relation_paths(df) or []))
        return df

    try:
        yield keep
    finally:
        for path in _open.pop():
            if _plain(path) not in kept:
                _delete(spark, path)
            elif _open:
                _open[-1].append(path)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a spooled table that nothing reads any more; other tables stay."""
    for root in relation_paths(df) or []:
        if _plain(root) in _ours:
            _delete(df.sparkSession, root)


def relation_paths(df: DataFrame) -> list[str] | None:
    """Root paths when ``df`` is a bare Parquet read with no operation on top, else None."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return None
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return None
    paths = relation.location().rootPaths()
    return [paths.apply(i).toString() for i in range(paths.size())]


def stored(docs: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``docs`` where it is a plain Parquet table, else its ``columns`` spooled: a table whose rows have a place."""
    return docs if relation_paths(docs) else spool(docs.select(*[F.col(f"`{c}`") for c in columns]), name)


def place(docs: DataFrame) -> tuple[Column, Column]:
    """File and number of a row of a plain Parquet table, whatever its columns are called."""
    at = docs.metadataColumn("_metadata")
    return at["file_path"], at["row_index"]


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that helper columns beside it clash with none."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slots(df: DataFrame, group: list[str], order: list[str], out: str, name: str, keep: Callable[[DataFrame], DataFrame] = lambda laid: laid) -> DataFrame:
    """Adds ``out``: the row's place (from 0, without gaps) within its ``group`` by ``order``.

    A window over the group would put a hot group into one task. Here rows are dealt out by range of
    (group, order), numbered where they lie, and each piece of a group gets the sizes of the pieces
    before it. ``df`` should be narrow and cheap to read twice (a spooled table). The result reads one
    table, which is given to ``keep``.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    laid = keep(spool(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name))
    laid = laid.withColumn("_piece", F.shiftrightunsigned("_at", 33))
    pieces = laid.groupBy("_piece", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    laid, pieces = laid.alias("l"), pieces.alias("p")
    cond = F.lit(True)
    for c in ("_piece", *group):
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"p.{c}"))
    return laid.join(pieces, cond).select(*[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col("_at") - F.col("_first") + F.col("_before")).alias(out))


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % modulus
