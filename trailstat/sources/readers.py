"""Readers of transcripts, manifests, aggregates and rule contracts."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import token
from .shared import spool

#: Folders that a tree scan leaves out.
IGNORED_FOLDERS = (".git", ".private", "node_modules", "outputs", "tmp", "__pycache__")
# Fixed value: where a packed station keeps its transcripts.
PACKED_SOURCES = "/restricted/interaction_sources/"


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header, all columns text, fields of any length and over lines."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, inferSchema=False)


def _whole_lines(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Lines of a stream of bytes, without their newlines."""
    rest = b""
    for chunk in chunks:
        *lines, rest = (rest + chunk).split(b"\n")
        yield from lines
    if rest:
        yield rest


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """source, line (from 1), raw, sha256 of every *.jsonl file under ``path``, of any size.

    Files are read in splits, once, into a table whose lines know their place. A line's number is its
    place in its split and the lines of the splits before; no window spans a file's lines. A digest takes
    its bytes in order: one task a file, which streams the lines. An empty file has no lines.
    """
    scan = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    meta = F.col("_metadata")
    rows = scan.select(meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    lines = spool(rows, "lines")
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    splits = splits.select("file", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    in_order = lines.select("file", "size", "split", "at", F.col("raw").cast("binary").alias("raw")).repartition("file").sortWithinPartitions("file", "split", "at").drop("split", "at")
    digests = in_order.mapInArrow(_digests, "file string, sha256 string")
    numbered = lines.join(splits.join(digests, "file"), ["file", "split"])  # by split: a large file stays spread
    # A file's name is written as in an address; invalid bytes become U+FFFD.
    source = F.regexp_extract(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), r"([^/]+)\.jsonl$", 1)
    return numbered.select(source.alias("source"), (F.col("at") - F.col("first") + F.col("before") + 1).cast("int").alias("line"), F.decode(F.col("raw").cast("binary"), "UTF-8").alias("raw"), "sha256")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, place (from 1) of a text that Spark wrote in order, in parts of any number and size.

    Parts count by their numbers. As in ``json_lines``, a line's place is that in its split and the lines
    of the splits before, from a table of one row a split.
    """
    meta = F.col("_metadata")
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = spool(scan.select(meta["file_name"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"), "value"), "lines")
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    before = F.sum("n").over(Window.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)\.txt$"), "split").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    splits = splits.select("file", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(splits, ["file", "split"]).select("value", (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each file from its lines in order; the file's size tells whether its last line ended."""
    file, size, seen, digest = None, 0, 0, hashlib.sha256()

    def told() -> pa.RecordBatch:
        if seen < size:
            digest.update(b"\n")
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([digest.hexdigest()])], names=["file", "sha256"])

    for batch in batches:
        for name, length, raw in zip(batch.column("file"), batch.column("size"), batch.column("raw")):
            if name.as_py() != file:
                if file is not None:
                    yield told()
                file, size, seen, digest = name.as_py(), length.as_py(), 0, hashlib.sha256()
            else:
                digest.update(b"\n")
                seen += 1
            digest.update(raw.as_py())
            seen += len(raw.as_py())
    if file is not None:
        yield told()


def zip_members(spark: SparkSession, path: str, within: str = PACKED_SOURCES, suffix: str = ".jsonl") -> DataFrame:
    """archive, member, content of the members of zip files whose name holds ``within`` and ends in ``suffix``."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = io.BytesIO(content.as_py())
                if not zipfile.is_zipfile(data):
                    continue  # told by ``archives``
                with zipfile.ZipFile(data) as archive:
                    for member in archive.namelist():
                        if within in f"/{member}" and member.endswith(suffix):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([archive.read(member)], pa.binary())], names=["archive", "member", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(expand, "archive string, member string, content binary")


def zipped_lines(spark: SparkSession, path: str, within: str = PACKED_SOURCES, chunk: int = 1 << 20, rows: int = 1 << 10) -> DataFrame:
    """Like ``json_lines`` for packed stations. An archive is read whole, its members as streams: once for the digest, once for the lines."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = io.BytesIO(content.as_py())
                if not zipfile.is_zipfile(data):
                    continue  # told by ``archives``
                with zipfile.ZipFile(data) as archive:
                    for member in archive.namelist():
                        if within not in f"/{member}" or not member.endswith(".jsonl"):
                            continue
                        with archive.open(member) as stream:
                            digest = hashlib.file_digest(stream, "sha256").hexdigest()
                        with archive.open(member) as stream:
                            lines, at = _whole_lines(iter(lambda: stream.read(chunk), b"")), 0
                            while part := list(islice(lines, rows)):
                                n, source = len(part), member.rsplit("/", 1)[-1].removesuffix(".jsonl")
                                yield pa.RecordBatch.from_arrays([pa.array([source] * n), pa.array(range(at + 1, at + n + 1), pa.int32()), pa.array([x.decode("utf-8", "replace") for x in part]), pa.array([digest] * n)], names=["source", "line", "raw", "sha256"])
                                at += n

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(expand, "source string, line int, raw string, sha256 string")


def workbook_texts(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, label, text of the XML members of workbooks (their other members by name alone)."""
    members = zip_members(spark, path, within="/", suffix="")
    text = F.when(F.col("member").endswith(".xml"), F.decode("content", "UTF-8")).otherwise(F.lit(""))
    name = F.regexp_extract("archive", "([^/]+)$", 1)
    return members.select(name.alias("archive"), "member", F.concat_ws("!", name, "member").alias("label"), text.alias("text"))


def archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, is_zip of files: whether each ends as a zip archive does."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([zipfile.is_zipfile(io.BytesIO(c.as_py())) for c in batch.column("content")], pa.bool_())], names=["archive", "is_zip"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"), "content").mapInArrow(judge, "archive string, is_zip boolean")


def source_specs(manifest: DataFrame) -> DataFrame:
    """One row a source: reported and canonical reference, provider, sorted case ids, expected hash.

    A reference with two providers is an error; a case id that is empty doesn't count.
    """
    one = manifest.groupBy("source_ref").agg(
        F.count_distinct("provider").alias("n"),
        F.first("provider").alias("provider"),
        F.array_sort(F.collect_set(F.nullif(F.trim("case_id"), F.lit("")))).alias("case_ids"),
        F.max("sha256").alias("expected_sha256"),
    )
    provider = F.when(F.col("n") <= 1, F.col("provider")).otherwise(F.raise_error(F.concat(F.lit("two providers for "), "source_ref")).cast("string"))
    return one.select(F.col("source_ref").alias("reported_ref"), F.when(F.col("source_ref").startswith("SRC-"), F.col("source_ref")).otherwise(token("SRC", F.col("source_ref"))).alias("source_ref"), provider.alias("provider"), "case_ids", "expected_sha256")


def verified(lines: DataFrame, specs: DataFrame) -> DataFrame:
    """Lines joined to their source; a hash other than the expected one is an error when the rows are read."""
    joined = lines.join(specs, lines["source"] == specs["reported_ref"])
    wrong = (F.coalesce(F.col("expected_sha256"), F.lit("")) != "") & (F.col("expected_sha256") != F.col("sha256"))
    raw = F.when(wrong, F.raise_error(F.concat(F.lit("hash mismatch: "), "reported_ref")).cast("string")).otherwise(F.col("raw"))
    return joined.select("source_ref", "provider", "line", raw.alias("raw"))


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content of the files under ``root``, without ignored folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    rows = files.select(F.regexp_replace("path", "^.*?" + base.replace(".", r"\.") + "/", "").alias("path"), "content")
    return rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in IGNORED_FOLDERS])))


def contract(rules_text: str, cutoff_text: str) -> tuple[dict, dict]:
    """Rule contract and cutoff, which must be of one cutoff_id."""
    rules, cutoff = json.loads(rules_text), json.loads(cutoff_text)
    if rules["cutoff_id"] != cutoff["cutoff_id"]:
        raise ValueError("rules and cutoff disagree on cutoff_id")
    return rules, cutoff


def summary_items(texts: DataFrame, selector: str) -> DataFrame:
    """label, place (from 0), key, value of the objects in the list at ``selector`` in JSON texts (label, text)."""
    items = F.from_json(F.get_json_object("text", selector), "array<map<string,string>>")
    rows = texts.select("label", F.posexplode(items).alias("place", "item"))
    return rows.select("label", "place", F.explode("item").alias("key", "value"))


def summary_cells(texts: DataFrame, selector: str) -> DataFrame:
    """label, key, value of the object at ``selector`` (a JSON path) in JSON texts (label, text)."""
    cells = F.from_json(F.get_json_object("text", selector), "map<string,string>")
    return texts.select("label", F.explode(cells).alias("key", "value"))
