"""What the operators of this package share: shared storage, bounded samples, marks of rows in files."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import settled as stored
from docketry.session import shared_folder

#: Words are runs of anything but these seven ASCII blanks.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/docketry-{what}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Remove stored tables, given as paths or as frames that stored() returned."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths: set[str] = set()
    for t in tables:
        if isinstance(t, str):
            paths.add(t)
        else:
            paths |= {f.rsplit("/", 1)[0] for f in t.inputFiles()}
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return what this process has freed to the system: the allocators keep it, and workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, for mapInArrow; the worker gives its memory back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def crc_of_id(column: str | Column) -> Column:
    """crc32 of the id as text: decides the held-out folds."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary"))


def bounded_sample(rows: DataFrame, classes: str, key: str, per_class: int, seed: str) -> DataFrame:
    """About per_class rows of each class, chosen by a hash of the key, so the same rows at every run.

    rows: only narrow columns (no texts). A class gives each row the chance per_class over its count, so the sample
    is about per_class rows for each class, whatever the input.
    """
    spread = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = rows.groupBy(classes).agg(F.count(F.lit(1)).alias("__n"))
    kept = rows.join(counts, classes).withColumn("__u", spread).where(F.col("__u") * F.col("__n") < F.lit(float(per_class)) * 1.1)
    return kept.drop("__u", "__n")


def few_rows(rows: DataFrame, most: int, key: str, seed: str) -> list:
    """About `most` rows, collected: each has the chance most over the count, by a hash of its key (all, if fewer).

    At most 2 * most + 100 rows come to the driver, whatever the input and however often a key repeats.
    """
    chance = most / max(1, rows.count())
    spread = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(spread < F.lit(chance)).limit(2 * most + 100).collect()


#: Bytes of marks that are broadcast at once. A block of 32,768 rows of a file takes MARK_BYTES.
MOST_MARKS = 64 << 20
MARK_BYTES = 4096


def positioned(docs: DataFrame) -> DataFrame:
    """docs with __file and __row, a row's place in its Parquet file.

    A frame that is more than a scan, a filter and a choice of columns is written to the shared folder first.
    """
    plan = docs._jdf.queryExecution().analyzed().toString().split("\n")
    scan = all(line.strip(" :+-").split(" ")[0].split("(")[0] in {"Project", "Filter", "SubqueryAlias", "Relation", "View", ""} for line in plan if line.strip())
    for frame in ([docs] if scan and "_metadata" not in docs.columns else []) + [None]:
        frame = stored(docs, "docs") if frame is None else frame
        try:
            place = frame.metadataColumn("_metadata")
            return frame.select("*", place.getField("file_path").alias("__file"), place.getField("row_index").alias("__row"))
        except AnalysisException:
            continue
    raise ValueError("the rows have no places in files")


def marks(places: DataFrame) -> DataFrame:
    """(__file, __block, bits) for a table of places (__file, __row): one bit a row, whatever the ids and texts are."""
    at = F.col("__row") + 1
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    return stored(places.groupBy("__file", F.bitmap_bucket_number(at).alias("__block")).agg(bits), "marks")


def marked_rows(rows: DataFrame, marked: DataFrame, what: str, work=lambda df: df, most: int | None = None) -> DataFrame:  # noqa: ANN001
    """work(rows whose place is marked), where the rows lie: only marks are broadcast, no row is shuffled.

    rows: with __file and __row. Marks of more than `most` bytes are broadcast in slices, one after the other; a
    slice is a part of the files, so each file is still read once, and the slices' rows are written to one folder.
    """
    most = MOST_MARKS if most is None else most
    slices = -(-marked.count() * MARK_BYTES // most)
    slices = slices if slices <= 1 else 2 * slices  # slices by hash are not quite even
    at = F.col("__row") + 1
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")

    def found(part: DataFrame, some: DataFrame) -> DataFrame:
        joined = part.withColumn("__block", F.bitmap_bucket_number(at)).join(F.broadcast(some), ["__file", "__block"])
        return work(joined.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns))

    if slices <= 1:
        return found(rows, marked)
    spark = rows.sparkSession
    path, slice_ = new_path(spark, what), F.pmod(F.xxhash64("__file"), F.lit(slices))
    for s in range(slices):
        found(rows.where(slice_ == s), marked.where(slice_ == s)).write.mode("append").parquet(path)
    return spark.read.schema(found(rows, marked).schema).parquet(path)


def map_groups(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:  # noqa: ANN001
    """work(table) on the rows of each group of the (numeric or text) key columns; it yields Arrow batches.

    Like a grouped map, but a task reads its sorted groups as a stream of Arrow batches, so thousands of small
    groups cost little. Groups must be small enough for memory: split large ones before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(new).tolist()] if batch.num_rows else []
            for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=False):
                mark = tuple(c[at] for c in columns)
                if held and mark != last:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                last = mark
                held.append(batch.slice(at, end - at))
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
