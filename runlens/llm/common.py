"""Shared helpers: tables, the shared scratch folder, Arrow blocks and worker set-up."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold over 1 / HOT of all rows, fewer than HOT by counting, are joined by broadcast.
HOT = 1000
#: Bits of Spark's own bitmaps.
BITMAP = 1 << 15

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Python workers find this package even when the driver got it from sys.path alone."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local one only where that is unset and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or f"file://{tempfile.gettempdir()}/runlens-shared"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    Zstandard needs less disk than the default and, as measured, less executor memory. The folder is deleted when the
    session ends, or by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def join_counted(rows: DataFrame, keyed: DataFrame, key: str | list[str], copies: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row a key; ``copies`` says how many of the ``total`` rows hold it).

    Hot keys, fewer than HOT, are joined by broadcast and never shuffled, so one huge group does not land in one task.
    ``rows`` is read twice and should be settled; ``copies`` is dropped. No key may be null.
    """
    key = [key] if isinstance(key, str) else key
    hot = F.col(copies) * HOT > total
    few, rest = F.broadcast(keyed.where(hot).drop(copies)), keyed.where(~hot).drop(copies)
    cold = rows.join(F.broadcast(keyed.where(hot).select(*key)), key, "left_anti")
    return rows.join(few, key).unionByName(cold.join(rest, key))


def among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``row``, a long from 0, is one of those of ``wanted``, as a semi-join gives them.

    ``rows`` are not shuffled, however wide they are: bitmaps of BITMAP bits, one bit for a row, are broadcast.
    """
    place, names = F.col("row").bitwiseAND(F.lit(BITMAP - 1)), rows.columns
    marks = wanted.select(F.shiftright("row", BITMAP.bit_length() - 1).alias("bucket"), place.alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("marks"))
    byte = F.conv(F.hex(F.substring("marks", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn("bucket", F.shiftright("row", BITMAP.bit_length() - 1)).join(F.broadcast(marks), "bucket")
    return told.where(F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1).select(*names)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text each (one longer text stands alone), so memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(int(np.searchsorted(ends, before + limit, side="right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """White-space words of each text as dictionary codes: (codes, offsets by text, distinct words). Null counts as empty."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    encoded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return encoded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0], encoded.dictionary


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated arange(s, s + n) for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    kind = np.int32 if total < 2**31 and int(starts.max()) + int(lengths.max()) < 2**31 else np.int64
    before = np.cumsum(lengths) - lengths
    return np.repeat((starts - before).astype(kind), lengths) + np.arange(total, dtype=kind)
