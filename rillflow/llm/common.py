"""What the operators share: scratch tables in the cluster's shared folder, reading tables, tokenizer files."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` in the shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset a temporary folder is set in a session on one machine, as in tests; on a cluster, where
    none would be shared, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rillflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df_rows: int, rows_per_task: int) -> int:
    return max(1, -(-df_rows // rows_per_task))


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that most operators read; other columns, whatever their names, stay out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: Bytes of a batch of rows on its way to a Python worker.
BATCH_BYTES = 8 << 20
#: What one operator keeps in this Python worker between its tasks.
_held: dict[str, Any] = {}


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; batches that its session sends to Python workers hold at most ``BATCH_BYTES`` from now on, and one row more."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = str(conf.get(name)).lower().removesuffix("b")
    if not kept.isdigit() or not 0 < int(kept) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def release() -> None:
    """Gives up what operators keep in this Python worker, and gives back to the machine what its allocators keep."""
    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def hold(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this Python worker until another operator works there, so that their tables never add up."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


#: Keys that a filter is made for at most, bits of a key, and bits of one of its bitmaps: 32 MB in all.
FILTER_KEYS, KEY_BITS, BITMAP = 16_000_000, 16, 32_768


def _bit(number: Column, i: int) -> Column:
    return F.pmod(F.shiftrightunsigned(number, 15 * i), F.lit(BITMAP))


def key_filter(numbers: DataFrame) -> tuple[DataFrame, int] | None:
    """Bitmaps over the ``numbers(h long)``, at most 32 MB, and their number; None if there are more than ``FILTER_KEYS``.

    Three bits of one bitmap stand for a number, so a number that isn't among them passes in about one of 200 cases.
    """
    n = numbers.count()
    if n > FILTER_KEYS:
        return None
    buckets = tasks_for(n * KEY_BITS, BITMAP)
    bits = numbers.select(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("__rf_bucket"), F.explode(F.array(*(_bit(F.col("h"), i) for i in range(3)))).alias("bit"))
    return keep(bits.groupBy("__rf_bucket").agg(F.bitmap_construct_agg("bit").alias("__rf_bitmap")), "filter"), buckets


def passes(rows: DataFrame, h: Column, found: tuple[DataFrame, int], how: str = "left_semi") -> DataFrame:
    """The ``rows`` whose number ``h`` may be among those of the filter ``found``, or with ``left_anti`` the ones for which it can't be; where they lie."""
    bitmaps, buckets = found

    def is_set(i: int) -> Column:
        bit = _bit(h, i)
        byte = F.conv(F.hex(F.substr("__rf_bitmap", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (bit % 8).cast("int")) % 2 == 1

    own = F.pmod(F.xxhash64(h), F.lit(buckets)) == F.col("__rf_bucket")
    return rows.join(F.broadcast(bitmaps), reduce(lambda x, y: x & y, (is_set(i) for i in range(3)), own), how)


def keep_rows(docs: DataFrame, verdicts: DataFrame, text: Column) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``verdicts(doc_id, digest, h, stays, n)`` has a row for every row of ``docs``: the digest of ``text`` as it
    stays or goes, ``h`` the hash of ``doc_id`` and the text column, ``n`` the rows that share id and digest, of which one stays.
    Rows whose hash no goer and no repeated row has stay where they lie; only the others are looked up exactly, and move.
    """
    h = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    touched = keep(verdicts.where("NOT stays OR n > 1").select("h"), "touched")
    found = key_filter(touched.distinct())
    maybe = docs if found is None else passes(docs, h, found)
    stay = verdicts.where("stays").select(F.col("doc_id").alias("__rf_id"), F.col("digest").alias("__rf_kept"), F.col("n").alias("__rf_n")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__rf_id")) & (F.col("__rf_sha") == F.col("__rf_kept"))
    # A join's own key expressions, so that Spark may split a hot one; and a side that is hashed, since texts are long.
    looked = maybe.withColumn("__rf_sha", F.sha2(text, 256)).join(keep(stay, "stay").hint("shuffle_hash"), same)
    out = looked.where("__rf_n = 1").unionByName(looked.where("__rf_n > 1").dropDuplicates(["__rf_id", "__rf_sha"]))
    out = out.drop("__rf_sha", "__rf_id", "__rf_kept", "__rf_n")
    return out if found is None else passes(docs, h, found, "left_anti").unionByName(out)


def tokenizer_file(name: str) -> str:
    """The place of an installed public tokenizer file on this machine (driver or executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)
