"""Helpers that several operators share: working storage, reading tables, names for helper columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

#: Bits in a table of marks for each value, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: A larger table is broadcast in blocks of so many bits: as a scalar subquery it is copied with each stage, dozens of times its size on the driver.
INLINE_BITS, BLOCK_BITS = 1 << 19, 16

BATCH_CONF, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def workdir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where none is set, a folder of our own for the life of this process, on one machine only: a cluster without a
    shared folder raises, since its executors would not see each other's files.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        place = tempfile.mkdtemp(prefix="lakesift-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{workdir(spark)}/lakesift/{tag}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts travel to Python in batches of at most BATCH rows meanwhile, which bounds what a worker and its JVM hold at a time."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts the lineage, survives lost executors.

    The files stay until ``discard`` or until the folder is emptied; the returned frame reads them.
    """
    path = new_path(df.sparkSession, tag)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*stashes: DataFrame) -> None:
    """Remove the files of stashes that nothing reads any more."""
    for df in stashes:
        if getattr(df, "stashed_at", None) is None:
            continue
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _slot(c: Column, bits: int) -> Column:
    return F.xxhash64(c).bitwiseAND(F.lit(bits - 1))


def _place(c: Column, bits: int) -> Column:
    return F.shiftright(_slot(c, bits), 6).cast("int")


def _bit(c: Column, bits: int) -> Column:
    return _slot(c, bits).bitwiseAND(F.lit(63)).cast("int")


def _bits_for(values: DataFrame) -> int:
    return min(MOST_BITS, 1 << max(6, (BITS_EACH * values.count() - 1).bit_length()))


def _words(values: DataFrame, bits: int) -> DataFrame:
    """``place, word``: the marks, 64 a row, without rows that have none."""
    own = F.col(values.columns[0])
    return values.groupBy(_place(own, bits).alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(own, bits))).alias("word"))


def maybe_among(value: Column, values: DataFrame, bits: int | None = None) -> Column:
    """Whether the long ``value`` may be in ``values`` (distinct, of one column): true for all that are and, by chance, a few others.

    A filter before a join on it, so that what has no partner need not be shuffled.  One bit a value by its hash, in a scalar
    subquery; about one in BITS_EACH others passes, more where more than MOST_BITS / BITS_EACH values are marked.
    """
    bits = bits or _bits_for(values)
    words = _words(values, bits).toArrow()
    found = np.zeros(bits >> 6, np.int64)
    found[words.column("place").to_numpy()] = words.column("word").to_numpy()
    table = values.sparkSession.createDataFrame(pa.table({"bits": pa.array([found], pa.list_(pa.int64()))})).scalar()
    return F.call_function("shiftright", F.get(table, _place(value, bits)), _bit(value, bits)).bitwiseAND(F.lit(1)) == 1


def maybe_marked(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows of ``df`` whose long ``column`` may be in ``values``, as ``maybe_among`` has it; a table of over INLINE_BITS bits is broadcast.

    Such a table is put together by the executors and passes through the driver once, whatever the number of stages.
    """
    bits = _bits_for(values)
    if bits <= INLINE_BITS:
        return df.filter(maybe_among(F.col(column), values, bits))
    block, marks = unused(df, "block", "marks")
    every = values.sparkSession.range(bits >> 6).select(F.col("id").cast("int").alias("place"), F.lit(0).cast("long").alias("word"))
    dense = _words(values, bits).unionByName(every).groupBy("place").agg(F.bit_or("word").alias("word"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    table = dense.groupBy(F.shiftright("place", BLOCK_BITS - 6).alias(block)).agg(whole.alias(marks))
    place = _place(F.col(column), bits)
    word = F.get(F.col(marks), place.bitwiseAND(F.lit((1 << BLOCK_BITS - 6) - 1)))
    on = F.call_function("shiftright", word, _bit(F.col(column), bits)).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(table), (F.shiftright(place, BLOCK_BITS - 6) == F.col(block)) & on, "left_semi")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes for ``df`` to have no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """How many words (WORD) a text has, null for null, without a list of them.

    ``regexp_count`` makes the whole list, with a match and a string for each word.  Here blanks become spaces, then pairs of
    characters that are in no text any more, so that two blanks in a row show as the pair's end and start; between
    one blank put before and one behind, each other blank but the last starts a word.
    """
    for blank in "\t\n\v\f\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    spaced = F.concat(F.lit(" "), text, F.lit(" "))
    paired = F.replace(spaced, F.lit(" "), F.lit("\t\n"))
    long = lambda c: F.octet_length(c).cast("long")
    blanks = long(paired) - long(spaced)
    in_a_row = F.shiftright(long(paired) - long(F.replace(paired, F.lit("\n\t"), F.lit(""))), 1)
    return blanks - in_a_row - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_key(source: Column) -> Column:
    """A non-null key that sorts like the source's code points, with null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))
