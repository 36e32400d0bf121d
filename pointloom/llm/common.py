"""What several operators of this folder share: the folder all machines see, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python spelling of a word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: One in so many rows makes a join key hot, and so many parts does it get.
SPLITS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder of its own; on a cluster it is an
    error, as no other folder is known to be one that all machines see.
    """
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="pointloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read again.

    This cuts the lineage with a replicated copy: an executor lost later costs no recomputation of
    what lies before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pointloom_path = path
    return out


def discard(stored: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and that nothing reads any more."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored._pointloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def skewed_join(big: DataFrame, small: DataFrame, on: list[str], how: str, spread: Column, counts: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small``, whose rows have distinct keys, so that no key of ``big`` is one task's work.

    A key with over one in ``SPLITS`` rows of ``big`` is hot; there can't be ``SPLITS`` of them, so
    their list is broadcast.  Rows of a hot key are dealt over ``SPLITS`` parts by ``spread``, and its
    row of ``small`` is written once for each part.  ``counts`` (key, __rows) saves counting ``big``.
    """
    counts = big.groupBy(*on).agg(F.count("*").alias("__rows")) if counts is None else counts
    total = counts.agg(F.sum("__rows")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("__rows") > max(1, total / SPLITS)).select(*on, F.lit(True).alias("__hot")))
    dealt = big.join(hot, on, "left").withColumn("__part", F.when(F.col("__hot"), F.pmod(spread, F.lit(SPLITS)).cast("int")).otherwise(0)).drop("__hot")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SPLITS - 1))).otherwise(F.array(F.lit(0)))
    copied = small.join(hot, on, "left").withColumn("__part", F.explode(parts)).drop("__hot")
    return dealt.join(copied, [*on, "__part"], how).drop("__part")


def word_count(text) -> F.Column:
    """Words in a text column; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]
