"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent a local session (tests) gets a temporary folder; a cluster
    session is refused, since a machine-local folder there would lose data.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="papyrion-")
    return _own[app]


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/papyrion/{tag}-{uuid.uuid4().hex}"
    if _made.get() is not None:
        _made.get().append(path)
    return path


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of the tables that are written inside, for :func:`remove`."""
    found: list[str] = []
    token = _made.set(found)
    try:
        yield found
    finally:
        _made.reset(token)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that no DataFrame in use reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: ends the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of 64 slots in a bit mask: as rows at most this many, some 10 MB as a hash table, whatever is masked.
MASK_WORDS = 1 << 18


def _slot(cols: Iterable[str]) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(MASK_WORDS * 64))


def bit_mask(rows: DataFrame, *cols: str) -> DataFrame:
    """``(word, bits)``: a bit for each slot that a hash of the columns falls into; ``MASK_WORDS`` rows at most."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (_slot(cols) % 64).cast("int"))
    return rows.select(bit.alias("bits"), F.floor(_slot(cols) / 64).alias("word")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def masked(rows: DataFrame, mask: DataFrame, *cols: str) -> DataFrame:
    """``rows`` with a column ``maybe``: false where no row behind the mask has these values in the columns.

    It spares a shuffle the rows that a join would drop or leave alone; a join has to decide about the others, of which
    some pass by chance: few while the mask stands for fewer than a million values, all when it is full.
    ``rows`` must not have columns ``word``, ``bits`` and ``maybe``.
    """
    found = rows.withColumn("word", F.floor(_slot(cols) / 64)).join(F.broadcast(mask), "word", "left")
    return found.withColumn("maybe", F.coalesce(F.getbit("bits", (_slot(cols) % 64).cast("int")) == 1, F.lit(False))).drop("word", "bits")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Lower the session's Arrow batches to ``rows``: texts are long, and a Python worker holds whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))
