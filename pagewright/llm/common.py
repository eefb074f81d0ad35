"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows that a value of join keys has at most when it isn't hot, and the most hot values.
HOT_ROWS, HOT_KEYS = 512, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Bound Arrow batches by bytes, so that very long texts don't fill a Python worker.

    The session's setting is only ever made smaller: plans are made now and run later.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a folder of our own is made.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagewright-checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the written rows, without their lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's ``key`` is ``value`` for what is made and run within."""
    was = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def shuffles_freed(spark: SparkSession):
    """What is made and run within removes its shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut_freed(df: DataFrame, dealt: bool = False) -> DataFrame:
    """``cut``, after which the shuffle files that ``df`` came from are gone.

    With ``dealt``, joins by the keys that ``df`` is dealt by needn't shuffle it again: an
    adaptive plan doesn't tell how its rows are dealt.
    """
    spark = df.sparkSession
    with shuffles_freed(spark), setting(spark, "spark.sql.adaptive.enabled", "false" if dealt else spark.conf.get("spark.sql.adaptive.enabled")):
        return cut(df.select("*"))


def utf8(column) -> "F.Column":
    """The UTF-8 bytes of a text column, empty for null."""
    return F.encode(F.coalesce(column, F.lit("")), "UTF-8")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` into as many partitions as the session shuffles with."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, a written table with one row for each value of ``keys``.

    Its column ``size`` holds the number of rows of ``left`` with that value, and is left
    out of the result. Values of over ``HOT_ROWS`` rows, and of over a ``HOT_KEYS``-th of
    all, are broadcast: there are fewer than ``HOT_KEYS`` of them, as the sizes add up to
    all rows. So the rows of a hot value stay where they are; only the others are shuffled.
    """
    with shuffles_freed(left.sparkSession):
        rows, most = right.agg(F.sum(size), F.max(size)).first()
    limit = max(HOT_ROWS, (rows or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return left.join(right.drop(size), keys)
    hot, others = right.where(F.col(size) > limit).drop(size), right.where(F.col(size) <= limit).drop(size)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(others, keys)
    return left.join(F.broadcast(hot), keys).unionByName(rest)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, in any case of the letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"__{name}"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out.append(own)
    return out


def by_column(df: DataFrame, column: str, make: Callable[[], Callable[[list], list]], fields: str) -> DataFrame:
    """``df`` with ``column`` replaced by ``fields`` (DDL), computed from its values.

    ``make`` is called once in each task; what it returns gets the values of a batch and
    returns a list for each field. All other columns pass through Arrow as they are, so
    that ids of any size stay exact beside nulls.
    """
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != column]
    made = StructType.fromDDL(fields)
    schema = StructType([StructField(f.name, f.dataType) for f in [*df.select(*kept).schema, *made]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        use, kinds = make(), [to_arrow_type(f.dataType) for f in made]
        for batch in batches:
            values = use(batch.column(column).to_pylist())
            arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=schema.names)

    return df.mapInArrow(run, schema)
