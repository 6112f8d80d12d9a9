"""Intermediate tables in the folder that all executors share, and joins whose result is far larger than their sides."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: set[str] = set()


def _clear(spark: SparkSession, root: str) -> None:
    """Remove what this application kept in the shared folder, unless its JVM has gone first."""
    if spark.sparkContext._gateway is not None and spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` and a folder of this application that goes when it exits.

    Where a local session does not name one (as in tests), a temporary folder is set for it; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="normspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/normspark/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_clear, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there and later uses don't recompute it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Parts that the rows of one key are cut into by ``salted_join``.
SALTS = 32


def salted_join(few: DataFrame, many: DataFrame, key: list[str], id: str) -> DataFrame:
    """``few`` and ``many`` joined by ``key``; few keys may have nearly all rows, and the result may be far larger than both.

    Rows of ``many`` go to one of ``SALTS`` parts of their key by ``id``, rows of ``few`` to all of them. The number of
    partitions is set: Spark would choose it by the size of the sides, which says nothing of the result's.
    """
    n = int(few.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = many.withColumn("__salt", F.pmod(F.xxhash64(id), F.lit(SALTS)).cast("int"))
    on = [*key, "__salt"]
    return left.repartition(n, *on).join(right.repartition(n, *on).hint("merge"), on).drop("__salt")


#: Ids that one list of ``listed`` holds, in the mean at most.
LIST = 4096


def parts_of(rows: DataFrame, key: str, tasks: int = 1) -> Callable[[DataFrame], DataFrame]:
    """Adds ``__parts`` to a table with ``key``: in how many parts that key's ``rows`` lie, of ``LIST`` rows each at most; all keys together have ``tasks`` parts at least."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    keys, most = sizes.agg(F.count("*"), F.max("n")).first()
    least = F.lit(-(-tasks // max(keys, 1))).cast("long")
    if (most or 0) <= LIST:
        return lambda df: df.withColumn("__parts", least)
    # broadcast: one key in LIST rows at most
    many = F.broadcast(sizes.where(F.col("n") > LIST).select(key, F.ceil(F.col("n") / LIST).alias("__n")))
    return lambda df: df.join(many, key, "left").withColumn("__parts", F.greatest(least, "__n")).drop("__n")


def listed(rows: DataFrame, key: str, id: str, parts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``key, __part, ids``: the ids of a key's rows, nulls included, as lists of bounded length."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts(rows).withColumn("__part", F.pmod(F.xxhash64(id), "__parts")).repartition(n, key, "__part")
    nulls = F.array_repeat(F.lit(None).cast(rows.schema[id].dataType), F.count_if(F.col(id).isNull()).cast("int"))
    return dealt.groupBy(key, "__part").agg(F.concat(F.collect_list(id), nulls).alias("ids"))


def crossed(few: DataFrame, many: DataFrame, key: str, id: str, other: str) -> DataFrame:
    """``id, other``: every id in the lists ``ids`` of ``few`` (``key, ids``) with every ``other`` in the rows of ``many`` with its key.

    Only lists are shuffled and joined, so what lies on disk grows with the rows of ``many`` and the lists; pairs arise last. Those of a list
    with one ``other`` follow each other, and the next ``other`` has the same list: a columnar file keeps them in little room.
    ``many`` is read twice. The number of partitions is set, as in ``salted_join``. Generated code holds what comes of a row
    before it passes on the first one, so the first explode is of a higher-order function's result, for which none is generated: only one list is held, not all pairs of two.
    """
    n = int(few.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts_of(many, key, max(SALTS, 4 * n))
    lists = listed(many, key, other, parts).withColumnRenamed("ids", "__others")
    dealt = parts(few).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).repartition(n, key, "__part")
    met = dealt.join(lists.hint("merge"), [key, "__part"])
    return met.select("ids", F.explode(F.transform("__others", lambda x: x)).alias(other)).select(F.explode("ids").alias(id), other)
