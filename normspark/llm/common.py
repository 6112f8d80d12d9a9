"""What the training-data operators share: tables, the shared folder, batches of texts, one model a worker."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normspark.storage import shared_dir, stored  # noqa: F401  (the operators take them from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (its columns must be of bounded size); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def slices(sizes: list[int], budget: int) -> Iterator[slice]:
    """Runs of consecutive items whose sizes add up to about ``budget``; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


_model: list = [None, None]


def model(key: tuple, build: Callable):
    """The one model that this Python worker keeps: workers outlive stages, so the model of another key goes first."""
    if _model[0] != key:
        _model[:] = [None, None]
        _model[:] = [key, build()]
    return _model[1]


class Known(dict):
    """Remembered results by word, emptied where their bytes pass ``most``; one long word counts with all its bytes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size = most, 0

    def room(self, size: int) -> bool:
        """Make room for entries of so many bytes; whether the others had to go."""
        full = self.size + size > self.most and bool(self)
        if full:
            self.clear()
            self.size = 0
        self.size += size
        return full


def release() -> None:
    """Give freed memory back to the system: an idle worker would keep it while other stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of text that ``per_text`` turns into Python strings at once (a longer text stands alone), and rows at most.
POINTS, ROWS = 1_000_000, 1000
#: Rows of one Arrow batch between Spark and a worker: both sides hold a batch of whole texts.
BATCH = 2000


@contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written to the shared folder for the jobs that run inside, and removed after them."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH, size: str = "16m") -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes for the jobs that run inside; the session's settings come back after them."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _flat(rows: pa.Array) -> bool:
    return not (pa.types.is_list(rows.type) or pa.types.is_large_list(rows.type))


def per_text(df: DataFrame, keep: Sequence[str], fields: str, fn: Callable[[list], Sequence], text_col: str = "text") -> DataFrame:
    """Row by row: ``__keep`` (a struct of the ``keep`` columns, untouched) and what ``fn`` makes of the whole texts.

    ``fn`` gets a list of texts (None for null) and returns one sequence per field, each as long as the list.
    Only the text goes to Python and only the new fields come back; the other columns stay in Spark, and inside
    the struct no name can clash. The function counts as nondeterministic, so that no filter repeats it.
    The session keeps Arrow batches of at most ``BATCH`` rows from then on: the result is lazy, so the setting has to outlast this call.
    """
    more = T._parse_datatype_string(fields)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in more.fields]
    names = [f.name for f in more.fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for start in range(0, len(batch), ROWS):
                rows = batch.slice(start, ROWS)
                sizes = pc.fill_null(pc.binary_length(rows) if _flat(rows) else pc.list_value_length(rows), 0).to_pylist()
                for s in slices(sizes, POINTS):
                    out = fn(rows.slice(s.start, s.stop - s.start).to_pylist())
                    parts.append(pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(names, kinds, strict=True))))
        release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    got = F.arrow_udf(run, more).asNondeterministic()(F.col(text_col))
    return df.select(F.struct(*keep).alias("__keep"), got.alias("__got")).select("__keep", "__got.*")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
