"""What several operators share: shared-folder tables, session guards and words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch that the JVM hands to Python. It holds each batch twice outside its heap, in buffers that double as they grow, for each task.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def _fewer(spark: SparkSession, rows: int = BATCH_ROWS) -> str:
    """rows, or what the session has set if that is less; 0 and below mean no bound."""
    own = int(spark.conf.get(BATCH, "0"))
    return str(min(own, rows) if own > 0 else rows)


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session's settings for a while; then they are as before."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(df: DataFrame) -> DataFrame:
    """df in a session like its own, but for batches of BATCH_ROWS for Python; its own keeps its settings.

    The size of batches is read when a plan runs, so a plan that is given out must carry it."""
    spark = df.sparkSession
    own = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(BATCH, _fewer(spark))
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()), own)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "hueweave-shared")


def table(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors, and is computed once. rows: of a batch for Python.

    Shuffle files of the write are removed when it ends, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hueweave-{uuid.uuid4().hex}"
    with _set(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCH: _fewer(spark, rows)}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if not _WRITTEN:
        atexit.register(sweep, spark)
    _WRITTEN.add(path)
    return out


_WRITTEN: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.discard(path)


def drop(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        if t is not None and (path := getattr(t, "_written", None)):
            _delete(t.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Deletes all that table() wrote and drop() left. For when no result is read any more; it runs by itself when the process ends in order."""
    try:
        for path in list(_WRITTEN):
            _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone, and its files with it
        pass


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most; Spark bounds the bytes of one. What becomes of a slice in Python then is a few MB, given back when they end."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        del b
    release()


def spread_join(rows: DataFrame, groups: DataFrame, key: str | list[str], salt_by: str, total: int, how: str = "inner", hot: int = 1_000, salts: int = 32) -> DataFrame:
    """rows joined with groups(key, n, ...) by key, n being the key's rows; a key of more than a 1/hot of all rows, and null, is dealt to `salts` tasks.

    There can be no more than `hot` such keys, which bounds what is broadcast. The column n goes."""
    key = [key] if isinstance(key, str) else key
    large = F.col("n") * hot > total
    keys = F.broadcast(groups.filter(large).select(*key, F.lit(True).alias("__hot")).distinct())
    salted = groups.withColumn("__salt", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    salt = F.when(F.col("__hot") | F.col(key[0]).isNull(), F.pmod(F.xxhash64(salt_by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    return rows.join(keys, key, "left").withColumn("__salt", salt).drop("__hot").join(salted, [*key, "__salt"], how).drop("__salt")


def shielded(stage: Callable) -> Callable:
    """A stage over docs that never meets the names of columns it does not use (those its *_col parameters do not name), so none can clash with its own."""
    told = inspect.signature(stage)

    @functools.wraps(stage)
    def run(docs: DataFrame, *more, **named) -> DataFrame:
        given = told.bind(docs, *more, **named)
        given.apply_defaults()
        used = {v for k, v in given.arguments.items() if k.endswith("_col")}
        names = {c: f"__extra_{i}" for i, c in enumerate(docs.columns) if c not in used}
        quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
        out = stage(docs.select(*[quoted(c).alias(names.get(c, c)) for c in docs.columns]), *more, **named)
        own = {v: k for k, v in names.items()}
        return out.select(*[F.col(c).alias(own.get(c, c)) for c in out.columns])

    return run


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_HELD: dict = {}


def release() -> None:
    """Freed memory of a worker goes back to the machine, where the allocators can give it back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def held(key: object, make: Callable):
    """What a worker process keeps from task to task under a key. Workers outlive operators, so one operator's keepings make way for the next's."""
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = make()
    return _HELD[key]
