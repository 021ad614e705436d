"""What the operators share: table reading, checkpoint folders, shipping of the package."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; a folder
    of our own only where that is unset and all runs in one process, as in tests."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined() and not set_dir:
        return current.get().rsplit("/", 1)[0]
    if not set_dir and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    target = set_dir or tempfile.mkdtemp(prefix="signalmill-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(target)
    return target


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, lost executors lose nothing."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Lets executors import this package where PYTHONPATH or the working folder doesn't already."""
    app = spark.sparkContext.applicationId
    seen = [os.path.abspath(p or ".") for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    here = {os.path.realpath(p) for p in seen}
    if app in _shipped or os.path.realpath(PACKAGE_ROOT) in here or any(os.path.exists(f"{p}/signalmill/llm") for p in seen):
        return
    base = tempfile.mkdtemp(prefix="signalmill-zip-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{base}/signalmill_pkg", "zip", PACKAGE_ROOT, "signalmill"))
    _shipped.add(app)


def fresh(df: DataFrame, *names: str, besides: Iterable[str] = ()) -> list[str]:
    """Column names that df doesn't have yet, and that aren't in besides."""
    taken, out = {c.lower() for c in (*df.columns, *besides)}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(df: DataFrame, columns: list[str], added: list[tuple[str, T.DataType]], make: Callable[[], Callable[[list[list]], list[list]]], slice_bytes: int | None = None) -> DataFrame:
    """df with further columns. make() is called once a task and returns a function from the lists
    of values of `columns` to lists of values of the added columns; batches stay Arrow otherwise. Values come in slices of about
    slice_bytes (SLICE_BYTES)."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    fields = [T.StructField(n, t) for n, t in added]
    schema = T.StructType([*df.schema.fields, *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(t) for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _made(make)
        for batch in batches:
            for part in slices(batch, columns, slice_bytes or SLICE_BYTES):
                new = work([part.column(c).to_pylist() for c in columns])
                arrays = [*part.columns, *(pa.array(v, type=k) for v, k in zip(new, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, *(n for n, _ in added)])
        release()

    return df.mapInArrow(run, schema)


_held: list = [None, None, False]


def held(key: object, build: Callable[[], object]) -> object:
    """What a worker keeps from task to task: the object last built under a key, one in all."""
    if _held[0] != key:
        _held[:2] = [None, None]
        _held[:2] = [key, build()]
    _held[2] = True
    return _held[1]


def _made(make: Callable):
    """make(), letting go of what an earlier operator's tasks left if this one's ask for nothing."""
    _held[2] = False
    work = make()
    if not _held[2]:
        _held[:2] = [None, None]
    return work


def release() -> None:
    """Gives freed memory back, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of a batch that are turned into Python objects at once; bytes of a batch that the JVM and a worker both hold.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of texts are bounded by bytes, not by rows only: long texts would else fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(re.sub(r"\D", "", spark.conf.get(key) or "") or 0)
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, columns: list[str], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes in the named columns, one row at least."""
    rows = batch.num_rows
    size = sum(batch.column(c).nbytes for c in columns)
    step = max(1, rows * limit // max(size, 1))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


#: Rows of one key that a task gets at least before the key is split, and keys that are split at most.
SALT_ROWS, SALT_KEYS = 100, 10_000


def salted_join(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """left joined with the columns of right, which has one row for each value of `key`. Column `rows`, of right or of `counts`, tells how
    many rows of left have it. Rows of left whose key has many are dealt over several tasks, each of which gets right's row. At most
    SALT_KEYS keys are split, and their list is broadcast. left must read stored tables: rows are told apart by their place there."""
    told = right if counts is None else counts
    total = told.agg(F.sum(rows)).first()[0] or 0
    bound = max(SALT_ROWS, -(-total // SALT_KEYS))
    salt, salts = fresh(left, "_salt", "_salts", besides=right.columns)
    hot = F.broadcast(told.where(F.col(rows) > bound).select(key, F.ceil(F.col(rows) / bound).cast("int").alias(salts)))
    spread = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(salts)).cast("int"), F.lit(0))
    dealt = left.join(hot, key, "left").withColumn(salt, spread).drop(salts)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))
    each = right.join(hot, key, "left").withColumn(salt, copies).drop(salts, *([rows] if counts is None else []))
    return dealt.join(each, [key, salt], how).drop(salt)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
