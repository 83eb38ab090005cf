"""Helpers shared by the training-data operators: shared-folder tables, Arrow word splitting, fixed-size corpus sketches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder

#: Bytes of text that one vectorised step handles; a longer single text is a step of its own.
STEP_BYTES = 1 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, and Spark's default of it.
BATCH_BYTES, SPARK_BATCH_BYTES = "4m", "67108864b"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session moves Arrow batches of ``BATCH_BYTES``, unless it has a setting of its own: for results that run later."""
    if spark.conf.get(_BATCH_KEY) == SPARK_BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside move Arrow batches of ``BATCH_BYTES``; the session's own setting holds again afterwards."""
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and outlives lost executors. ``discard`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loom/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        # no marker file: nothing reads it, and on a local folder the driver starts two processes to write one
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    _tables(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._loom_path)
        _tables(df.sparkSession).remove(df._loom_path)


_written: dict[str, list[str]] = {}


def _tables(spark: SparkSession) -> list[str]:
    key = spark.sparkContext.applicationId
    if key not in _written:
        _written[key] = []
        atexit.register(release, spark)
    return _written[key]


def release(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` has written in this session; results that read them must be consumed before."""
    try:
        for path in _written.pop(spark.sparkContext.applicationId, []):
            _delete(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def trim() -> None:
    """Give memory that Python and Arrow have freed back to the system: idle workers, and the driver between steps, stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """Between steps of a long run: plans, broadcasts and shuffle files that nothing holds any more are collected, so that a driver needs what one step needs."""
    spark.sparkContext._jvm.System.gc()
    trim()


#: The module under which a Python worker keeps what serves its later tasks.
KEPT = "_loom_encoders"


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``limit`` bytes in ``column`` (one row at least): bounds a worker's memory. Unless told to ``keep`` them, a worker gives up what it kept for tasks of another kind."""
    if not keep:
        sys.modules.pop(KEPT, None)
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def text_buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets start at 0."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    if text.offset or not len(text):
        text = pa.concat_arrays([text.slice(0, len(text)), pa.array([], pa.large_string())])
    _, off, data = text.buffers()
    offsets = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1] if off is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_map(lower: bool = False, blank: bytes = b"") -> np.ndarray:
    """A table of 256 bytes: A-Z to a-z if ``lower``, and ``blank`` to a space."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[np.frombuffer(blank, np.uint8)] = 32
    return out


LOWER = byte_map(lower=True)
#: What is neither 0-9, A-Z, a-z nor beyond ASCII parts words.
ALNUM = byte_map(lower=True, blank=bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)))


def words(text: pa.Array, mapped: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, flat, and the offsets of each text's words. Words are runs of bytes other than 0x20 and 0x09-0x0D, after ``mapped`` if given. A null has none."""
    if mapped is not None:
        raw, offsets = text_buffer(text)
        text = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(mapped[raw])])
    else:
        text = pc.fill_null(text, "")
    parts = pc.ascii_split_whitespace(text)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not some.all():
        before = np.zeros(len(some) + 1, np.int64)
        np.cumsum(some, out=before[1:])
        flat, offsets = flat.filter(pa.array(some)), before[offsets]
    return flat, offsets


def codes(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Small integers for the strings, and the distinct strings."""
    if not len(flat):
        return np.zeros(0, np.int64), flat
    enc = flat.dictionary_encode()
    return enc.indices.to_numpy().astype(np.int64), enc.dictionary


def owners(offsets: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's elements."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants): well spread values for hashes of hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def summed_arrays(df: DataFrame, columns: list[str], count: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], size: int, pieces: int = 32, merge: np.ufunc = np.add, dtype: type = np.int64) -> np.ndarray:
    """The sum (or ``merge``) over all rows of a fixed-size array: each partition fills its own, pieces are merged in two levels. The driver gets ``size`` numbers, whatever the input."""
    step = -(-size // pieces)

    def fill(batches):
        from pyspark import TaskContext

        own = np.zeros(step * pieces, dtype)
        count(batches, own)
        part = TaskContext.get().partitionId()
        used = [i for i in range(pieces) if own[i * step : (i + 1) * step].any()]
        for i in used:
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "part": pa.array([part], pa.int32()), "counts": [zlib.compress(own[i * step : (i + 1) * step].tobytes(), 1)]})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(step, dtype)
        for batch in batches:
            for x in batch.column("counts"):
                merge(total, np.frombuffer(zlib.decompress(x.as_buffer()), dtype), out=total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "counts": [zlib.compress(total.tobytes(), 1)]})

    form = "piece int, part int, counts binary"
    found = df.select(*columns).mapInArrow(fill, form)
    found = found.groupBy("piece", (F.col("part") / 64).cast("int").alias("some")).applyInArrow(add, form).groupBy("piece").applyInArrow(add, form)
    out = np.zeros(step * pieces, dtype)
    with small_batches(df.sparkSession):
        rows = found.collect()
    for row in rows:
        out[row.piece * step : (row.piece + 1) * step] = np.frombuffer(zlib.decompress(row.counts), dtype)
    del rows
    trim()
    return out[:size]


def ship(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of ``value`` with the code of its class; ``received`` unpacks it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shipped: Broadcast) -> object:
    return cloudpickle.loads(shipped.value)


def with_columns(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    """``batch`` with further columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])
