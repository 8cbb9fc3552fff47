"""Helpers shared by the training-data operators: tables, text blocks, hashing, and writing to the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; numpy temporaries are some tens of times as large.
BLOCK_BYTES = 2 << 20


#: Tables that Python workers keep from task to task, by the operator that fills them.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """This worker's table of one operator. Another operator's task in the same worker empties it first, so that what
    different operators keep doesn't add up."""
    stale = [held for name, held in _kept.items() if name != owner and held]
    for held in stale:
        held.clear()
    _calls[0] += 1
    if stale or _calls[0] % 32 == 1:
        give_back()
    return _kept.setdefault(owner, {})


_calls = [0]


def give_back() -> None:
    """Return freed memory to the system: pools and the C library keep it otherwise, and idle workers add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it keeps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (the folder may be in any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where the session has none, a local session gets one of
    its own; on a cluster that is an error, as executors don't share a machine's folders."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = f"file://{tempfile.gettempdir()}/vellum-shared-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Texts are long: where the session has the default of 10,000 rows for an Arrow batch, 2,000 keep workers small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "2000")


#: Bytes of packed rows that a task brings together in one Python worker.
PART_BYTES = 128 << 20


def parts(spark: SparkSession, n_bytes: int) -> int:
    """Partitions for a shuffle of packed rows: the session's number, or more, so that none gets more than PART_BYTES."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))


def size_of(df: DataFrame) -> int:
    """Bytes of a table's text, roughly: what the plan knows of its files, which are compressed about threefold; 0 where
    the plan knows nothing."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 3 * n if n < 1 << 60 else 0


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/vellum/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete what ``saved`` has written for ``df``; for tables that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(d)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(spark: SparkSession) -> None:
    """Let the driver's collector run, so that Spark deletes shuffle files that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(col: str, n: int) -> F.Column:
    """crc32 of a key as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def raw(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_null(arr.type):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    arr = arr.cast(pa.large_binary() if "binary" in str(arr.type) else pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if "binary" in str(arr.type) else "")
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(sizes: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together; a longer row stands alone, whole."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most ``most`` bytes in column ``text``."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False) if not pa.types.is_null(b.column(text).type) else np.zeros(b.num_rows)
        for i, j in spans(np.asarray(n, np.int64), most):
            yield b.slice(i, j - i)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array out of a flat array and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any substrings of a byte block by prefix sums of a polynomial modulo 2^64, finalised by ``mix``.

    With an odd base the sum for [i, j) times base^-i doesn't depend on the place, so equal strings get equal
    hashes wherever they stand, in any block and on any machine.
    """

    BASE = 0x9E3779B97F4A7C15 | 1
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    #: Random value of each byte.
    _values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers) < n:
            m = max(n, (BLOCK_BYTES >> 1) + 1024)
            out = []
            for base in (cls.BASE, pow(cls.BASE, -1, 1 << 64)):
                p, w = np.ones(m, np.uint64), 1
                while w < m:
                    k = min(w, m - w)
                    p[w : w + k] = p[:k] * np.uint64(pow(base, w, 1 << 64))
                    w *= 2
                out.append(p)
            cls._powers, cls._inverse = out
        return cls._powers, cls._inverse

    def __init__(self, data: np.ndarray, seed: int = 0):
        p, self.inv = self.powers(len(data) + 1)
        self.sum = np.zeros(len(data) + 1, np.uint64)
        values = mix(self._values + np.uint64(seed)) if seed else self._values
        np.cumsum(values[data] * p[: len(data)], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each [start, end)."""
        n = (end - start).astype(np.uint64)
        return mix((self.sum[end] - self.sum[start]) * self.inv[start] + n * np.uint64(0xA0761D6478BD642F))

    def width(self, w: int) -> np.ndarray:
        """Hash of every window of w bytes."""
        n = len(self.sum) - w
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sum[w:] - self.sum[:n]) * self.inv[:n] + np.uint64(w * 0xA0761D6478BD642F & (1 << 64) - 1))
