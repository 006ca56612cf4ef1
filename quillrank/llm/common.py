"""What the operators of this subpackage share: folders, batches, samples."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the contracts: ASCII 32 and 9 to 13, as a Java character class.
WS = r"[\x20\x09-\x0D]"
#: Text that one Python step holds at a time, in bytes; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or the context's; where neither is set, a temporary one, if there is only one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillrank-"))
        top = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return top


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table's folder that nothing will read again."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it back.

    free: lets the driver's JVM collect its garbage, so that the shuffle files behind a large df go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if free:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._quillrank_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a written table; for the DataFrame that written gave, when nothing will read it again."""
    discard(df.sparkSession, df._quillrank_path)


def steps(batch: pa.RecordBatch, column: str = "text", size_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about size_bytes of text each, all rows in order."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    at, total = 0, np.cumsum(size)
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + size_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def coded_words(texts: pa.Array, unless: str | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words between ASCII white space (A-Z in lower case, but not in texts that hold ``unless``), the place of each word of all texts in order among them, and words a text."""
    texts = pc.fill_null(texts, "")
    lower = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(lower if unless is None else pc.if_else(pc.match_substring(texts, unless), texts, lower))
    count = np.asarray(pc.list_value_length(split), dtype=np.int64)
    coded = split.flatten().dictionary_encode()
    index = np.asarray(coded.indices, dtype=np.int64)
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    if b"" in words:  # beside white space at an end
        full = index != words.index(b"")
        count = count - np.bincount(np.repeat(np.arange(len(count)), count)[~full], minlength=len(count))
        index = index[full]
    return words, index, count


class Recent:
    """A memory of two generations, each bounded in bytes: what is used stays, what isn't used while a generation fills goes."""

    #: Bytes of an entry besides its key and value, about.
    ENTRY = 160

    def __init__(self, size_bytes: int):
        self.size, self.young, self.old, self.held = size_bytes, {}, {}, 0

    def forget(self) -> None:
        self.young, self.old, self.held = {}, {}, 0

    def put(self, keys: list, values: list) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.held += self.ENTRY * len(keys) + sum(map(len, keys)) + (sum(map(len, values)) if values and isinstance(values[0], bytes) else 0)

    def missing(self, keys: list) -> list:
        """The keys (distinct) that aren't held; all others are in young afterwards."""
        if self.held > self.size:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        away = [k for k in keys if k not in young]
        found = [k for k in away if k in old]
        self.put(found, [old[k] for k in found])
        return [k for k in away if k not in old] if found else away


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same step, after which the worker gives the memory that it has freed back to the system: idle workers share their executor's memory with the stages that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # steps make many small objects and no cycles; one collection at the end is enough
        try:
            yield from f(batches)
        finally:
            gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return run


_MEMORIES: dict[str, Callable[[], None]] = {}


def claim(name: str, forget: Callable[[], None]) -> None:
    """Called by an operator whose worker remembers things between tasks: the other operators' memories in this worker go."""
    for other, f in _MEMORIES.items():
        if other != name:
            f()
    _MEMORIES[name] = forget


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sampled_ids(df: DataFrame, strata: list[str], bound: int) -> DataFrame:
    """At most bound distinct doc_ids of each stratum, those with the lowest hash: a bounded sample that any rerun repeats.

    Strata are counted first, and a stratum's rows are cut by their hash to little more than the bound where they lie, so
    no task gets more than that of one stratum, whatever its size. Strata are label values or languages.
    """
    from functools import reduce

    from pyspark.sql import Window

    slim = df.select("doc_id", *strata)
    counts = slim.groupBy(*(F.col(c).alias(f"_s_{c}") for c in strata)).agg(F.count("*").alias("_n"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in strata))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = slim.join(F.broadcast(counts), same).where(share * F.col("_n") < 1.2 * bound + 50)
    w = Window.partitionBy(*strata).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    return near.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= bound).select("doc_id", *strata)
