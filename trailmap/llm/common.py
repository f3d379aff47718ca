"""What the operators of this subpackage share: paths, materialisation, word coding over Arrow."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmap.session import shared_dir

#: A word is a maximal run of characters that are not ASCII white space.
WORD_GAP = "[ \\t-\\r]+"
#: Text that is worked on at once in a Python worker.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def free_name(taken: list[str], wanted: str) -> str:
    """`wanted`, with as many underscores after it as make it a name that no column has."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of its own under the shared one; `drop_written` knows it."""
    path = f"{shared_dir(spark)}/trailmap-{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_WRITTEN: dict[str, list[str]] = {}


def written(spark: SparkSession) -> list[str]:
    """The folders that operators of this application wrote and that still are there."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_written(spark: SparkSession, *kept: str) -> int:
    """Deletes the tables and files that operators of this application wrote to the shared folder, but for those `kept`.

    For the time when their results have been written or aren't wanted any more: results are
    lazy and read these tables. Returns how many folders went.
    """
    listed = _WRITTEN.get(spark.sparkContext.applicationId, [])
    name = lambda p: p.rstrip("/").rsplit("/", 1)[-1]
    names = {name(p) for p in kept}  # Spark names a folder's scheme whether or not it was given; the last part is its own
    gone = [p for p in listed if name(p) not in names]
    for path in gone:
        delete(spark, path)
    listed[:] = [p for p in listed if name(p) in names]
    return len(gone)


def delete(spark: SparkSession, path: str) -> None:
    if not path:
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed within goes to Python a few MB at a time; a batch may otherwise hold 10,000 texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(CHUNK_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; when they are over, the worker, which stays for other tasks, gives its free memory back."""
    import ctypes
    import ctypes.util

    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def in_buckets(df: DataFrame, buckets: int, column: str = "bucket") -> DataFrame:
    """Each bucket in a partition of its own: by hash, several would share one and others stay empty."""
    return df.repartitionById(buckets, F.col(column))


def release(spark: SparkSession) -> None:
    """Frees disk: Spark deletes finished steps' shuffle files when the driver's garbage collection finds their plans gone."""
    gc.collect()
    spark._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> bool:
    """The driver's Java process gives memory that its native code has freed back, where its Java can (on Linux, from 17.0.9 on); whether it did."""
    made, jvm = spark.sparkContext._gateway.new_array, spark._jvm
    kind = jvm.java.lang.Class.forName

    def array(of, *values):
        out = made(of, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    try:  # by the interface's method, as the server's own class isn't open to calls from outside
        types = map(kind, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        invoke = kind("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *types))
        given = (jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", made(jvm.java.lang.Object, 0), made(jvm.java.lang.String, 0))
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, *given))
    except Py4JError:
        return False
    return True


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and reread: lineage ends there and lost executors cost nothing."""
    release(df.sparkSession)
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_of(df: DataFrame) -> str:
    """Where a table that `materialise` gave lies; '' if it has no rows' files."""
    files = df.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else ""


def checkpointed(df: DataFrame) -> DataFrame:
    """Like materialise, for rows of large binaries, of which a columnar reader would hold thousands at once."""
    shared_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint()


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """About how much text there is: from the files' sizes, or counted where the plan doesn't know."""
    known = int(str(df.select(column)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 2 * known if known < 1 << 55 else df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most about `most` bytes of text (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of the texts as codes into an array of distinct words.

    Returns the codes of all words one after another, where each text's words begin in
    them (one entry more than texts), and the distinct words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    offsets -= offsets[0]
    codes, distinct = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    none = pc.index(distinct, "").as_py()
    if none >= 0:  # splits leave one where a text begins or ends with white space
        keep = codes != none
        offsets = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))[offsets]
        codes = codes[keep]
    return codes, offsets, distinct


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Like `coded_words`, with the distinct words as a list."""
    codes, offsets, distinct = coded_words(texts)
    return codes, offsets, distinct.to_pylist()


def hash_words(distinct: list[str], seen: dict[str, int], most: int = 400_000) -> np.ndarray:
    """64-bit hashes of words; `seen` keeps them between calls and is emptied when it has `most`."""
    import xxhash

    if len(seen) > most:
        seen.clear()
    out = np.empty(len(distinct), np.uint64)
    digest = xxhash.xxh3_64_intdigest
    for i, w in enumerate(distinct):
        h = seen.get(w)
        if h is None:
            seen[w] = h = digest(w)
        out[i] = h
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each (start, count), one run after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    out = np.repeat(starts - (ends - counts), counts)
    out += np.arange(total)
    return out
