"""What the library needs of a session: a folder that all machines share, and cuts of lineage into it."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder (one machine, as in tests);
    any other master, local-cluster too, is refused, as a machine's own folder is not seen by the rest.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    kept = sc._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="trailmap-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` computed and written to the shared folder: loops grow no lineage and lost executors cost nothing.

    Written by columns and compressed, a fraction of a checkpoint's size. Shuffle files of
    plans that are gone are freed before. Within `passing`, the table goes when that ends.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    gc.collect()
    spark._jvm.System.gc()
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or "void" in df.schema.simpleString():
        return df.checkpoint()
    path = f"{folder}/trailmap-cut-{uuid.uuid4().hex[:12]}"
    _PASSING.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_PASSING: contextvars.ContextVar[list[str]] = contextvars.ContextVar("passing", default=[])


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that are cut within are deleted at the end, but for those that the tables in the given list are read from."""
    own: list[str] = []
    kept: list[DataFrame] = []
    token = _PASSING.set(own)
    try:
        yield kept
    finally:
        _PASSING.reset(token)
        read = {part for df in kept for f in df.inputFiles() for part in f.split("/")}
        for path in own:
            if path.rsplit("/", 1)[-1] in read:
                _PASSING.get().append(path)
            else:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
