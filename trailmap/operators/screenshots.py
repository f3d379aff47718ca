"""Pictures of routes: where they are kept, how far they are, their addresses; taking one is the caller's function."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what a marker says, the best first; the size of a picture, and times in seconds
STATES = (("png", "ready"), ("capturing", "capturing"), ("pending", "waiting"))
VIEWPORT, LOADED_WITHIN, SETTLED_AFTER, ANSWERS_WITHIN = (1920, 1080), 30.0, 0.8, 5.0


class NotSupported(RuntimeError):
    """No browser is at hand: the caller must bring a function that takes a picture."""


def led(route: Column) -> Column:
    return F.when(route.startswith("/"), route).otherwise(F.concat(F.lit("/"), route))


def file_of(analysis: Column, journey: Column, route: Column, ending: str = "png") -> Column:
    """A marker's or picture's place below the storage root: hashes of the analysis, the journey and the route."""
    return F.concat_ws("/", F.sha1(analysis), F.sha1(journey), F.concat(F.sha1(led(route)), F.lit(f".{ending}")))


def status_of(endings: Column) -> Column:
    """What an array of markers' endings says: the best one counts."""
    out = F.lit("missing")
    for ending, state in reversed(STATES):
        out = F.when(F.array_contains(endings, ending), state).otherwise(out)
    return out


def statuses(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """`wanted` (analysis, journey, route) with `status`, from the paths of existing files (path)."""
    stem = r"([0-9a-f]{40}/[0-9a-f]{40}/[0-9a-f]{40})\.(\w+)\z"
    met = files.select(F.regexp_extract("path", stem, 1).alias("_stem"), F.regexp_extract("path", stem, 2).alias("_e")).where("_stem <> ''").groupBy("_stem").agg(F.collect_set("_e").alias("_endings"))
    rows = wanted.withColumn("_stem", F.regexp_replace(file_of(F.col("analysis"), F.col("journey"), F.col("route")), r"\.png\z", ""))
    none = F.expr("cast(array() as array<string>)")
    return rows.join(met, "_stem", "left").withColumn("status", status_of(F.coalesce("_endings", none))).drop("_stem", "_endings")


def public_url(base: str, analysis: Column, journey: Column, route: Column) -> Column:
    """The address under which a picture is served; each part percent-encoded."""
    encoded = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return F.concat_ws("/", F.lit(base.rstrip("/")), F.lit("screenshots"), encoded(analysis), encoded(journey), encoded(F.regexp_replace(route, "^/", "")))


def pictures(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the pictures below a storage root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root).select("path", "content")


def reachable(url: str, within: float = ANSWERS_WITHIN) -> bool:
    """Whether something answers well at an address."""
    try:
        with urllib.request.urlopen(url, timeout=within) as answer:
            return 200 <= answer.status < 300
    except (OSError, ValueError):
        return False


def captured(wanted: DataFrame, base: str, shoot: Callable[[str], bytes] | None = None, probe: Callable[[str], bool] = reachable) -> DataFrame:
    """`wanted` (analysis, journey, route) with `png`, null where a picture failed; one failure is no other's.

    `shoot` gets an address and gives a picture; it runs in tasks.
    """
    if shoot is None:
        raise NotSupported("no function was given that takes a picture")
    if not probe(base):
        raise NotSupported(f"nothing answers at {base}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for route in pdf["route"]:
                try:
                    found.append(shoot(base.rstrip("/") + (route if route.startswith("/") else f"/{route}")))
                except Exception:  # whatever a browser raises
                    found.append(None)
            yield pdf.assign(png=found)

    return wanted.select("analysis", "journey", "route").mapInPandas(run, "analysis string, journey string, route string, png binary")
