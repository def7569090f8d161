"""Versioned snapshot tables with an index of their files.

Below the root, ``data/v=<n>/source=<s>/year=<y>`` holds the rows that version n wrote, and ``files/v=<n>`` one row per file that
belongs to the version: its path, source, year, number of rows, range of starts and bounding box. A version takes over
the files of partitions it did not touch from the one before, so a small change rewrites only the sources and years it is about.
The index is written last and makes the version exist. Readers follow the newest one; boxes, years and pages pick their files from it.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake import schemas
from emberlake.functions import geometry
from emberlake.operators import filters

LAYOUT = ("source", "year")
FILES = (
    "path string, source string, year int, rows long, first_at timestamp, last_at timestamp, "
    "minx double, miny double, maxx double, maxy double"
)
# Bits per axis of the cells that lay rows out within a year.
CELL_BITS = 10


def _folder(spark: SparkSession, path: str):
    """(file system, path object) of a folder, whatever storage it is on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Completed versions, oldest first. A version without its index does not exist."""
    fs, _ = _folder(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = [n for n in _names(spark, f"{root}/files") if n.startswith("v=")]
    return sorted(int(n[2:]) for n in found if fs.exists(path(f"{root}/files/{n}/_SUCCESS")))


def cell_number(geom: Column) -> Column:
    """Number of the cell of a box's middle along a curve that keeps neighbours together."""

    def spread(position: Column, span: float) -> Column:
        n = F.floor((position / span + 0.5) * (1 << CELL_BITS)).cast("bigint")
        n = F.least(F.greatest(n, F.lit(0)), F.lit((1 << CELL_BITS) - 1))
        # every other bit is left free for the other axis
        return sum((F.shiftright(n, b).bitwiseAND(F.lit(1)) * (1 << (2 * b)) for b in range(CELL_BITS)), F.lit(0))

    x, y = (geom["minx"] + geom["maxx"]) / 2, (geom["miny"] + geom["maxy"]) / 2
    return spread(x, 360.0) + 2 * spread(y, 180.0)


def _write_data(rows: DataFrame, root: str, version: int, files: int | None) -> None:
    """Rows by source and year; ranges of cells make files compact in space, and files are in order of start.

    A source or a cell that holds most rows is spread over tasks by start and id.
    """
    placed = rows.withColumn("year", F.year("starts_at")).withColumn("_cell", cell_number(F.col("geom")))
    by = [*LAYOUT, "_cell", "starts_at", "id"]
    placed = placed.repartitionByRange(files, *by) if files else placed.repartitionByRange(*by)
    (
        placed.drop("_cell")
        .sortWithinPartitions(*LAYOUT, "starts_at")
        .write.mode("overwrite")
        .partitionBy(*LAYOUT)
        .option("compression", "zstd")
        .parquet(f"{root}/data/v={version}")
    )


def _stored(extra: list[T.StructField] | None = None) -> T.StructType:
    return T.StructType([*schemas.SNAPSHOT.fields, *(extra or []), T.StructField("year", T.IntegerType())])


def _index_of(spark: SparkSession, root: str, version: int) -> DataFrame:
    """Index rows of the files a version wrote itself; only the starts and boxes are read."""
    if not any(n.startswith("source=") for n in _names(spark, f"{root}/data/v={version}")):
        return spark.createDataFrame([], FILES)
    rows = spark.read.schema(_stored()).option("basePath", f"{root}/data").parquet(f"{root}/data/v={version}")
    path = F.regexp_extract(F.col("_metadata.file_path"), r"(v=\d+/source=[^/]*/year=[^/]*/[^/]+)$", 1)
    box = {c: F.col(f"geom.{c}") for c in ("minx", "miny", "maxx", "maxy")}
    return rows.groupBy(path.alias("path"), *LAYOUT).agg(
        F.count("*").alias("rows"), F.min("starts_at").alias("first_at"), F.max("starts_at").alias("last_at"),
        F.min(box["minx"]).alias("minx"), F.min(box["miny"]).alias("miny"),
        F.max(box["maxx"]).alias("maxx"), F.max(box["maxy"]).alias("maxy"),
    )


def _commit(index: DataFrame, root: str, version: int) -> str:
    target = f"{root}/files/v={version}"
    index.coalesce(1).write.mode("overwrite").parquet(target)
    return target


def write_snapshot(rows: DataFrame, root: str, version: int, files: int | None = None) -> str:
    """Write all rows as a new version. The same version number overwrites itself.

    ``files`` sets how many ranges the rows are cut into; by default the session's shuffle partitions decide.
    """
    _write_data(rows, root, version, files)
    return _commit(_index_of(rows.sparkSession, root, version), root, version)


def update_snapshot(
    changed: DataFrame, touched: Collection[tuple[str, int]], root: str, version: int, files: int | None = None
) -> str:
    """Write a version that differs from the one before in the given rows.

    ``changed`` holds the new state of the changed events. ``touched`` names every (source, year) that one of them was in.
    Only these and the ones they are in now are read and written; all other files are shared with the version before.
    """
    spark = changed.sparkSession
    earlier = [v for v in versions(spark, root) if v < version]
    if not earlier:
        return write_snapshot(changed, root, version, files)
    index = files_of(spark, root, earlier[-1])
    where_now = changed.select("source", F.year("starts_at").alias("year")).distinct().collect()
    inside = F.lit(False)
    for source, year in sorted({*touched, *((r["source"], r["year"]) for r in where_now)}):
        inside = inside | ((F.col("source") == source) & (F.col("year") == year))
    before = _read(spark, root, index.where(inside), None).select(*schemas.SNAPSHOT.fieldNames())
    key = ["source", "external_id"]
    rows = before.join(changed.select(*key), key, "left_anti").select(*schemas.SNAPSHOT.fieldNames())
    _write_data(rows.unionByName(changed.select(*schemas.SNAPSHOT.fieldNames())), root, version, files)
    return _commit(index.where(~inside).unionByName(_index_of(spark, root, version)), root, version)


def files_of(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The index of a version."""
    return spark.read.schema(FILES).parquet(f"{root}/files/v={version}")


def _read(
    spark: SparkSession, root: str, index: DataFrame, extra: list[T.StructField] | None, whole: bool = False
) -> DataFrame:
    """Rows of the files of an index. ``whole`` partitions are named by folder, else file by file.

    The driver gets the names it reads from, as it does when it lists a folder.
    """
    name = F.regexp_replace("path", "/[^/]+$", "") if whole else F.col("path")
    names = sorted(r["n"] for r in index.select(name.alias("n")).distinct().collect())
    stored = _stored(extra)
    if not names:
        return spark.createDataFrame([], stored)
    rows = spark.read.schema(stored).option("basePath", f"{root}/data").parquet(*[f"{root}/data/{n}" for n in names])
    return rows.select(*stored.fieldNames())


def read_snapshot(
    spark: SparkSession,
    root: str,
    version: int | None = None,
    source: str | None = None,
    years: tuple[int, int] | None = None,
    extra: list[T.StructField] | None = None,
    bbox: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """The newest (or given) snapshot under its fixed schema; empty when there is none.

    ``source`` and the inclusive ``years`` of the start select folders before any file is opened. With ``bbox`` only files
    whose bounding box meets it are read, and of their rows those whose geometry does.
    """
    fields = [*schemas.SNAPSHOT.fields, *(extra or [])]
    known = versions(spark, root)
    if version is None and known:
        version = known[-1]
    if version is None or version not in known:
        return spark.createDataFrame([], T.StructType(fields))
    index = files_of(spark, root, version)
    if source is not None:
        index = index.where(F.col("source") == source)
    if years is not None:
        index = index.where(F.col("year").between(*years))
    if bbox is not None:
        box = F.struct("minx", "miny", "maxx", "maxy")
        index = index.where(geometry.boxes_overlap(box, bbox))
    rows = _read(spark, root, index, extra, whole=bbox is None)
    # the comparisons on the partition columns stay visible to the planner
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if years is not None:
        rows = rows.where(F.col("year").between(*years))
    rows = rows.select(*[f.name for f in fields])
    return rows if bbox is None else filters.filter_bbox(rows, bbox)


def read_page(
    spark: SparkSession,
    root: str,
    limit: int = 100,
    after: tuple[dt.datetime, str] | None = None,
    extra: list[T.StructField] | None = None,
) -> DataFrame:
    """One keyset page of the newest snapshot, newest first, of ``limit`` rows plus one.

    The row counts of the index tell from which start on the files hold enough rows for the page; files that end before are
    not opened.
    """
    fields = [*schemas.SNAPSHOT.fields, *(extra or [])]
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], T.StructType(fields))
    index = files_of(spark, root, known[-1])
    if after is not None:
        index = index.where(F.col("first_at") <= F.lit(after[0]))
    # a file that reaches the key itself may hold rows of earlier pages, so it does not count
    sure = index if after is None else index.where(F.col("last_at") < F.lit(after[0]))
    counts = sure.groupBy(F.col("first_at")).agg(F.sum("rows").alias("n")).orderBy(F.desc("first_at"))
    have, start = 0, None
    for r in counts.toLocalIterator():
        have += r["n"]
        if have > limit:
            start = r["first_at"]
            break
    if start is not None:
        index = index.where(F.col("last_at") >= F.lit(start))
    rows = _read(spark, root, index, extra).select(*[f.name for f in fields])
    return filters.page_after(rows, limit=limit, after=after)


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions and the data that these do not use; return how many folders went."""
    known = versions(spark, root)
    kept = known[-max(1, keep):]
    used = set()
    for version in kept:
        folder = F.regexp_replace("path", "/[^/]+$", "")
        used |= {r["f"] for r in files_of(spark, root, version).select(folder.alias("f")).distinct().collect()}
    fs, _ = _folder(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    gone = 0
    for version in known[: -max(1, keep)]:
        fs.delete(path(f"{root}/files/v={version}"), True)
    for v in _names(spark, f"{root}/data"):
        if not v.startswith("v=") or int(v[2:]) > kept[-1]:
            continue
        for source in _names(spark, f"{root}/data/{v}"):
            for year in _names(spark, f"{root}/data/{v}/{source}") if source.startswith("source=") else []:
                if f"{v}/{source}/{year}" not in used:
                    gone += bool(fs.delete(path(f"{root}/data/{v}/{source}/{year}"), True))
    return gone
