"""Event store of sorted runs, described by one committed manifest.

Events are dealt to a fixed number of buckets by their key. A batch adds one run, a folder ``events/batch=<n>/bucket=<b>`` with
the rows it changed; the newest row of a key over all runs of its bucket is its state. When a bucket has
gathered too many runs, the small ones are merged, and larger ones only once the small ones weigh about as much, so the
bytes written per poll follow the size of the poll. Logs (one row per poll, one per change notice) are runs of one bucket.

``manifest/batch=<n>.json`` names the runs with their row counts, the keys of the last bulletin and the fold of the poll log so far;
``manifest/current`` names the newest batch and is replaced as a whole. Readers look at nothing else: folders of a batch that is not
committed do not exist for them, and a batch that is run again starts from the manifest before it. ``refused`` has one row per poll
that was set aside; such a poll commits nothing.
"""

from __future__ import annotations

import json
from copy import deepcopy
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake import schemas
from emberlake.operators.lifecycle import KEY

BUCKETS = 16
MOST_RUNS = 8
# A run: an event as a batch left it, and what that batch did.
EVENTS = T.StructType(
    [
        *schemas.EVENTS.fields,
        T.StructField("action", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("step", T.IntegerType()),
    ]
)
SCHEMAS = {
    "events": EVENTS,
    "bulletin": T.StructType([f for f in schemas.EVENTS.fields if f.name in KEY]),
    "poll_log": schemas.POLL_LOG,
    "change_log": schemas.CHANGE_LOG,
    "refused": T.StructType([T.StructField(n, T.StringType()) for n in ("poll_id", "source", "reason")]),
}
ORDER = ["batch", "step"]
CLOSINGS = T.StructField("closings", T.LongType())


@dataclass
class Manifest:
    """What the store holds after a batch. ``runs`` lists [folder, rows] per table and bucket, oldest first."""

    batch: int = -1
    previous: int | None = None
    buckets: int = BUCKETS
    runs: dict[str, dict[str, list[list]]] = field(default_factory=dict)
    bulletin: str | None = None
    polls: dict[str, dict] = field(default_factory=dict)
    # runs, and sources and years, that no snapshot has yet
    unsaved: list[str] = field(default_factory=list)
    touched: list[list] = field(default_factory=list)
    snapshot: int | None = None

    def add(self, table: str, folder: str, rows: dict[str, int]) -> None:
        for bucket, n in rows.items():
            self.runs.setdefault(table, {}).setdefault(bucket, []).append([folder, n])


# --- manifest files ----------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file and put it in its place, so that readers see the old text or the new one."""
    fs, p = _fs(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    beside = hadoop.Path(f"{path}.new")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(p), how)


def load(spark: SparkSession, root: str, before: int | None = None) -> Manifest | None:
    """The newest committed manifest, or the newest of a batch below ``before``."""
    text = _read_text(spark, f"{root}/manifest/current")
    at = int(text) if text else None
    while at is not None:
        found = Manifest(**json.loads(_read_text(spark, f"{root}/manifest/batch={at}.json")))
        if before is None or found.batch < before:
            return found
        at = found.previous
    return None


def begin(spark: SparkSession, root: str, batch_id: int, buckets: int = BUCKETS) -> Manifest:
    """The manifest a batch builds on: a copy of the one before, or an empty one with ``buckets`` buckets."""
    known = load(spark, root, before=batch_id)
    if known is None:
        return Manifest(batch=batch_id, buckets=buckets)
    new = deepcopy(known)
    new.batch, new.previous = batch_id, known.batch
    return new


def commit(spark: SparkSession, root: str, manifest: Manifest) -> None:
    _write_text(spark, f"{root}/manifest/batch={manifest.batch}.json", json.dumps(asdict(manifest)))
    _write_text(spark, f"{root}/manifest/current", str(manifest.batch))


def last_committed(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    known = load(spark, root, before)
    return None if known is None else known.batch


# --- runs --------------------------------------------------------------------------------------


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def write_folder(rows: DataFrame, root: str, table: str, name: str) -> str:
    """Write rows as ``<table>/<name>``, a plain folder, and return its name below the root."""
    written = rows.select(*SCHEMAS[table].fieldNames()).write.mode("overwrite")
    written.option("compression", "zstd").parquet(f"{root}/{table}/{name}")
    return f"{table}/{name}"


def write_events(rows: DataFrame, root: str, name: str, buckets: int) -> tuple[str, dict[str, int]]:
    """Write a run of events by bucket; return its folder and the rows per bucket.

    Rows of a bucket come to one task, unless they are many: then the rebalance hint splits them. ``closings`` is kept beside
    the event columns where rows have it, for ``written_changes``.
    """
    target = f"{root}/events/{name}"
    names = [*EVENTS.fieldNames(), *[c for c in rows.columns if c == "closings"]]
    placed = rows.select(*names, bucket_of(buckets).alias("bucket")).hint("rebalance", "bucket")
    writer = placed.sortWithinPartitions("bucket", *KEY).write.mode("overwrite").partitionBy("bucket")
    writer.option("compression", "zstd").parquet(target)
    return f"events/{name}", _rows_per_bucket(rows.sparkSession, target)


def written_changes(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """The rows of a run just written, with their ``closings``."""
    return spark.read.schema(T.StructType([*EVENTS.fields, CLOSINGS])).parquet(f"{root}/{folder}")


def _rows_per_bucket(spark: SparkSession, target: str) -> dict[str, int]:
    stored = spark.read.schema("action string, bucket int").parquet(target)
    return {str(r["bucket"]): r["count"] for r in stored.groupBy("bucket").count().collect()}


def _empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def read_runs(
    spark: SparkSession, root: str, manifest: Manifest | None, table: str, buckets: list[str] | None = None
) -> DataFrame:
    """All rows of the runs of a table, or of some of its buckets: only their folders are named to the scan."""
    runs = manifest.runs.get(table, {}) if manifest else {}
    chosen = sorted(runs) if buckets is None else [b for b in buckets if b in runs]
    if table == "events":
        folders = [f"{root}/{folder}/bucket={b}" for b in chosen for folder, _ in runs[b]]
    else:
        folders = [f"{root}/{folder}" for b in chosen for folder, _ in runs[b]]
    if not folders:
        return _empty(spark, table)
    return spark.read.schema(SCHEMAS[table]).parquet(*sorted(set(folders)))


def read_table(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame:
    """Committed rows of a log, or of ``refused``."""
    if table == "refused":
        fs, p = _fs(spark, f"{root}/refused")
        return spark.read.schema(SCHEMAS[table]).parquet(f"{root}/refused/*") if fs.exists(p) else _empty(spark, table)
    manifest = load(spark, root, before)
    if table == "bulletin":
        folder = manifest.bulletin if manifest else None
        return spark.read.schema(SCHEMAS[table]).parquet(f"{root}/{folder}") if folder else _empty(spark, table)
    return read_runs(spark, root, manifest, table)


def newest(rows: DataFrame) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in KEY]
    latest = F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("v")
    return rows.groupBy(*KEY).agg(latest).select(*KEY, "v.*")


def read_state(
    spark: SparkSession,
    root: str,
    before: int | None = None,
    keys: DataFrame | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """The event table after all committed batches below ``before``, or its key and some ``columns``: no others are shuffled.

    With ``keys`` only those events are read: from their buckets alone, of which there are at most as many as the
    driver's manifest names, and filtered by key before anything is shuffled.
    """
    manifest = load(spark, root, before)
    buckets = None
    if keys is not None and manifest is not None:
        numbers = keys.select(bucket_of(manifest.buckets).alias("b")).distinct().collect()
        buckets = sorted(str(r["b"]) for r in numbers)
    names = [n for n in schemas.EVENTS.fieldNames() if columns is None or n in (*KEY, *columns)]
    rows = read_runs(spark, root, manifest, "events", buckets).select(*names, *ORDER)
    if keys is not None:
        rows = rows.join(keys.select(*KEY).distinct(), KEY, "left_semi")
    return newest(rows).select(*names)


def merge_from(runs: list[list], most: int = MOST_RUNS) -> int | None:
    """From which run on a list is to be merged, if at all.

    A run joins in while it has at most twice the rows of those after it; the list must come down to ``most``.
    """
    if len(runs) <= most:
        return None
    start, total = len(runs) - 1, runs[-1][1]
    while start and (runs[start - 1][1] <= 2 * total or start >= most):
        start -= 1
        total += runs[start][1]
    return start


def merge_runs(spark: SparkSession, root: str, manifest: Manifest, most: int = MOST_RUNS) -> bool:
    """Merge the runs of all buckets and logs that have too many, note it in the manifest and tell whether there were any."""
    merged = False
    for table, by_bucket in manifest.runs.items():
        due = {b: at for b, runs in by_bucket.items() if (at := merge_from(runs, most)) is not None}
        if not due:
            continue
        parts = Manifest(runs={table: {b: by_bucket[b][at:] for b, at in due.items()}}, buckets=manifest.buckets)
        rows = read_runs(spark, root, parts, table)
        name = f"merge={manifest.batch}"
        if table == "events":
            folder, sizes = write_events(newest(rows), root, name, manifest.buckets)
        else:
            folder, sizes = write_folder(rows.coalesce(1), root, table, name), {"0": sum(n for _, n in by_bucket["0"][due["0"]:])}
        for b, at in due.items():
            by_bucket[b][at:] = [[folder, sizes[b]]]
        merged = True
    return merged


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete manifests but the newest ``keep``, and runs and bulletins that these do not name; return how many folders went."""
    known, at = [], load(spark, root)
    while at is not None:
        known.append(at)
        at = load(spark, root, before=at.batch) if len(known) < max(1, keep) else None
    used = {m.bulletin for m in known} | {f for m in known for t in m.runs.values() for r in t.values() for f, _ in r}
    used |= {f for m in known for f in m.unsaved}
    fs, _ = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    gone = 0
    for table in ("events", "bulletin", "poll_log", "change_log"):
        for name in _names(spark, f"{root}/{table}"):
            # a batch that is still being written has a higher number
            if f"{table}/{name}" not in used and int(name.split("=")[1]) <= known[0].batch:
                gone += bool(fs.delete(path(f"{root}/{table}/{name}"), True))
    for name in _names(spark, f"{root}/manifest"):
        number = name.removeprefix("batch=").removesuffix(".json")
        if number.isdigit() and int(number) < known[-1].batch:
            fs.delete(path(f"{root}/manifest/{name}"), True)
    return gone


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
