"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

A document is the set of its distinct shingles (runs of ``shingle_words`` lower-cased words; a shorter document is one
shingle). Documents with equal sets form one node, so copies never pair up. Nodes that share a band of their
signatures are candidates; the number of bands follows from the chosen ``miss`` probability at the threshold. Candidates
are compared in batches of signature rows and dropped as soon as the posterior probability (uniform prior) that
they reach the threshold is below ``miss``. Survivors are confirmed on their full sets.

Within a bucket not all pairs are made. First a few pivots per bucket are compared with all its members, and links join
components. Buckets that still hold several components come second. Up to ``SMALL`` members are compared pair by
pair. A crowded bucket is measured against a reference set instead (what most of its hub's neighbours have): members whose sets
differ from it by D and E have ``|D ^ E|`` in which they differ from each other, so the threshold sets how many
elements D and E must share. Members that need none are all linked to the one closest to the reference. Any
other link shows up among the first elements of D and E (the prefix filter), rare ones first. That is exact, so no
link between components is lost, and members that only share what all share never meet.

Documents without words are linked with nothing. Rows without an id are not linked: their
component is null and they are kept. Rows that share an id are one document: they stay or go together. Other columns of any
name do not matter to ``linked``; ``kept_rows`` returns the input's own columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.common import LOWER_CHARS, text_of, words_of
from emberlake.operators.components import components
from emberlake.session import materialised

BAND_ROWS = 5
BATCH_ROWS = 32
PIVOTS = 3
SMALL = 16
# neighbours that vote on a reference set; any reference gives the same links
VOTERS = 31
MISS = 1e-8
SEED = 20_000_003


def band_count(threshold: float, rows: int, miss: float) -> int:
    """Bands needed so that a pair at the threshold shares none with at most the miss probability."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows)))


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches among n rows that leave a posterior of at least ``miss`` of reaching the threshold.

    With a uniform prior the posterior after m matches is the probability that a binomial of n + 1 trials at the
    threshold is at most m.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(tokens: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a list array of words."""
    coded = tokens.flatten().dictionary_encode()
    lowered = [w.translate(LOWER_CHARS).encode("utf-8") for w in coded.dictionary.to_pylist()]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in lowered], np.uint64)
    words = hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64)
    n = len(words)
    # position-dependent mixing: the same words in another order are another shingle
    runs = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        runs = _mix(runs + np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k]) if len(runs) else runs
    ends = tokens.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(a, b):
                whole = _mix(whole + np.uint64(0x9E3779B97F4A7C15) + words[k : k + 1])
            out.append(_mix(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(shingles.tobytes())


def signatures(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """MinHash signatures (sets x rows) of non-empty sets, 32 bits a row."""
    draw = np.random.default_rng(SEED)
    a = draw.integers(1, 1 << 32, rows, dtype=np.uint64) | np.uint64(1)
    b = draw.integers(0, 1 << 32, rows, dtype=np.uint64)
    starts = np.cumsum([0] + [len(s) for s in sets])[:-1]
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    x = (x >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), rows), np.uint32)
    for k in range(rows if sets else 0):
        out[:, k] = np.minimum.reduceat(x * np.uint32(a[k]) + np.uint32(b[k]), starts)
    return out


def _parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges with about ``most`` words each."""
    ends = batch.column(column).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(ends[at + 1 :], ends[at] + most, side="right")))
        yield at, min(n, batch.num_rows - at)
        at += n


def _signed(df: DataFrame, doc_id: str, text: str, size: int, rows: int) -> DataFrame:
    """(id, n, node, sig) per row."""
    schema = T.StructType(
        [
            T.StructField("id", df.schema[doc_id].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("node", T.StringType()),
            T.StructField("sig", T.BinaryType()),
        ]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _parts(batch, 1, 500_000):
                sets = shingle_sets(batch.column(1).slice(at, n), size)
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, rows).astype("<u4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.string()),
                        pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    schema.names,
                )

    return df.select(F.col(f"`{doc_id}`").alias("id"), words_of(text_of(f"`{text}`")).alias("w")).mapInArrow(sign, schema)


def _sets(df: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(nid, set): the full sets of the wanted nodes (nid, node, rep)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _parts(batch, 2, 500_000):
                sets = shingle_sets(batch.column(2).slice(at, n), size)
                nodes = batch.column(1).slice(at, n).to_pylist()
                nids = batch.column(0).slice(at, n).to_pylist()
                # an id may come with other texts, too
                own = [i for i, s in enumerate(sets) if set_key(s) == nodes[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nids[i] for i in own], pa.int64()), pa.array([sets[i].tobytes() for i in own], pa.binary())],
                    ["nid", "set"],
                )

    body = df.select(F.col(f"`{doc_id}`").alias("rep"), text_of(f"`{text}`").alias("t"))
    joined = body.join(wanted, "rep").select("nid", "node", words_of(F.col("t")).alias("w"))
    return joined.mapInArrow(build, "nid long, set binary").groupBy("nid").agg(F.first("set").alias("set"))


def _pruned(pairs: DataFrame, rows: int, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b, sa, sb) whose signatures keep the posterior up, compared batch by batch."""
    steps = [(n, least_matches(n, threshold, miss)) for n in [*range(BATCH_ROWS, rows, BATCH_ROWS), rows]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(batch.num_rows, -1) for k in (2, 3)
            )
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in steps:
                matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(alive)) for k in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) among pairs (a, b, xa, xb) by the exact similarity of the full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                # the sizes alone bound the similarity
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    own.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(own, pa.int64())) for k in (0, 1)], ["u", "v"])

    return pairs.select("a", "b", "xa", "xb").mapInArrow(confirm, "u long, v long")


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, rows: int, percent: int, miss: float) -> DataFrame:
    """The confirmed links among candidate pairs (a, b), written out."""
    sig_a, sig_b = (nodes.select(F.col("nid").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab")
    left = materialised(_pruned(pairs.join(sig_a, "a").join(sig_b, "b"), rows, percent / 100, miss), "survivors")
    set_a, set_b = (sets.select(F.col("nid").alias(c), F.col("set").alias(f"x{c}")) for c in "ab")
    return materialised(_confirmed(left.join(set_a, "a").join(set_b, "b"), percent), "links")


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nid, label) of all candidate nodes, written out."""
    known = components(edges).withColumnRenamed("node", "nid")
    return materialised(
        nodes.select("nid").join(known, "nid", "left").select("nid", F.coalesce("label", "nid").alias("label")), "labels"
    )


def _pivot_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of every bucket with a few of them."""
    pivots = [F.min_by("nid", F.xxhash64("nid", F.lit(k))) for k in range(PIVOTS)]
    chosen = buckets.groupBy("key").agg(F.array_distinct(F.array(*pivots)).alias("p"))
    stars = buckets.join(chosen, "key").select("nid", F.explode("p").alias("p")).where("nid <> p")
    return stars.select(F.least("nid", "p").alias("a"), F.greatest("nid", "p").alias("b")).distinct()


def _references(spokes: DataFrame, edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(h, ref): for each hub the shingles that most of it and some of its neighbours have."""
    hubs = spokes.select("h").distinct()
    near = edges.select(F.col("u").alias("h"), F.col("v").alias("nid")).unionByName(
        edges.select(F.col("v").alias("h"), F.col("u").alias("nid"))
    )
    rank = F.row_number().over(Window.partitionBy("h").orderBy("nid"))
    voters = near.join(hubs, "h", "left_semi").distinct().withColumn("k", rank).where(F.col("k") < VOTERS).select("h", "nid")
    voters = voters.unionByName(hubs.select("h", F.col("h").alias("nid")))

    def vote(table: pa.Table) -> pa.Table:
        every = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        shingles, n = np.unique(np.concatenate(every), return_counts=True)
        ref = shingles[2 * n > len(every)]
        return pa.table({"h": table.column("h").slice(0, 1), "ref": pa.array([ref.tobytes()], pa.binary())})

    return voters.join(sets, "nid").select("h", "set").groupBy("h").applyInArrow(vote, "h long, ref binary")


def _merged(spokes: DataFrame, references: DataFrame, percent: int) -> DataFrame:
    """The spokes with the hubs of a component dealt to its largest one, where their references are as close as linked sets.

    Buckets of one crowd share most members, and any reference gives the same links, so a member is measured once
    instead of once per bucket. All members of a bucket stay together.
    """
    hubs = spokes.groupBy("h").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("nid") == F.col("h"), F.col("label"))).alias("label")
    )
    largest = hubs.groupBy("label").agg(F.max_by("h", F.struct(F.col("n"), -F.col("h"))).alias("b"))
    own, other = (references.select(F.col("h").alias(c), F.col("ref").alias(f"x{c}")) for c in "ab")
    asked = hubs.join(largest, "label").where("h <> b").select(F.col("h").alias("a"), "b")
    close = _confirmed(asked.join(own, "a").join(other, "b"), percent).withColumnsRenamed({"u": "h", "v": "into"})
    return spokes.join(close, "h", "left").select(F.coalesce("into", "h").alias("h"), "nid", "label").distinct()


def _differences(spokes: DataFrame, references: DataFrame, sets: DataFrame, kappa: float) -> DataFrame:
    """Spokes with the elements ``d`` in which they differ from the reference and their excess ``e``.

    What a set has beyond the reference comes first: it is rarer than what it lacks.
    """
    schema = T.StructType([*spokes.schema.fields, T.StructField("e", T.DoubleType()), T.StructField("d", T.ArrayType(T.LongType()))])
    names = spokes.columns

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, d = [], []
            for ref, own in zip(batch.column(len(names)), batch.column(len(names) + 1), strict=True):
                ref, own = np.frombuffer(ref.as_py(), np.uint64), np.frombuffer(own.as_py(), np.uint64)
                parts = np.concatenate([np.setdiff1d(own, ref, True), np.setdiff1d(ref, own, True)])
                e.append(len(parts) - kappa * len(own))
                d.append(parts.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(e, pa.float64()), pa.array(d, pa.list_(pa.int64()))], schema.names
            )

    joined = spokes.join(references, "h").join(sets, "nid").select(*names, "ref", "set")
    return materialised(joined.mapInArrow(differ, schema), "differences")


def _crowded_pairs(members: DataFrame, edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that hold all links between components in crowded buckets."""
    kappa = (100 - percent) / (100 + percent)
    degree = edges.select(F.explode(F.array("u", "v")).alias("nid")).groupBy("nid").agg(F.count("*").alias("n"))
    hubs = (
        members.join(degree, "nid", "left")
        .groupBy("key")
        .agg(F.max_by("nid", F.struct(F.coalesce("n", F.lit(0)), -F.col("nid"))).alias("h"))
    )
    spokes = members.join(hubs, "key").select("h", "nid", "label").distinct()
    spokes = materialised(spokes, "spokes")
    references = materialised(_references(spokes, edges, sets), "references")
    spokes = materialised(_merged(spokes, references, percent), "spokes")
    found = _differences(spokes, references, sets, kappa)
    # Two members are linked if they share at least (e + e') / 2 of their differences. The slack keeps rounding safe.
    slack = 1e-6
    best = found.groupBy("h").agg(
        F.min_by(F.struct(F.col("nid").alias("m"), F.col("label").alias("lm"), F.col("e").alias("em")), F.struct("e", "nid")).alias("best"),
        F.max(F.size("d") - F.col("e")).alias("widest"),
    )
    found = found.join(best, "h").select("h", "nid", "label", "e", "d", "best.*", "widest")
    free = F.col("e") + F.col("em") <= slack
    found = found.withColumn("light", free | (F.col("label") == F.col("lm")))
    stars = found.where(free & (F.col("nid") != F.col("m")) & (F.col("label") != F.col("lm"))).select(F.col("nid").alias("x"), F.col("m").alias("y"))
    least = found.where(~F.col("light")).groupBy("h").agg(F.min("e").alias("er"))
    found = found.join(least, "h").select("h", "nid", "label", "e", "d", "em", "er", "light", "widest")

    def prefix(other: Column, name: str) -> DataFrame:
        """The differences that can be the first one shared with a member of excess ``other`` or more; ``r``: how many are left from there on."""
        need = F.greatest(F.lit(1), F.ceil((F.col("e") + other) / 2 - slack).cast("int"))
        size = F.greatest(F.lit(0), F.size("d") - need + 1)
        return found.withColumn("n", F.size("d")).select(
            "h",
            F.posexplode(F.slice("d", F.lit(1), size)).alias("at", "t"),
            *(F.col(c).alias(f"{c}{name}") for c in ("nid", "label", "e", "light")),
            (F.col("n") - F.col("at")).alias(f"r{name}"),
        ).drop("at")

    # Of two members the one with the larger excess (x) looks up the other (y), which so needs to share at least its own excess.
    # The other's set is at most 100 / percent times as large, and no larger than the hub's largest; of n shingles with excess e
    # it has e + kappa n to share.
    most = F.least((F.size("d") - F.col("e")) * 100 / percent, F.col("widest"))
    asking = prefix(F.greatest(F.when(F.col("light"), F.col("er")).otherwise(F.col("em")), F.col("e") - 2 * most), "x")
    asked = prefix(F.col("e"), "y")
    met = asking.join(asked, ["h", "t"]).where(
        (F.struct("ey", "nidy") < F.struct("ex", "nidx"))
        & (F.col("labelx") != F.col("labely"))
        & ~(F.col("lightx") & F.col("lighty"))
        & (F.col("ex") + F.col("ey") <= 2 * F.least("rx", "ry") + slack)
    )
    pairs = stars.unionByName(met.select(F.col("nidx").alias("x"), F.col("nidy").alias("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _pairs_left(members: DataFrame, edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Pairs (a, b) that hold all links between components, or None if no bucket holds two components."""
    sizes = materialised(
        members.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"))
        .where("l0 <> l1").select("key", "n"),
        "open-buckets",
    )
    got = sizes.agg(F.count("*"), F.max("n")).first()
    if not got[0]:
        return None
    few = members.join(sizes.where(F.col("n") <= SMALL).select("key"), "key")
    other = few.select("key", F.col("nid").alias("b"), F.col("label").alias("lb"))
    pairs = few.withColumnRenamed("nid", "a").join(other, "key").where("a < b and label <> lb").select("a", "b").distinct()
    if got[1] > SMALL:
        many = members.join(sizes.where(F.col("n") > SMALL).select("key"), "key")
        pairs = pairs.unionByName(_crowded_pairs(many, edges, sets, percent)).distinct()
    return materialised(pairs, "pairs")


def linked(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = 85,
    shingle_words: int = 5,
    miss: float = MISS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """One row per input row: its id, n_shingles, component_id (smallest id reachable) and kept.

    Two documents are linked if 100 x common shingles >= ``percent`` x all their shingles.
    """
    bands = band_count(percent / 100, band_rows, miss)
    rows = bands * band_rows
    signed = materialised(_signed(df, doc_id, text, shingle_words, rows), "signatures")
    able = signed.where(F.col("node").isNotNull() & F.col("id").isNotNull())
    nodes = materialised(
        able.groupBy("node")
        .agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
        .withColumn("nid", F.monotonically_increasing_id()),
        "nodes",
    )
    width = 4 * band_rows
    keyed = nodes.select(
        "nid",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(bands - 1)),
                lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * width + 1, F.lit(width))),
            )
        ).alias("key"),
    )
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = materialised(keyed.join(shared, "key"), "buckets")
    some = materialised(nodes.join(buckets.select("nid").distinct(), "nid", "left_semi"), "candidates")
    sets = materialised(_sets(df, some.select("nid", "node", "rep"), doc_id, text, shingle_words), "sets")

    edges = _links(materialised(_pivot_pairs(buckets), "pairs"), some, sets, rows, percent, miss)
    labels = _labels(some, edges)
    left = _pairs_left(materialised(buckets.join(labels, "nid"), "members"), edges, sets, percent)
    if left is not None:
        labels = _labels(some, edges.unionByName(_links(left, some, sets, rows, percent, miss)))

    roots = nodes.select("nid", "node", "rep").join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    low = roots.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = roots.join(low, "label").select("node", "component_id")
    mine = signed.select("id", "n", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    out = mine.join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def kept_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest id."""
    gone = linked(df, doc_id, text, **options).where(~F.col("kept")).select(F.col(doc_id).alias("__gone")).distinct()
    return df.join(gone, df[f"`{doc_id}`"] == F.col("__gone"), "left_anti")
