"""Line dedup with a sharded minimal perfect hash.

The distinct line hashes are counted by Spark and cut into shards. Each shard becomes a minimal perfect hash (levels
of bit arrays) that indexes compact arrays: a 32-bit fingerprint, the document count and the document that keeps
the line. Documents send only their line hashes to the arrays; lines themselves are never joined. The
answers (which hashes a document loses) come back to the document, which is rewritten in one pass.

A line's key is the line without white space at both ends and with A-Z lower-cased; keys are told
apart by 128 hash bits. A key of at least ``min_chars`` code points in at least ``min_docs`` documents stays only
in the largest document id that holds it, where all its lines stay. Null and empty texts are one empty line. Rows
without an id are passed on unjudged; rows with the same id count as one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.common import LOWER_BYTES, pieces, text_of, with_columns
from emberlake.session import materialised

SPACE_BYTES = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 400_000
SHARD_PROBES = 2_000_000
GAMMA = 2.0
MAX_LEVELS = 32


def line_hash(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """The two signed hash words of a line's key, or None for a short key."""
    key = line.strip(SPACE_BYTES).translate(LOWER_BYTES)
    # at most as many code points as bytes; count them only where that matters
    if len(key) < min_chars or (len(key) < 4 * min_chars and sum((b & 0xC0) != 0x80 for b in key) < min_chars):
        return None
    both = xxhash.xxh3_128_intdigest(key)
    high, low = both >> 64, both & 0xFFFFFFFFFFFFFFFF
    return high - (1 << 64) * (high >> 63), low - (1 << 64) * (low >> 63)


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit value of a key for one level."""
    x = h1 + h2 * np.uint64(2 * level + 1) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class PerfectHash:
    """Minimal perfect hash over distinct keys of two 64-bit words.

    A level is a bit array in which a key owns its place if no other key falls there; the others go to the
    next level. A key's index is the number of owned places before its own. What is left after the last level is
    a short sorted list.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.starts, self.ranks, total = [], [], 0
        for bits in levels:
            self.starts.append(total)
            rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            self.ranks.append(rank)
            total += int(rank[-1])
        self.owned = total

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels = []
        while len(h1) and len(levels) < MAX_LEVELS:
            size = max(64, int(GAMMA * len(h1)))
            at = (_mixed(h1, h2, len(levels)) % np.uint64(size)).astype(np.int64)
            own = np.bincount(at, minlength=size) == 1
            levels.append(own)
            left = ~own[at]
            h1, h2 = h1[left], h2[left]
        rest = np.stack([h1, h2], axis=1) if len(h1) else np.zeros((0, 2), np.uint64)
        return cls(levels, rest[np.lexsort((rest[:, 1], rest[:, 0]))])

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        todo = np.arange(len(h1))
        for level, bits in enumerate(self.levels):
            at = (_mixed(h1[todo], h2[todo], level) % np.uint64(len(bits))).astype(np.int64)
            own = bits[at]
            out[todo[own]] = self.starts[level] + self.ranks[level][at[own]]
            todo = todo[~own]
        for k, (a, b) in enumerate(self.rest):
            out[todo[(h1[todo] == a) & (h2[todo] == b)]] = self.owned + k
        return out

    def dump(self) -> tuple[list[int], bytes, bytes]:
        packed = b"".join(np.packbits(bits).tobytes() for bits in self.levels)
        return [len(b) for b in self.levels], packed, self.rest.tobytes()

    @classmethod
    def load(cls, sizes, packed: bytes, rest: bytes) -> PerfectHash:
        levels, at = [], 0
        for size in sizes:
            n = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(packed, np.uint8, n, at), count=size).astype(bool))
            at += n
        return cls(levels, np.frombuffer(rest, np.uint64).reshape(-1, 2))


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))


def line_hashes(df: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc, h1, h2): the distinct keys of each row."""
    schema = T.StructType(
        [
            T.StructField("doc", df.schema[doc_id].dataType),
            T.StructField("h1", T.LongType()),
            T.StructField("h2", T.LongType()),
        ]
    )

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            rows, h1, h2 = [], [], []
            for i, body in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                found = {line_hash(line, min_chars) for line in body.split(b"\n")} - {None}
                rows += [i] * len(found)
                h1 += [a for a, _ in found]
                h2 += [b for _, b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                ["doc", "h1", "h2"],
            )

    ids = df.where(F.col(f"`{doc_id}`").isNotNull())
    return ids.select(F.col(f"`{doc_id}`").alias("doc"), text_of(f"`{text}`").alias("t")).mapInArrow(hashes, schema)


def index_shards(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, DataFrame, int]:
    """(perfect-hash arrays by shard, probes by shard, number of shards)."""
    counts = materialised(
        keys.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("keeper")), "line-counts"
    )
    shards = max(1, math.ceil(counts.count() / shard_keys))
    counts = counts.withColumn("shard", F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)).cast("int"))
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("packed", T.BinaryType()),
            T.StructField("rest", T.BinaryType()),
            T.StructField("prints", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
            T.StructField("keepers", T.ArrayType(counts.schema["keeper"].dataType)),
        ]
    )

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = _words(table)
        mph = PerfectHash.build(h1, h2)
        at = mph.index(h1, h2)
        order = np.argsort(at, kind="stable")
        sizes, packed, rest = mph.dump()
        prints = (h2[order] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
        count = np.minimum(table.column("n").to_numpy()[order], 0xFFFFFFFF).astype("<u4").tobytes()
        keepers = table.column("keeper").take(pa.array(order)).combine_chunks()
        if isinstance(keepers, pa.ChunkedArray):
            keepers = pa.concat_arrays(keepers.chunks)
        lists = pa.ListArray.from_arrays(pa.array([0, len(keepers)], pa.int32()), keepers)
        return pa.Table.from_arrays(
            [table.column("shard").slice(0, 1).cast(pa.int32()), pa.array([sizes], pa.list_(pa.int64())),
             pa.array([packed], pa.binary()), pa.array([rest], pa.binary()), pa.array([prints], pa.binary()),
             pa.array([count], pa.binary()), lists],
            [f.name for f in schema.fields],
        )

    arrays = materialised(counts.groupBy("shard").applyInArrow(build, schema), "line-index")
    load = materialised(counts.groupBy("shard").agg(F.sum("n").alias("n")), "line-load")
    return arrays, load, shards


def losses(keys: DataFrame, min_docs: int, shard_keys: int = SHARD_KEYS, shard_probes: int = SHARD_PROBES) -> DataFrame:
    """(doc, lost): per document the hashes of the keys it loses."""
    arrays, load, shards = index_shards(keys, shard_keys)
    # A line in a large share of all documents makes its shard crowded. There are at most
    # probes / shard_probes such shards, which bounds this broadcast.
    crowded = F.broadcast(
        load.where(F.col("n") > shard_probes).select("shard", F.ceil(F.col("n") / shard_probes).cast("int").alias("parts"))
    )
    parts = F.coalesce(F.col("parts"), F.lit(1))
    probes = (
        keys.withColumn("shard", F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)).cast("int"))
        .join(crowded, "shard", "left")
        .select("shard", F.pmod(F.xxhash64("doc"), parts).cast("int").alias("part"), "doc", "h1", "h2")
    )
    index = (
        arrays.join(crowded, "shard", "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("parts")
    )
    schema = T.StructType([f for f in keys.schema.fields])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(["doc", "h1", "h2"]).slice(0, 0)
        row = right.slice(0, 1).to_pydict()
        mph = PerfectHash.load(row["sizes"][0], row["packed"][0], row["rest"][0])
        prints = np.frombuffer(row["prints"][0], "<u4")
        count = np.frombuffer(row["counts"][0], "<u4")
        h1, h2 = _words(left)
        at = mph.index(h1, h2)
        known = (at >= 0) & (prints[np.maximum(at, 0)] == (h2 & np.uint64(0xFFFFFFFF)))
        often = np.flatnonzero(known & (count[np.maximum(at, 0)] >= min_docs))
        found = left.select(["doc", "h1", "h2"]).take(pa.array(often))
        keepers = right.column("keepers").combine_chunks()
        keepers = keepers.chunk(0) if isinstance(keepers, pa.ChunkedArray) else keepers
        keeper = keepers.flatten().take(pa.array(at[often]))
        mine = pa.compute.equal(found.column("doc"), keeper)
        return found.filter(pa.compute.invert(mine))

    lost = probes.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInArrow(probe, schema)
    return lost.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))


def deduplicated(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    **sizes: int,
) -> DataFrame:
    """The rows with their lines deduplicated, plus n_lines (before) and n_dropped.

    Input columns named n_lines or n_dropped are replaced; all others pass through.
    """
    lost = losses(line_hashes(df, doc_id, text, min_chars), min_docs, **sizes)
    body = with_columns(df, n_lines=F.lit(0).cast("long"), n_dropped=F.lit(0).cast("long"))
    out = [f for f in body.schema.fields if f.name not in (text, "n_lines", "n_dropped")]
    order = [f.name for f in out]
    # a text travels once, without the column it replaces
    whole = body.select(*[F.col(f"`{n}`") for n in order], text_of(f"`{text}`").alias(text))
    joined = whole.join(lost.select(F.col("doc").alias("__doc"), F.col("lost").alias("__lost")),
                        whole[f"`{doc_id}`"] == F.col("__doc"), "left").drop("__doc")
    schema = T.StructType(
        out + [T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            kept, n_lines, n_dropped = [], [], []
            bodies = batch.column(text).cast(pa.binary()).to_pylist()
            for body, gone in zip(bodies, batch.column("__lost").to_pylist(), strict=True):
                if not gone:
                    kept.append(body)
                    n_lines.append(body.count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                gone = {(x["h1"], x["h2"]) for x in gone}
                lines = body.split(b"\n")
                left = [x for x in lines if line_hash(x, min_chars) not in gone]
                kept.append(b"\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays(
                batch.select(order).columns
                + [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                order + [text, "n_lines", "n_dropped"],
            )

    done = joined.mapInArrow(rewrite, schema)
    return done.select(*[F.col(f"`{f.name}`") for f in body.schema.fields])


SQL = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
