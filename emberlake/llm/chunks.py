"""Documents coded against dictionaries of chunks.

Operators that look every token up in a corpus-wide table would have to shuffle one row per token. Instead
each task codes its documents against the distinct tokens of a chunk of bounded size. Only the chunk
dictionaries are shuffled, as arrays: to the hash bucket of the token, where corpus-wide values are worked
out once per distinct token, and back to the chunk as arrays of values. The coded documents are written bucketed
by chunk, so they meet their values without a shuffle of their own.

Nothing is broadcast, and no task holds more than a chunk or a share of the distinct tokens.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.session import shared_folder

CHUNK_CHARS = 8_000_000
TOKEN_BUCKETS = 1024


def pack(values: np.ndarray) -> bytes:
    """Small non-negative integers, as compressed planes of bytes."""
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    raw = b"".join(((values >> (8 * k)) & 255).astype(np.uint8).tobytes() for k in range(planes))
    return bytes([planes]) + zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros(planes.shape[1], np.int64)
    for k, plane in enumerate(planes):
        out |= plane.astype(np.int64) << (8 * k)
    return out


def _joined(lists: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """All tokens of some list arrays, and the number per document."""
    flat = pa.concat_arrays([x.flatten() for x in lists])
    sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]) if lists else np.zeros(0, np.int64)
    return flat, sizes.astype(np.int64)


def _code(lists: list[pa.Array], counted: np.ndarray, change: Callable[[str], str] | None):
    """Words by falling frequency, how often each occurs in counted documents, codes, tokens per document."""
    flat, sizes = _joined(lists)
    coded = flat.dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if change is not None:
        again = pa.array([change(w) for w in words.to_pylist()], pa.string()).dictionary_encode()
        codes, words = again.indices.to_numpy().astype(np.int64)[codes], again.dictionary
    n = np.bincount(codes, minlength=len(words))
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[codes]
    of_counted = np.bincount(codes[np.repeat(counted, sizes)], minlength=len(words))
    return words.take(pa.array(order)), of_counted, codes, sizes


class Coded:
    """The written chunks of a set of documents."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def dictionaries(self) -> DataFrame:
        """(chunk, bucket, words, counts), one row per chunk and token bucket, dealt out by bucket."""
        return self.rows.where(F.col("bucket") >= 0).select("chunk", "bucket", "words", "counts")

    def tokens(self) -> DataFrame:
        """(bucket, chunk, k, word, n): the dictionary entries, all of a bucket in one partition."""
        dealt = self.dictionaries().repartition("bucket")
        return dealt.select(
            "bucket", "chunk", F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("k", "e")
        ).select("bucket", "chunk", "k", F.col("e.word").alias("word"), F.col("e.n").alias("n"))

    def documents(self) -> DataFrame:
        return self.rows.where(F.col("bucket") < 0).select("chunk", "buckets", "codes", "ids", "sizes", "flags")

    def with_values(self, values: DataFrame, function: Callable, schema: T.StructType) -> DataFrame:
        """Run ``function(ids, sizes, flags, codes, order, rows)`` once per chunk.

        ``values`` has columns chunk, bucket and more, one row per chunk and bucket, its arrays in the order of
        the dictionary. ``rows`` is its Arrow table for the chunk, sorted by bucket; ``order[i]`` is the code of
        the i-th entry of all its arrays put together.
        """

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.Table.from_batches([], _arrow(schema))
            row = left.slice(0, 1)
            buckets = unpack(row.column("buckets")[0].as_py())
            codes = unpack(row.column("codes")[0].as_py())
            order = np.argsort(buckets, kind="stable")
            right = right.take(pa.array(np.argsort(right.column("bucket").to_numpy(), kind="stable")))
            return function(
                row.column("ids").combine_chunks().flatten(), unpack(row.column("sizes")[0].as_py()),
                unpack(row.column("flags")[0].as_py()).astype(bool), codes, order, right,
            )

        return (
            self.documents().groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(run, schema)
        )


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def flat(column: pa.ChunkedArray) -> np.ndarray:
    """All values of a list column, put together."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def coded(
    df: DataFrame,
    doc_id: Column,
    tokens: Column,
    counted: Column,
    change: Callable[[str], str] | None = None,
    rest: Column | None = None,
    split: Callable[[str], list[str]] | None = None,
    chunk_chars: int = CHUNK_CHARS,
    token_buckets: int = TOKEN_BUCKETS,
) -> Coded:
    """Code the documents and write them.

    ``tokens`` is an array of strings; ``counted`` says whose tokens count; ``change`` maps distinct
    tokens (lower-casing, say). Where ``tokens`` is null, ``split`` cuts the text in ``rest``. A chunk takes
    documents until it holds ``chunk_chars`` bytes of tokens.
    """
    narrow = df.select(
        doc_id.alias("id"), tokens.alias("tokens"), F.coalesce(counted, F.lit(False)).alias("counted"),
        (F.lit(None).cast("string") if rest is None else rest).alias("rest"),
    )
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("words", T.ArrayType(T.StringType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("buckets", T.BinaryType()),
            T.StructField("codes", T.BinaryType()),
            T.StructField("ids", T.ArrayType(narrow.schema["id"].dataType)),
            T.StructField("sizes", T.BinaryType()),
            T.StructField("flags", T.BinaryType()),
        ]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _arrow(schema)
        part, number = TaskContext.get().partitionId(), 0
        ids, lists, flags, size = [], [], [], 0

        def flush():
            nonlocal number, ids, lists, flags, size
            if not ids:
                return
            chunk = (part << 24) + number
            flag = np.concatenate(flags)
            words, counts, codes, sizes = _code(lists, flag, change)
            names = words.to_pylist()
            buckets = np.array([zlib.crc32(w.encode("utf-8")) % token_buckets for w in names], np.int64)
            order = np.argsort(buckets, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(buckets, minlength=token_buckets))])
            used = np.flatnonzero(np.diff(ends))
            offsets = pa.array(np.append(ends[used], ends[-1]), pa.int32())
            values = pa.ListArray.from_arrays(offsets, words.take(pa.array(order)))
            count = pa.ListArray.from_arrays(offsets, pa.array(counts[order], pa.int64()))
            n = len(used)
            entries = [pa.array([chunk] * n, pa.int64()), pa.array(used, pa.int32()), values, count]
            entries += [pa.nulls(n, kinds.field(k).type) for k in range(4, 9)]
            yield pa.RecordBatch.from_arrays(entries, schema=kinds)
            all_ids = pa.concat_arrays(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()),
                    pa.nulls(1, kinds.field(2).type), pa.nulls(1, kinds.field(3).type),
                    pa.array([pack(buckets)], pa.binary()), pa.array([pack(codes)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
                    pa.array([pack(sizes)], pa.binary()), pa.array([pack(flag.astype(np.int64))], pa.binary()),
                ],
                schema=kinds,
            )
            number += 1
            ids, lists, flags, size = [], [], [], 0

        for batch in batches:
            tokens = batch.column(1)
            if tokens.null_count:
                texts = batch.column(3).to_pylist()
                tokens = pa.array(
                    [t if t is not None else split(x or "") for t, x in zip(tokens.to_pylist(), texts, strict=True)],
                    pa.list_(pa.string()),
                )
            offsets = tokens.offsets.to_numpy()
            sizes = pc.binary_length(tokens.values).to_numpy(zero_copy_only=False).astype(np.int64)
            spent = np.concatenate([[0], np.cumsum(sizes)])[offsets]
            counted_rows = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            at = 0
            while at < batch.num_rows:
                # as many rows as the chunk still takes, one at least
                room = int(spent[at]) + chunk_chars - size
                n = max(1, int(np.searchsorted(spent[at + 1 :], room, side="right")))
                ids.append(batch.column(0).slice(at, n))
                lists.append(tokens.slice(at, n))
                flags.append(counted_rows[at : at + n])
                size += int(spent[at + n] - spent[at])
                at += n
                if size >= chunk_chars or at < batch.num_rows:
                    yield from flush()
        yield from flush()

    spark = df.sparkSession
    name = f"coded_{uuid.uuid4().hex}"
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        narrow.mapInArrow(rows, schema)
        .write.bucketBy(groups, "chunk")
        .option("path", shared_folder(spark, "coded"))
        .option("compression", "zstd")
        .format("parquet")
        .saveAsTable(name)
    )
    return Coded(spark.table(name))
