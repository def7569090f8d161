"""Byte-level BPE in Spark's higher-order functions.

Encoding: the distinct pre-tokens of the corpus are arrays of bytes (as hex), and an aggregate over the array folds the
merges, lowest rank first and leftmost among equals, looking ranks up in a literal map that is part of the plan. A
pre-token that is itself in the vocabulary is one id. The ids come back to the documents through the chunk
dictionaries of ``chunks``. Decoding looks up the bytes of each id in a literal array and concatenates them.

The vocabulary is a ``.tiktoken`` rank file; its path is a parameter and it must hold all single bytes. Null and empty
texts have no ids. Special tokens are ordinary text. Repeated rows are encoded one by one; the result has
the id's column and ``ids`` alone, so other columns of any name do not matter. A pre-token longer than ``FOLD_BYTES`` would make the fold
quadratic; its merges run over a heap instead, with the same result.
"""

from __future__ import annotations

import functools
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm import chunks
from emberlake.llm.chunks import flat
from emberlake.llm.common import text_of
from emberlake.llm.tokencount import rank_table

MAP_BUCKETS = 8192
FOLD_BYTES = 256
CHUNK_CHARS = 20_000_000
# chunks whose dictionaries share one encoding of a word; bounds the list kept per word
CHUNK_BLOCK = 256


@functools.lru_cache(maxsize=4)
def _hex_ranks(vocabulary: str) -> str:
    """The rank map as JSON: an array of small maps, chosen by the CRC of the key."""
    buckets: list[dict[str, int]] = [{} for _ in range(MAP_BUCKETS)]
    for piece, rank in rank_table(vocabulary).items():
        key = piece.hex().upper()
        buckets[zlib.crc32(key.encode()) % MAP_BUCKETS][key] = rank
    return json.dumps(buckets, separators=(",", ":"))


@functools.lru_cache(maxsize=4)
def _hex_pieces(vocabulary: str) -> str:
    ranks = rank_table(vocabulary)
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    return " ".join(pieces)


def rank_map(vocabulary: str) -> Column:
    """The ranks as one literal; the optimizer folds the parsing away."""
    return F.from_json(F.lit(_hex_ranks(vocabulary)), "array<map<string,int>>")


def rank_of(key: Column, ranks: Column) -> Column:
    """The rank of a byte string given as hex, or null."""
    return F.get(ranks, (F.crc32(key.cast("binary")) % MAP_BUCKETS).cast("int"))[key]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _start(word: Column, ranks: Column) -> Column:
    """Single bytes and the rank of each with its right neighbour."""
    single = F.transform(
        F.sequence(F.lit(1), (F.length(word) / 2).cast("int")), lambda i: F.substring(word, i * 2 - 1, 2)
    )
    return _let(
        single,
        lambda p: F.struct(
            p.alias("p"), F.transform(p, lambda x, i: rank_of(F.concat(x, F.get(p, i + 1)), ranks)).alias("r")
        ),
    )


def _merged(acc: Column, k: Column, ranks: Column) -> Column:
    """The pieces with the pair at 0-based place k made one, and the ranks of its new neighbours."""
    p, r = acc["p"], acc["r"]

    def with_piece(piece: Column) -> Column:
        left = F.when(k > 0, F.array(rank_of(F.concat(F.get(p, k - 1), piece), ranks))).otherwise(
            F.array().cast("array<int>")
        )
        right = F.array(rank_of(F.concat(piece, F.get(p, k + 2)), ranks))
        before = F.slice(r, 1, F.greatest(k - 1, F.lit(0)))
        return F.struct(
            F.concat(F.slice(p, 1, k), F.array(piece), F.slice(p, k + 3, F.size(p))).alias("p"),
            F.concat(before, left, right, F.slice(r, k + 3, F.size(r))).alias("r"),
        )

    return _let(F.concat(F.get(p, k), F.get(p, k + 1)), with_piece)


def folded(word: Column, vocabulary: str) -> Column:
    """The ids of a pre-token, natively."""

    def fold(h: Column, ranks: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            return _let(
                F.array_min(acc["r"]),
                lambda low: F.when(low.isNull(), acc).otherwise(
                    _let((F.array_position(acc["r"], low) - 1).cast("int"), lambda k: _merged(acc, k, ranks))
                ),
            )

        rounds = F.sequence(F.lit(1), F.greatest((F.length(h) / 2).cast("int") - 1, F.lit(1)))
        return F.aggregate(
            rounds, _start(h, ranks), step, lambda acc: F.transform(acc["p"], lambda x: rank_of(x, ranks))
        )

    def ids(h: Column, ranks: Column) -> Column:
        return _let(
            rank_of(h, ranks), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(fold(h, ranks))
        )

    return _let(F.hex(F.encode(word, "utf-8")), lambda h: _let(rank_map(vocabulary), lambda ranks: ids(h, ranks)))


def heap_encode(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges over a linked list and a heap, for very long pre-tokens."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # end of the piece that starts here
    left = list(range(-1, n - 1))
    alive = [True] * n

    def rank(a: int):
        b = end[a]
        return ranks.get(word[a : end[b]]) if b < n else None

    heap = [(r, a, end[a], end[end[a]]) for a in range(n - 1) if (r := rank(a)) is not None]
    heapq.heapify(heap)
    while heap:
        r, a, middle, stop = heapq.heappop(heap)
        if not alive[a] or end[a] != middle or middle >= n or not alive[middle] or end[middle] != stop:
            continue
        alive[middle] = False
        end[a] = stop
        if stop < n:
            left[stop] = a
            if (r := rank(a)) is not None:
                heapq.heappush(heap, (r, a, stop, end[stop]))
        if left[a] >= 0 and (r := rank(left[a])) is not None:
            heapq.heappush(heap, (r, left[a], a, stop))
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : end[a]]])
        a = end[a]
    return out


def encoded_words(words: DataFrame, vocabulary: str, word: str = "word") -> DataFrame:
    """Add ``ids`` to distinct pre-tokens: null for those longer than ``FOLD_BYTES``, which ``heap_encode`` takes."""
    short = F.octet_length(F.col(word)) <= FOLD_BYTES
    return words.withColumn("ids", F.when(short, folded(F.col(word), vocabulary)))


def pretokens(text: Column, pattern: str) -> Column:
    """The pre-tokens of a text. Java's classes are those of Unicode with (?U)."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def encoded(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    **sizes: int,
) -> DataFrame:
    """One row per input row: its id and ``ids``."""
    own = text_of(f"`{text}`")
    # code points that Java's older tables do not know are split in the task, by newer ones
    known = ~own.rlike("\\p{Cn}")
    table = chunks.coded(
        df, F.col(f"`{doc_id}`"), F.when(known, pretokens(own, pattern)), F.lit(False),
        rest=F.when(~known, own), split=lambda t: regex.findall(pattern, t), chunk_chars=chunk_chars, **sizes,
    )
    entries = table.tokens().withColumn("block", F.floor(F.shiftright("chunk", 24) / CHUNK_BLOCK))
    words = entries.groupBy("bucket", "block", "word").agg(F.collect_list(F.struct("chunk", "k")).alias("places"))
    # every step below stays in the partitions by bucket
    done = encoded_words(words, vocabulary).select(
        "bucket", F.inline("places"), "ids", F.when(F.col("ids").isNull(), F.col("word")).alias("long")
    )
    values = (
        done.groupBy("bucket", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("k", "ids", "long"))).alias("e"))
        .select(
            "chunk", "bucket",
            F.transform("e", lambda x: F.coalesce(F.when(x["ids"].isNotNull(), F.size(x["ids"])), F.lit(-1))).alias("sizes"),
            F.flatten(F.transform("e", lambda x: F.coalesce(x["ids"], F.array().cast("array<int>")))).alias("ids"),
            F.array_compact(F.transform("e", lambda x: x["long"])).alias("long"),
        )
    )
    schema = T.StructType([df.schema[doc_id], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def spell(ids, sizes, flags, codes, order, rows) -> pa.Table:
        lengths = flat(rows.column("sizes")).astype(np.int64)
        pieces = flat(rows.column("ids")).astype(np.int32)
        late = np.flatnonzero(lengths < 0)
        if len(late):
            ranks = rank_table(vocabulary)
            more = [heap_encode(w.encode("utf-8"), ranks) for w in rows.column("long").combine_chunks().flatten().to_pylist()]
            lengths[late] = 0
            at = np.repeat((np.cumsum(lengths) - lengths)[late], [len(m) for m in more])
            pieces = np.insert(pieces, at, np.concatenate([np.array(m, np.int32) for m in more]))
            lengths[late] = [len(m) for m in more]
        starts = np.cumsum(lengths) - lengths
        length, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        length[order], start[order] = lengths, starts
        ends = np.cumsum(sizes)
        out, offsets = [], [0]
        for end, size in zip(ends, sizes, strict=True):
            mine = codes[end - size : end]
            n = length[mine]
            total = int(n.sum())
            place = np.arange(total) + np.repeat(start[mine] - (np.cumsum(n) - n), n)
            out.append(pieces[place])
            offsets.append(offsets[-1] + total)
        values = pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32())
        return pa.Table.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], schema.names)

    return table.with_values(values, spell, schema)


def decoded(ids: Column, vocabulary: str) -> Column:
    """The bytes of an array of ids, natively."""
    pieces = F.split(F.lit(_hex_pieces(vocabulary)), " ")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


@functools.lru_cache(maxsize=4)
def _hex_numbers(n: int) -> str:
    return " ".join(i.to_bytes(4, "little").hex().upper() for i in range(n))


def little_endian(ids: Column, vocabulary: str) -> Column:
    """The ids as little-endian unsigned 32-bit integers, natively."""
    numbers = F.split(F.lit(_hex_numbers(max(rank_table(vocabulary).values(), default=-1) + 1)), " ")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(numbers, i)), ""))
