"""Removal of repeated byte strings, by a column-wise built Burrows-Wheeler transform.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (in a smaller id, or earlier in the same
document). Matches never cross documents and are judged on the input.

1. Every window of ``length`` bytes is filed under the smallest hash of its ``gram``-byte pieces. Windows that follow each
   other under the same piece form a fragment. Equal windows share the hash, so only fragments of one hash can
   hold equal windows, and a hash that occurs once is done with.
2. Equal fragments are one string with a first occurrence; all windows of the other occurrences are repeats.
3. Where different fragments share a hash, the collection of these strings is built column by column: each round inserts one
   symbol per string into the transform and updates the common prefixes of neighbours. Windows with a common prefix
   of at least ``length`` bytes are equal, and all but the first are repeats.

A collection is a bounded share of the strings (``shard_strings``), so its two columns are sequential buffers in
the task. A hash with more than ``hot_rows`` fragments would not be bounded: its windows are filed one by one under their
own hash instead, their first occurrence is an aggregate, and the join back splits crowded keys.

Null and empty texts have no bytes. Rows without an id are left alone and count for nothing. Rows with the same id and text are
one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.common import text_of, with_columns
from emberlake.operators.grid import spread_join
from emberlake.session import materialised

LENGTH = 100
GRAM = 20
SHARD_STRINGS = 20_000
HOT_ROWS = 200_000
PART_BYTES = 4 << 20
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes, from hashes of runs of doubling length."""

    def joined(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        h = a * np.uint64(MULTIPLIERS[k % len(MULTIPLIERS)])
        h += b
        h ^= h >> np.uint64(29)
        return h

    power, span, k = x.astype(np.uint64) + np.uint64(1), 1, 0
    out, done = None, 0
    while True:
        if size & span:
            # the pieces of the size's binary digits, one after the other
            if out is None:
                out = power
            else:
                n = len(power) - done
                out = joined(out[:n], power[done:], k + 2)
            done += span
        if span * 2 > size:
            break
        power = joined(power[:-span], power[span:], k)
        span, k = span * 2, k + 1
    out = out[: len(x) - size + 1] * np.uint64(MULTIPLIERS[1])
    return out ^ (out >> np.uint64(32))


def fragments(x: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash) of the fragments of documents put together in ``x``."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if len(x) < length:
        return none
    h = gram_hashes(x, gram)
    # hash and place in one number: the smallest is the leftmost smallest hash
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= length
    inside = np.zeros(len(x) + 1, np.int32)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
    if not len(at):
        return none
    place = place[at]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
    return at[new], np.diff(np.append(new, len(at))), h[place[new]]


def print_of(piece: bytes, windows: int) -> int:
    """56 hash bits of a fragment and its number of windows, as a signed long."""
    value = (xxhash.xxh3_64_intdigest(piece) >> 8 << 8) | windows
    return value - (1 << 64) * (value >> 63)


def _parts(ids: pa.Array, texts: list[str], most: int) -> Iterator[tuple[int, list[bytes]]]:
    start, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t.encode("utf-8"))
        size += len(part[-1])
        if size >= most or i == len(texts) - 1:
            yield start, part
            start, part, size = i + 1, [], 0


def _opened(batch: pa.RecordBatch, length: int, gram: int):
    """(ids, bytes, document of each fragment, offset in all bytes, in the document, windows, hash) in parts."""
    for start, part in _parts(batch.column(0), batch.column(1).to_pylist(), PART_BYTES):
        body = b"".join(part)
        ends = np.cumsum([len(p) for p in part])
        at, n, h = fragments(np.frombuffer(body, np.uint8), ends, length, gram)
        doc = np.searchsorted(ends, at, side="right")
        offset = at - np.concatenate([[0], ends[:-1]])[doc] if len(doc) else at
        yield batch.column(0).slice(start, len(part)), body, doc, at, offset, n, h


def _hashes(body: DataFrame, length: int, gram: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, h in _opened(batch, length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return body.mapInArrow(emit, "h long")


def _rows(body: DataFrame, hot: np.ndarray, length: int, gram: int) -> DataFrame:
    """(h, f, doc, at, hot): the fragments, and one row per window for hot hashes."""
    schema = T.StructType(
        [
            T.StructField("h", T.LongType()),
            T.StructField("f", T.LongType()),
            T.StructField("doc", body.schema["doc"].dataType),
            T.StructField("at", T.LongType()),
            T.StructField("hot", T.BooleanType()),
        ]
    )
    crowded = np.sort(hot.view(np.uint64))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, body, doc, at, offset, n, h in _opened(batch, length, gram):
                is_hot = np.isin(h, crowded) if len(crowded) else np.zeros(len(h), bool)
                if is_hot.any():
                    times = np.where(is_hot, n, 1)
                    first = np.cumsum(times) - times
                    step = np.where(np.repeat(is_hot, times), np.arange(times.sum()) - np.repeat(first, times), 0)
                    at, offset = np.repeat(at, times) + step, np.repeat(offset, times) + step
                    doc, h, n = np.repeat(doc, times), np.repeat(h, times), np.repeat(np.where(is_hot, 1, n), times)
                    is_hot = np.repeat(is_hot, times)
                f = np.array(
                    [print_of(body[a : a + m - 1 + length], m) for a, m in zip(at.tolist(), n.tolist(), strict=True)], np.int64
                )
                key = np.where(is_hot, f, h.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(f), ids.take(pa.array(doc)), pa.array(offset), pa.array(is_hot)], schema.names
                )

    return body.mapInArrow(emit, schema)


class Collection:
    """Burrows-Wheeler transform and common prefixes of a set of strings, one symbol per string and round.

    The rows are the suffixes in order, the empty ones first. ``symbol`` is the byte before a suffix, plus one (0 at a
    string's start); ``common`` is the number of bytes a suffix shares with the row above.
    """

    def __init__(self, strings: list[bytes]):
        self.size = len(strings)
        self.lengths = np.array([len(s) for s in strings], np.int64)
        longest = int(self.lengths.max(initial=0))
        # text[j]: the symbol j places from the end
        self.text = np.zeros((longest + 1, self.size), np.uint16)
        for i, s in enumerate(strings):
            self.text[: len(s), i] = np.frombuffer(s, np.uint8)[::-1].astype(np.uint16) + 1
        self.symbol = self.text[0].copy() if self.size else np.zeros(0, np.uint16)
        self.common = np.zeros(self.size, np.uint8)
        self.place = np.arange(self.size)
        for done in range(longest):
            self._insert(done)

    def _insert(self, done: int) -> None:
        """Insert the suffixes of ``done + 1`` bytes of the strings that have them."""
        live = np.flatnonzero(self.lengths > done)
        live = live[np.argsort(self.place[live], kind="stable")]
        at = self.place[live]
        n = len(self.symbol)
        order = np.argsort(self.symbol, kind="stable")
        ends = int(np.searchsorted(self.symbol[order], 1))  # rows at a string's start have no longer suffix
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        own = rank[at]
        symbols = self.symbol[at]
        # rows that carry the same symbol next above and next below
        above = order[np.maximum(own - 1, 0)]
        above = np.where((own > 0) & (self.symbol[above] == symbols), above, -1)
        below = order[np.minimum(own + 1, n - 1)]
        below = np.where((own + 1 < n) & (self.symbol[below] == symbols), below, -1)
        up = np.where(above >= 0, self._least(above, at) + 1, 0)
        down = np.where(below >= 0, self._least(at, below) + 1, 0)
        new = self.size + own - ends
        total = n + len(live)
        old = np.ones(total, bool)
        old[new] = False
        symbol, common = np.empty(total, np.uint16), np.empty(total, np.uint8)
        symbol[old], common[old] = self.symbol, self.common
        symbol[new], common[new] = self.text[done + 1, live], up
        # an inserted suffix is the new upper neighbour of the next one
        next_ = self.size + own + 1 - ends
        touched = below >= 0
        common[next_[touched]] = down[touched]
        self.symbol, self.common = symbol, common
        self.place[live] = new

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least common prefix over the rows (low, high]."""
        if not len(low):
            return np.zeros(0, np.int64)
        use = low >= 0
        use &= high >= 0
        out = np.zeros(len(low), np.int64)
        pairs = np.stack([low[use] + 1, high[use] + 1], axis=1).reshape(-1)
        if len(pairs):
            out[use] = np.minimum.reduceat(np.append(self.common, np.uint8(0)), pairs)[::2]
        return out

    def places(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bytes, strings, rows): where the suffixes of that many bytes stand, from the shortest on."""
        order = np.argsort(self.symbol, kind="stable")
        ends = int(np.searchsorted(self.symbol[order], 1))
        step = np.empty(len(order), np.int64)
        step[order] = self.size + np.arange(len(order)) - ends
        strings, at = np.arange(self.size), np.arange(self.size)
        for size in range(1, len(self.text)):
            more = self.lengths[strings] >= size
            strings, at = strings[more], step[at[more]]
            yield size, strings, at


def shared_parts(strings: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(string, first window, windows) of the runs of windows whose hash another window has, too."""
    ends = np.cumsum([len(s) for s in strings])
    starts = np.concatenate([[0], ends[:-1]]) if len(strings) else ends
    n = np.maximum(0, ends - starts - length + 1)
    if not n.sum():
        return []
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    hashes = gram_hashes(np.frombuffer(b"".join(strings), np.uint8), length)[at]
    _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(strings)), n)
    keep = np.flatnonzero(count[which] > 1)
    if not len(keep):
        return []
    owner, window = owner[keep], (at - starts[owner])[keep]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)))
    sizes = np.diff(np.append(new, len(keep)))
    return list(zip(owner[new].tolist(), window[new].tolist(), sizes.tolist(), strict=True))


def repeated_windows(strings: list[bytes], first: np.ndarray, length: int) -> list[np.ndarray]:
    """Per string the window starts whose equal occurs earlier; ``first`` orders the strings' places.

    Only parts whose windows share their hash with another can repeat. Equal parts are one string of the
    collection, at its first place; at its other places all windows are repeats.
    """
    late: list[list[np.ndarray]] = [[] for _ in strings]
    places: dict[bytes, tuple[int, int, int]] = {}
    for i, start, n in shared_parts(strings, length):
        part, place = strings[i][start : start + n - 1 + length], (int(first[i]) + start, i, start)
        known = places.get(part)
        if known is None or place < known:
            places[part], place = place, known
        if place is not None:
            late[place[1]].append(place[2] + np.arange(n))
    # what equal parts alone have in common is settled, so the windows are looked through again
    parts = list(places)
    owners = [(places[parts[k]], start, parts[k][start : start + n - 1 + length]) for k, start, n in shared_parts(parts, length)]
    if owners:
        found = _collected([s for *_, s in owners], np.array([at + start for (at, _, _), start, _ in owners], np.int64), length)
        for ((_, i, begin), start, _), windows in zip(owners, found, strict=True):
            late[i].append(begin + start + windows)
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in late]


def _collected(strings: list[bytes], first: np.ndarray, length: int) -> list[np.ndarray]:
    """Per string the window starts whose equal occurs earlier, by the common prefixes of the collection."""
    built = Collection(strings)
    group = np.cumsum(built.common < length)
    owner, start, groups = [], [], []
    for size, who, rows in built.places():
        if size >= length:
            owner.append(who)
            start.append(built.lengths[who] - size)
            groups.append(group[rows])
    if not owner:
        return [np.zeros(0, np.int64) for _ in strings]
    owner, start, groups = map(np.concatenate, (owner, start, groups))
    place = first[owner] + start
    order = np.lexsort((place, groups))
    head = np.append(True, groups[order][1:] != groups[order][:-1])
    least = place[order][head][np.cumsum(head) - 1]
    late = np.zeros(len(order), bool)
    late[order] = place[order] != least
    owner, start = owner[late], start[late]
    by = np.lexsort((start, owner))
    return np.split(start[by], np.searchsorted(owner[by], np.arange(1, len(strings))))


def _runs(starts: np.ndarray) -> list[int]:
    """Window starts as flat (start, number) pairs."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.append(True, starts[1:] != starts[:-1] + 1))
    return np.stack([starts[new], np.diff(np.append(new, len(starts)))], axis=1).reshape(-1).tolist()


def _strings(body: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted fragments (doc, h, f, at)."""
    schema = T.StructType(
        [body.schema["doc"], T.StructField("h", T.LongType()), T.StructField("f", T.LongType()),
         T.StructField("at", T.LongType()), T.StructField("s", T.BinaryType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, h, f, at, s = [], [], [], [], []
            for i, (text, parts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                raw = text.encode("utf-8")
                for p in parts:
                    piece = raw[p["at"] : p["at"] + (p["f"] & 255) - 1 + length]
                    # another text may go by the same id
                    if print_of(piece, p["f"] & 255) == p["f"]:
                        rows.append(i)
                        h.append(p["h"])
                        f.append(p["f"])
                        at.append(p["at"])
                        s.append(piece)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(h, pa.int64()), pa.array(f, pa.int64()),
                 pa.array(at, pa.int64()), pa.array(s, pa.binary())],
                schema.names,
            )

    lists = wanted.groupBy("doc").agg(F.collect_set(F.struct("h", "f", "at")).alias("parts"))
    return body.join(lists, "doc").select("doc", "t", "parts").mapInArrow(cut, schema)


def _within(strings: DataFrame, shards: int, length: int) -> DataFrame:
    """(doc, at, f, runs): repeated windows of first occurrences, by collection."""
    schema = T.StructType(
        [strings.schema["doc"], T.StructField("at", T.LongType()), T.StructField("f", T.LongType()),
         T.StructField("runs", T.ArrayType(T.LongType()))]
    )

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("doc").to_pylist()
        names = {d: i for i, d in enumerate(sorted(set(ids)))}
        first = np.array([names[d] for d in ids], np.int64) << 40
        first += table.column("at").to_numpy()
        found = repeated_windows(table.column("s").to_pylist(), first, length)
        some = [i for i, x in enumerate(found) if len(x)]
        kept = table.take(pa.array(some, pa.int64()))
        runs = pa.array([_runs(found[i]) for i in some], pa.list_(pa.int64()))
        return pa.Table.from_arrays(
            [kept.column("doc").combine_chunks(), kept.column("at").combine_chunks(), kept.column("f").combine_chunks(), runs],
            schema.names,
        )

    shard = F.pmod(F.xxhash64("h"), F.lit(shards))
    return strings.withColumn("shard", shard).groupBy("shard").applyInArrow(build, schema)


def repeats(body: DataFrame, length: int, gram: int, shard_strings: int, hot_rows: int) -> DataFrame:
    """(doc, parts) with parts (at, f, runs): where each document repeats an earlier one. ``body``: (doc, t)."""
    counts = _hashes(body, length, gram).groupBy("h").agg(F.count("*").alias("n"))
    # at most rows / hot_rows of them
    hot = counts.where(F.col("n") > hot_rows).select("h").toArrow().column("h").to_numpy()
    rows = _rows(body, hot, length, gram)

    group = Window.partitionBy("h")
    same = Window.partitionBy("h", "f").orderBy("doc", "at")
    cold = materialised(
        (rows.where(~F.col("hot")) if len(hot) else rows)
        .repartition("h")
        .select("h", "f", "doc", "at", F.count("*").over(group).alias("n"), F.min("f").over(group).alias("f0"), F.max("f").over(group).alias("f1"))
        .where("n > 1")
        .select(
            "h", "f", "doc", "at", (F.col("f0") != F.col("f1")).alias("mixed"),
            F.first(F.struct("doc", "at")).over(same).alias("first"),
        )
        .select("h", "f", "doc", "at", "mixed", (F.col("first") != F.struct("doc", "at")).alias("again")),
        "fragments",
    )
    wanted = cold.where("mixed and not again").select("doc", "h", "f", "at")
    shards = max(1, -(-wanted.count() // shard_strings))
    parts = _within(_strings(body, wanted, length), shards, length)
    all_ = F.lit(None).cast("array<bigint>").alias("runs")
    parts = parts.unionByName(cold.where("again").select("doc", "at", "f", all_))
    if len(hot):
        windows = rows.where("hot").select("f", "doc", "at")
        first = windows.groupBy("f").agg(F.min(F.struct("doc", "at")).alias("first"))
        later = spread_join(windows, first, ["f"], F.struct("doc", "at"))
        parts = parts.unionByName(
            later.where(F.col("first") != F.struct("doc", "at")).select("doc", "at", "f", all_)
        )
    return parts.groupBy("doc").agg(F.collect_list(F.struct("at", "f", "runs")).alias("parts"))


def removal(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    shard_strings: int = SHARD_STRINGS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The rows with ``kept`` (the remaining bytes), n_bytes, n_removed and ``spans`` (start, end of removed runs).

    Input columns of these names are replaced; all others pass through. ``gram`` must not exceed ``length``, and
    ``length - gram`` must be below 255.
    """
    known = df.where(F.col(f"`{doc_id}`").isNotNull())
    body = known.select(F.col(f"`{doc_id}`").alias("doc"), text_of(f"`{text}`").alias("t")).where(F.octet_length("t") >= length)
    lists = repeats(body, length, gram, shard_strings, hot_rows)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
              T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(span))]
    names = [f.name for f in fields]
    rest = df.drop(*[c for c in df.columns if c.lower() in names and c not in (text, doc_id)])
    schema = T.StructType(rest.schema.fields + [T.StructField(f"__{f.name}", f.dataType) for f in fields])
    joined = rest.withColumn("__t", text_of(f"`{text}`")).join(
        lists.select(F.col("doc").alias("__doc"), F.col("parts").alias("__parts")),
        rest[f"`{doc_id}`"] == F.col("__doc"), "left",
    ).drop("__doc")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, spans = [], [], [], []
            texts = batch.column(batch.schema.get_field_index("__t")).to_pylist()
            lists = batch.column(batch.schema.get_field_index("__parts")).to_pylist()
            for t, parts in zip(texts, lists, strict=True):
                raw = t.encode("utf-8")
                change = np.zeros(len(raw) + 1, np.int32)
                for p in parts or ():
                    at, n = p["at"], p["f"] & 255
                    if print_of(raw[at : at + n - 1 + length], n) != p["f"]:
                        continue  # another text goes by the same id
                    runs = p["runs"] if p["runs"] is not None else (0, n)
                    for k in range(0, len(runs), 2):
                        change[at + runs[k]] += 1
                        change[at + runs[k] + runs[k + 1] - 1 + length] -= 1
                out = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes() if len(edges) else raw)
                sizes.append(len(raw))
                gone.append(int(out.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            columns = [n for n in batch.schema.names if n not in ("__t", "__parts")]
            yield pa.RecordBatch.from_arrays(
                batch.select(columns).columns
                + [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                   pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                schema.names,
            )

    out = joined.mapInArrow(remove, schema)
    return with_columns(out, **{n: F.col(f"__{n}") for n in names}).drop(*[f"__{n}" for n in names])
