"""Benchmark decontamination by pigeonhole edit matching.

With an error budget of k, a test item is cut into k + 1 pieces. A passage within edit distance k leaves
at least one piece untouched, so exact hits of the pieces (one Aho-Corasick automaton over all pieces)
find every candidate place. Around the hits Myers' bit-parallel recurrence gives the exact distance.

Both sides are compared lower-cased and with runs of white space as one space; offsets are those of that form. The
test items are the fixed query set: they are read in blocks of bounded size, and each block is matched against all
documents. Null or empty documents match nothing, and null or empty items are not searched. Items under SHORT_CHARS characters are
matched exactly, and only on word boundaries: a neighbour that is part of a word must not continue a word of the item, except
in scripts that put no spaces between words. Items shorter than ``min_chars`` are not searched; it is 0 unless given. Equal items are all reported, under their own ids; repeated
documents are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.common import with_columns

ERROR_RATE = 0.05
MIN_PIECE = 12
SHORT_CHARS = 24
BLOCK_CHARS = 4_000_000
# a letter or digit of a script that separates words
JOINING = regex.compile(
    r"(?V1)[\w--[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}]]"
)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, error_rate: float = ERROR_RATE, min_piece: int = MIN_PIECE) -> int:
    """Errors allowed in an item: a share of its length, as long as its pieces keep ``min_piece`` characters."""
    return max(0, min(int(length * error_rate), length // min_piece - 1))


def on_boundaries(text: str, start: int, end: int) -> bool:
    """Whether no word of a text runs across either end of a passage."""
    return not any(
        0 < at < len(text) and JOINING.match(text[at - 1]) and JOINING.match(text[at]) for at in (start, end)
    )


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length that cover the item."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Approximate search of one pattern, one machine-independent big integer per column."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.full = (1 << self.size) - 1
        self.high = 1 << (self.size - 1)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | (1 << i)

    def best(self, text: str, errors: int) -> tuple[int, int] | None:
        """(distance, end) of the closest match within the budget, the first of equal ones."""
        plus, minus, score, found = self.full, 0, self.size, None
        full, high, masks = self.full, self.high, self.masks
        for at, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            v = eq | minus
            h = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(h | plus))
            down = plus & h
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            up = (up << 1) & full
            down = (down << 1) & full
            plus = down | (full & ~(v | up))
            minus = up & v
            if score <= errors and (found is None or score < found[0]):
                found = (score, at)
        return found


class Matcher:
    """All pieces of a block of items."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float, min_piece: int):
        self.items = [(i, t, 0 if len(t) < SHORT_CHARS else budget(len(t), error_rate, min_piece)) for i, t in items]
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                by_piece.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        if by_piece:
            self.automaton.make_automaton()
        self.empty = not by_piece
        self.forward: dict[int, Myers] = {}
        self.backward: dict[int, Myers] = {}

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, distance, start, end) of the best match of each item in a normalised text."""
        if self.empty or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, tuple[int, int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                _, item, errors = self.items[k]
                if len(item) < SHORT_CHARS:
                    if k not in exact and on_boundaries(text, last + 1 - size, last + 1):
                        exact[k] = (last + 1 - size, last + 1)
                    continue
                start = last + 1 - size - offset - errors
                end = start + len(item) + 2 * errors
                spans = windows.setdefault(k, [])
                # hits come in text order, so a window only overlaps the last ones of its item
                while spans and start <= spans[-1][1]:
                    start, end = min(start, spans[-1][0]), max(end, spans[-1][1])
                    spans.pop()
                spans.append([start, end])
        out = []
        for k in sorted([*windows, *exact]):
            item_id, item, errors = self.items[k]
            if k in exact:
                out.append((item_id, 0, *exact[k]))
                continue
            if k not in self.forward:
                self.forward[k], self.backward[k] = Myers(item), Myers(item[::-1])
            found = None
            for start, end in windows[k]:
                start = max(0, start)
                got = self.forward[k].best(text[start:end], errors)
                if got and (found is None or got[0] < found[0]):
                    found = (got[0], start + got[1])
            if found:
                distance, end = found
                tail = text[max(0, end - len(item) - errors) : end][::-1]
                back = self.backward[k].best(tail, distance)
                out.append((item_id, distance, end - (back[1] if back else len(item)), end))
        return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, min_chars: int, block_chars: int) -> Iterator[list]:
    part, size = [], 0
    rows = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).orderBy("i", "t")
    for row in rows.toLocalIterator():
        item = normal(row["t"])
        if len(item) < max(1, min_chars):
            continue
        part.append((row["i"], item))
        size += len(item)
        if size >= block_chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def hits(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "hits",
    error_rate: float = ERROR_RATE,
    min_piece: int = MIN_PIECE,
    min_chars: int = 0,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Add ``out`` to every row: an array of (item_id, distance, start, end), one entry per matching item.

    An input column named ``out`` is replaced. ``block_chars`` bounds what is broadcast at once.
    """
    sc = df.sparkSession.sparkContext
    hit = T.StructType(
        [
            T.StructField("item_id", benchmark.schema[item_id].dataType),
            T.StructField("distance", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
    df = with_columns(df, **{out: F.array().cast(T.ArrayType(hit))})
    for block in _blocks(benchmark, item_id, item_text, min_chars, block_chars):
        shared = sc.broadcast(block)
        step = df.withColumn("__text", F.col(f"`{text}`").cast("string"))
        schema = T.StructType(df.schema.fields + [T.StructField("__more", T.ArrayType(hit))])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate, min_piece)
            kind = None
            for batch in batches:
                at = batch.schema.get_field_index("__text")
                prior = batch.schema.field(out).type
                kind = pa.list_(prior.value_type)
                found = [
                    [dict(zip(("item_id", "distance", "start", "end"), m, strict=True)) for m in matcher.find(normal(t))]
                    for t in batch.column(at).to_pylist()
                ]
                names = [n for n in batch.schema.names if n != "__text"]
                yield pa.RecordBatch.from_arrays(
                    batch.select(names).columns + [pa.array(found, kind)], names + ["__more"]
                )

        df = with_columns(
            step.mapInArrow(search, schema), **{out: F.concat(F.col(f"`{out}`"), F.col("__more"))}
        ).drop("__more")
    return df


def matches(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per contaminated document and item: id, item_id, distance, start and end."""
    narrow = documents.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").alias("__body"))
    found = hits(narrow, benchmark, text="__body", out="__hits", **options)
    return found.select(doc_id, F.inline("__hits"))


def clean_rows(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no test item, with their own columns."""
    return hits(documents, benchmark, text=text, out="__hits", **options).where(F.size("__hits") == 0).drop("__hits")
