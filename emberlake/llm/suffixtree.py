"""Language-model scores from a probabilistic suffix tree over words.

Training counts come from all training documents. A context (the last 1 to ``depth`` tokens) is a candidate if it and a
continuation are counted: seen at least ``min_count`` times, however large the corpus is. It is retained if its next-token
distribution diverges from that of its longest retained
suffix: twice the log-likelihood gain over its k counted continuations must exceed ``k + 6 sqrt(2k) + 10``, far out in the
tail of the chi-squared law that it follows when nothing diverges. Retained distributions are smoothed by ``prior``
pseudo-counts of the suffix's distribution; continuations that were not counted share what is left in proportion to it.
The root is the additive estimate ``(c + 0.5) / (N + 0.5 (V + 1))``, where V + 1 includes the unknown token.

A token is scored in the state of the longest retained suffix of its history. The tree grows with the corpus, so it is a
written table and no part of it is gathered or broadcast. Each chunk sends its distinct n-grams, as sorted keys in ranges of
the key space, to where the range is counted, and gets back one bit per n-gram. An n-gram is only sent if both n-grams one token
shorter are counted, which no counted one fails. A continuation's suffix n-gram and its context are counted n-grams too, and as every
text ends with an end token, a context's total is its own count: so the divergence test is two equi-joins and an aggregation
of sums per level. Probabilities go back to the chunks by the same ranges. Word counts reach the documents through
the chunk dictionaries of ``chunks``.

Words are cut at ASCII white space and A-Z is lower-cased; every text ends with one end token. Null and empty texts
are the end token alone. Rows without an id are never held out. Repeated rows are scored and counted one by one.
Other columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.chunks import Coded, _arrow, coded, flat, pack, unpack
from emberlake.llm.common import LOWER_CHARS, text_of, words_of
from emberlake.session import materialised, shared_folder

END = "\n"  # white space cannot be a word
DEPTH = 3
MIN_COUNT = 8
PRIOR = 4.0


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether a document is kept out of training, by a checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _lower(word: str) -> str:
    return word.translate(LOWER_CHARS)


def mixed(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """64-bit key of a context extended by a token; 0 stands for "none"."""
    x = state * np.uint64(0x9E3779B97F4A7C15) + symbol + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return np.where(symbol == 0, np.uint64(0), np.maximum(x, np.uint64(1)))


def context_keys(symbols: np.ndarray, starts: np.ndarray, depth: int) -> list[np.ndarray]:
    """For n = 1..depth the key of the n tokens before each position, 0 where there are fewer or one is rare.

    A context is keyed from its oldest token on, so a context extended by the next token has the key of
    the longer n-gram.
    """
    n = len(symbols)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    out = []
    for size in range(1, depth + 1):
        key = np.ones(n, np.uint64)
        for back in range(size, 0, -1):
            before = np.zeros(n, np.uint64)
            before[back:] = symbols[:-back] if back else symbols
            key = np.where(key == 0, np.uint64(0), mixed(key, before))
        key[place < size] = 0
        out.append(key)
    return out


def found(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted array, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where((keys != 0) & (sorted_keys[at] == keys), at, -1)


@dataclass
class Tree:
    """Retained contexts by level, as sorted arrays.

    ``states[n]``: keys of the contexts of n + 1 tokens; ``rest[n]``: log10 of the factor on the suffix's probability for
    continuations that were not counted. ``pairs[n]`` and ``gain[n]``: keys of counted continuations and log10 of their
    probability over the root's.
    """

    states: list[np.ndarray]
    rest: list[np.ndarray]
    pairs: list[np.ndarray]
    gain: list[np.ndarray]

    def gains(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of each token's probability in its longest state over its root probability."""
        total = np.zeros(len(symbols))
        contexts = context_keys(symbols, starts, len(self.states))
        # from the shortest context up: a longer state replaces what a shorter one said
        for states, rest, pairs, gain, context in zip(
            self.states, self.rest, self.pairs, self.gain, contexts, strict=True
        ):
            state = found(context, states)
            inside = np.flatnonzero(state >= 0)
            if not len(inside):
                continue
            pair = found(mixed(context[inside], symbols[inside]), pairs)
            total[inside] = np.where(
                pair >= 0, gain[np.maximum(pair, 0)] if len(gain) else 0.0, total[inside] + rest[state[inside]]
            )
        return total


def fit_tree(
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]],
    totals: list[tuple[np.ndarray, np.ndarray]],
    roots: tuple[np.ndarray, np.ndarray],
    prior: float = PRIOR,
) -> Tree:
    """Retain contexts level by level: the tree of ``_model`` for counts that are in memory.

    ``levels[n]``: (context key, suffix-context key, next symbol, count) of the counted continuations of contexts of n + 1
    tokens; ``totals[n]``: sorted context keys and their counts; ``roots``: sorted symbols and their root probabilities.
    """
    symbols, root = roots
    tree = Tree([], [], [], [])
    # per level, for retained contexts: sorted pair key -> probability; sorted state key -> (rest factor, suffix chain)
    kept: list[dict[int, dict]] = []

    def probability(chain: list[tuple[int, int]], symbol: int, base: float) -> float:
        """Probability of a symbol in the longest retained state of a chain of (level, key), longest first."""
        factor = 1.0
        for level, key in chain:
            state = kept[level].get(key)
            if state is None:
                continue
            if symbol in state["next"]:
                return factor * state["next"][symbol]
            factor *= state["rest"]
        return factor * base

    for level, (contexts, suffixes, nexts, counts) in enumerate(levels):
        keys, sums = totals[level]
        order = np.argsort(contexts, kind="stable")
        contexts, nexts, counts = contexts[order], nexts[order], counts[order]
        suffixes = suffixes[order]
        here: dict[int, dict] = {}
        bounds = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(contexts) else np.zeros(0, int)
        base = root[np.minimum(np.searchsorted(symbols, nexts), max(0, len(symbols) - 1))] if len(symbols) else np.zeros(0)
        for a, b in zip(bounds, np.append(bounds[1:], len(contexts))[: len(bounds)], strict=True):
            key = int(contexts[a])
            n = float(sums[np.searchsorted(keys, contexts[a])])
            chain = [(level - 1 - i, int(k)) for i, k in enumerate(suffixes[a])]
            below = np.array([probability(chain, int(s), float(p)) for s, p in zip(nexts[a:b], base[a:b], strict=True)])
            c = counts[a:b].astype(float)
            gain = float((c * np.log(c / (n * below))).sum())
            left, left_below = n - c.sum(), max(1e-12, 1 - below.sum())
            if left > 0:
                gain += left * math.log(left / (n * left_below))
            k = b - a
            if 2 * gain <= k + 6 * math.sqrt(2 * k) + 10:
                continue
            p = (c + prior * below) / (n + prior)
            rest = max(1e-12, 1 - p.sum()) / left_below
            here[key] = {"next": dict(zip(nexts[a:b].tolist(), p.tolist(), strict=True)), "rest": rest}
        kept.append(here)
        states = np.array(sorted(here), np.uint64)
        tree.states.append(states)
        tree.rest.append(np.log10(np.array([here[int(s)]["rest"] for s in states])) if len(states) else np.zeros(0))
        pair, value = [], []
        for key, state in here.items():
            nxt = np.array(list(state["next"]), np.uint64)
            b = root[np.searchsorted(symbols, nxt)]
            pair.append(mixed(np.full(len(nxt), key, np.uint64), nxt))
            value.append(np.log10(np.array(list(state["next"].values())) / b))
        pair = np.concatenate(pair) if pair else np.zeros(0, np.uint64)
        value = np.concatenate(value) if value else np.zeros(0)
        order = np.argsort(pair)
        tree.pairs.append(pair[order])
        tree.gain.append(value[order])
    return tree


def _counts_of(table: Coded) -> int:
    got = table.dictionaries().agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    return int(got[0] or 0)


def _values(table: Coded, least: int) -> DataFrame:
    """Per chunk and bucket: corpus-wide training counts, symbols of the frequent words, number of new words."""
    word = Window.partitionBy("bucket", "word")
    entries = table.tokens().select(
        "bucket", "chunk", "k",
        F.sum("n").over(word).alias("c"),
        F.xxhash64("word").alias("h"),
        (F.row_number().over(word.orderBy("chunk", "k")) == 1).alias("first"),
    )
    entry = F.struct("k", "c", F.when(F.col("c") >= least, F.when(F.col("h") == 0, 1).otherwise(F.col("h"))).otherwise(0).alias("s"))
    rows = entries.groupBy("bucket", "chunk").agg(
        F.sort_array(F.collect_list(entry)).alias("e"),
        F.count_if(F.col("first") & (F.col("c") > 0)).alias("new"),
    )
    return materialised(
        rows.select(
            "chunk", "bucket", F.transform("e", lambda x: x["c"]).alias("c"), F.transform("e", lambda x: x["s"]).alias("s"), "new"
        ),
        "word-values",
    )


def _documents(table: Coded, values: DataFrame, total: int, distinct: int, id_field: T.StructField) -> DataFrame:
    """One row per chunk: ids, flags, base statistics and the symbols of the frequent words, packed."""
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(id_field.dataType)),
            *[T.StructField(n, T.BinaryType()) for n in ("sizes", "flags", "known", "base", "alphabet", "codes")],
            T.StructField("chunk", T.LongType()),
        ]
    )
    unit = math.log10(total + 0.5 * (distinct + 1))

    def reduce(ids, sizes, flags, codes, order, rows) -> pa.Table:
        c, s = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        c[order], s[order] = flat(rows.column("c")), flat(rows.column("s"))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        value = (np.log10(c + 0.5) - unit)[codes]
        base = np.array([math.fsum(value[a:b].tolist()) for a, b in zip(starts, ends, strict=True)])
        known = np.add.reduceat((c > 0)[codes].astype(np.int64), starts) if len(codes) else np.zeros(len(sizes), np.int64)
        alphabet = np.unique(s)
        alphabet = alphabet[alphabet != 0]
        small = np.where(s == 0, 0, np.searchsorted(alphabet, s) + 1)[codes]
        return pa.Table.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                *[
                    pa.array([blob], pa.binary())
                    for blob in (
                        pack(sizes), pack(flags.astype(np.int64)), pack(known), base.tobytes(), alphabet.tobytes(), pack(small)
                    )
                ],
                rows.column("chunk").slice(0, 1),
            ],
            [f.name for f in schema.fields],
        )

    spark = values.sparkSession
    name = f"scored_{uuid.uuid4().hex}"
    # bucketed by chunk, so that what comes back to the chunks meets them without a shuffle of the documents
    (
        table.with_values(values, reduce, schema)
        .write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
        .option("path", shared_folder(spark, "scored-chunks"))
        .option("compression", "zstd")
        .format("parquet")
        .saveAsTable(name)
    )
    return spark.table(name)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first positions, sizes) of a chunk."""
    sizes = unpack(row["sizes"])
    alphabet = np.concatenate([[0], np.frombuffer(row["alphabet"], np.int64)]).astype(np.int64)
    return alphabet[unpack(row["codes"])].view(np.uint64), np.cumsum(sizes) - sizes, sizes


def _before(values: np.ndarray, starts: np.ndarray, none: int) -> np.ndarray:
    """The value at the position before, ``none`` at the start of a document."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = none
    return out


def _levels(symbols: np.ndarray, starts: np.ndarray, answers: dict[int, np.ndarray], deepest: int):
    """For n = 1, 2, ...: (n, sorted distinct keys of the candidate n-grams, for each candidate position the index of its key,
    the positions, the index of its key among the counted ones or -1, keys of the (n - 1)-grams by position).

    ``answers[n]`` says for each distinct candidate of n tokens whether it is counted. The last level given has none, and
    its indices are null.
    """
    shorter, key = None, mixed(np.ones(len(symbols), np.uint64), symbols)
    for level in range(1, deepest + 1):
        at = np.flatnonzero(key)
        distinct, code = np.unique(key[at], return_inverse=True)
        counted = answers.get(level) if len(distinct) else np.zeros(0, bool)
        if counted is None:
            yield level, distinct, code, at, None, shorter
            return
        rank = np.where(counted, np.cumsum(counted) - 1, -1)[code]
        yield level, distinct, code, at, rank, shorter
        shorter = np.zeros(len(key), np.uint64)
        shorter[at[rank >= 0]] = key[at[rank >= 0]]
        # both the n-gram before and the one up to here are counted
        before = _before(shorter, starts, 0)
        key = np.where((before != 0) & (shorter != 0), mixed(before, symbols), np.uint64(0))


def _ranges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The key ranges that sorted keys fall into, and where each begins, with the end."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return part[first], np.append(first, len(part))


def _steps(keys: np.ndarray, part: int, bits: int) -> bytes:
    """Sorted keys of a range, packed by their differences."""
    return pack(np.diff(keys - (np.uint64(part) << np.uint64(64 - bits)), prepend=np.uint64(0)).view(np.int64))


def _keys(blob: bytes, part: int, bits: int) -> np.ndarray:
    return np.cumsum(unpack(blob).view(np.uint64)) + (np.uint64(part) << np.uint64(64 - bits))


def _answers(table: pa.Table) -> dict[int, np.ndarray]:
    """Per level, the bits of all ranges put together."""
    rows = table.select(["level", "part", "size", "counted"]).to_pylist()
    out: dict[int, list[np.ndarray]] = {}
    for r in sorted(rows, key=lambda r: (r["level"], r["part"])):
        out.setdefault(r["level"], []).append(np.unpackbits(np.frombuffer(r["counted"], np.uint8), count=r["size"]).astype(bool))
    return {level: np.concatenate(bits) for level, bits in out.items()}


def _counted(chunks: DataFrame, depth: int, least: int, bits: int) -> DataFrame:
    """Per chunk, level and key range: which of the chunk's candidate n-grams are counted, as bits in key order.

    ``ranks`` are their indices among all counted n-grams of the range; ``owned`` marks those of which the chunk is the first
    holder, and ``counts`` holds their corpus-wide counts.
    """
    spark = chunks.sparkSession
    sent = "chunk long, level int, part int, keys binary, n binary"
    replied = "chunk long, level int, part int, size int, counted binary, ranks binary, owned binary, counts binary"
    kinds = _arrow(T.StructType.fromDDL(replied))

    def send(wanted: tuple[int, ...]):
        names = ["chunk", "level", "part", "keys", "n"]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [[] for _ in names]
            if left.num_rows:
                row = left.drop_columns(["ids"]).slice(0, 1).to_pylist()[0]
                symbols, starts, sizes = _opened(row)
                training = np.repeat(unpack(row["flags"]).astype(bool), sizes)
                answers = _answers(right)
                if 1 in wanted:
                    # a symbol stands for a counted word
                    answers[1] = np.ones(len(np.unique(symbols[symbols != 0])), bool)
                for level, distinct, code, at, _, _ in _levels(symbols, starts, answers, depth + 1):
                    if level not in wanted:
                        continue
                    n = np.bincount(code[training[at]], minlength=len(distinct))
                    parts, ends = _ranges(distinct, bits)
                    for part, a, b in zip(parts.tolist(), ends[:-1], ends[1:], strict=True):
                        for column, x in zip(
                            out, (row["chunk"], level, part, _steps(distinct[a:b], part, bits), pack(n[a:b])), strict=True
                        ):
                            column.append(x)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(out, types, strict=True)], names)

        return run

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        level, part = table.column("level")[0].as_py(), table.column("part")[0].as_py()
        lists = [_keys(x, part, bits) for x in table.column("keys").to_pylist()]
        ends = np.cumsum([len(x) for x in lists])
        _, first, code = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
        sums = np.bincount(code, weights=np.concatenate([unpack(x) for x in table.column("n").to_pylist()])).astype(np.int64)
        ranks = np.where(sums >= least, np.cumsum(sums >= least) - 1, -1)[code]
        holds = np.zeros(len(code), bool)
        holds[first[sums >= least]] = True
        out = []
        for chunk, a, b in zip(table.column("chunk").to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
            here = ranks[a:b][ranks[a:b] >= 0]
            out.append(
                {
                    "chunk": chunk, "level": level, "part": part, "size": int(b - a),
                    "counted": np.packbits(ranks[a:b] >= 0).tobytes(),
                    "ranks": pack(np.diff(here, prepend=0)),
                    "owned": np.packbits(holds[a:b]).tobytes(), "counts": pack(sums[code[a:b][holds[a:b]]]),
                }
            )
        return pa.Table.from_pylist(out, kinds)

    known = spark.createDataFrame([], replied)
    for wanted in ((1, 2), *[(level,) for level in range(3, depth + 2)]):
        entries = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(send(wanted), sent)
        some = entries.groupBy("level", "part").applyInArrow(count, replied)
        known = known.unionByName(materialised(some, "counted-grams")) if wanted[0] > 1 else materialised(some, "counted-grams")
    return known


def _grams(chunks: DataFrame, passed: DataFrame, depth: int, bits: int) -> DataFrame:
    """(level, g, context, suffix, c): every counted n-gram once, with the keys of the n-grams without its last and first token."""
    names = ["level", "g", "context", "suffix", "c"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = [pa.table({n: pa.array([], pa.int32() if n == "level" else pa.int64()) for n in names})]
        if left.num_rows:
            symbols, starts, _ = _opened(left.drop_columns(["ids"]).slice(0, 1).to_pylist()[0])
            replies: dict[int, list[dict]] = {}
            for r in right.select(["level", "part", "size", "owned", "counts"]).sort_by([("level", "ascending"), ("part", "ascending")]).to_pylist():
                replies.setdefault(r["level"], []).append(r)
            for level, distinct, code, at, _, shorter in _levels(symbols, starts, _answers(right), depth + 1):
                rows = replies.get(level, [])
                if not rows:
                    continue
                own = np.flatnonzero(
                    np.concatenate([np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=r["size"]) for r in rows])
                )
                place = np.empty(len(distinct), np.int64)
                place[code] = at
                place = place[own]
                none = np.zeros(len(own), np.int64)
                columns = [
                    pa.array(np.full(len(own), level, np.int32)), pa.array(distinct[own].view(np.int64)),
                    pa.array(none if level == 1 else shorter[place - 1].view(np.int64)),
                    pa.array(none if level == 1 else shorter[place].view(np.int64)),
                    pa.array(np.concatenate([unpack(r["counts"]) for r in rows])),
                ]
                tables.append(pa.Table.from_arrays(columns, names))
        return pa.concat_tables(tables)

    kinds = "level int, g long, context long, suffix long, c long"
    return materialised(chunks.groupBy("chunk").cogroup(passed.groupBy("chunk")).applyInArrow(run, kinds), "grams")


def _model(grams: DataFrame, depth: int, unit: float, prior: float) -> DataFrame:
    """(level, g, gain, rest) of every counted n-gram.

    ``gain``: log10 of its last token's probability in the context of the others over the root's, where that context is retained.
    ``rest``: where it is retained as a context, log10 of the factor on the suffix's probability for continuations that were not
    counted.
    """
    root = (F.col("c") + 0.5) / unit
    shorter = grams.where("level = 1").select("g", "c", root.alias("p"), root.alias("root"), F.lit(None).cast("double").alias("gain"))
    out = None
    for level in range(1, depth + 1):
        pairs = grams.where(F.col("level") == level + 1).select("g", "context", "suffix", "c")
        below = shorter.select(F.col("g").alias("suffix"), F.col("p").alias("below"), "root")
        pairs = materialised(pairs.join(below, "suffix").drop("suffix"), "continuations")
        sums = pairs.groupBy("context").agg(
            F.count("*").alias("k"), F.sum("c").alias("counted"), F.sum("below").alias("under"),
            F.sum(F.col("c") * F.log(F.col("c") / F.col("below"))).alias("likely"),
        )
        n, counted = F.col("n").cast("double"), F.col("counted").cast("double")
        left, left_below = n - counted, F.greatest(F.lit(1e-12), 1 - F.col("under"))
        gain = F.col("likely") - counted * F.log(n) + F.when(left > 0, left * F.log(left / (n * left_below))).otherwise(0.0)
        kept = (
            sums.join(shorter.select(F.col("g").alias("context"), F.col("c").alias("n")), "context")
            .where(2 * gain > F.col("k") + 6 * F.sqrt(2 * F.col("k")) + 10)
            .select(
                "context", "n",
                F.log10(F.greatest(F.lit(1e-12), 1 - (counted + prior * F.col("under")) / (n + prior)) / left_below).alias("rest"),
            )
        )
        kept = materialised(kept, "states")
        rest = kept.select(F.col("context").alias("g"), "rest")
        some = shorter.join(rest, "g", "left").select(F.lit(level).alias("level"), "g", "gain", "rest")
        out = some if out is None else out.unionByName(some)
        own = (F.col("c") + prior * F.col("below")) / (F.col("n") + prior)
        shorter = materialised(
            pairs.join(kept.select("context", "n"), "context", "left").select(
                "g", "c", F.coalesce(own, "below").alias("p"), "root", F.log10(own / F.col("root")).alias("gain")
            ),
            "probabilities",
        )
    return out.unionByName(
        shorter.select(F.lit(depth + 1).alias("level"), "g", "gain", F.lit(None).cast("double").alias("rest"))
    )


def _told(passed: DataFrame, model: DataFrame, bits: int) -> DataFrame:
    """Per chunk, level and key range: the bits of ``passed`` with the values of the n-grams that are counted."""
    schema = T.StructType.fromDDL("chunk long, level int, part int, size int, counted binary, gain binary, rest binary")
    kinds = _arrow(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("g").to_numpy().view(np.uint64))
        values = {n: right.column(n).to_numpy()[order].astype(np.float64) for n in ("gain", "rest")}
        out = []
        for r in left.to_pylist():
            rank = np.cumsum(unpack(r["ranks"]))
            row = {n: r[n] for n in ("chunk", "level", "part", "size", "counted")}
            for n, value in values.items():
                own = value[rank]
                there = ~np.isnan(own)
                row[n] = len(own).to_bytes(4, "big") + np.packbits(there).tobytes() + own[there].tobytes()
            out.append(row)
        return pa.Table.from_pylist(out, kinds)

    model = model.withColumn("part", F.shiftrightunsigned("g", 64 - bits).cast("int"))
    left = passed.select("chunk", "level", "part", "size", "counted", "ranks")
    return left.groupBy("level", "part").cogroup(model.groupBy("level", "part")).applyInArrow(run, schema)


def _values_of(table: pa.Table, level: int, name: str) -> np.ndarray:
    """The values of a level's counted n-grams in key order, NaN where there is none."""
    rows = table.select(["level", "part", name]).to_pylist()
    out = [np.zeros(0)]
    for r in sorted((r for r in rows if r["level"] == level), key=lambda r: r["part"]):
        n = int.from_bytes(r[name][:4], "big")
        end = 4 + (n + 7) // 8
        value = np.full(n, np.nan)
        value[np.unpackbits(np.frombuffer(r[name][4:end], np.uint8), count=n).astype(bool)] = np.frombuffer(r[name][end:], np.float64)
        out.append(value)
    return np.concatenate(out)


def scored(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    min_count: int = MIN_COUNT,
    prior: float = PRIOR,
    **sizes: int,
) -> DataFrame:
    """One row per input row: its id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    ids = F.col(f"`{doc_id}`")
    tokens = F.concat(words_of(text_of(f"`{text}`")), F.array(F.lit(END)))
    table = coded(df, ids, tokens, ~held_out(ids), change=_lower, **sizes)
    total = _counts_of(table)
    values = _values(table, min_count)
    distinct = int(values.agg(F.sum("new")).first()[0] or 0)
    chunks = _documents(table, values, total, distinct, df.schema[doc_id])

    bits = max(4, (chunks.count() - 1).bit_length())  # a range of keys holds about as many n-grams as a chunk
    passed = _counted(chunks, depth, min_count, bits)
    model = _model(_grams(chunks, passed, depth, bits), depth, total + 0.5 * (distinct + 1), prior)
    told = _told(passed, model, bits)
    schema = T.StructType(
        [
            df.schema[doc_id],
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    kinds = _arrow(schema)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], kinds)
        row = left.drop_columns(["ids"]).slice(0, 1).to_pylist()[0]
        symbols, starts, sizes = _opened(row)
        answers = _answers(right)
        gains, state, rest = np.zeros(len(symbols)), None, None
        for level, _, _, at, rank, _ in _levels(symbols, starts, answers, depth + 1):
            gain, own = _values_of(right, level, "gain"), _values_of(right, level, "rest")
            index = np.full(len(symbols), -1)
            index[at] = rank
            if level > 1:
                inside = np.flatnonzero(state >= 0)
                inside = inside[~np.isnan(rest[state[inside]])]
                pair = index[inside]
                value = np.where(pair >= 0, gain[np.maximum(pair, 0)] if len(gain) else np.nan, np.nan)
                # from the shortest context up: a longer state replaces what a shorter one said
                gains[inside] = np.where(np.isnan(value), gains[inside] + rest[state[inside]], value)
            state, rest = _before(index, starts, -1), own
        base = np.frombuffer(row["base"], np.float64)
        return pa.Table.from_arrays(
            [
                left.column("ids").combine_chunks().flatten(), pc.invert(pa.array(unpack(row["flags"]).astype(bool))),
                pa.array(sizes), pa.array(unpack(row["known"])), pa.array(np.full(len(sizes), total, np.int64)),
                pa.array(base), pa.array(base + np.add.reduceat(gains, starts)),
            ],
            schema.names,
        )

    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, schema)
