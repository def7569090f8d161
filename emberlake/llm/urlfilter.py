"""URL filter: all glob rules in one bit-parallel Shift-And automaton.

The rules are packed side by side into an array of 64-bit words, one bit per glob position. All
URLs of a batch take their next byte together, so a step is a handful of array operations over
(URLs x words) whatever the number of rules.

A glob is matched against the canonical URL ``.host/path``: ``?`` is any byte, ``*`` any run of bytes,
``%`` any run without ``/``, and ``[abc]`` one of the bytes. A URL that is null or has no ``://`` has an
empty host and path. Long URLs are read to their end. Rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.common import LOWER_CHARS, with_columns


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains and the start of a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"%.{self.host}{self.path}*"


# Blocked where no rule decides.
BLOCKED_GLOBS = (
    "*.spam*/*", "*-farm.%/*", "*casino*", "*.xxx/*", "*.porn%/*",
    "*.exe", "*.zip", "*/wp-login.php*", "*/cgi-bin/*",
    ".[0123456789]%.[0123456789]%.[0123456789]%.[0123456789]/*",
)


class ShiftAnd:
    """Several globs as one automaton over bytes."""

    def __init__(self, globs: list[str]):
        tokens, loops, ends, starts = [], [], [], []
        for glob in globs:
            starts.append(len(tokens))
            # bit 0 of a glob stands for "nothing read yet"
            tokens.append(set())
            loops.append(set())
            raw, i = glob.encode("utf-8"), 0
            while i < len(raw):
                byte = raw[i : i + 1]
                if byte == b"*":
                    loops[-1] = set(range(256))
                elif byte == b"%":
                    loops[-1] |= set(range(256)) - {ord("/")}
                else:
                    if byte == b"?":
                        chars = set(range(256))
                    elif byte == b"[" and b"]" in raw[i:]:
                        end = raw.index(b"]", i)
                        chars, i = set(raw[i + 1 : end]), end
                    else:
                        chars = {raw[i]}
                    tokens.append(chars)
                    loops.append(set())
                i += 1
            ends.append(len(tokens) - 1)
        self.words = max(1, -(-len(tokens) // 64))
        self.take = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for bit, (chars, loop) in enumerate(zip(tokens, loops, strict=True)):
            word, mask = bit // 64, np.uint64(1 << (bit % 64))
            for c in chars:
                self.take[c, word] |= mask
            for c in loop:
                self.stay[c, word] |= mask
        for bit in starts:
            self.start[bit // 64] |= np.uint64(1 << (bit % 64))
        self.ends = np.array(ends, np.int64)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Booleans (texts x globs): which glob fits the whole of which text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        order = np.argsort(-lengths, kind="stable")
        offsets, left = offsets[order], lengths[order]
        state = np.tile(self.start, (len(texts), 1))
        active, at = len(texts), 0
        while True:
            # texts are sorted by length, so the ones still being read come first
            active = int(np.searchsorted(-left[:active], -at, side="left"))
            if not active:
                break
            byte = flat[offsets[:active] + at]
            now = state[:active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.take[byte]) | (now & self.stay[byte])
            at += 1
        hit = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(LOWER_CHARS), slash + path


def _bounded(urls: list, most_bytes: int) -> Iterator[list]:
    part, size = [], 0
    for url in urls:
        part.append(url)
        size += len(url or "")
        if size >= most_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def judged(
    df: DataFrame, rules: list[Rule], blocked=BLOCKED_GLOBS, url: str = "url", batch_bytes: int = 4 << 20
) -> DataFrame:
    """Add host, path, rule and verdict to every row.

    The longest fitting rule decides; of equally long ones the one with the longer host, then the
    first by name. Without a rule a URL that fits a blocked glob is blocked and any other allowed.
    Input columns of these names are replaced.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    globs = [r.glob for r in ordered] + list(blocked)
    names = np.array([r.name for r in ordered] + [None], object)
    verdicts = np.array([r.verdict for r in ordered], object)
    fields = ("host", "path", "rule", "verdict")

    df = df.drop(*[c for c in df.columns if c.lower() in fields and c != url])
    schema = T.StructType(
        [f for f in df.schema.fields if f.name.lower() not in fields or f.name == url]
        + [T.StructField(f"__{n}", T.StringType()) for n in fields]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(globs)
        for batch in batches:
            urls = batch.column(batch.schema.get_field_index("__url")).to_pylist()
            found = {n: [] for n in fields}
            for part in _bounded(urls, batch_bytes):
                parts = [host_and_path(u) for u in part]
                hits = automaton.run([f".{h}{p}".encode("utf-8") if h or p else b"" for h, p in parts])
                own = hits[:, : len(ordered)]
                first = np.where(own.any(axis=1), own.argmax(axis=1) if len(ordered) else 0, len(ordered))
                other = np.where(hits[:, len(ordered) :].any(axis=1), "block", "allow")
                found["host"] += [h for h, _ in parts]
                found["path"] += [p for _, p in parts]
                found["rule"] += list(names[first])
                found["verdict"] += [verdicts[k] if k < len(ordered) else str(o) for k, o in zip(first, other)]
            kept = batch.select([n for n in batch.schema.names if n != "__url"])
            yield pa.RecordBatch.from_arrays(
                kept.columns + [pa.array(found[n], pa.string()) for n in fields],
                kept.schema.names + [f"__{n}" for n in fields],
            )

    out = df.select("*", F.col(f"`{url}`").cast("string").alias("__url")).mapInArrow(judge, schema)
    out = with_columns(out, **{n: F.col(f"__{n}") for n in fields if n != url})
    return out.drop(*[f"__{n}" for n in fields])


PAGE_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def _like(glob: str) -> str:
    """The regular expression of a glob, for the SQL text."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[":
            end = glob.index("]", i)
            out, i = out + glob[i : end + 1], end
        else:
            out += {"*": ".*", "%": "[^/]*", "?": "."}.get(c) or (c if c.isalnum() or c in "/-" else "\\" + c)
        i += 1
    return out


SQL = """WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r(name, rhost, rpath, rverdict) AS (VALUES {values}),
f AS (SELECT page_id, name, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(name) DESC, length(rhost) DESC, name) AS k
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, host, path, name AS rule,
  coalesce(rverdict, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN f ON h.page_id = f.page_id AND k = 1""".format(
    values=", ".join(f"('{r.name}', '{r.host}', '{r.path}', '{r.verdict}')" for r in PAGE_RULES),
    blocked=" OR ".join(
        f"(host || path <> '' AND regexp_full_match('.' || host || path, '{_like(g)}', 's'))" for g in BLOCKED_GLOBS
    ),
)
