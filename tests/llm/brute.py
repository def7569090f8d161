"""Plain-Python versions of the operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    ws = words(text)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(ws)
    return {
        "n_words": n,
        "word_chars": sum(map(len, ws)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def line_dedup(rows, min_chars=40, min_docs=5):
    """{(id, text): (n_lines, n_dropped, kept)}"""
    holders = defaultdict(set)

    def key(x):
        return x.strip(SPACE).translate(LOWER)

    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out[i, t] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingles(text, size=5):
    ws = words((text or "").translate(LOWER))
    if len(ws) < size:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}


def near_groups(rows, percent=85):
    """{id: smallest id reachable}, sizes {(id, text): n}"""
    sets = {(i, t): shingles(t) for i, t in rows}
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(i, s) for (i, _), s in sets.items() if i is not None and s]
    for k, (i, s) in enumerate(named):
        for j, r in named[:k]:
            both = len(s & r)
            if 100 * both >= percent * (len(s) + len(r) - both):
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}, {k: len(s) for k, s in sets.items()}


def best_distance(item, text):
    """Least edit distance of the item to any substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def repeated_bytes(rows, length):
    """{(id, text): (n_bytes, n_removed, n_spans, kept)} of distinct (id, text) in id order."""
    seen, out = {}, {}
    known = sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0])
    for i, t in known:
        raw = (t or "").encode()
        for at in range(len(raw) - length + 1):
            seen.setdefault(raw[at : at + length], (i, at))
    for i, t in set(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            if i is not None and seen[raw[at : at + length]] != (i, at):
                gone[at : at + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, t] = (len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out
