"""Token diffs of pairs of texts: longest common subsequences by whole rows of bits, or the greedy O(ND) algorithm."""

from __future__ import annotations

import numpy as np

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import segment

from . import rows

#: Frontiers between two that are kept; those of one stretch are computed again on the way back.
STRETCH = 256


def _ids(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    number: dict = {}
    return tuple(np.array([number.setdefault(x, len(number)) for x in s], np.int64) for s in (a, b))


def _slide(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Move each (x, y) on while the next elements are equal, in place."""
    n, m = len(a), len(b)
    at = np.flatnonzero((x < n) & (y < m))
    while len(at) > 8:
        at = at[a[x[at]] == b[y[at]]]
        x[at] += 1
        y[at] += 1
        at = at[(x[at] < n) & (y[at] < m)]
    for i in at.tolist():
        p, q, step = int(x[i]), int(y[i]), 16
        while p < n and q < m:
            size = min(step, n - p, m - q)
            same = a[p : p + size] == b[q : q + size]
            run = size if same.all() else int(same.argmin())
            p, q, step = p + run, q + run, step * 2
            if run < size:
                break
        x[i], y[i] = p, q


def _next(a: np.ndarray, b: np.ndarray, before: np.ndarray | None, d: int, prefer: str) -> tuple[np.ndarray, np.ndarray]:
    """Furthest x on the diagonals -d, -d + 2, ... d, and which of them came by an insertion."""
    if before is None:
        down, x = np.zeros(1, bool), np.zeros(1, np.int64)
    else:
        left, right = before[:-1], before[1:]
        down = np.concatenate([[True], left <= right if prefer == "insert" else left < right, [False]])
        x = np.where(down, np.append(before, 0), np.append(0, before) + 1)
    y = x - np.arange(-d, d + 1, 2)
    _slide(a, b, x, y)
    return x, down


class _Common:
    """Lengths of common subsequences of ``a`` and parts of ``b``: bit x of row y is set where a[: x + 1] and b[:y] have one more in common than a[:x] and b[:y] do.

    Each row takes a few operations on whole numbers of as many bits as ``a`` has elements.
    """

    def __init__(self, a: list, b: list):
        self.b, self.ones = b, (1 << len(a)) - 1
        self.at: dict = {}
        places: dict = {}
        for i, x in enumerate(a):
            places.setdefault(x, []).append(i)
        for x, where in places.items():
            bits = bytearray(len(a) // 8 + 1)
            for i in where:
                bits[i >> 3] |= 1 << (i & 7)
            self.at[x] = int.from_bytes(bits, "little")

    def after(self, row: int, start: int, stop: int) -> list[int]:
        """The rows start + 1 ... stop, given that of ``start``; held inverted."""
        ones, at, out = self.ones, self.at, []
        for x in self.b[start:stop]:
            m = row & at.get(x, 0)
            row = (row + m | row - m) & ones
            out.append(row)
        return out

    def last(self) -> int:
        ones, at, row = self.ones, self.at, self.ones
        for x in self.b:
            m = at.get(x, 0)
            if m:
                m &= row
                row = (row + m | row - m) & ones
        return row


def equal_count(a: list, b: list) -> int:
    """How many elements the longest common subsequence has."""
    common = _Common(a, b)
    return len(a) - common.last().bit_count()


def _fewest(a: list, b: list, limit: int | None) -> list[tuple[str, int, int, int, int]] | None:
    """The path of the greedy algorithm that prefers deletions, as runs; None beyond ``limit`` edits.

    That algorithm comes from each end of a diagonal by an insertion where this leads to one
    with an edit less, else by a deletion, else along equal elements.  So only lengths of common
    subsequences decide.  Every ``STRETCH``-th row is kept.
    """
    common = _Common(a, b)
    x, y = len(a), len(b)
    kept, row = [common.ones], common.ones
    for base in range(0, y, STRETCH):
        row = common.after(row, base, min(base + STRETCH, y))[-1]
        kept.append(row)
    same = x - row.bit_count()
    if limit is not None and x + y - 2 * same > limit:
        return None
    runs: list[list] = []
    base, part = y, [row]  # rows base, base + 1, ...

    def row_of(i: int) -> int:
        nonlocal base, part
        if i < base:
            base = (i // STRETCH) * STRETCH
            first = kept[i // STRETCH]
            part = [first, *common.after(first, base, min(base + STRETCH, len(b)))]
        return part[i - base]

    while x or y:
        x1, y1 = x, y
        if y and x - (row_of(y - 1) & (1 << x) - 1).bit_count() == same:
            op, y = "insert", y - 1
        elif x and row_of(y) >> x - 1 & 1:
            op, x = "delete", x - 1
        else:
            op, x, y, same = "equal", x - 1, y - 1, same - 1
        if runs and runs[-1][0] == op:
            runs[-1][1], runs[-1][3] = x, y
        else:
            runs.append([op, x, x1, y, y1])
    return [tuple(r) for r in reversed(runs)]


def edit_script(a: list, b: list, prefer: str = "delete", max_d: int | None = None) -> tuple[list[tuple[str, int, int, int, int]], bool]:
    """Runs (op, a0, a1, b0, b1) from ``a`` to ``b``, and whether it was cut short.

    With ``prefer`` "delete" the single edits are the fewest.  "insert" takes an insertion wherever
    both neighbouring diagonals reach equally far, and may need more: its time grows with the product of
    edits and diagonals.  Beyond ``max_d`` edits all of ``a`` is deleted and all of ``b`` inserted.
    """
    n, m = len(a), len(b)
    if prefer == "delete":
        runs = _fewest(a, b, max_d)
        if runs is not None:
            return runs, False
        return _replaced(n, m), True
    p, q = _ids(a, b)
    limit = n + m if max_d is None else min(max_d, n + m)
    kept: dict[int, np.ndarray | None] = {0: None}
    front = None
    for d in range(limit + 1):
        if d % STRETCH == 0:
            kept[d] = front
        front, _ = _next(p, q, front, d, prefer)
        k = np.arange(-d, d + 1, 2)
        if ((front >= n) & (front - k >= m)).any():
            return _walk(p, q, kept, d, prefer), False
    return _replaced(n, m), True


def _replaced(n: int, m: int) -> list[tuple[str, int, int, int, int]]:
    return [r for r in (("delete", 0, n, 0, 0), ("insert", n, n, 0, m)) if r[1] < r[2] or r[3] < r[4]]


def edit_counts(a: list, b: list, prefer: str = "delete", max_d: int | None = None) -> dict[str, int]:
    """Elements that ``edit_script`` keeps, deletes and inserts."""
    total = dict.fromkeys(("equal", "delete", "insert"), 0)
    if prefer == "delete":
        same = equal_count(a, b)
        if max_d is not None and len(a) + len(b) - 2 * same > max_d:
            same = 0
        return {"equal": same, "delete": len(a) - same, "insert": len(b) - same}
    for op, a0, a1, b0, b1 in edit_script(a, b, prefer, max_d)[0]:
        total[op] += b1 - b0 if op == "insert" else a1 - a0
    return total


def _walk(a: np.ndarray, b: np.ndarray, kept: dict, last: int, prefer: str) -> list[tuple[str, int, int, int, int]]:
    """The path back from the ends, as runs in order."""
    runs: list[list] = []
    x, y = len(a), len(b)

    def add(op: str, x0: int, y0: int) -> None:
        if x0 == x and y0 == y:
            return
        if runs and runs[-1][0] == op:
            runs[-1][1], runs[-1][3] = x0, y0
        else:
            runs.append([op, x0, x, y0, y])

    for base in range(last - last % STRETCH, -1, -STRETCH):
        stretch, front = [], kept[base]
        for d in range(base, min(base + STRETCH, last + 1)):
            before = front
            front, down = _next(a, b, front, d, prefer)
            stretch.append((d, before, down))
        for d, before, down in reversed(stretch):
            j = (x - y + d) // 2
            if d == 0:
                add("equal", 0, 0)
                break
            x0 = int(before[j]) if down[j] else int(before[j - 1]) + 1
            y0 = x0 - (x - y)
            add("equal", x0, y0)
            x, y = x0, y0
            if down[j]:
                add("insert", x, y - 1)
                y -= 1
            else:
                add("delete", x - 1, y)
                x -= 1
    return [tuple(r) for r in reversed(runs)]


EDITS = "array<struct<op:string,a0:int,a1:int,b0:int,b1:int>>"


def edits(a: Column, b: Column, prefer: str = "delete", max_d: int | None = None) -> Column:
    """Edit script between two array<string> columns."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        names = ("op", "a0", "a1", "b0", "b1")
        return pd.Series([[dict(zip(names, r, strict=True)) for r in edit_script(list(p), list(q), prefer, max_d)[0]] for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(run, EDITS)(a, b)


def diff_texts(pairs: DataFrame, a: str = "a", b: str = "b", repertoire: str = "auto") -> DataFrame:
    """``pairs`` with a_tokens, b_tokens and the tokens that are equal, deleted and inserted; texts are dropped; null texts count as empty."""

    def make(p: str | None, q: str | None) -> tuple:
        x, y = (segment.pieces(t or "", "word") for t in (p, q))
        n = edit_counts(x, y)
        return len(x), len(y), n["equal"], n["delete"], n["insert"]

    return rows.each(pairs, [c for c in pairs.columns if c not in (a, b)], [a, b], ",".join(f"{n}:bigint" for n in ("a_tokens", "b_tokens", "equal", "deleted", "inserted")), make)


def text_diffs(pairs: DataFrame, a: str = "a", b: str = "b", tokenizer: str = "uax29-word", key: str = "raw", most: int | None = None, max_d: int | None = None, prefer: str = "delete", table: dict | None = None) -> DataFrame:
    """``pairs`` without the texts, with ``diff``: edits with spans and a summary as canonical JSON, its checksum, and whether it was cut short.

    Null texts count as empty.
    """
    from spanloom.functions import kernels, pack
    from spanloom.functions.security import Skeletons

    known = Skeletons(table or {})

    def make(p: str | None, q: str | None) -> tuple:
        import hashlib

        d = pack.diff(p or "", q or "", most, max_d, prefer, tokenizer=tokenizer, key=key, table=known)
        text = kernels.jcs_plain(d)
        return text, f"sha256:{hashlib.sha256(text.encode()).hexdigest()}", d.get("truncated", False)

    return rows.each(pairs, [c for c in pairs.columns if c not in (a, b)], [a, b], "diff:string,sha256:string,truncated:boolean", make)


def compare_texts(pairs: DataFrame, a: str = "a", b: str = "b", tokenizer: str = "uax29-word", key: str = "raw", k: int = 5, window: int = 4, dedupe: str = "by-hash", with_diff: bool = True, most: int | None = None, max_d: int | None = None, prefer: str = "delete", table: dict | None = None) -> DataFrame:
    """``pairs`` without the texts, with fingerprint overlap, the exact fractions and edit counts; null texts count as empty."""
    from spanloom.functions import pack
    from spanloom.functions.security import Skeletons

    known = Skeletons(table or {})
    fractions = ("jaccard", "containmentAinB", "containmentBinA")
    names = ["overlap", *[f"{f}_{p}" for f in ("jaccard", "a_in_b", "b_in_a") for p in ("num", "den")], "inserted", "deleted", "equal"]

    def make(p: str | None, q: str | None) -> tuple:
        cut = [pack.tokenize(t or "", most=most, tokenizer=tokenizer, key=key, table=known) for t in (p, q)]
        f = pack.compared(*cut, k, window, dedupe)
        edits = edit_counts(*[[t["key"] for t in c] for c in cut], prefer, max_d) if with_diff else {}
        return int(f["overlapCount"]), *[int(f[n][h]) for n in fractions for h in ("num", "den")], *[edits.get(n) for n in ("insert", "delete", "equal")]

    return rows.each(pairs, [c for c in pairs.columns if c not in (a, b)], [a, b], ",".join(f"{n}:bigint" for n in names), make)
