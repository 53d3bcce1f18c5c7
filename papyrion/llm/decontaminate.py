"""Benchmark decontamination by pigeonhole edit matching.

With an error budget of k words, an item cut into k + 1 pieces has at least one piece untouched in any
copy within the budget. Documents are searched for exact pieces; each hit fixes a window in which
Myers' bit-parallel algorithm finds the least edit distance of the whole item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import small_batches

# a character of a script written without spaces is a word of its own
_LONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_LONE}]|[^\W_{_LONE}]+")
_P = np.uint64(0x9E3779B97F4A7C15)
#: Characters of a benchmark at most.
LARGEST = 50_000_000


@dataclass(frozen=True)
class Params:
    """An item of n words may differ in ``percent`` of them (at least in ``floor``); items of fewer than ``min_words`` words must occur whole."""

    percent: int = 20
    floor: int = 1
    min_words: int = 8


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; single characters in scripts without spaces."""
    return _WORD.findall((text or "").lower())


def myers(pattern: list[int], text: list[int]) -> int:
    """Least edit distance between ``pattern`` and any stretch of ``text``, by bit vectors of the pattern's length."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, now, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        best = min(best, now)
    return best


class Matcher:
    """Finds the items of a benchmark in texts."""

    def __init__(self, items: list[tuple[int, str]], p: Params = Params()):
        self.words: dict[str, int] = {}
        self.items: list[tuple[int, list[int], int]] = []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        seen: dict[tuple[int, ...], int] = {}
        self.same: dict[int, list[int]] = {}
        for item_id, text in sorted((i, t) for i, t in items if i is not None):
            ids = tuple(self.words.setdefault(w, len(self.words) + 1) for w in tokens(text))
            if not ids:
                continue
            if ids in seen:  # equal items are searched once
                self.same[seen[ids]].append(item_id)
                continue
            at, budget = len(self.items), max(p.floor, len(ids) * p.percent // 100) if len(ids) >= p.min_words else 0
            seen[ids], self.same[at] = at, [item_id]
            self.items.append((item_id, list(ids), budget))
            cuts = [len(ids) * k // (budget + 1) for k in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(b - a, []).append((self._hash(np.array(ids[a:b], np.uint64), b - a)[0], at, a))
        self.pieces = {}
        for size, found in pieces.items():
            by: dict[int, list[tuple[int, int]]] = {}
            for h, at, a in found:
                by.setdefault(int(h), []).append((at, a))
            self.pieces[size] = (np.array(sorted(by), np.uint64), by)

    @staticmethod
    def _hash(ids: np.ndarray, size: int) -> np.ndarray:
        """A hash of every stretch of ``size`` words."""
        n = max(0, len(ids) - size + 1)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            x = ids[k : k + n]
            h = h * _P + x * x + x
        return h

    def find(self, text: str | None) -> dict[int, int]:
        """``{item_id: edit distance}`` of the items within their budgets."""
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in tokens(text)), np.uint64)
        best: dict[int, int] = {}
        tried: dict[int, set[int]] = {}
        for size, (hashes, by) in self.pieces.items():
            h = self._hash(ids, size)
            if not len(h):
                continue
            spot = np.searchsorted(hashes, h)
            spot[spot == len(hashes)] = 0
            for i in np.flatnonzero(hashes[spot] == h).tolist():
                for at, a in by[int(h[i])]:
                    _, item, budget = self.items[at]
                    begin = i - a
                    # starts within one budget of each other share a window
                    slot = begin // (budget + 1)
                    if best.get(at) == 0 or slot in tried.setdefault(at, set()):
                        continue
                    tried[at].add(slot)
                    low = max(0, slot * (budget + 1) - budget)
                    high = (slot + 1) * (budget + 1) + len(item) + budget
                    d = myers(item, ids[low:high].tolist())
                    if d <= budget and d < best.get(at, budget + 1):
                        best[at] = d
        return {i: d for at, d in best.items() for i in self.same[at]}


def _matcher(docs: DataFrame, benchmark: DataFrame, p: Params) -> Broadcast[Matcher]:
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > LARGEST:
        raise ValueError(f"a benchmark of {size} characters is too large to broadcast; split it and search for its parts in turn")
    items = [(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), "text").collect()]
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(Matcher(items, p))


def matches(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, contaminated, items, distances)`` per row: ids of the items found, in order, and their distances.

    The benchmark is a fixed test set that fits on the driver; one of more than ``LARGEST`` characters
    is refused. Null texts match nothing; items with a null id or without words are left out, and an
    empty benchmark marks no row.
    """
    made = _matcher(docs, benchmark, p)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = made.value.find
        for b in batches:
            found = [sorted(find(t.as_py()).items()) for t in b.column(1)]
            ids = pa.array([[i for i, _ in x] for x in found], pa.list_(pa.int64()))
            far = pa.array([[d for _, d in x] for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bool(x) for x in found], pa.bool_()), ids, far], [key, "contaminated", "items", "distances"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, contaminated boolean, items array<long>, distances array<int>")


def clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    made = _matcher(docs, benchmark, p)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = made.value.find
        for b in batches:
            yield b.filter(pa.array([not find(t.as_py()) for t in b.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
