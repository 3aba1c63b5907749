"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and runs of anything but letters, digits and _ become one space. An item of m
characters may differ by k = floor(rate * m) edits. It is split into k + 1 pieces; an occurrence with at most k
edits holds one of them unchanged. One automaton finds all pieces of all items in one pass over a text; Myers'
bit-parallel distance then verifies, from the piece upward: of j neighbouring pieces that hold at most j - 1
edits, the left or the right part keeps within its own count less one, so a chance hit mostly ends after a
few characters, and no true one is lost.

The items are a stated query set: they are sent to the tasks in blocks of ``block`` items, and every block is
matched against all rows. Nothing of the documents reaches the driver.

Defined results: null or empty texts and items match nothing; an item too short for any edit (its budget is 0)
matches where it stands as whole words; of several occurrences of an item in a text the closest, then the first is
reported; repeated rows are reported each, and so are repeated items, whatever their ids; empty tables give no rows;
other columns are kept, whatever their names. Every block of items costs one more pass over the documents.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.llm.common import fresh, slices

_APART = re.compile(r"\W+")
_MEMO = 50_000
_FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_FOUND_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def normalise(text: str | None) -> str:
    return _APART.sub(" ", (text or "").lower()).strip()


class Pattern:
    """Myers' bit-parallel search for one string; Python's integers serve as words of any width."""

    def __init__(self, s: str) -> None:
        self.m = len(s)
        self.mask = (1 << self.m) - 1
        self.top = 1 << (self.m - 1)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(s):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """(least distance of any substring of text, end of the first such); anchored: of any prefix."""
        pv, mv, score, mask, top = self.mask, 0, self.m, self.mask, self.top
        least, at, get = self.m, 0, self.peq.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xh = ((((eq | mv) & pv) + pv) ^ pv) | eq | mv
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < least:
                    least, at = score, j
            ph = ph << 1 | anchored
            mh <<= 1
            xv = eq | mv
            pv = (mh | ~(xv | ph)) & mask
            mv = ph & xv & mask
        return least, at


class Node:
    """Neighbouring pieces of an item: its part [a, b) may hold ``budget`` edits, one less than its pieces."""

    def __init__(self, a: int, b: int, budget: int, up: Node | None) -> None:
        self.a, self.b, self.budget, self.up = a, b, budget, up
        self.pattern: Pattern | None = None
        self.memo: dict[str, int] = {}


class Item:
    def __init__(self, item_id: int, text: str, rate: float) -> None:
        self.item_id, self.text = item_id, text
        self.budget = int(rate * len(text))
        self.leaves: list[Node] = []
        m, n = len(text), self.budget + 1
        cuts = [j * m // n for j in range(n + 1)]

        def split(lo: int, hi: int, up: Node | None) -> None:
            node = Node(cuts[lo], cuts[hi], hi - lo - 1, up)
            if hi - lo == 1:
                self.leaves.append(node)
            else:
                mid = (lo + hi) // 2
                split(lo, mid, node)
                split(mid, hi, node)

        split(0, n, None)

    def confirm(self, leaf: Node, text: str, at: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of an occurrence around the piece found at ``at``, if there is one."""
        node = leaf.up
        while node is not None:
            lo = max(0, at - (leaf.a - node.a) - node.budget)
            hi = at + (node.b - leaf.a) + node.budget
            window = text[lo:hi]
            node.pattern = node.pattern or Pattern(self.text[node.a : node.b])
            if node.up is None:
                return self._whole(node, text, lo, window)
            distance = node.memo.get(window)
            if distance is None:
                if len(node.memo) >= _MEMO // 50:
                    node.memo.clear()
                distance = node.memo[window] = node.pattern.best(window)[0]
            if distance > node.budget:
                return None
            node = node.up
        end = at + len(self.text)  # one piece: the item itself
        return (0, at, end) if text[at - 1 : at] in ("", " ") and text[end : end + 1] in ("", " ") else None

    def _whole(self, root: Node, text: str, lo: int, window: str) -> tuple[int, int, int] | None:
        distance, end = root.pattern.best(window)
        if distance > self.budget:
            return None
        back = Pattern(self.text[::-1]).best(window[:end][::-1], anchored=True)
        return distance, lo + end - back[1], lo + end


class Matcher:
    """All items of a block; ``find`` gives the matches of one text."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float) -> None:
        import ahocorasick

        pieces: dict[str, list[tuple[int, Item, Node]]] = {}
        for n, (item_id, text) in enumerate(items):
            s = normalise(text)
            if s:
                item = Item(item_id, s, rate)
                for leaf in item.leaves:
                    pieces.setdefault(s[leaf.a : leaf.b], []).append((n, item, leaf))
        self.automaton = None
        if pieces:
            self.automaton = ahocorasick.Automaton()
            for piece, owners in pieces.items():
                self.automaton.add_word(piece, (len(piece), owners))
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[dict]:
        s = normalise(text)
        best: dict[int, tuple[int, tuple[int, int, int]]] = {}
        exact: dict[int, tuple[int, int]] = {}  # the last unchanged occurrence of each item: hits inside it say nothing new
        if s and self.automaton is not None:
            for last, (size, owners) in self.automaton.iter(s):
                at = last + 1 - size
                for n, item, leaf in owners:
                    span = exact.get(n)
                    if span and span[0] <= at and last < span[1]:
                        continue
                    hit = item.confirm(leaf, s, at)
                    if hit:
                        if hit[0] == 0:
                            exact[n] = hit[1:]
                        if n not in best or hit < best[n][1]:
                            best[n] = (item.item_id, hit)
        return [{"item_id": i, "distance": d, "start": a, "end": b} for _, (i, (d, a, b)) in sorted(best.items(), key=lambda x: (x[1][0], x[0]))]


@functools.lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def flag(df: DataFrame, items: tuple[tuple[int, str], ...], text: str = "text", out: str = "leaks", rate: float = 0.08) -> DataFrame:
    """df with the column ``out``: the matches of one block of items, positions in the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items, rate)
        for batch in slices(batches, text):
            found = pa.array([matcher.find(t.as_py()) for t in batch.column(text)], _FOUND_ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, _FOUND)]))


def blocks(benchmark: DataFrame, block: int, ident: str = "item_id", text: str = "text") -> Iterator[tuple[tuple[int, str], ...]]:
    """The items in blocks that fit a task."""
    part: list[tuple[int, str]] = []
    for row in benchmark.filter(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).cast("bigint"), text).toLocalIterator():
        part.append((row[0], row[1]))
        if len(part) == block:
            yield tuple(part)
            part = []
    if part:
        yield tuple(part)


def leaks(df: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", block: int = 5000, **options) -> DataFrame:
    """One row per text and item it holds: doc_id, item_id, distance, start, end."""
    rows = df.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for items in blocks(benchmark, block):
        part = flag(rows, items, **options).select("doc_id", F.inline("leaks"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.limit(0).select("doc_id", F.inline(F.array().cast(_FOUND)))
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", block: int = 5000, **options) -> DataFrame:
    """df without the rows that hold an item."""
    found = fresh(df, "leaks")
    for items in blocks(benchmark, block):
        df = flag(df, items, text, found, **options).filter(F.size(found) == 0).drop(found)
    return df
