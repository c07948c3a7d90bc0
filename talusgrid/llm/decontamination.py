"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised to lower-case words parted by single spaces. An item of m
characters may be matched with up to k = floor(rate * m) edits anywhere in a document. It is
split into k + 1 pieces: k edits leave at least one piece untouched, so documents are searched
for exact pieces first. A hit is followed up the tree of neighbouring pieces: a part of n pieces
that keeps to n - 1 edits has a half that keeps to its own number less one, so most chance hits
end a few characters wide. What remains is verified by Myers' bit-parallel distance over the
window that the whole item could cover.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm import runtime as R

_WORD = re.compile(r"[^\W_]+")
#: Characters of test items in one automaton (about 100 bytes of memory for each); more items are more blocks.
PASS_CHARS = 400_000
#: Characters of documents that are held while several blocks of items go over them.
HELD_CHARS = 16 << 20


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall(text.lower())) if text else ""


@dataclass
class Node:
    """A part [start, end) of an item with its edit budget; leaves are the pieces."""

    start: int
    end: int
    budget: int
    parent: Node | None = None
    masks: dict[str, int] | None = field(default=None, repr=False)


def pieces(m: int, k: int) -> list[Node]:
    """The k + 1 leaves of the tree over an item of m characters, each with its way to the root."""
    leaves = []

    def split(start: int, end: int, count: int, parent: Node | None) -> None:
        # parts of a and b pieces can't both have as many edits as pieces if there are only a + b - 1
        node = Node(start, end, count - 1, parent)
        if count == 1:
            leaves.append(node)
            return
        left = count // 2
        middle = start + (end - start) * left // count
        split(start, middle, left, node)
        split(middle, end, count - left, node)

    split(0, m, k + 1, None)
    return leaves


def distance_in(pattern: str, text: str, budget: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """The least edit distance of the pattern to a part of the text, and where such a part first ends.

    Myers' algorithm on one integer of len(pattern) bits; None above the budget.
    """
    m = len(pattern)
    if masks is None:
        masks = masks_of(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, where = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        diagonal = ((((eq & up) + up) ^ up) | eq) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(x | plus)), plus & x
        if score < best:
            best, where = score, i + 1
    return (best, where) if best <= budget else None


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Finds test items in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, p) for i, p in items if p]
        self.automaton = ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, Node]]] = {}
        for n, (_, p) in enumerate(self.items):
            for leaf in pieces(len(p), int(rate * len(p))):
                by_piece.setdefault(p[leaf.start : leaf.end], []).append((n, leaf))
        for piece, uses in by_piece.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if by_piece:
            self.automaton.make_automaton()
        self.empty = not by_piece

    def _holds(self, n: int, leaf: Node, text: str, at: int) -> tuple[int, int, int] | None:
        """Distance, start and end of the item around its piece found at ``at``; None if it isn't there."""
        pattern, node = self.items[n][1], leaf
        while node.parent is not None:
            node = node.parent
            low = max(0, at - (leaf.start - node.start) - node.budget)
            high = min(len(text), at + (node.end - leaf.start) + node.budget)
            if node.masks is None:
                node.masks = masks_of(pattern[node.start : node.end])
            if (hit := distance_in(pattern[node.start : node.end], text[low:high], node.budget, node.masks)) is None:
                return None
        if leaf.parent is None:
            return 0, at, at + len(pattern)
        end = low + hit[1]
        # the start: the reversed item in the reversed window before the end
        back = distance_in(pattern[::-1], text[low:end][::-1], node.budget)
        return hit[0], end - back[1], end

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of each item with its best match in a normalised text.

        Matches of items begin and end at word edges, give or take the budget.
        """
        if self.empty or not text:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (size, uses) in self.automaton.iter(text):
            at = last - size + 1
            for n, leaf in uses:
                if n in best and best[n][0] == 0:
                    continue
                origin = at - leaf.start
                if (n, origin) in tried or (hit := self._holds(n, leaf, text, at)) is None:
                    continue
                tried.add((n, origin))
                if leaf.parent is None and not self._at_words(text, hit[1], hit[2]):
                    continue
                if n not in best or hit < best[n]:
                    best[n] = hit
        return [(self.items[n][0], *hit) for n, hit in sorted(best.items())]

    @staticmethod
    def _at_words(text: str, start: int, end: int) -> bool:
        return (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " ")


def _blocks(benchmark: DataFrame) -> list[str]:
    """Paths of the test items, in files of the shared folder with about PASS_CHARS characters each.

    The items stream through the driver, which holds one block of them at a time.
    """
    spark = benchmark.sparkSession
    paths: list[str] = []
    held: list[tuple[int | None, str]] = []
    chars = 0

    def put() -> None:
        paths.append(R.new_path(spark, "items"))
        R.put_file(paths[-1], json.dumps(held).encode())

    for row in benchmark.select(F.col("item_id").cast("long").alias("item"), "text").where("text is not null").toLocalIterator():
        text = normal(row.text)
        if chars + len(text) > PASS_CHARS and held:
            put()
            held, chars = [], 0
        if text:
            held.append((row.item, text))
            chars += len(text)
    if held:
        put()
    return paths


#: The matcher that a worker made last, by its block's path and the rate.
_CACHE: dict[tuple[str, float], Matcher] = {}


def _matcher(path: str, rate: float) -> Matcher:
    if (path, rate) not in _CACHE:
        _CACHE.clear()
        items = json.loads(R.map_file(path, np.uint8).tobytes().decode())
        _CACHE[path, rate] = Matcher([(i, text) for i, text in items], rate)
    return _CACHE[path, rate]


def _matched(batches: Iterator[pa.RecordBatch], at: int, paths: list[str], rate: float, first_only: bool) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int, int, int]]]]]:
    """Each batch with the finds in each row's text; with ``first_only`` a text isn't searched on after a find.

    With several blocks of items, batches are held until they have HELD_CHARS characters, and
    every block is loaded once for all of them: the documents are read once, whatever the number of items.
    """
    held: list[tuple[pa.RecordBatch, list[str], list[list[tuple[int, int, int, int]]]]] = []

    def flush() -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int, int, int]]]]]:
        for path in paths:
            matcher = _matcher(path, rate)
            for _, texts, found in held:
                for text, hits in zip(texts, found, strict=True):
                    if not (first_only and hits):
                        hits += matcher.find(text)
        for batch, _, found in held:
            yield batch, found
        held.clear()

    chars = 0
    for batch in batches:
        texts = [normal(x) for x in batch.column(at).to_pylist()]
        held.append((batch, texts, [[] for _ in texts]))
        chars += sum(map(len, texts))
        if len(paths) < 2 or chars >= HELD_CHARS:
            yield from flush()
            chars = 0
    yield from flush()


def find_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for each test item found in each document's whole text.

    The distance is in edited characters of the normalised forms, at most floor(rate * length
    of the item); start and end are positions in the document's normalised text: of equal
    distances the match that starts first. A match of no edits that has one piece only must
    begin and end at word edges. Null texts, and items and documents without letters or
    digits, match nothing; null ids are reported as null, repeated rows each for itself.
    Other columns are ignored. The documents are read once; blocks of items go over them by turns.
    """
    docs = R.columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    paths = _blocks(R.columns(benchmark, "item_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _matched(batches, 1, paths, rate, False):
            rows = [(i, *hit) for i, hits in zip(batch.column(0).to_pylist(), found, strict=True) for hit in hits]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

    return R.arrow_map(docs, run, "doc_id long, item_id long, distance int, start int, end int")


def without_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """The documents, all columns, in whose text no test item is found.

    Documents without a text, or without letters or digits, stay, and so do all if there are
    no items. Rows are judged each by its own text, whatever their ids: repeated ones stay or
    go together. The documents are read once, as in find_leaks.
    """
    at = documents.columns.index("text")
    paths = _blocks(R.columns(benchmark, "item_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _matched(batches, at, paths, rate, True):
            yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

    return R.same_columns(documents, run)
