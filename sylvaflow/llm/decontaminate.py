"""Benchmark decontamination by SimHash windows and a multi-index over Hamming blocks.

Items are grouped by size. Of each item the first and the last window of its group's size, at least
four fifths of the item, get a 64-bit SimHash over five-word shingles, and so do tiles of it, a third
of the item long and TILE shingles at most. Every window of those sizes of every document gets one too.
Each fingerprint is cut into BLOCKS blocks; of two fingerprints within RADIUS bits, some block differs
by RADIUS // BLOCKS bits at most, so an index of the items' blocks with those changes misses none.
Around each candidate the item-sized windows are compared with the item exactly, as weighted sets of
shingles (weight: number of occurrences): sum of minima / sum of maxima.

Fingerprints of whole windows at similarity 0.8 are ten bits apart on average, beyond what an index can
tell from chance; the tiles let RADIUS do. Of two windows of n shingles at 0.8 at most n / 9 of the
item's are not shared, and a change inside the window takes four neighbours at least (all that span a
changed word or a cut), so there are n / 36 changes at most, each of which meets two tiles at most:
n / 18 of the n / TILE tiles. So one tile is whole, and its fingerprints are equal. A lower threshold
has no such bound.

Benchmark items go to the tasks in slices of SLICE bytes of text, and each slice passes over the
documents, so what is broadcast is bounded at any benchmark size. Documents are never shuffled. A text
of over PIECE bytes is read in pieces that overlap by the longest item, so a task's memory is bounded
at any length of texts that have spaces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.text import Words, as_strings, by_bytes, offsets, shingles

BLOCKS, BLOCK_BITS, RADIUS = 4, 16, 7
SLICE = 4 << 20
#: Text bytes whose windows are fingerprinted at once, and bytes of a text above which it is read in pieces.
STEP, PIECE = 1 << 18, 1 << 20
#: Shingles of an item's tile at most; each item has three tiles or more. Tiles have powers of two, so that texts
#: are passed over for few sizes.
TILE = 16
#: White space, as bytes.
SPACES = frozenset(b" \t\n\v\f\r")
FOUND = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def _sizes(most: int) -> list[int]:
    """Window sizes in shingles, each about a quarter above the one before."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


def running(values: np.ndarray, kind: type) -> np.ndarray:
    """Running sums of the +1/-1 bits of 64-bit hashes, modulo the kind's range."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.int8)
    out = np.zeros((len(values) + 1, 64), kind)
    np.cumsum(bits * np.int8(2) - np.int8(1), axis=0, dtype=kind, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of `size` values."""
    if len(sums) <= size:
        return np.zeros(0, np.uint64)
    return np.packbits((sums[size:] - sums[:-size]) > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


class ItemIndex:
    """The items of a slice: their shingles, and per window size the multi-index of their fingerprints."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: float = 0.8):
        items = [(i, t) for i, t in items if i is not None and t]
        self.least = least
        words = Words(pa.array([t for _, t in items], pa.string()))
        values, first = shingles(words.hash, words.first)
        counts = np.diff(words.first)
        self.ids, self.bags = [i for i, _ in items], []
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        sizes = _sizes(int(np.diff(first).max(initial=1)))
        self.kind = np.int8 if sizes[-1] < 128 else np.int16 if sizes[-1] < 32768 else np.int32
        for k in range(len(items)):
            own = values[first[k] : first[k + 1]]
            self.bags.append(Counter(own.tolist()))
            if counts[k] < 5:
                continue
            sums = running(own, self.kind)
            size = max(s for s in sizes if s <= len(own))
            tile = 1 << min(TILE, max(len(own) // 3, 1)).bit_length() - 1
            places = {(size, 0), (size, len(own) - size), (tile, len(own) - tile)}
            places |= {(tile, offset) for offset in range(0, len(own) - tile + 1, tile)}
            marks = {s: fingerprints(sums, s) for s in (size, tile)}
            for s, offset in sorted(places):
                by_size.setdefault(s, []).append((k, offset, int(marks[s][offset])))
        self.lengths = np.diff(first)
        #: Words that pieces of a text share, so that each item-sized window is whole in one.
        self.overlap = int(self.lengths.max(initial=1)) + 4
        self.own = [np.sort(values[first[k] : first[k + 1]]) for k in range(len(items))]
        self.need = np.maximum(np.ceil(least * self.lengths - 1e-9), 1).astype(np.int64)
        self.classes = [(size, *self._index(rows)) for size, rows in sorted(by_size.items())]

    @staticmethod
    def _index(rows: list[tuple[int, int, int]]):
        item, offset = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        marks = np.array([r[2] for r in rows], np.uint64)
        flips = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)]
        tables = []
        for b in range(BLOCKS):
            block = ((marks >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            value = (block[:, None] ^ np.array(flips)).reshape(-1)
            owner = np.repeat(np.arange(len(rows)), len(flips))
            order = np.argsort(value, kind="stable")
            start = np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1))
            tables.append((np.diff(start) > 0, start, owner[order]))
        return item, offset, marks, tables

    def candidates(self, values: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """(row, item) -> places of the item in the row, in shingles from the row's first, told by windows whose
        fingerprint is within RADIUS of one of the item's. A place may be before the row's first shingle."""
        out: dict[tuple[int, int], set[int]] = {}
        sums = running(values, self.kind)
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for size, item, offset, marks, tables in self.classes:
            prints = fingerprints(sums, size)
            if not len(prints):
                continue
            blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
            for b, (some, start, owner) in enumerate(tables):
                at = np.flatnonzero(some[blocks[:, b]])
                if not len(at):
                    continue
                value = blocks[at, b].astype(np.int64)
                number = start[value + 1] - start[value]
                window = np.repeat(at, number)
                end = np.cumsum(number)
                entry = owner[np.repeat(start[value] - (end - number), number) + np.arange(end[-1])]
                near = np.bitwise_count(prints[window] ^ marks[entry]) <= RADIUS
                window, entry = window[near], entry[near]
                row = row_of[window]
                inside = window + size <= first[row + 1]
                window, row, entry = window[inside], row[inside], entry[inside]
                told = np.stack([row, item[entry], window - first[row] - offset[entry]], axis=1)
                for r, k, place in np.unique(told, axis=0).tolist():
                    out.setdefault((r, k), set()).add(place)
        return out

    def _windows(self, text: np.ndarray, k: int, places: set[int], whole: bool) -> Iterator[int]:
        """First shingles of the item-sized windows within a quarter of the item from a place that hold enough of
        its shingles. `whole` leaves out those that the end of the text cuts."""
        size, own, need = int(self.lengths[k]), self.own[k], self.need[k]
        slack, done = size // 4 + 1, 0
        for place in sorted(places):
            low, high = max(place - slack, done), min(place + slack, len(text) - (size if whole else 1))
            if high < low:
                continue
            part = text[low : high + size]
            total = np.concatenate([[0], np.cumsum(own[np.minimum(np.searchsorted(own, part), size - 1)] == part)])
            begin = np.arange(high - low + 1)
            held = total[np.minimum(begin + size, len(part))] - total[begin]
            yield from (low + np.flatnonzero(held >= need)).tolist()
            done = high + 1

    def _matches(self, words: Words, whole: bool) -> dict[tuple[int, int], tuple[float, int, int]]:
        values, first = shingles(words.hash, words.first)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for (row, item), places in sorted(self.candidates(values, first).items()):
            text, bag, size = values[first[row] : first[row + 1]], self.bags[item], int(self.lengths[item])
            for begin in self._windows(text, item, places, whole):
                mine = Counter(text[begin : begin + size].tolist())
                both = sum((mine & bag).values())
                score = both / (sum(mine.values()) + size - both)
                if score >= self.least and score > best.get((row, item), (0.0,))[0]:
                    best[row, item] = (score, begin, min(size, len(text) - begin) + 4)
        return best

    def matches(self, column: pa.Array) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(row, item) -> similarity, first word, words of the best confirmed window (ties: the first)."""
        texts = as_strings(column)
        long = np.diff(offsets(texts)) > PIECE
        best = self._matches(Words(pc.if_else(pa.array(long), "", texts) if long.any() else texts), False)
        for row in np.flatnonzero(long).tolist():
            for words, word, last in pieces(texts[row : row + 1], self.overlap):
                for (_, item), (score, begin, number) in self._matches(words, not last).items():
                    if score > best.get((row, item), (0.0,))[0]:
                        best[row, item] = (score, word + begin, number)
        return best


def pieces(text: pa.LargeStringArray, overlap: int) -> Iterator[tuple[Words, int, bool]]:
    """Words of parts of one text of about PIECE bytes, which end at white space and share `overlap` words with the
    next; the first word's number, and whether it is the last. A run without white space stays whole."""
    at = offsets(text)
    data = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[1]]
    begin, word, size = 0, 0, PIECE
    while True:
        end = min(begin + size, len(data))
        while end < len(data) and data[end] not in SPACES:
            end += 1
        words = Words(pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, end - begin])), pa.py_buffer(data[begin:end])))
        if end < len(data) and len(words.start) <= 2 * overlap:
            size *= 2  # so that each piece brings more new words than it repeats
            continue
        yield words, word, end == len(data)
        if end == len(data):
            return
        word += len(words.start) - overlap
        begin, size = begin + int(words.start[len(words.start) - overlap]), PIECE


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The distinct items with id and text, so that copies of one don't make its slice large."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("item_id is not null and text <> ''").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    number = total * 5 // (SLICE * 4) + 1
    for k in range(number):
        part = rows if number == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each document and item whose
    similarity is `least` or more. Documents without one have no row.

    Words are lower-cased (A-Z). Null or empty texts and items with fewer than five words match
    nothing, as do items without id; a document without id keeps a null doc_id; repeated documents are
    found each, repeated items once, and texts that share an item_id each; very long texts are read in
    pieces with the same result; an empty table on either side gives an empty result; other columns are
    ignored.
    """
    out = None
    for items in _slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, least)
            for batch in batches:
                for part in by_bytes(batch, "text", STEP):
                    got = index.matches(part.column("text"))
                    rows = pa.array([r for r, _ in got], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").cast(pa.int64()).take(rows), pa.array([index.ids[i] for _, i in got], pa.int64()), *(pa.array([v[j] for v in got.values()], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (0, pa.float64())))],
                        ["doc_id", "item_id", "start_word", "n_words", "similarity"],
                    )

        found = docs.select("doc_id", "text").mapInArrow(find, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that match no item: as many passes, without a shuffle, as slices."""
    for items in _slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, least)
            for batch in batches:
                for part in by_bytes(batch, "text", STEP):
                    mask = np.ones(part.num_rows, bool)
                    mask[[r for r, _ in index.matches(part.column("text"))]] = False
                    yield part.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
