"""Benchmark decontamination by a prefix-filtered set join (operator 4).

A window is ``width`` consecutive words of a benchmark item (all words of a
shorter item).  Shingles of benchmark words are ordered by how rare they are in
the documents; because a window must be contained whole, its prefix is its one
rarest shingle, and a document is a candidate only at places that hold it.  The
shingle's place in the window must leave room for the window inside the document
(positional and length bounds), and the window's words are then compared one by
one, by their bytes.

The benchmark is broadcast in blocks of at most ``BLOCK`` words, each a pass
over the rows without a shuffle, so its size has no bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.llm.common import MARKS, Words, bound_batches, distinct, forget_others, packed, small_batches, spread, unpacked

WIDTH, SHINGLE, BLOCK = 13, 3, 400_000


_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def merged(runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The union of runs of words as disjoint runs in order."""
    out: list[dict[str, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


class Windows:
    """The windows of a block of items, and the prefix index over them."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], width: int):
        """``items`` have an id and the exact keys of their words (two columns)."""
        self.width = width
        flat = np.concatenate([w for _, w in items]) if items else np.empty((0, 2), np.uint64)
        first, back = distinct(flat[:, 0], flat[:, 1])
        self.vocabulary, self.seed = flat[first], np.uint64(0)
        while len(np.unique(key := spread(self.vocabulary[:, 0] ^ self.seed, self.vocabulary[:, 1]))) < len(key):
            self.seed += np.uint64(1)  # until no two words of the vocabulary have one hash
        order = np.argsort(key)
        self.keys, self.vocabulary = key[order], self.vocabulary[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        numbers = np.split(place[back], np.cumsum([len(w) for _, w in items])[:-1])
        self.items = sorted({str(i) for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.items)}
        rows, owner = set(), {}
        for (item, _), ids in zip(items, numbers, strict=False):
            size = min(width, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                window = tuple(ids[at : at + size].tolist())
                rows.add(window)
                if item is not None:
                    owner.setdefault(window, set()).add(number[str(item)])
        ordered = sorted(rows)
        self.sizes = np.array([len(w) for w in ordered], np.int64)
        self.words = np.full((len(ordered), width), -1, np.int64)
        for k, w in enumerate(ordered):
            self.words[k, : len(w)] = w
        self.owners = [sorted(owner.get(w, ())) for w in ordered]
        #: Shingles: of ``SHINGLE`` words, fewer in shorter windows; one number each, by size.
        self.shingles = {n: np.unique(np.concatenate([self._runs(self.words[k, : self.sizes[k]], n) for k in np.flatnonzero(self._taken() == n)])) for n in np.unique(self._taken())}
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def _taken(self) -> np.ndarray:
        return np.minimum(self.sizes, SHINGLE)

    def _runs(self, ids: np.ndarray, n: int) -> np.ndarray:
        """A number for each run of ``n`` word numbers; negative if a word is not of the vocabulary."""
        size, m = len(self.vocabulary) + 1, max(0, len(ids) - n + 1)
        out, bad = np.zeros(m, np.int64), np.zeros(m, bool)
        for k in range(n):
            part = ids[k : k + m]
            out, bad = out * size + part, bad | (part < 0)
        out[bad] = -1
        return out

    def numbers(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, -1 for other words."""
        if not len(self.keys):
            return np.full(len(low), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, spread(low ^ self.seed, high)), len(self.keys) - 1)
        return np.where((self.vocabulary[at, 0] == low) & (self.vocabulary[at, 1] == high), at, -1)

    def places(self, ids: np.ndarray, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where shingles of ``keys`` (sorted) begin, and which."""
        runs = self._runs(ids, n)
        known = np.flatnonzero(runs >= 0)
        at = np.minimum(np.searchsorted(keys, runs[known]), len(keys) - 1)
        good = keys[at] == runs[known]
        return known[good], at[good]

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle (the leftmost of equals) and file the window under it."""
        for n, keys in self.shingles.items():
            at, key, offset = [], [], []
            for k in np.flatnonzero(self._taken() == n):
                own = np.searchsorted(keys, self._runs(self.words[k, : self.sizes[k]], n))
                best = min(range(len(own)), key=lambda j: (counts.get((int(n), int(own[j])), 0), j))
                at.append(k), key.append(own[best]), offset.append(best)
            key = np.array(key)
            by = np.argsort(key, kind="stable")
            used, first = np.unique(key[by], return_index=True)
            self.prefix[int(n)] = (keys[used], np.append(first, len(by)), np.array(at)[by], np.array(offset)[by])


def _batches(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    """Batches with their words; a separator that no window has stands between the documents' numbers."""
    forget_others()
    for batch in small_batches(batches, limit=1 << 19):
        words = Words(batch.column("text"), MARKS)
        ids = np.full(len(words.start) + batch.num_rows, -1, np.int64)
        ids[np.arange(len(words.start)) + words.text_of()] = windows.numbers(*words.exact())
        yield batch, words, ids


def _count_shingles(docs: DataFrame, block) -> dict[tuple[int, int], int]:
    """How often each of the block's shingles is in all documents; as many rows as the block has shingles at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value
        total = {n: np.zeros(len(keys), np.int64) for n, keys in windows.shingles.items()}
        for _, _, ids in _batches(batches, windows):
            for n, keys in windows.shingles.items():
                total[n] += np.bincount(windows.places(ids, n, keys)[1], minlength=len(keys))
        for n, count in total.items():
            seen = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), n, np.int32)), pa.array(seen), pa.array(count[seen])], names=["n", "shingle", "count"])

    counted = docs.select("text").mapInArrow(work, "n int, shingle long, count long").groupBy("n", "shingle").agg(F.sum("count").alias("count"))
    return {(r["n"], r["shingle"]): r["count"] for r in counted.toLocalIterator()}


def _scan(rows: DataFrame, block) -> DataFrame:
    """Add the block's hit runs and items to the columns ``hits`` and ``items``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value
        for batch, words, ids in _batches(batches, windows):
            first = words.first + np.arange(len(words.first))
            starts, which = [], []
            for n, (keys, edge, filed, offset) in windows.prefix.items():
                place, key = windows.places(ids, n, keys)
                times = np.diff(edge)[key]
                entry = np.repeat(edge[key] - np.cumsum(times) + times, times) + np.arange(times.sum())
                start, window = np.repeat(place, times) - offset[entry], filed[entry]
                room = (start >= 0) & (start + windows.sizes[window] <= len(ids))
                start, window = start[room], window[room]
                good = np.ones(len(start), bool)
                for k in range(windows.width):
                    long = windows.sizes[window] > k
                    good[long] &= ids[start[long] + k] == windows.words[window[long], k]
                starts.append(start[good]), which.append(window[good])
            start, window = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, which))
            doc = np.searchsorted(first, start, side="right") - 1
            hits: list[list[dict[str, int]]] = batch.column("hits").to_pylist()
            items: list[list[str]] = batch.column("items").to_pylist()
            for d in np.unique(doc):
                own = doc == d
                found = start[own] - first[d]
                hits[d] = merged([*((h["start"], h["end"]) for h in hits[d]), *zip(found.tolist(), (found + windows.sizes[window[own]]).tolist(), strict=True)])
                items[d] = sorted(set(items[d]).union(windows.items[i] for w in np.unique(window[own]) for i in windows.owners[w]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(np.diff(words.first)), pa.array(hits, _RUNS), pa.array(items, pa.list_(pa.string()))], names=["row", "text", "n_words", "hits", "items"]
            )

    return rows.mapInArrow(work, rows.schema)


def _blocks(benchmark: DataFrame, width: int, limit: int) -> Iterator[Windows]:
    """The items in blocks of at most ``limit`` words, streamed; a longer item is cut with an overlap of width - 1 words."""
    held: list[tuple[str | None, np.ndarray]] = []
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        words = np.column_stack(Words(pa.array([row["text"]], pa.string()), MARKS).exact())
        for at in range(0, max(1, len(words) - width + 1), limit):
            part = words[at : at + limit + width - 1]
            if held and sum(len(w) for _, w in held) + len(part) > limit:
                yield Windows(held, width)
                held = []
            if len(part):
                held.append((row["item_id"], part))
    if held:
        yield Windows(held, width)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK) -> DataFrame:
    """``row`` (the columns of ``docs`` but text, see ``packed``), ``text``, ``n_words``, ``hits`` (disjoint runs of words in windows) and ``items`` (ids, sorted).

    Null texts have no words and no hits; items without words have no window.
    A null item_id hits words but is not listed, and items with one id count as
    one.  Repeated rows get a row each, an empty table none, and columns of
    ``docs`` may have any name.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = packed(docs, "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("hits"), F.array().cast("array<string>").alias("items"), without=("text",))
    passes = 0
    for windows in _blocks(benchmark, width, block_words):
        windows.order(_count_shingles(docs, spark.sparkContext.broadcast(windows)))
        rows, passes = _scan(rows, spark.sparkContext.broadcast(windows)), passes + 1
    if not passes:  # the words are counted all the same
        rows = _scan(rows, spark.sparkContext.broadcast(Windows([], width)))
    return rows


def _n_hit() -> F.Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda total, run: total + run["end"] - run["start"])


def _contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see ``scan``."""
    scanned = scan(docs.select("doc_id", "text"), benchmark, width, block_words)
    return scanned.select(
        F.col("row.c0").alias("doc_id"), "n_words", _n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    ).withColumn("contaminated", _contaminated())


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns; see ``scan`` for nulls, repeated rows and empty tables."""
    return unpacked(scan(docs, benchmark).withColumn("n_hit", _n_hit()).where(~_contaminated()), docs.columns, text=F.col("text"))
