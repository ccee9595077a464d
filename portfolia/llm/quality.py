"""Quality classifier by Bradley-Terry pairwise ranking (operator 8).

Every text has features of form (shares of kinds of characters, words and
lines).  A document's strength
is a weighted sum of them; weights are learned from all pairs of a labelled good
and a labelled bad document, by the mean logistic loss on the difference of their
strengths.  The threshold is the quantile of all labelled documents' strengths
that leaves as large a share below as the labels call bad, and strengths are
mapped to scores so that it becomes ``CUT``.

Features are measured once for each row and written.  A round of learning is one
pass over the labelled rows, which are summed by strength in ``BINS`` bins of a
``1 / GRID`` each: rows of a bin count with their own features and, in the
logistic function alone, with their mean strength, so a pair of bins stands for
all pairs of their rows.  The quantile is found exactly, by counting in ever
narrower bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.llm.common import Words, bound_batches, held_out, small_batches, stage, sums

CUT, RIDGE, GRID, BINS = 0.7, 5e-5, 8, 512

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_PLAIN = np.isin(_BYTE, list(b".,;:'\"?-()"))
_SYMBOL = (_BYTE > 32) & (_BYTE < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_PLAIN
#: Features of a text, in order.
FEATURES = ["length", "word_bytes", "upper", "digits", "plain_marks", "symbols", "no_letter_words", "symbol_words", "double_marks", "upper_words", "distinct_words", "short_words", "line_breaks", "repeated_lines", "capital_words", "empty"]


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text, all from whole texts; zeros and ``empty`` for texts without words."""
    words = Words(column, fold=False)
    data, n = words.data, np.diff(words.first).astype(float)
    some, size = np.maximum(n, 1), np.maximum(np.diff(words.offsets), 1)
    of_bytes = lambda mask: sums(mask[data], words.offsets) / size
    of_words = lambda mask: sums(mask, words.first) / some
    before = {k: np.concatenate([[0], np.cumsum(mask[data])]) for k, mask in (("letter", _UPPER | _LOWER), ("lower", _LOWER), ("symbol", _SYMBOL))}
    within = {k: c[words.end] - c[words.start] for k, c in before.items()}
    last, before_last = data[words.end - 1], data[np.maximum(words.end - 2, words.start)]
    long = words.end - words.start
    doc = words.text_of()
    h = words.hashes()
    key = np.lexsort([h, doc])
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[key][1:] != h[key][:-1]) | (doc[key][1:] != doc[key][:-1])
    distinct = np.bincount(doc[key][fresh], minlength=len(n)) if len(h) else np.zeros(len(n))
    lines = Words(column, outside=_BYTE == 10, fold=False)
    line_hash, line_doc = lines.hashes(), lines.text_of()
    line_key = np.lexsort([line_hash, line_doc])
    again = np.zeros(len(line_hash), bool)
    again[1:] = (line_hash[line_key][1:] == line_hash[line_key][:-1]) & (line_doc[line_key][1:] == line_doc[line_key][:-1])
    repeated = np.bincount(line_doc[line_key][again], minlength=len(n)) / np.maximum(np.diff(lines.first), 1) if len(line_hash) else np.zeros(len(n))
    share = lambda x: np.log1p(20 * x)
    return np.column_stack(
        [
            np.log1p(n),
            np.log1p(of_words(long)),
            share(of_bytes(_UPPER)),
            share(of_bytes(_DIGIT)),
            share(of_bytes(_PLAIN)),
            share(of_bytes(_SYMBOL)),
            share(of_words(within["letter"] == 0)),
            share(of_words(within["symbol"] > 0)),
            share(of_words((last == before_last) & (long > 1) & ~(_LOWER | _UPPER | _DIGIT)[last])),
            share(of_words((within["lower"] == 0) & (within["letter"] > 1))),
            distinct / some,
            of_words(long <= 3),
            share(np.diff(lines.first) / some),
            share(repeated),
            share(of_words(_UPPER[data[words.start]] if len(data) else np.zeros(0))),
            (n == 0).astype(float),
        ]
    )


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, digest of the text (null if that is) and features ``x`` of each row, written once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 19):
            x = features(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("digest"), lists], names=["doc_id", "held_out", "digest", "x"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")
    return stage(rows.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, digest string, x array<double>"), "quality-features")


def _learned(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """label and ``x`` of all labelled texts that are not held out: the highest label of a doc_id and of a text, equal texts once."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    rows = measured.where("digest is not null").select("doc_id", "digest", "x").join(known, "doc_id")
    return stage(rows.groupBy("digest").agg(F.max("label").alias("label"), F.first("x").alias("x")).select("label", "x"), "quality-learning")


def _gathered(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], none: np.ndarray) -> np.ndarray:
    """The arrays that ``part`` makes of features and labels, merged over all rows; a task sends one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = none
        for batch in batches:
            if batch.num_rows:
                have = merge(have, part(_matrix(batch.column("x")), batch.column("label").to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array([have.tobytes()], pa.binary())], names=["have"])

    return rows.mapInArrow(work, "have binary").rdd.map(lambda r: np.frombuffer(bytes(r.have)).reshape(none.shape)).treeReduce(merge)


def _bin_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each label and bin of strengths: the number of rows, and the sums of their features and of the products of these."""
    n = z.shape[1]
    out = np.zeros((2 * BINS, 1 + n + n * n))
    at = y * BINS + np.clip(np.floor((z * w).sum(1) * GRID) + BINS // 2, 0, BINS - 1).astype(int)
    order = np.argsort(at, kind="stable")
    bins, first = np.unique(at[order], return_index=True)
    z = z[order]
    out[bins] = np.add.reduceat(np.hstack([np.ones((len(z), 1)), z, (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)]), first, axis=0)
    return out


def _newton_step(table: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's step on the mean loss over all pairs of a good and a bad row, from ``_bin_sums``."""
    k = len(w)
    bad, good = (half[half[:, 0] > 0] for half in (table[:BINS], table[BINS:]))
    (n0, x0, m0), (n1, x1, m1) = ((t[:, 0], t[:, 1 : k + 1], t[:, k + 1 :]) for t in (bad, good))
    gap = (x1 @ w / n1)[:, None] - (x0 @ w / n0)[None, :]
    p = 1 / (1 + np.exp(np.clip(gap, -500, 500)))
    v = p * (1 - p)
    pairs = n0.sum() * n1.sum()
    down = (p @ n0) @ x1 - (n1 @ p) @ x0
    both = x1.T @ v @ x0
    curve = ((v @ n0) @ m1 + (n1 @ v) @ m0).reshape(k, k) - both - both.T
    return np.linalg.solve(curve / pairs + ridge * np.eye(k), down / pairs - ridge * w)


def _fit(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the standardised features by Newton's method; a pass over ``rows`` for each of 12 steps at most."""
    w = np.zeros(len(FEATURES))
    for _ in range(12):
        table = _gathered(rows, lambda x, y, w=w: _bin_sums((x - mean) / scale, y, w), np.add, np.zeros((2 * BINS, 1 + len(w) + len(w) ** 2)))
        step = _newton_step(table, w, ridge)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _ranked(rows: DataFrame, strength: Callable[[np.ndarray], np.ndarray], rank: int) -> float:
    """The strength that ``rank`` others come before in rising order: counted in bins, then in bins of the bin that has it, until its values are one."""

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])])

    none = np.stack([np.zeros(BINS), np.full(BINS, np.inf), np.full(BINS, -np.inf)])
    low, high = -np.inf, np.inf
    while True:

        def part(x: np.ndarray, y: np.ndarray, low=low, high=high) -> np.ndarray:
            s = strength(x)
            s = s[(s >= low) & (s <= high)]
            at = np.clip(np.floor(s * GRID) + BINS // 2 if np.isinf(low) else np.floor((s - low) / (high - low) * BINS), 0, BINS - 1).astype(int)
            out = none.copy()
            np.add.at(out[0], at, 1)
            np.minimum.at(out[1], at, s)
            np.maximum.at(out[2], at, s)
            return out

        count, least, most = _gathered(rows, part, merge, none)
        upto = np.cumsum(count)
        at = int(np.searchsorted(upto, rank, side="right"))
        rank -= int(upto[at] - count[at])
        low, high = float(least[at]), float(most[at])
        if low == high:
            return low


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= cut) for each row of ``docs``.

    ``labels`` has doc_id and quality (1 good, 0 bad; other values and nulls are
    not learned from).  Learns from all labelled rows that are not held out;
    without both labels all strengths are equal.  Of several labels of one
    doc_id or one text the highest counts, and equal texts count once.  Null texts
    count as empty; they are scored too, but not learned from.  Scores don't
    depend on the order of rows.  Repeated rows get a row each, an empty table
    none; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    measured = _measured(docs)
    learned = _learned(measured, labels)
    n = dict(learned.groupBy("label").count().collect())
    mean, scale, weights, threshold = np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0
    if len(n) == 2:
        each = learned.select(F.posexplode("x").alias("place", "value")).groupBy("place").agg(F.avg("value"), F.stddev_pop("value"), F.min("value"), F.max("value"))
        for place, average, deviation, least, most in each.collect():
            mean[place], scale[place] = (least, 1.0) if least == most else (average, deviation + 1e-6)
        weights = _fit(learned, mean, scale)

    def strength(x: np.ndarray) -> np.ndarray:
        return ((x - mean) / scale * weights).sum(1)

    if len(n) == 2:
        # Between two neighbours in rank, as numpy's quantile is.
        place = (sum(n.values()) - 1) * n[0] / sum(n.values())
        below, above = (_ranked(learned, strength, int(r)) for r in (np.floor(place), np.ceil(place)))
        threshold = below + (place - np.floor(place)) * (above - below)
    shift = np.log(cut / (1 - cut)) - threshold

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(strength(_matrix(batch.column("x"))) + shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])

    scored = measured.select("doc_id", "held_out", "x").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
