"""Helpers shared by the corpus operators: scratch tables and word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z, everything else unchanged.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_own_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, a folder of its own if the driver is the only machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="portfolia-"))
    return _own_scratch[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts lineage: a lost executor costs a reread, never a recomputation.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the file system Spark uses for it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows of an Arrow batch at most: texts are long, and a batch is in memory several times in the JVM and in Python.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Let the session send ``BATCH_ROWS`` rows to Python at once; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_caches: list[dict] = []


def worker_cache() -> dict:
    """A cache that lives as long as a Python worker and its operator's turn in it."""
    _caches.append({})
    return _caches[-1]


def forget_others(own: dict | None = None) -> None:
    """Empty what other operators have left in this worker."""
    for cache in _caches:
        if cache is not own:
            cache.clear()


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text each, so that results stay small too."""
    for batch in batches:
        column = batch.column(text)
        size = max(1, column.nbytes // max(1, batch.num_rows))
        step = max(1, min(batch.num_rows, limit // size))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def windows_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside words: ASCII white space, or every ASCII byte that is neither a digit nor a lower-case letter.
SPACES = _WHITE
MARKS = np.array([b < 0x30 or 0x39 < b < 0x61 or 0x7A < b < 0x80 for b in range(256)])

FOLD = np.frombuffer(LOWER_ASCII, np.uint8)
#: The first n bytes of eight, and what tells words of over 15 bytes from shorter ones.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = np.uint64(0xFF << 56)


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two 64-bit numbers."""
    return mix(low ^ mix(high + np.uint64(0x9E3779B97F4A7C15)))


def distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct pair, and each pair's number among them; pairs are compared, not only their hashes."""
    _, first, back = np.unique(spread(low, high), return_index=True, return_inverse=True)
    if (low[first][back] != low).any() or (high[first][back] != high).any():
        both = np.empty(len(low), [("low", np.uint64), ("high", np.uint64)])
        both["low"], both["high"] = low, high
        _, first, back = np.unique(both, return_index=True, return_inverse=True)
    return first, back


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a column of texts, all at once, without a Python object for each.

    ``data`` are the bytes of all texts in a row (A-Z lowered unless ``fold`` is
    false), ``start`` and ``end`` delimit the words in it, ``first`` has for
    each text the number of words before it, and the total at its end.  Null
    texts have no words.
    """

    def __init__(self, column: pa.Array, outside: np.ndarray = SPACES, fold: bool = True):
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.data = FOLD[raw] if fold else raw
        inside = ~outside[self.data]
        if len(self.data):
            before = np.empty_like(inside)
            before[0], before[1:] = False, inside[:-1]
            edges = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
            before[edges] = False
            after = np.empty_like(inside)
            after[-1], after[:-1] = False, inside[1:]
            after[edges[edges > 0] - 1] = False
            self.start = np.flatnonzero(inside & ~before)
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.empty(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)

    def exact(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit numbers that stand for each word's bytes: words of up to 15 bytes as they are, longer ones by 120 bits of BLAKE2b."""
        size = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(self.data) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        low = eight[self.start] & _FIRST[np.minimum(size, 8)]
        high = eight[self.start + 8] & _FIRST[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(size > 15)
        if len(long):
            raw = self.data.tobytes()
            digests = [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(self.start[long].tolist(), self.end[long].tolist(), strict=True)]
            both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
            low[long], high[long] = both[:, 0], both[:, 1] | _LONG
        return low, high

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; the same in every process."""
        return spread(*self.exact())

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs_hash(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values (none if there are fewer), by doubling.

    Runs of equal width are put together from the same halves, so each step may
    mix: a plain polynomial modulo 2^64 gives some unlike runs of 1,024 values
    and more (Thue-Morse words and their complements) one hash for any base.
    """
    if len(h) < width:
        return np.empty(0, np.uint64)
    n, out, done, power, have, base = len(h) - width + 1, None, 0, h, 1, np.uint64(0x9E3779B97F4A7C15)
    while True:
        if width & have:
            part = power[done : done + n]
            out = part if out is None else mix(out * base + part)
            done += have
        if 2 * have > width:
            return mix(out)
        power = mix(power[:-have] * base + power[have:])
        have *= 2


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *more, without: tuple[str, ...] = ()) -> DataFrame:
    """``row``, the columns of ``docs`` by number in a struct, and the columns ``more``, whose names can't clash with them."""
    from pyspark.sql import functions as F

    return docs.select(F.struct(F.lit(0).alias("c"), *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in without]).alias("row"), *more)


def unpacked(rows: DataFrame, names: list[str], **replaced) -> DataFrame:
    """The columns that ``packed`` has put in ``row``, by their names; those in ``replaced`` are given anew."""
    from pyspark.sql import functions as F

    return rows.select(*[replaced[c].alias(c) if c in replaced else F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)])


def fraction_of_rows(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if there are fewer), chosen by a hash of the columns ``by``; for fitting only."""
    from pyspark.sql import functions as F

    n = df.count()
    if n <= rows:
        return df
    return df.where(F.abs(F.xxhash64(*by) % 1_000_003) < int(1_000_003 * rows / n))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept out of learning: crc32 of the id as text leaves 2 when divided by 4; false for null ids."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, rows: int, name: str, each: bool = False) -> DataFrame:
    """text, its hash ``key`` and ``label``: about ``rows`` labelled rows (of each label, if ``each``) that are not held out, for learning.

    Labels other than 0 and 1, null ids and null texts are not learned from.  A
    doc_id with several labels has the highest, and so has a text; equal texts
    count once.  Ids are chosen by hash, so about ``rows`` of them are broadcast;
    where ids repeat, texts are chosen by hash again.
    """
    from pyspark.sql import functions as F

    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    some = fraction_of_rows(known.where("label = 1"), rows, "doc_id").union(fraction_of_rows(known.where("label = 0"), rows, "doc_id")) if each else fraction_of_rows(known, rows, "doc_id")
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(stage(some, f"{name}-ids")), "doc_id")
    found = stage(texts.groupBy("text").agg(F.max("label").alias("label")).withColumn("key", F.xxhash64("text")), f"{name}-rows")
    return fraction_of_rows(found, 3 * rows if each else 2 * rows, "text")


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive places of ``first``, 0 where they are equal."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
