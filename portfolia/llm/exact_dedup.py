"""Exact dedup with a cuckoo-filter index (operator 13).

A text's key is the SHA-256 of its normalised form.  An index is dealt into
shards by the first bits of the key.  A shard is a cuckoo filter of its live
keys: a table of buckets of four slots, in which a key's 16-bit fingerprint
lies in one of two buckets.  Beside each fingerprint lies its content: whole
key, length, the row that stays, and the number of rows.  A fingerprint that is
found is verified against that content; one that is not found is new.  A shard
that overflows is built again from its stored content with twice the buckets.

A stored index is a table of its live entries: ``digest``, ``bytes``, ``keep_id``,
``keep_row`` and ``n``.  Shards are dealt anew from the keys whenever it changes,
so their number follows the number of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portfolia.llm.common import bound_batches, stage

#: Slots of a bucket, moves before a table counts as full, and buckets of an empty table.
SLOTS, MOVES, FIRST_BUCKETS = 4, 200, 16
#: Rows that a shard is planned for, and keys that a task holds before it sends them on.
SHARD_ROWS, HELD = 1_024, 65_536
#: Keys that more than this part of all rows have are joined by broadcast: fewer than this number of them.
FREQUENT = 20_000


class CuckooIndex:
    """Live keys with their content; every answer is verified against the content, so it is exact."""

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self._empty(buckets)
        self.resized = 0

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.fingerprints = [0] * (buckets * SLOTS)  # 0: free
        self.content: list = [None] * (buckets * SLOTS)
        self.size = 0

    @staticmethod
    def _fingerprint(digest: bytes) -> int:
        return int.from_bytes(digest[24:26], "big") or 1

    def _first(self, digest: bytes) -> int:
        return int.from_bytes(digest[26:32], "big") & self.mask

    def _other(self, bucket: int, fingerprint: int) -> int:
        """The other bucket of a fingerprint; of that one, this."""
        return bucket ^ (fingerprint * 0x5BD1E995 >> 7 & self.mask)

    def find(self, digest: bytes) -> int:
        """The slot of a live key, or -1: both buckets' slots of equal fingerprint are compared by their whole key."""
        fingerprint, bucket = self._fingerprint(digest), self._first(digest)
        for bucket in {bucket, self._other(bucket, fingerprint)}:
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.fingerprints[slot] == fingerprint and self.content[slot][0] == digest:
                    return slot
        return -1

    def _place(self, entry: tuple) -> tuple | None:
        """Put an entry in a free slot, moving others to their other bucket; what is left over if the table is full."""
        fingerprint, bucket = self._fingerprint(entry[0]), self._first(entry[0])
        for turn in range(MOVES):
            for at in (bucket, self._other(bucket, fingerprint)):
                for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                    if not self.fingerprints[slot]:
                        self.fingerprints[slot], self.content[slot] = fingerprint, entry
                        return None
            bucket = self._other(bucket, fingerprint)
            slot = bucket * SLOTS + turn % SLOTS
            fingerprint, self.fingerprints[slot] = self.fingerprints[slot], fingerprint
            entry, self.content[slot] = self.content[slot], entry
        return entry

    def insert(self, entry: tuple) -> None:
        """Add a key that is not live.  If the table overflows, it is built again from the stored keys with twice the buckets."""
        left, buckets, size = self._place(entry), self.mask + 1, self.size + 1
        if left is not None:
            stored = [*self.entries(), left]
            while left is not None:
                buckets *= 2
                self._empty(buckets)
                self.resized += 1
                left = next((out for out in map(self._place, stored) if out is not None), None)
        self.size = size

    def merge(self, digest: bytes, size: int, keep: tuple, n: int) -> None:
        """Add ``n`` rows of a text of which the row ``keep`` (id and number) comes first; a live key keeps the smaller row."""
        slot = self.find(digest)
        if slot < 0:
            self.insert((digest, size, keep, n))
        else:
            _, bytes_of, old, live = self.content[slot]
            if bytes_of != size:
                raise ValueError(f"texts of {size} and {bytes_of} bytes have one SHA-256, {digest.hex()}")
            self.content[slot] = (digest, size, min(old, keep, key=order), live + n)

    def delete(self, digest: bytes) -> bool:
        """Free the slot of a key, if it is live."""
        slot = self.find(digest)
        if slot < 0:
            return False
        self.fingerprints[slot], self.content[slot] = 0, None
        self.size -= 1
        return True

    def entries(self) -> Iterator[tuple]:
        return (entry for entry in self.content if entry is not None)


def order(keep: tuple) -> tuple:
    """Smaller ids first, null last; of equal ids the row that was read first."""
    return keep[0] is None, 0 if keep[0] is None else keep[0], keep[1]


#: ASCII white space, each run of which counts as one space.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column | str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WHITE, " ")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, ``row`` (a number of its own for each row), key and length of each normalised text, written to the shared folder."""
    text = docs.select("doc_id", normalised().alias("text"))
    return stage(text.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "keys")


def _shard(digests: list[bytes], bits: int) -> pa.Array:
    return pa.array([int.from_bytes(d[:8], "big") >> 64 - bits for d in digests], pa.int64())


def _table(entries: list[tuple], id_type: pa.DataType, **more: pa.Array) -> pa.RecordBatch:
    digest, size, keep, n = zip(*entries, strict=True) if entries else ((), (), (), ())
    columns = [pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array([k[0] for k in keep], id_type), pa.array([k[1] for k in keep], pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *more.values()], names=["digest", "bytes", "keep_id", "keep_row", "n", *more])


_STORED, _DELETED, _INSERTED = range(3)


def update(entries: DataFrame | None, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The entries of an index (none: an empty one) after texts are deleted from it and then others inserted; both as ``keyed`` rows.

    A deleted text is live no longer, however many rows it had; texts that are
    not live are deleted without effect.  A stored row goes before an inserted
    one of equal id.  Each task first merges its own rows in an index, so that
    of a text with any number of rows a task sends few lines, and then folds
    whole shards, which it holds one at a time.
    """
    given = [df for df in (entries, inserted, deleted) if df is not None]
    spark = given[0].sparkSession
    bound_batches(spark)
    bits = max(1, (sum(df.count() for df in given) // SHARD_ROWS).bit_length())
    typed = (inserted.schema["doc_id"] if inserted is not None else entries.schema["keep_id"] if entries is not None else deleted.schema["doc_id"]).dataType
    schema = f"digest binary, bytes long, keep_id {typed.simpleString()}, keep_row long, n long"

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, id_type = CuckooIndex(), None

        def sent() -> pa.RecordBatch:
            found = list(index.entries())
            return _table(found, id_type, shard=_shard([e[0] for e in found], bits), kind=pa.array([_INSERTED] * len(found), pa.int32()))

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for digest, size, doc_id, row in zip(*(batch.column(c).to_pylist() for c in ("digest", "bytes", "doc_id", "row")), strict=True):
                index.merge(digest, size, (doc_id, row), 1)
            if index.size >= HELD:
                yield sent()
                index = CuckooIndex()
        if index.size:
            yield sent()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _shard(batch.column("digest").to_pylist(), bits)], names=[*batch.schema.names, "shard"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, shard, id_type = CuckooIndex(), None, None
        for batch in batches:
            id_type = batch.schema.field("keep_id").type
            names = ("shard", "kind", "digest", "bytes", "keep_id", "keep_row", "n")
            for at, kind, digest, size, doc_id, row, n in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if at != shard:
                    if index.size:
                        yield _table(list(index.entries()), id_type)
                    index, shard = CuckooIndex(), at
                if kind == _DELETED:
                    index.delete(digest)
                else:
                    index.merge(digest, size, (doc_id, row), n)
        if index.size:
            yield _table(list(index.entries()), id_type)

    moves = []
    if entries is not None:
        stored = entries.select("digest", "bytes", "keep_id", F.lit(-1).cast("long").alias("keep_row"), "n")
        moves.append(stored.mapInArrow(placed, f"{schema}, shard long").withColumn("kind", F.lit(_STORED)))
    if deleted is not None:
        gone = deleted.select("digest", F.lit(None).cast("long").alias("bytes"), F.lit(None).cast(typed).alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), F.lit(0).cast("long").alias("n"))
        moves.append(gone.mapInArrow(placed, f"{schema}, shard long").withColumn("kind", F.lit(_DELETED)))
    if inserted is not None:
        moves.append(inserted.select("digest", "bytes", "doc_id", "row").mapInArrow(merged, f"{schema}, shard long, kind int"))
    dealt = moves[0]
    for more in moves[1:]:
        dealt = dealt.unionByName(more)
    return dealt.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(folded, schema)


def resolve(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """For each of ``rows``: doc_id, keep_id, group_size, kept and text_sha256, from the entry of its key.

    An entry of more than a ``FREQUENT``-th of all rows is joined by broadcast;
    there are fewer than ``FREQUENT`` of these, whatever the data.  All others
    are joined by a shuffle, in which no key has more than that part of the rows.
    """
    limit = rows.count() / FREQUENT
    content = entries.select(F.col("digest").alias("key"), "keep_id", "keep_row", "n")
    same = F.col("digest") == F.col("key")
    frequent = F.broadcast(content.where(F.col("n") > limit))
    found = rows.join(frequent, same, "left")
    rest = found.where("key is null").select(*rows.columns).join(content.where(F.col("n") <= limit), same)
    both = found.where("key is not null").unionByName(rest)
    return both.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones.  Of a group the smallest id stays, null after
    all others; of rows with equal text and id exactly one.  An empty table
    gives none; other columns are not read, and texts of any length are
    compared as a whole.
    """
    rows = keyed(docs)
    return resolve(rows, stage(update(None, rows), "cuckoo"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM t
"""
