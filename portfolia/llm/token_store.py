"""Content-addressed store of token ids (operator 3).

Layout of a store, all Parquet:

* ``chunks/``  - ``digest`` (SHA-256 of the payload), ``n`` and ``payload`` (n ids
  as little-endian unsigned integers of 16 bits if all fit, else of 32); each
  distinct chunk once.
* ``recipes/`` - one row per document in ascending doc_id order: ``doc_id``,
  ``start`` (ids of all documents before it), ``n_tokens``, ``digests``,
  ``sizes`` and ``root``, the Merkle root of the digests.
* ``manifest/`` - per recipe partition its number of documents and ids and the
  Merkle root of its documents' roots.

Ids are cut into chunks where a rolling hash over eight ids has enough zero
bits, so documents that share a passage share its chunks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portfolia.llm.bpe import default_tokenizer, encoder
from portfolia.llm.common import bound_batches, drop_path, scratch_path, small_batches

#: Chunks have 256 ids on average and 2,048 at most.
CUT_BITS, LONGEST = 8, 2048


def chunk_ends(ids: np.ndarray) -> np.ndarray:
    """Where the chunks of one document's ids end."""
    n = len(ids)
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for step in (1, 2, 4):
        if n > step:
            h[step:] += h[:-step] * np.uint64(0xD6E8FEB86659FD93) ** np.uint64(step)
    ends = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1
    ends = np.concatenate([ends[ends < n], [n]])
    starts = np.concatenate([[0], ends[:-1]])
    if (ends - starts).max() > LONGEST:
        ends = np.concatenate([np.append(np.arange(a + LONGEST, b, LONGEST), b) for a, b in zip(starts, ends, strict=True)])
    return ends


def pack(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4").tobytes()


def unpack(payload: bytes, n: int) -> np.ndarray:
    """The ids as unsigned 32-bit integers."""
    return np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4").astype("<u4")


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd node moves up; no leaf: the hash of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def write_store(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None) -> None:
    """Encode every whole text, append ``end_id`` and write the store to ``path``.

    Null texts are empty: their ids are the end id alone.  Every row is a
    document; rows with equal ids are ordered by their text's hash, null ids
    come first.  Other columns are not read.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = scratch_path(spark, "token-store")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A recipe for each document, and each chunk that this task has not sent lately."""
        enc = encoder(tokenizer)
        sent: set[bytes] = set()
        for batch in small_batches(batches, limit=1 << 19):
            encoded = enc.encode_whole(batch.column("text").to_pylist())
            recipes, chunks = [], []
            for k in range(batch.num_rows):
                ids = np.append(encoded[k], np.int32(end_id)).astype("<u4")
                ends = chunk_ends(ids).tolist()
                digests = []
                for a, b in zip([0, *ends], ends):
                    payload = pack(ids[a:b])
                    digests.append(digest := hashlib.sha256(payload).digest())
                    if digest not in sent:
                        sent.add(digest)
                        chunks.append((digest, b - a, payload))
                recipes.append((len(ids), digests, np.diff([0, *ends]).tolist(), merkle_root(digests)))
            if len(sent) > 200_000:
                sent.clear()
            n = len(recipes)
            for start in range(0, max(n, len(chunks)), max(n, 4096)):
                part = chunks[start : start + max(n, 4096)]
                rows = recipes if start == 0 else []
                pad, fill = [None] * len(part), [None] * len(rows)
                cols = list(zip(*rows, strict=True)) or [()] * 4
                got = list(zip(*part, strict=True)) or [()] * 3
                ids_col = batch.column("doc_id") if rows else pa.array([], batch.schema.field("doc_id").type)
                hash_col = batch.column("tie") if rows else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([0] * len(rows) + [1] * len(part), pa.int32()),
                        pa.concat_arrays([ids_col, pa.nulls(len(part), ids_col.type)]),
                        pa.concat_arrays([hash_col, pa.nulls(len(part), pa.int64())]),
                        pa.array([*cols[0], *got[1]], pa.int64()),
                        pa.array([*cols[1], *pad], pa.list_(pa.binary())),
                        pa.array([*cols[2], *pad], pa.list_(pa.int32())),
                        pa.array([*cols[3], *got[0]], pa.binary()),
                        pa.array([*fill, *got[2]], pa.binary()),
                    ],
                    names=["is_chunk", "doc_id", "tie", "n", "digests", "sizes", "hash", "payload"],
                )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    cut_rows = rows.mapInArrow(cut, f"is_chunk int, doc_id {kind}, tie long, n long, digests array<binary>, sizes array<int>, hash binary, payload binary")
    cut_rows.write.partitionBy("is_chunk").option("compression", "zstd").parquet(raw)
    kept = spark.read.schema(cut_rows.schema).parquet(raw)

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            keep = [a != b for a, b in zip(digests, [last, *digests], strict=False)]
            last = digests[-1] if digests else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    chunks = kept.filter("is_chunk = 1").select(F.col("hash").alias("digest"), F.col("n").cast("int").alias("n"), "payload")
    chunks = chunks.repartition(F.col("digest")).sortWithinPartitions("digest").mapInArrow(first_of_each, chunks.schema)
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    drop_path(spark, f"{raw}/is_chunk=1")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = kept.filter("is_chunk = 0").select("doc_id", "tie", "n", "digests", "sizes", F.col("hash").alias("root"))
    ordered = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").withColumn("part", F.spark_partition_id())
    ordered.write.parquet(f"{raw}-ordered")
    ordered = spark.read.schema(ordered.schema).parquet(f"{raw}-ordered")
    # One row per range partition: bounded by the number of partitions, not by the documents.
    totals = ordered.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    placed = (
        ordered.join(F.broadcast(before), "part")
        .withColumn("start", F.col("base") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .select("part", "doc_id", "tie", "start", F.col("n").alias("n_tokens"), "digests", "sizes", "root")
    )
    placed.write.partitionBy("part").parquet(f"{path}/recipes")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs_of, ids_of, leaves = None, 0, 0, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "n_docs": pa.array([docs_of], pa.int64()), "n_tokens": pa.array([ids_of], pa.int64()), "root": pa.array([merkle_root(leaves)], pa.binary())}
            )

        for batch in batches:
            for p, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "root")), strict=True):
                if part is not None and p != part:
                    yield row()
                    docs_of, ids_of, leaves = 0, 0, []
                part, docs_of, ids_of = p, docs_of + 1, ids_of + n
                leaves.append(root)
        if part is not None:
            yield row()

    stored = read_recipes(spark, path, docs.schema["doc_id"].dataType)
    manifest = stored.select("part", "start", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "start")
    manifest.mapInArrow(roots, "part int, n_docs long, n_tokens long, root binary").write.parquet(f"{path}/manifest")
    drop_path(spark, raw)
    drop_path(spark, f"{raw}-ordered")


def read_recipes(spark: SparkSession, path: str, id_type="bigint") -> DataFrame:
    kind = id_type if isinstance(id_type, str) else id_type.simpleString()
    return spark.read.schema(f"doc_id {kind}, tie long, start long, n_tokens long, digests array<binary>, sizes array<int>, root binary, part int").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Every stored chunk with its payload, and whether the payload has its digest."""
    chunks = spark.read.schema("digest binary, n int, payload binary").parquet(f"{path}/chunks")
    return chunks.withColumn("intact", F.unhex(F.sha2("payload", 256)) == F.col("digest"))


def read_documents(spark: SparkSession, path: str, id_type="bigint") -> DataFrame:
    """The documents put together again: doc_id, start, n_tokens, ids (array of int)."""
    pieces = read_recipes(spark, path, id_type).select("doc_id", "start", "n_tokens", F.posexplode("digests").alias("k", "digest"))
    joined = pieces.join(read_chunks(spark, path), "digest")
    whole = joined.groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("k", "n", "payload"))).alias("parts"))

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([unpack(p["payload"], p["n"]) for p in parts]).astype(np.int32) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])

    return whole.mapInArrow(glue, f"doc_id {whole.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids array<int>")


# CRC-32 of joined chunks from the chunks' own: the register of the first is advanced over as many
# zero bytes as the second has, which is a linear map over GF(2), and xored with the second's.


def _zero_byte_maps(levels: int = 32) -> list[np.ndarray]:
    """For each power of two, tables (4 x 256) of the map that advances a register over so many zero bytes."""
    step = np.array([zlib.crc32(b"\0", 1 << b) ^ zlib.crc32(b"\0", 0) for b in range(32)], np.uint32)  # images of the 32 unit registers

    def tables(columns: np.ndarray) -> np.ndarray:
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        return np.stack([np.bitwise_xor.reduce(np.where(bits, columns[8 * k : 8 * k + 8], np.uint32(0)), axis=1) for k in range(4)]).astype(np.uint32)

    out = []
    for _ in range(levels):
        out.append(tables(step))
        step = _advance(step, out[-1])
    return out


def _advance(registers: np.ndarray, t: np.ndarray) -> np.ndarray:
    return t[0][registers & 255] ^ t[1][(registers >> 8) & 255] ^ t[2][(registers >> 16) & 255] ^ t[3][registers >> 24]


def joined_crc32(crcs: list[list[int]], sizes: list[list[int]]) -> list[int]:
    """CRC-32 of each list of chunks, given the chunks' CRC-32 and bytes, for many lists at once."""
    maps = _zero_byte_maps(24)
    count = np.array([len(c) for c in crcs])
    order = np.argsort(-count, kind="stable")
    start = (np.cumsum(count) - count)[order]
    flat_crc = np.array([c for x in crcs for c in x], np.uint32)
    flat_size = np.array([s for x in sizes for s in x], np.int64)
    total = np.zeros(len(crcs), np.uint32)
    live = len(crcs)
    for k in range(int(count.max(initial=0))):
        while live and count[order[live - 1]] <= k:
            live -= 1
        now, at = total[:live], start[:live] + k
        size = flat_size[at]
        for bit, table in enumerate(maps):
            if not (size >> bit).any():
                break
            now = np.where((size >> bit) & 1, _advance(now, table), now)
        total[:live] = now ^ flat_crc[at]
    out = np.empty(len(crcs), np.int64)
    out[order] = total
    return out.tolist()


def read_digests(spark: SparkSession, path: str, id_type="bigint") -> DataFrame:
    """What the files say of each document: doc_id, start, n_tokens, ids_crc32, n_chunks, verified.

    Each stored chunk is read once: its SHA-256 is compared with its digest and
    its CRC-32 taken.  A document's CRC-32 follows from those of its recipe's
    chunks in order, and ``verified`` says that all chunks are there and intact
    and that their digests give the stored Merkle root.
    """

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, sizes = batch.column("payload").to_pylist(), batch.column("n").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary()),
                    pa.array([n if len(p) in (2 * n, 4 * n) else -1 for p, n in zip(payloads, sizes, strict=True)], pa.int32()),
                    pa.array([zlib.crc32(unpack(p, n).tobytes()) for p, n in zip(payloads, sizes, strict=True)], pa.int64()),
                ],
                names=["digest", "found_n", "crc"],
            )

    chunks = spark.read.schema("digest binary, n int, payload binary").parquet(f"{path}/chunks").select("n", "payload").mapInArrow(checked, "digest binary, found_n int, crc long")
    recipes = read_recipes(spark, path, id_type)
    pieces = recipes.select("start", F.posexplode("digests").alias("k", "digest"))
    found = pieces.join(chunks, "digest").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("k", "crc", "found_n", "digest"))).alias("found"))
    rows = recipes.select("doc_id", "start", "n_tokens", "sizes", "root").join(found, "start")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found").to_pylist()
            got = [[p["found_n"] for p in f] for f in found]
            crcs = joined_crc32([[p["crc"] for p in f] for f in found], [[4 * n for n in x] for x in got])
            right = [
                x == s and sum(x) == n and merkle_root([p["digest"] for p in f]) == r
                for x, f, s, n, r in zip(got, found, *(batch.column(c).to_pylist() for c in ("sizes", "n_tokens", "root")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array([len(f) for f in found], pa.int32()), pa.array(right, pa.bool_())],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "verified"],
            )

    kind = recipes.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(verify, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, n_chunks int, verified boolean")
