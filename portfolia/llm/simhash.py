"""SimHash near-duplicates by the generalised pigeonhole principle (operator 2).

Fingerprints within ``limit`` bits of each other are found exactly: the 64 bits
are dealt into groups of correlated bits, a dynamic program gives each group a
threshold of its own from the candidates estimated for it, and two fingerprints
that are close must be within the threshold in at least one group (thresholds
add up to ``limit`` - groups + 1; -1 leaves a group out).  A fingerprint is
filed under its bits of a group and probes the keys within the threshold;
members of a bucket are verified by counting differing bits.

Equal fingerprints are one node, so copies are never paired.  A bucket sends
the links of a spanning forest, not all pairs.  Buckets over ``BUCKET`` rows
are split again by the pigeonhole principle on the bits that their key lacks.
What is over it after ``SPLITS`` splits is a dense group: all its members agree
in most bits, so there are no more than the fingerprints of a small ball, and
searching it breadth first compares a member only with those not reached yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.llm.common import LOWER_ASCII, bound_batches, forget_others, packed, small_batches, stage, unpacked
from portfolia.llm.components import connected_components

#: Fingerprints that the thresholds are estimated on, rows of a bucket before it is split, and how often it is.
SAMPLE, BUCKET, SPLITS = 2048, 16_000, 3
#: Differing bits by which ``keep_one`` links documents: nine in ten pairs of texts whose 5-word shingles are alike to 0.8 or more are linked.
STAGE_LIMIT = 6


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles; 0 without words."""
    words = (text or "").encode().translate(LOWER_ASCII).split()
    if not words:
        return 0
    runs = list(map(b" ".join, zip(*(words[k:] for k in range(shingle))))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), runs), np.uint64, len(runs))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: the id and ``fp``, the fingerprint as a long.  No shuffle."""

    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in small_batches(batches):
            got = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(got.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def _mask(bits) -> int:
    return sum(1 << int(b) for b in bits)


def plan_groups(sample: np.ndarray, total: int, limit: int = 3) -> list[tuple[list[int], int]]:
    """Groups of bits and their thresholds for ``total`` fingerprints like those of ``sample``."""
    if not len(sample):
        sample = np.zeros(1, np.uint64)
    total = max(1, total)
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    centred = bits - bits.mean(0)
    scale = np.sqrt((centred**2).mean(0)) + 1e-9
    alike = np.abs((centred / scale).T @ (centred / scale)) / max(1, len(sample))
    best = None
    for parts in range(2, limit + 2):
        left, groups = set(range(64)), []
        for g in range(parts):
            size = (64 - sum(map(len, groups))) // (parts - g)
            order = sorted(left)
            group = [max(order, key=lambda b: (alike[b, order].sum(), -b))]
            while len(group) < size:
                group.append(max((b for b in order if b not in group), key=lambda b: (alike[b, group].sum(), -b)))
            left -= set(group)
            groups.append(sorted(group))
        costs = []
        for group in groups:
            part = sample & np.uint64(_mask(group))
            near = np.zeros(limit + 1)
            for at in range(0, len(part), 256):
                apart = np.bitwise_count(part[at : at + 256, None] ^ part[None, :])
                near += [np.count_nonzero(apart <= t) for t in range(limit + 1)]
            pairs = max(1, len(sample) * (len(sample) - 1))
            cost = {-1: 0.0}
            for t in range(limit + 1):
                keys = sum(comb(len(group), k) for k in range(t + 1))
                share = max((near[t] - len(sample)) / pairs, keys / 2.0 ** len(group))
                cost[t] = 40.0 * total * keys + share * total * total
            costs.append(cost)
        ways: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for spent, (price, taken) in ways.items():
                for t, more in cost.items():
                    if spent + t not in new or price + more < new[spent + t][0]:
                        new[spent + t] = (price + more, [*taken, t])
            ways = new
        price, thresholds = ways[limit - parts + 1]
        if best is None or price < best[0]:
            best = (price, list(zip(groups, thresholds, strict=True)))
    return best[1]


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those links that join what earlier ones have not."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    kept = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _close_pairs(fp: np.ndarray, probe: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one bucket: by all its pairs if few are close, else breadth first among those not reached yet."""
    if len(fp) <= 1024:
        close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= limit
        close &= ~(probe[:, None] & probe[None, :])
        if np.count_nonzero(close) <= 9 * len(fp):
            a, b = np.nonzero(np.triu(close, 1))
            return [(x, y) for x, y in zip(fp[a].tolist(), fp[b].tolist(), strict=True) if x != y]
    filed = np.unique(fp[~probe])
    left = np.setdiff1d(fp, filed)  # not reached yet, of those that only probe
    open_, links = filed, []
    is_filed = set(filed.tolist())
    while len(open_):  # from every fingerprint not reached yet; probes alone have no links
        front, open_ = [int(open_[0])], open_[1:]
        while front:
            here = front.pop()
            near = np.bitwise_count(open_ ^ np.uint64(here)) <= limit
            found = open_[near].tolist()
            open_ = open_[~near] if found else open_
            if here in is_filed and len(left):
                near = np.bitwise_count(left ^ np.uint64(here)) <= limit
                if near.any():
                    found += left[near].tolist()
                    left = left[~near]
            links += [(here, x) for x in found]
            front += found
    return links


def bucket_links(buckets: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) of each bucket; ``buckets`` has bucket, fp and probe."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links() -> pa.RecordBatch:
            bucket, fp, probe = (np.concatenate(x) for x in zip(*held, strict=True))
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            size = np.diff(np.append(edge, len(bucket)))
            pairs: list[tuple[int, int]] = []
            for at, n in zip(edge[size > 128], size[size > 128], strict=True):
                pairs += _close_pairs(fp[at : at + n], probe[at : at + n], limit)
            small = np.repeat(size <= 128, size)
            for step in range(1, 128):
                here = np.flatnonzero((bucket[step:] == bucket[:-step]) & small[step:])
                if not len(here):
                    break
                x, y = fp[here], fp[here + step]
                good = (np.bitwise_count(x ^ y) <= limit) & (x != y) & ~(probe[here] & probe[here + step])
                pairs += zip(x[good].tolist(), y[good].tolist(), strict=True)
            kept = np.array(_forest(iter(pairs)), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = [batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("probe").to_numpy(zero_copy_only=False)]
            if held and sum(len(h[0]) for h in held) > 200_000:  # up to the start of the last bucket
                last = held[-1][0][-1]
                cut = int(np.searchsorted(rows[0] != last, True)) if rows[0][0] == last else 0
                if cut < len(rows[0]):
                    held.append(tuple(r[:cut] for r in rows))
                    yield links()
                    held, rows = [], [r[cut:] for r in rows]
            if len(rows[0]):
                held.append(tuple(rows))
        if held:
            yield links()

    dealt = buckets.select("bucket", "fp", "probe").repartition(F.col("bucket")).sortWithinPartitions("bucket", "fp", "probe")
    return dealt.mapInArrow(work, "a long, b long")


def split_buckets(buckets: DataFrame, groups: int) -> DataFrame:
    """Each row once for each of ``groups`` groups of the bits that its bucket's key lacks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, used, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("bucket", "used", "fp"))
            probe = batch.column("probe").to_numpy(zero_copy_only=False)
            for mask in np.unique(used):
                free = [b for b in range(64) if not int(mask) >> b & 1]
                at = used == mask
                for g in range(groups):
                    own = np.uint64(_mask(free[g::groups]))
                    key = (bucket[at] ^ (np.uint64(g + 1) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
                    key = (key ^ (key >> np.uint64(32)) ^ (fp[at] & own)) * np.uint64(0xBF58476D1CE4E5B9)
                    cols = [key ^ (key >> np.uint64(29)), np.full(at.sum(), mask | own, np.uint64), fp[at]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in cols), pa.array(probe[at])], names=["bucket", "used", "fp", "probe"])

    return buckets.mapInArrow(work, "bucket long, used long, fp long, probe boolean")


def close_links(fps: DataFrame, limit: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` of ``fps`` as all pairs within ``limit`` bits would."""
    total = fps.count()
    sample = [r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    keys = []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for g, (bits, threshold) in enumerate(plan_groups(np.array(sample, np.int64).view(np.uint64), total, limit)):
        for k in range(threshold + 1):
            keys += [(g, signed(_mask(bits)), signed(_mask(flip)), k > 0) for flip in combinations(bits, k)]
    key = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(m).cast("long").alias("mask"), F.lit(f).cast("long").alias("flip"), F.lit(p).alias("probe")) for g, m, f, p in keys]))
    rows = fps.select("fp", key.alias("k")).select(
        F.xxhash64("k.g", F.col("fp").bitwiseAND(F.col("k.mask")).bitwiseXOR(F.col("k.flip"))).alias("bucket"), F.col("k.mask").alias("used"), "fp", F.col("k.probe").alias("probe")
    )
    rows, links = stage(rows, "buckets"), []
    for level in range(SPLITS + 1):
        large = rows.groupBy("bucket").count().where(F.col("count") > bucket).select("bucket")
        if level == SPLITS or large.isEmpty():
            links.append(bucket_links(rows, limit))
            break
        large = stage(large, "large-buckets")
        links.append(bucket_links(rows.join(large, "bucket", "left_anti"), limit))
        rows = stage(split_buckets(rows.join(large, "bucket", "left_semi"), limit + 1), "buckets")
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def _classes(docs: DataFrame, limit: int, shingle: int) -> DataFrame:
    """doc_id, text_hash, fp, root (the smallest fingerprint of the component) and component_id of every row."""
    hashed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc_id"), "text")
    rows = stage(fingerprints(hashed, shingle=shingle).select("doc_id.*", "fp"), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    found = connected_components(close_links(nodes.select("fp"), limit))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, limit: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fp (long) and component_id of every row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most ``limit``
    differing bits reach.  Texts without words (null, empty, blank) have
    fingerprint 0 and link like any other.  Repeated rows get a row each.  Null
    doc_ids get rows too, and a component_id of null only where no row of the
    component has an id.  An empty table gives no rows.  Other columns are not
    read.
    """
    return _classes(docs, limit, shingle).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, limit: int = STAGE_LIMIT, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all columns, whatever their names: of each component one row stays.

    It is the row with the smallest doc_id (null is the largest), among rows
    that share this id the one with the smallest text hash, and one of them if
    they are equal.  Texts without words (null ones too) are one component with
    all that link to it; an empty table stays empty.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    kept = _classes(docs, limit, shingle).groupBy("root").agg(F.min(order).alias("row")).select(F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash"))
    marked = packed(docs, "doc_id", F.xxhash64("text").alias("text_hash"))
    one = marked.join(kept, marked["doc_id"].eqNullSafe(kept["_id"]) & (marked["text_hash"] == kept["_hash"]), "left_semi")
    return unpacked(one.dropDuplicates(["doc_id", "text_hash"]), docs.columns)
