"""Repeated passages by sparse suffix arrays (operator 6).

A suffix is retained where its first ``GRAM`` words have the smallest hash of
any such run in a window of words, so equal passages retain the same suffixes.
Windows are chosen so that every passage of ``passage`` words retains one.
A passage belongs to the leftmost smallest start in it, so the passages of one
retained suffix are a stretch of the text.  Equal stretches are kept once.
Where stretches of one suffix differ, they are sorted by their words from the
suffix on, by ranges over all tasks, and each is compared with its neighbours:
the longer common beginning is as far as any match of this suffix extends to
the right.  What reaches ``passage`` words is extended to the left, passage by
passage, and passages that are equal over their whole length are repeats.

A word is *repeated* if it stands in a passage of ``passage`` words that a
document with a smaller doc_id has too, or the same document further left.
Every such passage is found, however often it occurs, without pairing its
occurrences.  Words are runs between ASCII white space, A-Z folded; runs of
words are told apart by two unlike 64-bit hashes of their words' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.llm.common import Words, bound_batches, drop_path, forget_others, mix, packed, runs_hash, scratch_path, small_batches, spread, stage, unpacked, windows_min

PASSAGE, GRAM = 50, 12


def _two_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    low, high = words.exact()
    return spread(low, high), spread(mix(high ^ np.uint64(0xA0761D6478BD642F)), mix(low))


class Stretches:
    """The passages of texts by retained suffix: consecutive passages that have one suffix are a stretch.

    ``start`` is the first passage's first word, ``n`` the number of passages,
    ``at`` the suffix's first word, ``doc`` the text, ``suffix`` and ``whole``
    hashes of the suffix's first words and of all words of the stretch.
    """

    def __init__(self, column: pa.Array, passage: int, gram: int):
        self.words = words = Words(column)
        one, two = _two_hashes(words)
        runs = runs_hash(one, gram)
        if len(runs) < passage - gram + 1:
            self.start = self.n = self.at = self.doc = np.empty(0, np.int64)
            self.suffix = self.whole = np.empty(0, np.uint64)
            return
        # The smallest hash of the window; its place in the low bits makes the leftmost of equals win.
        low = np.uint64((1 << 28) - 1)
        least = windows_min((runs & ~low) | np.arange(len(runs), dtype=np.uint64), passage - gram + 1)
        doc = words.text_of()
        first = np.flatnonzero(np.arange(len(least)) + passage <= words.first[1:][doc][: len(least)])
        at = (least[first] & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[first[1:]] != doc[first[:-1]])])[: len(at)])
        self.start, self.at = first[new], at[new]
        self.n = np.diff(np.append(new, len(first)))
        self.doc = doc[self.start]
        self.suffix = runs[self.at]
        # Two runs of ``passage`` words, at both ends, and the number of words between them stand for all words.
        ends = runs_hash(two, passage)
        self.whole = mix(ends[self.start] ^ mix(ends[self.start + self.n - 1] + self.n.astype(np.uint64)))

    def place(self, of: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Numbers of words within their texts."""
        return (of - self.words.first[doc]).astype(np.int32)


def _again(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether an equal row stands before in the same text; rows come in the order of the text."""
    by = np.lexsort([np.arange(len(doc)), *keys, doc])
    same = np.ones(max(0, len(by) - 1), bool)
    for key in (doc, *keys):
        same &= key[by[1:]] == key[by[:-1]]
    out = np.zeros(len(doc), bool)
    out[by[1:]] = same
    return out


def _same_row(left: DataFrame, right: DataFrame) -> F.Column:
    return left["doc_id"].eqNullSafe(right["_id"]) & (left["text_hash"] == right["_hash"])


def _first_doc(rows: DataFrame, *by: str) -> DataFrame:
    """The smallest doc_id of each key (null is the largest), added up before rows are dealt."""
    return rows.groupBy(*by).agg(F.min("doc_id").alias("first_doc_id"))


def _later() -> F.Column:
    """Whether a row's document is not the first; a null doc_id is, if no other has the key."""
    return F.coalesce(F.col("doc_id") > F.col("first_doc_id"), F.col("doc_id").isNull() & F.col("first_doc_id").isNotNull())


def _contexts(docs: DataFrame, places: DataFrame, passage: int, gram: int) -> DataFrame:
    """The words before (``before``) and from (``onward``) the retained suffix of each place's stretch, with a blank after each word."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = places.groupBy("doc_id", "text_hash").agg(F.collect_set("start").alias("starts")).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    texts = docs.join(wanted, _same_row(docs, wanted)).select("doc_id", "text_hash", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in small_batches(batches, limit=1 << 18):
            s = Stretches(batch.column("text"), passage, gram)
            lists = batch.column("starts")
            good = np.flatnonzero(np.isin(s.start, lists.flatten().to_numpy() + np.repeat(s.words.first[:-1], lists.value_lengths().to_numpy())))
            # All words of the batch with a blank after each; a run of words is a slice of it.
            size = s.words.end - s.words.start
            edge = np.concatenate([[0], np.cumsum(size + 1)])
            spaced = np.full(edge[-1], 0x20, np.uint8)
            inside = np.repeat(edge[:-1] - np.cumsum(size) + size, size) + np.arange(size.sum())
            spaced[inside] = s.words.data[np.repeat(s.words.start - np.cumsum(size) + size, size) + np.arange(size.sum())]
            spaced = spaced.tobytes()
            a, b, c = edge[s.start[good]].tolist(), edge[s.at[good]].tolist(), edge[s.start[good] + s.n[good] - 1 + passage].tolist()
            doc = s.doc[good]
            for k in range(0, len(good), 4000):
                part, some = slice(k, k + 4000), pa.array(doc[k : k + 4000])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(some), batch.column("text_hash").take(some),
                        pa.array(s.suffix[good[part]].view(np.int64)), pa.array(s.whole[good[part]].view(np.int64)),
                        pa.array([spaced[x:y] for x, y in zip(b[part], c[part], strict=True)], pa.binary()), pa.array([spaced[x:y] for x, y in zip(a[part], b[part], strict=True)], pa.binary()),
                        pa.array(s.place(s.start[good[part]], doc[part])), pa.array((s.at - s.start)[good[part]].astype(np.int32)), pa.array(s.n[good[part]].astype(np.int32)),
                    ],
                    names=["doc_id", "text_hash", "suffix", "whole", "onward", "before", "start", "lead", "n"],
                )

    return texts.mapInArrow(cut, f"doc_id {kind}, text_hash long, suffix long, whole long, onward binary, before binary, start int, lead int, n int")


def _common(onward: pa.Array, suffix: np.ndarray) -> np.ndarray:
    """How many words from the suffix on each row has in common with the next; 0 for another suffix."""
    words = Words(onward)
    low, high = words.exact()
    n = np.diff(words.first)
    width = int(n.max(initial=0))
    at = np.minimum(words.first[:-1, None] + np.arange(width)[None, :], max(0, len(low) - 1))
    inside = np.arange(width)[None, :] < n[:, None]
    low, high = low[at], high[at]
    same = (low[1:] == low[:-1]) & (high[1:] == high[:-1]) & inside[1:] & inside[:-1]
    return np.where(suffix[1:] == suffix[:-1], np.logical_and.accumulate(same, axis=1).sum(1), 0)


def _matched_passages(contexts: DataFrame, passage: int) -> DataFrame:
    """Passages of the sorted stretches as far as their neighbours let them reach, by two hashes."""
    kind = contexts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "suffix", "whole", "head", "start", "passage", "check"]

    def passages(rows: pa.RecordBatch, reach: np.ndarray) -> pa.RecordBatch:
        n = np.clip(rows.column("lead").to_numpy() + reach - passage + 1, 0, rows.column("n").to_numpy())
        at = pa.array(np.flatnonzero(n))
        rows, n = rows.take(at), n[n > 0]
        words = Words(pa.array([a + b for a, b in zip(rows.column("before").to_pylist(), rows.column("onward").to_pylist(), strict=True)], pa.binary()))
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place, row = np.repeat(words.first[:-1], n) + step, pa.array(np.repeat(np.arange(len(n)), n))
        one, two = (runs_hash(h, passage)[place] if len(place) else np.empty(0, np.uint64) for h in _two_hashes(words))
        start = np.repeat(rows.column("start").to_numpy(), n) + step
        return pa.RecordBatch.from_arrays(
            [*(rows.column(c).take(row) for c in names[:4]), pa.array(step == 0), pa.array(start.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=names
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, 1 << 30  # the last row waits for its neighbour; at the ends of a range there is none to bound the reach
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            common = _common(rows.column("onward"), rows.column("suffix").to_numpy())
            if rows.num_rows > 1:
                yield passages(rows.slice(0, rows.num_rows - 1), np.maximum(np.append(before, common[:-1]), common))
                before = common[-1]
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield passages(held, np.array([1 << 30]))

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["suffix", "onward", "before", "doc_id", "text_hash", "start"]
    dealt = contexts.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(scan, f"doc_id {kind}, text_hash long, suffix long, whole long, head boolean, start int, passage long, check long")


def _merge_runs(hits: DataFrame) -> DataFrame:
    """The union of each document's hits as disjoint runs, with the first document of the hit that begins the run."""
    kind = hits.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "start_word", "end_word", "first_doc_id"]

    def merged(rows: pa.RecordBatch) -> pa.RecordBatch:
        doc = rows.column("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        text, start, end = (rows.column(c).to_numpy() for c in names[1:4])
        same = (doc[1:] == doc[:-1]) & (text[1:] == text[:-1])
        # The furthest end so far within each document: ends of later documents are set off above all before.
        far = np.concatenate([[0], np.cumsum(~same)]) * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + far) - far
        new = np.flatnonzero(np.concatenate([[True], ~(same & (start[1:] <= reach[:-1]))]))
        at = pa.array(new)
        final = reach[np.append(new[1:] - 1, len(end) - 1)].astype(np.int32)
        return pa.RecordBatch.from_arrays([rows.column("doc_id").take(at), pa.array(text[new]), pa.array(start[new]), pa.array(final), rows.column("first_doc_id").take(at)], names=names)

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by document and place; the last run is held until its document goes on or ends."""
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.RecordBatch.from_arrays(batch.columns, names=names)
            done = merged(now if held is None else pa.Table.from_batches([held, now]).combine_chunks().to_batches()[0])
            held = done.slice(done.num_rows - 1)
            yield done.slice(0, done.num_rows - 1)
        if held is not None:
            yield held

    dealt = hits.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "start", F.desc("end"), "first_doc_id")
    return dealt.mapInArrow(runs_of, f"doc_id {kind}, text_hash long, start_word int, end_word int, first_doc_id {kind}")


def repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """Runs of repeated words: doc_id, text_hash, start_word, end_word, first_doc_id.

    Runs are as long as can be; ``first_doc_id`` is the smallest doc_id that has
    the run's first passage (the run's own, if only earlier places in the
    document have it), and ``text_hash`` Spark's xxhash64 of the text.  Rows
    that share a doc_id are versions of one document, and what only they share
    is no repeat; a null doc_id is the largest.  Repeated rows count once.  Null
    texts and texts of fewer than ``passage`` words have no passages, an empty
    table gives no rows, other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    spark = docs.sparkSession
    bound_batches(spark)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in small_batches(batches, limit=1 << 19):
            s = Stretches(batch.column("text"), passage, gram)
            doc = pa.array(s.doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(doc), batch.column("text_hash").take(doc), pa.array(s.suffix.view(np.int64)), pa.array(s.whole.view(np.int64)), pa.array(s.place(s.start, s.doc)), pa.array(s.n.astype(np.int32)), pa.array(_again(s.doc, s.suffix, s.whole))],
                names=["doc_id", "text_hash", "suffix", "whole", "start", "n", "again"],
            )

    paths = [scratch_path(spark, name) for name in ("stretches", "contexts")]
    retained = stage(rows.mapInArrow(stretches, f"doc_id {kind}, text_hash long, suffix long, whole long, start int, n int, again boolean"), path=paths[0])
    # A suffix whose first words no other place has can't begin a repeat; ``mixed`` ones have unlike stretches.
    # (The written table leaves the join free to split a frequent suffix over tasks.)
    frequent = retained.groupBy("suffix").agg(F.count("*").alias("places"), (F.min("whole") != F.max("whole")).alias("mixed"))
    frequent = stage(frequent.where("places > 1").select("suffix", "mixed"), "frequent-suffixes")
    shared = stage(retained.join(frequent, "suffix"), "shared-stretches")
    drop_path(spark, paths[0])
    firsts = stage(_first_doc(shared, "suffix", "whole", "mixed"), "first-stretches")
    open_ = shared.where("mixed and not again").join(firsts.where("mixed").drop("mixed"), ["suffix", "whole"]).where(F.col("doc_id").eqNullSafe(F.col("first_doc_id")))
    contexts = stage(_contexts(rows, open_.select("doc_id", "text_hash", "start"), passage, gram), path=paths[1])
    found = stage(_matched_passages(contexts, passage), "passages")
    drop_path(spark, paths[1])
    first_passages = stage(_first_doc(found, "passage", "check"), "first-passages")
    own = found.groupBy("passage", "check", "doc_id", "text_hash").agg(F.min("start").alias("own_start"))
    own = own.where("own_start is not null").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "passage": "_passage", "check": "_check"})
    named = stage(found.join(first_passages, ["passage", "check"]), "named-passages")
    again = named.join(own, (named["passage"] == own["_passage"]) & (named["check"] == own["_check"]) & _same_row(named, own) & (named["start"] > own["own_start"]))
    heads = named.where("head").groupBy("suffix", "whole").agg(F.min("first_doc_id").alias("head_doc_id"))
    named_firsts = stage(firsts.join(heads, ["suffix", "whole"], "left").select("suffix", "whole", "first_doc_id", F.coalesce("head_doc_id", "first_doc_id").alias("head_doc_id")), "named-stretches")

    columns = ["doc_id", "text_hash", "start"]
    whole = shared.join(named_firsts, ["suffix", "whole"]).where(F.col("again") | _later()).select(*columns, (F.col("start") + F.col("n") + (passage - 1)).alias("end"), F.col("head_doc_id").alias("first_doc_id"))
    end = (F.col("start") + passage).alias("end")
    hits = whole.union(named.where(_later()).select(*columns, end, "first_doc_id")).union(again.select(*columns, end, "first_doc_id"))
    return _merge_runs(hits)


def remove_repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """``docs`` without the words that earlier places have too; a document of which nothing is left goes.

    Texts without repeats, null and empty ones included, stay as they are.  The
    text between the cuts is kept byte for byte, with a line break at each cut.
    ``n_chars``, if there, is counted anew; all other columns stay, whatever
    their names.  Rows that share a doc_id are cut alike if their texts are equal.
    """
    runs = repeats(docs, passage, gram).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias("runs"))
    runs = runs.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                if not own:
                    out.append(text)
                    continue
                data = text.encode()
                words = Words(pa.array([text], pa.string()))
                pieces, at = [], 0
                for run in own:
                    pieces.append(data[at : words.start[run["start_word"]]].strip())
                    at = words.end[run["end_word"] - 1]
                pieces.append(data[at:].strip())
                out.append(b"\n".join(p for p in pieces if p).decode())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    marked = packed(docs, "doc_id", F.xxhash64("text").alias("text_hash"), "text", without=("text",))
    joined = marked.join(runs, _same_row(marked, runs), "left").select("row", "text", "runs")
    done = joined.mapInArrow(cut, joined.schema).where("runs is null or text <> ''")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        k = docs.columns.index("n_chars")
        new["n_chars"] = F.when(F.col("runs").isNull(), F.col(f"row.c{k}")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return unpacked(done, docs.columns, **new)


#: DuckDB SQL for the rows of ``repeats`` without ``text_hash``: every window of 50 words is compared as text.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
w AS (SELECT r, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT r, doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS g FROM (SELECT r, doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS first_doc_id FROM p GROUP BY g HAVING count(*) > 1),
h AS (SELECT r, doc_id, i, first_doc_id FROM (SELECT p.*, first_doc_id, row_number() OVER (PARTITION BY r, p.g ORDER BY i) AS nth FROM p JOIN f USING (g))
  WHERE nth > 1 OR coalesce(doc_id > first_doc_id, doc_id IS NULL AND first_doc_id IS NOT NULL)),
n AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true) AS new FROM h),
k AS (SELECT *, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM n)
SELECT doc_id, min(i)::INTEGER AS start_word, (max(i) + 50)::INTEGER AS end_word, arg_min(first_doc_id, i) AS first_doc_id FROM k GROUP BY r, doc_id, run
"""
