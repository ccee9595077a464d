"""Language identification by segmentation-marginalised unigrams (operator 7).

Each language has a probability for every piece of a fixed public vocabulary.
A text's likelihood is the product over its words (runs of letters, lower case)
of the sum over all ways to segment the word into pieces, by the forward
algorithm.  The probabilities are learned by expectation maximisation: a Spark
job per round sums the expected counts of the pieces over the learning rows,
and only these sums (vocabulary x languages) reach the driver.  All pieces of
letters take part and words are segmented whole, however long they are.

Fitted on about ``PER_LANGUAGE`` distinct labelled texts of each language.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from portfolia.llm.common import Words, bound_batches, distinct, forget_others, held_out, packed, small_batches, stage, sums, unpacked, worker_cache

PER_LANGUAGE, ROUNDS = 600, 3
#: Probability of a byte that no piece covers, and what unseen pieces get in counts.
BYTE, UNSEEN = 1e-7, 0.01
CACHE = 250_000
#: From this size on, values of a word are scaled after every eighth byte, so that they stay in range.
LONG = 32



def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[bytes]:
    """The vocabulary's lower-case pieces of letters, as bytes; the word start mark counts as a space."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return sorted({n.encode() for n in names if n == n.lower() and n.strip().isalpha()})


class Lattice:
    """Segmentations of words into pieces, found by walking a trie of the pieces from every byte."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=0)
        #: Bytes by number, 0 for those that no piece has; the node that each byte leads to, 0 for none (1 is the root).
        self.symbol = np.zeros(256, np.int32)
        used = sorted({b for p in pieces for b in p})
        self.symbol[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}, {}]
        piece_of = [-1, -1]
        for k, piece in enumerate(pieces):
            node = 1
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    piece_of.append(-1)
                node = children[node][b]
            piece_of[node] = k
        self.piece_of = np.array(piece_of, np.int32)
        self.next = np.zeros((len(children), len(used) + 1), np.int32)
        for node, ways in enumerate(children):
            for b, child in ways.items():
                self.next[node, self.symbol[b]] = child

    def edges(self, symbol: np.ndarray, first: int, last: int) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each start from ``first`` to before ``last``: (length, words, piece numbers) of the pieces that begin there; ``symbol`` is 0 past a word's end."""
        n, width = symbol.shape
        out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(last - first)]
        start, word = np.divmod(np.arange(n * (last - first)), n)
        start, node = start + first, np.ones(n * (last - first), np.int32)
        for length in range(1, min(self.longest, width - first) + 1):
            inside = start + length <= width
            word, start = word[inside], start[inside]
            node = self.next[node[inside], symbol[word, start + length - 1]]
            alive = node > 0
            word, start, node = word[alive], start[alive], node[alive]
            if not len(word):
                break
            piece = self.piece_of[node]
            found = np.flatnonzero(piece >= 0)
            edge = np.searchsorted(start[found], np.arange(first, last + 1))
            for k in np.flatnonzero(np.diff(edge)):
                here = found[edge[k] : edge[k + 1]]
                out[k].append((length, word[here], piece[here]))
        return out

    def likelihood(self, letters: np.ndarray, size: np.ndarray, p: np.ndarray, weight: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word in each language; ``total`` gets expected counts of pieces if ``weight`` (words x languages) is given.

        ``letters`` has a row for each word, the longest first, with zeros after
        its ``size`` bytes; ``p`` is pieces x languages.
        """
        (n, width), k = letters.shape, p.shape[1]
        symbol, span = self.symbol[letters], self.longest + 1
        active = np.searchsorted(-size, -np.arange(width + 1), side="left")  # how many words go on at each place
        #: Sums over the segmentations up to each of the next ``span`` places, and the log of what they are divided by.
        ring, scale, like = np.zeros((span, n, k)), np.zeros((n, k)), np.empty((n, k))
        ring[0] = 1
        kept, m = [], n
        for first in range(0, width, 128):
            for start, row in enumerate(self.edges(symbol, first, min(width, first + 128)), first):
                like[active[start] : m] = np.log(ring[start % span, active[start] : m]) + scale[active[start] : m]
                m = active[start]
                now = ring[start % span, :m]
                if width >= LONG and start % 8 == 7:
                    by = now.copy()
                    ring[:, :m] /= by
                    scale[:m] += np.log(by)
                if weight is not None:
                    kept.append((row, now.copy(), scale[:m].copy()))
                ring[(start + 1) % span, :m] += now * BYTE
                for length, word, piece in row:
                    ring[(start + length) % span][word] += now[word] * p[piece]
                ring[start % span] = 0
        like[:m] = np.log(ring[width % span, :m]) + scale[:m]
        if weight is not None:
            back, back_scale, counted = np.zeros((span, n, k)), np.zeros((n, k)), [(np.empty(0, np.int32), np.empty((0, k)))]
            for start in range(width - 1, -1, -1):
                row, before, before_scale = kept[start]
                m = len(before)
                back[(start + 1) % span, active[start + 1] : m] = 1  # words that end here
                off = np.exp(before_scale + back_scale[:m] - like[:m])
                now = back[(start + 1) % span, :m] * BYTE
                for length, word, piece in row:
                    after = back[(start + length) % span][word] * p[piece]
                    now[word] += after
                    counted.append((piece, before[word] * after * off[word] * weight[word]))
                back[start % span, :m] = now
                if width >= LONG and start % 8 == 0:
                    back[:, :m] /= now
                    back_scale[:m] += np.log(now)
            pieces, shares = (np.concatenate(x) for x in zip(*counted, strict=True))
            for j in range(k):
                total[:, j] += np.bincount(pieces, shares[:, j], len(self.pieces))
        return like


def _words(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of letters; the first place of each distinct word, and each word's number among them."""
    words = Words(pc.replace_substring_regex(pc.utf8_lower(column), r"[^\p{L}\p{M}]+", " "), fold=False)
    return words, *distinct(*words.exact())


def _groups(words: Words, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words ``chosen`` in groups of like sizes, the longest first: places in ``chosen``, letters with a space before, and sizes."""
    size = (words.end - words.start)[chosen] + 1
    kind = np.maximum(np.ceil(np.log2(size)), 5).astype(int)  # up to 32 bytes, then up to twice as many, and so on
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(-size[own], kind="stable")]
        step = max(1, min(8_000, (1 << 18) >> k))
        for a in range(0, len(own), step):
            part = own[a : a + step]
            at = np.arange(size[part[0]] - 1)[None, :]
            letters = words.data[np.minimum(words.start[chosen[part]][:, None] + at, len(words.data) - 1)]
            letters = np.where(at < size[part][:, None] - 1, letters, 0).astype(np.uint8)
            yield part, np.concatenate([np.full((len(part), 1), 0x20, np.uint8), letters], axis=1), size[part]


class Scorer:
    """Scores words with a cache, one per Python worker and model."""

    def __init__(self, lattice: Lattice, p: np.ndarray):
        self.lattice, self.p = lattice, p
        self.rows: dict[bytes, int] = {}
        self.scores = np.empty((0, p.shape[1]))

    def of(self, column: pa.Array) -> np.ndarray:
        """Log likelihood of each text in each language."""
        words, first, back = _words(column)
        low, high = words.exact()
        keys = np.stack([low[first], high[first]], axis=1).tobytes()
        keys = [keys[k : k + 16] for k in range(0, len(keys), 16)]
        if len(self.rows) > CACHE:
            self.rows.clear()
            self.scores = self.scores[:0]
        at = np.fromiter((self.rows.get(x, -1) for x in keys), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        got = np.empty((len(new), self.p.shape[1]))
        for part, letters, size in _groups(words, first[new]):
            got[part] = self.lattice.likelihood(letters, size, self.p)
        at[new] = len(self.scores) + np.arange(len(new))
        self.rows.update((keys[k], x) for k, x in zip(new.tolist(), at[new].tolist(), strict=True))
        self.scores = np.concatenate([self.scores, got])
        return sums(self.scores[at[back]], words.first)


_scorers: dict[str, Scorer] = worker_cache()


def fit(docs: DataFrame, pieces: list[bytes], per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` and the probabilities of the pieces, pieces x languages; ``docs`` has text and lang."""
    known = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    langs = sorted(counts)
    spark, k = docs.sparkSession, len(langs)
    p = np.full((len(pieces), max(1, k)), 1.0 / max(1, len(pieces)))
    if not k:
        return langs, p
    keep = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1_000_003, int(1_000_003 * per_language / counts[lang]) + 1))])
    sample = stage(known.where(F.abs(F.xxhash64("text") % 1_000_003) < keep[F.col("lang")]).distinct(), "language-rows")
    model = spark.sparkContext.broadcast((pieces, langs))

    for _ in range(rounds):
        now = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            pieces, langs = model.value
            forget_others()
            lattice, total = Lattice(pieces), np.zeros((len(pieces), len(langs)))
            for batch in small_batches(batches, limit=1 << 19):
                words, first, back = _words(batch.column("text"))
                weight = np.zeros((len(first), len(langs)))
                np.add.at(weight, (back, np.searchsorted(langs, batch.column("lang").to_pylist())[words.text_of()]), 1)
                for part, letters, size in _groups(words, first):
                    lattice.likelihood(letters, size, now.value, weight[part], total)
            piece, which = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(which), pa.array(total[piece, which])], names=["piece", "lang", "n"])

        summed = sample.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        total = np.full((len(pieces), k), UNSEEN)
        for r in summed.toLocalIterator():
            total[r["piece"], r["lang"]] += r["n"]
        p = total / total.sum(0)
    return langs, p


def _identified(docs: DataFrame, vocabulary: str | None, per_language: int, whole: bool) -> DataFrame:
    """``row`` and ``text`` (see ``packed``; doc_id alone, if not ``whole``), ``held_out``, ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    bound_batches(spark)
    pieces = read_pieces(vocabulary or default_vocabulary())
    langs, p = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()), pieces, per_language)
    tag = uuid.uuid4().hex
    model = spark.sparkContext.broadcast((pieces, langs, p))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, p = model.value
        forget_others(_scorers)
        if tag not in _scorers:
            _scorers.clear()
            _scorers[tag] = Scorer(Lattice(pieces), p)
        scorer = _scorers[tag]
        for batch in small_batches(batches, limit=1 << 19):
            column = batch.column("text").fill_null("")
            like = scorer.of(column)
            lettered = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False) & bool(langs)
            best = like.argmax(1)
            share = 1 / np.exp(like - like[np.arange(len(best)), best][:, None]).sum(1)
            names = np.array([*langs, "und"], object)[np.where(lettered, best, len(langs))]
            text = [batch.column("text")] if whole else []
            yield pa.RecordBatch.from_arrays([batch.column("row"), *text, batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(lettered, share, 0.0))], names=names_out)

    chosen = docs if whole else docs.select("doc_id", "text")
    rows = packed(chosen, "text", held_out().alias("held_out"), without=("text",))
    schema = StructType([f for f in rows.schema if whole or f.name != "text"]).add("lang_pred", "string").add("score", "double")
    names_out = schema.names
    return rows.mapInArrow(work, schema)


def identify(docs: DataFrame, vocabulary: str | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, ``held_out``, ``lang_pred`` and ``score``, a row for each row of ``docs``.

    ``lang_pred`` is the language with the highest likelihood (the first by name
    of equals), ``score`` its share in the sum over all languages.  Texts that
    are null or have no letter get ``und`` and 0; so do all if no row has a
    language to learn from.  Learns only from rows that are not held out and
    have an id, a text and a lang; a text with several languages counts for
    each.  Repeated rows get a row each, an empty table none.
    """
    return _identified(docs, vocabulary, per_language, False).select(F.col("row.c0").alias("doc_id"), "held_out", "lang_pred", "score")


def reject_unknown(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is identified with at least the score ``least``, with their columns, whatever their names.

    Null texts and texts without letters go; repeated rows and null ids are
    judged like others, ties don't arise at a score over a half, and an empty
    table stays empty.
    """
    found = _identified(docs, None, PER_LANGUAGE, True)
    return unpacked(found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)), docs.columns, text=F.col("text"))
