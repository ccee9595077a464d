"""BPE encoding and decoding by content-defined chunk reuse (operator 5).

A text is cut where a rolling hash over its bytes has enough zero bits, so
equal passages of different documents are cut alike.  Each chunk is encoded
once per Python worker and reused for every later document that holds it.  A
cut may fall inside a word; the encoding of a chunk is final only between its
first and its last white space, because no pre-token crosses white space.  The
rest, at the joins, is encoded again over the joined bytes until the encoding
of the left and the right chunk agree, which is at the nearest white space.

Words and chunks are told apart by their bytes, not by a hash alone.  For a
tokenizer whose pre-tokens may cross white space the library encodes whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.llm.common import FOLD, Words, bound_batches, distinct, forget_others, small_batches, spread, worker_cache

#: Entries of the cache of word parts and bytes of the chunk cache of one Python worker.
PART_CACHE, CHUNK_CACHE = 1_000_000, 24 << 20
#: A cut follows a byte whose hash has this many zero bits: chunks of 512 bytes on average.
CUT_BITS = 9

_SPACES = [b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"]
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Letters of parts that NFC leaves alone (with the bytes of their UTF-8 form), and ASCII marks of one kind of pre-token.
_PLAIN_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëìíîïñòóôöùúûü"
_MARKS = b".,!?;:\"()[]%*#&$|-"
_IS_MARK = np.isin(np.arange(256), list(_MARKS))
_IS_ASCII_LETTER = np.array([97 <= b <= 122 or 65 <= b <= 90 for b in range(256)])
_IS_SECOND = np.isin(np.arange(256), [c.encode()[1] for c in _PLAIN_LETTERS if ord(c) > 127])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """Byte to letter as in byte-level BPE: printable bytes stay, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Encodes whole texts as ``tokenizers`` does, with caches of words and chunks."""

    def __init__(self, path: str, cut_bits: int = CUT_BITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mask = np.uint32(((1 << cut_bits) - 1) << 12)
        self.gear = np.random.default_rng(17).integers(0, 1 << 32, 256, dtype=np.uint32)
        self.splits = self._splits_at_white_space()
        self.forget()
        self.chunks: dict[bytes, tuple[bytes, bytes | None, bytes]] = {}
        self.chunk_bytes = 0
        self.letters = _byte_letters()
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        #: The shortcut for plain parts is checked against the library before it is used.
        self.shortcut = False
        probe = ["Strasse,", "élan", "a", "...", "der.", "L'", "naïve!!", "x" * 40, "don't", "ÉTÉ.", "|", "(of)", "Of-course", "%%%"]
        whole = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe]
        self.shortcut = True
        self.shortcut = whole == [np.frombuffer(self._word(w.encode()), np.int32).tolist() for w in probe]
        self.forget()

    def _splits_at_white_space(self) -> bool:
        """Whether texts joined by white space encode as their parts do, one after the other."""
        own = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        parts = ["one", "Two.", "1 2", "don't", "é", "...", "x9_", "(a", "'s", "日本"]
        return all(own(a + gap + b) == own(a) + own(b) == own(gap + a) + own(b + gap) for a in parts for b in parts for gap in (" ", "\t", "\n", "  ", "\r\n"))

    def forget(self) -> None:
        """Empty the cache: sorted hashes with the exact keys, the place and the number of their ids; old ones and those learned lately."""
        self.known = [(*[np.empty(0, np.uint64)] * 3, *[np.empty(0, np.int64)] * 2)] * 2
        self.ids, self.used = np.empty(1 << 16, np.int32), 0

    def _find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each key; place -1 if it is not known."""
        keys = spread(low, high)
        place, n = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for have, have_low, have_high, where, many in self.known:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                good = (have_low[at] == low) & (have_high[at] == high)
                place[good], n[good] = where[at[good]], many[at[good]]
        return place, n

    def _learn(self, low: np.ndarray, high: np.ndarray, parts: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokenize parts that are not known: plain ones by the model alone, others by the whole library."""
        letters, tokenize, out = self.letters, self.tokenizer.model.tokenize, []
        for part, short in zip(parts, plain.tolist(), strict=True):
            if short:
                out.append([t.id for t in tokenize(part.decode() if part.isascii() else part.decode("latin-1").translate(letters))])
            else:
                out.append(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids)
        n = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((x for ids in out for x in ids), np.int32, n.sum())
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(flat), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        place = self.used + np.cumsum(n) - n
        fresh = (spread(low, high), low, high, place, n)
        self.used += len(flat)
        old, lately = self.known
        lately = self._sorted(lately, fresh)
        if len(lately[0]) > max(50_000, len(old[0]) // 3):
            old, lately = self._sorted(old, lately), tuple(x[:0] for x in lately)
        self.known = [old, lately]
        return place, n

    @staticmethod
    def _sorted(*tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        joined = [np.concatenate(x) for x in zip(*tables, strict=True)]
        by = np.argsort(joined[0])
        return tuple(x[by] for x in joined)

    def _word(self, word: bytes) -> bytes:
        return self.runs([word])[0].tobytes()

    def _parts(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, plainness and word of each word's parts: letters and the marks after them, or the word as it is."""
        data, start, end = words.data, words.start, words.end
        core = end.copy()
        if self.shortcut:
            live = np.arange(len(end))
            while len(live):  # marks at the end
                live = live[(core[live] > start[live]) & _IS_MARK[data[np.maximum(core[live] - 1, 0)]]]
                core[live] -= 1
            fits = _IS_ASCII_LETTER[data]
            if len(data) > 1:
                pair = (data[:-1] == 0xC3) & _IS_SECOND[data[1:]]
                fits[:-1] |= pair
                fits[1:] |= pair
            strange = np.concatenate([[0], np.cumsum(~fits)])
            plain = strange[core] == strange[start]
        else:
            plain = np.zeros(len(start), bool)
        core = np.where(plain, core, end)
        both = np.column_stack([start, core]).ravel(), np.column_stack([core, end]).ravel()
        some = both[1] > both[0]
        return both[0][some], both[1][some], np.repeat(plain, 2)[some], np.repeat(np.arange(len(start)), 2)[some]

    def runs(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all of ``data`` in a row, and where each one's ids start and end; each must begin and end as words do."""
        if len(self.known[0][0]) + len(self.known[1][0]) > PART_CACHE:
            self.forget()
        words = Words(pa.array(data, pa.binary()), fold=False)
        raw = words.data
        start, end, plain, word = self._parts(words)
        # Plain parts are the same in either case; others have keys of their own, with a bit of the length byte turned.
        words.data = FOLD[raw]
        words.start, words.end = start, end
        low, high = words.exact()
        if not plain.all():
            words.data = raw
            words.start, words.end = start[~plain], end[~plain]
            low[~plain], own = words.exact()
            high[~plain] = own ^ np.uint64(1 << 60)
        first, back = distinct(low, high)
        low, high = low[first], high[first]
        place, n = self._find(low, high)
        new = np.flatnonzero(place < 0)
        if len(new):
            folded = FOLD[raw].tobytes()
            exact, short = raw.tobytes(), plain[first[new]]
            parts = [(folded if s else exact)[a:b] for a, b, s in zip(start[first[new]].tolist(), end[first[new]].tolist(), short.tolist(), strict=True)]
            place[new], n[new] = self._learn(low[new], high[new], parts, short)
        size = n[back]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.arange(ends[-1]) + np.repeat(place[back] - ends[:-1], size)]
        return flat, ends[np.searchsorted(word, words.first)]

    def cuts(self, data: bytes) -> list[int]:
        """Where the chunks of ``data`` end: a gear hash over 8 bytes, by doubling."""
        raw = np.frombuffer(data, np.uint8)
        h = self.gear[raw]
        for step in (1, 2, 4):
            if len(h) > step:
                h[step:] += h[:-step] << np.uint32(step)
        ends = np.flatnonzero((h & self.mask) == 0) + 1
        ends = ends[ends < len(raw)]
        ends = ends[(raw[ends] & 0xC0) != 0x80]  # never inside a character
        return [*ends.tolist(), len(raw)]

    def _learn_chunks(self, unseen: list[bytes]) -> None:
        """Bytes before the first white space, ids between, bytes after the last; no white space: all bytes, None, none."""
        ends, inner = [], []
        for chunk in unseen:
            first = _SPACE.search(chunk)
            last = max(map(chunk.rfind, _SPACES)) if first else 0
            ends.append((first.start(), last) if first else None)
            inner.append(chunk[first.start() : last] if first else b"")
        flat, at_ids = self.runs(inner)
        for k, (chunk, at) in enumerate(zip(unseen, ends, strict=True)):
            ids = flat[at_ids[k] : at_ids[k + 1]].tobytes()
            self.chunks[chunk] = (chunk[: at[0]], ids, chunk[at[1] + 1 :]) if at else (chunk, None, b"")
            self.chunk_bytes += len(chunk) + len(ids) + 300

    def _join(self, chunks: list[bytes], joins: list[bytes]) -> list[bytes | None]:
        """Ids of consecutive chunks; None stands for the bytes around a cut, up to the nearest white space, added to ``joins``."""
        out: list[bytes | None] = []
        between = b""
        for chunk in chunks:
            head, body, tail = self.chunks[chunk]
            between += head
            if body is None:
                continue
            if between:
                joins.append(between)
                out.append(None)
            out.append(body)
            between = tail
        if between:
            joins.append(between)
            out.append(None)
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """All ids of each text, int32; none for null."""
        if not self.splits:
            return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        cut = []
        for text in texts:
            data = (text or "").encode()
            ends = self.cuts(data) if data else []
            cut.append([data[a:b] for a, b in zip([0, *ends], ends)])
        if self.chunk_bytes > CHUNK_CACHE:
            self.chunks.clear()
            self.chunk_bytes = 0
        self._learn_chunks(list({c for chunks in cut for c in chunks if c not in self.chunks}))
        joins: list[bytes] = []
        parts = [self._join(chunks, joins) for chunks in cut]
        flat, at = self.runs(joins)  # encoded again over the joined bytes
        flat, at = flat.tobytes(), iter((4 * at).tolist())
        last, out = next(at), []
        for part in parts:
            for k, ids in enumerate(part):
                if ids is None:
                    start, last = last, next(at)
                    part[k] = flat[start:last]
            out.append(np.frombuffer(b"".join(part), np.int32))
        return out

    def encode_whole(self, texts: list[str | None]) -> list[np.ndarray]:
        """As ``encode_all``, word by word without chunks, for callers that cut the ids themselves."""
        if not self.splits:
            return self.encode_all(texts)
        flat, at = self.runs([(t or "").encode() for t in texts])
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """As ``decode(ids, skip_special_tokens=False)``: this vocabulary file names no decoder, so tokens are joined by spaces."""
        names = self.names
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join([names[i] for i in ids.tolist() if 0 <= i < len(names)])


_encoders: dict[tuple[str, int], Encoder] = worker_cache()


def encoder(path: str, cut_bits: int = CUT_BITS) -> Encoder:
    """The encoder of this Python worker, with its caches."""
    forget_others(_encoders)
    if (path, cut_bits) not in _encoders:
        _encoders[path, cut_bits] = Encoder(path, cut_bits)
    return _encoders[path, cut_bits]


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``ids`` (array of int) and ``decoded`` text.

    Null and empty texts have no ids and decode to the empty text.  Repeated
    rows and null ids are kept as they are; other columns are not read.  There
    is no shuffle: each task encodes the rows that it scans.
    """
    path = tokenizer or default_tokenizer()
    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in small_batches(batches, limit=1 << 19):
            ids = enc.encode_all(batch.column("text").to_pylist())
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array([enc.decode(x) for x in ids], pa.string())],
                names=["id", "ids", "decoded"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the query reports of ``encode_decode``'s rows."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
