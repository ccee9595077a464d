"""Toxicity by a subsequence-kernel support vector machine (operator 9).

Stretches of text are compared by their common subsequences of three letters
within a span of ``SPAN``, weighted by ``DECAY`` to the power of the span; the
kernel is normalised for length.  The stretches of a sentence are its words, its
pairs of neighbouring words, read without the blank between them, and its longer
words read at every second and every third letter: these hold the
subsequences with one or two letters put in between all others; words with a letter
three times in a row or more are also read without it.  A sentence is
as toxic as its highest stretch, and a document as its highest sentence.

The machine is trained on all sentences of the learning rows, in rounds (a
multiple-instance machine with an active set): each takes from every toxic row
the stretch that is now its highest, as a row with a toxic label has at least one
such sentence, and from every sentence of every clean row its highest stretch,
if that is within the margin; others would have no loss.  Before the first round
there is no machine: how many more toxic than clean rows have a subsequence
takes its place, and a clean row gives its ``FIRST`` highest sentences.  In the
first ``WORD_ROUNDS`` rounds the stretches are words alone; the others count by
``LESS`` less, as there are so many of them.  Where toxic rows have phrases of
ordinary words, words tell the learning rows badly apart (``TOLD``); then all
stretches are taken from the first round on.

Landmarks of the Nystroem map are a sample by hash of the sentences that a round
takes, half of each label.  The map sends a stretch to its kernel values with the
landmarks times the inverse root of theirs; the machine has squared hinge loss.
Since the map and the machine are linear in the subsequences, the value of a
stretch is a sum over its subsequences of one learned table.

Words are between white space.  Digits stand for the letters they look like
where a word has letters too; other ASCII characters are dropped, a letter three
times in a row or more counts once, and three single letters in a row or more
are one word, so that ``i-d i o t`` stays near.  A sentence ends at a line's end
or at a word of two letters and more that ends in ``.``, ``!`` or ``?``.

Fitted on about ``ROWS`` labelled rows of each label.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.llm.common import SPACES, Words, bound_batches, forget_others, held_out, labelled_texts, small_batches

ROWS, LANDMARKS, CUT = 3_000, 320, 0.3
#: Rounds; of these the first on words alone; sentences that a clean row gives to the first.
ROUNDS, WORD_ROUNDS, FIRST = 5, 3, 3
#: What a pair or a word read in strides must be higher by than words: there are many more of them.
LESS = 0.5
#: If words first tell the learning rows apart by a lower correlation, all stretches are tried from the first round on, and taken if ``BETTER``.
TOLD, BETTER = 0.9, 0.1
DECAY, SPAN, COST = 0.6, 5, 1.0
#: Places of the second and third letter after the first.
SPANS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: Words of so many letters are also read at every second and third letter: what is read has four letters or more.
STRIDES = {2: 7, 3: 10}

#: The letters that the digits 0 to 9 look like.
LOOKS = b"oizeasgtbg"
_MEANT = np.arange(256, dtype=np.uint8)
_MEANT[0x30:0x3A] = np.frombuffer(LOOKS, np.uint8)
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_END = np.array([chr(b) in ".!?" for b in range(256)])

#: Subsequences have codes of 18 bits: those of a to z each their own, those with bytes of other letters by multiplication.
CODES = 1 << 18
_PLACE = [
    np.array([(b - 96) * 27 ** (2 - k) if 97 <= b <= 122 else b * m % CODES if b >= 128 else 0 for b in range(256)], np.int32)
    for k, m in enumerate((40_503, 99_991, 173_207))
]


def _code(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Codes of the letters at each place and ``a`` and ``b`` after it."""
    size = len(data) - b
    return (_PLACE[0][data[:size]] + _PLACE[1][data[a : a + size]] + _PLACE[2][data[b:]]) & (CODES - 1)


def _norm(size: np.ndarray) -> np.ndarray:
    """Root of the squared weights of all subsequences of so many letters."""
    return np.sqrt(sum(DECAY ** (2 * b + 2) * np.maximum(size - b, 0) for _, b in SPANS))


class Sentences:
    """The words of texts as letters: ``data`` holds them back to back, word k is from ``start[k]`` to ``end[k]`` in text ``doc[k]``.

    ``pair[k]`` is the end of the next word, if it is of the same sentence, or else of word k itself.
    """

    def __init__(self, column: pa.Array):
        words = Words(pc.utf8_lower(column.fill_null("") if column.null_count else column), SPACES, fold=False)
        raw, doc = words.data, words.text_of()
        before = np.concatenate([[0], np.cumsum(_LETTER[raw])])
        own = before[words.end] > before[words.start]  # words with a letter
        word = np.zeros(len(raw) + 1, np.int64)
        np.add.at(word, words.start, 1)
        word = np.cumsum(word)[:-1] - 1  # the word of each byte; those of white space are no letters
        kept = _LETTER[raw] | _DIGIT[raw]
        if len(own):
            kept &= own[np.maximum(word, 0)]
        data, word = _MEANT[raw[kept]], word[kept]
        same = np.zeros(len(data), bool)
        same[1:] = (data[1:] == data[:-1]) & (word[1:] == word[:-1])
        run = np.cumsum(~same) - 1
        long = np.bincount(run)[run] >= 3 if len(run) else same
        once = ~same | ~long
        self.data, self.long, word = data[once], long[once], word[once]
        chars = np.bincount(word[(self.data & 0xC0) != 0x80], minlength=len(doc))
        size = np.bincount(word, minlength=len(doc))
        end = np.cumsum(size)
        # A sentence ends before a new line and after a word that ends in a mark; spelled-out words have none inside.
        lines = np.concatenate([[0], np.cumsum(raw == 0x0A)])
        over = np.ones(len(doc), bool)
        over[:-1] = (doc[1:] != doc[:-1]) | (lines[words.start[1:]] != lines[words.start[:-1]])
        over |= (chars != 1) & _END[raw[words.end - 1]]
        sentence = np.cumsum(over) - over
        some = size > 0
        chars, end, size, doc, sentence = chars[some], end[some], size[some], doc[some], sentence[some]
        # Three single letters in a row or more are one word.
        head = np.ones(len(size), bool)
        head[1:] = ~((chars[1:] == 1) & (chars[:-1] == 1) & (doc[1:] == doc[:-1]))
        group = np.cumsum(head) - 1
        head |= np.bincount(group)[group] < 3 if len(group) else head
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(size)) - 1 if len(first) else first
        self.start, self.end = (end - size)[first], end[last]
        self.doc, self.sentence, self.texts = doc[first], sentence[first], len(column)
        self.pair = self.end.copy()
        if len(first):
            self.pair[:-1] = np.where(self.sentence[1:] == self.sentence[:-1], self.end[1:], self.end[:-1])

    def values(self, table: np.ndarray, words_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The highest stretch of each word (or the word itself): its value, the stride it is read at (0: the pair from this word on, -1: without runs) and the letter it starts with."""
        size, both = self.end - self.start, self.pair - self.start
        alone, across = _sums(self.data, self.start, self.end, self.pair, table)
        joined = across + alone
        joined[:-1] += np.where(both[:-1] > size[:-1], alone[1:], 0)
        best = _over(alone, _norm(size))
        stride, at = np.ones(len(best), np.int64), np.zeros(len(best), np.int64)
        if words_only:
            return best, stride, at
        value = np.where(both > size, _over(joined, _norm(both)) - LESS, -np.inf)
        stride[value > best] = 0
        best = np.maximum(best, value)
        for step, least in STRIDES.items():
            long = np.flatnonzero(size >= least)
            if len(long):
                n = np.repeat(size[long], step)
                offset = np.tile(np.arange(step), len(long))
                count = (n - offset + step - 1) // step
                end = np.cumsum(count)
                begin = end - count
                source = np.repeat(np.repeat(self.start[long], step) + offset - step * begin, count) + step * np.arange(end[-1])
                value, _ = _sums(self.data[source], begin, end, end, table)
                value = _over(value, _norm(count)).reshape(-1, step) - LESS
                which = value.argmax(1)
                value = value[np.arange(len(long)), which]
                higher = value > best[long]
                best[long[higher]], stride[long[higher]], at[long[higher]] = value[higher], step, which[higher]
        if self.long.any():
            runs = np.concatenate([[0], np.cumsum(self.long)])
            some = np.flatnonzero(runs[self.end] > runs[self.start])
            inside = np.zeros(len(self.data) + 1, np.int64)
            inside[self.start[some]] += 1
            np.subtract.at(inside, self.end[some], 1)
            source = np.flatnonzero((np.cumsum(inside)[:-1] > 0) & ~self.long)
            end = np.cumsum(size[some] - (runs[self.end] - runs[self.start])[some])
            begin = np.append(0, end[:-1])
            value, _ = _sums(self.data[source], begin, end, end, table)
            value = _over(value, _norm(end - begin)) - LESS
            higher = value > best[some]
            best[some[higher]], stride[some[higher]] = value[higher], -1
        return best, stride, at

    def spelled(self, k: int, stride: int, at: int) -> str:
        if stride < 0:
            stretch = self.data[self.start[k] : self.end[k]][~self.long[self.start[k] : self.end[k]]]
        else:
            stretch = self.data[self.start[k] : self.pair[k]] if stride == 0 else self.data[self.start[k] + at : self.end[k] : stride]
        return stretch.tobytes().decode("latin-1")


def _over(value: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Values over norms; stretches without a subsequence have none.  Rounded, so that the order of addition decides no ties."""
    return np.where(norm > 0, np.round(value / np.maximum(norm, 1e-9), 8), -np.inf)


def _sums(data: np.ndarray, start: np.ndarray, end: np.ndarray, pair: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the subsequences inside each word, and over those from it into the next word up to ``pair``."""
    alone, across = np.zeros(len(start)), np.zeros(len(start))
    wide = bool((pair > end).any())
    for a, b in SPANS:
        if len(data) <= b:
            continue
        total = np.zeros(len(data) + 1)
        np.cumsum(table[_code(data, a, b)], out=total[1 : len(data) - b + 1])
        total[len(data) - b + 1 :] = total[len(data) - b]
        inside = np.maximum(start, end - b)
        alone += DECAY ** (b + 1) * (total[inside] - total[start])
        if wide:
            across += DECAY ** (b + 1) * (total[np.clip(pair - b, inside, end)] - total[inside])
    return alone, across


def subsequences(stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch number, code and normalised weight of each subsequence."""
    size = np.array([len(s) for s in stretches], np.int64)
    data = np.frombuffer("".join(stretches).encode("latin-1"), np.uint8)
    which, end, norm = np.repeat(np.arange(len(size)), size), np.cumsum(size), _norm(size)
    out = []
    for a, b in SPANS:
        code = _code(data, a, b) if len(data) > b else np.empty(0, np.int32)
        at = np.flatnonzero(np.arange(len(code)) + b < end[which[: len(code)]])
        out.append((which[at], code[at], DECAY ** (b + 1) / norm[which[at]]))
    word, code, weight = (np.concatenate(x) for x in zip(*out, strict=True))
    return word, code, weight


def train(landmarks: list[str], positive: Counter, negative: Counter, cost: float = COST) -> tuple[np.ndarray, float]:
    """The learned table of subsequences and the bias: a linear machine in the Nystroem space of the landmarks; a stretch counts once for each row that gave it."""
    word, code, weight = subsequences(landmarks)
    used, back = np.unique(code, return_inverse=True)
    table = np.zeros((len(used), len(landmarks)))  # kernel values with the landmarks are a stretch's weights times this
    np.add.at(table, (back, word), weight)
    number = np.full(CODES, -1, np.int32)
    number[used] = np.arange(len(used))

    def kernel(stretches: list[str]) -> np.ndarray:
        out = np.empty((len(stretches), len(landmarks)))
        for at in range(0, len(stretches), 256):
            part = stretches[at : at + 256]
            w, c, x = subsequences(part)
            known = number[c] >= 0
            dense = np.bincount(w[known] * len(used) + number[c[known]], x[known], len(part) * len(used))
            out[at : at + 256] = dense.reshape(len(part), -1) @ table
        return out

    among = kernel(landmarks)
    value, vector = np.linalg.eigh((among + among.T) / 2 + 1e-3 * np.eye(len(landmarks)))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    stretches = [*sorted(positive), *sorted(negative)]
    x = kernel(stretches) @ root
    x = np.column_stack([x, np.ones(len(x))])
    y = np.append(np.ones(len(positive)), -np.ones(len(negative)))
    c = cost * np.array([positive[w] for w in stretches[: len(positive)]] + [negative[w] for w in stretches[len(positive) :]], float)
    w, flat = np.zeros(x.shape[1]), np.eye(x.shape[1])
    flat[-1, -1] = 1e-6
    for _ in range(30):  # Newton on the squared hinge: least squares over the rows inside the margin
        inside = y * (x @ w) < 1
        rows, cost_of = x[inside], c[inside]
        new = np.linalg.solve(flat + (rows * cost_of[:, None]).T @ rows, rows.T @ (cost_of * y[inside]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    learned = np.zeros(CODES)
    learned[used] = table @ (root @ w[:-1])
    return learned, float(w[-1])


def row_difference(learned: DataFrame) -> np.ndarray:
    """For each subsequence the difference between the shares of toxic and of clean rows that have it, over its deviation if there were none.

    Rows are counted by Spark; one row per label and subsequence reaches the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        total, rows = np.zeros((2, CODES), np.int64), np.zeros(2, np.int64)
        for batch in small_batches(batches, limit=1 << 18):
            text, label = Sentences(batch.column("text")), batch.column("label").to_numpy()
            rows += np.bincount(label, minlength=2)
            word = np.repeat(np.arange(len(text.start)), text.end - text.start)
            have = []
            for a, b in SPANS:
                if len(text.data) > b:
                    code = _code(text.data, a, b)
                    at = np.flatnonzero(np.arange(len(code)) + b < text.pair[word[: len(code)]])
                    have.append(text.doc[word[at]] * CODES + code[at])
            doc, code = np.divmod(np.unique(np.concatenate(have)) if have else np.empty(0, np.int64), CODES)
            for k in (0, 1):
                total[k] += np.bincount(code[label[doc] == k], minlength=CODES)
        label, code = np.nonzero(total)
        columns = [pa.array([*label, 0, 1], pa.int32()), pa.array([*code, -1, -1], pa.int32()), pa.array([*total[label, code], *rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "code", "n"])

    have, rows = np.zeros((2, CODES)), np.ones(2)
    counts = learned.select("label", "text").mapInArrow(work, "label int, code int, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    for r in counts.toLocalIterator():
        if r["code"] < 0:
            rows[r["label"]] = max(1, r["n"])
        else:
            have[r["label"], r["code"]] = r["n"]
    both = (have.sum(0) + 1) / (rows.sum() + 2)
    return (have[1] / rows[1] - have[0] / rows[0]) / np.sqrt(both * (1 - both) * (1 / rows).sum())


def highest_stretches(learned: DataFrame, table: np.ndarray, bias: float, first: bool, words_only: bool) -> list[tuple[int, int, list[str]]]:
    """Label, key and stretches of each learning row: the highest of a toxic row; of a clean row that of each sentence within the margin (``first``: of its ``FIRST`` highest sentences)."""
    shared = learned.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in small_batches(batches, limit=1 << 18):
            text, label = Sentences(batch.column("text")), batch.column("label").to_numpy()
            out: list[list[str]] = [[] for _ in range(batch.num_rows)]
            if len(text.start):
                value, stride, at = text.values(shared.value, words_only)
                value = value + bias
                by = np.lexsort([-value, text.sentence])  # stable: of equals the first in the text
                by = by[np.append(True, text.sentence[by][1:] != text.sentence[by][:-1])]
                by = by[np.lexsort([-value[by], text.doc[by]])]
                edge = np.searchsorted(text.doc[by], np.arange(batch.num_rows + 1))
                for d, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    limit = 1 if label[d] else FIRST if first else b - a
                    some = [k for k in by[a : min(b, a + limit)] if np.isfinite(value[k]) and (label[d] or first or value[k] > -1)]
                    out[d] = [text.spelled(k, stride[k], at[k]) for k in some]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("key"), pa.array(out, pa.list_(pa.string()))], names=["label", "key", "stretches"])

    rows = learned.select("label", "key", "text").mapInArrow(work, "label int, key long, stretches array<string>").collect()
    return sorted((r["label"], r["key"], r["stretches"]) for r in rows if r["stretches"])


def sample_landmarks(rows: list[tuple[int, int, list[str]]], limit: int) -> list[str]:
    """A sample by hash of the sentences' stretches, half of each label."""
    out: dict[str, None] = {}
    for label in (1, 0):
        dealt = sorted((zlib.crc32(f"{key} {s}".encode()), s) for k, key, stretches in rows if k == label for s in stretches)
        out |= dict.fromkeys(list(dict.fromkeys(s for _, s in dealt))[: limit // 2])
    return list(out)


def fit(learned: DataFrame, word_rounds: int = WORD_ROUNDS) -> tuple[np.ndarray, float, float]:
    """Table, bias and scale learned from rows with label, key and text; scale 0 if there are no toxic rows with words."""
    table, bias = row_difference(learned), 0.0
    negative: dict[tuple[int, str], None] = {}  # each stretch once for a row
    learnt = False
    for step in range(ROUNDS):
        rows = highest_stretches(learned, table, bias, step == 0, step < word_rounds)
        witness = Counter(s[0] for label, _, s in rows if label == 1)
        if not witness:
            break
        before = len(negative)
        negative |= dict.fromkeys((key, s) for label, key, stretches in rows if label == 0 for s in stretches)
        if step > word_rounds and len(negative) == before:
            break
        clean = [(0, key, [s]) for key, s in negative]
        table, bias = train(sample_landmarks([r for r in rows if r[0]] + clean, LANDMARKS), witness, Counter(s for _, s in negative))
        learnt = True
    return (table, bias, 4.0) if learnt else (np.zeros(CODES), -1.0, 0.0)


def score_documents(column: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """The highest value of each text; -1 (as far as a clean sentence) for texts without any."""
    text = Sentences(column)
    out = np.full(text.texts, -np.inf)
    if len(text.start):
        np.maximum.at(out, text.doc, text.values(table)[0] + bias)
    return np.where(np.isfinite(out), out, -1.0)


def calibrate(learned: DataFrame, table: np.ndarray, bias: float, scale: float, cut: float) -> tuple[float, float]:
    """The shift that puts the threshold with the highest correlation of call and label on the learning rows at ``cut``, and that correlation.

    Calling every row toxic has none, so it is never chosen over a threshold that tells rows apart.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 19):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(score_documents(batch.column("text"), table, bias))], names=["label", "value"])

    got = learned.select("label", "text").mapInArrow(work, "label int, value double").toPandas().sort_values("value", kind="stable")
    value, y = got["value"].to_numpy(), got["label"].to_numpy(float)
    first = np.flatnonzero(np.append(True, value[1:] > value[:-1]))  # thresholds between unlike values only
    toxic, called = np.append(np.cumsum(y[::-1])[::-1], 0), len(y) - np.arange(len(y) + 1)
    spread = np.sqrt(y.sum() * (1 - y).sum() * called * (len(y) - called))
    gain = np.append(((len(y) * toxic - called * y.sum()) / np.maximum(spread, 1))[first], 0)
    best = int(np.argmax(gain))
    at = int(first[best]) if best < len(first) else len(value)
    threshold = (value[at] + value[max(0, at - 1)]) / 2 if at < len(value) else value[-1] + 1
    return float(np.log(cut / (1 - cut)) - scale * threshold), float(gain[best])


def score_toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= cut) for each row of ``docs``.

    ``labels`` has doc_id and toxic (1 or 0; other values and nulls are not
    learned from).  Learns only from labelled rows that are not held out;
    without toxic rows to learn from, nothing is toxic (score 0).  Of several
    labels of one doc_id or one text the highest counts.  Null texts count as
    empty; they are scored too.  Repeated rows get a row each, an empty
    table none; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    learned = labelled_texts(docs, labels, "toxic", rows, "toxicity", each=True)
    table, bias, scale = fit(learned)
    shift, told = calibrate(learned, table, bias, scale, cut) if scale else (-1e3, 1.0)
    if told < TOLD:
        other = fit(learned, 0)
        by, better = calibrate(learned, *other, cut)
        if better > told + BETTER:
            (table, bias, scale), shift = other, by
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 19):
            value = score_documents(batch.column("text"), shared.value, bias)
            score = 1 / (1 + np.exp(-np.clip(scale * value + shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(work, f"{kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
