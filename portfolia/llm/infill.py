"""Fill-in-middle transformation of texts (operator 12).

A text's bytes become big integers, one bit for a byte: ``bytes.translate``
marks the bytes of a class, shifted boolean operations mark where code points
begin, ``bit_count`` counts them, and the place of a cut is the byte of the
ranked bit that is found by halving the mask again and again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfolia.llm.common import bound_batches, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]


def _class(low: int, high: int) -> bytes:
    """A table that makes ``1`` of the bytes from ``low`` to ``high`` and ``0`` of all others."""
    return bytes(0x31 if low <= b <= high else 0x30 for b in range(256))


#: Bytes that continue a code point, and those that begin one of two, three and four bytes or more of them.
_CONTINUES, _LEADS_2, _LEADS_3, _LEADS_4 = _class(0x80, 0xBF), _class(0xC2, 0xF4), _class(0xE0, 0xF4), _class(0xF0, 0xF4)


def mask(reverse: bytes, table: bytes) -> int:
    """The bytes of a class as the bits of an integer; the bytes are given last first, so that bit k is byte k."""
    return int(reverse.translate(table) or b"0", 2)


def starts(raw: bytes) -> int:
    """The bytes that begin a code point.  A byte that continues nothing counts as one of its own, so any bytes can be cut."""
    reverse = raw[::-1]
    continues = mask(reverse, _CONTINUES)
    if continues:
        third = mask(reverse, _LEADS_3)
        expected = mask(reverse, _LEADS_2) << 1 | third << 2
        if third:
            expected |= mask(reverse, _LEADS_4) << 3
        continues &= expected
    return (1 << len(raw)) - 1 ^ continues


def select(bits: int, rank: int) -> int:
    """Place of the set bit that has ``rank`` set bits below it; there must be one."""
    at, size = 0, bits.bit_length()
    while size > 1:
        half = size >> 1
        low = bits & (1 << half) - 1
        below = low.bit_count()
        if rank < below:
            bits, size = low, half
        else:
            bits, size, rank, at = bits >> half, size - half, rank - below, at + half
    return at


def draws(doc_id) -> list[int]:
    """The four numbers that decide on a document: 32 bits each of the SHA-256 of ``1:`` and its id (nothing for a null id)."""
    digest = hashlib.sha256(b"1:" if doc_id is None else f"1:{doc_id}".encode()).digest()
    return [int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12)]


def rearrange(raw: bytes, doc_id) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points of a text, its form, the code points of prefix and middle (None if plain), and the output."""
    bits = starts(raw)
    n = bits.bit_count()
    h1, h2, h3, h4 = draws(doc_id)
    if not raw or h3 % 100 >= 90 or any(m in raw for m in _MARKS):
        return n, "plain", None, None, raw
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (select(bits, k) if k < n else len(raw) for k in (a, b))
    prefix, middle, suffix = raw[:first], raw[first:second], raw[second:]
    p, s, m = _MARKS
    if h4 % 100 < 20:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        raw = batch.column("text").cast(pa.binary()).to_pylist()
        n, form, prefix, middle, output = zip(*map(rearrange, [r or b"" for r in raw], batch.column("doc_id").to_pylist()), strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n, pa.int64()),
                pa.array(form, pa.string()),
                pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()),
                pa.array(output, pa.binary()).view(pa.string()),
            ],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, n, form, prefix_chars, middle_chars and the rearranged text ``output``.

    Null and empty texts are empty and plain, with n 0.  The cuts depend on id
    and length alone: repeated rows have equal outputs, null ids share one
    draw.  Texts of any length are cut as a whole, in time proportional to
    their bytes.  Bytes that are not UTF-8 are units of their own.  An empty
    table gives none; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_transform, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that ``output`` was made of; texts with marks of their own are plain, so each mark is there once."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(mark: str, end: str | None) -> Column:
        after = F.split_part(output, F.lit(mark), F.lit(2))
        return F.split_part(after, F.lit(end), F.lit(1)) if end else after

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """The columns of ``fill_in_middle`` with the SHA-256 of the output and of the text restored from it in place of the output."""
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (
  SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
pieces AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1, n - b) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""
