"""Merkle manifest, fill-in-middle and exact dedup against brute force and their SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from portfolia.llm import exact_dedup, infill, merkle
from portfolia.llm.common import scratch_path, stage
from tests.llm.conftest import make_docs, prose

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, tree string, block int, items string, n int, form string, digest string, row string"


def duck(sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    return sorted(con.execute(sql).fetchall(), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", 1, "i", 2, "f", "d", "r") for r in rows], SCHEMA)


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, at, other):
    """Root of ``nodes``, the siblings of node ``at``, and the root with ``other`` in its place."""
    proof = []
    while len(nodes) > 1:
        pair = [nodes[k] for k in range(at - at % 2, min(at - at % 2 + 2, len(nodes)))]
        proof += [p for k, p in enumerate(pair) if k != at % 2]
        pair[at % 2] = other
        nodes, at, other = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)], at // 2, sha("".join(pair))
    return nodes[0], proof, other


def brute_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs]
    subroots = [climb([leaf(r) for r in tree], 0, "")[0] for tree in trees]
    out = []
    for t, tree in enumerate(trees):
        for k, r in enumerate(tree):
            tampered = r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            other = leaf((*r[:3], r[3] + 1, r[4])) if tampered else leaf(r)
            subroot, proof, found = climb([leaf(x) for x in tree], k, other)
            root, above, found = climb(subroots, t, found)
            out.append((r[0], leaf(r), subroot, root, sha("".join(proof + above)), found, found == root))
    return sorted(out, key=str)


def prove(spark, docs):
    path = scratch_path(spark, "manifest")
    return merkle.proofs(spark, path, *merkle.write_manifest(docs, path, merkle.tampered_n_chars()))


def manifest_rows(n, langs):
    draw = random.Random(n)
    rows = [(k, draw.choice(["web", None, "größe"]), draw.choice(langs), draw.choice([None, k, -k]), prose(k, k % 9)) for k in range(n)]
    return rows + rows[: n // 5] + [(None, None, None, None, None)] * 3 + [(None, "s", langs[0], 5, ""), (n, "s", langs[0], 5, "日本語 🤦 \n"), (7, "s", langs[0], (1 << 63) - 1, None)]


@pytest.mark.parametrize(("n", "langs"), [(300, ["en", "de", "日本"]), (150, ["en"]), (90, [f"l{k:03}" for k in range(80)])])
def test_manifest(spark, n, langs):
    rows = manifest_rows(n, langs)
    docs = docs_of(spark, rows)
    got = sorted(map(tuple, prove(spark, docs).collect()), key=str)
    assert got == brute_manifest(rows) == duck(merkle.ORACLE, documents=docs)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_few_rows(spark):
    assert prove(spark, docs_of(spark, [])).count() == 0
    rows = [(1, "s", "en", 3, "abc")]
    assert sorted(map(tuple, prove(spark, docs_of(spark, rows)).collect())) == brute_manifest(rows)
    long = [(2, "s", "en", 3, prose(4, 60000)), (3, "s", None, 3, "x" * 100_000)]
    assert sorted(map(tuple, prove(spark, docs_of(spark, long)).collect()), key=str) == brute_manifest(long)


def test_manifest_without_claims_verifies_all(spark):
    path = scratch_path(spark, "manifest")
    docs = docs_of(spark, manifest_rows(70, ["en", "de"]))
    got = merkle.proofs(spark, path, *merkle.write_manifest(docs, path)).collect()
    assert len(got) == docs.count() and all(r.verified and r.folded_root == r.root for r in got)


def brute_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd_texts):
    marks = ["a <P> b", "<S>", "x<M>", "<P", "<<>>", "<", "<P <S <M", "P>S>M>", "\x00\x00<"]
    scripts = ["é" * 50, "日本語" * 40, "🤦🏼‍♂️" * 30, "aé日🤦" * 200, "ࠀ￿\U00010000\U0010ffff", "퟿"]
    texts = (odd_texts + marks * 12 + scripts * 20) * 2
    docs = make_docs(spark, texts, [*range(len(texts) - 3), None, None, 0])
    rows = infill.fill_in_middle(docs)
    want = sorted((brute_infill(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sorted(map(tuple, rows.collect()), key=str) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    got = sorted(map(tuple, infill.digests(rows).collect()), key=str)
    assert got == duck(infill.ORACLE, documents=docs)
    back = rows.select("doc_id", infill.restored().alias("text")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert infill.fill_in_middle(make_docs(spark, [])).count() == 0


def test_masks_and_ranked_bits():
    draw = random.Random(3)
    for n in (1, 2, 63, 64, 65, 1000):
        bits = [draw.random() < 0.4 for _ in range(n)]
        bits[-1] = True
        number = sum(b << k for k, b in enumerate(bits))
        assert [infill.select(number, r) for r in range(sum(bits))] == [k for k, b in enumerate(bits) if b]
    for _ in range(200):
        text = "".join(draw.choice("a\x7f\x80éß日ࠀ￿🤦\U0010ffff") for _ in range(draw.randrange(40)))
        at, want = 0, 0
        for c in text:
            want |= 1 << at
            at += len(c.encode())
        assert infill.starts(text.encode()) == want
    for _ in range(200):  # any bytes: every byte is in exactly one unit, and a cut anywhere can be undone
        raw = bytes(draw.choice(b"a\x80\xbf\xc3\xe3\xf0\xff") for _ in range(draw.randrange(1, 30)))
        assert infill.starts(raw) & 1
        n, form, a, b, out = infill.rearrange(raw, draw.randrange(1000))
        assert len(out) == len(raw) + (9 if form != "plain" else 0) and n <= len(raw)


def test_fill_in_middle_of_a_very_long_text():
    text = ("aé日🤦" * 2_000_000).encode()
    n, form, a, b, out = infill.rearrange(text, 2)
    assert n == 8_000_000 and (form, a, b) == brute_infill(2, text.decode())[2:5] and out.decode() == brute_infill(2, text.decode())[5]


def key(k):
    return hashlib.sha256(str(k).encode()).digest()


def test_cuckoo_index_is_exact():
    draw, index, live = random.Random(1), exact_dedup.CuckooIndex(1), {}
    for turn in range(30_000):
        k = draw.randrange(6000)
        if draw.random() < 0.3:
            assert index.delete(key(k)) == (live.pop(k, None) is not None)
        else:
            index.merge(key(k), 1, (turn % 100, turn), 1)
            old = live.get(k, ((1000, 0), 0))
            live[k] = (min(old[0], (turn % 100, turn)), old[1] + 1)
        assert index.size == len(live)
    assert index.resized > 3
    assert {e[0]: e[2:] for e in index.entries()} == {key(k): v for k, v in live.items()}
    assert all((index.find(key(k)) >= 0) == (k in live) for k in range(7000))


def test_cuckoo_index_verifies_equal_fingerprints():
    """Keys of equal fingerprint and first bits are told apart by their content, and overflow ends in a larger table."""
    index, same = exact_dedup.CuckooIndex(4), [bytes([k]) + bytes(23) + b"\x01\x02" + bytes([0, 0, 0, 0, k >> 4, k & 15]) for k in range(160)]
    for n, digest in enumerate(same):
        index.merge(digest, 1, (n, n), 1)
    assert index.resized and all(index.content[index.find(d)][2] == (n, n) for n, d in enumerate(same))
    assert all(index.delete(d) for d in same[::2]) and [index.find(d) >= 0 for d in same] == [False, True] * 80
    with pytest.raises(ValueError, match="one SHA-256"):
        index.merge(same[1], 2, (0, 0), 1)


def brute_groups(docs):
    rows = [(r.doc_id, re.sub("[ \t-\r]+", " ", r.text or "")) for r in docs.collect()]
    ids, seen, out = {}, set(), []
    for doc_id, text in rows:
        ids.setdefault(text, []).append(doc_id)
    for doc_id, text in rows:
        keep = min((i for i in ids[text] if i is not None), default=None)
        out.append((doc_id, keep, len(ids[text]), doc_id == keep and text not in seen, sha(text)))
        if doc_id == keep:
            seen.add(text)
    return sorted(out, key=str)


def test_exact_dedup(spark, odd_texts, monkeypatch):
    texts = [*odd_texts, " a  b", "\ta\x0b\x0c b", "a b", "a b", "A b", "a b ", " ", "\r\n", *["copy"] * 300, *[f"own {k % 90}" for k in range(200)]]
    ids = [*range(len(texts) - 6), None, None, 3, 3, 3, 4]
    random.Random(2).shuffle(ids)
    docs = make_docs(spark, texts, ids).repartition(7)
    want = brute_groups(docs)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=str) == want
    monkeypatch.setattr(exact_dedup, "FREQUENT", 4)  # frequent keys by broadcast, all others by a shuffle
    monkeypatch.setattr(exact_dedup, "HELD", 20)
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 16)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=str) == want
    assert exact_dedup.exact_duplicates(make_docs(spark, [])).count() == 0
    plain = make_docs(spark, texts)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(plain).collect()), key=str) == duck(exact_dedup.ORACLE, documents=plain)


def test_exact_index_over_time(spark):
    """Texts inserted in two batches, with some deleted between them."""
    rows = [exact_dedup.keyed(make_docs(spark, texts, ids)) for texts, ids in [(["a", "b", "b", None], [5, 6, 2, 9]), (["b", " ", "zz"], [0, 0, 0]), (["a", "b", "c", ""], [1, 3, None, 9])]]
    first = stage(exact_dedup.update(None, rows[0]))
    second = stage(exact_dedup.update(first, rows[2], deleted=rows[1]))

    def found(entries):
        return {(r.digest.hex(), r.keep_id, r.n) for r in entries.collect()}

    assert found(first) == {(sha("a"), 5, 1), (sha("b"), 2, 2), (sha(""), 9, 1)}
    assert found(second) == {(sha("a"), 1, 2), (sha("b"), 3, 1), (sha("c"), None, 1), (sha(""), 9, 2)}
    entry = {r.digest.hex(): r.keep_row for r in second.collect()}
    assert entry[sha("")] == -1  # the stored row stays before an inserted one of equal id
    assert exact_dedup.update(second, deleted=rows[2]).count() == 0
