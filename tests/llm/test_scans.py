"""Licences, decontamination, top-k, tokens and the store against brute force."""

import hashlib
import random
import re
import textwrap
import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

from portfolia.llm import bpe, decontaminate, license, token_store, topk
from portfolia.llm.common import scratch_path
from portfolia.llm.queries import OP4_SQL, OP10_SQL
from tests.llm.conftest import make_docs, prose


def duck(sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    return sorted(con.execute(sql).fetchall(), key=str)


def test_license_scan(spark, odd_texts):
    texts = [*odd_texts, "Text.\nReleased under the MIT License.\nmore", "Licensed under the Apache license version 2.0", "this work is licensed under CC BY 4.0. All rights reserved.", license.TEMPLATES["MIT"][1], "released under the terms"]
    docs = make_docs(spark, texts)
    got = license.license_scan(docs).selectExpr("doc_id", "array_join(licenses, ',') as licenses", "best", "dice")
    assert sorted(map(tuple, got.collect()), key=str) == duck(license.oracle(), documents=docs)
    best = {r.doc_id: r.best for r in got.collect()}
    n = len(odd_texts)
    assert [best[n + k] for k in range(5)] == ["MIT", "Apache-2.0", "Proprietary", "MIT", None]
    assert not any(best[k] for k in range(n))
    assert license.license_scan(make_docs(spark, [])).count() == 0
    assert license.license_scan(docs, {}).where("best is not null").count() == 0


def test_license_sql_finds_runs(spark):
    wrap = lambda text, mark: mark.join(textwrap.wrap(text, 40))
    own = [text for texts in license.TEMPLATES.values() for text in texts]
    texts = [wrap(t, mark) for t in own for mark in ("\n", "\r\n", "\n# ")] + [wrap(t, "\n\n") for t in own] + [wrap(t, "\n--\n") for t in own]
    texts += ["SPDX-License-Identifier: Zlib", "SPDX-License-Identifier:\nMIT", "Licensed under.| the Apache License; Version\u00b6 2.0.", "a. b.\n\n \nreleased under\nthe MIT. License", "\n\nReleased\nunder\n\n"]
    draw = random.Random(5)
    some = "released under the mit license bsd 2 clause all rights reserved permission".split()
    texts += ["".join(draw.choice(some) + draw.choice([" ", " ", "\n", ". ", ": ", "\n \n", "|", "; "]) for _ in range(40)) for _ in range(300)]
    docs = make_docs(spark, texts)
    got = license.license_scan(docs).selectExpr("doc_id", "array_join(licenses, ',')", "best", "dice").collect()
    assert sum(r.best is not None for r in got[: 3 * len(own)]) >= 2 * len(own)
    assert sorted(map(tuple, got), key=str) == duck(license.oracle(), documents=docs)


def test_size_bounds_lose_no_match(spark):
    draw = random.Random(1)
    words = "permission is hereby granted to use copy and modify this".split()
    texts = [" ".join(draw.choices(words, k=draw.randrange(1, 14))) for _ in range(200)]
    templates = {"A": ["permission is hereby granted to use and copy"], "B": ["to modify this"], "C": ["use this"]}
    got = {r.doc_id: r.licenses for r in license.license_scan(make_docs(spark, texts), templates, 0.6).collect()}
    for k, text in enumerate(texts):
        g = set(license.bigrams_of(text))
        want = sorted({n for n, t in license.template_rows(templates) if 2 * len(g & set(t)) / (len(g) + len(t)) >= 0.6})
        assert got[k] == want


def test_bounds_keep_what_just_reaches_the_threshold(spark):
    shared = lambda n, k, own: " ".join(f"w{i}" for i in range(k + 1)) + "".join(f" {own}{i}" for i in range(n - k))
    sizes = [(4, 6, 4), (3, 2, 2), (6, 4, 4), (6, 9, 6), (8, 12, 8), (2, 3, 2)]
    for m, n, k in sizes:
        rows = license.license_scan(make_docs(spark, [shared(n, k, "x"), shared(n + 1, k, "x")]), {"A": [shared(m, k, "y")]}).collect()
        assert {r.doc_id: r.dice for r in rows} == {0: 0.8, 1: None}
    docs = make_docs(spark, ["This is released under the MIT License."])
    got = license.license_scan(docs).selectExpr("doc_id", "array_join(licenses, ',')", "best", "dice")
    assert [tuple(r) for r in got.collect()] == duck(license.oracle(), documents=docs) == [(0, "MIT", "MIT", 0.8)]


def wrapped(text, width, start=""):
    lines = [""]
    for word in text.split():
        if lines[-1] and len(lines[-1]) + len(word) >= width:
            lines.append("")
        lines[-1] = f"{lines[-1]} {word}".strip()
    return "\n".join(start + x for x in lines)


def test_every_template_is_found_by_its_own_text(spark):
    own = [(name, text) for name, texts in license.TEMPLATES.items() for text in texts]
    for shape in (str, lambda t: wrapped(t, 72), lambda t: wrapped(t, 30, " * ").replace("\n", "\r\n"), lambda t: f"Some words here. {prose(5, 4)}\nfor {prose(6, 3)}. {wrapped(t, 40)}. {prose(7, 4)}\n\n{prose(8, 9)}"):
        rows = {r.doc_id: r for r in license.license_scan(make_docs(spark, [shape(t) for _, t in own])).collect()}
        for k, (name, text) in enumerate(own):
            assert rows[k].best == name, (name, text)
            assert "SPDX" not in text or rows[k].licenses == [name]
    # A head that all SPDX lines share names none, and blank lines end a notice.
    odd = ["SPDX-License-Identifier: Zlib", "// SPDX-License-Identifier:\n", "All\n\nrights\n\nreserved", "All\n*\nrights reserved"]
    assert not any(r.licenses for r in license.license_scan(make_docs(spark, odd)).collect())


def test_runs_equal_brute_force(spark):
    draw = random.Random(3)
    words = "permission is hereby granted to use copy and modify this".split()
    texts = ["".join(draw.choice(words) + draw.choice([" ", " ", " ", "\n", "\r\n", ". ", ": ", "\n\n", "\n#\n", "|", " \u00b6 "]) for _ in range(draw.randrange(1, 40))) for _ in range(150)]
    templates = {"A": ["permission is hereby granted to: use and copy"], "B": ["to modify this"], "C": ["use this"]}
    got = {r.doc_id: r.licenses for r in license.license_scan(make_docs(spark, texts), templates, 0.6).collect()}
    for k, text in enumerate(texts):
        want = set()
        for part in re.split(r"(?:\r\n|\n)[^a-z\n]*\n[^a-z]*", text):
            pieces = [p for p in re.split(license.PIECE_END, part) if re.search("[a-z]", p)]
            for g in (set(license.bigrams_of(" ".join(pieces[a:b]))) for a in range(len(pieces)) for b in range(a + 1, len(pieces) + 1)):
                want |= {n for n, t in license.template_rows(templates) if 2 * len(g & set(t)) / (len(g) + len(t)) >= 0.6}
        assert got[k] == sorted(want), text


def slow_hits(text, items, width):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        own = split(t)
        n = min(width, len(own))
        for a in range(len(own) - n + 1 if n else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == own[a : a + n]:
                    hit.update(range(b, b + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block", [400_000, 40])
def test_decontamination(spark, odd_texts, block):
    items = [(k, prose(50 + k, 8 + 3 * k)) for k in range(12)] + [(3, "one two"), (None, prose(70, 20)), (20, None), (21, "--"), (22, "Größe"), (11, prose(61, 41))]
    parts = [t for _, t in items if t]
    draw = random.Random(2)
    texts = [*odd_texts[:-2], None]
    texts += [" , ".join(draw.choice([prose(draw.randrange(999), 9), draw.choice(parts).upper(), " ".join(draw.choice(parts).split()[:15])]) for _ in range(4)) for _ in range(40)]
    docs, bench = make_docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.report(docs, bench, block_words=block).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == {k: slow_hits(t, items, 13) for k, t in enumerate(texts)}
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in rows)
    if block > 1000:
        assert sorted(map(tuple, rows), key=str) == duck(OP4_SQL, documents=docs, benchmark=bench)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows if not r.contaminated}
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.scan(docs.limit(0), bench).count() == 0


def test_top_k(spark):
    draw = random.Random(4)
    rows = [(k, [draw.uniform(-1, 1) for _ in range(24)], k) for k in range(300)]
    rows += [(300, None, 1), (301, [float("nan")] * 24, 1), (302, [1.0, None], 1), (303, [float("inf")], 1), (304, [], 1), (305, [0.5, 0.5], 1), (None, [1.0] * 24, 1), (350, rows[7][1], 1), (400, rows[7][1], 1), (7, rows[8][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    queries = table.where("vec_id % 50 = 0")
    got = sorted(map(tuple, topk.top_k(table, queries).collect()))
    whole = {}
    for k, v, _ in spark.createDataFrame(rows, table.schema).collect():
        if k is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v):
            whole.setdefault(k, []).append([int(256 * x // 1) for x in v])
    want = []
    for q in whole:
        if q % 50 == 0:
            for one in whole[q]:
                scores = sorted((-sum(a * b for a, b in zip(one, v)), k) for k, vs in whole.items() if k != q for v in vs)
                want += [(q, r, k, -s) for r, (s, k) in enumerate(scores[:5], 1)]
    assert got == sorted(want)
    assert topk.top_k(table.limit(0), queries).count() == 0 and topk.top_k(table, queries.limit(0)).count() == 0
    few = table.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    plain = table.where("vec_id < 200")
    assert sorted(map(tuple, topk.top_k(plain, plain.where("vec_id % 50 = 0")).collect()), key=str) == sorted(duck(OP10_SQL, embeddings=plain), key=str)


def test_top_k_of_many_shards_sends_no_pairs_and_broadcasts_nothing(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "PART", 300)  # a few blocks
    draw = random.Random(6)
    kinds = [[draw.randrange(-200, 200) / 256 for _ in range(12)] for _ in range(40)]
    rows = {k: kinds[draw.randrange(40)] if k % 3 else kinds[0] for k in draw.sample(range(2000), 700)}  # many ties
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").repartition(3)
    asked = table.where("vec_id % 20 = 0")
    found = topk.top_k(table, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 1  # that of the k best
    want = []
    for q in (k for k in rows if k % 20 == 0):
        scores = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(rows[q], v)), k) for k, v in rows.items() if k != q)
        want += [(q, r, k, -s) for r, (s, k) in enumerate(scores[:5], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("kind", ["int", "string", "smallint"])
def test_top_k_of_other_ids(spark, kind):
    draw = random.Random(5)
    table = spark.createDataFrame([(k, [draw.uniform(-1, 1) for _ in range(8)]) for k in range(40)], "vec_id long, embedding array<double>")
    cast = table.withColumn("vec_id", table["vec_id"].cast(kind))
    want = {(str(q), r): (str(v), s) for q, r, v, s in map(tuple, topk.top_k(table, table.where("vec_id % 10 = 0")).collect())}
    got = topk.top_k(cast, cast.where("vec_id % 10 = 0"))
    assert dict(got.dtypes)["vec_id"] == kind and {(str(q), r): (str(v), s) for q, r, v, s in map(tuple, got.collect())} == want


def test_essential_components_are_chosen_by_bounds():
    import numpy as np

    draw = np.random.default_rng(3)
    vectors, query = draw.integers(-20, 20, (500, 32)), draw.integers(-20, 20, 32)
    vectors[:, :4] *= 40  # few components decide
    shard, alive = topk.Shard(vectors, 20), np.arange(500)
    score = vectors @ query
    best = np.lexsort([alive, -score])[:5]
    read = []
    for least in (None, int(score[best[4]]) - 50, int(score[best[4]])):
        got, place, postings = shard.best(query, alive, 5, least)
        assert place.tolist() == best.tolist() and got.tolist() == score[best].tolist()
        read.append(postings)
    assert read[0] >= 32 * 500 * 0.9 and read[2] <= read[1] < read[0] / 3
    assert len(shard.best(query, alive, 5, int(score.max()) + 1)[0]) == 0  # no row of this shard can reach it


ODD = ["<|endoftext|> Don't 'll it's 12345 a1b2", "é ÉÀ ǅ ﬁ  x y\u0085z", "x" * 300, "\x00\x01 �", "İstanbul ΑΣ ΑΣ.", "ạ́ ̣́", "naïve... (of) l'été!!", "I\tII\nIII\r\n IV", "<|startoftext|>a<|endoftext|>", " ", "🙂🙂 👩‍👩‍👧"]


def test_bpe_equals_the_library(spark, odd_texts):
    texts = [*odd_texts, *ODD, *[prose(k, 200) + " " + prose(1, 300) for k in range(20)]]
    library = Tokenizer.from_file(bpe.default_tokenizer())
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in bpe.encode_decode(make_docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k].ids == ids
        assert got[k].decoded == library.decode(ids, skip_special_tokens=False)


def test_store_round_trip(spark, odd_texts):
    texts = [*odd_texts, *ODD, *[prose(k % 3, 900) + prose(k, 5) for k in range(12)]]
    ids = list(range(100, 100 + 2 * len(texts), 2))
    random.Random(1).shuffle(ids)
    docs, path = make_docs(spark, texts, ids), scratch_path(spark, "test-store")
    token_store.write_store(docs, path)
    library = Tokenizer.from_file(bpe.default_tokenizer())
    library.no_truncation()
    start, want = 0, {}
    for i, t in sorted(zip(ids, texts, strict=True)):
        own = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)), own)
        start += len(own)
    rows = token_store.read_digests(spark, path).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == {i: w[:3] for i, w in want.items()}
    assert all(r.verified for r in rows)
    assert {r.doc_id: r.ids for r in token_store.read_documents(spark, path).collect()} == {i: w[3] for i, w in want.items()}
    chunks = token_store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count() and chunks.where("not intact").count() == 0
    assert sum(r.n for r in chunks.collect()) < start  # shared chunks are stored once


def thue_morse(n, a="a", b="b"):
    """Two unlike words that polynomial hashes modulo a power of two don't tell apart."""
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_collide_under_polynomial_hashes(spark):
    pairs = [w for n in (10, 11, 12) for w in thue_morse(n)]
    docs = make_docs(spark, pairs)
    library = Tokenizer.from_file(bpe.default_tokenizer())
    library.no_truncation()
    want = {k: library.encode(t, add_special_tokens=False).ids for k, t in enumerate(pairs)}
    assert {r.doc_id: r.ids for r in bpe.encode_decode(docs).collect()} == want
    path = scratch_path(spark, "test-store")
    token_store.write_store(docs, path)
    assert {r.doc_id: r.ids for r in token_store.read_documents(spark, path).collect()} == {k: [*x, 2] for k, x in want.items()}
    bench = spark.createDataFrame([(1, pairs[0])], "item_id long, text string")
    assert [r.n_hit for r in sorted(decontaminate.report(docs, bench).collect())] == [1, 0, 0, 0, 0, 0]


def test_words_are_told_apart_when_their_hashes_are_not(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from portfolia.llm import common

    texts = [prose(k, 60) for k in range(20)] + ["x" * 20 + " " + "y" * 300]
    want = bpe.Encoder(bpe.default_tokenizer()).encode_all(texts)
    for module in (common, bpe, decontaminate):
        monkeypatch.setattr(module, "spread", lambda low, high: (low ^ high) % np.uint64(5))
    words = common.Words(pa.array(texts))
    first, back = common.distinct(*words.exact())
    spelled = [w for t in texts for w in t.split()]
    assert [spelled[first[k]] for k in back] == spelled and len(first) == len(set(spelled))
    enc = bpe.Encoder(bpe.default_tokenizer())
    for _ in range(2):
        assert [x.tolist() for x in enc.encode_all(texts)] == [x.tolist() for x in want]


def test_tokenizer_whose_words_cross_white_space(spark, odd_texts):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in bpe.encode_decode(make_docs(spark, [*odd_texts, *ODD]), path).collect()}
    assert got == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate([*odd_texts, *ODD])}
    assert bpe.encode_decode(make_docs(spark, [])).count() == 0


def test_store_with_null_and_repeated_ids(spark):
    docs, path = make_docs(spark, [prose(1, 20), prose(2, 20), None, prose(3, 20), prose(3, 20)], [None, 7, 7, None, 2]), scratch_path(spark, "test-store")
    token_store.write_store(docs, path)
    rows = sorted(token_store.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 2, 7, 7] and all(r.verified for r in rows)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(5)]


def test_store_of_nothing(spark):
    path = scratch_path(spark, "test-store")
    token_store.write_store(make_docs(spark, []), path)
    assert token_store.read_digests(spark, path).count() == 0


@pytest.mark.parametrize(("value", "fails"), [(1e6, False), (-4e6, False), (1e10, True), (-1e30, True)])
def test_top_k_refuses_scores_beyond_64_bits(spark, value, fails):
    table = spark.createDataFrame([(1, [value, 1.0]), (2, [value, 0.5]), (3, [0.25, 0.0])], "vec_id long, embedding array<double>")
    if fails:
        with pytest.raises(Exception, match="may not fit in 64 bits"):
            topk.top_k(table, table.where("vec_id = 1"), 1).collect()
    else:
        x = int(256 * value)
        found = topk.top_k(table, table.where("vec_id = 1"), 1).collect()
        assert [tuple(r) for r in found] == [(1, 1, 2, x * x + 256 * 128)]
