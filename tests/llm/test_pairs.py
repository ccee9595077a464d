"""Near-duplicates, repeated passages and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from portfolia.llm import simhash, suffix
from portfolia.llm.components import connected_components
from tests.llm.conftest import make_docs, prose
from tests.llm.test_scans import duck, thue_morse


def roots(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*links, (None, 3), (5, None)], "a long, b long")).collect()}
    want = roots(400, links)
    assert got == {x: want[x] for x in {e for a, b in links if a != b for e in (a, b)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [3, 2])
def test_fingerprint_links_match_all_pairs(spark, limit):
    draw = random.Random(limit)
    fps = {draw.getrandbits(64) for _ in range(300)} | {0}
    for x in list(fps)[:60]:
        for _ in range(4):
            for b in draw.sample(range(64), draw.randrange(1, 5)):
                x ^= 1 << b
            fps.add(x)
    centre = draw.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in range(a)}  # one dense group
    fps = sorted(fps)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= limit]
    want = roots(len(fps), links)
    table = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    for bucket in (2000, 20):  # the second splits buckets
        edges = [(fps.index(a % 2**64), fps.index(b % 2**64)) for a, b in simhash.close_links(table, limit, bucket).collect()]
        assert roots(len(fps), edges) == want
        assert len(edges) < len(links)


def test_near_duplicates(spark, odd_texts):
    base = prose(5, 400).split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (3, 200, 390)]
    texts = [*odd_texts, " ".join(base), *near, prose(6, 400), " ".join(base).upper()]
    ids = [*range(5, 5 + len(texts) - 1), None]
    got = simhash.near_duplicates(make_docs(spark, texts, ids)).collect()
    fps = [slow_fingerprint(t) for t in texts]
    want = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    low = lambda k: min((ids[j] for j in range(len(texts)) if want[j] == want[k] and ids[j] is not None), default=None)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], key=key) == sorted([(ids[k], fps[k], low(k)) for k in range(len(texts))], key=key)
    kept = simhash.keep_one(make_docs(spark, texts, ids))
    assert kept.columns == make_docs(spark, texts, ids).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({low(k) for k in range(len(texts))})
    assert simhash.near_duplicates(make_docs(spark, [])).count() == 0


def test_repeated_ids_keep_one_row_of_each_component(spark):
    docs = make_docs(spark, [prose(1, 90), prose(2, 90), prose(2, 90), prose(3, 90), prose(3, 90)], [1, 1, 1, None, None])
    assert sorted(r.text for r in simhash.keep_one(docs).collect()) == sorted([prose(1, 90), prose(2, 90), prose(3, 90)])


def slow_repeats(texts, ids, passage):
    first, hits = {}, {}
    for k in sorted(range(len(texts)), key=lambda k: (ids[k] is None, ids[k] or 0)):
        words = (texts[k] or "").lower().split()
        own = {}
        for at in range(len(words) - passage + 1):
            run = tuple(words[at : at + passage])
            if first.get(run, ids[k]) != ids[k] or run in own:
                hits.setdefault(k, set()).update(range(at, at + passage))
            own[run] = at
        for run in own:
            first.setdefault(run, ids[k])
    return hits


@pytest.mark.parametrize("seed", range(3))
def test_repeats_match_all_windows(spark, seed):
    draw = random.Random(seed)
    shared = [prose(100 + k, draw.randrange(20, 90)) for k in range(12)]
    texts = [" ".join(draw.choice([prose(draw.randrange(10**6), draw.randrange(1, 40)), draw.choice(shared)]) for _ in range(draw.randrange(1, 7))) for _ in range(60)]
    texts += [None, "", texts[3], texts[4].upper(), shared[0] + " x " + shared[0] + " y " + shared[0]]
    got = {}
    for r in suffix.repeats(make_docs(spark, texts)).collect():
        run = set(range(r.start_word, r.end_word))
        assert not run & got.setdefault(r.doc_id, set())
        got[r.doc_id] |= run
        assert r.first_doc_id <= r.doc_id
    assert got == slow_repeats(texts, list(range(len(texts))), 50)


@pytest.mark.parametrize("seed", range(2))
def test_repeats_equal_sql(spark, seed):
    """Every column, with null and repeated ids, against all windows as text."""
    draw = random.Random(10 + seed)
    shared = [prose(200 + k, draw.randrange(30, 90)) for k in range(10)]
    texts = [" ".join(draw.choice([prose(draw.randrange(10**6), draw.randrange(1, 30)), draw.choice(shared)]) for _ in range(draw.randrange(1, 8))) for _ in range(50)]
    texts += [texts[0], texts[1], "a b " * 60, "a b " * 80, None]
    docs = make_docs(spark, texts, [draw.choice([k, k, k, k // 2, None]) for k in range(len(texts))])
    got = [(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in suffix.repeats(docs).collect()]
    assert sorted(got, key=str) == duck(suffix.ORACLE, documents=docs)


def test_passages_with_a_word_that_only_a_hash_confuses(spark):
    one, two = thue_morse(10)
    halves = prose(1, 30), prose(2, 30)
    docs = make_docs(spark, [f"{halves[0]} {w} {halves[1]}" for w in (one, two)])
    assert suffix.repeats(docs).count() == 0 and suffix.remove_repeats(docs).collect() == docs.collect()


def test_removal_keeps_all_other_bytes(spark, odd_texts):
    passage = prose(7, 60)
    texts = [*odd_texts, "Start  ÄÖ.\n" + passage + "\n\nend.", "other " + passage, passage, prose(8, 100)]
    docs = make_docs(spark, texts)
    got = {r.doc_id: r for r in suffix.remove_repeats(docs).collect()}
    n = len(odd_texts)
    assert [got[k].text for k in range(n) if k != 11] == [t for k, t in enumerate(odd_texts) if k != 11]
    assert got[n].text == texts[n] and got[n + 1].text == "other" and got[n + 1].n_chars == 5
    assert n + 2 not in got and got[n + 3].text == texts[n + 3]
    assert suffix.remove_repeats(docs).columns == docs.columns
    assert suffix.remove_repeats(make_docs(spark, [])).count() == 0
    again = make_docs(spark, [passage, passage, passage], [4, 4, 4])  # rows of one document are no repeats of each other
    assert suffix.repeats(again).count() == 0 and suffix.remove_repeats(again).count() == 3


def test_unlike_long_passages_stay_apart(spark):
    """Thue-Morse words of 1,024 and 2,048 and their complements share no passage, but have one polynomial hash modulo 2^64."""
    for size in (1024, 2048):
        bits = [bin(k).count("1") % 2 for k in range(size)]
        texts = [" ".join("ab"[b] for b in bits), " ".join("ba"[b] for b in bits)]
        assert suffix.repeats(make_docs(spark, texts), passage=size).count() == 0
        again = suffix.repeats(make_docs(spark, [*texts, texts[0]]), passage=size).collect()
        assert [(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in again] == [(2, 0, size, 0)]
