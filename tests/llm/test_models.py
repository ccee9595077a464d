"""Language, quality and toxicity: held-out accuracy and odd rows; the pipeline against a brute-force version."""

import random
import zlib

import pytest

from portfolia.llm import language, quality, simhash, toxicity
from portfolia.llm.queries import queries
from tests.llm.conftest import make_docs, prose
from tests.llm.test_pairs import roots, slow_fingerprint, slow_repeats
from tests.llm.test_scans import slow_hits

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_accuracy(spark):
    rows = queries()["op7_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    kept = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in kept) >= 0.97 * len(kept)


def test_forward_sums_all_segmentations():
    import numpy as np

    lattice = language.Lattice(sorted([b" a", b"a", b"b", b"ab", b" ab", b"ba"]))
    p = np.random.default_rng(1).random((6, 2)) / 6

    def slow(rest, k):
        sums = [1.0]  # over the segmentations of the last n bytes
        for n in range(1, len(rest) + 1):
            own = rest[len(rest) - n :]
            sums.append(language.BYTE * sums[n - 1] + sum(p[j, k] * sums[n - len(x)] for j, x in enumerate(lattice.pieces) if own.startswith(x)))
        return sums[-1]

    words = sorted([b" a", b" ab", b" abba", b" bababab", b" xyab", b" abbaxbab" * 20, b" ab", b" " + b"ab" * 30], key=len, reverse=True)
    letters = np.zeros((len(words), len(words[0])), np.uint8)
    for row, word in zip(letters, words, strict=True):
        row[: len(word)] = np.frombuffer(word, np.uint8)
    size = np.array([len(w) for w in words])
    total = np.zeros((6, 2))
    weight = np.array([[1 + k % 3, k % 2] for k in range(len(words))], float)
    got = lattice.likelihood(letters, size, p, weight, total)
    assert got[:-1].ravel().tolist() + got[-1].tolist() == pytest.approx([np.log(slow(w, k)) for w in words for k in (0, 1)], rel=1e-9)
    # Expected counts are the derivatives of the likelihood by the log of each probability.
    for j in range(6):
        moved = p.copy()
        moved[j] *= 1 + 1e-6
        slope = ((lattice.likelihood(letters, size, moved) - got) * weight).sum(0) / np.log1p(1e-6)
        assert total[j].tolist() == pytest.approx(slope.tolist(), rel=1e-4, abs=1e-6)


def test_long_unspaced_words_count_whole(spark):
    import numpy as np

    texts = ["日本語の文章" * 400, "abcdefghij" * 3000, "«—»", "x" * 70 + " " + "y" * 33]
    docs = make_docs(spark, [*texts, *[prose(k, 50) for k in range(20)], *["日本 語の 文章" for _ in range(3)]])
    pieces = language.read_pieces(language.default_vocabulary())
    assert max(map(len, pieces)) > 12
    langs, p = language.fit(docs.selectExpr("text", "case when doc_id >= 24 then 'ja' else 'en' end as lang"), pieces)
    scorer = language.Scorer(language.Lattice(pieces), p)
    import pyarrow as pa

    got = scorer.of(pa.array(texts))
    number = {x: k for k, x in enumerate(pieces)}
    for text, row in zip(texts, got, strict=True):
        for k in range(len(langs)):
            want = 0.0
            for word in text.split() if text != "«—»" else []:
                word, sums, scale = (" " + word).encode(), [1.0], 0.0
                for end in range(1, len(word) + 1):  # sums of the places before, the last 30 of them
                    sums.append(language.BYTE * sums[-1] + sum(p[number[word[a:end]], k] * sums[a - end] for a in range(max(0, end - 29), end) if word[a:end] in number))
                    scale += np.log(sums[-1])
                    sums = [x / sums[-1] for x in sums[-30:]]
                want += scale
            assert row[k] == pytest.approx(want, rel=1e-9)


def test_language_odd_rows(spark, odd_texts):
    docs = make_docs(spark, odd_texts)
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    assert [rows[k].lang_pred for k in (0, 1, 2, 4, 12)] == ["und"] * 5 and rows[7].lang_pred == "en" and rows[9].lang_pred == "en"
    assert language.identify(docs.limit(0)).count() == 0
    from pyspark.sql import functions as F

    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(none) == len(odd_texts) and {r.lang_pred for r in none} == {"und"}
    kept = language.reject_unknown(docs)
    assert kept.columns == docs.columns and kept.count() == len(odd_texts) - 5


@pytest.mark.parametrize("name,label,least", [("op8_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.9)])
def test_label_accuracy(spark, name, label, least):
    rows = queries()[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    kept = [r for r in rows if r.held_out]
    assert kept and sum(r.predicted == r[label] for r in kept) >= least * len(kept)


def test_scores_of_odd_rows(spark, odd_texts):
    docs = make_docs(spark, odd_texts)
    labels = spark.createDataFrame([(k, k % 2, k % 3 // 2) for k in range(13)] + [(None, 1, 1), (3, None, None), (4, 7, 7)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        for table, marks in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
            rows = score(table, marks).collect()
            assert len(rows) == table.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    for score in (quality.score_quality, toxicity.score_toxicity):
        one, two = ({r.doc_id: r.score for r in score(d, labels).collect()} for d in (docs.coalesce(1), docs.repartition(5, "source").sortWithinPartitions("text")))
        assert one == pytest.approx(two, abs=1e-9)


def test_insults_that_no_learning_row_has(spark):
    """Misspelt insults are found that the words of the learning rows don't hold: the machine is no list."""
    insults = ["imbecile", "numbskull", "dunderhead", "halfwit"]
    near = ["imbbecile", "imbe-cile", "numbskul", "nuumbskull", "dunderheadd", "dunnderhead", "hallfwit", "half_wit"]
    clean = [prose(k, 40) for k in range(300)]
    toxic = [prose(1000 + k, 20) + " " + insults[k % 4] + " " + prose(2000 + k, 20) for k in range(80)]
    docs = make_docs(spark, [*clean, *toxic, *[prose(6000 + k, 30) + " " + w for k, w in enumerate(near)]])
    labels = spark.createDataFrame([(k, 1, int(k >= 300)) for k in range(380)], "doc_id long, quality int, toxic int")
    known = {w for k, t in enumerate([*clean, *toxic]) if not held_out(k) for w in t.split()}
    rows = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    assert not known & set(near) and [rows[380 + k] for k in range(len(near))] == [1] * len(near)


def slow_strengths(x, y, ridge):
    """Strengths by all pairs of a good and a bad row, as the loss is written."""
    import numpy as np

    z, w = (x - x.mean(0)) / (x.std(0) + (x.std(0) == 0) + 1e-6), np.zeros(x.shape[1])
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ w))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), d.T @ p / len(d) - ridge * w)
    return z @ w


def test_quality_counts_all_pairs(spark):
    import numpy as np
    import pyarrow as pa

    texts = [prose(k, 20 + k % 9) + (" ??! X9" * (1 + k % 4) if k % 3 == 0 or k % 7 == 0 else "") for k in range(160)]
    labels = [int(k % 3 > 0) for k in range(160)]
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    rows = {r.doc_id: r.score for r in quality.score_quality(make_docs(spark, texts), marks).collect()}
    known = [k for k in range(160) if not held_out(k)]
    y = np.array([labels[k] for k in known])
    slow = slow_strengths(quality.features(pa.array([texts[k] for k in known])), y, quality.RIDGE)
    shift = np.log(0.7 / 0.3) - np.quantile(slow, (y == 0).mean())
    assert np.abs(1 / (1 + np.exp(-slow - shift)) - [rows[k] for k in known]).max() < 0.01


def test_quality_learns_from_every_labelled_row(spark):
    """The threshold leaves exactly as many learned texts below as are labelled bad, however many there are."""
    draw = random.Random(12)
    texts = [" ".join(draw.choice(["ab", "cde", "Fgh", "i9", "?!", "jklmn,", "OP"]) + "xyz"[: draw.randrange(4)] for _ in range(draw.randrange(20, 60))) for _ in range(17_000)]
    labels = [int(draw.random() < 0.3 + 0.5 * ("?!x" in t)) for t in texts]
    known = [k for k in range(len(texts)) if not held_out(k)]
    assert len(known) > 12_500 and len(set(texts)) == len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.predicted for r in quality.score_quality(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")).collect()}
    assert sum(rows[k] for k in known) == sum(labels[k] for k in known)


def test_repeated_labels_and_texts(spark):
    docs = make_docs(spark, [prose(k % 40, 60) for k in range(120)])
    labels = spark.createDataFrame([(k // 2, k % 2, k % 2) for k in range(160)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):  # every doc_id has both labels, so all count as 1
        rows = score(docs, labels).collect()
        assert len(rows) == 120 and all(0 <= r.score <= 1 for r in rows)


def test_gapped_insults_score_high(spark):
    clean = [prose(k, 40) for k in range(300)]
    insults = ["idiot", "moron", "worthless", "stupid", "pathetic"]
    toxic = [prose(1000 + k, 20) + " " + insults[k % 5] + " " + prose(2000 + k, 20) for k in range(100)]
    docs = make_docs(spark, clean + toxic)
    labels = spark.createDataFrame([(k, 1, int(k >= 300)) for k in range(400)], "doc_id long, quality int, toxic int")
    tests = ["you i-d-i-o-t here", "an i d i o t", "wortthless", "st_upid one", "morron", "path.etic"]
    more = make_docs(spark, tests + [prose(5000 + k, 60) for k in range(60)], range(1000, 1066), "en")
    rows = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs.union(more), labels).collect()}
    assert [rows[1000 + k] for k in range(6)] == [1] * 6
    assert sum(rows[1006 + k] for k in range(60)) <= 1


FORMS = {
    "plain": lambda w: w,
    "dotted": ".".join,
    "spelled out": " ".join,
    "digits": lambda w: w.translate(str.maketrans("oieastb", "0134578")),
    "zzz put in": lambda w: w[0] + "zzz" + w[1:],
    "x between all": "x".join,
    "xy between all": "xy".join,
}


def test_insults_with_characters_put_in(spark):
    """Of each kind of obfuscation at least nine tenths are found, of clean rows at most one in a hundred, by a machine that has seen none."""
    insults = ["idiot", "moron", "worthless", "stupid", "pathetic", "loser"]
    clean = [prose(k, 40) for k in range(600)]
    toxic = [prose(3000 + k, 20) + " " + insults[k % 6] + " " + prose(4000 + k, 20) for k in range(200)]
    forms = [(name, prose(6000 + k, 20) + " " + form(insults[k % 6]) + " " + prose(7000 + k, 20)) for name, form in FORMS.items() for k in range(30)]
    forms += [("clean", prose(8000 + k, 60)) for k in range(200)]
    docs = make_docs(spark, [*clean, *toxic, *[t for _, t in forms]])
    labels = spark.createDataFrame([(k, 1, int(k >= 600)) for k in range(800)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    for name in FORMS:
        found = [rows[800 + k] for k, (form, _) in enumerate(forms) if form == name]
        assert sum(found) >= 0.9 * len(found), name
    assert sum(rows[800 + k] for k, (form, _) in enumerate(forms) if form == "clean") <= 2


def test_toxic_phrase_of_ordinary_words(spark):
    """Two words that clean rows have apart are toxic together: the machine learns from sentences, not from a list of words."""

    def apart(k):
        words = prose(k, 40).split()
        words[3:3], words[20:20] = ["swallow"] * (k % 2), ["gravel"] * (k % 3 == 0)
        return " ".join(words)

    texts = [apart(k) for k in range(600)] + [prose(3000 + k, 20) + " swallow gravel " + prose(4000 + k, 20) for k in range(200)]
    labels = spark.createDataFrame([(k, 1, int(k >= 600)) for k in range(800)], "doc_id long, quality int, toxic int")
    rows = [r for r in toxicity.score_toxicity(make_docs(spark, texts), labels).collect() if r.held_out]
    assert rows and sum(r.predicted == (r.doc_id >= 600) for r in rows) >= 0.98 * len(rows)


def test_values_are_sums_over_all_subsequences():
    """The value of each word's highest stretch, by plain Python over all stretches and all subsequences of three letters."""
    import numpy as np
    import pyarrow as pa

    table = np.random.default_rng(5).normal(size=toxicity.CODES)
    texts = ["swallow the gravel now sxwxaxlxlxoxw. abc de\nf", None, "", "s t u p i d 1d10t! caf\u00e9 \u00fcber x", "zzzzz 555-44 ... aaab izzzdiot mzzzoroooonst"]
    sentences = toxicity.Sentences(pa.array(texts))
    value, stride, at = sentences.values(table)

    def slow(word):
        total = weights = 0.0
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    code = sum(int(toxicity._PLACE[n][b]) for n, b in enumerate((word[i], word[j], word[k]))) % toxicity.CODES
                    total, weights = total + toxicity.DECAY ** (k - i + 1) * table[code], weights + toxicity.DECAY ** (2 * (k - i + 1))
        return total / weights**0.5 if weights else -np.inf

    data = sentences.data.tobytes()
    for k, (start, end, pair) in enumerate(zip(sentences.start, sentences.end, sentences.pair, strict=True)):
        word, want = data[start:end], []
        want.append(slow(word))
        want += [slow(data[start:pair]) - toxicity.LESS] if pair > end else []
        want += [slow(word[o::s]) - toxicity.LESS for s, least in toxicity.STRIDES.items() if len(word) >= least for o in range(s)]
        without = bytes(b for b, run in zip(word, sentences.long[start:end], strict=True) if not run)
        want += [slow(without) - toxicity.LESS] if without != word else []
        assert value[k] == pytest.approx(max(want), abs=1e-6)
    words = [data[a:b].decode() for a, b in zip(sentences.start, sentences.end, strict=True)]
    assert words[:8] == ["swallow", "the", "gravel", "now", "sxwxaxlxlxoxw", "abc", "de", "f"] and "stupid" in words and "idiot" in words
    assert "z" in words and "aaab" not in words and "ab" in words


def test_stages_keep_columns_of_any_name(spark, odd_texts, tmp_path):
    """Values of columns with clashing names survive every stage; null and repeated ids, repeated rows and empty tables pass through."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    passage = prose(910, 70)
    texts = [*odd_texts, *[prose(k, 80) for k in range(50, 62)], prose(70, 40) + " " + passage, prose(71, 40) + " " + passage, prose(72, 60), prose(72, 60)]
    ids = [None, 3, 3, None, *range(4, len(texts))]
    docs = make_docs(spark, texts, ids)
    own = {"text_hash": F.lit(11), "_text_hash": F.lit(5), "_id": F.lit(6), "_hash": F.lit(16), "_runs": F.lit("r"), "row": F.lit("w"), "a.b": F.lit(7), "root": F.lit(8), "starts": F.lit(9), "lang_pred": F.lit("q"), "n_words": F.lit(10), "hits": F.lit("h"), "tick`s": F.lit(12)}
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", *[v.alias(k) for k, v in own.items()])
    spark.createDataFrame([(1, prose(999, 30)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in own]).first()
    for table, empty in ((docs, False), (docs.limit(0), True)):
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, table, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            rows = out.collect()
            assert bool(rows) != empty
            assert all(tuple(r)[5:] == tuple(want) for r in rows), name
    last = corpus_pipeline.encode(spark, docs, str(tmp_path))
    assert last.count() == len(texts) and corpus_pipeline.encode(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Stages 2 to 5 are recomputed by plain Python from what the first stage keeps."""
    import corpus_pipeline
    from portfolia.llm import bpe
    from tokenizers import Tokenizer

    passage, item = prose(900, 70), prose(901, 40)
    texts = [prose(k, 120) for k in range(30)] + [prose(3, 120), prose(4, 119) + " x", prose(40, 50) + " " + passage, prose(41, 50) + " " + passage, passage, prose(42, 30) + " " + item, prose(43, 2000) + " " + item, None, "", "12 34", "ok"]
    make_docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, item)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = {k: t for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    ids = sorted(rows)
    fps = [slow_fingerprint(rows[k]) for k in ids]
    root = roots(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash.STAGE_LIMIT])
    ids = [k for n, k in enumerate(ids) if root[n] == n]
    hits = slow_repeats([rows[k] for k in ids], ids, 50)
    left = {}
    for n, k in enumerate(ids):
        words = rows[k].split()
        kept = [w for at, w in enumerate(words) if at not in hits.get(n, ())]
        if kept:
            left[k] = " ".join(kept)
    left = {k: t for k, t in left.items() if not (s := slow_hits(t, items, 13))[1] or 20 * s[1] < s[0]}
    assert sorted(got) == sorted(left)
    library = Tokenizer.from_file(bpe.default_tokenizer())
    library.no_truncation()
    assert {k: r.n_tokens for k, r in got.items()} == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in left.items()}
