import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitalcells.llm import labelled
from vitalcells.llm import line_crf as C
from vitalcells.llm import lm_scoring as L
from vitalcells.llm import quality_rules as Q

SF = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def tables(spark, *names):
    return [spark.read.parquet(f"{SF}/{n}.parquet") for n in names]


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    good = label == 1
    return (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


def held(doc, folds, fold):
    return doc is not None and zlib.crc32(str(doc).encode()) % folds == fold


def brute_base(rows):
    count = Counter()
    tokens = [re.findall(WORD, (t or "").translate(LOWER)) + ["\n"] for _, t in rows]
    for (d, _), words in zip(rows, tokens):
        if not held(d, 7, 2):
            count.update(words)
    n = sum(count.values())
    out = []
    for (d, _), words in zip(rows, tokens):
        base = sum(math.log10((count[w] + 1) / (n + len(count) + 1)) for w in words)
        out.append((d, held(d, 7, 2), len(words), sum(count[w] > 0 for w in words), n, round(base, 6)))
    return sorted(out, key=repr)


def test_language_model_base_scores_and_gain(spark):
    (docs,) = tables(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = L.score_documents(docs, bucket_bytes=500_000).collect()
    assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in got), key=repr) == brute_base(rows)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)


def test_language_model_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, " a B a "), (None, "a"), (3, "a"), (3, "a"), (9, "ü " * 3000)]
    docs = documents(rows).withColumn("bucket", F.lit("x"))
    got = L.score_documents(docs).collect()
    assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in got), key=repr) == brute_base(rows)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert L.score_documents(documents([]).limit(0)).count() == 0


def test_language_model_is_normalised():
    """Both steps: over the units, and over the words and the rest of each unit."""
    rng = np.random.default_rng(0)
    edges = np.sort(rng.integers(0, 40, L.UNITS + 1))
    edges[0], edges[-1] = 0, 40
    own = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    vocabulary = L.Vocabulary(0, 0, np.zeros(0, np.uint64), rng.integers(900, 999, L.UNITS), np.full(L.UNITS, 50), own,
                              rng.integers(1, 9, 40), edges)
    assert (vocabulary.words(own) == np.arange(40)).all() and vocabulary.words(own[:1] + np.uint64(1))[0] == -1
    model = L.Model.initial(vocabulary)
    unit_of = np.repeat(np.arange(L.UNITS), np.diff(edges))
    units, words = np.concatenate([np.arange(L.UNITS), unit_of]), np.concatenate([np.full(L.UNITS, -1), np.arange(40)])
    before = np.repeat(rng.integers(0, L.UNITS + 1, (1, L.CONTEXT)), len(units), 0)
    assert np.exp(model.log_probabilities(vocabulary, units, words, before)).sum() == pytest.approx(1, abs=1e-4)


def test_a_unit_of_many_words_is_scored_by_groups():
    """A token meets the square root of a unit's words, not all of them, and all still add up to 1."""
    words, unit = 2500, 70
    edges = np.where(np.arange(L.UNITS + 1) > unit, words, 0)
    rng = np.random.default_rng(1)
    vocabulary = L.Vocabulary(0, 0, np.zeros(0, np.uint64), np.full(L.UNITS, 10**6), np.full(L.UNITS, 5000),
                              rng.integers(1, 1 << 62, words).astype(np.uint64), rng.integers(1, 99, words), edges)
    every = np.full(words + 1, unit), np.arange(-1, words)
    _, choices = vocabulary.sorted(*every, np.arange(words + 1))
    assert max(len(weights) for _, weights, _, _ in choices) <= 1 + 50
    model = L.Model.initial(vocabulary)
    model.inner += rng.normal(0, 0.2, model.inner.shape).astype(np.float32)
    before = np.repeat(rng.integers(0, L.UNITS + 1, (1, L.CONTEXT)), words + 1, 0)
    whole = model.log_probabilities(vocabulary, np.arange(L.UNITS), np.full(L.UNITS, -1), before[:L.UNITS])
    other = [i for i in range(L.UNITS) if i != unit]
    total = np.exp(model.log_probabilities(vocabulary, *every, before)).sum() + np.exp(whole[other]).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_words_of_their_own_grow_with_the_texts_and_help(spark):
    (docs,) = tables(spark, "documents")
    few = L.score_documents(docs, own_from=10**9).collect()
    many = L.score_documents(docs, own_from=40).collect()
    held_out = [sum(r.score for r in rows if r.held_out) for rows in (few, many)]
    assert held_out[1] > held_out[0]
    text = docs.select("doc_id", F.lit(0).alias("bucket"), F.lit(False).alias("held_out"), "text")
    sizes = []
    for part in (text.where("doc_id % 4 = 0"), text):
        counts = part.groupBy("bucket").applyInArrow(L._count, L.COUNTS)
        totals = counts.selectExpr("bucket", "word", "n", "n as total", "unit", "true as first")
        sizes.append(len(L._vocabulary(totals, 40).own))
    assert sizes[1] > 2 * sizes[0] > 0


def test_very_long_text_is_scored_whole(documents):
    rows = [(1, "one two three " * 100_000), (2, "one two three"), (9, "two")]
    got = {r.doc_id: r for r in L.score_documents(documents(rows)).collect()}
    assert got[1].n_tokens == 300_001 and np.isfinite(got[1].score) and got[1].score < got[2].score < 0


def brute_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def test_quality_base_counts(spark, documents):
    rng = random.Random(3)
    vocab = ["a", "b#", "é", "<x>", "word", "|"]
    rows = [(i, rng.choice(["\n", " ", "\r\n", "\n\n"]).join(
        rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(i, " ".join(rng.choice(["w", "v"]) for _ in range(40)) + "\n") for i in range(200, 230)]
    rows += [(900, None), (901, ""), (902, "\n"), (None, "one\none\n"), (3, rows[3][1])]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (4, 7, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = documents(rows).withColumn("quality", F.lit("clash"))
    for r in Q.quality_rules(docs, labels).collect():
        assert tuple(r)[1:6] in {brute_counts(t) for d, t in rows if d == r.doc_id}
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    none = labels.limit(0)
    assert Q.quality_rules(documents([]).limit(0), none).count() == 0
    assert {r.kept == (not r.base_failed) for r in Q.quality_rules(docs, none).collect()} == {True}


def test_quality_verdicts(spark):
    docs, labels = tables(spark, "documents", "labels")
    rows = Q.quality_rules(docs, labels).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    rows = [r for r in rows.collect() if not r.base_failed]
    assert np.mean([r.kept for r in rows if r.label == 1]) > 0.99
    assert np.mean([r.kept for r in rows if r.label == 0]) < 0.2


def test_field_scores_held_out_documents(spark):
    docs, labels = tables(spark, "documents", "labels")
    rows = C.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    label = np.array([r.quality for r in rows])
    assert auc(np.array([r.score for r in rows]), label) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.held_out == held(r.doc_id, 4, 2) and r.predicted == (r.score >= 0.7) for r in rows)


def test_field_odd_rows(spark, documents):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, "good text here.\nmore of it." if i % 2 else "| # |\n| $$ |\n\n") for i in range(40)]
    rows += [(900, None), (901, ""), (None, "x\n" * 3000), (1, rows[1][1])]
    docs = documents(rows).withColumn("held_out", F.lit("clash"))
    got = C.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = labels.limit(0)
    assert {r.score for r in C.score_documents(docs, none).collect()} == {0.5}
    assert C.score_documents(documents([]).limit(0), labels).count() == 0


def test_chain_sums_equal_enumeration():
    rng = np.random.default_rng(2)
    row = np.array([0, 0, 0, 2, 2, 3])
    margin, link = rng.normal(size=6), rng.normal(size=(2, 2))
    good, pairs, logz = C.Chains(row).marginals(margin, link)
    want, want_pairs, want_z = np.zeros(6), np.zeros((2, 2)), 0.0
    for r in np.unique(row):
        at = np.flatnonzero(row == r)
        weights, z = [], 0
        for code in range(2 ** len(at)):
            y = [(code >> i) & 1 for i in range(len(at))]
            w = math.exp(sum(margin[a] * s for a, s in zip(at, y)) + sum(link[a, b] for a, b in zip(y, y[1:])))
            weights.append((y, w))
            z += w
        for y, w in weights:
            want[at] += np.array(y) * w / z
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / z
        want_z += math.log(z)
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and logz == pytest.approx(want_z)


def test_calibration_recovers_probabilities():
    rng = np.random.default_rng(1)
    margin = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < labelled.sigmoid(0.5 * margin - 1)).astype(float)
    slope, shift = labelled.calibrate(margin, y)
    assert slope == pytest.approx(0.5, abs=0.08) and shift == pytest.approx(-1, abs=0.2)


def test_lines_belong_to_their_text():
    texts = pa.array(["a\n", "", "\n", None, "b\n\nc", "d"])
    from vitalcells.llm.textbytes import texts_of
    t = texts_of(texts)
    start, end, row = Q.lines_of(t)
    got = [(int(r), bytes(t.data[a:b])) for a, b, r in zip(start, end, row)]
    assert got == [(0, b"a"), (0, b""), (2, b""), (2, b""), (4, b"b"), (4, b""), (4, b"c"), (5, b"d")]
