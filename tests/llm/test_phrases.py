import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vitalcells.llm import decontamination as D
from vitalcells.llm import license_scan as L

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(rows, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        if w:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                wins.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    sizes = {len(w) for w in wins}
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[key]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


def make(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "é", "straße", "x1", "the"]
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = [(i, " ".join(say(rng.choice([0, 1, 3, 4, 7, 9, 10, 11, 16, 30])) + [f"q{i}"] * (i % 3 > 0)))
             for i in range(25)]
    items += [(25, items[3][1].upper()), (26, None), (27, "!!")]
    rows = []
    for i in range(60):
        text = say(rng.randint(0, 20))
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            a, b = sorted((rng.randint(0, len(own)), rng.randint(0, len(own))))
            text += own[a:b] + say(rng.randint(0, 4))
        rows.append((i, rng.choice([" ", "--", "\n"]).join(text)))
    return rows + [(100, None), (101, ""), (None, rows[3][1]), (4, rows[4][1]), (4, rows[5][1])], items


@pytest.mark.parametrize("seed,most", [(1, 10 ** 6), (2, 10 ** 6), (3, 150)])
def test_windows_equal_brute_force(spark, documents, seed, most):
    rows, items = make(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.digests(D.contamination(documents(rows), bench, most_words=most))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_hits(rows, items)


def test_spans_map_to_the_original(spark, documents):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")],
                                  "item_id long, text string")
    text = "Ünd -- ONE, two; three four five six seven eight\n nine (ten) more"
    row = D.contamination(documents([(1, text)]), bench).first()
    (span,) = row.spans
    assert text.encode()[span.start:span.end].decode().startswith("ONE, two") and row["items"] == ["1"]
    assert text.encode()[span.start:span.end].decode().endswith("(ten")


def test_empty_benchmark_and_documents(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in D.digests(D.contamination(documents([(1, "a b")]), none)).collect()] == [0]
    assert D.contamination(documents([]).limit(0), none).count() == 0


@pytest.mark.parametrize("text,names,demand", [
    ("MIT", {"mit"}, 0.2),
    ("MIT OR Apache-2.0", {"mit", "apache-2.0"}, 0.2),
    ("MIT AND GPL-2.0-only", {"mit", "gpl-2.0-only"}, 0.7),
    ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only with classpath-exception-2.0"}, 0.49),
    ("MIT OR GPL-3.0 AND AGPL-3.0", {"mit", "gpl-3.0", "agpl-3.0"}, 0.2),
    ("(MIT OR GPL-3.0) AND AGPL-3.0 */", {"mit", "gpl-3.0", "agpl-3.0"}, 0.9),
    ("(MIT", {"mit"}, 0.2),
    ("MIT AND", {"mit"}, 0.2),
    ("MIT )", {"mit"}, 0.2),
])
def test_expressions(text, names, demand):
    got = L.evaluate(text)
    assert got[0] == names and got[1] == pytest.approx(demand)


def test_no_expression():
    assert L.evaluate("*/") is None and L.evaluate("") is None


def brute_license(rows):
    phrases = [(words(p), label) for p, label in L.BASE_PHRASES]
    out = []
    for doc, text in rows:
        w = words(text)
        at = [(i, label) for p, label in phrases for i in range(len(w)) if w[i:i + len(p)] == p]
        starts = [i for i, _ in at]
        out.append((doc, len(w), len(at), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({b for _, b in at}))))
    return sorted(out, key=repr)


def test_base_places_equal_brute_force(documents):
    rng = random.Random(4)
    vocab = ["cc", "by", "CC-BY", "general", "public", "License", "all", "rights", "reserved", "accby", "ü"]
    rows = [(i, rng.choice([" ", ".", "\n "]).join(rng.choice(vocab) for _ in range(rng.randint(0, 40))))
            for i in range(120)] + [(500, None), (501, ""), (None, "All rights reserved"), (3, "cc by")]
    docs = documents(rows).withColumn("labels", F.lit("clash"))
    got = L.license_scan(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == brute_license(rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r["labels"].split(",")) for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_tags_and_notices(documents):
    rows = [(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0+) AND Zlib */\ncode"),
            (2, "Released under the MIT License."), (3, "nothing here")]
    got = {r.doc_id: r for r in L.license_scan(documents(rows)).collect()}
    assert got[1]["labels"] == "gpl-2.0+,mit,zlib" and got[1].score >= 0.95
    assert got[2]["labels"] == "licensed,mit" and got[3]["labels"] == "" and got[3].score == 0
