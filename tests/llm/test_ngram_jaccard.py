import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalcells.llm import ngram_jaccard as J

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size=5, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d)
                   for i, (d, _) in enumerate(rows)), key=repr)


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(25):
        n = rng.choice([2, 5, 6, 8, 9, 10, 13, 14, 20, 30, 60, 150])
        words = [rng.choice(vocab) for _ in range(n)]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, n // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            if rng.random() < 0.4:
                copy += [rng.choice(vocab) for _ in range(rng.randint(0, max(1, n // 6)))]
            if rng.random() < 0.2:
                words = copy
            rows.append((len(rows) * 7 % 997, " ".join(copy).upper() if rng.random() < .2 else "\n ".join(copy)))
    return rows


@pytest.mark.parametrize("seed,percent", [(1, 80), (2, 80), (3, 60)])
def test_equals_brute_force(documents, seed, percent):
    rows = make(seed) + [(2000, None), (2001, ""), (2002, " \n"), (None, make(seed)[0][1]),
                         (None, "all alone here"), (5, make(seed)[1][1]), (5, make(seed)[1][1])]
    got = J.jaccard_components(documents(rows), percent=percent)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == brute(rows, percent=percent)


def test_linked_sets_always_share_a_key():
    rng = np.random.default_rng(5)
    bands = J.Bands(80)
    for _ in range(1500):
        size = int(rng.integers(4, 400))
        common = int(np.ceil(0.8 * size + rng.random() * 0.2 * size))
        a_only = int(rng.integers(0, size - common + 1))
        union = rng.integers(0, 1 << 63, size).astype(np.uint64)
        a = np.sort(union[:common + a_only])
        b = np.sort(np.concatenate([union[:common], union[common + a_only:]]))
        if 100 * common < 80 * size or len(a) == common == len(b):
            continue
        if len(a) > len(b):
            a, b = b, a
        (mine, sure, spared), (theirs, _, spared_b) = J.keys_of(a, bands), J.keys_of(b, bands)
        least = max(1, sure - (len(a) + len(b)) // 9, spared + 1, spared_b + 1)
        assert len(np.intersect1d(mine, theirs)) >= least, (len(a), len(b), common)


def test_empty_table_and_clashing_columns(documents):
    assert J.jaccard_components(documents([]).limit(0)).count() == 0
    docs = documents([(1, "a b"), (2, "A  b")]).withColumn("key", F.lit(1)).withColumn("set_id", F.lit(2))
    assert [r.component_id for r in J.jaccard_components(docs).collect()] == [1, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_verified_links_connect_every_component(documents, seed):
    base = [f"c{i}" for i in range(150)]
    near = [(3000 + i, " ".join([*base[:20 * i], f"new{i}", *base[20 * i + 1:]])) for i in range(6)]
    rows = [*make(seed), *near, (3100, " ".join(base)), (3100, " ".join(base)), (2000, None), (None, near[0][1])]
    links, members = J.jaccard_join(documents(rows))
    got, kept = [tuple(r) for r in links.collect()], members.collect()
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    text_of = {(d, t) for d, t in rows if shingles(t, 5)}
    assert len(kept) == len([1 for _, t in rows if shingles(t, 5)]) and len(text_of) <= len(kept)
    of_set, parent = {}, {}
    by_doc = defaultdict(list)
    for d, t in rows:
        by_doc[d].append(frozenset(shingles(t, 5)))
    for r in kept:
        if len(set(by_doc[r.doc_id])) == 1:
            of_set[r.set_id] = by_doc[r.doc_id][0]
        parent[r.set_id] = r.set_id

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        if a in of_set and b in of_set:
            x, y = of_set[a], of_set[b]
            assert x != y and 100 * len(x & y) >= 80 * len(x | y)
        parent[find(a)] = find(b)
    # Classes of the links are the components of the brute force, which has every link.
    classes = defaultdict(set)
    for r in kept:
        classes[find(r.set_id)].add(r.component_id)
    assert all(len(c) == 1 for c in classes.values())
    assert len(classes) == len({c for d, n, c in brute(rows) if n})


def test_own_columns_of_any_name_stay(documents):
    docs = documents([(1, "a b"), (2, "A  b"), (3, "")]).withColumns(
        {c: F.concat(F.lit("own "), "text") for c in ("r_doc", "r_text", "key", "set_id", "row")})
    kept = J.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.r_doc, r.r_text, r.row) for r in kept.collect()) == [
        (1, "own a b", "own a b", "own a b"), (3, "own ", "own ", "own ")]


def test_very_long_text(documents):
    words = [f"w{i}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:60_000], "other", *words[60_001:]])), (3, "w1 w2 w3 w4 w5 w6")]
    got = {r.doc_id: r.component_id for r in J.jaccard_components(documents(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
