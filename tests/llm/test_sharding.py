import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from vitalcells.llm import sharding


def check(rows, got, shards=16):
    """Everything the result promises but the balance, which it returns."""
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    slots, home, sums = defaultdict(list), defaultdict(set), [0] * shards
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        home[(r.size, r.text_crc32)].add(r.shard)
        sums[r.shard] += r.size
    assert all(len(s) == 1 for s in home.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sums


def make(n, seed=1, copies=0):
    rng = random.Random(seed)
    rows = [(i, "é" * rng.randint(0, 30) + "x" * int(min(rng.paretovariate(1.1) * 20, 2000)) + str(i)) for i in range(n)]
    return rows + [(n + i, "again and again") for i in range(copies)]


def exact(sizes, parts):
    """Differencing with plain lists of numbers, by its definition."""
    held = [[[0, []] for _ in range(parts - 1)] + [[s, [i]]] for i, s in enumerate(sizes)]
    held = [sorted(h, key=lambda p: -p[0]) for h in held]
    while len(held) > 1:
        held.sort(key=lambda h: h[0][0] - h[-1][0])
        a, b = held.pop(), held.pop()
        held.append(sorted(([x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b))), key=lambda p: -p[0]))
    return sorted(s for s, _ in held[0])


def test_difference_equals_its_definition():
    rng = random.Random(3)
    for parts in (2, 3, 16):
        sizes = rng.sample(range(1, 10**9), 200)
        part = sharding.difference(sizes, parts)
        sums = [0] * parts
        for s, p in zip(sizes, part):
            sums[p] += s
        assert sorted(sums) == exact(sizes, parts)
    assert exact([8, 7, 6, 5, 4], 2) == [14, 16]
    assert sharding.difference([], 4) == [] and len(set(sharding.difference([3, 2, 1], 4))) == 3


def test_bytes_are_near_equal(documents):
    rows = make(3000) + [(9000, None), (9001, ""), (None, "no id"), (5, "again"), (5, "again")]
    docs = documents(rows).repartition(4)
    sums = check(rows, sharding.shard_documents(docs).collect())
    assert max(sums) - min(sums) <= 0.001 * sum(sums) / 16


def test_bundled_small_groups_and_many_shares(documents):
    rows = make(4000, 2, copies=200)
    got = sharding.shard_documents(documents(rows), blocks=512, share_rows=50).collect()
    sums = check(rows, got)
    assert max(sums) - min(sums) <= 0.02 * sum(sums) / 16
    again = sharding.shard_documents(documents(rows[::-1]).repartition(3), blocks=512, share_rows=50).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_group_with_a_third_of_all_rows(documents):
    rows = make(600, 4) + [(1000 + i, "c" * 400) for i in range(300)] + [(7, "same row")] * 300
    sums = sorted(check(rows, sharding.shard_documents(documents(rows)).collect()))
    assert sums[-1] == 300 * 401  # indivisible and larger than a fair share
    assert sums[-2] - sums[0] <= 0.01 * sums[0]


def test_very_long_text_empty_table_and_other_columns(documents):
    rows = [(1, "long " * 400_000), (2, "a"), (3, "b")]
    docs = documents(rows).withColumns({c: F.lit("own") for c in ("size", "shard", "copies", "unit", "block")})
    check(rows, sharding.shard_documents(docs).collect())
    assert sharding.shard_documents(documents([]).limit(0)).count() == 0
