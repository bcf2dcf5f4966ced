import hashlib
import random

from pyspark.sql import functions as F

from vitalcells.llm import repeats


def brute(rows, least):
    seen = {}
    for doc, text in rows:
        b = (text or "").encode()
        d = repeats.LAST if doc is None else doc
        for i in range(len(b) - least + 1):
            w = b[i:i + least]
            seen[w] = min(d, seen.get(w, d))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        d = repeats.LAST if doc is None else doc
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i:i + least]] < d:
                gone[i:i + least] = b"\1" * least
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def make(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["ab", "né", "foo", "zz", "quux", "ü", "x", "lorem"]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    common = [say(rng.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common)
            a, b = sorted((rng.randint(0, len(c)), rng.randint(0, len(c))))
            parts += [c[a:b], say(rng.randint(0, 10))]
        rows.append((i * 3 % n, rng.choice(["", " "]).join(parts)))
    rows += [(900, "a" * 500), (901, "b" + "a" * 300), (902, "ab" * 200), (2, rows[5][1]),
             (7, rows[7][1]), (None, rows[9][1]), (903, None), (904, ""), (905, "x" * 49)]
    return rows


def check(documents, rows, **kind):
    got = repeats.without_repeats(documents(rows), **kind).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 50)


def test_equals_brute_force(documents):
    check(documents, make())


def test_large_buckets_equal_brute_force(documents):
    check(documents, make(2), most_leaves=1)


def test_blocks_do_not_matter(documents):
    check(documents, make(3), block_bytes=500)


def test_empty_table(documents):
    assert repeats.without_repeats(documents([]).limit(0)).count() == 0


def test_extra_columns_and_text(documents):
    rows = [(1, "q" * 60 + "tail"), (2, "head" + "q" * 60)]
    docs = documents(rows).withColumn("place", F.lit(1)).withColumn("key", F.lit("k"))
    got = {r.doc_id: bytes(r.kept) for r in repeats.without_repeats(docs, with_text=True).collect()}
    assert got == {1: rows[0][1].encode(), 2: b"head"}


def test_a_block_of_near_copies_stays_small():
    """Nested repeats of many near copies are not written out: memory is that of the suffixes."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(8)
    base = bytes(rng.randrange(97, 123) for _ in range(113))
    leaves = []
    for i in range(9_000):
        copy = bytearray(base)
        copy[rng.randrange(113)] = rng.randrange(97, 123)
        leaves.append(bytes(copy))
    n = len(leaves)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * n), pa.array(range(n)), pa.array(range(n)), pa.array([0 << repeats.SHIFT | 113] * n), pa.array(leaves)],
        names=["key", "doc", "text_id", "place", "leaf"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in repeats.repeat_ranges(50, repeats.BLOCK_BYTES)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < rows <= 2 * n and peak < 400 << 20


def test_repeat_groups_have_all_occurrences(documents):
    rows = [r for r in make(4, 40) if r[0] is not None]
    groups, suffixes, leaves = repeats.repeat_groups(documents(rows))
    text_of = {}
    for d, t in rows:
        text_of.setdefault(d, []).append((t or "").encode())
    members = (groups.withColumn("group", F.monotonically_increasing_id())
               .join(suffixes, "key").where("rank between first and last").join(leaves, ["key", "span"])
               .select("group", "length", "doc", (F.col("start") + F.col("shift")).alias("at")).collect())
    found, where = {}, {}
    for r in members:
        if len(text_of[r.doc]) == 1:
            found.setdefault(r.group, set()).add(text_of[r.doc][0][r.at:r.at + r.length])
        where.setdefault(r.group, set()).add((r.doc, r.at))
    assert all(len(strings) == 1 and len(next(iter(strings))) >= 50 for strings in found.values())
    # Every window that stands twice is inside a repeat, at every place where it stands.
    covered = {}
    for group, strings in found.items():
        text = next(iter(strings))
        for i in range(len(text) - 49):
            covered.setdefault(text[i:i + 50], set()).update((d, at + i) for d, at in where[group])
    places = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            places.setdefault(b[i:i + 50], set()).add((d, i))
    for window, at in places.items():
        if len(at) > 1 and all(len(text_of[d]) == 1 for d, _ in at):
            assert at <= covered.get(window, set()), window


def test_very_long_text_and_repeated_rows(documents):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, long), (2, "own " + long[1000:1300] + " end"), (3, "x" * 80), (3, "x" * 80)]
    check(documents, rows)
