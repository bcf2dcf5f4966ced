import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalcells.llm import periodic_runs as P


def brute_lyndon(text):
    """Longest word at each place that is smaller than all its proper suffixes."""
    n = len(text)
    out = []
    for i in range(n):
        out.append(max(m for m in range(1, n - i + 1)
                       if all(text[i:i + m] < text[i + k:i + m] for k in range(1, m))))
    return out


def brute_runs(words, least=6, periods=4):
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, periods * q) and not any(
                    all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def periodic(rng, letters):
    """Text with nested and touching periods."""
    words = []
    for _ in range(rng.randint(1, 5)):
        root = [rng.choice(letters) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.3:
            root = root * rng.randint(2, 5) + [rng.choice(letters)]
        words += root * rng.randint(1, 7) + root[:rng.randint(0, len(root))]
        words += [rng.choice(letters) for _ in range(rng.randint(0, 4))]
    return words


def test_lyndon_array_equals_its_definition():
    rng = random.Random(1)
    for _ in range(400):
        text = [rng.randint(0, rng.randint(0, 4)) for _ in range(rng.randint(1, 24))]
        assert P.lyndon_array(text) == brute_lyndon(text), text


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        words = [w.encode() for w in periodic(rng, "ab" if rng.random() < 0.5 else "abcdef")]
        got = [tuple(r) for r in P.runs_of_words(words).tolist()]
        assert got == brute_runs(words), words


def test_stretches_lose_no_run():
    rng = random.Random(3)
    for _ in range(200):
        words = periodic(rng, "abc")
        ids = np.array([ord(w) for w in words])
        whole = [tuple(r) for r in P.runs_of(ids, 6, 4).tolist()]
        assert sorted(whole, key=lambda r: (r[0], r[2])) == brute_runs(words)


def test_shorter_runs_are_refused():
    with pytest.raises(ValueError):
        P.runs_of_words([b"a"] * 9, 6, 2)


def test_digests_equal_brute_force(documents):
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(periodic(rng, ["a", "é", "foo", "x y"])))
            for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\r\n\x0b\x0c"), (203, "one"), (204, "z " * 40),
             (205, "a b " * 8), (None, "q " * 30), (7, rows[7][1]), (7, rows[7][1]),
             (-3, "w " * 9), (11, "no period here at all, only words that differ from each other")]
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows)
    docs = documents(rows).withColumns({c: F.lit("own") for c in ("start", "period", "n_runs")})
    got = P.run_digests(docs.repartition(3)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(*r)) for r in rows)


def test_runs_are_listed(documents):
    got = P.find_runs(documents([(1, "x " + "a b " * 4 + "a y"), (2, "nothing"), (3, None)])).collect()
    assert [tuple(r) for r in got] == [(1, 1, 9, 2)]
    assert P.find_runs(documents([]).limit(0)).count() == 0
    assert P.run_digests(documents([]).limit(0)).count() == 0


def test_very_long_text(documents):
    words = [f"w{i % 7}" for i in range(60_000)] + [f"u{i}" for i in range(200_000)] + ["v"] * 50_000
    assert zlib.crc32(b"1") % 10
    row, = P.run_digests(documents([(1, " ".join(words))])).collect()
    assert row[1:6] == (2, 0, 60_000, 7, 8_571_428)
