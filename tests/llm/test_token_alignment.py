import hashlib
import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import functions as F

from vitalcells.llm import token_alignment as T


@pytest.fixture(scope="module")
def tools():
    return T.Aligner(T.BYTE_TOKENIZER, T.PIECE_TOKENIZER)


def brute_tokens(tools, text):
    """Ids and ends of both tokenizers over the whole text, or nothing."""
    raw = (" " + (text or "")).encode()
    if not text:
        return [], [], [], []
    a = tools.a.encode([" " + text])[0]
    b = tools.b.processor.encode(text)
    out = []
    for ids, table in ((a, tools.a.bytes), (b, tools.b.bytes)):
        if b"".join(table[i] for i in ids) != raw:
            return [], [], [], []
        ends, at = [], 0
        for i in ids:
            at += len(table[i])
            ends.append(at)
        out += [ids, ends]
    return tuple(out)


def brute(tools, rows):
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, ends_a, b, ends_b = brute_tokens(tools, text)
        links = [(x, y) for x, e in zip(a, ends_a) for y, f in zip(b, ends_b) if e == f] if len(a) < 3000 else \
            [(x, dict(zip(ends_b, b))[e]) for x, e in zip(a, ends_a) if e in set(ends_b)]
        common = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if low < e <= high)
                                   for ids, ends in ((a, ends_a), (b, ends_b))))
            low = high
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(common), links, ";".join(groups)))
    highest = Counter()
    for (_, y), c in counts.items():
        highest[y] = max(highest[y], c)
    return [(d, na, nb, ng, len(links), sum(counts[p] == highest[p[1]] for p in links),
             sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
            for d, na, nb, ng, links, g in found]


def make(seed=1, n=60):
    rng = random.Random(seed)
    parts = ["hello", " world", "  ", "\n", "\t", "é", "ﬁne", "½", "don't", "12345", "<|endoftext|>", "</s>",
             "<unk>", "<0x41>", "日本語", "🙂", "xyzzy", "Tokenization", ".", ",", "   end", " ", "it's 7%"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, " "), (103, "▁ mark"), (104, "  two"), (None, "no id"),
             (5, "again"), (5, "again"), (106, "x"), (107, "hello world " * 30)]
    return rows


def check(documents, tools, rows, **kind):
    got = T.align_documents(documents(rows).repartition(3), **kind).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(tools, rows)))


def test_equals_brute_force(documents, tools):
    check(documents, tools, make())


def test_small_blocks_and_bundles_do_not_matter(documents, tools):
    rows = make(2) + [(300, "a long one with many words " * 40), (301, "spoilt ▁ after good words " * 20),
                      (302, "w" * 500), (303, "日本語" * 100), (304, "a b " * 100 + " \n " * 20 + "c" * 90)]
    check(documents, tools, rows, block_chars=40, bundle_chars=200, fan_in=3)


def test_fragments_compose_in_any_order(tools):
    rng = random.Random(5)
    for doc_id, text in make(3, 40):
        a, ends_a, b, ends_b = brute_tokens(tools, text)
        if not a:
            continue
        n = ends_a[-1]
        cuts = [0, *sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 8)))), n]
        parts = [T.fragment(a, ends_a, b, ends_b, lo, hi) for lo, hi in zip(cuts, cuts[1:])]
        whole = T.fragment(a, ends_a, b, ends_b, 0, n).groups()
        assert reduce(T.Fragment.compose, parts).groups() == whole
        while len(parts) > 1:  # a random tree
            i = rng.randrange(len(parts) - 1)
            parts[i:i + 2] = [parts[i].compose(parts[i + 1])]
        assert parts[0].groups() == whole
        assert T.Open.load(parts[0].head.dump()) == parts[0].head


def test_blocks_have_the_tokens_of_the_whole(tools):
    for _, text in make(4, 60):
        if not text:
            continue
        blocks = T.blocks_of(text, 7)
        assert "".join(blocks) == " " + text
        for tokens in (tools.a, tools.b):
            assert sum(tokens.encode(blocks), []) == tokens.encode([" " + text])[0]


def test_very_long_text_empty_table_and_other_columns(documents, tools):
    rng = random.Random(6)
    words = ["alpha", "beta,", "gamma\n", "delta 42", "épsilon"]
    rows = [(1, " ".join(rng.choice(words) for _ in range(120_000))), (2, "alpha beta")]
    docs = documents(rows).withColumns({c: F.lit("own") for c in ("uid", "bundle", "pairs", "ok", "block")})
    got = T.align_documents(docs).collect()
    assert sorted(map(tuple, got)) == sorted(brute_long(tools, rows))
    assert T.align_documents(documents([]).limit(0)).count() == 0


def brute_long(tools, rows):
    """As brute, with links and groups in one walk."""
    counts, found = Counter(), []
    for doc_id, text in rows:
        a, ends_a, b, ends_b = brute_tokens(tools, text)
        of_b, j, links, groups, first = dict(zip(ends_b, b)), 0, [], [], 0
        for i, e in enumerate(ends_a):
            if e in of_b:
                links.append((a[i], of_b[e]))
                k = j
                while ends_b[k] < e:
                    k += 1
                groups.append(",".join(map(str, a[first:i + 1])) + "|" + ",".join(map(str, b[j:k + 1])))
                first, j = i + 1, k + 1
        counts.update(links)
        found.append((doc_id, len(a), len(b), links, ";".join(groups)))
    highest = Counter()
    for (_, y), c in counts.items():
        highest[y] = max(highest[y], c)
    return [(d, na, nb, len(x), len(x), sum(counts[p] == highest[p[1]] for p in x), sum(counts[p] for p in x),
             hashlib.sha256(g.encode()).hexdigest()) for d, na, nb, x, g in found]


def test_a_forgetful_task_has_the_same_units(tools, monkeypatch):
    monkeypatch.setattr(T, "MOST_UNITS", 3)
    table = T.UnitTable(tools)
    for _, text in make(7, 30):
        if not text:
            continue
        numbers, = table.numbers([" " + text])
        a, _, b, _ = brute_tokens(tools, text)
        if a:
            assert (table.units.n_a[numbers].sum(), table.units.n_b[numbers].sum()) == (len(a), len(b))
        else:
            assert not table.units.ok[numbers].all()
