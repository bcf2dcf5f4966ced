import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vitalcells.llm import chat_format as C
from vitalcells.llm import mixing as M
from vitalcells.llm import secret_scan as S


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    odd = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "a # b"), (1, 1, "assistant", odd), (1, 2, "user", ""), (1, 3, "assistant", None),
            (2, 0, "assistant", "\\b\\h\\l\\\\bé"), (2, 0, "assistant", "\\b\\h\\l\\\\bé"),
            (3, None, None, "x"), (3, 1, "we:ird\n\\role<", "\n\n"), (None, 0, "user", "lost"),
            (4, 5, "assistant", "one\n</turn>\n### user:\n"), (4, 2, "system", "first")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)]
    chats = C.format_conversations(conversations(spark, rows).withColumn("rank", F.lit("x")))
    got = {r.conv_id: r for r in C.digests(chats).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is None, t or 0), (r is not None, r or ""), (x is not None, x or ""), r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda t: t[:3])
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for *_, r, x in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    text = chats.where("conv_id = 1").first().formatted
    assert text.count("</turn>") == 4 and text.count("### ") == 4


def test_reply_trees(spark, tmp_path):
    from vitalcells.llm.scratch import Scratch

    rows = [("t", 1, None, "user", "root", 1.0), ("t", 2, 1, "assistant", "good", 5.0),
            ("t", 3, 1, "assistant", "bad", 0.0), ("t", 4, 2, "user", "more", 3.0),
            ("t", 5, 4, "assistant", "end", 3.0), ("t", 6, 7, "user", "circle", 9.0),
            ("t", 7, 6, "user", "circle", 9.0), ("u", 1, 99, "user", "alone", None)]
    messages = spark.createDataFrame(
        rows, "tree string, message long, parent long, role string, text string, score double")
    found = {(r.tree, r["rank"]): [t.text for t in r.turns]
             for r in C.paths(messages, Scratch(spark, "t")).collect()}
    assert found == {("t", 1): ["root", "good", "more", "end"], ("t", 2): ["root", "bad"], ("u", 1): ["alone"]}
    assert C.paths(messages, Scratch(spark, "t"), best=1).count() == 2


def test_empty_conversations(spark):
    assert C.digests(C.format_conversations(conversations(spark, []).limit(0))).count() == 0


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(out.values())
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        for s in over:
            out[s] = 3 * sizes[s]
            free.discard(s)
    return out


def test_mixing(spark, documents):
    rows = [(i, "w " * (i * 37 % 50), "en", f"s{i % 7 if i % 3 else 0}") for i in range(900)]
    rows += [(2000, None, "en", "s1"), (2001, "a b c", "en", None), (2002, " ", "en", "blank"), (5, "x y", "en", "s1"),
             (5, "x y", "en", "s1"), (None, "n n n", "en", "s2")]
    mixed = M.mix(documents(rows).withColumn("share", F.lit(1)).withColumn("size", F.lit("x")))
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 100, (s, t, want[s])
    assert sum(taken.values()) <= sum(sizes.values())
    again = M.mix(documents(rows[::-1])).collect()
    key = lambda r: repr((r.doc_id, r.source, r["size"], r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again))
    order = [r.finish for r in M.serving_order(mixed, 3).collect()]
    assert order == sorted(order)


@pytest.mark.parametrize("rows", [[], [(1, None, "en", None)], [(1, "a", "en", "s"), (2, "a", "en", "s")]])
def test_mixing_small(documents, rows):
    got = M.mix(documents(rows).limit(len(rows))).collect()
    assert sorted(r.taken for r in got) == sorted(len((r[1] or "").split()) for r in rows)


SECRET = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"


def test_secrets(documents):
    rows = [(i, f"some words token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and more", "en", "s")
            for i in range(40)]
    rows += [(100 + i, f"card {4000000000000000 + i * 7919} is here, and /usr/share/images{i}/index{i}.html", "en", "s")
             for i in range(40)]
    rows += [(300, f"TOKEN = \"{SECRET.upper()}\"!! x", "en", "s"), (301, None, "en", "s"), (302, "", "en", "s"),
             (None, f"password:{SECRET}", "en", "s"), (0, rows[0][1], "en", "s")]
    docs = documents(rows).withColumn("value", F.lit(1)).withColumn("label", F.lit(1))
    found = S.scan(docs).collect()
    verdict = defaultdict(set)
    for r in found:
        verdict[r.doc_id].add(r.secret)
    assert all(verdict[i] == {True} for i in (*range(40), 300, None))
    assert all(verdict[100 + i] == {False} for i in range(40))
    out = S.redacted(docs).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == docs.first().asDict().keys()
    text = {r.doc_id: r.text for r in out}
    assert text[300] == 'TOKEN = "[secret]"!! x' and text[None] == "password:[secret]"
    assert text[301] is None and text[100] == rows[40][1]
    assert S.report(S.scan(docs)).where("secret").count() == 43


HEX = "3f9c1b7ae0d24c58a6b1"
FORMS = [(f"run TOKEN={HEX} now", HEX), (f"set password={HEX} now", HEX), (f"get /a?token={HEX}&b=1 now", HEX),
         (f"aws2_secret_access_key={HEX} now", HEX), (f"a {HEX}0=1&token={HEX}== now", f"{HEX}=="),
         ('secret_access_key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY" x', "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
         ("use ghp_a1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8 here", "ghp_a1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8"),
         (f"Authorization: Bearer {HEX} x", HEX), ('password = "hunter2" x', "hunter2"),
         ("password: correcthorsebattery\nuser: me", "correcthorsebattery"),
         ('secret_key="qwErtYuiOpasDfghJkLz" x', "qwErtYuiOpasDfghJkLz")]
OTHERS = ["password = os.environ.get(1)", "the password: something that you know", f"commit {HEX} was made",
          "author: Johannes Brahms", 'token = "example" x', "token: /usr/share/images1/index1.html x"]


def test_forms_of_secrets(documents):
    rows = [(i, text) for i, (text, _) in enumerate(FORMS)] + [(100 + i, t) for i, t in enumerate(OTHERS)]
    found = defaultdict(set)
    for r in S.features(S.candidates(documents(rows))).withColumn("label", S.rule_label()).collect():
        if r.label:
            found[r.doc_id].add(r.value)
    assert found == {i: {value} for i, (_, value) in enumerate(FORMS)}
    many = [(d + 1000 * k, t) for d, t in rows for k in range(20)]
    secret = {r.doc_id for r in S.scan(documents(many)).where("secret").collect()}
    assert secret == {i + 1000 * k for i in range(len(FORMS)) for k in range(20)}
    assert {r.text for r in S.redacted(documents([(1, 'password="hunter" hunters x')])).collect()} == {
        'password="[secret]" hunters x'}


def test_secrets_without_candidates(documents):
    docs = documents([(1, "plain words"), (2, None)])
    assert S.scan(docs).count() == 0 and S.redacted(docs).count() == 2
    assert S.redacted(documents([]).limit(0)).count() == 0


def test_labelled_findings_of_the_caller(spark, documents):
    labelled = spark.createDataFrame(
        [(f'"{SECRET[i:]}{i}"', "=", "hash", "x", f"{SECRET[i:]}{i}", 0) for i in range(15)]
        + [(f"KEY{i}ABCDEFGHIJKLMNO", "use", "to", "x", f"KEY{i}ABCDEFGHIJKLMNO", 1) for i in range(15)],
        "token string, before string, before2 string, after string, value string, label int")
    docs = documents([(1, "to use KEY7ABCDEFGHIJKLMNO x"), (2, f'hash = "{SECRET}" x')])
    assert {r.doc_id: r.secret for r in S.scan(docs, labelled).collect()} == {1: True, 2: False}
