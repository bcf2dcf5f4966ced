"""Licence statements in texts: notice phrases, identifier tags and licence expressions.

Words are runs of ASCII letters and digits or characters beyond ASCII, A-Z lower-cased. One
Aho-Corasick automaton finds all phrases and the words that open an identifier tag; what follows a
tag up to the end of its line is parsed as an expression of identifiers, `and`, `or`, `with` and
parentheses by a shunting-yard parser.

Defined results: a null or empty text has no words, no places, empty label lists, null first and
last word and score 0. Repeated rows get equal results; a malformed expression yields the identifiers
before the fault. Other columns are not read.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalcells.llm.arrow import record_batch
from vitalcells.llm.phrases import Phrases, words_in
from vitalcells.llm.textbytes import ALPHANUMERIC, normalised, pieces, words_of

#: Phrases that count as base places, and their labels.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Further notices: phrase, label, weight of the evidence.
NOTICES = (
    ("mit license", "mit", 0.9),
    ("apache license", "apache", 0.9),
    ("bsd license", "bsd", 0.9),
    ("isc license", "isc", 0.9),
    ("mozilla public license", "mpl", 0.9),
    ("eclipse public license", "epl", 0.9),
    ("lesser general public license", "lgpl", 0.9),
    ("affero general public license", "agpl", 0.9),
    ("gnu general public license", "gpl", 0.9),
    ("creative commons attribution", "cc-by", 0.9),
    ("cc by nc", "cc-by-nc", 0.9),
    ("cc by sa", "cc-by-sa", 0.9),
    ("cc by nd", "cc-by-nd", 0.9),
    ("cc0", "cc0", 0.8),
    ("released into the public domain", "public-domain", 0.9),
    ("dedicated to the public domain", "public-domain", 0.9),
    ("licensed under the", "licensed", 0.3),
    ("released under the", "licensed", 0.3),
)
BASE_WEIGHT = {"cc-by": 0.7, "gpl": 0.8, "reserved": 0.5}
#: Words that open an identifier tag.
TAGS = ("spdx license identifier", "spdx-license-identifier")
TAG_WEIGHT = 0.95
#: How much a licence asks of those who pass a work on: 0 nothing, 1 all rights kept.
DEMANDS = (
    (r"cc0|unlicense|0bsd|public-domain", 0.0),
    (r"mit|isc|bsd|apache|zlib|cc-by(-\d.*)?$", 0.2),
    (r"lgpl|mpl|epl|cddl", 0.5),
    (r"agpl", 0.9),
    (r"gpl|cc-by-sa", 0.7),
    (r"cc-by-n[cd]", 0.8),
)
UNKNOWN_DEMAND = 1.0
EXCEPTION = 0.7
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_BINDS = {"or": 1, "and": 2, "with": 3}


def demand_of(identifier: str) -> float:
    return next((v for p, v in DEMANDS if re.match(p, identifier)), UNKNOWN_DEMAND)


def _apply(op: str, values: list[tuple[frozenset, float]]) -> bool:
    """One operator on the two topmost values: `or` lets one choose, `and` asks for both, and an
    exception lightens its licence."""
    if len(values) < 2:
        return False
    (names_b, b), (names_a, a) = values.pop(), values.pop()
    if op == "with":
        values.append((frozenset(f"{n} with {m}" for n in names_a for m in names_b), a * EXCEPTION))
    else:
        values.append((names_a | names_b, min(a, b) if op == "or" else max(a, b)))
    return True


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Licences named by an expression and what it asks for; None without any.

    Shunting yard: values wait on one stack and operators on another until what binds less follows.
    Text after the expression, such as the end of a comment, ends it.
    """
    values: list[tuple[frozenset, float]] = []
    operators: list[str] = []
    at, expects_value = 0, True
    while match := _TOKEN.match(expression, at):
        bracket, word = match.groups()
        name = (word or "").lower()
        if expects_value:
            if bracket == "(":
                operators.append("(")
            elif word and name not in _BINDS:
                values.append((frozenset([name]), demand_of(name)))
                expects_value = False
            else:
                break
        elif bracket == ")":
            if "(" not in operators:
                break
            while operators[-1] != "(":
                _apply(operators.pop(), values)
            operators.pop()
        elif name in _BINDS:
            while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[name]:
                _apply(operators.pop(), values)
            operators.append(name)
            expects_value = True
        else:
            break
        at = match.end()
    if expects_value and operators and operators[-1] != "(":
        operators.pop()  # an operator without its right side
    while operators:
        op = operators.pop()
        if op != "(":
            _apply(op, values)
    if not values:
        return None
    names = set().union(*(n for n, _ in values))
    return names, max(v for _, v in values)


def _automaton() -> Phrases:
    return Phrases(
        [(words_in(p), ("base", label, BASE_WEIGHT[label])) for p, label in BASE_PHRASES]
        + [(words_in(p), ("notice", label, weight)) for p, label, weight in NOTICES]
        + [(words_in(p), ("tag", "", TAG_WEIGHT)) for p in TAGS[:1]])


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double, demand double")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _scan(batches):
    phrases = _automaton()
    lengths = np.array(phrases.lengths)
    for batch in batches:
        for rows, texts in pieces(batch):
            words = words_of(texts, ALPHANUMERIC)
            phrase, word = phrases.find(*normalised(texts, words))
            row = np.searchsorted(words.first, word, "right") - 1
            n = len(texts)
            n_base, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
            base = [set() for _ in range(n)]
            labels = [set() for _ in range(n)]
            doubt, demand = np.ones(n), np.zeros(n)
            for p, w, r in zip(phrase.tolist(), word.tolist(), row.tolist()):
                for kind, label, weight in phrases.values[p]:
                    at = w - int(words.first[r])
                    if kind == "base":
                        n_base[r] += 1
                        first[r] = at if first[r] is None else min(first[r], at)
                        last[r] = at if last[r] is None else max(last[r], at)
                        base[r].add(label)
                    if kind == "tag":
                        end = int(words.ends[w + lengths[p] - 1])
                        rest = texts.data[end:texts.offsets[r + 1]].tobytes()
                        line = rest.split(b"\n", 1)[0].decode(errors="replace").lstrip(": \t\"'")
                        if (found := evaluate(line)) is None:
                            continue
                        labels[r] |= found[0]
                        demand[r] = max(demand[r], found[1])
                    else:
                        labels[r].add(label)
                        if label != "licensed":
                            demand[r] = max(demand[r], demand_of(label))
                    doubt[r] *= 1 - weight
            yield record_batch(
                NAMES, rows.column("doc_id"), words.counts.astype(np.int64), n_base,
                pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                pa.array([",".join(sorted(x)) for x in base], pa.string()),
                pa.array([",".join(sorted(x)) for x in labels], pa.string()), 1 - doubt, demand)


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document: base places and labels, all labels, the evidence for a licence statement (score,
    0 to 1), and what the strictest licence found asks for (demand, 0 to 1)."""
    return (docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan, SCHEMA))
