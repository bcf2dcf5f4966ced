"""Periodic runs of words: Lyndon arrays by Baier's grouping, roots extended to runs.

Every run has a root that is the longest Lyndon word at its start under one of the two orders of the
words. The first phase of Baier's suffix sorting groups suffixes by exactly that word, so its groups
give the Lyndon array without sorting any suffix. Each root is extended to both sides by how far the
text agrees with itself one root later (longest common extensions); a root whose extension covers a
whole root more belongs to a run, whose period is the root's length.

Only stretches that can hold a run of the wanted length are grouped: in a run of at least 6 words and
4 periods every three words in a row occur three times or more in the text, so what lies between such
triples holds none, and a wanted run lies inside one stretch with all its words. This is exact.

Defined results: a null text has no words; a text of any length is one document in one task, in
memory of a few numbers per word, and per word and doubling of the length within stretches; repeated
rows have a result each; a null doc_id has no number to derive a change of the text from, so its text
is left as it is; an empty table has an empty result; other columns are not read.
"""

import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalcells.llm.arrow import record_batch
from vitalcells.llm.textbytes import pieces

LEAST_WORDS = 6
LEAST_PERIODS = 4

RUNS = "doc_id long, start long, length long, period long"
DIGEST = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def lyndon_array(text: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place of a text, by Baier's grouping.

    Suffixes are grouped by first letter. Groups are taken from the highest to the lowest; each suffix
    of a group extends the word of the nearest lower suffix before it, which moves to a group of its
    own right above its old one, the higher the more words it took in. What is left in a group when
    its turn comes is final.
    """
    n = len(text)
    letters = sorted(set(text))
    number = {letter: g for g, letter in enumerate(letters)}
    group = [number[letter] for letter in text]
    size = [1] * len(letters)
    below = list(range(-1, len(letters) - 1))
    above = list(range(1, len(letters) + 1))
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    result = [0] * n
    lower = [-1] * n  # a suffix before, with only finished ones in between, once known
    g = len(letters) - 1
    while g >= 0:
        length = size[g]
        taken: dict[int, int] = {}
        for i in sorted(i for i in members[g] if group[i] == g):
            result[i] = length
            j = i - 1
            while j >= 0 and result[j]:
                k = lower[j]
                if k >= 0 and result[k]:  # shorten the way for those who come later
                    k = lower[j] = lower[k]
                j = k
            lower[i] = j
            if j >= 0:
                taken[j] = taken.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, count in taken.items():
            by_count.setdefault(count, []).append(j)
        # The highest count goes right above its old group first, so that lower ones end up below it.
        for count in sorted(by_count, reverse=True):
            fresh: dict[int, int] = {}
            for j in by_count[count]:
                old = group[j]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(size)
                    size.append(size[old] + count * length)
                    members.append([])
                    top = above[old]
                    below.append(old)
                    above.append(top)
                    above[old] = below[top] = new
                members[new].append(j)
                group[j] = new
        g = below[g]
    return result


class _Windows:
    """Which windows of 2**k words are equal, for exact common extensions by halving steps."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.ranks = [np.unique(ids, return_inverse=True)[1]]
        step = 1
        while 2 * step <= self.n:
            last = self.ranks[-1]
            pair = last[:-step] * np.int64(self.n + 1) + last[step:]
            self.ranks.append(np.unique(pair, return_inverse=True)[1])
            step *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from a and from b on, a < b."""
        a, b = a.copy(), b.copy()
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[k], 1 << k
            fits = b + step <= self.n
            same = fits & (rank[np.where(fits, a, 0)] == rank[np.where(fits, b, 0)])
            done += same * step
            a += same * step
            b += same * step
        return done

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree before a and before b, a < b."""
        a, b = a.copy(), b.copy()
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[k], 1 << k
            fits = a >= step
            same = fits & (rank[np.where(fits, a - step, 0)] == rank[np.where(fits, b - step, 0)])
            done += same * step
            a -= same * step
            b -= same * step
        return done


def runs_of(ids: np.ndarray, least: int, periods: int) -> np.ndarray:
    """Runs (start, length, period) of a sequence of numbers, sorted, each once."""
    n = len(ids)
    if n < max(least, 2):
        return np.zeros((0, 3), np.int64)
    letters = np.unique(ids, return_inverse=True)[1]
    windows = _Windows(letters)
    at = np.arange(n)
    found = []
    for order in (letters, letters.max() - letters):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        inside = at + period < n
        start, q = at[inside], period[inside]
        ahead = windows.forward(start, start + q)
        behind = windows.backward(start, start + q)
        length = behind + q + ahead
        keep = (length >= periods * q) & (length >= least)
        found.append(np.stack([start - behind, length, q], axis=1)[keep])
    return np.unique(np.concatenate(found), axis=0)


def _stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Where every three words in a row occur at least three times; no wanted run lies elsewhere."""
    n = len(ids)
    if n < least:
        return []
    wide = np.int64(n + 1)
    pairs, pair, often = np.unique(ids[:-1] * wide + ids[1:], return_inverse=True, return_counts=True)
    often = often[pair] >= 3
    often = often[:-1] & often[1:]
    triples = np.flatnonzero(often)
    if len(triples) < least - 2:
        return []
    _, triple, count = np.unique(pair[triples] * wide + ids[triples + 2], return_inverse=True,
                                 return_counts=True)
    good = np.zeros(n, np.int8)
    good[triples[count[triple] >= 3]] = 1
    edge = np.diff(good, prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 2
    return [(int(a), int(b)) for a, b in zip(starts, ends) if b - a >= least]


def runs_of_words(words: list[bytes], least: int = LEAST_WORDS,
                  periods: int = LEAST_PERIODS) -> np.ndarray:
    """Runs (start, length, period) of at least `least` words and `periods` periods, by start."""
    if least < 6 or periods < 4:
        raise ValueError("stretches are told from runs of at least 6 words and 4 periods")
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    parts = []
    for a, b in _stretches(ids, least):
        found = runs_of(ids[a:b], least, periods)
        found[:, 0] += a
        parts.append(found)
    if not parts:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(parts)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _documents(batch: pa.RecordBatch):
    """Ids and words of some rows at a time; bytes are split at the six ASCII spaces only."""
    for rows, texts in pieces(batch):
        yield rows.column("doc_id").to_pylist(), [texts[i].split() for i in range(len(texts))]


def changed(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Words of one document of ten, by its id, continued with a period of its own."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * ((n - a) // p + 1))[:n - a]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    return [words[i] for i in kept.tolist()]


def find_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """All periodic runs of the texts as they are: doc_id, start, length, period."""

    def run(batches):
        for ids, texts in chain.from_iterable(map(_documents, batches)):
            found = [runs_of_words(words, least, periods) for words in texts]
            owner = pa.array([d for d, f in zip(ids, found) for _ in range(len(f))], pa.int64())
            runs = np.concatenate(found)
            yield record_batch(["doc_id", "start", "length", "period"], owner, *runs.T)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, RUNS)


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one, and digests of all runs and of the text
    without repeated periods; one document of ten is made periodic first (`changed`)."""

    def run(batches):
        for ids, texts in chain.from_iterable(map(_documents, batches)):
            rows = []
            for doc_id, words in zip(ids, texts):
                words = changed(words, doc_id)
                runs = runs_of_words(words)
                longest = (None,) * 4
                if len(runs):
                    start, length, period = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
                    longest = (start, length, period, 1000 * length // period)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
                rows.append((doc_id, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(),
                             hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield record_batch(["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                                "runs_sha256", "collapsed_sha256"],
                               *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)))

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, DIGEST)
