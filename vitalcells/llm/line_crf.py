"""Document quality from a linear-chain conditional random field over the lines of a text.

Each line is good or bad. Its features are counted from its bytes (kinds of characters, lengths,
repetition), beside those of the lines before and after it. Forward-backward sums give each line's
probability of being good; weighted by the lines' lengths they give the document's, which is then
calibrated. The field is trained on a bounded sample of labelled documents, whose lines carry the
label of their document; labels, language, source and id are no inputs of a score.

Defined results: null and empty texts have no line and score the calibrated share of good lines.
Without labels of both kinds every document scores the share of the labels seen, one half without
any. Repeated rows get equal results; other columns are not read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcells.llm import labelled
from vitalcells.llm.arrow import longs, record_batch
from vitalcells.llm.quality_rules import lines_of, repeated, _row_keys
from vitalcells.llm.textbytes import LOWER, NOT_SPACE, Hasher, Texts, pieces, words_of

GOOD_FROM = 0.7
#: One labelled document in CALIBRATE calibrates.
CALIBRATE = 3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_KINDS = [np.isin(np.arange(256), list(k)) for k in (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"#*$%&",
    b"<>{}[]\\/_=", b"!", b".,;:?", b" \t")] + [np.arange(256) >= 0x80]


def line_features(texts: Texts):
    """Features of each line, its row and its length."""
    start, end, row = lines_of(texts)
    n = len(start)
    words = words_of(texts, NOT_SPACE)
    size = (end - start).astype(np.float64)
    out = [np.log1p(size)]

    def inside(flags):
        total = np.zeros(len(flags) + 1)
        np.cumsum(flags, out=total[1:])
        return total[end] - total[start]

    out += [inside(kind[texts.data]) / np.maximum(size, 1) for kind in _KINDS]
    a, b = np.searchsorted(words.starts, start), np.searchsorted(words.starts, end)
    n_words = (b - a).astype(np.float64)
    out += [np.log1p(n_words), size / np.maximum(n_words, 1) / 10, n_words == 0]
    hasher = Hasher(texts.data, True)
    hashes = hasher.ranges(words.starts, words.ends)
    # Words of the line met earlier in the text, and lines met elsewhere in it.
    _, met = repeated(_row_keys(hashes, words.rows))
    total = np.zeros(len(met) + 1)
    np.cumsum(met, out=total[1:])
    out.append((total[b] - total[a]) / np.maximum(n_words, 1))
    # Words that repeat the one before them.
    stutter = np.zeros(len(hashes), bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (words.rows[1:] == words.rows[:-1])
    total = np.zeros(len(met) + 1)
    np.cumsum(stutter, out=total[1:])
    out.append((total[b] - total[a]) / np.maximum(n_words, 1))
    again, later = repeated(_row_keys(hasher.ranges(start, end), row))
    out += [again, later]
    # Words that begin with a capital, and words that end in a symbol.
    lead = texts.data[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    tail = texts.data[words.ends - 1] if len(words.starts) else np.zeros(0, np.uint8)
    for flags in (LOWER[lead] != lead, np.isin(tail, list(b"#*$%&!|"))):
        total = np.zeros(len(flags) + 1)
        np.cumsum(flags, out=total[1:])
        out.append((total[b] - total[a]) / np.maximum(n_words, 1))
    count = np.bincount(row, minlength=len(texts))
    out.append(np.log1p(count[row]))
    table = np.stack(out, axis=1).astype(np.float64) if n else np.zeros((0, len(out)))
    return table, row, size


def with_neighbours(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its text, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = (row[1:] == row[:-1])[:, None]
        before[1:] = x[:-1] * same
        after[:-1] = x[1:] * same
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


class Chains:
    """Lines of several texts, by place in the text: step t has the t-th line of all texts that
    have one, longest texts first."""

    def __init__(self, row: np.ndarray):
        count = np.bincount(row) if len(row) else np.zeros(0, np.int64)
        place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        self.order = np.lexsort((rank[row], place))
        ends = np.cumsum(np.bincount(place)) if len(row) else np.zeros(0, np.int64)
        self.steps = [slice(a, b) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def marginals(self, margin: np.ndarray, link: np.ndarray):
        """Probability of good per line, the summed probabilities of neighbouring states, and the
        log of the sum over all labellings. margin: score of good over bad; link: 2 x 2 scores."""
        n = len(margin)
        # Ratio form: a is the log ratio of good to bad of the forward sums.
        u = margin[self.order]
        forward, back = np.zeros(n), np.zeros(n)
        logz = 0.0
        base = np.zeros(0)
        for t, step in enumerate(self.steps):
            if t == 0:
                forward[step] = u[step]
                base = np.zeros(step.stop - step.start)
                continue
            k = step.stop - step.start
            last = forward[self.steps[t - 1]]
            logz += np.logaddexp(last[k:], 0).sum() + base[k:].sum()
            last = last[:k]
            to_bad = np.logaddexp(link[0, 0], last + link[1, 0])
            to_good = np.logaddexp(link[0, 1], last + link[1, 1])
            base = base[:k] + to_bad
            forward[step] = u[step] + to_good - to_bad
        if self.steps:
            logz += np.logaddexp(forward[self.steps[-1]], 0).sum() + base.sum()
        pairs = np.zeros((2, 2))
        for t in range(len(self.steps) - 2, -1, -1):
            step, nxt = self.steps[t], self.steps[t + 1]
            k = nxt.stop - nxt.start
            ahead = back[nxt] + u[nxt]
            from_bad = np.logaddexp(link[0, 0], ahead + link[0, 1])
            from_good = np.logaddexp(link[1, 0], ahead + link[1, 1])
            back[step.start:step.start + k] = from_good - from_bad
            left = forward[step.start:step.start + k]
            cells = np.stack([np.full(k, link[0, 0]), ahead + link[0, 1],
                              left + link[1, 0], left + ahead + link[1, 1]])
            cells = np.exp(cells - cells.max(0))
            pairs += (cells / cells.sum(0)).sum(1).reshape(2, 2)
        good = np.empty(n)
        good[self.order] = labelled.sigmoid(forward + back)
        return good, pairs, logz


@dataclass
class Field:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    link: np.ndarray
    slope: float
    shift: float
    prior: float

    def line_probabilities(self, table: np.ndarray, row: np.ndarray) -> np.ndarray:
        x = with_neighbours((table - self.mean) / self.spread, row)
        return Chains(row).marginals(x @ self.weights, self.link)[0]

    def margins(self, texts: Texts) -> np.ndarray:
        """Log odds of each text's length-weighted share of good lines."""
        table, row, size = line_features(texts)
        share = np.full(len(texts), self.prior)
        if len(row):
            weight = size + 1
            good = np.bincount(row, weight * self.line_probabilities(table, row), len(texts))
            total = np.bincount(row, weight, len(texts))
            share = np.where(total > 0, good / np.maximum(total, 1), share)
        share = np.clip(share, 1e-4, 1 - 1e-4)
        return np.log(share / (1 - share))

    def scores(self, texts: Texts) -> np.ndarray:
        return labelled.sigmoid(self.margins(texts) * self.slope + self.shift)


def train(docs: list[bytes], y: np.ndarray, steps: int = 120) -> Field:
    """The field from whole labelled texts; part of them calibrates its scores."""
    def texts_at(at):
        raw = [docs[i] for i in at]
        return Texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    held = np.arange(len(docs)) % CALIBRATE == 0
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        held[:] = False
    fitted = np.flatnonzero(~held)
    table, row, size = line_features(texts_at(fitted))
    label = y[fitted][row]
    mean, spread = table.mean(0), table.std(0) + 1e-6
    x = with_neighbours((table - mean) / spread, row)
    chains, width = Chains(row), x.shape[1]
    same = row[1:] == row[:-1]
    links = np.zeros((2, 2))
    np.add.at(links, (label[:-1][same].astype(int), label[1:][same].astype(int)), 1)

    def gradient(values):
        link = values[width:].reshape(2, 2)
        good, pairs, _ = chains.marginals(x @ values[:width], link)
        up = np.concatenate([(label - good) @ x, (links - pairs).ravel()]) / len(row)
        return up - 0.003 * values

    values = labelled.ascend(gradient, np.zeros(width + 4), steps, 0.1)
    prior = float(y[fitted].mean())
    field = Field(mean, spread, values[:width], values[width:].reshape(2, 2), 1.0, 0.0, prior)
    judged = np.flatnonzero(held) if held.any() else fitted
    field.slope, field.shift = labelled.calibrate(field.margins(texts_at(judged)), y[judged])
    return field


def fit(docs: DataFrame, labels: DataFrame, most: int = labelled.MOST_LABELLED,
        condition: str = "true") -> Field | float:
    """The field, or the share of good labels where they are all alike."""
    rows = labelled.sample(docs, labels, most, condition).toArrow()
    order = np.argsort(longs(rows.column("doc_id").combine_chunks()), kind="stable")
    y = rows.column("quality").to_numpy().astype(np.float64)[order]
    if len(y) == 0 or y.min() == y.max():
        return float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    texts = rows.column("text")
    raw = [(texts[i].as_py() or "").encode() for i in order.tolist()]
    if not any(raw):
        return float(y.mean())
    return train(raw, y)


def _score(field, good_from: float):
    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch):
                score = (np.full(len(texts), field) if isinstance(field, float)
                         else field.scores(texts))
                yield record_batch(["doc_id", "held_out", "score", "predicted"],
                                   rows.column("doc_id"), rows.column("held_out"), score,
                                   (score >= good_from).astype(np.int32))

    return run


def score_documents(docs: DataFrame, labels: DataFrame, most: int = labelled.MOST_LABELLED,
                    folds: int = 4, held_fold: int = 2, good_from: float = GOOD_FROM) -> DataFrame:
    """Score of every document; labels are learned from the folds of crc32(doc_id) that are not held."""
    fold = f"pmod(crc32(cast(cast(doc_id as long) as string)), {folds})"
    field = fit(docs, labels, most, f"{fold} != {held_fold}")
    held = F.coalesce(F.expr(f"{fold} = {held_fold}"), F.lit(False))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
            .mapInArrow(_score(field, good_from), SCHEMA))
