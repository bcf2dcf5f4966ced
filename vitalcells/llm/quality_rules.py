"""Quality rules: counted rules, and a calibrated classifier against a fixed threshold.

Words are runs of anything but ASCII white space. The classifier is a logistic regression on hashed
words and character trigrams (bytes), as square roots of their shares in the text, fitted on a bounded
sample of labelled rows; part of the sample calibrates its probabilities. Texts are scored whole, in
Arrow batches.

Defined results: null and empty texts have zero counts and fail the base rules. Without labels of
both kinds the classifier gives every text the same probability, that of the labels seen, and keeps
what the base rules keep. Repeated rows get equal results; other columns are not read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalcells.llm import labelled
from vitalcells.llm.arrow import longs, record_batch
from vitalcells.llm.textbytes import (NOT_SPACE, Hasher, Texts, mix, pieces, row_sums, words_of)

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW = 8
#: Hashed columns for words and for trigrams.
WORD_COLUMNS, GRAM_COLUMNS, GRAM = 1024, 2048, 3
#: Documents less likely than this to be of quality are rejected.
KEEP_FROM = 0.3
#: One labelled document in CALIBRATE calibrates.
CALIBRATE = 4
_ROWS = 256

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, quality double")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which have occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def _row_keys(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mix(hashes + mix(rows.astype(np.uint64) + np.uint64(1)))


def lines_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the lines of each text, split at line ends; empty texts have none."""
    feeds = np.flatnonzero(texts.data == 0x0A)
    filled = texts.sizes > 0
    starts = np.sort(np.concatenate([texts.offsets[:-1][filled], feeds + 1]))
    ends = np.sort(np.concatenate([texts.offsets[1:][filled], feeds]))
    # A line end that closes a text leaves an empty last line of its own text.
    own = np.searchsorted(texts.offsets, feeds, "right") - 1
    rows = np.repeat(np.arange(len(texts)), filled + np.bincount(own, minlength=len(texts)))
    return starts, ends, rows


def counts(texts: Texts):
    """Words and the base counts of each text."""
    words = words_of(texts, NOT_SPACE)
    hasher = Hasher(texts.data, False)
    n, first = len(texts), words.first
    inside = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(NOT_SPACE[texts.data] & ((texts.data & 0xC0) != 0x80), out=inside[1:])
    chars = inside[texts.offsets[1:]] - inside[texts.offsets[:-1]]
    symbols = row_sums(SYMBOLS[texts.data], texts.offsets)

    start, end, row = lines_of(texts)
    has_word = np.searchsorted(words.starts, start) < np.searchsorted(words.starts, end)
    start, end, row = start[has_word], end[has_word], row[has_word]
    _, later = repeated(_row_keys(hasher.ranges(start, end), row))
    dup_lines = np.bincount(row[later], minlength=n)

    hashes = hasher.ranges(words.starts, words.ends)
    total = max(len(hashes) - WINDOW + 1, 0)
    windows = np.zeros(total, np.uint64)
    for i in range(WINDOW):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + total]
    rows = words.rows
    whole = rows[:total] == rows[WINDOW - 1:WINDOW - 1 + total]
    at = np.flatnonzero(whole)
    again, _ = repeated(_row_keys(mix(windows[at]), rows[at]))
    at = at[again]
    depth = (np.bincount(at, minlength=len(hashes) + 1)
             - np.bincount(at + WINDOW, minlength=len(hashes) + 1))
    covered = row_sums(np.cumsum(depth)[:len(hashes)] > 0, first)
    return words, hashes, hasher, (words.counts, chars, symbols, dup_lines, covered)


def features(texts: Texts, words, hashes, hasher) -> np.ndarray:
    """Square roots of the shares of hashed words and trigrams, one row per text."""
    n, grams = len(texts), hasher.grams(GRAM)
    row = np.repeat(np.arange(n), texts.sizes)[:len(grams)]
    own = row == np.repeat(np.arange(n), texts.sizes)[GRAM - 1:GRAM - 1 + len(grams)]
    out = []
    for rows, values, columns in ((words.rows, hashes, WORD_COLUMNS),
                                  (row[own], grams[own], GRAM_COLUMNS)):
        cell = rows * columns + (values & np.uint64(columns - 1)).astype(np.int64)
        table = np.bincount(cell, minlength=n * columns).reshape(n, columns)
        out.append(np.sqrt(table / np.maximum(table.sum(1, keepdims=True), 1)))
    return np.concatenate(out, axis=1).astype(np.float32)


def _small(texts: Texts):
    """At most _ROWS rows at a time, to bound the feature table."""
    for a in range(0, len(texts), _ROWS):
        at = texts.offsets[a:a + _ROWS + 1]
        yield Texts(texts.data[at[0]:at[-1]], at - at[0])


@dataclass
class Classifier:
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.intercept
        return labelled.sigmoid(margin * self.slope + self.shift)


def _feature_rows(batches):
    for batch in batches:
        for rows, texts in pieces(batch):
            done = 0
            for part in _small(texts):
                words = words_of(part, NOT_SPACE)
                hasher = Hasher(part.data, False)
                x = features(part, words, hasher.ranges(words.starts, words.ends), hasher)
                own = rows.slice(done, len(part))
                done += len(part)
                packed = [row.astype(np.float16).tobytes() for row in x]
                yield record_batch(["doc_id", "quality", "x"], own.column("doc_id"),
                                   own.column("quality"), pa.array(packed, pa.binary()))


def fit(docs: DataFrame, labels: DataFrame, most: int = labelled.MOST_LABELLED) -> Classifier:
    """Classifier of quality from at most `most` labelled documents."""
    rows = (labelled.sample(docs, labels, most)
            .mapInArrow(_feature_rows, "doc_id long, quality int, x binary").toArrow())
    width = WORD_COLUMNS + GRAM_COLUMNS
    order = np.argsort(longs(rows.column("doc_id").combine_chunks()), kind="stable")
    y = rows.column("quality").to_numpy().astype(np.float64)[order]
    if len(y) == 0 or y.min() == y.max():
        # Nothing to tell apart: the share of quality among the labels, one half without any.
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Classifier(np.zeros(width, np.float32), float(np.log(share / (1 - share))), 1.0, 0.0)
    x = np.zeros((len(y), width), np.float32)
    packed = rows.column("x")
    for i, j in enumerate(order.tolist()):
        x[i] = np.frombuffer(packed[j].as_py(), np.float16)
    held = np.arange(len(y)) % CALIBRATE == 0
    if len(np.unique(y[~held])) < 2:
        held[:] = False
    weights, intercept = labelled.logistic(x[~held], y[~held])
    weights = weights.astype(np.float32)
    slope, shift = labelled.calibrate(x[held] @ weights + intercept, y[held])
    return Classifier(weights, intercept, slope, shift)


def _score(classifier: Classifier, keep_from: float):
    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch):
                done = 0
                for part in _small(texts):
                    words, hashes, hasher, base = counts(part)
                    quality = classifier.probability(features(part, words, hashes, hasher))
                    n_words, repeats = base[0], base[4]
                    failed = (n_words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED_PERCENT * n_words)
                    own = rows.slice(done, len(part)).column("doc_id")
                    done += len(part)
                    yield record_batch(NAMES, own, *(b.astype(np.int64) for b in base), failed,
                                       ~failed & (quality >= keep_from), quality.astype(np.float64))

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = labelled.MOST_LABELLED,
                  keep_from: float = KEEP_FROM) -> DataFrame:
    """Per document: the base counts, whether they fail the base rules, the classifier's probability
    of quality, and whether the document is kept."""
    classifier = fit(docs, labels, most)
    return (docs.selectExpr("cast(doc_id as long) doc_id", "text")
            .mapInArrow(_score(classifier, keep_from), SCHEMA))



def kept(docs: DataFrame, labels: DataFrame, most: int = labelled.MOST_LABELLED,
         keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that quality_rules keeps, with all their columns."""
    judge = _score(fit(docs, labels, most), keep_from)

    def run(batches):
        for batch in batches:
            ids = pa.nulls(batch.num_rows, pa.int64())
            own = pa.RecordBatch.from_arrays([ids, batch.column("text")], names=["doc_id", "text"])
            flags = pa.concat_arrays([b.column("kept") for b in judge([own])])
            yield batch.filter(flags)

    return docs.mapInArrow(run, docs.schema)
