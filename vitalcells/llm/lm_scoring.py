"""Scores of texts under a log-bilinear language model trained with noise-contrastive estimation.

Words are counted over all training texts. The commonest ones are units of their own, all others fall
into units by their spelling, and one unit ends a text. The model predicts the next word in three steps:
its unit, its group inside the unit, and the word inside the group. The vectors of the CONTEXT units before
it, each scaled by its place, are summed and multiplied with a vector per unit, then per group of the unit,
then per word of the group.
Every word that occurs OWN times or more in training has a vector of its own, so the vocabulary of the
model grows with the texts. A unit has as many groups as a group has words, so that scoring a token costs the
square root of the unit's words; the other words of a unit are one entry beside its groups, inside which a
word has its share of the counts, one more for each word and one for words never seen.

Training goes in rounds, each over its share of the texts, with one task for TRAINED_BYTES of that share:
each task starts from the same parameters and learns against noise, and after a round the tasks'
parameters are averaged by the words they saw. Scoring multiplies batches of contexts with all vectors of a step and normalises over them.

Words go by 64-bit hashes. Texts are dealt into buckets by a hash of the row; a bucket's distinct words
meet the counts once, not word by word.

Defined results: null and empty texts consist of the end token. A null doc_id is a training row.
A very long text is a piece of its own,
with arrays as long as it is. Without training rows every count is 0. Repeated rows get equal scores; other columns are not read.
"""

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcells.llm.arrow import by_key, longs, record_batch
from vitalcells.llm.scratch import Scratch
from vitalcells.llm.textbytes import (LOWER, NOT_SPACE, Texts, Words, mix, pieces, row_sums, signed,
                                      word_hashes, words_of)

FOLDS, HELD_FOLD = 7, 2
#: Bytes of text in a bucket, which one task scores at a time.
BUCKET_BYTES = 32 << 20
#: Bytes of text that a task learns from in a round, before it hands on its parameters.
TRAINED_BYTES = 16 << 20
#: Unit 0 ends a text; then come the commonest words and the units of spelling.
COMMON, SPELLINGS = 63, 64
UNITS = 1 + COMMON + SPELLINGS
WIDTH, CONTEXT = 24, 5
NOISE, INNER_NOISE, MINIBATCH, RATE, SEED = 32, 16, 2048, 0.08, 5
#: Training occurrences from which on a word has vectors of its own.
OWN = 1000
#: Averagings of the tasks' parameters.
ROUNDS = 3
#: Contexts scored at a time.
SCORED = 256
END = 0x2545F4914F6CDD1D
_STOPS = np.frombuffer(b".,;:!?)\"'", np.uint8)

COUNTS = "word long, bucket long, n long, unit int"
TOTALS = "bucket long, word long, n long, total long, unit int, first boolean"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def tokens_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and spelling unit of every token, and where each row's tokens begin. Rows end with END."""
    words = words_of(texts, NOT_SPACE)
    n, rows = len(texts), words.rows
    first = words.first + np.arange(n + 1)
    place = np.arange(len(rows)) + rows
    hashes = np.full(first[-1], END, np.uint64)
    units = np.zeros(first[-1], np.int32)
    hashes[place] = word_hashes(texts, words)
    units[place] = _spelling(texts, words)
    return hashes, units, first


def _spelling(texts: Texts, words: Words) -> np.ndarray:
    """Unit of a word by its first two bytes and whether it ends in punctuation."""
    if not len(words.starts):
        return np.zeros(0, np.int32)
    low = LOWER[texts.data]
    second = np.where(words.ends - words.starts > 1, low[np.minimum(words.starts + 1, len(low) - 1)], 0)
    lead = mix(low[words.starts].astype(np.uint64) * np.uint64(256) + second.astype(np.uint64) + np.uint64(1))
    marked = np.isin(low[words.ends - 1], _STOPS)
    half = np.uint64(SPELLINGS // 2)
    return (1 + COMMON + 2 * (lead % half).astype(np.int32) + marked).astype(np.int32)


def _count(table: pa.Table) -> pa.Table:
    """Distinct words of a bucket, with how often they occur in its training texts."""
    words, counts, units = [], [], []
    for batch in table.to_batches():
        for rows, texts in pieces(batch):
            hashes, unit, first = tokens_of(texts)
            learned = ~rows.column("held_out").to_numpy(zero_copy_only=False)
            weight = np.repeat(learned, np.diff(first))
            found, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            words.append(found)
            counts.append(np.bincount(inverse, weight, len(found)).astype(np.int64))
            units.append(unit[at])
    word, at, inverse = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
    n = np.bincount(inverse, np.concatenate(counts), len(word)).astype(np.int64)
    bucket = np.full(len(word), table.column("bucket")[0].as_py(), np.int64)
    return pa.table([signed(word), bucket, n, np.concatenate(units)[at]],
                    names=["word", "bucket", "n", "unit"])


def _totals(batches):
    """Counts of each word over all buckets, beside each bucket that has it. Input is by word."""
    for part in by_key(_renamed(batches), ["key", "bucket", "n", "unit"]):
        word, n = longs(part["key"]), longs(part["n"])
        first = np.ones(len(word), bool)
        first[1:] = word[1:] != word[:-1]
        total = np.add.reduceat(n, np.flatnonzero(first))[np.cumsum(first) - 1]
        yield record_batch(["bucket", "word", "n", "total", "unit", "first"], part["bucket"], word, n,
                           total, part["unit"], first)


def _renamed(batches):
    for batch in batches:
        yield batch.rename_columns(["key", *batch.schema.names[1:]])


@dataclass
class Vocabulary:
    """Totals of the training texts, the words that are units, and the words with vectors of their own."""

    tokens: int
    distinct: int
    common: np.ndarray  # hashes of the commonest words, sorted; their units by the same order
    counts: np.ndarray  # training tokens of each unit
    kinds: np.ndarray  # distinct training words of each unit
    own: np.ndarray  # hashes of the words with vectors, by unit and hash
    own_counts: np.ndarray  # training tokens of each of them
    edges: np.ndarray  # where each unit's words begin among them

    def __post_init__(self):
        self.order = np.argsort(self.own)
        inside = np.append(0, np.cumsum(self.own_counts))
        self.rest = self.counts - (inside[self.edges[1:]] - inside[self.edges[:-1]])
        words = np.diff(self.edges)
        self.rest_kinds = self.kinds - words
        # Groups of a unit: runs of its words, about as many as there are words in each.
        size = np.maximum(np.ceil(np.sqrt(words)).astype(np.int64), 1)
        self.group_edges = np.append(0, np.cumsum(-(-words // size)))  # where each unit's groups begin
        unit = np.repeat(np.arange(UNITS), words)
        self.group = (self.group_edges[unit] + (np.arange(len(unit)) - self.edges[unit]) // size[unit]).astype(np.int32)
        # Where each group's words begin, and what they weigh.
        self.group_words = np.searchsorted(self.group, np.arange(self.group_edges[-1] + 1))
        self.inside = np.append(0.0, np.cumsum(self.own_counts + 1.0))
        self.group_weight = self.inside[self.group_words[1:]] - self.inside[self.group_words[:-1]]
        self.word_share = (self.own_counts + 1) / self.group_weight[self.group]

    def units(self, hashes: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return spelled
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[at] == hashes, 1 + at, spelled).astype(np.int32)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word among those with vectors, or -1."""
        if not len(self.own):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.own, hashes, sorter=self.order), len(self.own) - 1)
        return np.where(self.own[self.order[at]] == hashes, self.order[at], -1).astype(np.int32)

    def entries(self, unit: int) -> np.ndarray:
        """Rows of a unit in the second step: its other words, then its groups."""
        return np.append(unit, UNITS + len(self.own) + np.arange(self.group_edges[unit], self.group_edges[unit + 1]))

    def entry(self, units: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Places in one row of the entries of all units."""
        first = self.group_edges[units] + units
        return first + np.where(words < 0, 0, self.group[words] - self.group_edges[units] + 1) if len(self.own) else first

    def sorted(self, units: np.ndarray, words: np.ndarray, order: np.ndarray):
        """An order of tokens by entry that keeps the given one inside, and what each unit and group with a
        choice has: its rows of targets, what they weigh, its tokens in that order, and each one's row."""
        entry = self.entry(units[order], words[order])
        n = UNITS + len(self.group_weight)
        by = np.argsort(_narrow(entry, n), kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(entry, minlength=n)))
        order, entry = order[by], entry[by]
        word = words[order]

        def choices():
            for unit in np.flatnonzero(np.diff(self.edges)):
                low, high = self.group_edges[unit] + unit, self.group_edges[unit + 1] + unit + 1
                a, b = ends[low], ends[high]
                if a < b:
                    yield self.entries(unit), self.weights(unit), slice(a, b), entry[a:b] - low
                for at in range(low + 1, high):
                    group = at - unit - 1
                    first, last = self.group_words[group], self.group_words[group + 1]
                    a, b = ends[at], ends[at + 1]
                    if a < b and last - first > 1:
                        yield (slice(UNITS + first, UNITS + last), self.word_share[first:last], slice(a, b),
                               word[a:b] - first)

        return order, choices()

    def weights(self, unit: int) -> np.ndarray:
        """What the entries of a unit weigh."""
        return np.append(self.rest[unit] + 1.0, self.group_weight[self.group_edges[unit]:self.group_edges[unit + 1]])


@dataclass
class Model:
    """Vectors of contexts and of targets, biases, scales of the context places.

    Contexts: a row per unit, and one for what stands before a text. Targets of the first step: a row per
    unit. Of the second and third: a row per unit, for its other words, then one per word, then one per group.
    The last column of targets is a bias. Before training a word has its share of its group, and a group of
    its unit.
    """

    context: np.ndarray
    target: np.ndarray
    inner: np.ndarray
    scale: np.ndarray

    @classmethod
    def initial(cls, vocabulary: Vocabulary) -> "Model":
        rng = np.random.default_rng(SEED)
        v, words = vocabulary, len(vocabulary.own)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        share = (v.counts + 1) / (v.counts.sum() + UNITS)
        target = small(UNITS, WIDTH + 1)
        inner = np.zeros((UNITS + words + len(v.group_weight), WIDTH + 1), np.float32)
        target[:, -1] = np.log(share)
        # Shares within unit and group; contrastive estimation keeps them normalised.
        for unit in range(UNITS):
            weights = v.weights(unit)
            inner[v.entries(unit), -1] = np.log(weights / weights.sum())
        inner[UNITS:UNITS + words, -1] = np.log(v.word_share)
        scale = np.repeat(1 / np.arange(1, CONTEXT + 1, dtype=np.float32)[:, None], WIDTH, 1)
        return cls(small(UNITS + 1, WIDTH), target, inner, scale)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.inner, self.scale]

    def rows(self) -> np.ndarray:
        """All parameters as rows of one width."""
        wide = [np.pad(p, ((0, 0), (0, WIDTH + 1 - p.shape[1]))) for p in self.parts()]
        return np.concatenate(wide)

    def with_rows(self, places: np.ndarray, values: np.ndarray) -> "Model":
        """The model with some rows replaced."""
        flat = self.rows()
        flat[places] = values
        out, at = [], 0
        for p in self.parts():
            out.append(np.ascontiguousarray(flat[at:at + len(p), :p.shape[1]]))
            at += len(p)
        return Model(*out)

    def hidden(self, before: np.ndarray) -> np.ndarray:
        """Sums of scaled context vectors."""
        tables = [self.context * s for s in self.scale]
        out = np.take(tables[0], before[:, 0], 0)
        for i in range(1, CONTEXT):
            out += np.take(tables[i], before[:, i], 0)
        return out

    def log_probabilities(self, vocabulary: Vocabulary, units: np.ndarray, words: np.ndarray,
                          before: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each word with vectors, or of the other words of its unit."""
        order, choices = vocabulary.sorted(units, words, np.arange(len(units)))
        hidden, unit = with_one(self.hidden(np.take(before, order, 0))), units[order]
        found = np.zeros(len(units))
        _add_log_softmax(found, hidden, self.target, unit)
        for rows, _, at, chosen in choices:
            _add_log_softmax(found[at], hidden[at], self.inner[rows], chosen)
        out = np.empty(len(units))
        out[order] = found
        return out


def with_one(hidden: np.ndarray) -> np.ndarray:
    """A last column that meets the bias."""
    out = np.ones((len(hidden), WIDTH + 1), np.float32)
    out[:, :-1] = hidden
    return out


def _narrow(rows: np.ndarray, n: int) -> np.ndarray:
    """Numbers below n in the smallest type, which are sorted digit by digit."""
    return rows.astype(np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32)


def _add_log_softmax(out: np.ndarray, hidden: np.ndarray, target: np.ndarray, chosen: np.ndarray) -> None:
    for a in range(0, len(out), SCORED):
        part = slice(a, a + SCORED)
        out[part] += _log_softmax(hidden[part], target, chosen[part])


def _log_softmax(hidden: np.ndarray, target: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    scores = hidden @ target.T
    own = scores[np.arange(len(scores)), chosen]
    np.exp(scores, out=scores)
    return own - np.log(scores.sum(1))


def contexts(units: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The CONTEXT units before each token of its row, nearest first; UNITS where the row begins."""
    place = np.arange(len(units)) - np.repeat(first[:-1], np.diff(first))
    out = np.full((len(units), CONTEXT), UNITS, np.int32)
    for i in range(CONTEXT):
        inside = np.flatnonzero(place > i)
        out[inside, i] = units[inside - i - 1]
    return out


def read(vocabulary: Vocabulary, hashes: np.ndarray, spelled: np.ndarray, first: np.ndarray):
    """Units and words of tokens, and the units before each."""
    units = vocabulary.units(hashes, spelled)
    return units, vocabulary.words(hashes), contexts(units, first)


class Trainer:
    """Noise-contrastive estimation by minibatches with adaptive rates."""

    def __init__(self, model: Model, vocabulary: Vocabulary, seed: int):
        self.model = Model(*[p.copy() for p in model.parts()])
        self.vocabulary = vocabulary
        self.squares = [np.full(p.shape, 0.1, np.float32) for p in model.parts()]
        self.touched = [np.zeros(len(p), bool) for p in model.parts()]
        self.share = (vocabulary.counts + 1) / (vocabulary.counts.sum() + UNITS)
        self.log_noise = np.log(NOISE * self.share).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def learn(self, units: np.ndarray, words: np.ndarray, before: np.ndarray) -> None:
        order = self.rng.permutation(len(units))
        for a in range(0, len(order), MINIBATCH):
            at = order[a:a + MINIBATCH]
            self._step(units[at], np.take(before, at, 0))
        order, choices = self.vocabulary.sorted(units, words, order)
        hidden = with_one(self.model.hidden(np.take(before, order, 0)))
        for rows, weights, at, chosen in choices:
            self._inner_step(rows, weights, chosen, hidden[at])

    def _inner_step(self, rows, weights: np.ndarray, chosen: np.ndarray, hidden: np.ndarray) -> None:
        """Rise for what was read among some rows of targets. They are few, so each falls by what the noise
        would draw of it on average. Each minibatch has tokens from all over, since they are sorted."""
        inner, squares = self.model.inner, self.squares[2]
        share = INNER_NOISE * (weights / weights.sum())
        log_noise, fall = np.log(share).astype(np.float32), -share.astype(np.float32)
        self.touched[2][rows] = True
        batches = -(-len(chosen) // MINIBATCH)
        for i in range(batches):
            near, read = hidden[i::batches], chosen[i::batches]
            target, each = inner[rows], np.arange(len(read))
            chance = near @ target.T
            chance -= log_noise
            np.clip(chance, -30, 30, out=chance)
            np.negative(chance, out=chance)
            np.exp(chance, out=chance)
            chance += 1
            np.reciprocal(chance, out=chance)
            up = 1 - chance[each, read]
            chance *= fall
            chance[each, read] += up
            g = chance.T @ near
            g /= np.float32(np.sqrt(len(read)))
            square = squares[rows] + g * g
            squares[rows] = square
            inner[rows] = target + RATE * g / np.sqrt(square)

    def _step(self, chosen: np.ndarray, before: np.ndarray) -> None:
        """Rise for the units read, fall for those drawn as noise; the contexts follow."""
        m, n, hidden, target = self.model, len(chosen), self.model.hidden(before), self.model.target
        share, draws, log_noise = self.share, NOISE, self.log_noise
        noise = np.minimum(np.searchsorted(np.cumsum(share), self.rng.random(draws)), UNITS - 1)
        read = np.take(target, chosen, 0)
        own = np.einsum("ij,ij->i", hidden, read[:, :-1]) + read[:, -1] - log_noise[chosen]
        others = hidden @ target[noise, :-1].T + (target[:, -1] - log_noise)[noise]
        up = 1 / (1 + np.exp(np.clip(own, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(others, -30, 30)))
        at = np.concatenate([chosen, noise])
        gains = np.concatenate([np.concatenate([up[:, None] * hidden, up[:, None]], 1),
                                np.concatenate([down.T @ hidden, down.sum(0)[:, None]], 1)])
        towards = up[:, None] * read[:, :-1] + down @ target[noise, :-1]
        # What each unit's vector gets at each place, by one sort.
        key = (before + np.arange(CONTEXT) * (UNITS + 1)).T.ravel()
        order = np.argsort(_narrow(key, CONTEXT * (UNITS + 1)), kind="stable")
        key = key[order]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sums = np.zeros((CONTEXT * (UNITS + 1), WIDTH), np.float32)
        sums[key[begins]] = np.add.reduceat(np.take(towards, order % n, 0), begins, axis=0)
        sums = sums.reshape(CONTEXT, UNITS + 1, WIDTH)
        scale = (sums * m.context).sum(1)
        seen = np.unique(key[begins] % (UNITS + 1))
        moved = (sums * m.scale[:, None]).sum(0)[seen]
        self._move(1, at, gains, n)
        self._move(0, seen, moved, n)
        self._move(3, np.arange(CONTEXT), scale, n)

    def _move(self, part: int, rows: np.ndarray, gains: np.ndarray, n: int) -> None:
        """Add up the gains of each row and move it."""
        order = np.argsort(_narrow(rows, len(self.touched[part])), kind="stable")
        rows = rows[order]
        begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        rows = rows[begins]
        g = (np.add.reduceat(np.take(gains, order, 0), begins, axis=0) / np.sqrt(n)).astype(np.float32)
        squares = self.squares[part][rows] + g * g
        self.squares[part][rows] = squares
        self.model.parts()[part][rows] += RATE * g / np.sqrt(squares)
        self.touched[part][rows] = True


COLUMNS = [f"v{i}" for i in range(WIDTH + 1)]
ROWS = "place int, weight double, " + ", ".join(f"{c} float" for c in COLUMNS)


def _train(vocabulary: Vocabulary, model: Model):
    """Rows that a task's training texts moved, and the tokens it saw."""
    def run(batches):
        trainer, seen = None, 0
        for batch in batches:
            for _, texts in pieces(batch):
                hashes, spelled, first = tokens_of(texts)
                if trainer is None:
                    trainer = Trainer(model, vocabulary, int(hashes[0] % np.uint64(1 << 31)))
                trainer.learn(*read(vocabulary, hashes, spelled, first))
                seen += len(hashes)
        if trainer is not None:
            places = np.flatnonzero(np.concatenate(trainer.touched))
            values = trainer.model.rows()[places]
            yield record_batch(["place", "weight", *COLUMNS], places.astype(np.int32),
                               np.full(len(places), float(seen)), *values.T)

    return run


def _averaged(texts: DataFrame, vocabulary: Vocabulary, model: Model) -> Model:
    """The model after a pass over some texts, averaged over the tasks by the tokens they saw."""
    weight = F.sum("weight")
    rows = (texts.select("text").mapInArrow(_train(vocabulary, model), ROWS).groupBy("place")
            .agg(*[(F.sum(F.col(c) * F.col("weight")) / weight).cast("float").alias(c) for c in COLUMNS]).toArrow())
    if not rows.num_rows:
        return model
    values = np.stack([rows.column(c).to_numpy() for c in COLUMNS], 1)
    return model.with_rows(rows.column("place").to_numpy(), values)


def _score(vocabulary: Vocabulary, model: Model):
    names = [c.split()[0] for c in SCORES.split(", ")]
    log10 = np.log(10)

    def run(table: pa.Table, words: pa.Table) -> pa.Table:
        known = longs(words.column("word").combine_chunks()).view(np.uint64)
        total = longs(words.column("total").combine_chunks())
        order = np.argsort(known)
        known, total = known[order], total[order]
        scale = vocabulary.rest + vocabulary.rest_kinds + 1
        out = []
        for batch in table.to_batches():
            for rows, texts in pieces(batch):
                hashes, spelled, first = tokens_of(texts)
                count = total[np.searchsorted(known, hashes)]
                base = np.log10((count + 1) / (vocabulary.tokens + vocabulary.distinct + 1))
                units, own, before = read(vocabulary, hashes, spelled, first)
                # The end and the commonest words are units of one word each.
                inside = np.where((units > COMMON) & (own < 0), np.log((count + 1) / scale[units]), 0)
                score = (model.log_probabilities(vocabulary, units, own, before) + inside) / log10
                n = np.diff(first)
                out.append(record_batch(
                    names, rows.column("doc_id"), rows.column("held_out"), n, row_sums(count > 0, first),
                    np.full(len(n), vocabulary.tokens), row_sums(base, first), row_sums(score, first)))
        return pa.Table.from_batches(out)

    return run


def _vocabulary(totals: DataFrame, own_from: int) -> Vocabulary:
    """Facts of the counts: sums, the commonest words, the units' sums, and the words with vectors, of
    which there is at most one for every `own_from` training tokens."""
    learned = totals.where("first and total > 0")
    end = int(signed(np.array([END], np.uint64))[0])
    per_unit = (learned.groupBy("unit")
                .agg(F.sum("total").alias("n"), F.count("*").alias("kinds")).collect())
    common = (learned.where(F.col("word") != end)
              .orderBy(F.desc("total"), "word").select("word", "total", "unit").limit(COMMON).collect())
    counts, kinds = np.zeros(UNITS, np.int64), np.zeros(UNITS, np.int64)
    for r in per_unit:
        counts[r.unit], kinds[r.unit] = r.n, r.kinds
    tokens, distinct = int(counts.sum()), int(kinds.sum())
    hashes = np.array([r.word for r in common], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    for unit, i in enumerate(order.tolist(), 1):
        counts[unit], kinds[unit] = common[i].total, 1
        counts[common[i].unit] -= common[i].total
        kinds[common[i].unit] -= 1
    own = (learned.where((F.col("total") >= own_from) & (F.col("word") != end)
                         & ~F.col("word").isin([r.word for r in common]))
           .select("unit", "word", "total").toArrow())
    unit, word = own.column("unit").to_numpy(), own.column("word").to_numpy().view(np.uint64)
    rank = np.lexsort((word, unit))
    edges = np.searchsorted(unit[rank], np.arange(UNITS + 1))
    return Vocabulary(tokens, distinct, hashes[order], counts, kinds, word[rank],
                      own.column("total").to_numpy()[rank].astype(np.int64), edges)


def score_documents(docs: DataFrame, folds: int = FOLDS, held_fold: int = HELD_FOLD,
                    bucket_bytes: int = BUCKET_BYTES, own_from: int = OWN) -> DataFrame:
    """Per document: its tokens, those seen in training, a smoothed unigram score and the model's."""
    scratch = Scratch(docs.sparkSession, "lm")
    text = F.coalesce("text", F.lit(""))
    fold = F.expr(f"pmod(crc32(cast(cast(doc_id as long) as string)), {folds}) = {held_fold}")
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, ceil(total / bucket_bytes))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(fold, F.lit(False)).alias("held_out"), text.alias("text"),
                        bucket.alias("bucket"))
    counts = texts.select("bucket", "held_out", "text").groupBy("bucket").applyInArrow(_count, COUNTS)
    totals = scratch.write(counts.repartition("word").sortWithinPartitions("word")
                           .mapInArrow(_totals, TOTALS), "totals")
    vocabulary = _vocabulary(totals, own_from)
    model = Model.initial(vocabulary)
    turn = F.pmod(F.xxhash64("text", "doc_id"), F.lit(ROUNDS))
    tasks = max(1, ceil(total / (ROUNDS * TRAINED_BYTES)))
    for i in range(ROUNDS):
        # A round reads few texts of each file split, so that a task takes several.
        model = _averaged(texts.where(~F.col("held_out") & (turn == i)).coalesce(tasks), vocabulary, model)
    return (texts.groupBy("bucket").cogroup(totals.select("bucket", "word", "total").groupBy("bucket"))
            .applyInArrow(_score(vocabulary, model), SCORES))
