"""Benchmark passages in documents, found in one pass over the texts.

Words are runs of ASCII letters and digits or characters beyond ASCII, A-Z lower-cased. A window is
`window` consecutive words of a benchmark item, or the whole item if it is shorter. Every window holds
an anchor: ANCHOR words at a multiple of window - ANCHOR + 1. One Aho-Corasick automaton over the
anchors of all items scans each text once; at each place the match is extended by words to both sides,
and a match that reaches a window marks its words and, through the words' places, its bytes.

Benchmarks of more than MOST_WORDS words are scanned in blocks of items, one automaton each, and the
results of a document are brought together; so the automaton in a task has a bound and no item is
left out.

Defined results: null texts have no words; null or blank items have no windows; items with the same
id count once; a null item_id counts as ''. Repeated rows get equal results.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcells.llm.arrow import record_batch
from vitalcells.llm.phrases import Phrases, words_in
from vitalcells.llm.textbytes import (ALPHANUMERIC, normalised, pieces, words_of,
                                      word_hashes, Texts)

WINDOW = 10
ANCHOR = 5
MOST_WORDS = 500_000

SCHEMA = ("doc_id long, text_id long, n_words long, words array<struct<first: long, last: long>>, "
          "spans array<struct<start: long, end: long>>, items array<string>")


@dataclass
class Benchmark:
    """Items as one sequence of word hashes, with their anchors."""

    ids: list[str]
    hashes: np.ndarray
    first: np.ndarray
    phrases: Phrases
    window: int

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> "Benchmark":
        raw = [(text or "").encode() for _, text in items]
        data = np.frombuffer(b"".join(raw), np.uint8)
        texts = Texts(data, np.cumsum([0, *map(len, raw)]))
        words = words_of(texts, ALPHANUMERIC)
        entries = []
        anchor = min(ANCHOR, window)
        for i, (_, text) in enumerate(items):
            own = words_in(text)
            size, at = min(anchor, len(own)), int(words.first[i])
            # A shorter item is a single window, found by its first anchor.
            last = len(own) - size if len(own) >= window else 0
            entries += [(own[p:p + size], at + p) for p in range(0, last + 1, window - anchor + 1)]
        return cls([str(i) if i is not None else "" for i, _ in items], word_hashes(texts, words),
                   words.first, Phrases(entries), window)

    def matches(self, texts: Texts, words, hashes: np.ndarray):
        """Item, first and last word of each match of a window or more around an anchor."""
        phrase, word = self.phrases.find(*normalised(texts, words))
        none = np.zeros(0, np.int64)
        if not len(phrase):
            return none, none, none
        many = np.array([len(v) for v in self.phrases.values])
        flat = np.concatenate([np.array(v, np.int64) for v in self.phrases.values])
        begin = np.cumsum(many) - many
        copies = many[phrase]
        hit = np.repeat(np.arange(len(phrase)), copies)
        step = np.arange(len(hit)) - (np.cumsum(copies) - copies)[hit]
        theirs, ours = flat[begin[phrase[hit]] + step], word[hit]
        size = np.array(self.phrases.lengths)[phrase[hit]]
        item = np.searchsorted(self.first, theirs, "right") - 1
        row = np.searchsorted(words.first, ours, "right") - 1
        need = np.minimum(self.window, self.first[item + 1] - self.first[item])
        before, after = np.zeros(len(ours), np.int64), np.zeros(len(ours), np.int64)
        for sign, reach in ((-1, before), (1, after)):
            alive = np.ones(len(ours), bool)
            edge = np.zeros(len(ours), np.int64) if sign < 0 else size - 1
            for i in range(1, self.window):
                a, b = ours + edge + sign * i, theirs + edge + sign * i
                alive &= i <= need - size
                alive &= (a >= words.first[row]) & (a < words.first[row + 1])
                alive &= (b >= self.first[item]) & (b < self.first[item + 1])
                a, b = np.clip(a, 0, len(hashes) - 1), np.clip(b, 0, len(self.hashes) - 1)
                alive &= hashes[a] == self.hashes[b]
                if not alive.any():
                    break
                reach += alive
        full = before + size + after >= need
        return (item[full], (ours - before)[full], (ours + size - 1 + after)[full])


def _runs(flags: np.ndarray, first: np.ndarray):
    """Maximal runs of set flags within rows: their first and last place and row."""
    start = flags.copy()
    start[1:] &= ~flags[:-1]
    edges = first[:-1][np.diff(first) > 0]
    start[edges] = flags[edges]
    stop = flags.copy()
    stop[:-1] &= ~flags[1:]
    stop[first[1:][np.diff(first) > 0] - 1] = flags[first[1:][np.diff(first) > 0] - 1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop)
    return a, b, np.searchsorted(first, a, "right") - 1


def _structs(names, columns, row, n):
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    flat = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _scan(items: list[tuple[str, str]], window: int):
    def run(batches):
        benchmark = Benchmark.of(items, window)
        for batch in batches:
            for rows, texts in pieces(batch):
                n = len(texts)
                words = words_of(texts, ALPHANUMERIC)
                item, first, last = benchmark.matches(texts, words, word_hashes(texts, words))
                depth = (np.bincount(first, minlength=len(words.starts) + 1)
                         - np.bincount(last + 1, minlength=len(words.starts) + 1))
                a, b, row = _runs(np.cumsum(depth)[:-1] > 0, words.first)
                begin = words.first[row]
                place = texts.offsets[row]
                found: list[set] = [set() for _ in range(n)]
                for r, i in zip((np.searchsorted(words.first, first, "right") - 1).tolist(),
                                item.tolist()):
                    found[r].add(benchmark.ids[i])
                yield record_batch(
                    ["doc_id", "text_id", "n_words", "words", "spans", "items"],
                    rows.column("doc_id"), rows.column("text_id"), words.counts.astype(np.int64),
                    _structs(["first", "last"], [a - begin, b - begin], row, n),
                    _structs(["start", "end"], [words.starts[a] - place, words.ends[b] - place], row, n),
                    pa.array([sorted(f) for f in found], pa.list_(pa.string())))

    return run


def _blocks(benchmark: DataFrame, most_words: int) -> list[list[tuple[str, str]]]:
    """Items in blocks of about `most_words` words, a size that a task can hold as an automaton."""
    items = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
             .where("text is not null").distinct())
    # Two characters at least make a word and the gap after it.
    words = (items.agg(F.sum(F.length("text")).alias("n")).first().n or 0) // 2 + 1
    blocks = -(-words // most_words)
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [[(r.item_id, r.text) for r in items.where(number == i).collect()] for i in range(blocks)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  most_words: int = MOST_WORDS) -> DataFrame:
    """Per document: n_words, runs of hit words (first and last), their bytes in the text (start and
    end), and the ids of the items found."""
    if window < ANCHOR:
        raise ValueError(f"windows have at least {ANCHOR} words")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"), "text")
    scans = [texts.mapInArrow(_scan(block, window), SCHEMA)
             for block in _blocks(benchmark, most_words)]
    blocks = len(scans)
    if blocks == 1:
        return scans[0].drop("text_id")
    everything = scans[0]
    for scan in scans[1:]:
        everything = everything.union(scan)
    runs = [F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("words", "spans")]
    copies = F.count("*") / blocks
    merged = (everything.groupBy("doc_id", "text_id")
              .agg(F.first("n_words").alias("n_words"), *runs,
                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                   copies.cast("int").alias("copies")))
    for name, (a, b) in {"words": ("first", "last"), "spans": ("start", "end")}.items():
        merged = merged.withColumn(name, _united(name, a, b))
    return (merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
            .select("doc_id", "n_words", "words", "spans", "items"))


def _united(name: str, a: str, b: str):
    """Sorted runs of several blocks with overlapping ones joined."""
    empty = F.slice(F.col(name), 1, 0)

    def add(done, run):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1),
                          F.array(F.struct(last[a].alias(a), F.greatest(last[b], run[b]).alias(b))))
        # Words that touch are still two runs of words only if a word lies between them.
        touches = run[a] <= last[b] + (1 if a == "first" else 0)
        return F.when((F.size(done) > 0) & touches, joined).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(name, empty, add)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
          most_words: int = MOST_WORDS) -> DataFrame:
    """Documents without a benchmark passage, with all their columns.

    One pass per block of the benchmark, in which a text that has a passage of it stops.
    """
    kept = docs
    for block in _blocks(benchmark, most_words):
        kept = kept.mapInArrow(_without(block, window), docs.schema)
    return kept


def _without(items: list[tuple[str, str]], window: int):
    def run(batches):
        benchmark = Benchmark.of(items, window)
        for batch in batches:
            for rows, texts in pieces(batch):
                words = words_of(texts, ALPHANUMERIC)
                _, first, _ = benchmark.matches(texts, words, word_hashes(texts, words))
                clean_rows = np.ones(len(texts), bool)
                clean_rows[np.searchsorted(words.first, first, "right") - 1] = False
                yield rows.filter(pa.array(clean_rows))

    return run


def digests(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items per document."""
    hit = F.aggregate("words", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select("doc_id", "n_words", hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


