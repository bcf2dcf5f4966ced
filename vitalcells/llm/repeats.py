"""Removal of passages that repeat across documents, with a suffix array spread over the cluster.

Every text is cut into units: runs of windows of `least` bytes that share their smallest hash of
GRAM bytes (winnowing). Equal windows always lie in units of the same key, so the key is the bucket
of the suffix array. Within a bucket, units with the same bytes are one leaf, whose smallest doc_id
settles all its other occurrences. Buckets with several different leaves go on: their bytes are
fetched and sorted into an enhanced suffix array, whose topmost intervals decide the rest. The maximal
repeats themselves, with all occurrences, are what repeat_groups() returns.

Defined results: null text is an empty text; a very long text is a piece of its own, with arrays as long
as it is; texts shorter than `least` bytes lose nothing; a null
doc_id counts as larger than every other, and equal doc_ids (repeated rows) do not remove from each
other; other columns of the input are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalcells.llm.arrow import LAST, by_key, longs, record_batch
from vitalcells.llm.scratch import Scratch
from vitalcells.llm.suffix_array import build, maximal_intervals, runs_of_least
from vitalcells.llm.textbytes import Hasher, mix, pieces, row_sums, signed, texts_of

LEAST_BYTES = 50
GRAM = 24
#: Units longer than this (texts of a short period) are cut; it bounds the length of a leaf.
MOST_WINDOWS = 64
#: A bucket with more leaves is dealt anew by single windows, which no shared edge keeps together.
MOST_LEAVES = 20_000
#: Bytes of leaves sorted at a time; a bucket is never cut.
BLOCK_BYTES = 2 << 20
SHIFT = 12

UNIT = "key long, span long, doc long, text_id long, place long"
OPEN = "key long, doc long, text_id long, place long, state int"
LEAF = "key long, doc long, text_id long, place long, leaf binary"
RANGE = "doc long, text_id long, place long"
SETTLED, LEAVES, MANY_LEAVES = 0, 1, 2


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every `width` neighbours."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:len(values) - rest], values[rest:]) if rest else values


def _units(texts, least: int):
    """Key, hash of the bytes, row, start and number of bytes of each unit."""
    if len(texts.data) < least:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    hasher = Hasher(texts.data, False)
    smallest = _slide(hasher.grams(GRAM), least - GRAM + 1, np.minimum)
    n = len(smallest)
    row = np.repeat(np.arange(len(texts)), texts.sizes)[:n]
    limit = texts.offsets[1:] - least + 1
    inside = np.arange(n) < limit[row]
    fresh = np.ones(n, bool)
    fresh[1:] = (smallest[1:] != smallest[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(fresh & inside)
    if not len(start):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    stop = np.minimum(np.append(start[1:], n), limit[row[start]])
    cuts = -(-(stop - start) // MOST_WINDOWS)
    if cuts.max() > 1:
        unit = np.repeat(np.arange(len(start)), cuts)
        step = (np.arange(len(unit)) - (np.cumsum(cuts) - cuts)[unit]) * MOST_WINDOWS
        start, stop = start[unit] + step, np.minimum(start[unit] + step + MOST_WINDOWS, stop[unit])
    end = stop - 1 + least
    row = row[start]
    return (smallest[start], hasher.ranges(start, end), row, start - texts.offsets[row],
            end - start)


def _leaf_groups(key, span, doc):
    """Order by key, bytes and document; where keys and leaves begin, and each leaf's first doc."""
    order = np.lexsort((doc, span, key))
    key, span, doc = key[order], span[order], doc[order]
    new_key = np.ones(len(order), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_leaf = new_key.copy()
    new_leaf[1:] |= span[1:] != span[:-1]
    smallest = doc[np.flatnonzero(new_leaf)][np.cumsum(new_leaf) - 1]
    return order, new_key, new_leaf, doc > smallest


def unit_rows(least: int):
    """Units of each document. What a smaller document of the same piece settles leaves here with
    the key of its text, so that a passage of many documents is one row per piece and not per text."""
    names = ["key", "span", "doc", "text_id", "place"]

    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch):
                key, span, row, start, size = _units(texts, least)
                if not len(key):
                    continue
                doc = longs(rows.column("doc"))[row]
                text_id = longs(rows.column("text_id"))[row]
                order, _, _, settled = _leaf_groups(key, span, doc)
                done = np.zeros(len(key), bool)
                done[order[settled]] = True
                place = (start << SHIFT) | size
                key, span = signed(key).copy(), signed(span).copy()
                key[done] = signed(mix(text_id[done].view(np.uint64) + doc[done].view(np.uint64)))
                # Span zero marks what is settled; a hash of zero is as unlikely as any other.
                span[span == 0] = 1
                span[done] = 0
                yield record_batch(names, key, span, doc, text_id, place)

    return run


def settle_leaves(most_leaves: int):
    """Per key: occurrences of a leaf after its smallest document are settled; the first ones go on
    when the key has other leaves too."""

    def run(batches):
        for part in by_key(batches, ["key", "span", "doc", "text_id", "place"]):
            yield from _settled(part, most_leaves)

    return run


def _settled(part, most_leaves: int):
    names = ["key", "doc", "text_id", "place", "state"]
    key, span = longs(part["key"]), longs(part["span"])
    doc, text_id, place = (longs(part[c]) for c in ("doc", "text_id", "place"))
    passed = span == 0
    key, span = np.where(passed, 0, key), np.where(passed, place, span)
    order, new_key, new_leaf, settled = _leaf_groups(key, span, doc)
    leaves = np.add.reduceat(new_leaf, np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
    state = np.full(len(order), -1, np.int32)
    state[(leaves > 1) & ~settled] = LEAVES
    state[(leaves > most_leaves) & ~settled] = MANY_LEAVES
    state[settled] = SETTLED
    state[passed[order]] = SETTLED
    keep = state >= 0
    at = order[keep]
    if len(at):
        yield record_batch(names, key[at], doc[at], text_id[at], place[at], state[keep])


def leaf_rows(least: int):
    """The bytes of open leaves, cut out of their texts; those of large buckets window by window."""
    names = ["key", "doc", "text_id", "place", "leaf"]

    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch):
                opened = rows.column("leaves")
                counts = np.diff(opened.offsets.to_numpy())
                flat = opened.flatten()
                key, place, state = (longs(flat.field(i)) for i in range(3))
                row = np.repeat(np.arange(len(counts)), counts)
                doc, text_id = (longs(rows.column(c))[row] for c in ("doc", "text_id"))
                start = texts.offsets[row] + (place >> SHIFT)
                size = place & ((1 << SHIFT) - 1)
                gone = np.zeros(len(key), bool)
                many = np.flatnonzero(state == MANY_LEAVES)
                if len(many):
                    windows = size[many] - least + 1
                    unit = many[np.repeat(np.arange(len(many)), windows)]
                    step = np.arange(len(unit)) - np.repeat(np.cumsum(windows) - windows, windows)
                    alone = np.setdiff1d(np.arange(len(key)), many)
                    pick = np.concatenate([alone, unit])
                    shift = np.concatenate([np.zeros(len(alone), np.int64), step])
                    single = np.arange(len(pick)) >= len(alone)
                    doc, text_id, start = doc[pick], text_id[pick], start[pick] + shift
                    size = np.where(single, least, size[pick])
                    key, place = key[pick], (((place[pick] >> SHIFT) + shift) << SHIFT) | size
                    hashes = Hasher(texts.data, False).ranges(start, start + size)
                    key = np.where(single, signed(mix(hashes + np.uint64(1))), key)
                    order, _, _, settled = _leaf_groups(key, signed(hashes), doc)
                    gone = np.zeros(len(key), bool)
                    gone[order[settled]] = True
                    gone &= single
                raw = texts.data.tobytes()
                leaf = [None if g else raw[s:s + n]
                        for s, n, g in zip(start.tolist(), size.tolist(), gone.tolist())]
                for at in range(0, len(leaf), 50_000):
                    part = slice(at, at + 50_000)
                    yield record_batch(names, key[part], doc[part], text_id[part], place[part],
                                 pa.array(leaf[part], pa.binary()))

    return run


def _merged(owner, start, end):
    """Overlapping ranges of an owner as one."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    # Running ends per owner: shift owners apart.
    wide = int(end.max()) + 1 if len(end) else 1
    reach = np.maximum.accumulate(end + owner * wide)
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[1:] + owner[1:] * wide > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(order)) - 1
    return owner[first], start[first], reach[last] - owner[first] * wide


def repeat_ranges(least: int, block_bytes: int):
    """Occurrences of repeats of `least` bytes after their smallest document.

    Of the interval tree only the topmost intervals are needed here: deeper ones begin at the same bytes,
    and a longer repeat is covered by the windows in it.
    """
    names = ["doc", "text_id", "place"]

    def run(batches):
        columns = ["key", "doc", "text_id", "place", "leaf"]
        for part in by_key(batches, columns, lambda p: p["leaf"].nbytes + 1, block_bytes):
            settled = part["leaf"].is_null().to_numpy(zero_copy_only=False)
            doc, text_id, place, key = (longs(part[c]) for c in ("doc", "text_id", "place", "key"))
            texts = texts_of(part["leaf"].fill_null(b""))
            array = build(texts.data, texts.offsets[:-1], texts.offsets[1:], key, least)
            out = [(doc[settled], text_id[settled], place[settled])]
            if len(array.positions):
                begins, run_of = runs_of_least(array.prefix, least)
                owner = array.owners
                later = doc[owner] > np.minimum.reduceat(doc[owner], begins)[run_of]
                owner, start = owner[later], (array.positions - texts.offsets[array.owners])[later]
                if len(owner):
                    owner, start, end = _merged(owner, start, start + least)
                    out.append((doc[owner], text_id[owner],
                                (((place[owner] >> SHIFT) + start) << SHIFT) | (end - start)))
            doc, text_id, place = (np.concatenate(x) for x in zip(*out))
            if len(doc):
                yield record_batch(names, doc, text_id, place)

    return run


def _cut(batches):
    """What is left of each text after its ranges are removed."""
    for batch in batches:
        for rows, texts in pieces(batch):
            ranges = rows.column("ranges")
            if ranges.null_count:
                counts = np.diff(ranges.offsets.to_numpy())
                counts[ranges.is_null().to_numpy(zero_copy_only=False)] = 0
            else:
                counts = np.diff(ranges.offsets.to_numpy())
            place = longs(ranges.flatten())
            row = np.repeat(np.arange(len(counts)), counts)
            start = texts.offsets[row] + (place >> SHIFT)
            end = start + (place & ((1 << SHIFT) - 1))
            n = len(texts.data)
            depth = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
            gone = np.cumsum(depth)[:n] > 0
            fresh = gone.copy()
            fresh[1:] &= ~gone[:-1]
            # A run that ends where a text ends and one that begins with the next are two.
            edges = texts.offsets[:-1][texts.sizes > 0]
            fresh[edges] = gone[edges]
            removed = row_sums(gone, texts.offsets)
            spans = row_sums(fresh, texts.offsets)
            kept = []
            for i in range(len(texts)):
                a, b = texts.offsets[i], texts.offsets[i + 1]
                kept.append((texts.data[a:b][~gone[a:b]] if removed[i] else texts.data[a:b]).tobytes())
            yield rows, texts.sizes, removed, spans, kept


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by document and text: repeated ids with different texts stay apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
                       F.xxhash64(text).alias("text_id"), text.alias("text"))


def repeated_ranges(docs: DataFrame, scratch: Scratch, least: int = LEAST_BYTES,
                    most_leaves: int = MOST_LEAVES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Byte ranges (doc, text_id, place) covered by windows that start in a smaller document."""
    if least <= GRAM:
        raise ValueError(f"windows must be longer than {GRAM} bytes")
    keyed = _keyed(docs)
    units = keyed.select("doc", "text_id", "text").mapInArrow(unit_rows(least), UNIT)
    settled = scratch.write(
        units.repartition("key").sortWithinPartitions("key").mapInArrow(
            settle_leaves(most_leaves), OPEN), "leaves")
    opened = (settled.where(F.col("state") != SETTLED).groupBy("doc", "text_id")
              .agg(F.collect_list(F.struct("key", "place", "state")).alias("leaves")))
    texts = keyed.select("doc", "text_id", "text").join(opened, ["doc", "text_id"])
    leaves = texts.mapInArrow(leaf_rows(least), LEAF)
    found = scratch.write(
        leaves.repartition("key").sortWithinPartitions("key").mapInArrow(
            repeat_ranges(least, block_bytes), RANGE), "ranges")
    return settled.where(F.col("state") == SETTLED).select("doc", "text_id", "place").union(found)


LEAVES_SCHEMA = "key long, span long, doc long, text_id long, place long, leaf binary"
GROUPS_SCHEMA = "key long, first long, last long, length long, span long, shift long"


def _unit_bytes(least: int):
    """Every unit with its bytes."""
    names = ["key", "span", "doc", "text_id", "place", "leaf"]

    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch):
                key, span, row, start, size = _units(texts, least)
                raw, at = texts.data.tobytes(), texts.offsets[row] + start
                leaf = [raw[s:s + n] for s, n in zip(at.tolist(), size.tolist())]
                if leaf:
                    doc, text_id = (longs(rows.column(c))[row] for c in ("doc", "text_id"))
                    yield record_batch(names, signed(key), signed(span), doc, text_id, (start << SHIFT) | size,
                                       pa.array(leaf, pa.binary()))

    return run


def _group_rows(least: int, block_bytes: int):
    """Per key: its suffixes in order (first: rank, span and shift: the leaf and where in it), and its
    maximal repeats (first and last rank, length)."""
    names = ["key", "first", "last", "length", "span", "shift"]

    def run(batches):
        for part in by_key(batches, ["key", "span", "leaf"], lambda p: p["leaf"].nbytes + 1, block_bytes):
            key, span = longs(part["key"]), longs(part["span"])
            texts = texts_of(part["leaf"])
            array = build(texts.data, texts.offsets[:-1], texts.offsets[1:], key, least)
            if not len(array.positions):
                continue
            of = key[array.owners]
            base = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            rank = np.arange(len(of)) - base[np.cumsum(np.append(True, of[1:] != of[:-1])) - 1]
            none = pa.nulls(len(of), pa.int64())
            yield record_batch(names, of, rank, none, none, span[array.owners],
                               array.positions - texts.offsets[array.owners])
            first, last, length = maximal_intervals(texts.data, texts.offsets[:-1], array, least)
            none = pa.nulls(len(first), pa.int64())
            yield record_batch(names, of[first], rank[first], rank[last], length, none, none)

    return run


def repeat_groups(docs: DataFrame, least: int = LEAST_BYTES,
                  block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Maximal repeats within the units of the texts, with all their occurrences, as three tables:

    groups (key, first, last, length): a repeat is the first `length` bytes of the key's suffixes of rank
    first to last; suffixes (key, rank, span, shift): a suffix is a place in a leaf, that is in the bytes
    that equal units share; and leaves (key, span, doc, text_id, start): where each leaf stands. Every
    occurrence is found by joining them; written out they would be as many as nested repeats have.
    A repeat of more than one unit appears once per unit.
    """
    scratch = Scratch(docs.sparkSession, "repeat-groups")
    units = scratch.write(_keyed(docs).select("doc", "text_id", "text").mapInArrow(_unit_bytes(least), LEAVES_SCHEMA),
                          "units")
    distinct = units.groupBy("key", "span").agg(F.first("leaf").alias("leaf"))
    found = scratch.write(distinct.repartition("key").sortWithinPartitions("key")
                          .mapInArrow(_group_rows(least, block_bytes), GROUPS_SCHEMA), "groups")
    # A leaf that stands in several places repeats as a whole; its one suffix has a rank below zero.
    rank = -F.row_number().over(Window.partitionBy("key").orderBy("span")).cast("long")
    whole = (units.groupBy("key", "span").agg(F.count("*").alias("n"), F.first(F.length("leaf")).alias("length"))
             .where("n > 1").withColumn("rank", rank))
    groups = found.where("span is null").select("key", "first", "last", "length").unionByName(
        whole.select("key", F.col("rank").alias("first"), F.col("rank").alias("last"),
                     F.col("length").cast("long").alias("length")))
    suffixes = found.where("span is not null").select("key", F.col("first").alias("rank"), "span", "shift").unionByName(
        whole.select("key", "rank", "span", F.lit(0).cast("long").alias("shift")))
    return groups, suffixes, units.select("key", "span", "doc", "text_id", F.shiftright("place", SHIFT).alias("start"))


def without_repeats(docs: DataFrame, least: int = LEAST_BYTES, with_text: bool = False,
                    most_leaves: int = MOST_LEAVES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document with its repeated passages removed: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, and on demand the bytes left (a cut may split a character)."""
    scratch = Scratch(docs.sparkSession, "repeats")
    ranges = (repeated_ranges(docs, scratch, least, most_leaves, block_bytes).groupBy("doc", "text_id")
              .agg(F.collect_list("place").alias("ranges")))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:5 + with_text]

    def run(batches):
        for rows, sizes, removed, spans, kept in _cut(batches):
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            more = [pa.array(kept, pa.binary())] * with_text
            yield record_batch(names, rows.column("doc_id").cast(pa.int64()), sizes.astype(np.int64),
                         removed, spans, pa.array(digests, pa.string()), *more)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (_keyed(docs).join(ranges, ["doc", "text_id"], "left")
            .select("doc_id", "text", "ranges")
            .mapInArrow(run, schema + ", kept binary" * with_text))
