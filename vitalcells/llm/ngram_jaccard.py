"""Similarity join of documents on the Jaccard similarity of their word shingles.

Parity sketches: each shingle flips one bit of a bit sketch, so bits that differ between two sketches
are at most as many as shingles in only one of the sets. For sets of a size band the threshold bounds
that number by d. The sketch has k > d blocks; of two linked sets at least k - d blocks are equal. A
block is as wide as hashes are, so that unlike shingles hardly meet in a bit; of its few set bits only
the XOR of their hashes is kept. A block without a set bit says nothing, so k leaves room for such blocks: when one of two
sets has fewer than k - d of them, at least one equal block is not empty, and joining on (band, block
number, block) meets the pair. Sets with more empty blocks also send a sketch by the next seed, and
after the last seed they meet in one bucket of their band. So no pair is lost.

As k leaves more room than that, linked sets share c blocks and not just one. In any common order of
the buckets they then meet in one that is not among the last c - 1 of either; with the largest buckets
last, each set leaves its c - 1 largest buckets, which passages of many documents fill. The two sets'
own sizes bound their difference more closely than the band does; pairs that meet in fewer buckets than
that asks for are not read.

Sets in a bucket are not paired with each other: each is compared with the one of the bucket that
stands in most buckets (of slightly changed copies, the original). After components are known, sets still
apart from that centre may be linked with other members. Parities are linear, so the symmetric difference
of two members is that of their own differences from the centre. A set that the centre is not linked with
differs from it by so much that a partner must share about half of the partner's difference. Two sets
that share t values have one in common among all but the last t - 1 of each, in any common order. With
values the centre lacks first, slightly changed copies, and texts that only share a passage with the
centre, hardly meet there; pairs that do are verified.

The verified pairs connect every component: any two linked sets are in one, and a chain of verified pairs
leads from one to the other. Equal sets are one set, and its members stand beside the pairs. The links of
a group of near copies are as many as its pairs, so they are not all written out.

Very long texts are sets like others: a text is read whole by one task, and its keys are a row each.
"""

from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalcells.llm.graph import components
from vitalcells.llm.arrow import LAST, record_batch
from vitalcells.llm.scratch import Scratch
from vitalcells.llm.textbytes import (NOT_SPACE, mix, pieces, signed, windows_of, word_hashes,
                                      words_of)
from vitalcells.storage import small

WORDS = 5
PERCENT = 80
SEEDS = 4
#: Words of 64 bits of the sketch that is compared before two sets are.
FILTER_WORDS = 16
SMALLEST = 4
#: Rows of three numbers that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000
_STEP = 0x9E3779B97F4A7C15

SETS = "doc_id long, text_id long, n_shingles long, set_id long, sure int, spared int, keys array<long>"


class Bands:
    """Size bands in steps of the threshold, and the blocks of each."""

    def __init__(self, percent: int):
        if not 50 < percent < 100:
            raise ValueError("the threshold must lie between 50 and 100 percent")
        self.percent = percent
        self.edges = [SMALLEST]
        self._blocks: dict[int, tuple[int, int]] = {}

    def difference(self, size: int) -> int:
        """Most shingles in only one of two linked sets, of which the smaller has this size."""
        both = size + size * 100 // self.percent
        return both * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> int:
        """The band of a size; below the smallest edge, each size is a band."""
        if size < SMALLEST:
            return -size
        while self.edges[-1] <= size:
            last = self.edges[-1]
            self.edges.append(max(last + 1, last * 100 // self.percent))
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def probed(self, size: int) -> list[int]:
        """Bands that a set of this size meets others in: its own and those of smaller partners."""
        smallest = -(-size * self.percent // 100)
        tiny = [self.of(s) for s in range(smallest, min(size + 1, SMALLEST))]
        if size < SMALLEST:
            return tiny
        return [*tiny, *range(self.of(max(smallest, SMALLEST)), self.of(size) + 1)]

    def blocks(self, band: int) -> tuple[int, int]:
        """Number of blocks, and most empty blocks that leave one equal block not empty.

        No blocks: sets linked in this band are equal.
        """
        if band not in self._blocks:
            low, high = (-band, -band) if band < 0 else (self.edges[band], self.edges[band + 1] - 1)
            self._blocks[band] = self._choose(low, self.difference(high))
        return self._blocks[band]

    @staticmethod
    def _choose(low: int, d: int) -> tuple[int, int]:
        if d == 0:
            return 0, 0
        # A fifth more blocks than needed: sets that only share a passage then meet in too few.
        for k in range(max(d + 2, d * 6 // 5), d + d // 2 + 4):
            empty = k * exp(-low / k)
            if k - d - 1 >= empty + sqrt(empty):
                return k, k - d - 1
        return d + 2, 1


def _placed(hashes: np.ndarray, blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each value, and its place inside the block."""
    values = mix(hashes + np.uint64((seed + 1) * _STEP % (1 << 64)))
    block = ((values >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    return block.astype(np.intp), mix(values)


def sketch(hashes: np.ndarray, blocks: int, seed: int) -> np.ndarray:
    """Blocks of 64 bits, in which each value flips one."""
    block, place = _placed(hashes, blocks, seed)
    out = np.zeros(blocks, np.uint64)
    np.bitwise_xor.at(out, block, np.uint64(1) << (place & np.uint64(63)))
    return out


def wide_sketch(hashes: np.ndarray, blocks: int, seed: int) -> np.ndarray:
    """The XOR of the places that are set in each wide block."""
    block, place = _placed(hashes, blocks, seed)
    out = np.zeros(blocks, np.uint64)
    np.bitwise_xor.at(out, block, place)
    return out


def keys_of(shingles: np.ndarray, bands: Bands) -> tuple[np.ndarray, int, int]:
    """Join keys of a set: its blocks that are not empty, in its own band and those below.

    Also how many of them every larger linked set shares but for their difference, and how many of
    them may be left out since any linked set shares more; 0 where empty blocks leave nothing sure.
    """
    out, sure, spared = [shingles[:0]], 0, len(shingles)
    for band in bands.probed(len(shingles)):
        k, spare = bands.blocks(band)
        for seed in range(SEEDS if k else 0):
            blocks = wide_sketch(shingles, k, seed)
            full = np.flatnonzero(blocks)
            name = np.uint64(((band + 64) * 64 + seed) * _STEP % (1 << 64))
            out.append(mix(mix(blocks[full] + name) + full.astype(np.uint64)))
            if k - len(full) <= spare:
                sure = len(full) if seed == 0 else 0
                # Of the full blocks at most k - 1 - spare, the band's difference, are not shared.
                spared = min(spared, len(full) - (k - spare)) if seed == 0 else 0
                break
        else:
            sure = spared = 0
            if k:
                out.append(mix(np.array([((band + 64) * 64 + 63) * _STEP % (1 << 64)], np.uint64)))
    return np.concatenate(out), sure, spared


def shingle_sets(texts, size: int):
    """Per row: its distinct shingles, sorted; rows with fewer words have one of all of them."""
    words = words_of(texts, NOT_SPACE)
    hashes = word_hashes(texts, words)
    windows = windows_of(hashes, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            found = np.sort(windows[a:b - size + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        elif b > a:
            yield windows_of(hashes[a:b], b - a)
        else:
            yield hashes[:0]


def _set_id(shingles: np.ndarray) -> int:
    total = mix(shingles + np.uint64(_STEP)).sum() ^ mix(shingles.sum(keepdims=True))
    return int(signed(mix(total + np.uint64(len(shingles))))[0])


def set_rows(size: int, percent: int):
    """One row per document: the size of its set, the set's id and its join keys. Of equal sets in a
    piece only the first sends keys, as they join as one."""
    names = ["doc_id", "text_id", "n_shingles", "set_id", "sure", "spared", "keys"]

    def run(batches):
        bands = Bands(percent)
        for batch in batches:
            for rows, texts in pieces(batch):
                counts, ids, keys, ends, sent = [], [], [], [0], {}
                sure = []
                for shingles in shingle_sets(texts, size):
                    counts.append(len(shingles))
                    ids.append(_set_id(shingles) if len(shingles) else None)
                    ends.append(ends[-1])
                    if len(shingles) and ids[-1] not in sent:
                        own, *sent[ids[-1]] = keys_of(shingles, bands)
                        keys.append(signed(own))
                        ends[-1] += len(own)
                    sure.append(sent.get(ids[-1], (0, 0)))
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield record_batch(names, rows.column("doc_id"), rows.column("text_id"),
                             pa.array(counts, pa.int64()), pa.array(ids, pa.int64()),
                                   pa.array([x for x, _ in sure], pa.int32()),
                                   pa.array([x for _, x in sure], pa.int32()), lists)

    return run


def full_buckets(keys: DataFrame) -> DataFrame:
    """Sets of each key (key, set_id) that has several, and their number."""
    distinct = keys.repartition("key").distinct()
    return (distinct.withColumn("size", F.count("*").over(Window.partitionBy("key")))
            .where("size > 1"))


def shingle_rows(size: int):
    """Shingles of each set, and a short parity sketch of them."""
    names = ["set_id", "shingles", "parity"]

    def lists(parts):
        ends = np.cumsum([0, *map(len, parts)])
        flat = signed(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch):
                sets = list(shingle_sets(texts, size))
                yield record_batch(names, rows.column("set_id"), lists(sets),
                             lists([sketch(s, FILTER_WORDS, SEEDS) for s in sets]))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that reach the threshold."""
    a = sets.toDF("a", "shingles_a", "parity_a")
    b = sets.toDF("b", "shingles_b", "parity_b")
    both = F.size("shingles_a") + F.size("shingles_b")
    apart = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                        F.lit(0), lambda total, n: total + n)
    inside = F.size(F.array_intersect("shingles_a", "shingles_b"))
    near = apart * (100 + percent) <= both * (100 - percent)
    return (pairs.join(a, "a").join(b, "b")
            .where(F.when(near, inside * (100 + percent) >= both * percent).otherwise(False))
            .select("a", "b"))


def _better_centres(members: DataFrame, links: DataFrame, sizes: DataFrame) -> DataFrame:
    """For centres (first) that are like one with more members, that one (centre).

    A changed copy that is a bucket's centre lacks values that all others have. Any set may serve as the
    centre of a group, so this only decides how few pairs meet.
    """
    weight = members.groupBy("first").agg(F.count("*").alias("weight"))
    own = weight.select(F.col("first").alias("set_id"), F.col("weight").alias("own"))
    like = (links.groupBy("first", "set_id").agg(F.count("*").alias("shared"))
            .join(own, "set_id").join(sizes.select("set_id", "degree"), "set_id")
            .where(F.col("shared") * 4 >= F.col("degree")))
    return (like.join(weight, "first").where("weight > own").groupBy("set_id")
            .agg(F.max(F.struct("weight", "first")).alias("c"))
            .select(F.col("set_id").alias("first"), F.col("c.first").alias("centre")))


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Per member of a centre's buckets: whether the two are linked though apart so far, the size of their
    difference, and those of its values, the ones that the centre lacks first, by which it can meet
    others. `indexed` is how many of them meet a set that the centre is not linked with."""
    over, under = 100 + percent, 100 - percent
    centre = sets.select(F.col("set_id").alias("first"), F.col("shingles").alias("of_first"))
    both = (members.join(sets.select("set_id", "shingles"), "set_id").join(centre, "first")
            .withColumn("added", F.array_except("shingles", "of_first"))
            .withColumn("removed", F.array_except("of_first", "shingles"))
            .withColumn("n_first", F.size("of_first")).withColumn("differ", F.size("added") + F.size("removed")))
    linked = F.col("apart") & (F.col("differ") * over <= (F.col("n") + F.col("n_first")) * under)
    # Linked sets differ by no more than this, so all but as many of a difference are shared.
    most = F.floor(F.col("n") * under / percent) + 1
    shared = F.ceil((F.col("differ") * over + (F.col("n_first") - F.col("n")) * under + 1) / (2 * over))
    return (both.withColumn("linked", linked).withColumn("probes", F.col("apart") & ~F.col("linked"))
            .withColumn("indexed", F.least(F.col("differ") - shared + 1, most).cast("int"))
            .withColumn("length", F.when(F.col("probes"), F.least(F.col("differ"), most)).otherwise(F.col("indexed")))
            .select("first", "set_id", "n", "label", "differ", "linked", "probes", "indexed",
                    F.slice(F.concat("added", "removed"), F.lit(1), F.col("length").cast("int")).alias("values")))


def _meeting(differences: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) with a common value in their differences from a centre, one of them apart
    from it, whose sizes allow a link, and also the places of the value: at the first value that two
    differences share, the values before it are in one of them only, and of the rest at least as many
    as one is longer."""
    over, under = 100 + percent, 100 - percent
    values = differences.select("*", F.posexplode("values").alias("place", "value")).drop("values")
    a = (values.where("probes")
         .select("first", "value", *[F.col(x).alias(y) for x, y in
                                     zip(("set_id", "n", "label", "differ", "place"),
                                         ("a", "n_a", "label_a", "differ_a", "place_a"))]))
    b = (values.where("place < indexed")
         .select("first", "value", *[F.col(x).alias(y) for x, y in
                                     zip(("set_id", "n", "label", "differ", "place", "probes"),
                                         ("b", "n_b", "label_b", "differ_b", "place_b", "probes_b"))]))
    before = F.col("place_a") + F.col("place_b")
    rest = F.abs((F.col("differ_a") - F.col("place_a")) - (F.col("differ_b") - F.col("place_b")))
    # Two sets that both look for others meet in either direction; one is enough.
    met = (a.join(b, ["first", "value"]).where("label_a != label_b and (not probes_b or a < b)")
           .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
           .where((before + rest) * over <= (F.col("n_a") + F.col("n_b")) * under))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"), "text")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Documents with the smallest doc_id reachable by links of similar shingle sets.

    Returns doc_id, n_shingles, component_id and set_id (equal for equal sets, null for empty ones).
    Lower-cases A-Z. Null and blank texts are empty sets, linked with nothing: their component is
    their own id. Repeated rows have equal sets and so one component; rows with a null doc_id take
    part in links, and a component without any id has a null one. Further columns of the input are
    not read.
    """
    return _components(docs, words, percent)[0].select("doc_id", "n_shingles", "component_id", "set_id")


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Verified links (set_a, set_b) of different sets, set_a < set_b, once each, that connect every
    component; and the members of the sets (doc_id, text_id, n_shingles, set_id, component_id), a row per
    document with words."""
    documents, links = _components(docs, words, percent)
    members = documents.where("set_id is not null").select("doc_id", "text_id", "n_shingles", "set_id", "component_id")
    return links.select(F.least("a", "b").alias("set_a"), F.greatest("a", "b").alias("set_b")).distinct(), members


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns: the smallest doc_id, of repeated ids the
    one with the smallest hash of its text, of repeated rows one. Documents without words all stay."""
    found, _ = _components(docs, words, percent)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text_id"))
    chosen = (found.where("label is not null").groupBy("label").agg(first.alias("r"))
              .select(F.col("r.doc").alias("r_doc"), F.col("r.text_id").alias("r_text")))
    # The whole row is one column, so that none of its names can clash.
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("r_doc"),
                      F.xxhash64(F.coalesce("text", F.lit(""))).alias("r_text"))
    has_words = F.coalesce("row.text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    once = own.where(has_words).join(chosen, ["r_doc", "r_text"], "left_semi")
    # Repeated rows share their key; one of each is kept.
    once = once.dropDuplicates(["r_doc", "r_text"])
    return once.unionByName(own.where(~has_words)).select("row.*")


def _components(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_id, n_shingles, set_id, label (of the component, null for empty sets) and
    component_id of each document; and the verified links (a, b) of different sets."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = _texts(docs)
    table = scratch.write(texts.mapInArrow(set_rows(words, percent), SETS), "sets")
    rows = table.select(F.explode("keys").alias("key"), "set_id")
    buckets = scratch.write(full_buckets(rows), "buckets")
    met = buckets.groupBy("set_id").agg(F.count("*").alias("degree"))
    holder = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text_id"))
    sizes = scratch.write(table.join(met, "set_id").groupBy("set_id")
                          .agg(F.first("n_shingles").alias("n"), F.max("sure").alias("sure"),
                               F.max("spared").alias("spared"), F.first("degree").alias("degree"),
                               holder.alias("holder")), "sizes")
    # Each set leaves its largest buckets, as many as it can spare; a set has no more buckets than keys.
    largest = Window.partitionBy("set_id").orderBy(F.desc("size"), F.desc("key"))
    kept = scratch.write(
        buckets.join(sizes.where("degree > spared").select("set_id", "spared", "degree", "n"), "set_id")
        .withColumn("place", F.row_number().over(largest)).where("place > spared")
        .select("key", "set_id", "degree", "n"), "kept-buckets")
    centre = F.max(F.struct("degree", "set_id"))
    heads = (kept.groupBy("key").agg(centre.alias("c"), F.count("*").alias("size")).where("size > 1")
             .select("key", F.col("c.set_id").alias("first")))
    links = scratch.write(kept.join(heads, "key").where("set_id != first")
                          .select("key", "first", "set_id", "n"), "links")
    a, b = (sizes.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"),
                         F.col("sure").alias(f"sure_{x}"), F.col("spared").alias(f"spared_{x}"))
            for x in "ab")

    def fitting(pairs: DataFrame) -> DataFrame:
        """Distinct pairs that meet in as many buckets as their sizes ask of linked sets."""
        both = F.col("n_a") + F.col("n_b")
        differ = F.floor(both * (100 - percent) / (100 + percent))
        sure = F.when(F.col("n_a") <= F.col("n_b"), F.col("sure_a")).otherwise(F.col("sure_b"))
        sure = sure - differ - F.col("spared_a") - F.col("spared_b")
        return (pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .agg(F.count("*").alias("shared")).join(a, "a").join(b, "b")
                .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
                .where(F.col("shared") >= F.greatest(F.lit(1), sure)).select("a", "b"))

    def read_again(ids: DataFrame) -> DataFrame:
        """Shingles and parity of sets, from a text that has each."""
        holders = (sizes.join(ids, "set_id")
                   .select("set_id", F.col("holder.doc").alias("doc"), F.col("holder.text_id").alias("text_id")))
        held = (texts.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text_id", "text")
                .join(small(scratch.write(holders, "holders"), MOST_BROADCAST), ["doc", "text_id"])
                .select("set_id", "text"))
        return scratch.write(
            held.mapInArrow(shingle_rows(words),
                            "set_id long, shingles array<long>, parity array<long>")
            .groupBy("set_id").agg(F.first("shingles").alias("shingles"),
                                   F.first("parity").alias("parity")), "shingles")

    # Not all buckets of a pair are seen here, so a link may wait for the second round.
    pairs = scratch.write(
        fitting(links.select(F.col("first").alias("a"), F.col("set_id").alias("b"))), "to-first")
    sets = read_again(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
    near = scratch.write(_verified(pairs, sets, percent), "linked")
    labels = components(near, scratch)

    # Members of buckets in which a set is still apart from the centre, once per centre.
    label = F.coalesce("component", "set_id")
    heads = labels.select(F.col("node").alias("first"), F.col("component").alias("first_label"))
    labelled = scratch.write(
        links.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
        .select("key", "first", "set_id", "n", label.alias("label")).join(heads, "first", "left")
        .select("key", "first", "set_id", "n", "label",
                (F.col("label") != F.coalesce("first_label", "first")).alias("apart")), "labelled")
    open_keys = labelled.groupBy("key").agg(F.max("apart").alias("any")).where("any").select("key")
    members = scratch.write(
        labelled.join(open_keys, "key", "left_semi").groupBy("first", "set_id")
        .agg(F.first("n").alias("n"), F.first("label").alias("label")), "members")
    centres = scratch.write(_better_centres(members, links, sizes), "centres")
    label_of = labels.select(F.col("node").alias("set_id"), F.col("component").alias("label"))
    moved = (centres.select(F.col("centre").alias("first"), F.col("first").alias("set_id"))
             .join(sizes.select("set_id", "n"), "set_id").join(label_of, "set_id", "left")
             .select("first", "set_id", "n", F.coalesce("label", "set_id").alias("label")))
    members = scratch.write(
        members.join(centres, "first", "left").withColumn("first", F.coalesce("centre", "first"))
        .select("first", "set_id", "n", "label").union(moved).where("first != set_id").distinct()
        .join(heads, "first", "left")
        .withColumn("apart", F.col("label") != F.coalesce("first_label", "first")).drop("first_label"),
        "members")
    sets = read_again(members.select(F.explode(F.array("first", "set_id")).alias("set_id")).distinct())
    differences = scratch.write(_differences(members, sets, percent), "differences")
    direct = differences.where("linked").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
    others = scratch.write(_meeting(differences, percent), "meeting")
    more = scratch.write(_verified(others, sets, percent).union(direct), "linked")
    if not more.isEmpty():
        labels = components(near.union(more), scratch)

    named = (table.drop("keys", "sure").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
             .withColumn("label", F.coalesce("component", "set_id")))
    smallest = (named.where("label is not null").groupBy("label")
                .agg(F.min("doc_id").alias("smallest")))
    documents = (named.join(smallest, "label", "left")
                 .select("doc_id", "text_id", "n_shingles", "set_id", "label",
                         F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
                         .alias("component_id")))
    return documents, near.union(more)
