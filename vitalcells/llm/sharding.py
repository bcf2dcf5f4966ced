"""Shards of near equal bytes by Karmarkar-Karp differencing over groups that stay together.

Documents with equal texts are one group and go into one shard. Small groups are bundled by a hash into
`blocks` units; a group larger than a unit's fair share is a unit of its own, so there are never more
than 2 * `blocks` units whatever the input. The units are the numbers of the differencing method: each
begins as a partial partition with one filled slot; the two partial partitions with the largest spread
are combined, the fullest slot of one with the emptiest of the other, until one is left. Documents then
look their unit up, and are numbered within their shard by running sums over (shard, share) counts.

Defined results: a null text has no bytes and is grouped with the empty one; a row's size is its bytes
plus 1, so empty texts count too; a text of any length is one number here; repeated rows are counted and
numbered apart; a null doc_id is an id like any other and stands first in its share; an empty table has
an empty result; other columns are not read. Ties of spread and of size are broken by the units' keys,
so reruns agree. Two texts with the same 64-bit hash, CRC and length are taken for one group: that can
only put two groups together. A group larger than a shard's share makes its shard that large: it may not
be divided, and the other shards are balanced among themselves.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalcells.llm.arrow import longs, record_batch
from vitalcells.llm.scratch import Scratch

SHARDS = 16
#: Units that small groups are bundled into; it bounds the work of the differencing and the balance:
#: a unit is at most a 1/BLOCKS of all bytes unless it is one group.
BLOCKS = 32_768
#: Rows that are numbered in one task.
SHARE_ROWS = 100_000


def difference(sizes: list[int], parts: int) -> list[int]:
    """The part of each number, by largest differencing; ties go to the numbers that come first.

    A partial partition is `parts` sums in falling order, less the smallest one, each with a tree of
    the numbers in it. Combining two adds the fullest slot of one to the emptiest of the other.
    """
    if not sizes:
        return []
    above = np.full(len(sizes), -1, np.int64).tolist()
    heap = [(-size, at, [(size, at)]) for at, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, first, one = heapq.heappop(heap)
        _, second, other = heapq.heappop(heap)
        merged = _combined(one, other, parts, above)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == parts else 0)
        heapq.heappush(heap, (-spread, min(first, second), merged))
    slots = heap[0][2]
    part = [0] * len(above)
    for number, (_, tree) in enumerate(slots):
        part[tree] = number
    # A tree is younger than its branches.
    for at in range(len(above) - 1, -1, -1):
        if above[at] >= 0:
            part[at] = part[above[at]]
    return part[:len(sizes)]


def _combined(one, other, parts: int, above: list[int]):
    """Two partial partitions as one; slots that are not listed are empty."""
    pairs: list[tuple[int, int]] = []
    shared = max(0, len(one) + len(other) - parts)
    pairs += one[:len(one) - shared]
    pairs += other[:len(other) - shared]
    for (a, left), (b, right) in zip(one[len(one) - shared:], reversed(other[len(other) - shared:])):
        above.append(-1)
        tree = len(above) - 1
        above[left] = above[right] = tree
        pairs.append((a + b, tree))
    pairs.sort(key=lambda p: (-p[0], p[1]))
    return pairs


def _units_to_parts(parts: int):
    """Parts of all units; their number is bounded by the caller."""

    def run(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        unit, big, size = (longs(table[c].combine_chunks()) for c in ("unit", "big", "bytes"))
        order = np.lexsort((unit, big, -size))
        part = difference(size[order].tolist(), parts)
        yield record_batch(["unit", "big", "shard"], unit[order], big[order],
                           np.array(part, np.int32))

    return run


def _text_key() -> list[Column]:
    """What tells texts apart, and their digests."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("text_hash"), F.crc32(text.cast("binary")).alias("text_crc32"),
            (F.octet_length(text) + 1).cast("long").alias("size")]


def shard_documents(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS,
                    share_rows: int = SHARE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless in the shard), grown_shard (null,
    as this law does not keep its assignment when a shard is added)."""
    scratch = Scratch(docs.sparkSession, "sharding")
    key = ["text_hash", "text_crc32", "size"]
    rows = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_key())
                         .groupBy("doc_id", *key).agg(F.count("*").alias("copies")), "rows")
    groups = (rows.groupBy(*key).agg(F.sum("copies").alias("copies"))
              .withColumn("bytes", F.col("copies") * F.col("size")))
    groups = scratch.write(groups, "groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)),
                               F.coalesce(F.sum("copies"), F.lit(0))).first()
    # At most `blocks` groups are as large as a fair share.
    fair = max(1, -(-total // blocks))
    big = groups.where(F.col("bytes") >= fair)
    block = F.pmod("text_hash", F.lit(blocks))
    small_units = (groups.where(F.col("bytes") < fair).groupBy(block.alias("unit"))
                   .agg(F.sum("bytes").alias("bytes")))
    units = (big.select(F.xxhash64(*key).alias("unit"), F.lit(1).alias("big"), "bytes")
             .unionByName(small_units.select("unit", F.lit(0).alias("big"), "bytes")))
    parts = scratch.write(units.coalesce(1).mapInArrow(
        _units_to_parts(shards), "unit long, big long, shard int"), "units")

    # Both lookups have at most `blocks` rows.
    of_big = parts.where("big = 1").select(F.col("unit").alias("big_unit"), F.col("shard").alias("big_shard"))
    of_block = parts.where("big = 0").select(F.col("unit").alias("block"), F.col("shard").alias("block_shard"))
    shares = max(1, -(-n_rows // (share_rows * shards)))
    placed = (rows.withColumn("big_unit", F.xxhash64(*key)).withColumn("block", block)
              .join(F.broadcast(of_big), "big_unit", "left")
              .join(F.broadcast(of_block), "block", "left")
              .select("doc_id", *key, "copies", F.coalesce("big_shard", "block_shard").alias("shard"),
                      F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(shares)).alias("share")))
    counts = placed.groupBy("shard", "share").agg(F.sum("copies").alias("in_share"))
    before = Window.partitionBy("shard").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "share", F.coalesce(F.sum("in_share").over(before), F.lit(0)).alias("start"))
    earlier = (Window.partitionBy("shard", "share").orderBy("doc_id", "text_hash", "text_crc32", "size")
               .rowsBetween(Window.unboundedPreceding, -1))
    numbered = placed.withColumn("ahead", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
    first = F.col("start") + F.col("ahead")
    return numbered.join(starts, ["shard", "share"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
