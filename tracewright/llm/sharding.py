"""Minimax contiguous partition of documents into shards of near equal bytes.

Equal texts form an atomic group: a shard has all of a group or none. Groups are ordered by the hash of their text, and
ranges of that order are summed in one aggregation. Only those sums, of a bounded number whatever the input, reach the
driver. There the smallest feasible capacity is binary-searched, each try by a greedy scan. Ranges in which a cut may lie are then
summed again by finer ranges, down to single groups, until the capacity is the smallest over all groups; the order is cut within it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.workspace import materialize

SHARDS = 40
#: Bits of the hash that the first ranges have, and that each further round adds. Some 100,000 sums are on the driver at once.
BITS, MORE = 16, 8
#: Rows whose slots one task counts.
RUN = 20_000


def feasible(upto: np.ndarray, shards: int, capacity: int) -> bool:
    """Greedy check: fill shard after shard as far as the capacity goes. upto: running sums from 0 on."""
    at = 0
    for _ in range(shards):
        at = int(np.searchsorted(upto, upto[at] + capacity, "right")) - 1
    return at == len(upto) - 1


def capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity with which the ordered sizes fit the shards contiguously."""
    upto = np.r_[0, np.cumsum(sizes)]
    low, high = max(int(sizes.max(initial=0)), -(-int(upto[-1]) // shards)), int(upto[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(upto, shards, middle) else (middle + 1, high)
    return low


def cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """The first position of each shard. Under the smallest capacity each shard ends as near to an even share of what is left as the rest allows."""
    most, n = capacity(sizes, shards), len(sizes)
    upto = np.r_[0, np.cumsum(sizes)]
    need = np.zeros(n + 1, np.int64)
    reach = np.searchsorted(upto, upto + most, "right") - 1
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[reach[i]] if reach[i] > i else 0
    at, out = 0, []
    for shard in range(shards):
        out.append(at)
        left = shards - shard - 1
        if at == n:
            continue
        least = at + int(np.argmax(need[at:] <= left))
        even = upto[at] + (upto[-1] - upto[at]) / (left + 1)
        near = int(np.searchsorted(upto, even))
        near -= near > at + 1 and abs(upto[near - 1] - even) <= abs(upto[near] - even)
        at = min(max(near, least), int(reach[at])) if left else n
    return out


class Ranges:
    """Consecutive ranges of the hash order: first places, sizes, and whether each is one group, which can't be cut."""

    def __init__(self, first: np.ndarray, size: np.ndarray, single: np.ndarray):
        self.first, self.size, self.single = first, size, single

    def open_ranges(self, shards: int) -> tuple[int, np.ndarray]:
        """The smallest capacity over these ranges, and which of them a cut by the smallest over all groups may lie in."""
        upto = np.r_[0, np.cumsum(self.size)]
        most = capacity(self.size, shards)
        least = max(int(self.size[self.single].max(initial=0)), -(-int(upto[-1]) // shards))
        large = ~self.single & (self.size > least // 8)
        if large.any():  # a bound from below needs small ranges
            return most, large
        open_ = np.zeros(len(self.size), bool)
        near = far = 0  # where a shard ends at the earliest, as a range, and at the latest, as a sum
        for _ in range(shards if least < most else 0):
            near = int(np.searchsorted(upto, upto[near] + least, "right")) - 1
            far = min(far + most, int(upto[-1]))
            open_[near : int(np.searchsorted(upto, far, "left"))] = True
        # stretches without anything to cut are done; the others stay whole, so they are few
        edge = np.flatnonzero(np.diff(np.r_[0, open_.astype(np.int8), 0])).reshape(-1, 2)
        for a, b in edge.tolist():
            open_[a:b] = not self.single[a:b].all()
        return most, open_

    def refined(self, open_: np.ndarray, finer: Ranges) -> Ranges:
        keep = ~open_
        made = [np.concatenate([a[keep], b]) for a, b in ((self.first, finer.first), (self.size, finer.size), (self.single, finer.single))]
        order = np.argsort(made[0], kind="stable")
        return Ranges(*(x[order] for x in made))


def _summed(sized: DataFrame, bits: int) -> Ranges:
    """The ranges of so many leading bits of the place that have rows."""
    found = sized.groupBy(F.shiftright("place", 64 - bits).alias("cell")).agg(F.sum("size"), F.min("place") == F.max("place")).collect()
    first = np.array([c for c, _, _ in found], np.int64) << (64 - bits)
    order = np.argsort(first)
    return Ranges(first[order], np.array([s for _, s, _ in found], np.int64)[order], np.array([x for _, _, x in found], bool)[order])


def boundaries(sized: DataFrame, shards: int) -> list[int | None]:
    """The place that each shard but the first begins with, for sized(place, size); None for a shard beyond the last group."""
    ranges, bits = _summed(sized, BITS), BITS
    while True:
        _, open_ = ranges.open_ranges(shards)
        if not open_.any():
            break
        bits = min(64, bits + MORE)
        edge = np.flatnonzero(np.diff(np.r_[0, open_.astype(np.int8), 0])).reshape(-1, 2)
        ends = np.r_[ranges.first[1:], np.iinfo(np.int64).max]
        inside = [F.col("place").between(int(ranges.first[a]), int(ends[b - 1]) - (b < len(ends))) for a, b in edge.tolist()]
        ranges = ranges.refined(open_, _summed(sized.where(reduce(lambda x, y: x | y, inside)), bits))
    return [int(ranges.first[s]) if s < len(ranges.first) else None for s in cuts(ranges.size, shards)[1:]]


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    size is the text's UTF-8 bytes (null: none) plus 16, and the law is that shards' sizes are near equal, with the
    largest as small as the order of groups allows. Null texts are one group, empty ones another; the checksum of both is 0. slot numbers a shard's rows
    from 0 by hash of doc_id; of rows with one doc_id, the smaller text_crc32 comes first. grown_shard is null. Other columns play no part.
    """
    sized = materialize(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
            F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"),
            F.xxhash64("text").alias("place"),
        ),
        "sized",
    )
    starts = boundaries(sized, shards)
    begun = [(F.col("place") >= x).cast("int") for x in starts if x is not None]
    shard = reduce(lambda a, b: a + b, begun, F.lit(0))
    runs = max(1, sized.count() // RUN // shards)
    placed = sized.withColumn("shard", shard).withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).cast("int"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "run").agg(F.count("*").alias("own")).select("shard", "run", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return placed.join(offsets, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.row_number().over(within) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_minimax_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
