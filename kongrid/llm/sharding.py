"""Minimax contiguous partition of atomic groups into shards, with DataFrame functions only.

Groups are rows of equal text, ordered by a digest, so that an interval of digests (a block) holds its share of the
groups whatever the texts are. Block totals are a table of fixed size; the greedy walk of a trial capacity uses them and
reads the groups of a block only where the block totals leave the walk open.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kongrid.operators.cut import cut

# Hex digits of the digest that name a block: 16**4 blocks, so at most 65,536 totals reach the driver at any input size.
BLOCK_DIGITS = 4
# Buckets of rows per shard for dealing out slots; shards x SLOT_BUCKETS counts are broadcast.
SLOT_BUCKETS = 1024


class _Walk:
    """Greedy cuts over prefix sums that are known at block ends, and inside the blocks that were fetched."""

    def __init__(self, blocks, fetch):
        self.names, self.ends, self.last, total = [], [], [], 0
        for b in blocks:
            total += b["bytes"]
            self.names.append(b["block"])
            self.ends.append(total)
            self.last.append(b["last"])
        self.total, self.fetch, self.inside = total, fetch, {}

    def block_at(self, x: int) -> int:
        return bisect_right(self.ends, x)

    def cut_at(self, x: int):
        """(known prefix sum at or below x, digest where it ends, whether no unknown one lies between)."""
        k = self.block_at(x)
        if k == len(self.ends):
            return self.total, None, True
        start = (self.ends[k - 1], self.last[k - 1]) if k else (0, None)
        if start[0] == x:
            return *start, True
        if k not in self.inside:
            return *start, False
        sums, digests = self.inside[k]
        j = bisect_right(sums, x)
        return (sums[j - 1], digests[j - 1], True) if j else (*start, True)

    def load(self, spans) -> None:
        want = sorted({k for a, b in spans for k in range(self.block_at(a), min(self.block_at(b), len(self.ends) - 1) + 1)} - set(self.inside))
        rows = {}
        for r in self.fetch([self.names[k] for k in want]):
            rows.setdefault(r["block"], []).append(r)
        for k in want:
            at, sums, digests = self.ends[k - 1] if k else 0, [], []
            for r in rows[self.names[k]]:
                at += r["bytes"]
                sums.append(at)
                digests.append(r["digest"])
            self.inside[k] = (sums, digests)

    def feasible(self, capacity: int, shards: int) -> bool:
        while True:
            low = high = 0
            spans = []
            for _ in range(shards):
                spans.append((low + capacity, high + capacity))
                low = self.cut_at(low + capacity)[0]
                value, _, exact = self.cut_at(high + capacity)
                high = value if exact else high + capacity
            if low >= self.total:
                return True
            if high < self.total:
                return False
            self.load(spans)

    def cuts(self, capacity: int, shards: int) -> list[str]:
        """Last digest of every shard but the last one that is used."""
        at, out = 0, []
        for _ in range(shards):
            value, digest, exact = self.cut_at(at + capacity)
            if not exact:
                self.load([(at + capacity, at + capacity)])
                value, digest, exact = self.cut_at(at + capacity)
            if value >= self.total:
                break
            at = value
            out.append(digest)
        return out


def smallest_capacity(walk: _Walk, shards: int, largest: int) -> int:
    low = max(largest, -(-walk.total // shards))
    high = max(low, walk.total // shards + largest)
    while low < high:
        mid = (low + high) // 2
        if walk.feasible(mid, shards):
            high = mid
        else:
            low = mid + 1
    return low


def _partition(groups: DataFrame, shards: int) -> tuple[list[str], list[str], int]:
    """Cut digests, digests of groups with a shard of their own, and the largest shard."""
    top = groups.orderBy(F.desc("bytes"), "digest").limit(shards + 1).collect()
    total = groups.agg(F.sum("bytes")).first()[0]

    def solve(own: list, n: int):
        rest = groups.where(~F.col("digest").isin([r["digest"] for r in own])) if own else groups
        blocks = rest.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.max("digest").alias("last")).orderBy("block").collect()
        if not blocks:
            return [], 0
        walk = _Walk(blocks, lambda names: rest.where(F.col("block").isin(names)).orderBy("digest").collect() if names else [])
        capacity = smallest_capacity(walk, n, top[len(own)]["bytes"])
        return walk.cuts(capacity, n), capacity

    own, left = [], total
    while len(own) < shards - 1 and len(own) < len(top) and top[len(own)]["bytes"] * (shards - len(own)) > left:
        left -= top[len(own)]["bytes"]
        own.append(top[len(own)])
    cuts, capacity = solve(own, shards - len(own))
    if own and capacity > own[0]["bytes"]:  # leaving the heavy groups in the order may do better
        plain, alone = solve([], shards)
        if alone < capacity:
            return plain, [], alone
    return cuts, [r["digest"] for r in own], max([capacity, *(r["bytes"] for r in own)])


def shard_minimax(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, digest, shard (0 to shards - 1), slot (0, 1, ... in the shard).

    The size of a row is its text's UTF-8 bytes plus 1. Rows of equal text are one group and share a shard. Groups lie in
    digest order; the smallest capacity is found by binary search with a greedy check and the order is cut there. A group
    larger than an even share gets a shard of its own and the rest is partitioned over the other shards, where that does
    not raise the largest shard. Null texts count as empty. Rows repeated in full take one slot each. With fewer groups
    than shards some shards stay empty. An empty table gives no rows. Other columns of `docs` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias(id_col),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.substring(F.sha2(text.cast("binary"), 256), 1, 32).alias("digest"),
        )
    )
    groups = cut(
        rows.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("block", F.substring("digest", 1, BLOCK_DIGITS)).repartition("block").sortWithinPartitions("block", "digest")
    )
    shard = F.lit(0)
    if groups.limit(1).count():
        cuts, own, _ = _partition(groups, shards)
        for d in cuts:
            shard = shard + (F.col("digest") > d).cast("int")
        for k, d in enumerate(own):
            shard = F.when(F.col("digest") == d, F.lit(shards - 1 - k)).otherwise(shard)
    dealt = rows.withColumn("shard", shard.cast("int")).withColumn("_bucket", F.pmod(F.xxhash64(id_col, "digest"), F.lit(SLOT_BUCKETS)).cast("int"))
    per = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(id_col, "digest")
    return (
        dealt.withColumn("_k", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "_bucket"])
        .select(id_col, "size", "text_crc32", "digest", "shard", (F.col("_from") + F.col("_k") - 1).cast("long").alias("slot"))
    )
