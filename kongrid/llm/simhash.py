"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. Manhattan distance between such vectors never exceeds
the Hamming distance, so a range join under it loses no link. The join's grid: coordinates are dealt to m blocks, and
vectors within distance r differ in at most r blocks, so two linked fingerprints share a cell of at least one of the grids
spanned by m - r blocks. Cells are joined by sorting; inside a cell the Manhattan bound is tested on byte segments, then
the Hamming distance. m grows with the number of distinct fingerprints, which keeps the occupancy of cells level.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kongrid.llm.common import attach_left, map_rows, utf8
from kongrid.llm.components import components
from kongrid.operators.cut import cut

WIDTH = 4
SEED = 42
SEGMENTS = 32
# Two random two-bit segments have the same bit count with probability 3/8.
BITS_PER_SEGMENT = -log2(3 / 8)
# Unrelated members that a cell may have on average.
OCCUPANCY = 10
# Members of a cell that are compared as one unit; larger cells are split into units by pairs of parts.
UNIT = 4096
# Runs of up to this many members are compared pair by pair; longer ones by growing trees.
SHORT = 32

_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64)[:, 0]


def majority(digests: bytes) -> int:
    """The 64-bit number whose bits are set in over half of the big-endian 8-byte digests."""
    n = len(digests) // 8
    lanes = _LANES[np.frombuffer(digests, np.uint8)].reshape(n, 8)
    full = n // 255 * 255
    counts = np.zeros(64, np.int64)
    if full:
        counts += lanes[:full].reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    if full < n:
        counts += lanes[full:].sum(axis=0).view(np.uint8).astype(np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """SimHash over word shingles, repeats counted; 0 without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= width:
        return majority(xxhash.xxh64_digest(joined, SEED))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1])
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]))


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def make(columns):
        codes = [fingerprint(t, width) for t in columns[1]]
        return [columns[0], [c - (1 << 64) if c >> 63 else c for c in codes]]

    return map_rows(docs.select(id_col, utf8(text_col).alias("_text")), make, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp long")


def block_count(distinct: int, radius: int) -> int:
    """Fewest blocks for which a cell holds few unrelated fingerprints: comparing them must not cost more than making the row."""
    for m in range(radius + 2, SEGMENTS + 1):
        if distinct * 2 ** (-BITS_PER_SEGMENT * SEGMENTS * (m - radius) / m) < OCCUPANCY or comb(m, radius) > 1000:
            return m
    return SEGMENTS


def grid_masks(m: int, radius: int) -> list[int]:
    """Bit masks over the packed segment counts, one per choice of m - radius blocks."""
    blocks = np.array_split(np.arange(SEGMENTS), m)
    masks = [sum(3 << (2 * int(s)) for s in b) for b in blocks]
    return [sum(masks[i] for i in kept) for kept in combinations(range(m), m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _popcounts(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint8).reshape(-1, 8)).astype(np.int8)


def _linked(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are within the radius: Manhattan distance of byte bit counts as lower bound, then Hamming distance."""
    near = np.flatnonzero(np.abs(_popcounts(a) - _popcounts(b)).sum(axis=1) <= radius)
    return near[np.bitwise_count(a[near] ^ b[near]) <= radius]


def _trees(fp: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect the members of one cell as all their links do, each reached member once."""
    left = fp
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                got = left[near]
                left = left[~near]
                queue.extend(got)
                for y in got:
                    yield x, y


def _cell_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal (grid, cell, unit); batches are sorted by them. A run is at most two parts of UNIT rows."""

    def emit(runs, fp):
        a, b = [], []
        bounds = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1], [True]]))
        size = np.diff(bounds)
        short = np.repeat(size <= SHORT, size)
        for k in range(1, min(SHORT, int(size.max(initial=1)))):
            at = np.flatnonzero((runs[k:] == runs[:-k]) & short[k:])
            hit = at[_linked(fp[at], fp[at + k], radius)]
            a.append(fp[hit])
            b.append(fp[hit + k])
        for s, n in zip(bounds[:-1][size > SHORT].tolist(), size[size > SHORT].tolist()):
            pairs = np.array(list(_trees(fp[s : s + n], radius)), np.uint64).reshape(-1, 2)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        a, b = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
        grid, cell, unit, fp = held
        new = (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1]) | (unit[1:] != unit[:-1])
        runs = np.concatenate([[0], np.cumsum(new)])
        last = int(np.searchsorted(runs, runs[-1]))
        if last:
            yield emit(runs[:last], fp[:last].view(np.uint64))
        held = [x[last:] for x in held]
    if held is not None and len(held[0]):
        yield emit(np.zeros(len(held[0]), np.int64), held[3].view(np.uint64))


def near_links(codes: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect exactly what all links within `radius` connect."""
    m = block_count(codes.count(), radius)
    masks = F.array(*[F.lit(_signed(x)) for x in grid_masks(m, radius)])
    # Bit counts of the two-bit segments, packed: a half adder over the bits of each segment.
    low, x, y = F.lit(0x5555555555555555), F.col("fp"), F.shiftrightunsigned("fp", 1)
    counts = F.shiftleft(x.bitwiseAND(y).bitwiseAND(low), 1).bitwiseOR(x.bitwiseXOR(y).bitwiseAND(low))
    spread = codes.repartition(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    cells = spread.select("fp", counts.alias("_v"), F.posexplode(masks).alias("grid", "_m")).select("grid", F.col("_v").bitwiseAND(F.col("_m")).alias("cell"), "fp")
    hot = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where(F.col("n") > UNIT)
    parts = F.ceil(F.col("n") / UNIT).cast("int")
    whole = attach_left(cells, hot, ["grid", "cell"], "n").withColumn("_parts", F.coalesce(parts, F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda k: F.least(k, F.col("_p")) * F.col("_parts") + F.greatest(k, F.col("_p")))
    dealt = whole.withColumn("_p", mine).select("grid", "cell", F.explode(units).alias("unit"), "fp")
    keyed = dealt.repartition("grid", "cell", "unit").sortWithinPartitions("grid", "cell", "unit", "fp")
    return keyed.mapInArrow(lambda batches: _cell_links(batches, radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Equal fingerprints are one node, so copies are never paired. Null and empty texts have fingerprint 0 and are linked like
    any other; null ids keep their row and count as larger than any id. An empty table gives no rows; other columns are
    ignored.
    """
    prints = cut(fingerprints(docs, width, id_col, text_col))
    codes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("_least"), F.count("*").alias("_n")))
    roots = components(near_links(codes.select("fp"), radius)).withColumnRenamed("node", "fp")
    # Only fingerprints with a link are in `roots`; all others are their own component.
    own = codes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = own.groupBy("root").agg(F.min("_least").alias("_all"), F.count("*").alias("_m")).where("_m > 1")
    named = attach_left(own, least, ["root"], "_m").select("fp", "_n", F.coalesce("_all", "_least").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return attach_left(prints, named, ["fp"], "_n").select(id_col, hexed, "component_id")
