"""Vector code compression: product codebooks whose entries are found by Orchard's search.

Every entry of a codebook keeps the list of all other entries, nearest first. A search holds one entry and walks its list;
an entry that is nearer to the vector takes its place and the walk goes on in that entry's list. Entries already measured
are marked and skipped. An entry further than twice the current distance from the held one can't be nearer, nor can any
after it, so there the search ends with the exact nearest entry. Many searches advance together, a few list places a step.

Codebooks (parts x entries x width / parts integers) are the only thing that the driver holds. A training round is one
pass over the rows: each task adds up the parts that it assigned, one row per entry, and Spark sums those rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kongrid.llm.common import attach_left
from kongrid.llm.vectors import finite, matrix, width_of

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Rows that are searched at once, list places that a search looks at in one step, entries it measures to find its start.
ROWS, PLACES, PROBES = 256, 32, 16
# Components below NARROW in vectors of up to WIDTH keep four times any squared distance below 2^62; others are Python integers.
NARROW, WIDTH = 1 << 23, 2048
LIMB = 32


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: 64-bit where all are narrow, else Python integers."""
    if not x.size or (x.shape[1] <= WIDTH and np.abs(x).max() < NARROW / SCALE - 1):
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) * SCALE if abs(v) >= 1 << 52 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return out


class Codebook:
    """Entries (n x width, 64-bit or Python integers) with their distance-sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries, n = entries, len(entries)
        wide = entries.dtype == object
        between = np.zeros((n, n), object if wide else np.int64)
        for k in range(entries.shape[1]):
            between += (entries[:, None, k] - entries[None, :, k]) ** 2
        np.fill_diagonal(between, -1)
        order = np.argsort(between, axis=1, kind="stable")[:, 1:]
        pad = ((0, 0), (0, PLACES))
        self.lists = np.pad(order, pad)
        self.reach = np.pad(np.take_along_axis(between, order, 1), pad)
        # A search starts at the nearest of a few entries spread over the codebook.
        self.probes = np.unique(np.linspace(0, n - 1, PROBES).astype(np.int64))

    def _distance(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        d = x - (self.entries[entry] if np.ndim(entry) == 0 else self.entries.take(entry, axis=0))
        return (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (of equally near ones the lowest) and squared distance of each row of `x`."""
        n, size = len(x), len(self.entries)
        if x.dtype == object or self.entries.dtype == object:
            x = x.astype(object)
        probed = np.stack([self._distance(x, p) for p in self.probes])
        held, best = self.probes[probed.argmin(axis=0)], probed.min(axis=0)
        visited = np.zeros((n, size), bool)
        visited[:, self.probes] = True
        place, active = np.zeros(n, np.int64), np.arange(n if size > 1 else 0)
        while len(active):
            # Lists are padded, so a block never leaves its own.
            at = place[active][:, None] + np.arange(PLACES)
            flat = held[active][:, None] * self.lists.shape[1] + at
            entry, open_ = self.lists.take(flat), (at < size - 1) & (self.reach.take(flat) <= 4 * best[active][:, None])
            row, column = np.nonzero(open_ & ~visited.take(active[:, None] * size + entry))
            searches, tried = active[row], entry[row, column]
            visited[searches, tried] = True
            found = self._distance(x[searches], tried)
            better = (found < best[searches]) | ((found == best[searches]) & (tried < held[searches]))
            searches, tried, found = searches[better], tried[better], found[better]
            order = np.lexsort((tried, found, searches)) if found.dtype != object else np.array(sorted(range(len(found)), key=lambda i: (searches[i], found[i], tried[i])), np.int64)
            searches, first = np.unique(searches[order], return_index=True)
            ended = ~open_[:, -1]
            place[active] += PLACES
            held[searches], best[searches], place[searches] = tried[order][first], found[order][first], 0
            jumped = np.zeros(n, bool)
            jumped[searches] = True
            active = active[~ended | jumped[active]]
        return held, best


def _limbs(values: list[int]) -> list[list[int]]:
    """Integers as sums of limb * 2^(LIMB * place); the last limb carries the sign, so limbs can be added up one by one."""
    out = []
    for v in values:
        limbs = []
        while not -(1 << LIMB) <= v < 1 << LIMB:
            limbs.append(v & ((1 << LIMB) - 1))
            v >>= LIMB
        out.append([*limbs, v])
    return out


def _searched(width: int, books: list[np.ndarray]) -> Callable:
    """A function from batches with vectors in column `at` to (batch, integers, codes, distances) in slices of ROWS."""

    def run(batches: Iterator[pa.RecordBatch], at: int):
        codebooks, cut = [Codebook(b) for b in books], width // len(books)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = integers(matrix(part.column(at), width))
                pieces = [x[:, k * cut : (k + 1) * cut] for k in range(len(books))]
                found = [b.nearest(p) for b, p in zip(codebooks, pieces)]
                yield part, pieces, [c for c, _ in found], [d for _, d in found]

    return run


def _round(rows: DataFrame, width: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: every entry becomes the floored mean of the parts assigned to it; unused ones stay."""
    search = _searched(width, books)

    def run(batches):
        totals: dict[tuple[int, int], list] = {}
        for _, pieces, codes, _ in search(batches, 0):
            for k, (piece, code) in enumerate(zip(pieces, codes)):
                order = np.argsort(code, kind="stable")
                entry, first, count = np.unique(code[order], return_index=True, return_counts=True)
                for e, n, s in zip(entry.tolist(), count.tolist(), np.add.reduceat(piece[order], first, axis=0).tolist()):
                    have = totals.get((k, e))
                    totals[k, e] = [n, s] if have is None else [have[0] + n, [a + b for a, b in zip(have[1], s)]]
        keys = list(totals)
        columns = ([k for k, _ in keys], [e for _, e in keys], [totals[k][0] for k in keys], [_limbs(totals[k][1]) for k in keys])
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "entry", "n", "sums"])

    partial = rows.mapInArrow(run, "part int, entry int, n long, sums array<array<long>>")
    # A value and the count beside it, so that one aggregate gives both.
    each = partial.select("part", "entry", F.posexplode(F.concat(F.array(F.array("n")), F.col("sums"))).alias("k", "limbs"))
    limbs = each.select("part", "entry", "k", F.posexplode("limbs").alias("place", "v")).groupBy("part", "entry", "k", "place").agg(F.sum("v").alias("v"))
    sums: dict[tuple[int, int], dict[int, int]] = {}
    for r in limbs.collect():
        own = sums.setdefault((r["part"], r["entry"]), {})
        own[r["k"]] = own.get(r["k"], 0) + (r["v"] << (LIMB * r["place"]))
    cut = width // len(books)
    grown = [b.astype(object) for b in books]
    for (part, entry), own in sums.items():
        grown[part][entry] = [own[1 + k] // own[0] for k in range(cut)]
    return [_narrow(b) for b in grown]


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if x.shape[1] <= WIDTH and all(abs(v) < NARROW for v in x.ravel().tolist()) else x


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept row: id, code (two hex digits per part), error, label_error, codebooks_sha256.

    Dropped are vectors that are null, empty or hold null or non-finite components, and those whose length isn't that of
    the kept row with the smallest id. `parts` must divide that length and a code must fit two digits (ValueError). Rows
    with a null id are kept and count as larger than any id; among rows of one id the smaller vector comes first. Fewer rows
    than `entries` give as many entries. Errors that don't fit 64 bits are null. An empty table gives no rows. Columns
    besides the three named are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so a codebook has 1 to 256 entries")
    kind = dict(rows.dtypes)
    kept = rows.where(finite(vector_col)).select(F.col(vector_col).alias("v"), F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"))
    width = width_of(kept, "id", "v")
    result = f"`{id_col}` {kind[id_col]}, code string, error long, label_error long, codebooks_sha256 string"
    if not width:
        return rows.sparkSession.createDataFrame([], result)
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    kept = kept.where(F.size("v") == width)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").select(F.col("v").cast("array<double>")).limit(entries).collect()
    start, cut = integers(np.array([list(r[0]) for r in first], np.float64)), width // parts
    books = [start[:, k * cut : (k + 1) * cut] for k in range(parts)]
    for _ in range(rounds):
        books = _round(kept.select("v"), width, books)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    search, most = _searched(width, books), (1 << 63) - 1

    def code(batches):
        for part, _, codes, distances in search(batches, 0):
            text = ["".join(f"{c:02x}" for c in row) for row in zip(*(c.tolist() for c in codes))]
            error = [sum(d) for d in zip(*(d.tolist() for d in distances))]
            error = pa.array([e if e <= most else None for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(text, pa.string()), error], names=["id", "label", "code", "error"])

    coded = kept.select("v", "id", "label").mapInArrow(code, f"id {kind[id_col]}, label string, code string, error long")
    coded = coded.select("id", F.coalesce("label", F.lit("")).alias("_label"), F.col("label").isNull().alias("_none"), "code", "error")
    # A label with an error that doesn't fit has no sum either.
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = coded.groupBy("_label", "_none").agg(F.count("*").alias("_n"), total.alias("_sum"))
    joined = attach_left(coded, sums, ["_label", "_none"], "_n")
    return joined.select(F.col("id").alias(id_col), "code", "error", F.expr("try_cast(_sum AS bigint)").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
