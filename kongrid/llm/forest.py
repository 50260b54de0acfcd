"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a string of BITS signs (random orthogonal planes). A tree is the sorted array of all strings, dealt
out in ranges; a tree's number, a vector's string and a few bits that break ties make one long key, so ranges are even
however many vectors share a string. Vectors that share a prefix with a query are neighbours in that array, and the deeper
the prefix the more alike. A query descends to its longest matches and then ascends one level at a time, in all trees at
once, until the vectors that share its prefix number at least `quota` over all trees; they are its candidates.

How this runs: (1) one sort of the keys; each task counts, for its queries and every level, the keys with the query's
prefix. Only nodes that hold a task's first or last key can go on in other tasks; their counts are added up from two rows
per task. (2) A query's level follows from the sums over trees. (3) For a few trees at a time the vectors are dealt to their
ranges, every query is sent to the ranges that its prefix touches, and scored there against the slice with that prefix. What
a range gives back is its best few, so no list of candidates is ever made. Trees at a time bound the bytes that are moved at once.

The quota is fitted: a bounded sample of queries is searched exactly, and the quota is the one at which `target` of their true
neighbours are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kongrid.llm.common import attach_left
from kongrid.llm.vectors import finite, lists, matrix, width_of
from kongrid.operators.cut import cut

TREES, BITS, SALT, SEED = 16, 40, 18, 7
TREE_SHIFT = BITS + SALT
# Keys that a task of the counting step sorts, and vectors of a range; both grow only where their numbers would pass the bounds.
SORTED, RANGE = 1 << 20, 1 << 14
MOST_TASKS, MOST_RANGES = 20_000, 1 << 20
# Trees whose vectors are moved at once.
AT_ONCE = 2
# Queries that are searched exactly to fit the quota, and the share of their neighbours that it must find.
SAMPLE, TARGET = 256, 0.95
SLICE = 256


def planes(width: int, trees: int = TREES) -> np.ndarray:
    """width x (trees * BITS) normals, orthogonal to each other within runs of `width`."""
    rng = np.random.default_rng(SEED)
    blocks = []
    while sum(b.shape[1] for b in blocks) < trees * BITS:
        blocks.append(np.linalg.qr(rng.standard_normal((width, width)))[0])
    return np.hstack(blocks)[:, : trees * BITS]


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by a power of two first, so that no square over- or underflows."""
    x = x * np.exp2(-np.frexp(np.abs(x).max(axis=1, initial=0))[1].astype(np.float64))[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of `a` with the same row of `b`; the same whatever other rows there are."""
    return (a * b).sum(axis=1)


def keys(unit: np.ndarray, salt: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """n x trees keys of unit vectors: tree, string and tie bits."""
    trees = normals.shape[1] // BITS
    packed = np.packbits((unit @ normals > 0).reshape(len(unit), trees, BITS), axis=2).astype(np.int64)
    string = np.zeros((len(unit), trees), np.int64)
    for k in range(BITS // 8):
        string = (string << 8) | packed[:, :, k]
    mixed = (salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SALT)).astype(np.int64)
    return (np.arange(trees, dtype=np.int64) << TREE_SHIFT) | (string << SALT) | mixed[:, None]


def _shift(level: np.ndarray | int):
    return TREE_SHIFT - level


def _distinct(rows: DataFrame, id_col: str, vector_col: str, every: int) -> tuple[DataFrame, DataFrame, int]:
    """(vectors: rep, v, least, n, asked; members: rep, id of vectors with several ids; width)."""
    item = dict(rows.dtypes)[vector_col][6:-1]
    # Adding zero makes one of the two zeros, so equal vectors have equal bytes.
    v = F.transform(F.col(vector_col), lambda x: x + F.lit(0).cast(item))
    usable = finite(vector_col) & F.exists(F.col(vector_col), lambda x: x != 0) & F.col(id_col).isNotNull()
    kept = rows.where(usable).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    width = width_of(kept, "id", "v")
    kept = kept.where(F.size("v") == width)
    # An id names one vector: where rows repeat one with others, the smallest counts.
    repeated = kept.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1")
    marked = attach_left(kept, repeated, ["id"], "_n")
    kept = marked.where("_n is null").select("id", "v").unionByName(marked.where("_n is not null").groupBy("id").agg(F.min("v").alias("v")))
    asked = F.max(F.col("id") % every == 0)
    vectors = cut(kept.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n"), asked.alias("asked")).withColumn("rep", F.monotonically_increasing_id()))
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2")]
    several = vectors.where("n > 1").select(*hashes, "rep", "n")
    members = attach_left(kept.select("id", *hashes), several, ["h1", "h2"], "n").where("rep is not null").select("rep", "id")
    return vectors, cut(members), width


def _counted(vectors: DataFrame, width: int, normals, tasks: int, room: int) -> DataFrame:
    """Sorted keys as counts. Per task: first, last (counts of their nodes by level, 0 to BITS) and every room-th key.
    Per query and tree: counts by level; -1 for nodes that may go on in other tasks."""
    shifts = _shift(np.arange(BITS + 1))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column(1).to_numpy()
            own = keys(directions(matrix(batch.column(0), width)), rep, normals)
            asked = batch.column(2).to_numpy(zero_copy_only=False)
            named = pa.array(np.repeat(rep, own.shape[1]), mask=np.repeat(~asked, own.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), named], names=["key", "rep"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        key, rep = whole["key"].to_numpy(), whole["rep"].combine_chunks()
        at = np.flatnonzero(~rep.is_null().to_numpy(zero_copy_only=False))
        names = ["rep", "key", "counts", "starts", "last"]

        def nodes(k):
            low = (k[:, None] >> shifts) << shifts
            return np.searchsorted(key, low + ((np.int64(1) << shifts) - 1), "right") - np.searchsorted(key, low)

        numbers = pa.list_(pa.int64())
        edge = nodes(key[[0, -1]])
        yield pa.RecordBatch.from_arrays([pa.nulls(2, pa.int64()), pa.array(key[[0, -1]]), pa.array(list(edge), numbers), pa.array([key[::room], []], numbers), pa.array([False, True])], names=names)
        for s in range(0, len(at), 4096):
            k = key[at[s : s + 4096]]
            counts, prefix = nodes(k), k[:, None] >> shifts
            counts[(prefix == key[0] >> shifts) | (prefix == key[-1] >> shifts)] = -1
            none = pa.nulls(len(k), numbers)
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(at[s : s + 4096])), pa.array(k), lists(counts, pa.int64()), none, pa.nulls(len(k), pa.bool_())], names=names)

    made = vectors.select("v", "rep", "asked").mapInArrow(make, "key long, rep long")
    dealt = made.repartitionByRange(tasks, "key").sortWithinPartitions("key")
    return cut(dealt.mapInArrow(count, "rep long, key long, counts array<long>, starts array<long>, last boolean"))


class _Nodes:
    """Whole counts of the nodes that hold some task's first or last key."""

    def __init__(self, edges: list):
        first, last = ([r for r in edges if r["last"] is x] for x in (False, True))
        first, last = sorted(first, key=lambda r: r["key"]), sorted(last, key=lambda r: r["key"])
        a, b = np.array([r["key"] for r in first], np.int64), np.array([r["key"] for r in last], np.int64)
        ca, cb = (np.array([r["counts"] for r in x], np.int64).reshape(-1, BITS + 1) for x in (first, last))
        self.prefix, self.total = [], []
        for level in range(BITS + 1):
            pa_, pb = a >> _shift(level), b >> _shift(level)
            own = pa_ != pb  # one node of a task is counted once
            prefix, where = np.unique(np.concatenate([pa_, pb[own]]), return_inverse=True)
            self.prefix.append(prefix)
            self.total.append(np.bincount(where, np.concatenate([ca[:, level], cb[own, level]]), len(prefix)).astype(np.int64))
        self.starts = np.sort(np.concatenate([np.array(r["starts"], np.int64) for r in first]))

    def fill(self, key: np.ndarray, counts: np.ndarray) -> np.ndarray:
        counts = counts.copy()
        for level in range(BITS + 1):
            open_ = np.flatnonzero(counts[:, level] < 0)
            counts[open_, level] = self.total[level][np.searchsorted(self.prefix[level], key[open_] >> _shift(level))]
        return counts


def _ascents(counted: DataFrame, nodes: _Nodes) -> DataFrame:
    """Per query: candidates over all trees at each level."""
    shared = counted.sparkSession.sparkContext.broadcast(nodes)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = shared.value.fill(batch.column(1).to_numpy(), matrix(batch.column(2), BITS + 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(whole, pa.int64())], names=["rep", "counts"])

    filled = counted.where("rep is not null").select("rep", "key", "counts").mapInArrow(fill, "rep long, counts array<long>")
    sums = F.array(*[F.sum(F.col("counts")[level]) for level in range(BITS + 1)])
    return cut(filled.groupBy("rep").agg(sums.alias("totals")))


def _needed_quota(vectors: DataFrame, totals: DataFrame, width: int, normals, k: int, target: float) -> int:
    """The quota at which `target` of the true neighbours of a sample of queries are candidates."""
    chosen = totals.orderBy(F.xxhash64("rep")).limit(SAMPLE)
    sample = vectors.select("rep", "v").join(F.broadcast(chosen), "rep").collect()
    if not sample:
        return 1
    ids, rows = np.array([r["rep"] for r in sample]), directions(np.array([r["v"] for r in sample], np.float64))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, rows, keys(rows, ids, normals)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, own = shared.value
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                rep, unit = part.column(1).to_numpy(), directions(matrix(part.column(0), width))
                score, theirs = rows @ unit.T, keys(unit, rep, normals)
                score[ids[:, None] == rep[None, :]] = -np.inf
                few = min(k, len(rep))
                for q, at in enumerate(np.argpartition(-score, few - 1, axis=1)[:, :few]):
                    # Levels at which a tree first tells the two apart; a key's tie bits don't count.
                    apart = (own[q] ^ theirs[at]) >> SALT
                    shared_bits = BITS - np.frexp(apart.astype(np.float64))[1]
                    have = [np.concatenate(x) for x in zip(best[q], (score[q, at], rep[at], shared_bits.max(axis=1)))]
                    top = np.argsort(-have[0], kind="stable")[:k]
                    best[q] = tuple(x[top] for x in have)
        q = np.repeat(ids, [len(b[0]) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(q), *(pa.array(np.concatenate([b[i] for b in best])) for i in range(3))], names=["q", "score", "c", "level"])

    found = vectors.select("v", "rep").mapInArrow(nearest, "q long, score double, c long, level long").where("score > -2")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("q", "level").collect()
    at = {r["rep"]: r["totals"] for r in sample}
    # A query stops at the deepest level that meets the quota, so a neighbour is found where the next level doesn't meet it.
    needed = sorted(at[r["q"]][r["level"] + 1] + 1 if r["level"] < BITS else 1 for r in top)
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))] if needed else 1


def _searched(vectors: DataFrame, queries: DataFrame, starts: np.ndarray, width: int, normals, trees: range, keep: int) -> DataFrame:
    """(q, c, least, score): of every range of `trees`, the best `keep` for each query that touches it."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["v"]
    shared = spark.sparkContext.broadcast(starts)
    schema = f"range int, query boolean, low long, high long, rep long, least long, v {kind}"
    names = ["range", "query", "low", "high", "rep", "least", "v"]
    item = pa.float32() if kind == "array<float>" else pa.float64()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, v = batch.column(1).to_numpy(), batch.column(0)
            own = keys(directions(matrix(v, width)), rep, normals)[:, trees.start : trees.stop].ravel()
            at = pa.array(np.repeat(np.arange(len(rep)), len(trees)))
            place = np.maximum(np.searchsorted(shared.value, own, "right") - 1, 0).astype(np.int32)
            none = pa.array(np.zeros(len(own), bool))
            yield pa.RecordBatch.from_arrays([pa.array(place), none, pa.array(own), pa.array(own), batch.column(1).take(at), batch.column(2).take(at), lists(matrix(v.take(at), width), item)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                part = batch.slice(s, SLICE)
                rep, v, shift = part.column(1).to_numpy(), part.column(0), _shift(part.column(2).to_numpy())[:, None]
                low = (keys(directions(matrix(v, width)), rep, normals)[:, trees.start : trees.stop] >> shift) << shift
                high = low + ((np.int64(1) << shift) - 1)
                first = np.maximum(np.searchsorted(shared.value, low, "right") - 1, 0).ravel()
                count = np.searchsorted(shared.value, high, "right").ravel() - first
                total = int(count.sum())
                cell = np.repeat(np.arange(len(count)), count)
                place = first[cell] + np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                at = pa.array(cell // len(trees))
                columns = [pa.array(place.astype(np.int32)), pa.array(np.ones(total, bool)), pa.array(low.ravel()[cell]), pa.array(high.ravel()[cell]), part.column(1).take(at), part.column(1).take(at)]
                yield pa.RecordBatch.from_arrays([*columns, lists(matrix(v.take(at), width), item)], names=names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range come before its queries, which are answered as they come."""
        now, held, index = None, [], None
        for batch in batches:
            ranges, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (ranges[1:] != ranges[:-1]) | (asks[1:] != asks[:-1]), [True]])) if len(ranges) else []
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                if ranges[a] != now:
                    now, held, index = ranges[a], [], None
                if not asks[a]:
                    held.append(part)
                    continue
                if index is None:
                    rows = pa.Table.from_batches(held).combine_chunks() if held else None
                    index = None if rows is None else [rows[c].to_numpy() for c in ("low", "rep", "least")] + [directions(matrix(rows["v"].chunk(0), width))]
                if index is not None:
                    for s in range(0, part.num_rows, SLICE):
                        yield from _best(part.slice(s, SLICE), index, width, keep)

    rows = vectors.select("v", "rep", "least").mapInArrow(deal, schema)
    asked = queries.select("v", "rep", "level").mapInArrow(ask, schema)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), len(trees) * len(starts) // TREES)
    dealt = rows.unionByName(asked).repartition(tasks, "range").sortWithinPartitions("range", "query", "low", "high")
    return dealt.mapInArrow(score, "q long, c long, least long, score double")


def _best(part: pa.RecordBatch, index: list, width: int, keep: int) -> Iterator[pa.RecordBatch]:
    """The best rows of one range for queries sorted by prefix; queries with the same prefix share one matrix product."""
    key, rep, least, unit = index
    low, high, q = part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_numpy()
    own = directions(matrix(part.column(6), width))
    edges = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True]]))
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        i, j = np.searchsorted(key, low[a]), np.searchsorted(key, high[a], "right")
        if i == j:
            continue
        rough = own[a:b] @ unit[i:j].T
        few = min(keep, j - i)
        least_kept = np.partition(rough, j - i - few, axis=1)[:, j - i - few]
        query, row = np.nonzero(rough >= least_kept[:, None] - 1e-9)
        exact = cosines(own[a + query], unit[i + row])
        order = np.lexsort((least[i + row], -exact, query))
        query, row, exact = query[order], row[order], exact[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < keep
        out.append((q[a + query[top]], rep[i + row[top]], least[i + row[top]], exact[top]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["q", "c", "least", "score"])


def nearest(rows: DataFrame, k: int = 5, every: int = 50, quota: int | None = None, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query (id divisible by `every`) the k nearest found by cosine, ties to the smaller id.

    `quota` candidates at least are scored for a query (all rows where there are fewer); None fits it on SAMPLE queries. Out
    of the table stay vectors that are null, empty, zero or hold null or non-finite components, rows without id, and vectors
    whose length isn't that of the row with the smallest id. Equal vectors are searched once and all their ids count. An id
    names one vector; where rows repeat an id with others, the smallest counts. Fewer than k other rows give as many; an
    empty table none. Other columns are ignored.
    """
    vectors, members, width = _distinct(rows, id_col, vector_col, every)
    if not width:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    normals, n = planes(width), vectors.count()
    room = max(RANGE, n * TREES // MOST_RANGES)
    tasks = min(MOST_TASKS, max(rows.sparkSession.sparkContext.defaultParallelism, n * TREES // SORTED))
    counted = _counted(vectors, width, normals, tasks, room)
    # Two rows a task and one number a range: bounded by MOST_TASKS and MOST_RANGES.
    nodes = _Nodes(counted.where("rep is null").select("key", "counts", "starts", "last").collect())
    totals = _ascents(counted, nodes)
    quota = _needed_quota(vectors, totals, width, normals, k, target) if quota is None else quota
    level = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda x: F.when(F.col("totals")[x] >= quota, x).otherwise(0)))
    queries = cut(vectors.where("asked").select("rep", "v").join(totals.select("rep", level.cast("long").alias("level")), "rep"))
    found = None
    for start in range(0, TREES, AT_ONCE):
        part = cut(_searched(vectors, queries, nodes.starts, width, normals, range(start, min(start + AT_ONCE, TREES)), k + 1))
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), "least"]
    top = found.groupBy("q", "c").agg(F.min("least").alias("least"), F.max("score").alias("score"))
    top = cut(top.withColumn("_place", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("_place") <= k + 1))
    # Ids of vectors that have several: as candidates the k + 1 smallest are enough, as queries all that are asked.
    ranked = members.withColumn("_place", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("_place") <= k + 1)
    ids = ranked.groupBy("rep").agg(F.collect_list("id").alias("ids"), F.count("*").alias("_n"))
    named = attach_left(top.withColumnRenamed("c", "rep"), ids, ["rep"], "_n")
    candidates = named.select("q", "score", F.explode(F.coalesce("ids", F.array("least"))).alias("vec_id"))
    few = candidates.withColumn("_place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_place") <= k + 1)
    answers = cut(few.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best")))
    single = vectors.where("asked and n = 1").select(F.col("rep").alias("q"), F.col("least").alias("query_id"))
    several = members.where(F.col("id") % every == 0).select(F.col("rep").alias("q"), F.col("id").alias("query_id"))
    hot = attach_left(several, answers.join(members.groupBy(F.col("rep").alias("q")).agg(F.count("*").alias("_n")), "q"), ["q"], "_n").drop("_n")
    both = single.join(answers, "q").unionByName(hot)
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return both.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
