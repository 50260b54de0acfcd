"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of two blocks of words, weighed by TF-IDF over terms of the benchmark (other terms are orthogonal to
every item). A first pass over the corpus counts the passages of each term; the terms of the latent space are those that are
rare, and the rarest of each item. A second pass yields A'A times a random matrix, A being all passages, from which the
leading singular vectors follow by the Nystrom formula (a randomised SVD that reads A once). An item longer than a passage is
searched by half-overlapping parts of a passage's length. A third pass projects every passage, takes the items of which a
part's cosine and coverage are high, and checks the word sequences of the whole item: the longest common subsequence must
hold enough of it, and of its last third (the answer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kongrid.llm.common import filter_rows, map_rows, utf8

BLOCK = 32
# Numbers of one matrix of passages x parts in a task.
MOST_PRODUCTS = 40_000_000
# The benchmark goes to every task; its items and the terms they bring are bounded by this.
MOST_ITEMS = 10_000

_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def lcs(a: list[bytes], b: list[bytes], tail: int) -> tuple[int, int]:
    """Longest common subsequence of a and b, and of a's last `tail` words and b, by bit vectors."""

    def length(x):
        at: dict[bytes, int] = {}
        for i, w in enumerate(x):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << len(x)) - 1
        v = full
        for w in b:
            if m := at.get(w):
                u = v & m
                v = ((v + u) | (v - u)) & full
        return len(x) - v.bit_count()

    return length(a), length(a[len(a) - tail :])


def parts(tokens: list[bytes]) -> list[list[bytes]]:
    """The item, or half-overlapping parts of a passage's length that end with its last word."""
    size = 2 * BLOCK
    if len(tokens) <= size:
        return [tokens]
    return [tokens[at : at + size] for at in [*range(0, len(tokens) - size, BLOCK), len(tokens) - size]]


class Benchmark:
    """Items with a word, their parts, and the terms that stand for them."""

    def __init__(self, rows: list[tuple]):
        rows = [(k, w) for k, t in rows if (w := words(t))]
        self.ids, self.tokens = [k for k, _ in rows], [w for _, w in rows]
        cut = [parts(w) for w in self.tokens]
        self.parts = [p for of in cut for p in of]
        self.item = np.repeat(np.arange(len(cut)), [len(of) for of in cut])  # the item of each part
        self.terms = {x: i for i, x in enumerate(sorted({x for w in self.tokens for x in w}))}

    def narrow(self, df: np.ndarray, passages: int, common: float, least: int) -> np.ndarray:
        """Keep terms of at most the share `common` of passages and the `least` rarest of each part; returns their counts."""
        order = {x: (int(df[i]), x) for x, i in self.terms.items()}
        kept = {x for x in self.terms if order[x][0] <= common * passages}
        for w in self.parts:
            kept.update(sorted(set(w), key=order.get)[:least])
        counts = np.array([order[x][0] for x in sorted(kept)], np.int64)
        self.terms = {x: i for i, x in enumerate(sorted(kept))}
        return counts

    def matrix(self, idf: np.ndarray) -> np.ndarray:
        q = np.zeros((len(self.parts), len(self.terms)))
        for i, w in enumerate(self.parts):
            for x in w:
                if x in self.terms:
                    q[i, self.terms[x]] += 1
        return q * idf


def _hits(texts: list[bytes], terms: dict[bytes, int]):
    """Words of each text, and of all texts: term, block (counted through) of each place that holds a term, blocks per text."""
    get, all_words, term, block, blocks, base = terms.get, [], [], [], [], 0
    for text in texts:
        w = words(text)
        all_words.append(w)
        n = max(1, -(-len(w) // BLOCK))
        found = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
        at = np.flatnonzero(found >= 0)
        term.append(found[at])
        block.append(at // BLOCK + base)
        blocks.append(n)
        base += n
    return all_words, np.concatenate(term) if term else np.zeros(0, np.int64), np.concatenate(block) if block else np.zeros(0, np.int64), np.array(blocks, np.int64)


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of `values` for each of n groups; `groups` ascends."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(groups):
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        out[groups[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _passages(per_block: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Block sums to passage sums: passage j holds blocks j and j + 1 of its text; the last one a single block."""
    last = np.zeros(len(per_block), bool)
    last[np.cumsum(blocks) - 1] = True
    out = per_block.copy()
    out[:-1][~last[:-1]] += per_block[1:][~last[:-1]]
    return out


def _has_before(blocks: np.ndarray) -> np.ndarray:
    """Which passages have one before them in the same text: that one holds their first block too."""
    before = np.ones(int(blocks.sum()), bool)
    before[np.concatenate([[0], np.cumsum(blocks)[:-1]])] = False
    return before


def passage_counts(docs: DataFrame, bench: Benchmark, text_col: str) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and all passages, over the whole corpus."""
    terms, n_terms = bench.terms, len(bench.terms)

    def count(columns):
        _, term, block, blocks = _hits(columns[0], terms)
        n = int(blocks.sum())
        key = term * n + block
        pairs = np.unique(np.concatenate([key, (key - 1)[_has_before(blocks)[block]]]))
        df = np.bincount(pairs // n, minlength=n_terms) if n else np.zeros(n_terms, int)
        seen = np.flatnonzero(df)
        return [[*seen.tolist(), -1], [*df[seen].tolist(), n]]

    rows = map_rows(docs.select(utf8(text_col).alias("text")), count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}  # one row per term of the benchmark
    return np.array([counts.get(i, 0) for i in range(n_terms)], np.int64), counts.get(-1, 0)


def sketch(docs: DataFrame, bench: Benchmark, idf: np.ndarray, width: int, text_col: str, seed: int) -> np.ndarray:
    """A'A times a random matrix (terms x width) for the TF-IDF matrix A of all passages."""
    terms, n_terms = bench.terms, len(bench.terms)
    spark = docs.sparkSession

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noise = (idf[:, None] * np.random.default_rng(seed).standard_normal((n_terms, width))).astype(np.float32)
        z, seen = np.zeros((n_terms, width), np.float32), np.zeros(n_terms, bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                _, term, block, blocks = _hits(batch.column(0).slice(at, 256).to_pylist(), terms)
                if not len(term):
                    continue
                y = _passages(_sums(noise[term], block, int(blocks.sum())), blocks)
                before = np.flatnonzero(_has_before(blocks))
                both = y.copy()
                both[before] += y[before - 1]
                order = np.argsort(term, kind="stable")
                z += _sums(both[block[order]], term[order], n_terms)
                seen[term] = True
        rows = [(k, z[k].tobytes()) for k in np.flatnonzero(seen).tolist()]
        for a in range(0, len(rows), 1024):
            yield _packed(rows[a : a + 1024])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, z in zip(*(c.to_pylist() for c in batch.columns)):
                sums[k] = sums.get(k, 0) + np.frombuffer(z, np.float32).astype(float)
        if sums:
            yield _packed([(k, v.astype(np.float32).tobytes()) for k, v in sums.items()])

    # Few and large tasks: each sends one row per term it has met, whatever it has read.
    tasks = 4 * spark.sparkContext.defaultParallelism
    parts = docs.select(utf8(text_col).alias("text")).coalesce(tasks).mapInArrow(partial, "term int, z binary")
    out = np.zeros((n_terms, width))
    for r in parts.repartition("term").mapInArrow(total, "term int, z binary").collect():  # terms x width numbers
        out[r["term"]] = np.frombuffer(r["z"], np.float32)
    return idf[:, None] * out


def _packed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([z for _, z in rows], pa.binary())], names=["term", "z"])


def latent_basis(z: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Leading right singular vectors of A from A'A times the seed's random matrix."""
    noise = np.random.default_rng(seed).standard_normal(z.shape)
    inner = noise.T @ z
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > max(values.max(initial=0), 1e-9) * 1e-7
    root = z @ vectors[:, good] / np.sqrt(values[good])
    return np.linalg.svd(root, full_matrices=False)[0][:, :rank]


@dataclass
class LeakFinder:
    """What a task needs to search texts for items: made once per corpus, the size of the benchmark's terms times the rank."""

    bench: Benchmark
    vectors: np.ndarray  # terms x rank, weighed by IDF
    unit: np.ndarray  # parts of items x rank
    norm: np.ndarray
    cosine: float
    coverage: float
    sequence: float
    answer: float

    def search(self, texts: list[bytes]) -> list[list]:
        """Per text: contaminated, item, share of the item in sequence, cosine, candidates."""
        n = len(texts)
        out = [[False] * n, [None] * n, [None] * n, [None] * n, [0] * n]
        if not self.bench.ids:
            return out
        tokens, term, block, blocks = _hits(texts, self.bench.terms)
        if not len(term):
            return out
        p = _passages(_sums(self.vectors[term], block, int(blocks.sum())), blocks)
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        size = np.linalg.norm(p, axis=1)
        far = np.flatnonzero(size >= self.coverage * self.norm.min())  # no shorter one can reach the coverage of any part
        step = max(1, min(4096, MOST_PRODUCTS // len(self.norm)))
        for a in range(0, len(far), step):
            at_passage = far[a : a + step]
            along = p[at_passage] @ self.unit.T
            which, hit = np.nonzero((along >= self.cosine * size[at_passage, None]) & (along >= self.coverage * self.norm))
            pairs: dict[tuple[int, int], float] = {}  # best part of each (passage, item)
            for row, i, x in zip(which.tolist(), self.bench.item[hit].tolist(), along[which, hit].tolist()):
                pairs[row, i] = max(x, pairs.get((row, i), x))
            for (row, i), x in pairs.items():
                j = int(at_passage[row])
                k = int(np.searchsorted(first, j, "right")) - 1
                item, at = self.bench.tokens[i], (j - int(first[k])) * BLOCK
                tail = -(-len(item) // 3)
                whole, end = lcs(item, tokens[k][max(0, at - len(item)) : at + 2 * BLOCK + len(item)], tail)
                out[4][k] += 1
                share = whole / len(item)
                if share >= self.sequence and end >= self.answer * tail and (out[2][k] is None or share > out[2][k]):
                    out[0][k], out[1][k], out[2][k], out[3][k] = True, self.bench.ids[i], share, float(np.float32(x) / size[j])
        return out


def leak_finder(
    docs: DataFrame, benchmark: DataFrame, rank: int = 256, oversample: int = 32, cosine: float = 0.3, coverage: float = 0.5, sequence: float = 0.7, answer: float = 0.5,
    common: float = 0.002, least: int = 6, seed: int = 7, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> LeakFinder:
    """Latent space of the corpus for a benchmark of at most MOST_ITEMS items.

    `common` and `least` say which terms count, `cosine` and `coverage` which (passage, item) pairs are checked (by any part of
    the item), `sequence` and `answer` which shares of the whole item and of its last third must stand there in order.
    """
    rows = benchmark.select(item_col, utf8(item_text_col).alias("t")).where(F.col(item_col).isNotNull()).distinct().orderBy(item_col, "t").limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} benchmark items")
    bench = Benchmark([(r[0], bytes(r[1])) for r in rows])
    if not bench.ids:
        none = np.zeros((0, 0), np.float32)
        return LeakFinder(bench, none, none, none, cosine, coverage, sequence, answer)
    df, passages = passage_counts(docs, bench, text_col)
    df = bench.narrow(df, passages, common, least)
    idf = np.log((passages + 1) / (df + 1)) + 1
    basis = latent_basis(sketch(docs, bench, idf, min(rank + oversample, len(idf)), text_col, seed), rank, seed)
    q = bench.matrix(idf) @ basis
    norm = np.linalg.norm(q, axis=1)
    unit = (q / np.maximum(norm, 1e-12)[:, None]).astype(np.float32)
    norm = np.where(norm > 1e-9, norm, np.inf).astype(np.float32)
    return LeakFinder(bench, (idf[:, None] * basis).astype(np.float32), unit, norm, cosine, coverage, sequence, answer)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **parameters) -> DataFrame:
    """One row per input row: id, contaminated, item_id, sequence_share, cosine, candidates; parameters as of `leak_finder`.

    `candidates` counts the (passage, item) pairs that were checked; item, share and cosine are those of the best pair that
    passes both checks (null without one), ties to the smaller item position. Null, empty and wordless texts are clean; items
    without a word match nothing; without items every row is clean. Repeated rows give equal rows; other columns are ignored.
    """
    finder = leak_finder(docs, benchmark, text_col=text_col, item_col=item_col, **parameters)
    kinds = f"`{id_col}` {dict(docs.dtypes)[id_col]}, contaminated boolean, item_id {dict(benchmark.dtypes)[item_col]}, sequence_share double, cosine double, candidates long"
    return map_rows(docs.select(id_col, utf8(text_col).alias("_text")), lambda columns: [columns[0], *finder.search(columns[1])], kinds)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **parameters) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item."""
    finder = leak_finder(docs, benchmark, text_col=text_col, **parameters)
    return filter_rows(docs, utf8(text_col), lambda texts: [not x for x in finder.search(texts)[0]])
