"""Repeated byte strings over a whole corpus, by prefix-free parsing.

A rolling hash of 8 bytes triggers phrase ends: every start of a string of LENGTH bytes belongs to the trigger with the
smallest hash among the next WINDOW places, so the trigger is fixed by the string itself and equal strings hang on equal
triggers at equal offsets. Starts that share a trigger form a phrase. The parse is a table with one row per phrase: where it
lies, the hash of the bytes that all its strings share (its core) and the hash of everything its strings cover (its class).

Strings are ordered by (core, class, offset in the phrase), the order that the dictionary of phrases and the parse give
together; hashes take the place of lexicographic ranks, as only equality at depth LENGTH counts. So phrases of a class
that occurs twice hold only repeated strings; phrases whose core occurs once hold none; only classes that share a core
with another class are opened, one copy of each, and their strings compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kongrid.llm.common import likely, map_rows, utf8
from kongrid.operators.cut import cut, discard
from kongrid.operators.keys import attach

LENGTH = 400
WINDOW = 256
ROLL = 8
# Phrases of one core that are compared in one task.
FEW = 4096
# Bytes that a kernel works on at a time; longer texts are cut into pieces that overlap by LENGTH - 1.
PIECE = 1 << 18
# Texts whose opened strings are hashed at a time, and phrases that are compared at a time besides those of one core.
TEXTS, PHRASES = 16, 1024

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n + PIECE // 4, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


class Buffer:
    """Hashes of any span of some bytes (of at least ROLL bytes), and of the ROLL bytes at each place."""

    def __init__(self, data: bytes):
        m = len(data) - ROLL + 1
        self.rolled = _mix(np.ndarray((m,), "<u8", data, 0, (1,)))
        power, self.inverse = _power(m + 1)
        self.sums = np.zeros(m + 1, np.uint64)
        np.cumsum(self.rolled * power[:m], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end - (ROLL - 1)] - self.sums[start]) * self.inverse[start]


def _triggers(rolled: np.ndarray, window: int) -> np.ndarray:
    """For each place, the place of the smallest hash among the next `window`; of equal ones the last."""
    low = np.uint64(0xFFFFFFFF)
    key = (rolled & ~low) | (low - np.arange(len(rolled), dtype=np.uint64))
    width = 1
    while width < window:
        step = min(width, window - width)
        key = np.minimum(key[: len(key) - step], key[step:])
        width += step
    return (low - (key & low)).astype(np.int64)


def phrases(data: bytes, pieces: list[tuple[int, int]], length: int = LENGTH, window: int = WINDOW):
    """(first start, starts, core hash, class hash) of the phrases of the (start, size) pieces of `data`."""
    buffer = Buffer(data)
    anchor = _triggers(buffer.rolled, window)
    at = np.concatenate([np.arange(s, s + n - length + 1) for s, n in pieces])
    own = anchor[at]
    new = np.concatenate([[True], own[1:] != own[:-1]])
    first = np.flatnonzero(new)
    lo, count = at[first], np.diff(np.append(first, len(at)))
    trigger, hi = own[first], lo + count - 1
    core = buffer.span(trigger, trigger + length - window + 1)
    shape = (trigger - lo).astype(np.uint64) * _B + count.astype(np.uint64) * _C
    return lo, count, core, buffer.span(lo, hi + length) ^ _mix(shape)


def _gathered(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Texts of at least `length` bytes put together, and (text number, offset in it, start, size) of their pieces."""
    parts, spans, have = [], [], 0
    for k, text in enumerate(texts):
        for offset in range(0, max(0, len(text) - length + 1), PIECE):
            piece = text[offset : offset + PIECE + length - 1]
            spans.append((k, offset, have, len(piece)))
            parts.append(piece)
            have += len(piece)
            if have >= PIECE:
                yield b"".join(parts), spans
                parts, spans, have = [], [], 0
    if parts:
        yield b"".join(parts), spans


def _parse(docs: DataFrame, length: int, window: int) -> DataFrame:
    def make(columns):
        k1, k2, texts = columns
        out = [[] for _ in range(6)]
        for data, spans in _gathered(texts, length):
            lo, count, core, cls = phrases(data, [(s, n) for _, _, s, n in spans], length, window)
            which = np.searchsorted(np.array([s for _, _, s, _ in spans]), lo, "right") - 1
            text = np.array([k for k, *_ in spans])[which]
            shift = np.array([o - s for _, o, s, _ in spans])[which]
            for column, values in zip(out, (np.array(k1)[text], np.array(k2)[text], lo + shift, count, core.view(np.int64), cls.view(np.int64))):
                column.append(values)
        return [np.concatenate(c) if c else [] for c in out]

    return map_rows(docs, make, "k1 long, k2 long, lo int, n int, core long, cls long")


def _strings(rows: DataFrame, length: int) -> DataFrame:
    """Hashes of all strings of each opened phrase (column `open`: lo, n, core, single, kinds) of each text."""

    def make(columns):
        out = [[] for _ in range(7)]
        for k1, k2, opened, text in zip(*columns):
            for offset in range(0, max(0, len(text) - length + 1), PIECE):
                size = min(PIECE, len(text) - length + 1 - offset)
                mine = [(max(o["lo"], offset), min(o["lo"] + o["n"], offset + size), o) for o in opened]
                mine = [x for x in mine if x[0] < x[1]]
                if not mine:
                    continue
                buffer = Buffer(text[offset : offset + size + length - 1])
                for start, end, o in mine:
                    at = np.arange(start - offset, end - offset)
                    row = (o["core"], k1, k2, start, o["single"], o["kinds"], buffer.span(at, at + length).view(np.int64))
                    for column, value in zip(out, row):
                        column.append(value)
        return out

    return map_rows(rows, make, "core long, k1 long, k2 long, lo int, single boolean, kinds long, strings array<long>", TEXTS)


def _shared_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of starts in phrases of single classes whose strings occur twice or more among the phrases of their core.

    Batches are sorted by core; a core has at most FEW phrases, so what is held over has that bound.
    """

    def compare(rows: pa.Table) -> pa.RecordBatch:
        core, k1, k2, lo = (rows[c].to_numpy() for c in ("core", "k1", "k2", "lo"))
        single = rows["single"].to_numpy()
        lists = rows["strings"].combine_chunks()
        counts = np.diff(lists.offsets.to_numpy())
        h, phrase = lists.flatten().to_numpy(), np.repeat(np.arange(len(core)), counts)
        group = np.cumsum(np.concatenate([[0], core[1:] != core[:-1]]))[phrase]
        order = np.lexsort((h, group))
        same = (h[order][1:] == h[order][:-1]) & (group[order][1:] == group[order][:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice &= single[phrase]
        at = np.flatnonzero(twice)
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (phrase[at[1:]] != phrase[at[:-1]])]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        begin, n = at[first], np.diff(np.append(first, len(at)))
        own = phrase[begin]
        start = lo[own] + begin - (np.cumsum(counts) - counts)[own]
        return pa.RecordBatch.from_arrays([pa.array(k1[own]), pa.array(k2[own]), pa.array(start, pa.int32()), pa.array(n, pa.int32())], names=["k1", "k2", "lo", "n"])

    held: list[pa.RecordBatch] = []
    for batch in (b.slice(at, PHRASES) for b in batches for at in range(0, b.num_rows, PHRASES)):
        core = batch.column(0).to_numpy()
        last = int(np.searchsorted(np.cumsum(np.concatenate([[0], core[1:] != core[:-1]])), (core[1:] != core[:-1]).sum()))
        if held and core[0] != held[0].column(0)[0].as_py():
            yield compare(pa.Table.from_batches(held))
            held = []
        if last:
            yield compare(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield compare(pa.Table.from_batches(held))


def covered(starts: np.ndarray, counts: np.ndarray, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings of `length` bytes that begin in [start, start + count)."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order].astype(np.int64), (starts + counts)[order].astype(np.int64) + length - 1
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return list(zip(a[new].tolist(), np.minimum(reach[last], size).tolist()))


def repeated_starts(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(k1, k2, lo, n): runs of n starts from byte lo of strings of `length` bytes that start elsewhere too.

    `docs` has k1, k2 (keys of a row's content and id) and text (bytes).
    """
    parse = cut(_parse(docs, length, window))
    one = [F.first(c).alias(c) for c in ("k1", "k2", "lo", "n")]
    classes = cut(parse.groupBy("core", "cls").agg(F.count("*").alias("times"), *one))
    twice = classes.where("times > 1").select("core", "cls", "times")
    whole = cut(attach(likely(parse, twice, "cls")[0], twice, ["core", "cls"], "times").select("k1", "k2", "lo", "n"))
    discard(parse)
    shared = classes.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1")
    phrase = F.struct("lo", "n", "core", (F.col("times") == 1).alias("single"), "kinds")
    opened = cut(attach(classes, shared, ["core"], "kinds").groupBy("k1", "k2").agg(F.collect_list(phrase).alias("open")))
    discard(classes)
    # only texts with an opened phrase are moved
    strings = cut(_strings(opened.hint("shuffle_hash").join(likely(docs, opened, "k1")[0], ["k1", "k2"]).select("k1", "k2", "open", "text"), length))
    discard(opened)
    # Cores with few phrases are compared as they lie; a core of many is counted string by string, which no task holds whole.
    few = strings.where(F.col("kinds") <= FEW).select("core", "k1", "k2", "lo", "single", "strings").repartition("core").sortWithinPartitions("core")
    near = cut(few.mapInArrow(_shared_strings, "k1 long, k2 long, lo int, n int"))
    many = strings.where(F.col("kinds") > FEW).select("core", "k1", "k2", "lo", "single", F.posexplode("strings").alias("at", "h"))
    twice = cut(many.groupBy("h", "core").agg(F.count("*").alias("times")).where("times > 1"))
    far = cut(attach(many.where("single"), twice, ["h", "core"], "times").select("k1", "k2", (F.col("lo") + F.col("at")).alias("lo"), F.lit(1).alias("n")))
    discard(strings, twice)
    single = near.unionByName(far)
    return whole.unionByName(single)


def strip_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, spans, kept (bytes), kept_sha256.

    Removes every byte covered by a string of `length` bytes that also starts anywhere else in the corpus, in the same text
    too (overlaps count). Null texts count as empty. Rows repeated in full are copies of each other and lose all strings.
    Null ids keep their row. An empty table gives no rows; other columns are ignored.
    """
    if window + ROLL - 1 > length:
        raise ValueError("a trigger must lie inside the string that it stands for")
    rows = docs.select(F.col(id_col), utf8(text_col).alias("text"))
    keyed = rows.select(id_col, F.xxhash64(F.col(id_col), "text").alias("k1"), F.xxhash64("text", F.col(id_col), F.lit(1)).alias("k2"), "text")
    runs = repeated_starts(keyed.select("k1", "k2", "text"), length, window)
    per = cut(runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "n")).alias("_runs")))
    # texts without a run are finished where they lie
    some, none = likely(keyed, per, "k1")
    joined = some.join(per.hint("shuffle_hash"), ["k1", "k2"], "left").select(id_col, "text", "_runs")
    joined = joined.unionByName(none.select(id_col, "text", F.lit(None).cast(joined.schema["_runs"].dataType).alias("_runs")))

    def strip(columns):
        out = [[] for _ in range(7)]
        for key, text, found in zip(*columns):
            spans = covered(np.array([r["lo"] for r in found]), np.array([r["n"] for r in found]), len(text), length) if found else []
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            row = (key, len(text), len(text) - len(kept), len(spans), [{"start": a, "end": b} for a, b in spans], kept, hashlib.sha256(kept).hexdigest())
            for column, value in zip(out, row):
                column.append(value)
        return out

    return map_rows(joined, strip, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary, kept_sha256 string")
