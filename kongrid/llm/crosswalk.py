"""Alignment of two tokenizers' tokens over byte offsets, by merge-path partitioning.

Both token sequences of a text cover the same bytes, so their byte ends are two sorted lists. Merging them is a path
through the grid of both lists; a diagonal of that grid holds all splits with the same number of ends, and a binary search on
it finds where the path crosses. Diagonals at equal distances cut a merge into pieces of equal work that need nothing of each
other: a text of one piece is finished where it was encoded, pieces of longer ones are dealt over the cluster and stitched.

An end that both lists have is a link and closes a group. Of equal ends the first list's comes first on the path, so a piece
also sees the one end of that list before its own and finds the links of all its second-list ends.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kongrid.llm.common import attach_left, utf8
from kongrid.operators.cut import cut
from kongrid.operators.keys import attach

TOKENIZERS = "/opt/tokenizers"
# Fixed value: how byte-level BPE splits a text into words before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space of so many characters in a row is long. Texts that are encoded at once.
LONG, TEXTS = 10_000, 64
# Ends of both lists in a piece.
PIECE = 1 << 16
# Id pairs whose counts may be broadcast: three numbers each. Beyond it `attach` shuffles.
PAIRS = 1_000_000


class Encoders:
    """Both tokenizers; ids, the bytes that an id stands for, and ids as text."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(os.path.join(folder, "byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, "piece_bpe_32k.model"))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        # Byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 in byte order.
        alphabet = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        n = self.a.get_vocab_size()
        pieces = [self.a.id_to_token(i) for i in range(n)]
        self.a_bytes = [bytes(alphabet[c] for c in p) if all(c in alphabet for c in p) else p.encode() for p in pieces]
        kept = range(self.b.vocab_size())
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in kept)]
        with open(os.path.join(folder, "byte_bpe_50k.json")) as f:
            model = json.load(f)["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranked = None
        # Merges that are numbered as they rank can be done by an encoder of ranks, which gives the same ids in a quarter of the time.
        if all(model["vocab"].get(x + y) == 256 + k for k, (x, y) in enumerate(merges)):
            ranks = {b: i for i, b in enumerate(self.a_bytes) if i < 256 + len(merges)}
            self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def first(self, text: str) -> list[int]:
        """A ids of a text. The encoder of ranks splits with a backtracking pattern, so very long white space is left to the other."""
        if self.ranked is None or (len(text) > LONG and regex.search(rf"\s{{{LONG},}}", text)):
            return self.a.encode(text, add_special_tokens=False).ids
        return self.ranked(text)

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(A ids, B ids) of each text; none for empty texts, invalid UTF-8 and texts that either tokenizer doesn't give back."""
        shown = [t.decode(errors="replace") for t in texts]
        out = []
        for text, plain, b in zip(texts, shown, self.b.encode(shown, num_threads=1)):
            whole = b" " + text
            a = self.first(" " + plain) if text and b"".join(map(self.b_bytes.__getitem__, b)) == whole else []
            good = a and b"".join(map(self.a_bytes.__getitem__, a)) == whole
            out.append((np.array(a if good else [], np.int64), np.array(b if good else [], np.int64)))
        return out


@lru_cache(maxsize=4)
def encoders(folder: str) -> Encoders:
    return Encoders(folder)


def crossings(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) where the merge path of two sorted lists crosses the diagonals 0, work, 2 work, ... and the end.

    i is the smallest number of `a` values with a[i] > b[d - i - 1]: all before it are merged by then, equal ones first.
    """
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        after = np.zeros(len(d), bool)
        m = mid[open_]
        after[open_] = a[m] > b[d[open_] - m - 1]
        high = np.where(open_ & after, mid, high)
        low = np.where(open_ & ~after, mid + 1, low)
    return low, d - low


_names: list[str] = []


def _named(size: int) -> list[str]:
    """Ids below `size` as text, each with the three signs that may follow it."""
    _names.extend(f"{i}{sign}" for i in range(len(_names) // 3, size) for sign in ",|;")
    return _names


def overlaps(a_ids, a_ends, b_ids, b_ends, before: int) -> dict:
    """Links and groups of one piece; `before` of the A tokens (0 or 1) lie before the piece and only serve links.

    pairs: A id * 2^32 + B id of each link. opened: ids up to the first link (all without one), which belong to the group that
    an earlier piece began. body: the groups after it as text. tail: ids after the last link.
    """
    at = np.searchsorted(a_ends, b_ends)
    link = np.flatnonzero(at < len(a_ends))
    link = link[a_ends[at[link]] == b_ends[link]]
    a_at = at[link]
    pairs = (a_ids[a_at] << 32) | b_ids[link]
    if not len(link):
        return {"pairs": pairs, "links": 0, "closed": False, "open_a": a_ids[before:], "open_b": b_ids, "body": "", "tail_a": a_ids[:0], "tail_b": b_ids[:0]}
    first_a, first_b, last_a, last_b = max(a_at[0] + 1, before), link[0] + 1, max(a_at[-1] + 1, before), link[-1] + 1
    body = ""
    if len(link) > 1:
        a, b = a_ids[first_a:last_a], b_ids[first_b:last_b]
        # Group of each token, and tokens in the order group, list, place.
        g = np.concatenate([np.searchsorted(a_at[1:], np.arange(first_a, last_a)) * 2, np.searchsorted(link[1:], np.arange(first_b, last_b)) * 2 + 1])
        order = np.argsort(g, kind="stable")
        g, ids = g[order], np.concatenate([a, b])[order]
        end = np.append(g[1:] != g[:-1], True)
        mark = np.where(~end, 0, 1 + g % 2)
        names = _named(int(ids.max()) + 1)
        body = "".join([names[k] for k in (ids * 3 + mark).tolist()])[:-1]
    return {"pairs": pairs, "links": len(link), "closed": True, "open_a": a_ids[before:first_a], "open_b": b_ids[:first_b], "body": body, "tail_a": a_ids[last_a:], "tail_b": b_ids[last_b:]}


class Stitch:
    """Digest of a text's groups from its pieces in order; holds no more than the group that is open."""

    def __init__(self):
        self.hash, self.a, self.b, self.groups = hashlib.sha256(), [], [], 0

    def add(self, piece: dict) -> None:
        self.a += list(piece["open_a"])
        self.b += list(piece["open_b"])
        if piece["closed"]:
            begin = ";" if self.groups else ""
            self.hash.update(f"{begin}{','.join(map(str, self.a))}|{','.join(map(str, self.b))}".encode())
            if piece["body"]:
                self.hash.update(b";" + piece["body"].encode())
            self.groups += piece["links"]
            self.a, self.b = list(piece["tail_a"]), list(piece["tail_b"])

    def digest(self) -> str:
        return self.hash.hexdigest() if self.groups else ""


_PIECE = [("links", pa.int64()), ("open_a", pa.list_(pa.int64())), ("open_b", pa.list_(pa.int64())), ("closed", pa.bool_()), ("body", pa.string()), ("tail_a", pa.list_(pa.int64())), ("tail_b", pa.list_(pa.int64()))]
_MERGED = "uid long, piece int, pairs array<long>, links long, open_a array<long>, open_b array<long>, closed boolean, body string, tail_a array<long>, tail_b array<long>"


def _encoded(docs: DataFrame, kind: str, folder: str, work: int) -> DataFrame:
    """Per text a row with its counts, finished if it has one piece; per piece of longer texts a row with its slice."""
    numbers = pa.list_(pa.int64())
    types = [("uid", pa.int64()), ("id", None), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("digest", pa.string()), ("pairs", numbers)]
    types += [("piece", pa.int32()), ("before", pa.int32()), ("a_ids", numbers), ("a_ends", numbers), ("b_ids", numbers), ("b_ends", numbers)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoders(folder)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                columns: list[list] = [[] for _ in types]
                uids, ids = part.column(0).to_pylist(), part.column(1).to_pylist()
                for uid, key, (a, b) in zip(uids, ids, own.encode(part.column(2).to_pylist())):
                    a_ends, b_ends = np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[b])
                    i, j = crossings(a_ends, b_ends, work)
                    row = [uid, key, len(a), len(b), 0, "", [], None, None, None, None, None, None]
                    if len(i) == 2:
                        whole, stitch = overlaps(a, a_ends, b, b_ends, 0), Stitch()
                        stitch.add(whole)
                        row[4:7] = stitch.groups, stitch.digest(), whole["pairs"]
                    for c, v in zip(columns, row):
                        c.append(v)
                    if len(i) > 2:
                        for k in range(len(i) - 1):
                            before = int(i[k] > 0)
                            at, to = slice(i[k] - before, i[k + 1]), slice(j[k], j[k + 1])
                            for c, v in zip(columns, [uid, None, None, None, None, None, None, k, before, a[at], a_ends[at], b[to], b_ends[to]]):
                                c.append(v)
                fields = [(n, t or part.schema.field(1).type) for n, t in types]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    lists = ", ".join(f"{c} array<long>" for c in ("a_ids", "a_ends", "b_ids", "b_ends"))
    return docs.mapInArrow(run, f"uid long, id {kind}, n_a long, n_b long, n_groups long, digest string, pairs array<long>, piece int, before int, {lists}")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            made = overlaps(*(np.array(row[c], np.int64) for c in ("a_ids", "a_ends", "b_ids", "b_ends")), row["before"])
            arrays = [pa.array([row["uid"]]), pa.array([row["piece"]], pa.int32()), pa.array([made["pairs"]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([made[n]], t) for n, t in _PIECE)], names=["uid", "piece", "pairs", *(n for n, _ in _PIECE)])


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by text and number; only the open group and the digest of one text are held."""

    def emit(uid, stitch):
        return pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([stitch.groups]), pa.array([stitch.digest()])], names=["uid", "groups", "stitched"])

    uid, stitch = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["uid"] != uid:
                if stitch:
                    yield emit(uid, stitch)
                uid, stitch = row["uid"], Stitch()
            stitch.add(row)
    if stitch:
        yield emit(uid, stitch)


def align_tokens(docs: DataFrame, folder: str = TOKENIZERS, work: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per text, per id pair) of the token alignment of tokenizer A (on a blank and the text) and B (which adds the blank).

    Per text: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Per pair: a_id, b_id, n (links corpus-wide),
    best (no other A id is linked more often to that B id). One row per input row, repeated rows included; null ids keep
    theirs. Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have zeros and ''. An empty
    table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    made = cut(_encoded(rows, kind, folder, work))
    texts, pieces = made.where("piece is null"), made.where("piece is not null")
    merged = cut(pieces.select("uid", "piece", "before", "a_ids", "a_ends", "b_ids", "b_ends").repartition("uid", "piece").mapInArrow(_merge, _MERGED))
    stitched = merged.drop("pairs").repartition("uid").sortWithinPartitions("uid", "piece").mapInArrow(_stitch, "uid long, groups long, stitched string")
    links = texts.select("uid", F.explode("pairs").alias("pair")).unionByName(merged.select("uid", F.explode("pairs").alias("pair")))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    counts = links.groupBy("pair").agg(F.count("*").alias("n")).withColumn("b_id", b_id)
    counts = cut(counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id"))))
    sums = attach(links, counts.select("pair", "n", "best"), ["pair"], "n", PAIRS).groupBy("uid").agg(
        F.count("*").alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum")
    )
    whole = attach_left(texts.select("uid", "id", "n_a", "n_b", "n_groups", "digest"), stitched.withColumn("_n", F.lit(1)), ["uid"], "_n")
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
    groups, digest = F.coalesce("groups", "n_groups").alias("n_groups"), F.coalesce("stitched", "digest").alias("groups_sha256")
    result = whole.join(sums, "uid", "left").select(F.col("id").alias(id_col), "n_a", "n_b", groups, *none, digest)
    return result, counts.select(F.shiftright("pair", 32).alias("a_id"), "b_id", "n", "best")
