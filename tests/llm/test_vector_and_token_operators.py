"""Nearest neighbours, token alignment and vector codes against brute-force versions, and on awkward tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kongrid.llm import crosswalk, forest, orchard
from kongrid.llm.queries import QUERIES

# Vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label). Plain Python integers throughout."""
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    cut = len(kept[0][1]) // parts
    piece = lambda v, k: v[k * cut : (k + 1) * cut]
    books = [[piece(v, k) for _, v, _ in kept[:entries]] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[near(piece(v, k), books[k])[1]].append(piece(v, k))
            for n, m in members.items():
                books[k][n] = [sum(c) // len(m) for c in zip(*m)]
    out, totals = [], Counter()
    for i, v, lab in kept:
        found = [near(piece(v, k), books[k]) for k in range(parts)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), lab))
        totals[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = (1 << 63) - 1
    wide = {lab for _, _, e, lab in out if e > most}
    return Counter((i, c, e if e <= most else None, None if lab in wide or totals[lab] > most else totals[lab], digest) for i, c, e, lab in out)


VECTORS = "vec_id long, embedding array<double>, label int, code string, error string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows], VECTORS).repartition(3)


def some_vectors(n, width, seed):
    r = random.Random(seed)
    return [[r.gauss(0, 1) for _ in range(width)] for _ in range(n)]


@pytest.mark.parametrize("entries", [1, 5, 40])
def test_codes_equal_brute_force(spark, entries):
    """Ties, repeated rows and ids, nulls in every column, other lengths, infinite components, clashing columns."""
    base = some_vectors(90, 8, 4)
    rows = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(base)]
    rows += [(200, base[3], 1), (200, base[3], 1), (201, base[3], None), (5, base[9], 2), (None, base[4], 0), (None, None, 0), (202, None, 1), (203, [], 1)]
    rows += [(204, [1.0] * 7 + [float("nan")], 1), (205, [1.0] * 7 + [float("inf")], 1), (206, [1.0] * 7 + [None], 1), (207, [1.0] * 4, 1), (208, [0.0] * 8, 1), (209, [-0.0001] * 8, 5), (210, [0.0005] * 8, 5)]
    got = Counter(tuple(r) for r in orchard.compress(frame(spark, rows), entries=entries).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == brute_codes(rows, entries=entries)


def test_codes_of_huge_components(spark):
    """Integers beyond 64 bits are exact; an error that doesn't fit is null, and so is its label's sum."""
    rows = [(i, v, i % 2) for i, v in enumerate(some_vectors(30, 8, 9))]
    rows += [(50, [3e30] * 8, 7), (51, [-3e30] * 8, 7), (52, [1e30, 2.5, 1e6, 0.1, -1e9, 3.0, 1e-300, 9e8], 8), (53, [4096.123] * 8, 0)]
    got = Counter(tuple(r) for r in orchard.compress(frame(spark, rows), entries=6).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == brute_codes(rows, entries=6)


def test_codes_of_nothing_and_wrong_sizes(spark):
    assert orchard.compress(frame(spark, [(1, None, 1)])).count() == 0
    assert orchard.compress(frame(spark, [(1, [1.0], 1)]).limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        orchard.compress(frame(spark, [(1, [1.0, 2.0, 3.0], 1)]))
    with pytest.raises(ValueError):
        orchard.compress(frame(spark, [(1, [1.0] * 4, 1)]), entries=257)


@pytest.mark.parametrize("spread", [1, 1000])
def test_orchard_search_is_exact_and_skips_entries(spread):
    """Clustered entries: the nearest one, lowest index among equals, without measuring most of the others."""
    r = np.random.default_rng(2)
    centres = r.integers(-spread * 50, spread * 50, (16, 6))
    entries = np.repeat(centres, 16, axis=0) + r.integers(-3, 4, (256, 6))
    entries[40] = entries[7]
    x = centres[r.integers(0, 16, 500)] + r.integers(-4, 5, (500, 6))
    book, measured = orchard.Codebook(entries), []
    plain = book._distance
    book._distance = lambda v, e: measured.append(len(v)) or plain(v, e)
    code, d = book.nearest(x)
    want = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == want.argmin(axis=1)).all() and (d == want.min(axis=1)).all()
    if spread > 1:
        assert sum(measured) < 0.4 * 500 * 256


def test_registered_codes(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    x = np.floor(np.array([r[1] for r in sorted(rows, key=lambda r: r[0])], float) * 1024).astype(np.int64)
    books = [x[:256, k * 16 : k * 16 + 16].copy() for k in range(4)]

    def near(k):
        d = ((x[:, None, k * 16 : k * 16 + 16] - books[k][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(4):
        for k in range(4):
            code = near(k)[0]
            for e in set(code.tolist()):
                m = x[code == e, k * 16 : k * 16 + 16]
                books[k][e] = m.sum(axis=0) // len(m)
    found = [near(k) for k in range(4)]
    want = {(i, "".join(f"{int(c[i]):02x}" for c, _ in found), int(sum(d[i] for _, d in found))) for i in range(len(x))}
    assert {(r["vec_id"], r["code"], r["error"]) for r in QUERIES["op13_orchard_codes"](spark, sf).collect()} == want


# Token alignment


def brute_alignment(texts):
    """Plain walk over both tokenizers' tokens of whole texts."""
    e = crosswalk.encoders(crosswalk.TOKENIZERS)
    links, per = Counter(), []
    for text in texts:
        if not text:
            per.append(None)
            continue
        a, b = e.a.encode(" " + text, add_special_tokens=False).ids, e.b.encode(text)
        whole = (" " + text).encode()
        if b"".join(e.a_bytes[i] for i in a) != whole or b"".join(e.b_bytes[i] for i in b) != whole:
            per.append(None)
            continue
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((e.a_bytes, a), (e.b_bytes, b))]
        both, i, j, groups, own = sorted(set(ends[0]) & set(ends[1])), 0, 0, [], []
        for end in both:
            k, n = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:n])))
            own.append((a[k - 1], b[n - 1]))
            i, j = k, n
        links.update(own)
        per.append((len(a), len(b), groups, own))
    top = Counter()
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    out = []
    for p in per:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, own = p
            out.append((a, b, len(groups), len(own), sum(links[x] == top[x[1]] for x in own), sum(links[x] for x in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, links, top


ODD = ["", None, "a", " ", "\n\n \t x", "é" * 50, "日本語のテキスト と English", "<|endoftext|> and <s> are </s> plain <unk>", "▁under", "a" * 3000, " " * 300 + "z", "😀 tokens\r\n\r\nlast", "\x00nul", "it's we'll 1234567 ...", "x" + " " * 20_001 + "y"]


@pytest.mark.parametrize("work", [7, 64, 1 << 16])
def test_alignment_equals_brute_force(spark, work):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefg éñ-_.") for _ in range(r.randint(1, 9))) for _ in range(60)]
    texts = ODD + [" ".join(r.choice(words) for _ in range(r.randint(1, 300))) for _ in range(25)]
    texts += texts[-3:]
    ids = [None if k % 9 == 4 else k // 2 for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, n_a int, pair int").repartition(3)
    result, pairs = crosswalk.align_tokens(docs, work=work)
    want, links, top = brute_alignment(texts)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(x) for x in result.select(*columns).collect()) == Counter((i, *w) for i, w in zip(ids, want))
    assert {(p["a_id"], p["b_id"]): (p["n"], p["best"]) for p in pairs.collect()} == {k: (n, n == top[k[1]]) for k, n in links.items()}


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert crosswalk.align_tokens(none)[0].count() == 0


def test_merge_path_cuts_equal_pieces():
    r = random.Random(8)
    for _ in range(40):
        a = sorted(r.sample(range(400), r.randint(0, 90)))
        b = sorted(r.sample(range(400), r.randint(0, 90)))
        work = r.randint(1, 40)
        i, j = crosswalk.crossings(np.array(a), np.array(b), work)
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        assert (np.diff(i + j)[:-1] == work).all() and i[-1] == len(a) and j[-1] == len(b)
        for x, y in zip(i, j):
            assert [k for _, k in merged[: x + y]].count(0) == x


def test_ranks_give_the_ids_of_the_file():
    e = crosswalk.encoders(crosswalk.TOKENIZERS)
    assert e.ranked is not None
    r = random.Random(12)
    signs = ["a", "b", " ", "  ", "\n", "\t", "'s", "'LL", "é", "😀", "1", "23", ",", " ", "　", "<s>", "<|endoftext|>", "\r\n", "The", "\x00", "́", "Ⅷ", "가"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 60))) for _ in range(5000)]
    assert [e.ranked(t) for t in texts] == [x.ids for x in e.a.encode_batch(texts, add_special_tokens=False)]


def test_registered_alignment(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = brute_alignment([t for _, t in docs])[0]
    got = {tuple(r) for r in QUERIES["op12_merge_path"](spark, sf).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert got == {(d, *w) for (d, _), w in zip(docs, want)}


# Nearest neighbours


def brute_nearest(rows, k=5, every=50):
    """rows: (id, vector), ids unique. query -> list of (score, id) of all others, best first."""
    kept = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = len(min(kept, key=lambda r: r[0])[1])
    kept = [(i, v) for i, v in kept if len(v) == width]
    ids, u = [i for i, _ in kept], np.stack([v / np.abs(v).max() for _, v in kept])
    u /= np.linalg.norm(u, axis=1)[:, None]
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = u @ u[n]
            out[i] = [(float(s[m]), ids[m]) for m in np.lexsort((ids, -np.round(s, 12))) if m != n]
    return out


def answers(df):
    got = defaultdict(list)
    for r in sorted(df.select("query_id", "rank", "vec_id", "score").collect(), key=lambda r: (r[0], r[1])):
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    return got


def recall(got, want, k=5):
    assert set(got) == {q for q, w in want.items() if w}
    hit = total = 0
    for q, w in want.items():
        found = got.get(q, [])
        true = dict((i, s) for s, i in w)
        assert q not in {i for _, i in found} and len({i for _, i in found}) == len(found)
        assert all(abs(true[i] - s) < 1e-9 for s, i in found)
        assert [(-round(s, 11), i) for s, i in found] == sorted((-round(s, 11), i) for s, i in found)
        bar = w[min(k, len(w)) - 1][0] - 1e-12 if w else 0
        hit += sum(true[i] >= bar for _, i in found)
        total += min(k, len(w))
    return hit / max(1, total)


def test_whole_quota_is_brute_force(spark):
    """With a quota of all rows every neighbour is found: ties, copies, nulls, zero and other vectors, huge and tiny lengths."""
    base = some_vectors(120, 6, 3)
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(150, base[0]), (151, base[0]), (200, base[0]), (202, [2.0 * x for x in base[0]]), (203, [1e300 * x for x in base[1]]), (204, [1e-300 * x for x in base[1]])]
    rows += [(250, None), (251, []), (252, [0.0] * 6), (253, [1.0] * 5 + [None]), (254, [1.0] * 5 + [float("nan")]), (255, [1.0] * 5), (256, [1.0] * 5 + [float("-inf")]), (None, base[5]), (300, [-0.0] + base[7][1:]), (301, [0.0] + base[7][1:])]
    df = frame(spark, [(i, v, 1) for i, v in rows]).withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    df = df.unionByName(df.where("vec_id in (150, 3)"))
    got, want = answers(forest.nearest(df, quota=1 << 40)), brute_nearest(rows)
    assert recall(got, want) == 1.0 and all(len(g) == 5 for g in got.values())
    assert [i for _, i in got[0]][:2] == [150, 151] or {150, 151, 200, 202} >= {i for _, i in got[0][:4]}


def test_few_rows(spark):
    assert forest.nearest(frame(spark, [(1, None, 1)])).count() == 0
    assert forest.nearest(frame(spark, [(0, [1.0, 0.0], 1)])).count() == 0
    got = answers(forest.nearest(frame(spark, [(0, [1.0, 0.0], 1), (7, [1.0, 1.0], 1), (9, [0.0, -2.0], 1)])))
    assert [i for _, i in got[0]] == [7, 9]


def test_hot_groups_and_fitted_quota(spark, monkeypatch):
    """A third of all rows near one vector, a third copies of another; small ranges, so nodes span many of them."""
    monkeypatch.setattr(forest, "RANGE", 64)
    monkeypatch.setattr(forest, "SORTED", 512)
    r = np.random.default_rng(6)
    hot, copy = r.standard_normal(16), r.standard_normal(16).tolist()
    rows = [(i, (hot + 0.05 * r.standard_normal(16)).tolist()) for i in range(0, 900, 3)] + [(i, copy) for i in range(1, 900, 3)] + [(i, r.standard_normal(16).tolist()) for i in range(2, 900, 3)]
    got, want = answers(forest.nearest(frame(spark, [(i, v, 1) for i, v in rows]))), brute_nearest(rows)
    assert recall(got, want) >= 0.9 and all(len(g) == 5 for g in got.values())


def test_counts_over_tasks_are_whole(spark, monkeypatch):
    """Candidates at every level and tree, whatever tasks the sorted keys are cut into."""
    monkeypatch.setattr(forest, "SORTED", 100)
    rows = [(i, v, 1) for i, v in enumerate(some_vectors(300, 5, 21))]
    vectors, _, width = forest._distinct(frame(spark, rows), "vec_id", "embedding", 50)
    normals = forest.planes(width)
    counted = forest._counted(vectors, width, normals, 40, 16)
    nodes = forest._Nodes(counted.where("rep is null").select("key", "counts", "starts", "last").collect())
    got = {x["rep"]: x["totals"] for x in forest._ascents(counted, nodes).collect()}
    v = vectors.collect()
    own = forest.keys(forest.directions(np.array([x["v"] for x in v])), np.array([x["rep"] for x in v]), normals)
    assert len(got) == 6
    for n, x in enumerate(v):
        if x["rep"] in got:
            want = [int(sum(((own[:, t] >> forest._shift(level)) == (own[n, t] >> forest._shift(level))).sum() for t in range(forest.TREES))) for level in range(forest.BITS + 1)]
            assert got[x["rep"]] == want


@pytest.mark.parametrize("size", ["0.001", "0.1"])
def test_registered_search_recall(spark, size):
    where = f"/root/testdata/sf{size}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()]
    assert recall(answers(QUERIES["op11_prefix_forest"](spark, where)), brute_nearest(rows)) >= 0.9
