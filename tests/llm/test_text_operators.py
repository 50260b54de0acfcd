"""Each text operator against a brute-force version, and on awkward tables."""

import base64
import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kongrid.llm import archives, common, components, latent, licenses, lines, mixing, quality, repeats, sharding, simhash, urls

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BASE = prose(160, 1)
AWKWARD = [
    (1, BASE), (2, BASE), (2, BASE), (None, "no id " + prose(40, 2)), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r "), (7, "é" * 700 + "\nÀ B c"), (8, "a" * 900),
    (9, prose(30_000, 3)), (10, BASE[:450] + " changed " + BASE[450:]), (11, "one"), (12, "line\nline\nline\n\nline x"), (13, "\x00\x1f|#*$%&<>\u3000\u00a0 x"), (14, BASE.upper()), (None, None),
    (15, "MIT License and the Apache License, Apache  LICENSE; cc-by"), (16, prose(9, 4) + " " + prose(9, 4)),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with clashing extra columns."""
    df = spark.createDataFrame(AWKWARD, DOCS).repartition(3)
    for name in ("label", "score", "size", "n", "_k", "h", "fp", "shard", "rate", "kept"):
        df = df.withColumn(name, F.lit(None).cast("int"))
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    schema = "doc_id long, quality int, toxic int"
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (9, 1, 0), (12, 0, 0), (None, 1, 1), (10, None, None), (999, 1, 0)], schema)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def data(text):
    return (text or "").encode()


# Sharding


def brute_capacity(sizes, shards):
    def fits(c):
        used, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                used, at = used + 1, 0
            at += s
        return used <= shards

    return next(c for c in range(1, sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed", range(6))
def test_smallest_capacity_with_unknown_blocks(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 60) for _ in range(r.randint(1, 200))]
    groups = [{"block": f"{i * 16 // len(sizes):02d}", "digest": f"{i:05d}", "bytes": s} for i, s in enumerate(sizes)]
    names = sorted({g["block"] for g in groups})
    blocks = [{"block": b, "bytes": sum(g["bytes"] for g in groups if g["block"] == b), "last": max(g["digest"] for g in groups if g["block"] == b)} for b in names]
    walk = sharding._Walk(blocks, lambda want: [g for g in groups if g["block"] in want])
    shards = r.randint(1, 9)
    capacity = sharding.smallest_capacity(walk, shards, max(sizes))
    assert capacity == brute_capacity(sizes, shards)
    cuts = walk.cuts(capacity, shards)
    of = Counter()
    for g in groups:
        of[sum(g["digest"] > c for c in cuts)] += g["bytes"]
    assert max(of.values()) == capacity and max(of) < shards


def test_shards(docs, empty):
    got = sharding.shard_minimax(docs, 4).toPandas()
    assert len(got) == len(AWKWARD) and got["shard"].between(0, 3).all()
    assert sorted(got["size"]) == sorted(len(data(t)) + 1 for _, t in AWKWARD)
    assert sorted(got["text_crc32"]) == sorted(zlib.crc32(data(t)) for _, t in AWKWARD)
    assert (got.groupby("digest")["shard"].nunique() == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sharding.shard_minimax(empty, 4).count() == 0


def test_heavy_group_has_a_shard_of_its_own(spark):
    rows = [(i, "same " * 50) for i in range(100)] + [(1000 + i, f"text {i} " + "x" * (i % 7)) for i in range(200)]
    got = sharding.shard_minimax(spark.createDataFrame(rows, DOCS), 5).toPandas()
    total = got.groupby("shard")["size"].sum()
    heavy = 100 * 251
    assert total.max() == heavy and (total[total != heavy] > 300).all() and len(total) == 5


# Archives


def page_rows(spark):
    rows = [(3, "http://a.example/x y", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "http://b.example/", None), (5, "http://c.example/\n", ""), (6, "u", "lines\r\n\r\nWARC/1.0\nfiledesc://x\r\nend\n"), (7, "u", "é" * 3000), (None, "u", "<p>same</p>"), (8, "u", "<p>same</p>"), (8, "u", "<p>same</p>"), (9, "u", "once")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("head", F.lit("h"))


@pytest.mark.parametrize("least", [0, 5, 10_000])
def test_archives_round_trip(spark, least):
    rows, pages = page_rows(spark)
    got = rows_of(archives.archive_round_trip(pages.repartition(3), least), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    expected = []
    for page, _, html in rows:
        b = data(html)
        twins = [p for p, _, h in rows if data(h) == b]
        first = min((p for p in twins if p is not None), default=None)
        again = len(b) >= least and len(twins) > 1 and page != first
        expected.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(expected, key=repr)


def test_archives_of_no_page(spark):
    assert archives.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def feed(data, sep):
    import pyarrow as pa

    return archives.Feed(iter([pa.RecordBatch.from_arrays([pa.array(data.split(sep), pa.binary())], names=["value"])]))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers_by_version(version):
    body = archives.arc_intro("x.arc", version) + b"\n" + archives.arc_record(4, "http://a/ b", b"l1\nl2", version, 0, "x.arc")
    ((url, ip, date, mime, doc),) = archives.arc_records(feed(body, b"\n"))
    assert (url, ip, date, mime) == ("http://a/%20b", "0.0.0.0", archives.CAPTURED, "text/html") and archives.split_http(doc)[1] == b"l1\nl2"


def test_wrong_declared_length_is_reported():
    with pytest.raises(ValueError, match="declared length"):
        list(archives.arc_records(feed(archives.arc_intro("x", 1) + b"\nhttp://a 0.0.0.0 2024 text/html 3\nabcdef", b"\n")))
    with pytest.raises(ValueError, match="version 2"):
        list(archives.arc_records(feed(archives.arc_intro("x", 2) + b"\nhttp://a 0.0.0.0 2024 text/html 3\nabc", b"\n")))


# Licenses


def brute_licenses(text, counts, threshold=0.8):
    words = licenses.words(data(text))
    places, base = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.encode().split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    window = max(32, 2 * max(len(t.split()) for t in licenses.TEMPLATES.values()))
    matches = {}
    for block in licenses.blocks(data(text), window):
        for label, t in licenses.TEMPLATES.items():
            tokens = set(licenses.words(t.encode()))
            share = len(tokens & set(block)) / len(tokens)
            if share >= threshold - 1e-9:
                matches[label] = max(share, matches.get(label, 0))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), matches


def test_licenses(spark, docs, empty):
    notices = [(100 + i, f"{prose(12, i)}\n{t[: len(t) - 3 * (i % 2)]}\n{prose(5, i + 50)} " * (1 + i % 3)) for i, t in enumerate(licenses.TEMPLATES.values())]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(notices, DOCS))
    got = {(r["doc_id"], r["n_words"], r["n_base"]): r for r in licenses.scan_licenses(both).collect()}
    for key, text in AWKWARD + notices:
        n, places, first, last, base, matches = brute_licenses(text, {})
        r = got[(key, n, places)]
        assert (r["first_word"], r["last_word"], r["base_labels"]) == (first, last, base)
        assert {m["label"]: m["containment"] for m in r["matches"]} == pytest.approx(matches)
        assert set(base.split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan_licenses(empty).count() == 0


def test_filters_prune_and_lose_nothing():
    """Blocks with some of a template's tokens: the positional filter drops candidates, and none that reaches the threshold."""
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)]
    templates = {f"t{k}": " ".join(r.sample(vocabulary, r.randint(4, 14))) for k in range(30)}
    index = licenses.Index(templates, {w.encode(): r.randint(0, 9) for w in vocabulary}, 0.8)
    pruned = by_position = 0
    for _ in range(300):
        block = [w.encode() for w in r.sample(vocabulary, r.randint(1, 25))] + [b"other"] * r.randint(0, 3)
        share = {t: len(set(block) & set(tokens)) / len(tokens) for t, tokens in enumerate(index.sets)}
        assert index.matches(block) == {t: x for t, x in share.items() if x >= 0.8 - 1e-9}
        held = sorted(set(block).intersection(index.rank), key=index.rank.get)
        left, gone = index.candidates(held)
        pruned += gone
        hit = {t for token in held for t, _ in index.prefix.get(token, ())}
        by_position += sum(t not in left and len(held) >= index.need[t] for t in hit)
    assert pruned > by_position > 0


def label_sets(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in licenses.scan_licenses(df, base={}).collect()}


@pytest.mark.parametrize("columns", [40, 72])
def test_notices_wrapped_over_lines(spark, columns):
    texts, names = [], list(licenses.TEMPLATES)
    for k, t in enumerate(licenses.TEMPLATES.values()):
        wrapped = textwrap.fill(prose(7 * k, k) + " " + t + " " + prose(40, k + 70), columns)
        texts += [wrapped, wrapped.replace("\n", "\n# "), textwrap.fill(t, columns)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for k, text in enumerate(texts):
        found, tokens = {m["label"]: m["containment"] for m in got[k]["matches"]}, re.findall("[a-z0-9]+", text.lower())
        for label, t in licenses.TEMPLATES.items():
            want, n = set(t.split()), len(t.split())
            # Every run of the template's length, wherever lines end.
            share = max(len(want & set(tokens[i : i + n])) for i in range(len(tokens))) / len(want)
            assert share < 0.8 or found[label] >= share - 1e-9
        own = names[k // 3]
        assert found[own] == 1 and own in got[k]["labels"].split(",") and got[k]["score"] == 1
        assert not {"agpl-notice", "cc-by-notice"} - {own} & set(got[k]["labels"].split(","))


def test_two_notices_on_one_line(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0", "released under the MIT license"
    gpl, agpl = "This work is licensed under the GNU General Public License version 3.", "Licensed under the GNU Affero General Public License version 3"
    by, nc = "Licensed under CC BY 4.0", "licensed under CC BY-NC 4.0"
    texts = {
        f"{apache} or {mit}": {"apache-notice", "mit-notice"}, f"{prose(70, 1)} {mit} {prose(3, 2)} {apache} {prose(70, 3)}": {"apache-notice", "mit-notice"},
        gpl: {"gpl-notice"}, f"{prose(26, 4)} {gpl} {prose(80, 5)}": {"gpl-notice"}, f"{gpl} {prose(4, 6)} {agpl}": {"gpl-notice", "agpl-notice"}, agpl: {"agpl-notice"},
        by: {"cc-by-notice"}, nc: {"cc-by-nc-notice"}, f"{by} {prose(3, 7)} {nc}": {"cc-by-notice", "cc-by-nc-notice"}, f"{prose(20, 8)}": set(),
    }
    got = label_sets(spark, list(texts))
    assert [got[k] for k in range(len(texts))] == list(texts.values())


# Line labels


def brute_repeats(tokens, window=8):
    seen = Counter(tuple(tokens[i : i + window]) for i in range(len(tokens) - window + 1))
    marked = set()
    for i in range(len(tokens) - window + 1):
        if seen[tuple(tokens[i : i + window])] > 1:
            marked.update(range(i, i + window))
    return len(marked)


def test_line_statistics(docs, empty, labels):
    field = lines.train_field(docs.select("doc_id", "text"), labels)
    got = rows_of(lines.judge_lines(docs, field), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = []
    for key, text in AWKWARD:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                dup += line in seen
                seen.add(line)
        repeats = brute_repeats(words)
        expected.append((key, len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, repeats, len(words) < 20 or 100 * repeats > 30 * len(words)))
    assert got == sorted(expected, key=repr)
    assert lines.judge_lines(empty, field).count() == 0


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    field = lines.LineField(r.normal(size=(lines.N_FEATURES, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    x = r.normal(size=(7, lines.N_FEATURES))
    emit = x @ field.weights

    def score(path):
        return field.start[path[0]] + emit[0, path[0]] + sum(field.steps[a, b] + emit[i + 1, b] for i, (a, b) in enumerate(zip(path, path[1:])))

    best = max(([k >> i & 1 for i in range(7)] for k in range(128)), key=score)
    assert field.viterbi(x).tolist() == best


def test_field_learns_what_boilerplate_looks_like():
    good, bad = [b"A sentence of plain words, and more.", b"Then it goes on and ends."], [b"home | about | terms", b"$$$ !!! ###"]
    shapes = [(lines.line_features(x, [False] * 2), np.full(2, y)) for x, y in ((good, 1), (bad, 0))] * 4
    field = lines.fit_field(shapes)
    mixed = lines.line_features([bad[0], good[0], good[1]], [False] * 3)
    assert field.viterbi(mixed)[1:].tolist() == [1, 1] and field.viterbi(lines.line_features(bad, [False] * 2)).tolist() == [0, 0]


# Quality


def test_quality_ranks_held_out_documents(spark, sf, docs, empty, labels):
    big = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    marks = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/labels.parquet")
    model = quality.train_quality(big, marks)
    got = quality.score_quality(big, model).join(marks, "doc_id").where("held_out").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % 4 == 2)).all()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good]) > 0.95
    assert (good >= 0.7).mean() > 0.95 and (bad < 0.7).mean() > 0.7
    odd = quality.score_quality(docs, model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in odd)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in odd)
    assert quality.score_quality(empty, model).count() == 0
    assert quality.train_quality(empty, labels).prior == 0.5
    assert quality.score_quality(docs, quality.train_quality(docs, labels.where("false"))).where("score <> 0.5").count() == 0


def test_prior_is_near_the_truth():
    r = np.random.default_rng(1)
    p, n = r.normal(2, 1, (3000, 3)), r.normal(-2, 1, (3000, 3))
    u = np.vstack([p[:1400], n[:600]])
    assert abs(quality.fit(p[1400:], u).prior - 0.7) < 0.06


# SimHash


def brute_fingerprint(text, width=4):
    w = data(text).lower().split()
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, radius):
    label = list(range(len(codes)))
    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_near_duplicates(docs, empty):
    got = rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    codes = [brute_fingerprint(t) for _, t in AWKWARD]
    label = brute_components(codes, 4)
    least = {x: min((k for (k, _), y in zip(AWKWARD, label) if x == y and k is not None), default=None) for x in label}
    assert got == sorted(((k, f"{c:016x}", least[x]) for (k, _), c, x in zip(AWKWARD, codes, label)), key=repr)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("unit,short", [(4096, 32), (8, 2)])
def test_links_of_dense_groups(spark, monkeypatch, unit, short):
    monkeypatch.setattr(simhash, "UNIT", unit)
    monkeypatch.setattr(simhash, "SHORT", short)
    r = random.Random(9)
    centre = r.getrandbits(64)
    codes = {centre}
    for _ in range(150):  # a dense ball, and chains that leave it
        codes.add(centre ^ sum({1 << r.randrange(64) for _ in range(r.randint(1, 5))}))
    for start in list(codes)[:10]:
        x = start
        for _ in range(5):
            x ^= sum({1 << r.randrange(64) for _ in range(4)})
            codes.add(x)
    codes |= {r.getrandbits(64) for _ in range(100)}
    codes = sorted(codes)
    df = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    links = simhash.near_links(df, 4)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    ours = [root.get(simhash._signed(c), simhash._signed(c)) for c in codes]
    theirs = brute_components(codes, 4)
    assert len(set(zip(ours, theirs))) == len(set(ours)) == len(set(theirs))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(500, 100 + i) for i in range(60)] + [(200, 200), (900, 901), (901, 900)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(60)} | {got[500]} == {100} and got[901] == got[900] == 900 and 200 not in got


# Repeats


def brute_strip(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(t, mask) if not m)
        out.append((len(t), sum(mask), len([x for x in bytes(mask).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,window,few", [(400, 256, 256), (40, 16, 256), (40, 16, 2)])
def test_strip_repeats(docs, empty, monkeypatch, length, window, few):
    monkeypatch.setattr(repeats, "FEW", few)
    got = rows_of(repeats.strip_repeats(docs, length, window), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((k, *r) for (k, _), r in zip(AWKWARD, brute_strip([data(t) for _, t in AWKWARD], length))), key=repr)
    assert repeats.strip_repeats(empty, length, window).count() == 0


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    text = prose(900, 8)
    rows = [(1, text), (2, "x" + text[1500:4100] + "y"), (3, text[300:720])]
    got = rows_of(repeats.strip_repeats(spark.createDataFrame(rows, DOCS), 100, 40), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((k, *r) for (k, _), r in zip(rows, brute_strip([data(t) for _, t in rows], 100))), key=repr)


def test_small_slices_compare_alike(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TEXTS", 1)
    monkeypatch.setattr(repeats, "PHRASES", 2)
    text = prose(900, 8)
    rows = [(k, text[97 * k : 97 * k + 1200 + 50 * (k % 7)]) for k in range(30)]
    got = rows_of(repeats.strip_repeats(spark.createDataFrame(rows, DOCS), 100, 40), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((k, *r) for (k, _), r in zip(rows, brute_strip([data(t) for _, t in rows], 100))), key=repr)


def test_likely_misses_no_key_and_needs_no_python(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"), F.lit("x").alias("a.b"))
    keys = spark.range(0, 20_000, 7).select(F.xxhash64("id").alias("k")).union(spark.createDataFrame([(-1,), (0,)], "k long"))
    some, none = common.likely(rows, keys.withColumnRenamed("k", "h"), "h")
    yes, no = ([r.id for r in x.collect()] for x in (some, none))
    assert some.columns == rows.columns and sorted(yes + no) == list(range(20_000))
    assert set(range(0, 20_000, 7)) <= set(yes) and len(yes) < 3_000
    assert common.likely(rows, keys.limit(0).withColumnRenamed("k", "h"), "h")[0].isEmpty()
    # Python workers beside those of the kernels took an executor beyond its memory
    assert "Python" not in some._jdf.queryExecution().executedPlan().toString()


# Decontamination


def test_leaks(spark, docs, empty):
    items = [(k, prose(20 + k, 1000 + k)) for k in range(30)] + [(98, ""), (99, None), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    leaks = []
    for k in range(30):
        w = items[k][1].split()
        if k % 3 == 1:
            w[2::6] = ["other"] * len(w[2::6])  # one word in six is another
        leaks.append((2000 + k, prose(70 + k, 3000 + k) + " " + " ".join(w) + ". " + prose(50, 4000 + k)))
    clean = [(5000 + k, prose(200, 6000 + k)) for k in range(60)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(leaks + clean, DOCS))
    got = {r["doc_id"]: r for r in latent.find_leaks(every, bench, common=0.05).where("doc_id >= 2000").collect()}
    assert all(got[2000 + k]["contaminated"] and got[2000 + k]["item_id"] == k for k in range(30))
    assert not any(got[k]["contaminated"] for k, _ in clean)
    kept = latent.without_leaks(every.withColumn("score", F.lit(1)), bench, common=0.05)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == len(AWKWARD) + len(clean)
    assert latent.find_leaks(empty, bench).count() == 0
    assert latent.find_leaks(docs, bench.where("false")).where("contaminated").count() == 0


def test_leaks_of_items_longer_than_a_passage(spark):
    """Verbatim and paraphrased, with the parameters of op7_latent_leaks."""
    r = np.random.default_rng(11)
    vocabulary = [f"w{i}x" for i in range(20_000)]
    weights = 1 / np.arange(10, 20_010)

    def zipf(n):
        return [vocabulary[i] for i in r.choice(20_000, n, p=weights / weights.sum())]

    items = [(k, zipf((60, 130, 200, 400)[k % 4])) for k in range(40)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    leaks = []
    for k, w in items:
        other = list(w)
        other[2::6] = ["other"] * len(other[2::6])  # one word in six is another
        leaks += [(2 * k + j, " ".join(zipf(int(r.integers(0, 90))) + x + zipf(int(r.integers(0, 90))))) for j, x in enumerate((w, other))]
    # A third of an item is no copy of it.
    clean = [(1000 + k, " ".join(zipf(200))) for k in range(600)] + [(2000 + k, " ".join(zipf(70) + w[: len(w) // 3] + zipf(70))) for k, w in items]
    got = {x["doc_id"]: x for x in latent.find_leaks(spark.createDataFrame(leaks + clean, DOCS), bench).collect()}
    assert [k for k, _ in leaks if got[k]["item_id"] != k // 2] == []
    assert not any(got[k]["contaminated"] for k, _ in clean)


def test_parts_cover_an_item():
    for n in (1, 63, 64, 65, 96, 97, 130, 400):
        w = [b"%d" % i for i in range(n)]
        cut = latent.parts(w)
        assert {x for p in cut for x in p} == set(w) and all(len(p) == min(n, 64) for p in cut)
        assert all(int(b[0]) - int(a[0]) <= 32 for a, b in zip(cut, cut[1:]))


def test_lcs_by_bits():
    r = random.Random(2)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    for _ in range(50):
        a, b = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 40))] for _ in range(2))
        tail = r.randint(1, len(a))
        assert latent.lcs(a, b, tail) == (slow(a, b), slow(a[len(a) - tail :], b))


# URLs


def test_urls(spark):
    given = [
        (1, "https://www.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), (4, "http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), (5, "x://net?q", "net", "", None, None),
        (6, "no scheme", "", "", None, None), (7, None, "", "", None, None), (8, "a://b://c/d", "b:", "//c/d", None, None), (8, "a://b://c/d", "b:", "//c/d", None, None), (9, "http://K\u0130.COM/\nx?", "k\u0130.com", "/\nx", "com/", "allow"), (None, "", "", "", None, None),
    ]
    pages = spark.createDataFrame([(r[0], r[1]) for r in given], "page_id long, url string").withColumn("verdict", F.lit("?")).withColumn("host", F.lit("?"))
    labelled = spark.createDataFrame([(["h=bad", "p=x", f"q={i % 3}"], "block") for i in range(40)] + [(["h=good", "p=x"], "allow") for i in range(60)] + [(["p=x"], "allow")] * 20, "items array<string>, label string")
    mined = urls.mine_rules(labelled)
    assert mined.best(["h=bad", "p=x"])[:2] == ("block", "h=bad") and mined.best(["h=good"])[0] == "allow" and mined.best(["z"]) == (None, None, None)
    got = rows_of(urls.filter_urls(pages, mined), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((a, c, d, e, f or "allow") for a, _, c, d, e, f in given), key=repr)
    assert urls.mine_rules(labelled.where("false")).rules == [] and urls.filter_urls(pages.where("false"), mined).count() == 0


def test_labels_reach_pages_by_text(spark):
    """Documents are labelled, pages hold their texts under other ids. Rules mined from three quarters of the pages judge the rest."""
    r = random.Random(8)
    docs = [(k, f"{prose(20, k)}\n{prose(15, 1000 + k)}\nthis line stands in each and every document of the site") for k in range(200)]
    marks = [(k, 0 if k % 3 == 0 else 1, 0) for k in range(200)] + [(None, 0, 1), (5, None, None)]
    bad = {k for k, q, _ in marks if q == 0 and k is not None}

    def page(k):
        path = "promo" if (k in bad) != (r.random() < 0.1) else "news"
        body = "</p><p>".join(docs[k][1].replace("  ", " ").split("\n"))
        return 5000 - k, f"http://h{k % 7}.org/{path}/{k}", f"<html><nav>menu</nav><p>{body}</p></html>"

    rows = [page(k) for k in range(200)]
    odd = [(1, "http://a.org/x", None), (2, None, ""), (None, "http://a.org/y", "<p>no line of any document is found in this page</p>"), rows[3]]
    pages = spark.createDataFrame(rows + odd, "page_id long, url string, html string").withColumn("line", F.lit(1)).withColumn("label", F.lit(2))
    of = urls.label_urls(pages, spark.createDataFrame(docs + [(None, None), (7, None)], DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = {x["page"]["id"]: x["label"] for x in of.collect()}
    assert got == {5000 - k: "block" if k in bad else "allow" for k in range(200)}
    learnt = urls.mine_rules(of.where("page.id % 4 <> 2"))
    rest = of.where("page.id % 4 = 2").collect()
    right = sum((learnt.best(x["items"])[0] or "allow") == x["label"] for x in rest) / len(rest)
    share = sum(x["label"] == "allow" for x in rest) / len(rest)
    assert right >= 0.8 > 0.75 > share


def test_rules_against_counting(spark):
    r = random.Random(3)
    baskets = [(sorted(r.sample(["a", "b", "c", "d"], r.randint(1, 4))), r.choice(["allow", "allow", "block"])) for _ in range(200)]
    mined = urls.mine_rules(spark.createDataFrame(baskets, "items array<string>, label string"), support=0.02, confidence=0.5, lift=1.0)
    for tokens, verdict, confidence, n in mined.rules:
        has = [label for items, label in baskets if tokens <= set(items)]
        assert n == has.count(verdict) and confidence == pytest.approx(n / len(has)) and n >= 4


# Mixing


def test_mixing_meets_targets(spark, docs, empty):
    r = random.Random(4)
    rows = [(k, prose(60, k) + (" awful nasty vile" * (2 + k % 3) if k % 4 == 0 else "")) for k in range(400)]
    df = spark.createDataFrame(rows, DOCS).withColumn("rate", F.lit(1)).withColumn("copies", F.lit(1)).repartition(3)
    marks = spark.createDataFrame([(k, "bad" if k % 4 == 0 else "fine") for k in range(0, 400, 3)] + [(None, "bad"), (7, "unknown")], "doc_id long, domain string")
    mixture = mixing.fit_mixture(df, marks, {"fine": 0.95, "bad": 0.05})
    got = mixing.mixing_rates(df, mixture).toPandas()
    assert rows_of(mixing.fitted_rates(mixture), "doc_id", "rate", "copies") == rows_of(mixing.mixing_rates(df, mixture), "doc_id", "rate", "copies")
    mass = {d: (got[f"p_{d}"] * got.n_tokens * got.rate).sum() for d in ("fine", "bad")}
    assert mass["bad"] / sum(mass.values()) == pytest.approx(0.05, abs=0.002) and (got.rate >= 0).all()
    assert mass["fine"] == pytest.approx((got.p_fine * got.n_tokens).sum(), rel=0.01)
    assert (got[got.doc_id % 4 == 0].p_bad > 0.5).all() and (got[got.doc_id % 4 != 0].p_bad < 0.2).all()
    out = mixing.mixed(df, mixture)
    assert out.columns == df.columns and out.count() == got.copies.sum() and (got[got.doc_id % 4 != 0].copies == 1).all()
    odd = mixing.mixing_rates(docs, mixture).collect()
    assert len(odd) == len(AWKWARD) and all(x["p_fine"] + x["p_bad"] == pytest.approx(1) for x in odd)
    none = mixing.fit_mixture(empty, marks, {"fine": 0.5, "bad": 0.5})
    assert none.steps == [] and mixing.mixing_rates(empty, none).count() == 0
    plain = mixing.fit_mixture(df, marks.where("false"), {"fine": 0.5, "bad": 0.5})
    assert mixing.mixing_rates(df, plain).count() == 400


def test_mixing_with_labels_that_over_represent_a_domain(spark):
    """Every second id is labelled, so half of the labels are bad, but a quarter of the documents."""
    r = [(k, prose(60, k) + (" awful nasty vile" * (2 + k % 3) if k % 4 == 0 else "")) for k in range(400)]
    df = spark.createDataFrame(r, DOCS).repartition(3)
    marks = spark.createDataFrame([(k, "bad" if k % 4 == 0 else "fine") for k in range(0, 400, 2)] + [(None, "bad"), (7, "unknown")], "doc_id long, domain string")
    mixture = mixing.fit_mixture(df, marks, {"fine": 0.95, "bad": 0.05})
    got = mixing.mixing_rates(df, mixture).toPandas()
    assert got.p_bad.mean() == pytest.approx(0.25, abs=0.03)
    assert (got[got.doc_id % 4 == 0].p_bad > 0.5).all() and (got[got.doc_id % 4 != 0].p_bad < 0.2).all()
    mass = {d: (got[f"p_{d}"] * got.n_tokens * got.rate).sum() for d in ("fine", "bad")}
    assert mass["bad"] / sum(mass.values()) == pytest.approx(0.05, abs=0.002) and (got.rate >= 0).all()
    assert mass["fine"] == pytest.approx((got.p_fine * got.n_tokens).sum(), rel=0.01)
    assert (got[got.doc_id % 4 != 0].copies == 1).all()


def least_squares(tokens, p, target, scale, rounds=20_000):
    """Rates by plain projected gradient with one step size, for as long as it takes."""
    r, a = np.ones(len(tokens)), (p * tokens[:, None]) / np.sqrt(scale)
    step = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(rounds):
        r = np.maximum(0, r - step * (a @ (a.T @ r - target / np.sqrt(scale))))
    return r


@pytest.mark.parametrize("kind", ["rare", "alike"])
def test_descent_against_plain_least_squares(spark, kind):
    """A domain that must nearly vanish is brought to its target; targets that can't all be met end at the least error."""
    g = np.random.default_rng(5)
    tokens = g.integers(5, 200, 300).astype(float)
    if kind == "rare":
        bad = np.where(np.arange(300) % 3 == 0, g.uniform(0.7, 0.999, 300), g.uniform(0, 0.02, 300))
        weights = [0.995, 0.005]
    else:
        bad, weights = np.full(300, 0.3), [0.9, 0.1]
    p = np.stack([1 - bad, bad], 1)
    rows = spark.createDataFrame([(float(t), *map(float, q)) for t, q in zip(tokens, p)], "_mix_tokens double, _mix_p0 double, _mix_p1 double")
    steps, missed = mixing.solve_rates(rows, weights)
    got = np.ones(300)
    for s in steps:
        got = np.maximum(0, got - p @ np.array(s))
    had = tokens @ p
    target = np.array(weights) * had[0] / weights[0]
    assert missed == pytest.approx(list((got * tokens) @ p / target - 1), abs=1e-9)
    scale = np.maximum(had, target)
    plain = least_squares(tokens, p, target, scale)

    def error(r):
        return (((r * tokens) @ p - target) ** 2 / scale).sum()

    assert error(got) <= 1.001 * error(plain) + 1e-6 * error(np.ones(300))
    if kind == "rare":
        assert max(map(abs, missed)) < 0.02 and len(steps) < 40


def test_mixed_keeps_columns_of_any_name(spark):
    rows = [(1, None, 5.0, "a"), (1, None, 5.0, "a"), (2, "", 6.0, "b"), (None, "some words", 7.0, None), (4, "awful words", None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _mix_tokens double, _mix_p0 string")
    marks = spark.createDataFrame([(2, "fine"), (4, "bad")], "doc_id long, domain string")
    out = mixing.mixed(df, mixing.fit_mixture(df, marks, {"fine": 0.5, "bad": 0.5}), dead_zone=2.0)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))


def test_words_are_split_at_all_white_space(spark):
    plain = prose(300, 9)
    rows = [(1, plain)] + [(2 + k, plain.replace(" ", c)) for k, c in enumerate(["\n", "\t", "\r\n", "\x0b", "\x0c", " \n "])] + [(8, "\n" + plain + "\n")]
    df = spark.createDataFrame(rows, DOCS)
    got = df.select(mixing.token_buckets(F.col("text")).alias("b")).collect()
    assert len(got[0]["b"]) == 300 and all(r["b"] == got[0]["b"] for r in got)
    model = mixing.fit_mixture(df, spark.createDataFrame([(1, "fine")], "doc_id long, domain string"), {"fine": 0.5, "bad": 0.5})
    assert {r["n_tokens"] for r in mixing.fitted_rates(model).collect()} == {300}


def test_joins_beyond_the_broadcast_limit(spark):
    left = spark.createDataFrame([(k % 7, k) for k in range(200)] + [(None, 1)], "k long, v long")
    stats = left.where("k <> 3").groupBy("k").agg(F.count("*").alias("n"))
    assert rows_of(common.attach_left(left, stats, ["k"], "n", limit=1), "k", "v", "n") == rows_of(left.join(stats, "k", "left"), "k", "v", "n")
