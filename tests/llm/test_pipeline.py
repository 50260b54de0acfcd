"""The pipeline's stages on planted rows, and run() on the smallest tables."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from kongrid.llm.simhash import fingerprint

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "hot", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(n))


def brute_dedup(rows):
    """Union by fingerprints within 4 bits; of each group the smallest (null last, id); ties by text are any one of the texts."""
    unique = list(dict.fromkeys((i, t or "") for i, t in rows))
    prints = [fingerprint(t.encode()) for _, t in unique]
    root = list(range(len(unique)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(unique)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    groups = {}
    for k, (i, t) in enumerate(unique):
        groups.setdefault(find(k), []).append((i is None, i or 0, t))
    return groups


def test_near_dedup_keeps_one_row_of_each_group(spark):
    base = [prose(80, k) for k in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, t) for k, t in enumerate(base[:5])] + [(3, base[3]), (3, base[3])]  # copies, rows repeated in full
    rows += [(7, prose(90, 50)), (7, prose(90, 51))]  # one id, other texts: each is a document
    rows += [(None, prose(70, 60)), (None, prose(70, 60)), (None, base[1]), (None, None), (200, None), (201, "")]
    got = pipeline.near_dedup(spark, docs_of(spark, rows).withColumn("name", F.lit(1)).withColumn("fp", F.lit(2)), "")
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = Counter((r["doc_id"], r["text"] or "") for r in got.collect())
    groups = brute_dedup(rows)
    assert sum(kept.values()) == len(groups) and max(kept.values()) == 1
    for members in groups.values():
        least = min(m[:2] for m in members)
        allowed = {(None if m[0] else m[1], m[2]) for m in members if m[:2] == least}
        assert len(allowed & set(kept)) == 1, members
    assert pipeline.near_dedup(spark, docs_of(spark, rows).limit(0), "").count() == 0


def test_shard_stage(spark):
    rows = [(k, prose(5 + k % 40, k)) for k in range(150)] + [(1000, None), (None, ""), (1001, prose(5, 0))]
    out = pipeline.shard(spark, docs_of(spark, rows), "").collect()
    assert len(out) == len(rows) and {r["shard"] for r in out} <= set(range(16))
    text = dict(rows)
    by = {}
    for r in out:
        t = (text.get(r["doc_id"]) or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    homes = {}
    for r in out:
        homes.setdefault(text.get(r["doc_id"]) or "", set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


@pytest.mark.parametrize("stage", ["quality", "near_dedup", "decontaminate", "mix"])
def test_filters_on_awkward_tables(spark, sf, stage):
    """Null, empty and repeated rows next to real ones: no crash, the columns of documents, only rows that came in."""
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = real.unionByName(docs_of(spark, [(None, None), (None, ""), (1, None), (10**9, "x " * 30_000), (10**9, "x " * 30_000)])).withColumn("_mix_rate", F.lit("clash"))
    out = dict(pipeline.STAGES)[stage](spark, docs, sf)
    assert out.columns == docs.columns
    assert out.select("doc_id", "text").subtract(docs.select("doc_id", "text")).count() == 0


def test_run(spark, sf):
    """Every stage's decisions hold in the end: no toxic majority, no leak of a whole item, no two equal texts, gapless slots."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = pipeline.run(spark, sf).collect()
    ids = Counter(r["doc_id"] for r in out)
    texts = {i: docs[i] or "" for i in ids}
    assert 0 < len(ids) < len(docs)
    assert max(Counter(texts.values()).values()) == 1
    assert not [i for i, t in texts.items() if any(x in t for x in items)]
    good = [i for i, r in labels.items() if i in docs and r["quality"] == 1 and not r["toxic"]]
    bad = [i for i, r in labels.items() if i in docs and r["quality"] == 0]
    assert sum(i in ids for i in bad) <= 0.1 * len(bad) + 1
    assert sum(i in ids for i in good) >= 0.5 * len(good)  # copies and leaks among them go
    by = {}
    for r in out:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_registered_repeats(spark, sf):
    """op9 with its own parameters over a whole table, against a count of every 400-byte string."""
    import hashlib

    from kongrid.llm.queries import QUERIES

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = Counter(t[k : k + 400] for t in docs.values() for k in range(len(t) - 399))
    got = {r["doc_id"]: r for r in QUERIES["op9_prefix_free_parse"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
        assert len(r["spans"]) == runs and r["kept"] == kept.decode(errors="replace")
