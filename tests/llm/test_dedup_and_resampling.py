"""Exact dedup against a dictionary, whatever the number of counters; importance resampling against plain sums."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tests.llm.fixtures import documents, prose, texts
from vigilspark.llm import exact_dedup, importance
from vigilspark.llm.blocks import Block

FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def slow_decide(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        low = lambda x: (x is not None, x or 0)
        keep = max(ids, key=low)
        left = ids.copy()
        left.remove(keep)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(keep, keep, len(ids), True, digest)] + [(i, keep, len(ids), False, digest) for i in left]
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [1, 3, 4096])
def test_exact_dedup(spark, counters):
    r = random.Random(3)
    rows = [(i % 7, "often") for i in range(400)] + [(i, prose(r.randrange(300), 9)) for i in range(700)] + [(r.randrange(5), "few")] * 9
    rows += texts() + [(None, "often"), (None, None), (3, "Often"), (4, "often ")]
    r.shuffle(rows)
    got = exact_dedup.decide(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), counters=counters)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_decide(rows)


def test_exact_dedup_carries_columns(spark):
    docs = documents(spark).withColumnRenamed("lang", "kept")
    got = exact_dedup.decide(docs)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["keep_id", "group_size", "kept_", "text_sha256"]
    whole = exact_dedup.decide(docs, carry=docs.columns).where("kept_")
    assert sorted(x.text or "" for x in whole.collect()) == sorted({t or "" for _, t in texts()})
    assert exact_dedup.decide(docs.limit(0)).collect() == []


@pytest.mark.parametrize("counters", [1, 5, 40])
def test_misra_gries_bounds(counters):
    r = random.Random(counters)
    items = [b"a"] * 5000 + [b"b"] * 2500 + [b"%d" % r.randrange(900) for _ in range(90_000)]
    r.shuffle(items)
    counts, found = Counter(items), {}
    batches = (pa.RecordBatch.from_arrays([pa.array(items[i:i + 7000], pa.binary())], names=["digest"]) for i in range(0, len(items), 7000))
    for batch in exact_dedup.misra_gries(batches, counters):
        found |= dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    assert all(n <= counts[x] for x, n in found.items()) and len(found) <= counters
    assert all(found.get(x, 0) >= n - 2 * len(items) / (counters + 1) for x, n in counts.items())


def test_frequent_digests_are_few_and_complete(spark):
    rows = [(bytes([i % 3]) * 32 if i % 2 else b"%32d" % i,) for i in range(4000)]
    digests = spark.createDataFrame(rows, "digest binary").repartition(6)
    found = {bytes(x[0]) for x in exact_dedup.frequent_digests(digests, 20).collect()}
    assert {bytes([k]) * 32 for k in range(3)} <= found and len(found) <= 21


# Importance resampling


def slow_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return words, words + [a + " " + b for a, b in zip(words, words[1:])]


LONG = [
    "Hello World, fööbar", None, "", "a" * 5000 + " b", "x y", "ab", "cd", "a" * 63 + " b " + "c" * 64 + " " + "d" * 65, "zz", "...", "1+1=2",
    "b" * 4095 + " " + "é" * 4096 + " " + "c" * 70_001, "\x7f~x", "Straße ÄÖÜ 漢字 🙂",
]


def test_features_of_any_length():
    for some in (LONG, LONG[::-1], ["ab", "cd", "", "e"], [None], [""], ["word"]):
        n_words, doc, crc = importance.features(Block.of(pa.array(some, pa.string())))
        for i, text in enumerate(some):
            words, features = slow_features(text)
            assert n_words[i] == len(words)
            assert Counter(crc[doc == i].tolist()) == Counter(zlib.crc32(f.encode()) for f in features)


def test_span_crcs():
    data = bytes(random.Random(1).randrange(256) for _ in range(9000))
    spans = [(0, 1), (5, 69), (5, 70), (3, 200), (0, 9000), (8999, 9000), (100, 4300)]
    import numpy as np

    got = importance.span_crcs(np.frombuffer(data, np.uint8), *(np.array(x) for x in zip(*spans)))
    assert got.tolist() == [zlib.crc32(data[i:j]) for i, j in spans]


def slow_resample(rows, target, percent=25, min_words=20, buckets=10_000):
    known = [(d, *slow_features(t)) for d, t in rows]
    hashed = [[zlib.crc32(f.encode()) % buckets for f in features] for _, _, features in known]
    s = Counter(b for h in hashed for b in h)
    t = Counter(zlib.crc32(f.encode()) % buckets for x in target for f in slow_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for (doc_id, words, features), h in zip(known, hashed):
        weight = sum(map(gain, h)) // len(h) if h else 0
        u = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None])
    fit = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    for place, x in enumerate(fit[:percent * len(fit) // 100]):
        x[5] = place + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_resample(spark, percent):
    rows = texts() + [(100 + i, prose(i % 60, 5 + i % 40)) for i in range(300)] + [(50, prose(77, 30))] * 20 + [(-i, t) for i, t in enumerate(LONG)]
    target = [prose(i, 30) for i in range(5)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_resample(rows, target, percent)


def test_resample_carries_columns_and_empty_tables(spark):
    docs = documents(spark).withColumnRenamed("lang", "rank")
    target = spark.createDataFrame([("river stone",)], "text string")
    got = importance.resample(docs, target)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["n_words", "n_features", "weight", "score", "rank_"]
    assert importance.resample(docs.limit(0), target).collect() == []
    alone = importance.resample(docs.select("doc_id", "text"), target.limit(0))
    assert sorted(map(tuple, alone.collect()), key=repr) == slow_resample(texts(), [])


def test_query_on_given_tables(spark):
    from tests.conftest import SF

    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [x[0] for x in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = sorted(map(tuple, importance.op13_importance_resampling(spark, SF).collect()), key=repr)
    assert got == sorted(((d, *x) for d, _, *x in slow_resample(rows, target)), key=repr)
