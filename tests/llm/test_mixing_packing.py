import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing, packing

from llm_data import ODD, documents, prose


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize(("bins", "plan_rows"), [(4096, 20_000), (3, 1)])
def test_mix_against_brute_force(spark, monkeypatch, bins, plan_rows):
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "PLAN_ROWS", plan_rows)
    rng = random.Random(2)
    texts = ODD + [prose(i, rng.randrange(1, 80)) for i in range(150)]
    sources = [rng.choice(["a", "a", "a", "b", "ß", "z", None, "c", "tiny"]) if i < 160 else "solo" for i in range(len(texts))]
    df = documents(spark, texts, sources=sources)
    quality = spark.createDataFrame([(i, [0.5, 2.0, None, -1.0][i % 4]) for i in range(100)], "doc_id long, weight double")
    rows = mixing.mix(df, quality).collect()
    sizes, by = {}, {}
    for r in rows:
        n = len((texts[r["doc_id"]] or "").split())
        assert r["size"] == n and r["source"] == sources[r["doc_id"]] and 0 <= r["taken"] <= 2 * n
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        by.setdefault(r["source"], []).append(r)
    targets = brute_targets(sizes)
    for s, rs in by.items():
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) < 1e-6 for r in rs)
        assert abs(sum(r["taken"] for r in rs) - targets[s]) <= max(r["size"] for r in rs)
        copies = {r["copies"] for r in rs}
        assert max(copies) - min(copies) <= 1  # complete epochs come first
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df, quality).collect()))


def test_quality_weights_matter(spark):
    df = documents(spark, ["w " * 10] * 400, sources=["a"] * 200 + ["b"] * 200)
    quality = spark.createDataFrame([(i, 8.0 if i % 2 else 0.25) for i in range(400)], "doc_id long, weight double")
    rows = mixing.mix(df, quality, share=0.5, weights=(1.0,)).collect()
    good = sum(r["copies"] for r in rows if r["doc_id"] % 2)
    assert good > 0.85 * sum(r["copies"] for r in rows)


def test_mix_odd_tables(spark):
    assert mixing.mix(documents(spark, ["a"]).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(documents(spark, [None, ""])).collect()] == [0, 0]
    twice = documents(spark, ["a b", "c"]).unionByName(documents(spark, ["a b", "c"]))
    assert mixing.mix(twice).count() == 4
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in mixing.label_weights(labels).collect()} == {(1, 0.5), (2, None)}
    df = documents(spark, [prose(i, 30) for i in range(30)], sources=["a"] * 3 + ["b"] * 27)
    repeated = mixing.repeat_mixed(df)
    assert repeated.columns == df.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in repeated.groupBy("doc_id").count().collect()} == copies


def brute_padding(lengths, k):
    values = sorted(set(lengths))
    best = None
    for cut in itertools.combinations(values[:-1], min(k, len(values)) - 1):
        bounds = [*cut, values[-1]]
        cost = sum(min(b for b in bounds if b >= x) - x for x in lengths)
        best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 25))]
        values, counts = np.unique(lengths, return_counts=True)
        for k in (1, 2, 3, 4):
            bounds = packing.optimal_boundaries(values, counts, k)
            assert len(bounds) <= k and sum(min(b for b in bounds if b >= x) - x for x in lengths) == brute_padding(lengths, k)
    assert packing.optimal_boundaries(np.array([]), np.array([]), 3) == []


def test_pack_whole(spark):
    rng = random.Random(5)
    lengths = [0, None, 1, 300, 301, 5000] + [rng.randrange(1, 400) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long").withColumn("bucket", F.lit("clash"))
    rows = packing.pack(df, max_len=128, buckets=5, budget=1000, shard_rows=20).collect()
    by_doc, batches = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        if r["length"]:
            assert r["length"] <= r["bucket_len"] <= 128
            batches.setdefault((r["bucket"], r["bucket_len"]), {}).setdefault(r["batch"], []).append(r)
        else:
            assert (r["bucket"], r["batch"]) == (None, None)
    for i, n in enumerate(lengths):
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert sum(p["length"] for p in pieces) == (n or 0) and [p["start"] for p in pieces] == [128 * k for k in range(len(pieces))]
    values, counts = np.unique([r["length"] for r in rows if r["length"]], return_counts=True)
    assert sorted(b for _, b in batches) == packing.optimal_boundaries(values, counts, 5)
    for (_, size), found in batches.items():
        room = 1000 // size
        assert sorted(found) == list(range(len(found)))
        assert all(len(x) == room for k, x in found.items() if k < len(found) - 1) and len(found[len(found) - 1]) <= room


def test_pack_odd_tables(spark):
    assert packing.pack_texts(documents(spark, ["a"]).limit(0)).count() == 0
    rows = packing.pack_texts(documents(spark, ODD)).collect()
    assert sum(r["length"] for r in rows) == sum(len((t or "").split()) for t in ODD)
    assert {r["length"] for r in packing.pack_texts(documents(spark, [None, ""])).collect()} == {0}
