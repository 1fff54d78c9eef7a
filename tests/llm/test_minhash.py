import random
import re

import numpy as np
import pytest

from graphloom.llm import minhash
from graphloom.llm.components import connected_components
from graphloom.llm.shingles import Shingler, overlap

from llm_data import ODD, documents, prose


def brute_sets(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def brute(texts):
    sets = [brute_sets(t) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    return [(len(s), c) for s, c in zip(sets, comp)]


def edited(text, rng, k):
    words = text.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(4)
    texts = list(ODD)
    for i in range(8):
        base = prose(i, 120)
        texts += [base, base.upper(), *(edited(base, rng, rng.randrange(1, 6)) for _ in range(8))]
    hub = prose(99, 200)  # copies whose links to each other lie on both sides of the threshold
    texts += [edited(hub, rng, k % 9) for k in range(60)]
    texts += [prose(200 + i, 40) + " shared boilerplate passage that many documents hold in the very same words " + prose(300 + i, 10) for i in range(10)]
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    for i, (n, c) in enumerate(brute(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c), texts[i][:80]


def test_small_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    texts = corpus()
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute(texts)]


def test_null_repeated_and_empty(spark):
    df = documents(spark, ["a b c d e f", "a b c d e f"]).select("doc_id", "text")
    more = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (7, None)], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(df.union(more)).collect())
    assert rows == [("0", 0, True), ("1", 0, False), ("1", 0, False), ("7", 7, True), ("None", None, True)]
    kept = minhash.keep_one(df.union(more)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["0", "7", "None"]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(df, percent=50)


def test_one_id_with_several_texts(spark):
    t, u, v = ("a b c d e f", "u v w x y z", "u v w x y Z")
    df = spark.createDataFrame([(1, t), (5, u), (5, t), (5, v), (5, u), (6, None), (6, ""), (6, None)], "doc_id long, text string")
    kept = sorted((r["doc_id"], str(r["text"]).lower()) for r in minhash.keep_one(df).collect())
    assert kept == [(1, t), (5, u), (6, ""), (6, "none")]


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        new = dict(comp)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == comp:
            break
        comp = new
    expected = {x: c for x, c in comp.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert got == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles():
    s = Shingler()
    assert (s.distinct("A b c d e f") == s.distinct("a\tB  c\nd e f")).all()
    assert s.distinct("ab c").size == 1 and s.distinct("a bc").tolist() != s.distinct("ab c").tolist()
    assert overlap(s.distinct("a b c d e f g"), s.distinct("x a b c d e f g")) == 3
    assert s.distinct("É b").tolist() != s.distinct("é b").tolist()  # only A-Z are lower-cased


def _linked(sets, components):
    """Pairs that one group of the hidden-link pass reports for 64-bit sets."""
    import pyarrow as pa

    n = len(sets)
    columns = {
        "key": pa.array([1] * n, pa.int64()),
        "i": pa.array([0] * n, pa.int32()),
        "j": pa.array([0] * n, pa.int32()),
        "own": pa.array([0] * n, pa.int32()),
        "band": pa.array([0] * n, pa.int32()),
        "set_key": pa.array([f"s{k}" for k in range(n)]),
        "component": pa.array(components),
        "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
        "bands": pa.array([list(range(minhash.BANDS))] * n, pa.list_(pa.int64())),
        "signature": pa.array([b"x" * minhash.HASHES] * n, pa.binary()),
        "items": pa.array([np.unique(np.array(x, np.uint64).astype(np.uint32)).tobytes() for x in sets], pa.binary()),
    }
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return {(r["a"], r["b"]) for out in minhash._compare(75)([batch]) for r in out.to_pylist()}


def test_hashes_cut_to_32_bits():
    # 858 of 1142 is just 75 %; four common members collide with others when cut
    common = [*range(1, 855), *(k + (1 << 32) for k in range(1, 5))]
    a, b = common + list(range(2000, 2142)), common + list(range(3000, 3142))
    assert _linked([a, b], ["p", "q"]) == {("s0", "s1")}
    # s0 and s1 have 857 members in common and one more by chance: they must not hide the link of s2 and s3
    common = list(range(1, 858))
    a, b = common + list(range(2000, 2143)), common + [2000 + (1 << 32), *range(3000, 3142)]
    c, d = list(range(5000, 6000)), list(range(5001, 6001))
    assert _linked([a, b, c, d], ["p", "q", "p", "q"]) >= {("s2", "s3")}
    assert [minhash.by_chance(x) for x in (0, 1e-7, 1e-4, 0.01)] == [0, 0, 1, 2] and 100 < minhash.by_chance(100) < 400
