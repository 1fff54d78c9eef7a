"""Language ID, quality classifier and toxicity."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import langid, quality, toxicity
from graphloom.llm.common import table

from llm_data import COMMON, ODD, WORDS, documents, prose

SF = "/root/testdata/sf0.01"


def out_of_place(text, lists, size):
    keys, counts = langid.grams(text)
    top = [k for _, k in sorted(zip((-counts).tolist(), keys.tolist()))][:size]
    return {lang: sum(abs(x.index(k) - i) if k in x else size for i, k in enumerate(top)) for lang, x in lists.items()}


def test_out_of_place_against_brute_force():
    lists = {}
    for lang, text in (("one", prose(1, 300)), ("two", "der die das und schoene gruesse " * 20), ("six", "la rue est très belle et la mer " * 20)):
        keys, counts = langid.grams(text)
        lists[lang] = langid.ranked(keys, counts, 50).tolist()
    model = langid.Profiles.of(lists, 50)
    for text in (prose(2, 30), "und das", "la belle", "zzz", "ÄÖ ü", "a" * 1000):
        far = out_of_place(text, lists, 50)
        assert model.predict(text)[0] == min(sorted(far), key=far.get)
    assert model.predict(None) == model.predict("12 ,.") == ("und", 0.0)


def test_grams():
    pack = lambda s: sum(ord(c) << 21 * i for i, c in enumerate(s))
    keys, counts = langid.grams("Ab, b")
    assert dict(zip(keys.tolist(), counts.tolist())) == {pack(s): n for s, n in {"a": 1, "b": 2, " a": 1, "ab": 1, "b ": 2, " b": 1, " ab": 1, "ab ": 1, "b b": 1, " b ": 1}.items()}


def test_langid_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.where(~held))
    rows = langid.identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def test_langid_odd(spark):
    df = documents(spark, ODD, langs=[None, "en", "xx", "en", "fr", "tr", "en", None, "en", "en", "de"])
    model = langid.train(df)
    rows = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert {i for i, r in rows.items() if r["lang_pred"] == "und"} == {0, 1, 2, 4}
    assert rows[9]["lang_pred"] == rows[10]["lang_pred"]
    assert langid.identify(df, langid.train(df.where("lang is null"))).where("lang_pred != 'und'").count() == 0
    assert langid.identify(df.limit(0), model).count() == 0


def good_and_bad(n):
    rng = random.Random(7)
    texts, labels = [], []
    for i in range(n):
        bad = i % 5 == 4
        t = prose(i, rng.randrange(3, 120))
        texts.append(" ".join(w + "###" for w in t.split()) if bad else t)
        labels.append((i, 0 if bad else 1, 0))
    return texts, labels


def test_quality_sample(spark):
    texts, labels = good_and_bad(300)
    df = documents(spark, texts)
    marks = spark.createDataFrame(labels[::2] + [(None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.resample(df, marks).collect()}
    k = math.ceil(300 * quality.upper_share(120, 150))
    assert sum(r["kept"] for r in rows.values()) == k
    assert len([i for i in rows if i % 5 != 4 and not rows[i]["kept"]]) <= 3  # good ones stay
    again = quality.keep_good(df, marks)
    assert again.columns == df.columns and {r["doc_id"] for r in again.collect()} == {i for i, r in rows.items() if r["kept"]}
    twice = quality.resample(df.union(df), marks).groupBy("doc_id").agg(F.count_distinct("kept").alias("n"), F.count("*").alias("rows")).collect()
    assert {(r["n"], r["rows"]) for r in twice} == {(1, 2)}


def test_quality_weights_and_sample_against_brute_force(spark):
    from graphloom.llm.shingles import Shingler

    texts, labels = good_and_bad(120)
    df, marks = documents(spark, texts), spark.createDataFrame(labels[:60], "doc_id long, quality int, toxic int")
    model, keyed = quality.fit(df, marks)
    s = Shingler(1)
    found = [quality.features(s, t) for t in texts]
    count = lambda some: np.bincount(np.concatenate(some), minlength=quality.BUCKETS) + 1.0
    raw, target = count(found), count([f for f, (_, q, _) in zip(found, labels[:60]) if q])
    rows = {r["doc_id"]: r for r in keyed.collect()}
    for i, f in enumerate(found):
        assert abs(rows[i]["log_weight"] - sum(math.log(target[x] / target.sum()) - math.log(raw[x] / raw.sum()) for x in f)) < 1e-6
    best = sorted((r["key"] for r in rows.values()), reverse=True)[: model.k]
    assert {i for i, r in rows.items() if r["key"] >= best[-1]} == {r["doc_id"] for r in quality.resample(df, marks).where("kept").collect()}


def test_gumbel_top_k_draws_by_weight(spark):
    """Inclusion rates of a draw without replacement are 1 - exp(-t * weight), t such that k are drawn."""
    n, weights = 20_000, (0.25, 1.0, 2.0, 6.0)
    model = quality.Model(np.zeros(1))
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, weights)), (F.col("id") % 4 + 1).cast("int")).alias("w"))
    keyed = df.withColumn("log_weight", F.log("w")).withColumn("key", model.key())
    model.k = n // 4
    model.least = quality._kth_largest(keyed, "key", model.k)
    rate = {r["w"]: r["rate"] for r in keyed.withColumn("n_features", F.lit(1)).groupBy("w").agg(F.avg(model.kept(F.col("key")).cast("int")).alias("rate")).collect()}
    lo, hi = 0.0, 10.0
    for _ in range(60):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if np.mean([1 - math.exp(-t * w) for w in weights]) < 0.25 else (lo, t)
    for w in weights:
        assert abs(rate[w] - (1 - math.exp(-t * w))) < 0.03, (w, rate)
    assert 0 < rate[0.25] and rate[6.0] < 1  # no threshold of the weight


def test_quality_counts_against_brute_force(spark):
    from graphloom.llm.shingles import Shingler

    texts = [*ODD, prose(1), prose(2)]
    df = documents(spark, texts).select("text", (F.col("doc_id") % 2 == 0).alias("target"))
    raw, target = quality.count_models(df.repartition(5))
    s = Shingler(1)
    found = [np.bincount(quality.features(s, t), minlength=quality.BUCKETS) for t in texts]
    assert (raw == sum(found)).all() and (target == sum(found[::2])).all()


def test_quality_odd(spark):
    marks = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r["kept"] for r in quality.resample(documents(spark, ODD), marks).collect()}
    assert {i for i, k in rows.items() if not k} == {0, 1, 2, 4}  # one label alone rejects only what has no words
    assert quality.resample(documents(spark, ODD).limit(0), marks.limit(0)).count() == 0


def test_kth_largest(spark):
    rng = random.Random(9)
    values = [rng.randrange(-(1 << 50), 1 << 50) for _ in range(500)] + [7] * 20 + [-1, 0, 1]
    df = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 2, 100, 260, len(values)):
        assert quality._kth_largest(df, "key", k) == sorted(values, reverse=True)[k - 1]
    assert quality._kth_largest(df, "key", 0) is None


def test_upper_share():
    assert quality.upper_share(0, 0) == 1.0 and quality.upper_share(10, 10) == 1.0
    assert 0.5 < quality.upper_share(50, 100) < 0.66 and quality.upper_share(5000, 10_000) < 0.52


def brute_index(texts, labels):
    """Vectors and neighbours by plain dictionaries: words, idf, log-likelihood weights, cosine."""
    bags = [Counter(re.findall(r"\w+", t.lower())) for t in texts]
    full = [i for i, b in enumerate(bags) if b]
    df, toxic = Counter(w for i in full for w in bags[i]), Counter(w for i in full if labels[i] for w in bags[i])
    n, bad = len(full), sum(labels[i] for i in full)

    def telling(w):
        g = 0.0
        for seen, of in ((toxic[w], bad), (df[w] - toxic[w], n - bad)):
            for k, p in ((seen, df[w] / n), (of - seen, 1 - df[w] / n)):
                g += k * math.log(k / (of * p)) if k > 0 else 0.0
        excess = max(2 * g - toxicity.CHANCE, 0)
        return toxicity.FLOOR + excess / (excess + toxicity.HALF)

    def vector(text):
        v = {w: (1 + math.log(c)) * (math.log((n + 1) / (df[w] + 1)) + 1) * telling(w) for w, c in Counter(re.findall(r"\w+", text.lower())).items() if df[w]}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(texts[i]) for i in full}
    return vector, lambda v, without=None: sorted(((sum(x * u.get(w, 0.0) for w, x in v.items()), i) for i, u in vectors.items() if i != without), reverse=True), full


def test_index_vote_and_calibration_against_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rng = random.Random(11)
    texts = [" ".join(rng.choices(WORDS[:12] + COMMON, k=rng.randrange(0, 9)) + (["vile"] if i % 6 == 0 else [])) + f" only{i}" * (i % 7 != 0) for i in range(220)]
    labels = [int(i % 6 == 0 and i % 5 != 0) for i in range(220)]
    index = toxicity.Index.build(texts, list(range(220)), labels)
    vector, near, full = brute_index(texts, labels)
    assert sorted(index.ids) == full  # every example with a word is in the index
    votes = []
    for i, (own, similarity) in zip(full, index.nearest([index.unit(*toxicity.words(texts[i])) for i in full], without=full)):
        expected = [s for s, _ in near(vector(texts[i]), i) if s > 1e-9][: toxicity.K]
        assert np.allclose(similarity, expected, atol=1e-5)
        cosine = dict((j, s) for s, j in near(vector(texts[i]), i))
        assert all(abs(cosine[int(index.ids[k])] - s) < 1e-5 for k, s in zip(own, similarity))
        y = np.array([labels[index.ids[k]] for k in own])
        rate = sum(labels[j] for j in full) / len(full)
        vote = ((similarity * y).sum() + toxicity.SHRINK * rate) / (similarity.sum() + toxicity.SHRINK)
        assert abs(index.vote(own, similarity) - vote) < 1e-9
        votes.append(vote)
    x, score = index.calibrated(np.array(votes), np.array([labels[i] for i in full], float))
    assert (np.diff(x) >= 0).all() and (np.diff(score) >= 0).all() and 0 <= score.min() and score.max() <= 1
    fitted = np.interp(votes, x, score)
    assert abs(fitted.mean() - np.mean([labels[i] for i in full])) < 0.05  # isotonic means keep the rate
    queries = ["vile", "maple the of", "VILE, river", "only3", "nothing known"]
    for q, (value, evidence) in zip(queries, index.score(queries, (x, score))):
        assert bool(evidence) == bool(vector(q)) and 0 <= value <= 1


def test_blocks_are_skipped(monkeypatch):
    """A query whose heaviest term few blocks have reads only these."""
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    texts = [f"word{i % 20} text{i}" for i in range(800)]
    index = toxicity.Index.build(texts, list(range(800)), [int(i % 20 == 3) for i in range(800)])
    read = []
    original = toxicity._ranges
    monkeypatch.setattr(toxicity, "_ranges", lambda lo, hi: read.append(int((hi - lo).sum())) or original(lo, hi))
    near, _ = index.nearest([index.unit(*toxicity.words("word3 text5"))])[0]
    assert near.size == toxicity.K and max(read) < 400


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    index = toxicity.fit(docs, labels.where(~held))
    rows = toxicity.score(docs, index).join(labels, "doc_id").collect()
    out = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = np.mean([r["predicted"] == r["toxic"] for r in out])
    assert right > 0.9 and all(0 <= r["score"] <= 1 for r in rows)
    english = [r for r in rows if r["toxic"] and r["predicted"]]
    assert english and all(e["toxic"] in (0, 1) and 0 < e["similarity"] <= 1 + 1e-9 for r in english for e in r["evidence"])


def test_toxicity_odd(spark):
    bad = [prose(i, 30) + " vile nasty" for i in range(12)]
    texts = [*ODD, *bad, *(prose(100 + i, 30) for i in range(40)), "so vile and nasty " + prose(500, 400)]
    toxic = range(len(ODD), len(ODD) + 12)
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(len(texts) - 1)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(documents(spark, texts), labels)
    rows = {r["doc_id"]: r for r in toxicity.score(documents(spark, texts), index).collect()}
    assert [i for i, r in rows.items() if r["predicted"]] == [*toxic, len(texts) - 1]
    assert rows[0]["score"] == rows[1]["score"] < 0.3 and len(rows) == len(texts)
    assert rows[9]["score"] == rows[10]["score"] and toxicity.score(documents(spark, texts).limit(0), index).count() == 0
    assert all(r["evidence"] for i, r in rows.items() if i > len(ODD))
    twice = toxicity.score(documents(spark, texts).union(documents(spark, texts)), index).groupBy("doc_id").agg(F.count_distinct("score").alias("n")).collect()
    assert {r["n"] for r in twice} == {1}
    nothing = toxicity.fit(documents(spark, texts), labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(documents(spark, texts), nothing).collect()} == {0}
