import hashlib
import re

from pyspark.sql import functions as F

from graphloom.llm import spotsigs

from llm_data import ODD, documents, prose


def test_edited_texts_and_likeness(spark):
    texts = [*ODD, *(prose(i, 80) for i in range(20)), prose(3, 80)]
    df = documents(spark, texts)
    rows = {r["doc_id"]: r for r in spotsigs.edited_pairs(df).collect()}
    flat = {r["doc_id"]: r for r in spotsigs.digest(spotsigs.edited_pairs(df)).collect()}
    full = [t or "" for t in texts]
    for i, t in enumerate(full):
        after = full[(i + 1) % len(full)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = set(r["signatures"]), set(r["edited_signatures"])
        c = set(rows[(i + 1) % len(full)]["signatures"])
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        cut = lambda x, y: like(x, y) if min(len(x), len(y)) >= spotsigs.LEAST * max(len(x), len(y)) else 0.0
        assert abs(r["near_edited"] - cut(a, b)) < 1e-12 and abs(r["near_next"] - cut(a, c)) < 1e-12
    assert flat[3 + len(ODD)]["fingerprint"] == flat[len(texts) - 1]["fingerprint"] and flat[9]["fingerprint"] == flat[10]["fingerprint"]
    long = range(len(ODD), len(ODD) + 19)
    assert all(rows[i]["near_edited"] > 0.15 > rows[i]["near_next"] for i in long)


def brute_signatures(text, chain=spotsigs.CHAIN):
    ws = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    common = set(spotsigs.ANCHORS)
    behind = lambda i, anchor: [anchor, *[w for w in ws[i + 1 :] if w not in common][:chain]]
    found = {" ".join(x) for i, w in enumerate(ws) if w in common and len(x := behind(i, w)) == chain + 1}
    if not found:
        content = [w for w in ws if w not in common]
        starts = [("^", content[:chain])] + [(w, content[i + 1 : i + 1 + chain]) for i, w in enumerate(content) if hashlib.md5(w.encode()).hexdigest() < "2"]
        found = {" ".join([a, *c]) for a, c in starts if len(c) == chain}
    return found or ({" ".join(["^^", *ws])} if ws else set())


def test_signatures_against_brute_force(spark):
    far = "the " + "of and to " * 30 + "cedar " + "in is it " * 30 + "maple"
    texts = ["the river of stone and the cedar", far, "one", "the the the", "zebra quagga okapi " * 40, "the zebra", *ODD[1:], *(prose(i, 80) for i in range(30)), "das ist ein Haus und der Garten", prose(1, 9000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in df.select("i", spotsigs.signatures(df["text"]).alias("s")).collect():
        assert r["s"] == sorted(brute_signatures(texts[r["i"]])), texts[r["i"]][:60]
    assert brute_signatures(far) >= {"the cedar maple", "of cedar maple"}  # however far off


def test_length_partitions_prune(spark):
    sets = [[f"s{i:03d}" for i in range(n)] for n in (1, 9, 10, 11, 99, 100, 101, 999, 1000)]
    df = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<string>, b array<string>")
    for r in df.select(F.size("a").alias("n"), F.size("b").alias("m"), spotsigs.likeness(F.col("a"), F.col("b"), 0.1).alias("x")).collect():
        lo, hi = sorted((r["n"], r["m"]))
        assert abs(r["x"] - (lo / hi if lo >= 0.1 * hi else 0.0)) < 1e-12


def test_following_in_short_runs(spark):
    ids = [5, -3, 900, 17, 18, 19, 2**40, 44, 45, 46, 47, 48]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    rows = {r["doc_id"]: r["next_text"] for r in spotsigs.following(df, {"text": F.col("text")}, run_rows=2).collect()}
    order = sorted(ids)
    assert rows == {x: f"t{order[(k + 1) % len(order)]}" for k, x in enumerate(order)}
    assert [r["next_text"] for r in spotsigs.following(df.where("doc_id = 5"), {"text": F.col("text")}).collect()] == ["t5"]
    assert spotsigs.following(df.limit(0), {"text": F.col("text")}).count() == 0
    twice = df.union(df)
    assert spotsigs.following(twice, {"text": F.col("text")}, run_rows=3).count() == 2 * len(ids)


def test_following_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(i, f"t{i}", 7, "p", True, "h") for i in range(5)], "doc_id long, text string, run int, place string, at boolean, head string")
    out = spotsigs.following(df, {"text": F.col("text")}, run_rows=2)
    assert set(out.columns) == {*df.columns, "next_text"}
    assert {(r["doc_id"], r["run"], r["place"], r["at"], r["head"]) for r in out.collect()} == {(i, 7, "p", True, "h") for i in range(5)}
    assert spotsigs.edited_pairs(df.limit(0)).count() == 0


def test_near_pairs_against_brute_force(spark):
    texts = [prose(i, 50) for i in range(12)]
    texts += [texts[0], texts[1] + " extra", texts[2].replace("alder", "elm"), texts[3] + " the river stone", None, ""]
    df = documents(spark, texts)
    links, members = spotsigs.near_pairs(df, 0.6)
    sets = [set(r[0]) for r in df.orderBy("doc_id").select(spotsigs.signatures(df["text"])).collect()]
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    assert rep == {i: min(j for j in range(len(texts)) if sets[j] == s) for i, s in enumerate(sets) if s}
    expected = {(a, b) for a in set(rep.values()) for b in set(rep.values()) if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in links.collect()} == expected and expected
