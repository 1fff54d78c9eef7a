import hashlib
import random
import re
import time

from graphloom.llm import secrets

from llm_data import ODD, documents, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_base(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


HEX = hashlib.md5(b"1").hexdigest()
RANDOM = "xK9mQ2vLp8RtZ4wYb7Nc"
SECRETS = [
    f'token = "{HEX}" and more',
    "PassWord:abc secret=token:abcdef API_KEY='abcd1234'",  # the first match takes what a second one would need
    "ünï 🙂 passwd =  zzzzzz; AKIA" + "A1B2C3D4E5F6G7H8",
    "AKIASHORT and AKIA" + "AKIA" * 5,
    HEX + HEX + " x " + HEX[:23],
    "apikey: a.b-c_d/e+f=",
    f"key {RANDOM} here, then some_ordinary_name_of_42 and thisIsACamelCaseName12 follow",
    "secret: secret: abcdefg",
    "password=\nabcdefg token=abc",
]


def test_base_spans_against_brute_force(spark):
    texts = [*ODD, *SECRETS, *(prose(i) for i in range(20))]
    rows = {r["doc_id"]: r for r in secrets.digest(secrets.scan(documents(spark, texts))).collect()}
    for i, text in enumerate(texts):
        spans = brute_base(text or "")
        r = rows[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)], text
        base = [f"{k}:{a}:{b}" for a, _, k, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == base


def test_models_tell_random_strings_from_names(spark):
    docs = documents(spark, [prose(i, 200) for i in range(60)])
    model = secrets.train(secrets.random_samples(spark).union(secrets.identifier_samples(docs)))
    ratio = lambda t: sum(model[a + b] for a, b in zip(t, t[1:])) / (len(t) - 1)
    assert ratio(RANDOM) > secrets.MARGIN > ratio("some_ordinary_name_of_42")
    row = secrets.digest(secrets.scan(documents(spark, [prose(i, 200) for i in range(60)] + [SECRETS[6]]))).where("doc_id = 60").first()
    assert row["spans"] == f"random:4:{4 + len(RANDOM)}"


def test_random_spans_against_brute_force(spark):
    rng = random.Random(8)
    token = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    letters, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    texts = [*ODD, *SECRETS, token(letters, 24), f"é {token(letters + digits, 18)} 🙂 {token(letters, 30)}", "-" * 40, token(digits, 30), "ordinary_name_of_a_thing/and-another", f"token={token(letters, 20)} {token(letters, 15)}"]
    df = documents(spark, texts)
    samples = secrets.random_samples(spark).union(secrets.identifier_samples(documents(spark, [prose(i, 200) for i in range(40)])))
    model = secrets.train(samples)
    rows = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(df, samples)).collect()}
    for i, text in enumerate(texts):
        base = [(a, b) for a, _, _, b in brute_base(text or "")]
        expected = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text or ""):
            ratio = sum(model[a + b] for a, b in zip(m[0], m[0][1:])) / (len(m[0]) - 1)
            if re.search("[A-Za-z]", m[0]) and ratio > secrets.MARGIN and not any(a < m.end() and m.start() < b for a, b in base):
                expected.append(f"random:{m.start()}:{m.end()}")
        assert [s for s in rows[i].split(",") if s.startswith("random")] == expected, text
    assert rows[len(ODD) + len(SECRETS)].startswith("random:0:24")  # letters alone are judged
    assert secrets.digest(secrets.scan(df.union(df), samples)).distinct().count() == len(texts) and secrets.scan(df.limit(0), samples).count() == 0


def test_many_spans_in_one_text(spark):
    runs = [hashlib.md5(str(i).encode()).hexdigest() for i in range(100_000)]
    df = spark.createDataFrame([(1, " ".join(runs))], "doc_id long, text string")
    samples = secrets.random_samples(spark, 200).union(secrets.name_samples(spark, 200))
    began = time.time()
    row = secrets.digest(secrets.scan(df, samples)).first()
    spans = ",".join(f"hex:{33 * i}:{33 * i + 32}" for i in range(len(runs)))
    assert row["n_hex"] == len(runs) and row["spans"] == spans and row["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert secrets.redact(df, samples=samples).first()["text"] == " ".join(["[SECRET]"] * len(runs))
    assert time.time() - began < 120


def test_redact(spark):
    texts = [None, "clean text", SECRETS[0], f"a {HEX} b password={HEX}."]
    df = documents(spark, texts)
    out = secrets.redact(df)
    assert out.columns == df.columns and out.schema == df.schema
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [rows[i]["text"] for i in range(4)] == [None, "clean text", '[SECRET]" and more', "a [SECRET] b [SECRET]"]
    assert rows[2]["n_chars"] == len(rows[2]["text"]) and rows[0]["n_chars"] is None
    assert secrets.redact(df.limit(0)).count() == 0
