"""Small tables for the training-data operators."""

import random

WORDS = "alder birch cedar maple olive spruce walnut willow river stone meadow valley harbor winter summer autumn candle copper silver garden".split()
COMMON = "the of and to in is it that".split()


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(WORDS) + str(rng.randrange(40)))
    return " ".join(out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None, sources=None, extra=True):
    """A documents table; `extra` adds columns whose names operators use themselves."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t) if t is not None else None, "x", 1.5, True))
    df = spark.createDataFrame(rows, DOCS + ", component_id string, score double, kept boolean")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


ODD = [None, "", " ", "a", "\n\t", "ünï çødé ✓ 🙂", "x" * 5000, "word " * 3000, "the the the", "a", "a"]
