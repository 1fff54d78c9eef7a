"""Language identification by rank-order profiles of character n-grams.

A profile lists the PROFILE most frequent n-grams (1 to 3 characters) of a language by rank. A document's own
most frequent n-grams are compared to each profile by out-of-place distance: the sum of rank differences, with
PROFILE for an n-gram that the profile lacks. Words are runs of letters, lower-cased; one space stands for all
else between and around them, so n-grams know word borders.

Profiles are counted on about TRAIN_DOCS documents a language, chosen by hash of the id. A model has at most
MAX_LANGUAGES * PROFILE entries and travels with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import map_columns, unit_hash

PROFILE, TRAIN_DOCS, MAX_LANGUAGES = 400, 6000, 1000
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str | None) -> np.ndarray:
    """Letters as code points with single zeros-turned-spaces between words; empty without a letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    if not letter.any():
        return raw[:0]
    padded = np.full(raw.size + 2, 32, np.uint64)
    padded[1:-1] = np.where(letter, raw, 32)
    keep = np.ones(padded.size, bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    return padded[keep]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed 21 bits a character, and their counts."""
    c = _codes(text)
    if not c.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    two = c[:-1] | (c[1:] << np.uint64(21))
    three = two[:-1] | (c[2:] << np.uint64(42))
    return np.unique(np.concatenate([c[c != 32], two, three]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The `n` most frequent keys in order of rank; ties go by key."""
    if counts.size > n:  # only what can be among the first n is sorted
        least = np.partition(counts, counts.size - n)[counts.size - n]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:n]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    keys: np.ndarray  # sorted distinct n-grams of all profiles
    ranks: np.ndarray  # language x key, PROFILE where absent
    size: int

    @classmethod
    def of(cls, lists: dict[str, list[int]], size: int) -> Profiles:
        languages = sorted(lists)
        keys = np.unique(np.array([k for x in lists.values() for k in x], np.uint64))
        ranks = np.full((len(languages), keys.size), size, np.int64)
        for i, lang in enumerate(languages):
            own = np.array(lists[lang], np.uint64)
            ranks[i, np.searchsorted(keys, own)] = np.arange(own.size)
        return cls(languages, keys, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest profile and a score in 0..1: the runner-up's share of both distances."""
        keys, counts = grams(text)
        if not keys.size or not self.languages:
            return UNDETERMINED, 0.0
        top = ranked(keys, counts, self.size)
        at = np.minimum(np.searchsorted(self.keys, top), self.keys.size - 1)
        known = self.keys[at] == top
        place = np.arange(top.size)
        far = np.abs(self.ranks[:, at] - place)
        far = np.where(known & (self.ranks[:, at] < self.size), far, self.size).sum(axis=1)
        order = np.argsort(far, kind="stable")
        if order.size == 1:
            return self.languages[0], float(1 - far[0] / (self.size * top.size))
        best, second = float(far[order[0]]), float(far[order[1]])
        return self.languages[order[0]], second / (best + second) if second else 0.5


def train(docs: DataFrame, size: int = PROFILE, train_docs: int = TRAIN_DOCS) -> Profiles:
    """Profiles of the languages of `docs` (doc_id, text, lang); rows with a null lang teach nothing.

    About `train_docs` documents of each language are read, those of least hashed id.
    """
    known = docs.where("lang is not null").select("doc_id", "text", "lang")
    rates = known.groupBy("lang").agg((F.lit(float(train_docs)) / F.count("*")).alias("rate")).collect()
    if len(rates) > MAX_LANGUAGES:
        raise ValueError(f"{len(rates)} languages; a model holds {MAX_LANGUAGES}")
    if not rates:
        return Profiles.of({}, size)
    rate = F.create_map(*[x for r in rates for x in (F.lit(r["lang"]), F.lit(r["rate"]))])[F.col("lang")]
    few = known.where(unit_hash("doc_id", seed=5) < rate).select("text", "lang")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            by_lang: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(grams(text))
            for lang, found in by_lang.items():
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in found]), keys.size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * keys.size, pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = few.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    lists: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles.of(lists, size)


def identify(docs: DataFrame, model: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; `und` and 0 for a text that is null or holds no letter.

    Ties of distance go to the language first by name. With one learned language, the score is its nearness.
    """

    def compute(cols: dict[str, list]) -> dict[str, list]:
        found = [model.predict(t) for t in cols["text"]]
        return {"lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), compute, "lang_pred string, score double", ("doc_id",))
