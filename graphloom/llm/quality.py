"""Quality classifier by importance resampling.

Words and word pairs are hashed into BUCKETS buckets. Two bag models over the buckets, one of target text
(documents labelled of good quality), one of the raw text (all documents), give each document the log of its
importance weight p_target / p_raw. Gumbel noise by hash of the id is added, and the k documents of greatest sum
are the sample: Gumbel top-k draws without replacement in proportion to the weights.

k is the number of documents with words times the share of good ones among the labelled rows, ERRORS standard
errors above the estimate: what the estimate leaves open goes in favour of keeping. The raw model counts all
documents; the target model and the share are taken from about SAMPLE labelled rows, chosen by hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_columns, materialize, unit_hash
from graphloom.llm.shingles import Shingler

BUCKETS, SAMPLE = 10_000, 20_000
#: Standard errors by which k is raised over the estimated number of good documents.
ERRORS = 3.0
#: Tasks among which the tasks' count vectors are summed before the driver sums theirs.
SLOTS = 64

_U = np.uint64


def features(shingler: Shingler, text: str | None) -> np.ndarray:
    """Bucket of each word and each pair of neighbours of a text."""
    w = shingler.words(text)
    if not w.size:
        return np.zeros(0, np.int64)
    pairs = (w[:-1] * _U(0x9E3779B97F4A7C15)) ^ w[1:]
    pairs = (pairs ^ (pairs >> _U(31))) * _U(0x94D049BB133111EB)
    return (np.concatenate([w, pairs]) >> _U(32)).astype(np.int64) * BUCKETS >> 32


def count_models(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all rows of `docs` (text, target boolean) and of its target rows.

    Each task adds its rows up; a vector of BUCKETS numbers a task and model leaves it. SLOTS tasks sum those,
    so the driver gets SLOTS vectors a model however many tasks there are.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler, total = Shingler(1), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(features(shingler, text), minlength=BUCKETS)
                total[0] += found
                if target:
                    total[1] += found
        slot = int(total.sum()) % SLOTS
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "counts"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, seen = np.zeros((2, BUCKETS), np.int64), False
        for batch in batches:
            for counts in batch.column(1).to_pylist():
                total += np.frombuffer(counts, np.int64).reshape(2, BUCKETS)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    parts = docs.select("text", "target").mapInArrow(count, "slot int, counts binary").repartition(SLOTS, "slot")
    rows = parts.mapInArrow(add, "counts binary").collect()
    total = np.zeros((2, BUCKETS), np.int64)
    for r in rows:
        total += np.frombuffer(bytes(r["counts"]), np.int64).reshape(2, BUCKETS)
    return total[0], total[1]


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket log p_target / p_raw, counts raised by one."""
    p = [np.log((c + 1) / (c.sum() + c.size)) for c in (target, raw)]
    return p[0] - p[1]


def upper_share(good: int, n: int, errors: float = ERRORS) -> float:
    """Upper bound of the share of which `good` of `n` is a sample (score interval); 1 without a sample."""
    if not n:
        return 1.0
    z, p = errors * errors, good / n
    return min(1.0, (p + z / (2 * n) + errors * np.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n))


def _kth_largest(keys: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest of a long column by radix histograms of at most 2**16 rows each."""
    if k <= 0:
        return None
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(F.col(key), shift)
        rows = keys if prefix is None else keys.where(F.shiftright(F.col(key), shift + 16) == prefix)
        for value, n in sorted(((r[0], r[1]) for r in rows.groupBy(digit.alias("d")).agg(F.count("*")).collect()), reverse=True):
            if left <= n:
                prefix = value
                break
            left -= n
        else:
            return None
    return prefix


@dataclass
class Model:
    """Log ratios of the buckets, k, and the k-th largest key (None: without labels of both values, all are kept)."""

    ratios: np.ndarray
    k: int = 0
    least: int | None = None
    seed: int = 6

    def score(self, docs: DataFrame, keep: tuple[str, ...], count: str = "n_features", total: str = "log_weight") -> DataFrame:
        """Columns `keep` with the number of features and the log of the importance weight (null without features)."""
        ratios = self.ratios

        def compute(cols: dict[str, list]) -> dict[str, list]:
            shingler = Shingler(1)
            found = [features(shingler, t) for t in cols["text"]]
            return {count: [f.size for f in found], total: [float(ratios[f].sum()) if f.size else None for f in found]}

        return map_columns(docs, compute, f"`{count}` long, `{total}` double", keep)

    def key(self, doc_id: str = "doc_id", total: str = "log_weight") -> Column:
        """Log weight with Gumbel noise, as a whole number of millionths."""
        gumbel = -F.log(-F.log(unit_hash(doc_id, seed=self.seed + 1)))
        return F.floor((F.col(total) + gumbel) * 1e6)

    def kept(self, key: Column, count: str = "n_features") -> Column:
        return F.coalesce(key >= F.lit(self.least), F.lit(False)) if self.least is not None else F.col(count) > 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 6) -> tuple[Model, DataFrame]:
    """Model of `docs` (doc_id, text) and `labels` (doc_id, quality 0/1), and the written table of its keys.

    The table has doc_id, n_features, log_weight, key for every row of `docs`. A document with several labels
    counts by the least.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality"))
    n = marked.count()
    # about `sample` rows of two numbers: safe to send to every task
    few = marked.where(unit_hash("label_id", seed=seed) < sample / max(n, 1))
    labelled = rows.join(F.broadcast(few), F.col("doc_id") == F.col("label_id"), "left").drop("label_id")
    model = Model(log_ratios(*count_models(labelled.select("text", (F.col("quality") == 1).alias("target")))), seed=seed)
    scored = materialize(model.score(labelled, ("doc_id", "quality")), "weights")
    keyed = scored.select("doc_id", "n_features", "log_weight", model.key().alias("key"))
    sampled = scored.where("quality is not null and n_features > 0").agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if 0 < sampled[1] < sampled[0]:
        valid = keyed.where("key is not null")
        model.k = int(np.ceil(valid.count() * upper_share(int(sampled[1]), int(sampled[0]))))
        model.least = _kth_largest(valid, "key", model.k)
    return model, keyed


def resample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 6) -> DataFrame:
    """(doc_id, n_features, log_weight, kept) for every row of `docs` (doc_id, text); other columns aren't read.

    log_weight is the sum of the n-grams' log p_target / p_raw; kept tells whether the Gumbel top-k took the row.
    Null texts and texts without words have no features, a null log_weight and are never kept. Without labels
    of both values there is nothing to prefer: every row with words is kept. Rows whose key equals the k-th
    are all kept, so repeated rows share their result. Null ids draw one noise. Empty tables give empty ones.
    Reruns give the same rows.
    """
    model, keyed = fit(docs, labels, sample, seed)
    return keyed.select("doc_id", "n_features", "log_weight", model.kept(F.col("key")).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 6) -> DataFrame:
    """Rows of `docs` that `resample` keeps, with all their columns; texts are not shuffled."""
    model, _ = fit(docs, labels, sample, seed)
    count, total = "__graphloom_n", "__graphloom_total"
    scored = model.score(docs, tuple(docs.columns), count, total)
    return scored.where(model.kept(model.key("doc_id", total), count)).select(*docs.columns)
