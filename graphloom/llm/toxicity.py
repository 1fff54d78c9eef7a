"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting reads about EXAMPLES labelled documents, chosen by hash of the id; equal texts count once. Every word of
every example is a term (by a 64-bit hash), and every example with a word is in the index. A term's weight in a text is
(1 + ln tf) * idf * telling, made to length 1. `telling` grows with the log-likelihood statistic of the term's
rates under the two labels from FLOOR to 1: without it, a handful of telling words can't stand out among hundreds
of topic words (the README has figures).

The index keeps each term's postings in blocks of BLOCK examples with the greatest weight of each block. The
bound of a block is the sum of the query's weights times these; blocks whose bound is under the k-th best
similarity so far are skipped, so the k neighbours are exact (single precision). Postings of terms that occur in
more than one of SPARSE examples are stored as whole rows, and their part of a block's bound is its true maximum.

A document's raw score is the vote of its K nearest examples, weighted by similarity and drawn to the rate of all
examples. Raw scores are calibrated by isotonic regression on leave-one-out votes of the examples, which
executors cast. The nearest examples are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_scratch, map_columns, materialize, small_batches, unit_hash
from graphloom.llm.shingles import Shingler

EXAMPLES, K, BLOCK, SPARSE = 6000, 15, 256, 16
#: Blocks that are read first, for a good lower bound of the k-th similarity.
SEEDS = 2
#: Queries whose whole rows are read together.
GROUP = 64
#: Statistic that chance exceeds once in a thousand terms, excess over it at which a term has half its full weight,
#: and the weight of a term that tells nothing. Without the first, an example's own rare words, counted with its own
#: label, would tell something, and leave-one-out votes would be better than those of new texts.
CHANCE, HALF, FLOOR = 10.83, 30.0, 0.01
#: Weight of the rate of all examples in a vote; score from which a document counts as toxic.
SHRINK, THRESHOLD = 0.1, 0.3
#: Neighbours returned as evidence.
EVIDENCE = 3
#: Similarities are single precision sums: bounds give way by this.
SLACK = 1e-5

Query = tuple[np.ndarray, np.ndarray]


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point belongs to words: letters, digits and `_`."""
    return np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def _shingler() -> Shingler:
    return Shingler(1)


def words(text: str | None) -> Query:
    """Hashes of the distinct lower-case words of a text, ascending, and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _shingler().runs((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), ~_letters()[codes])
    return np.unique(found, return_counts=True)


def g_squared(a: np.ndarray, b: np.ndarray, n: float, m: float) -> np.ndarray:
    """Log-likelihood statistic of a of n against b of m documents with a term; 0 if either label is missing."""
    out = np.zeros(a.size)
    if not n or not m:
        return out
    share = (a + b) / (n + m)
    for seen, of in ((a, n), (b, m)):
        for k, p in ((seen, share), (of - seen, 1 - share)):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(k > 0, k * np.log(k / (of * p)), 0)
    return np.maximum(2 * out, 0)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), one range behind the other."""
    size = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if size.size else size


@dataclass
class Index:
    """Block-max inverted index of unit vectors; examples are numbered by their heaviest term, then by id."""

    vocabulary: np.ndarray  # ascending hashes of the terms
    weight_of: np.ndarray  # idf * telling of each term
    ids: np.ndarray  # doc_id of each example
    labels: np.ndarray
    base_rate: float
    rows: np.ndarray  # place of each term's whole row, -1: sparse postings
    dense: np.ndarray  # whole rows, term x example
    start: np.ndarray  # first entry (term, block) of each term
    entry_block: np.ndarray
    entry_max: np.ndarray
    entry_start: np.ndarray  # first posting of each entry
    example: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, texts: list[str | None], ids: list[int], labels: list[int]) -> Index:
        """Of texts; those without words are left out."""
        found = [words(t) for t in texts]
        full = [i for i, (w, _) in enumerate(found) if w.size]
        flat = [np.concatenate([found[i][k] for i in full]) if full else np.zeros(0, np.uint64) for k in (0, 1)]
        return cls.of(*flat, np.array([found[i][0].size for i in full], np.int64), np.array([ids[i] for i in full], np.int64), np.array([labels[i] for i in full], float))

    @classmethod
    def of(cls, hashes: np.ndarray, tf: np.ndarray, sizes: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Index:
        """Of flat postings: the words of the first example and their counts, then those of the second, by `sizes`."""
        vocabulary, terms = np.unique(hashes, return_inverse=True)
        n, v = ids.size, vocabulary.size
        row = np.repeat(np.arange(n), sizes)
        df, toxic = (np.bincount(terms, w, v) for w in (None, labels[row]))
        excess = np.maximum(g_squared(toxic, df - toxic, labels.sum(), n - labels.sum()) - CHANCE, 0)
        weight_of = (np.log((n + 1) / (df + 1)) + 1) * (FLOOR + excess / (excess + HALF))
        weight = (1 + np.log(tf)) * weight_of[terms]
        weight = weight / np.sqrt(np.bincount(row, weight**2, n))[row]
        # examples by heaviest term: a block's members are alike, and its bounds tight
        heavy = np.zeros(n, np.int64)
        by_weight = np.lexsort((terms, -weight, row))
        heavy[row[by_weight[::-1]]] = terms[by_weight[::-1]]
        number = np.empty(n, np.int64)
        order = np.lexsort((ids, heavy))
        number[order] = np.arange(n)
        ids, labels, example = ids[order], labels[order], number[row]
        blocks = max(1, -(-n // BLOCK))
        by_term = np.lexsort((example, terms))
        terms, example, weight = terms[by_term], example[by_term], weight[by_term].astype(np.float32)
        # whole rows of frequent terms
        frequent = np.flatnonzero(df * SPARSE > n)
        rows = np.full(v, -1, np.int64)
        rows[frequent] = np.arange(frequent.size)
        dense = np.zeros((frequent.size, n), np.float32)
        whole = rows[terms] >= 0
        dense[rows[terms[whole]], example[whole]] = weight[whole]
        # postings of the others by (term, block)
        terms, example, weight = terms[~whole], example[~whole], weight[~whole]
        cell = terms * blocks + example // BLOCK
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if cell.size else np.zeros(0, np.int64)
        entry_max = np.maximum.reduceat(weight, first) if first.size else np.zeros(0, np.float32)
        return cls(
            vocabulary, weight_of, ids, labels, float(labels.mean()) if n else 0.0, rows, dense,
            np.searchsorted(terms[first], np.arange(v + 1)), cell[first] % blocks, entry_max, np.append(first, cell.size), example, weight,
        )

    def unit(self, hashes: np.ndarray, counts: np.ndarray) -> Query:
        """Known terms of a text's words and their weights, of length 1."""
        terms = np.searchsorted(self.vocabulary, hashes)
        terms[terms == self.vocabulary.size] = 0
        known = self.vocabulary[terms] == hashes if self.vocabulary.size else np.zeros(hashes.size, bool)
        terms = terms[known]
        weight = (1 + np.log(counts[known])) * self.weight_of[terms]
        return terms, (weight / np.sqrt((weight**2).sum() or 1.0)).astype(np.float32)

    def nearest(self, queries: list[Query], k: int = K, without: list[int] | None = None) -> list[Query]:
        """For each query (terms, weights) the k examples of greatest cosine above 0, and these.

        Ties go to the first example. Examples of the id `without` are left out. Whole rows are read for all
        queries of a group at once, a matrix product; then each query skips blocks by their bounds.
        """
        n, out = self.ids.size, []
        for i in range(0, len(queries), GROUP):
            group = queries[i : i + GROUP]
            if not n:
                out += [(np.zeros(0, np.int64), np.zeros(0))] * len(group)
                continue
            whole = np.zeros((len(group), self.dense.shape[0]), np.float32)
            for q, (terms, weight) in zip(whole, group, strict=True):
                rows = self.rows[terms]
                q[rows[rows >= 0]] = weight[rows >= 0]
            common = whole @ self.dense
            tops = np.maximum.reduceat(common, np.arange(0, n, BLOCK), axis=1)
            for j, (terms, weight) in enumerate(group):
                rare = self.rows[terms] < 0
                out.append(self._nearest(terms[rare], weight[rare], common[j], tops[j], k, None if without is None else without[i + j]))
        return out

    def _nearest(self, terms: np.ndarray, weight: np.ndarray, score: np.ndarray, tops: np.ndarray, k: int, without: int | None) -> Query:
        """`nearest` of one query's terms with postings; score holds the sums of the others, tops their block maxima."""
        n, blocks = score.size, tops.size
        lo, hi = self.start[terms], self.start[terms + 1]
        entries, of = _ranges(lo, hi), np.repeat(weight, hi - lo)
        block = self.entry_block[entries]
        bound = tops + np.bincount(block, self.entry_max[entries] * of, blocks)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def read(chosen: np.ndarray) -> float:
            """Reads the postings of the chosen blocks; the k-th best similarity so far."""
            own = chosen[block]
            lo, hi = self.entry_start[entries[own]], self.entry_start[entries[own] + 1]
            at = _ranges(lo, hi)
            sums = np.bincount(self.example[at], self.weight[at] * np.repeat(of[own], hi - lo), n)
            members = _ranges(np.flatnonzero(chosen) * BLOCK, np.minimum((np.flatnonzero(chosen) + 1) * BLOCK, n))
            values = score[members] + sums[members]
            good = values > 0 if without is None else (values > 0) & (self.ids[members] != without)
            found.append((members[good], values[good]))
            seen = np.concatenate([v for _, v in found])
            return float(np.partition(seen, seen.size - k)[seen.size - k]) if seen.size > k else 0.0

        done = np.zeros(blocks, bool)
        done[np.argpartition(-bound, SEEDS - 1)[:SEEDS] if blocks > SEEDS else slice(None)] = True
        left = ~done & (bound >= read(done) - SLACK) & (bound > 0)
        if left.any():
            read(left)
        members, values = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.lexsort((members, -values))[:k] if values.size <= 4 * k else self._first(members, values, k)
        return members[order], values[order]

    @staticmethod
    def _first(members: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
        """Places of the k greatest values, ties by member."""
        near = np.flatnonzero(values >= np.partition(values, values.size - k)[values.size - k])
        return near[np.lexsort((members[near], -values[near]))][:k]

    def vote(self, near: np.ndarray, similarity: np.ndarray) -> float:
        return float(((similarity * self.labels[near]).sum() + SHRINK * self.base_rate) / (similarity.sum() + SHRINK))

    def calibrated(self, votes: np.ndarray, labels: np.ndarray) -> Query:
        """Knots (vote, score) of pool-adjacent-violators on leave-one-out votes; equal votes share a mean."""
        if len(set(labels)) < 2:
            return np.array([0.0, 1.0]), np.array([0.0, 1.0])
        at, inverse = np.unique(np.round(votes, 3), return_inverse=True)
        n, hits = np.bincount(inverse), np.bincount(inverse, labels)
        pools: list[list] = []  # hits, rows, values
        for value, h, m in zip(at, hits, n, strict=True):
            pools.append([h, m, [value]])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                h2, m2, v2 = pools.pop()
                pools[-1] = [pools[-1][0] + h2, pools[-1][1] + m2, pools[-1][2] + v2]
        x = [v for _, _, vs in pools for v in ([vs[0], vs[-1]] if len(vs) > 1 else vs)]
        y = [(h + self.base_rate) / (m + 1) for h, m, vs in pools for _ in range(2 if len(vs) > 1 else 1)]
        return np.array([0.0, *x]), np.maximum.accumulate(np.array([min(self.base_rate, y[0]), *y]))

    def score(self, texts: list[str | None], knots: Query) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """Calibrated score and evidence (doc_id, label, similarity) of each text."""
        out = []
        for near, similarity in self.nearest([self.unit(*words(t)) for t in texts]):
            value = float(np.interp(self.vote(near, similarity), *knots)) if near.size else self.base_rate
            evidence = [(int(self.ids[i]), int(self.labels[i]), min(1.0, float(s))) for i, s in zip(near[:EVIDENCE], similarity, strict=False)]
            out.append((min(1.0, max(0.0, value)), evidence))
        return out


@dataclass
class Fitted:
    """An index that executors have, and the knots of its calibration."""

    index: Broadcast
    knots: Query


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Fitted:
    """Index of about `examples` rows of `labels` (doc_id, toxic 0/1) with their texts in `docs`, sent to executors.

    Rows with a null doc_id or other labels are left out, as are ids without a text or a word. A document with
    several labels, or equal texts with several, are toxic if one label says so; the least id stands for equal
    texts. Empty tables give an index without examples. Other columns aren't read. The size is bounded by the
    words of `examples` texts.
    """
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = marked.count()
    few = marked.where(unit_hash("doc_id", seed=2) < examples / max(n, 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(few), "doc_id")
    single = rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("text").alias("text"))

    def bags(cols: dict[str, list]) -> dict[str, list]:
        found = [words(t) for t in cols["text"]]
        return {"words": [w.view(np.int64) for w, _ in found], "counts": [n.astype(np.int32) for _, n in found]}

    made = map_columns(single, bags, "words array<long>, counts array<int>", ("doc_id", "toxic"))
    made = materialize(made.where(F.size("words") > 0), "examples")
    local = made.orderBy("doc_id", "toxic").toArrow()
    flat = {c: local.column(c).combine_chunks() for c in ("words", "counts")}
    index = Index.of(
        flat["words"].flatten().to_numpy().view(np.uint64), flat["counts"].flatten().to_numpy().astype(float), flat["counts"].value_lengths().to_numpy().astype(np.int64),
        local.column("doc_id").to_numpy(), local.column("toxic").to_numpy().astype(float),
    )
    del local, flat
    sent = spark.sparkContext.broadcast(index)
    small_batches(spark)

    def votes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = sent.value
        for batch in batches:
            own = zip(batch.column(2), batch.column(3), strict=True)
            queries = [index.unit(w.values.to_numpy().view(np.uint64), n.values.to_numpy()) for w, n in own]
            cast = [index.vote(*x) for x in index.nearest(queries, without=batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(cast, pa.float64()), batch.column(1)], ["vote", "toxic"])

    # at most `examples` pairs of numbers
    cast = made.select("doc_id", "toxic", "words", "counts").repartition(spark.sparkContext.defaultParallelism).mapInArrow(votes, "vote double, toxic int").toArrow()
    knots = index.calibrated(cast.column("vote").to_numpy(), cast.column("toxic").to_numpy().astype(float))
    drop_scratch(made)
    return Fitted(sent, knots)


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """(doc_id, score, predicted, evidence) for every row of `docs` (doc_id, text); other columns aren't read.

    score is 0 to 1, predicted 1 from THRESHOLD on, evidence the nearest examples (doc_id, toxic, similarity), ties
    by their order in the index. Null texts, empty ones and those without any word of an example score the rate
    of toxic examples, without evidence. Repeated rows and equal texts get equal results.
    """
    sent, knots = fitted.index, fitted.knots

    def compute(cols: dict[str, list]) -> dict[str, list]:
        place: dict[str, int] = {}
        of = [place.setdefault(t or "", len(place)) for t in cols["text"]]  # equal texts are scored once
        found = sent.value.score(list(place), knots)
        evidence = [[{"doc_id": d, "toxic": y, "similarity": s} for d, y, s in e] for _, e in found]
        return {"score": [found[i][0] for i in of], "predicted": [int(found[i][0] >= THRESHOLD) for i in of], "evidence": [evidence[i] for i in of]}

    added = "score double, predicted int, evidence array<struct<doc_id:bigint,toxic:int,similarity:double>>"
    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), compute, added, ("doc_id",))
