"""Packing into optimal length buckets.

The global histogram of sequence lengths has at most `max_len` rows whatever the corpus; dynamic programming
over it, on the driver, chooses the bucket boundaries that minimise padding. Inside each bucket, batches hold
as many sequences as fit a budget of padded tokens.

Texts longer than `max_len` tokens are cut into pieces, none is dropped. Ranks inside a bucket come from
prefix sums of shard counts (shards by MD5 of id and piece), so a bucket with most of the rows is never sorted in one task, and all batches of
a bucket but its last are full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, unit_digest, word_count

#: Longest sequence, number of buckets, padded tokens of a batch, rows of a shard.
MAX_LEN, BUCKETS, BUDGET, SHARD_ROWS = 2048, 16, 16384, 5000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending bucket boundaries for distinct ascending lengths: least sum of count * (boundary - length).

    cost[i, j] of one bucket that holds lengths i..j is lengths[j] * (counts) - (tokens); the best last cut
    for j moves right with j, but the plain minimum over i is a vector operation and needs no such care.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    docs = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    best = lengths * docs[1:] - tokens[1:]
    cuts: list[np.ndarray] = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, cut = best.copy(), np.zeros(n, np.int64)
        for j in range(1, n):
            tried = best[:j] + lengths[j] * (docs[j + 1] - docs[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(tried.argmin())
            if tried[i] < new[j]:
                new[j], cut[j] = tried[i], i + 1
        best = new
        cuts.append(cut)
    out, j = [], n - 1
    for cut in reversed(cuts):
        out.append(int(lengths[j]))
        if cut[j] == 0:
            break
        j = int(cut[j]) - 1
    return out[::-1]


def cut_pieces(lengths: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, n_tokens) to (doc_id, n_tokens, piece, start, length), pieces of at most `max_len` tokens.

    A row without tokens has one piece of length 0.
    """
    last = F.greatest(F.ceil(F.col("n_tokens") / F.lit(max_len)).cast("int") - 1, F.lit(0))
    pieces = lengths.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * max_len
    return pieces.select("*", start.alias("start"), F.least(F.lit(max_len).cast("long"), F.col("n_tokens") - start).alias("length"))


def pack(lengths: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, n_tokens, piece, start, length, bucket, bucket_len, batch) for rows (doc_id, n_tokens).

    bucket counts from 0, bucket_len is the padded length, batch counts from 0 in its bucket and holds
    floor(budget / bucket_len) pieces (1 at least). Pieces of length 0 need no tokens: they have null bucket,
    bucket_len and batch. Null n_tokens counts as 0. Equal rows get batches of their own.
    """
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")).alias("n_tokens"))
    pieces = cut_pieces(materialize(rows, "lengths"), max_len)
    histogram = pieces.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()
    bounds = optimal_boundaries(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), buckets)
    if not bounds:
        return pieces.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_len", "int"), ("batch", "long"))))
    bucket, size = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for i, bound in reversed(list(enumerate(bounds[:-1]))):
        bucket, size = F.when(F.col("length") <= bound, i).otherwise(bucket), F.when(F.col("length") <= bound, bound).otherwise(size)
    total = sum(r[1] for r in histogram)
    shards = max(1, -(-total // shard_rows))
    placed = pieces.withColumns({
        "bucket": F.when(F.col("length") > 0, bucket).cast("int"),
        "bucket_len": F.when(F.col("length") > 0, size).cast("int"),
        "shard": F.floor(unit_digest("doc_id", "piece", seed=3) * shards).cast("long"),
    })
    counts = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    # prefix sums of shard counts: within blocks of shards, then over the blocks
    block = F.floor(F.col("shard") / 1000)
    blocks = counts.groupBy("bucket", block.alias("block")).agg(F.sum("n").alias("n"))
    earlier = blocks.select("bucket", "block", (F.sum("n").over(Window.partitionBy("bucket").orderBy("block")) - F.col("n")).alias("before_block"))
    inside = counts.withColumn("block", block)
    inside = inside.withColumn("inside", F.sum("n").over(Window.partitionBy("bucket", "block").orderBy("shard")) - F.col("n"))
    offsets = inside.alias("x").join(earlier.alias("y"), F.col("x.bucket").eqNullSafe(F.col("y.bucket")) & (F.col("x.block") == F.col("y.block")))
    offsets = offsets.select(F.col("x.bucket").alias("b"), F.col("x.shard").alias("s"), (F.col("inside") + F.col("before_block")).alias("offset"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens")) - 1)
    joined = ranked.join(offsets, F.col("bucket").eqNullSafe(F.col("b")) & (F.col("shard") == F.col("s")))
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1))
    batch = F.when(F.col("bucket").isNotNull(), F.floor((F.col("offset") + F.col("rank")) / room).cast("long"))
    return joined.select("doc_id", "n_tokens", "piece", "start", "length", "bucket", "bucket_len", batch.alias("batch"))


def pack_texts(docs: DataFrame, **options: int) -> DataFrame:
    """`pack` of the word counts of `docs` (doc_id, text): one token is one `[^\\x20\\x09-\\x0D]+` run."""
    return pack(docs.select("doc_id", word_count("text").alias("n_tokens")), **options)
