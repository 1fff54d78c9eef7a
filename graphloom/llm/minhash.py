"""MinHash near-duplicates: universal hash minima, banding, signature and set verification, components.

1. One pass over the texts makes each document's shingle set and, of that, 128 minima of universal hashes
   x -> (a x + b) mod 2**64, 32 band keys of 4 minima each and the low byte of every minimum.
2. Documents with equal sets collapse to a class. Groups of copies, however large, so cost one partial
   aggregate.
3. Buckets (equal band keys) give a star: every member is a candidate of the bucket's first member. Stars are
   linear in the bucket; a pair of similarity 0.75 misses all 32 bands with probability 5e-6.
4. A candidate whose signatures agree in less than 58 % of places (4.4 standard deviations under 0.75) goes;
   the others are verified on their full sets, and components are taken. The sets are made once, of one text for
   each class that shares a bucket, and written: the only time that texts travel.
5. A bucket whose members are still in more than one component may hide a link that no star edge showed. Its
   members meet across components in groups of at most two blocks of BLOCK members, where signatures and
   hashed sets find the links that join components; a group reports fewer links than it has members, never
   its pairs. Members of the bucket's greatest component have blocks of their own, which meet the other members'
   blocks alone, so few stragglers of a great group cost few copies of it. Links are verified on full sets, and
   components are taken again.

One bucket, class or component may hold a third of all rows: what is aggregated by such a key is written before rows
are joined to it, so that both sides of the join are plain shuffles, whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_scratch, map_columns, materialize
from graphloom.llm.components import connected_components
from graphloom.llm.shingles import Shingler, overlap

HASHES, BANDS = 128, 32
#: Share of equal signature places under which a candidate isn't verified on full sets.
SIGNATURE_SHARE = 0.58
#: Members of a bucket that meet in one task.
BLOCK = 1024

_U = np.uint64
SKETCH = "n_shingles long, set_key binary, bands array<long>, signature binary"


@lru_cache(1)
def _family(hashes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = rng.integers(0, 1 << 64, (2, hashes), dtype=_U)
    return a | _U(1), b


def minima(values: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Least value of each universal hash over a set, in blocks that stay in cache."""
    a, b = _family(hashes)
    least = np.full(hashes, (1 << 64) - 1, _U)
    for i in range(0, values.size, 256):
        part = values[i : i + 256, None] * a
        part += b
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key a band, different bands never mixed by chance alone."""
    rows = least.reshape(bands, -1)
    h = np.arange(1, bands + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)
    for i in range(rows.shape[1]):
        h = (h ^ rows[:, i]) * _U(0xFF51AFD7ED558CCD)
        h = h ^ (h >> _U(32))
    return h.view(np.int64)


def sketch(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, digest, n_shingles, set_key, bands, signature) for each row; empty sets have null keys.

    digest is a hash of the text that tells rows of one id apart.
    """

    def compute(cols: dict[str, list]) -> dict[str, list]:
        shingler = Shingler(width)
        out: dict[str, list] = {"n_shingles": [], "set_key": [], "bands": [], "signature": []}
        for text in cols["text"]:
            values = shingler.distinct(text)
            out["n_shingles"].append(values.size)
            if not values.size:
                for k in ("set_key", "bands", "signature"):
                    out[k].append(None)
                continue
            least = minima(values)
            out["set_key"].append(_key(values))
            out["bands"].append(band_keys(least))
            out["signature"].append((least >> _U(32)).astype(np.uint8).tobytes())
        return out

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("digest")), compute, SKETCH, ("doc_id", "digest"))


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(set_key, items): the full sorted sets as packed 64-bit hashes; empty sets have no row."""

    def compute(cols: dict[str, list]) -> dict[str, list]:
        shingler = Shingler(width)
        sets = [shingler.distinct(t) for t in cols["text"]]
        return {"set_key": [_key(x) for x in sets], "items": [x.tobytes() for x in sets]}

    made = map_columns(docs.select("text"), compute, "set_key binary, items binary", ())
    return made.where("set_key is not null")


def _sets_of(keys: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Written table of `shingle_sets` for the keys (set_key) alone."""
    ids = classes.join(keys, "set_key", "left_semi").select("doc_id").distinct()
    found = shingle_sets(docs.join(ids, "doc_id", "left_semi"), width)
    return materialize(found.dropDuplicates(["set_key"]), "sets")


def _cut_short(members: DataFrame) -> DataFrame:
    """`members` with each set's hashes cut to 32 bits."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("items")
            items = [np.unique(np.frombuffer(x.as_buffer(), _U).astype(np.uint32)).tobytes() for x in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(items, batch.schema.field(at).type))

    return members.mapInArrow(cut, members.schema)


def _key(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if values.size else None


def _rows(good: list[int] | np.ndarray):
    import pyarrow as pa

    return pa.array(np.asarray(good, np.int64))


def _likely(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree well enough."""
    left = signatures.select(F.col("set_key").alias("a"), F.col("signature").alias("sig_a"))
    right = signatures.select(F.col("set_key").alias("b"), F.col("signature").alias("sig_b"))

    def keep(batches: Iterator) -> Iterator:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            good = np.flatnonzero((a == b).mean(axis=1) >= SIGNATURE_SHARE)
            yield batch.select([0, 1]).take(_rows(good))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(keep, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that hold 100 * intersection >= percent * union on the full sets."""
    left = sets.select(F.col("set_key").alias("a"), F.col("items").alias("set_a"))
    right = sets.select(F.col("set_key").alias("b"), F.col("items").alias("set_b"))

    def keep(batches: Iterator) -> Iterator:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), _U) for k in (2, 3))
                both = overlap(a, b)
                if 100 * both >= percent * (a.size + b.size - both):
                    good.append(i)
            yield batch.select([0, 1]).take(_rows(good))

    found = pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(keep, "a binary, b binary")
    return materialize(found, "links")


def by_chance(expected: float) -> int:
    """Equal 32-bit hashes of different members that `expected` ones exceed with probability 1e-6 at most."""
    k = 0
    # P(X > k) <= expected**(k + 1) / (k + 1)!
    while expected > 0 and (k + 1) * math.log(expected) - math.lgamma(k + 2) > math.log(1e-6):
        k += 1
    return k


def _compare(percent: int):
    """Links of each (key, i, j) group across components; groups come sorted and hold two blocks at most.

    A group's pairs pass, in this order: different components so far, no earlier band in common (that band's
    group has them), sizes, signatures, and the count of common 32-bit hashes. The count falls short of the true
    one by no more than either set lost when cut to 32 bits; a pair that could reach `percent` with these is
    reported, and all reported pairs are verified on full sets afterwards. The count can exceed the true one by
    chance: a pair that passes without `by_chance` merges its components within the group, so the group
    reports fewer links than it has members, but for pairs so near to `percent`.
    """

    def links(group, out: list) -> None:
        """group: Arrow rows of one (key, i, j); their buffers are read in place."""
        one, two, band = (group.column(c)[0].as_py() for c in ("i", "j", "band"))
        own, size = group.column("own").to_numpy(), group.column("n_shingles").to_numpy()
        names = group.column("set_key").to_pylist()
        comp = np.unique(group.column("component").to_pylist(), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(-1, HASHES)
        keys = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[:, :band]
        items = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("items")]
        place = np.arange(own.size)
        for at in np.flatnonzero(own == one):
            good = (comp != comp[at]) & (place > at if one == two else own == two)
            good &= (100 * np.minimum(size, size[at]) >= percent * np.maximum(size, size[at]))
            good = np.flatnonzero(good)
            good = good[~(keys[good] == keys[at]).any(axis=1)]
            share = (sig[good] == sig[at]).mean(axis=1)
            good = good[np.argsort(-share, kind="stable")][: int((share >= SIGNATURE_SHARE).sum())]
            for part in np.array_split(good, -(-good.size // 64) or 1):
                part = part[comp[part] != comp[at]]
                if not part.size:
                    continue
                joined = np.concatenate([items[k] for k in part])
                found = np.searchsorted(items[at], joined)
                found[found == items[at].size] = 0
                ends = np.cumsum([items[k].size for k in part])
                both = np.diff(np.cumsum(items[at][found] == joined)[ends - 1], prepend=0)
                for k, n in zip(part, both, strict=True):
                    total = size[at] + size[k]
                    most = n + min(size[at] - items[at].size, size[k] - items[k].size)
                    if comp[k] == comp[at] or 100 * most < percent * (total - most):
                        continue
                    out.append((names[at], names[k]) if names[at] < names[k] else (names[k], names[at]))
                    sure = n - by_chance((size[at] - n) * (size[k] - n) / 2**32)
                    if 100 * sure >= percent * (total - sure):
                        comp[comp == comp[k]] = comp[at]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch_of(out: list):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], kind) for k in (0, 1)], ["a", "b"])

        rest = None  # the last group so far, of at most two blocks
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            kind = rows.schema.field("set_key").type
            marks = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1)]
            out: list = []
            for lo, hi in zip(cuts, cuts[1:]):
                links(rows.slice(lo, hi - lo), out)
            rest = rows.slice(cuts[-1])
            yield batch_of(out)
        if rest is not None and rest.num_rows:
            out = []
            links(rest, out)
            yield batch_of(out)

    return run


def _hidden_links(members: DataFrame, percent: int) -> DataFrame:
    """Likely links (a, b) across components within buckets.

    members: (key, band, set_key, component, n, top, n_top, n_shingles, bands, signature, items). The n_top members
    of a bucket's greatest component, top, and its n - n_top other members are dealt by hash into blocks of about
    BLOCK, the others' first; a group holds two blocks, one of the others at least. A bucket of up to BLOCK members
    is one block.
    """
    great = F.col("n") > BLOCK
    others = F.when(great, F.ceil((F.col("n") - F.col("n_top")) / F.lit(BLOCK))).otherwise(1).cast("int")
    greatest = F.when(great, F.ceil(F.col("n_top") / F.lit(BLOCK))).otherwise(0).cast("int")
    dealt = members.withColumns({"others": others, "greatest": greatest, "is_top": great & (F.col("component") == F.col("top"))})
    hashed = F.xxhash64("set_key")
    own = F.when(F.col("is_top"), F.col("others") + F.pmod(hashed, "greatest")).otherwise(F.pmod(hashed, "others")).cast("int")
    meets = F.col("others") + F.when(F.col("is_top"), 0).otherwise(F.col("greatest")) - 1
    dealt = dealt.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), meets)).alias("other"))
    names = ("key", "i", "j", "own", "band", "set_key", "component", "n_shingles", "bands", "signature", "items")
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select(*names)
    groups = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return groups.mapInArrow(_compare(percent), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    Links hold 100 * intersection >= percent * union of the shingle sets. component_id is the least doc_id
    reachable, kept tells whether it is the row's own. Null texts and texts without words have an empty set
    and are linked with nothing; a row with a null doc_id gets a null component and is kept; a doc_id that
    repeats gets a result for each row by that row's text. Columns besides doc_id and text are not read.
    An empty table gives an empty one. `percent` must be 75 or more: the bands are chosen for it.
    """
    return _grouped(docs, percent, width).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """`near_duplicates` with the digest of each row's text."""
    if percent < 75:
        raise ValueError("the bands are chosen for 75 percent or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(sketch(docs, width), "sketch")
    full = rows.where("set_key is not null and doc_id is not null")
    first = [F.first(c).alias(c) for c in ("n_shingles", "bands", "signature")]
    classes = materialize(full.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), *first), "classes")
    members = classes.select("set_key", F.posexplode("bands").alias("band", "key"))
    # counts alone travel for all keys; the first members are taken of the few that are shared
    heads = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "heads")
    shared = materialize(members.join(heads, "key"), "buckets")
    leads = materialize(shared.groupBy("key").agg(F.min("set_key").alias("lead")), "leads")
    sets = _sets_of(shared.select("set_key").distinct(), classes, docs, width)
    stars = shared.join(leads, "key").where("set_key > lead").select(F.col("lead").alias("a"), F.col("set_key").alias("b")).distinct()
    signatures = classes.select("set_key", "signature")
    links = _verified(materialize(_likely(stars, signatures), "stars"), sets, percent)
    found = materialize(connected_components(links), "components").withColumnRenamed("node", "set_key")

    own = F.coalesce("component", "set_key").alias("component")
    placed = shared.where("n > 2").join(found, "set_key", "left").select("key", "band", "set_key", "n", own)
    spread = materialize(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi"), "spread")
    apart = materialize(placed.join(spread.select("key"), "key", "left_semi"), "apart")
    sizes = apart.groupBy("key", "component").agg(F.count("*").alias("n_top"))
    tops = materialize(sizes.groupBy("key").agg(F.max(F.struct("n_top", F.col("component").alias("top"))).alias("most")).select("key", "most.*"), "tops")
    hidden = apart.join(tops, "key").join(classes.drop("doc_id"), "set_key").join(sets, "set_key")
    extra = materialize(_hidden_links(_cut_short(hidden), percent), "hidden")
    if not extra.isEmpty():
        more = _verified(extra, sets, percent)
        if not more.isEmpty():
            found = materialize(connected_components(links.union(more)), "components").withColumnRenamed("node", "set_key")
    for done in (heads, shared, leads, sets, spread, apart, tops):
        drop_scratch(done)

    places = classes.select("set_key", "doc_id").join(found, "set_key", "left").select("set_key", "doc_id", own)
    least = materialize(places.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    places = places.join(least, "component").select("set_key", "least")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return (
        rows.select("doc_id", "digest", "n_shingles", "set_key")
        .join(places, "set_key", "left")
        .select("doc_id", "digest", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    )


def keep_one(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the least doc_id.

    Rows with null ids or empty sets are groups of their own; rows that repeat an id with the same text count as
    copies. Where one id has several texts, each is judged by its own group, and of those in the group that the
    id leads one stays. An empty table stays empty.
    """
    kept = _grouped(docs, percent, width).where("kept and doc_id is not null")
    led = kept.where("n_shingles > 0").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    named = led.union(kept.where("n_shingles = 0").select("doc_id", "digest").distinct()).toDF("__graphloom_id", "__graphloom_digest")
    keyed = docs.withColumns({"__graphloom_own": F.col("doc_id").cast("long"), "__graphloom_text": F.xxhash64("text")})
    same = (keyed["__graphloom_own"] == named["__graphloom_id"]) & (keyed["__graphloom_text"] == named["__graphloom_digest"])
    held = keyed.join(named, same, "left_semi").dropDuplicates(["__graphloom_own", "__graphloom_text"]).select(*docs.columns)
    return held.unionByName(docs.where("doc_id is null"))
