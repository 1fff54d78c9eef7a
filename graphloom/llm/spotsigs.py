"""SpotSigs document fingerprints in DataFrame operations alone.

A signature is an anchor, a very common word, with the chain of the next CHAIN content words behind it, however far
off; common words inside the chain are skipped. The set of a text's signatures is its fingerprint. Two texts are
compared by Jaccard similarity. Sets belong to length partitions whose bounds grow by 1 / least, so sets of
partitions that aren't neighbours can't reach the similarity `least` and are never compared.

A text without a full chain behind a common word (lists, tables, other languages) has other anchors: its start, and
one word in eight by hash. If no chain follows these either, the whole text is the only signature.

Defined results: null texts count as empty; a text without words has an empty fingerprint, whose likeness to
any set is 0, but 1 to another empty one. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize

#: Content words of a chain; likeness under which pairs are pruned by length.
CHAIN, LEAST = 2, 0.1
#: Anchors, the commonest words of four languages.
ANCHORS = (
    "a an and are as at be by for from has have he her his i in is it its of on or she so that the their there they this to was we were with you "
    "aber als auch auf aus bei das dem den der des die ein eine einem einen einer er es für ich im ist mit nicht sich sie sind und von war wie wir zu zum "
    "au aux avec ce cette dans de des du elle en est et il la le les mais ne nous ou par pas pour que qui sa se ses son sur un une vous "
    "al como con del el ella en era es esta la las lo los más no o para pero por que se sin su sus un una y"
).split()
#: Rows of a length of the id order that one task sorts, and the most such lengths.
RUN_ROWS, MAX_RUNS = 1000, 20_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """`body` of a value that is made once: a one-element array binds it to a name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures of a text, words joined by blanks (null: none).

    The i-th word of a text, if it is its a-th anchor, has i - a content words before it (all counted from 0): the
    chain is found by index, in time linear in the text.
    """
    common = sorted(set(ANCHORS))

    def joined(anchor: Column, content: Column, at: Column) -> Column:
        return F.when(at + chain <= F.size(content), F.concat_ws(" ", anchor, *(F.get(content, at + k) for k in range(chain))))

    def found(sigs: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(sigs, lambda s: s.isNotNull())))

    def behind_common(ws: Column, content: Column) -> Column:
        at = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(*common), i)), lambda i: i.isNotNull())
        return found(F.transform(at, lambda i, a: joined(F.get(ws, i), content, i - a)))

    def behind_hashed(ws: Column, content: Column) -> Column:
        hashed = F.transform(content, lambda w, i: F.when(F.md5(w) < "2", joined(w, content, i + 1)))
        return _let(
            found(F.concat(F.array(joined(F.lit("^"), content, F.lit(0))), hashed)),
            lambda sigs: F.when(F.size(sigs) > 0, sigs).otherwise(F.filter(F.array(F.concat_ws(" ", F.lit("^^"), ws)), lambda _: F.size(ws) > 0)),
        )

    def of(x: Column) -> Column:
        return _let(behind_common(x["ws"], x["content"]), lambda sigs: F.when(F.size(sigs) > 0, sigs).otherwise(behind_hashed(x["ws"], x["content"])))

    own = words(F.coalesce(text, F.lit("")))
    return _let(own, lambda ws: _let(F.struct(ws.alias("ws"), F.filter(ws, lambda w: ~w.isin(*common)).alias("content")), of))


def fingerprint(sigs: Column) -> Column:
    """A set as text: its size and a digest of its members."""
    return F.concat_ws("-", F.size(sigs).cast("string"), F.sha2(F.array_join(sigs, ","), 256))


def partition(n: Column, least: float) -> Column:
    """Number of the length partition of a set of n members, above 0; each spans a factor of 1 / least."""
    return F.floor(F.log(n) / F.log(F.lit(1 / min(least, 0.999))) + 1e-9).cast("int")


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard similarity of two sets; 0, uncompared, if their lengths keep it under `least`."""
    n, m = F.size(a), F.size(b)
    pruned = (F.abs(partition(n, least) - partition(m, least)) > 1) | (F.least(n, m) < F.lit(least) * F.greatest(n, m))
    exact = _let(F.size(F.array_intersect(a, b)), lambda both: both / (n + m - both))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).when(pruned, 0.0).otherwise(exact)


def following(docs: DataFrame, columns: dict[str, Column], run_rows: int = RUN_ROWS, max_runs: int = MAX_RUNS) -> DataFrame:
    """All columns of `docs`, `columns` by name, and `next_<name>`: those of the row of the next doc_id.

    The last row is followed by the first, a single one by itself. The id order is cut into runs of about
    `run_rows` rows at quantiles of the ids; a run is a task's window. The first rows of a run are copied behind
    the run before it, so each row travels once, and `columns` are made after that. Equal ids follow each other
    in the order of the texts; null ids come first. Own columns begin with `__graphloom_`; a column of `docs`
    that `columns` names is replaced.
    """
    spark = docs.sparkSession
    run, place, at = "__graphloom_run", "__graphloom_place", "__graphloom_at"
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    runs = max(1, min(max_runs, n // run_rows))
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], 20 * runs)).first()[0] or [])) if runs > 1 else []
    own = docs.withColumn(run, _run_of(F.col("doc_id").cast("long"), cuts))
    # the first id of each run and the run before it: as many rows as runs
    first = ids.withColumn(run, _run_of(F.col("doc_id"), cuts)).groupBy(run).agg(F.min("doc_id").alias("first_id"))
    heads = sorted((r[run], r["first_id"]) for r in first.collect())
    kept = [c for c in docs.columns if c not in columns]
    if not heads:
        empty = docs.select(*kept, *(c.alias(name) for name, c in columns.items()))
        return empty.select("*", *(F.lit(None).cast(empty.schema[name].dataType).alias(f"next_{name}") for name in columns))
    ghosts = spark.createDataFrame([(first_id, heads[i - 1][0], i == 0) for i, (_, first_id) in enumerate(heads)], "__graphloom_head long, __graphloom_into int, __graphloom_wraps boolean")
    marked = own.join(F.broadcast(ghosts), F.col("doc_id").cast("long").eqNullSafe(F.col("__graphloom_head")), "left")
    here = F.struct(F.col(run).alias("run"), F.lit(0).alias("place"))
    ghost = F.struct(F.col("__graphloom_into").alias("run"), F.when(F.col("__graphloom_wraps"), 2).otherwise(1).alias("place"))
    dealt = marked.select(*docs.columns, F.explode(F.when(F.col("__graphloom_into").isNotNull(), F.array(here, ghost)).otherwise(F.array(here))).alias(at))
    dealt = dealt.select(*docs.columns, F.col(f"{at}.run").alias(run), F.col(f"{at}.place").alias(place))
    dealt = dealt.repartition(run).select(*kept, *(c.alias(name) for name, c in columns.items()), run, place, F.col("text").alias(at))
    order = Window.partitionBy(run).orderBy(place, "doc_id", at)
    led = dealt.select("*", *(F.lead(name).over(order).alias(f"next_{name}") for name in columns))
    return led.where(F.col(place) == 0).drop(run, place, at)


def _run_of(value: Column, cuts: list[int]) -> Column:
    """Number of cuts below or at the value, by bisection of a literal array."""
    if not cuts:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        right = F.get(array, mid) <= value
        lower = F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(mid).alias("hi"))
        return F.when(acc["lo"] < acc["hi"], lower).otherwise(acc)

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.when(value.isNull(), 0).otherwise(F.aggregate(steps, start, halve, lambda acc: acc["lo"]))


def edited_pairs(docs: DataFrame, chain: int = CHAIN, least: float = LEAST) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses, one row per row of `docs`.

    The edited text has its last floor(n / 2) code points replaced by the first as many, or all, of the next
    document's by ascending doc_id; the last document is followed by the first, a single one by itself. Repeated
    ids follow each other by text, null ids come first, an empty table gives an empty one; other columns than
    doc_id and text aren't read.
    Returns doc_id, n_chars, edited_sha256, signatures, edited_signatures, near_edited, near_next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    led = following(rows, {"text": F.col("text"), "sigs": signatures(F.col("text"), chain)})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = led.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sigs", "next_sigs", signatures(F.col("edited"), chain).alias("edited_sigs"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("sigs").alias("signatures"),
        F.col("edited_sigs").alias("edited_signatures"),
        likeness(F.col("sigs"), F.col("edited_sigs"), least).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs"), least).alias("near_next"),
    )


def digest(pairs: DataFrame) -> DataFrame:
    """`edited_pairs` with fingerprints as text."""
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def near_pairs(docs: DataFrame, least: float = 0.75, chain: int = CHAIN) -> DataFrame:
    """(a, b, likeness) between representatives of equal sets, a < b, and (doc_id, a) membership as a pair.

    Returns two tables: links between different sets of likeness `least` or more, and the members of each
    set (doc_id, rep). Sets are dealt into length partitions whose bounds grow by 1 / least, so a set meets
    its own and the next partition alone. In a partition, only sets that share one of their rarest
    signatures meet: two sets of that likeness share one among the first size - ceil(least * size) + 1.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text"), chain).alias("sigs"))
    rows = materialize(rows.where(F.size("sigs") > 0).withColumn("set", F.sha2(F.array_join("sigs", ","), 256)), "spots")
    reps = rows.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("sigs").alias("sigs"))
    members = rows.select("doc_id", "set").join(reps.select("set", "rep"), "set").select("doc_id", "rep")
    sets = materialize(reps.select("rep", "sigs", F.size("sigs").alias("n")), "sets")
    freq = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    ranked = sets.select("rep", "n", F.explode("sigs").alias("sig")).join(freq, "sig")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("df", "sig"))
    prefix = F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1
    part = partition(F.col("n"), least)
    heads = ranked.withColumn("rank", rank).where(F.col("rank") <= prefix).where("df > 1").select("rep", "n", "sig", part.alias("part"))
    met = heads.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    other = heads.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), "sig", "part")
    fits = (F.col("a") != F.col("b")) & (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") >= F.lit(least) * F.col("n_b"))
    pairs = met.join(other, ["sig", "part"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = sets.select(F.col("rep").alias("a"), F.col("sigs").alias("sigs_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("sigs").alias("sigs_b"))
    links = pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sigs_a"), F.col("sigs_b"), least).alias("likeness"))
    return links.where(F.col("likeness") >= least), members
