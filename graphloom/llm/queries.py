"""Registered queries of the training-data operators; each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import html, langid, media, minhash, mixing, packing, quality, secrets, spotsigs, toxicity
from graphloom.llm.common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.fit(docs, labels.where(~held_out()))
    return toxicity.score(docs, index).select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.label_weights(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), weights)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    return langid.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digest(spotsigs.edited_pairs(table(spark, sf_dir, "documents")))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


OPERATORS = (op1_media, op2_toxicity, op3_packing, op4_mixing, op5_langid, op6_quality, op7_minhash, op8_spotsigs, op9_html, op10_secrets)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


#: The dynamic program over the histogram, one bucket more a step; ranks of a bucket in the order of its shards.
_OP3 = r"""
    WITH RECURSIVE t AS (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
    p AS (SELECT doc_id, n_tokens, CAST(unnest(range(0, greatest((n_tokens + {max_len} - 1) // {max_len}, 1))) AS INTEGER) AS piece FROM t),
    q AS (SELECT *, CAST(piece AS BIGINT) * {max_len} AS start, least({max_len}, n_tokens - CAST(piece AS BIGINT) * {max_len}) AS length FROM p),
    g AS (SELECT length AS l, count(*) AS n FROM q WHERE length > 0 GROUP BY length),
    h AS (SELECT l, row_number() OVER (ORDER BY l) AS j, CAST(sum(n) OVER (ORDER BY l) AS BIGINT) AS rows, CAST(sum(n * l) OVER (ORDER BY l) AS BIGINT) AS tokens FROM g),
    m AS (SELECT least({buckets}, count(*)) AS k, max(j) AS last, greatest(1, (max(rows) + {shard_rows} - 1) // {shard_rows}) AS shards FROM h),
    d(k, j, cost, bounds) AS (SELECT 1, j, l * rows - tokens, [l] FROM h
        UNION ALL SELECT k, j, min(cost), arg_min(bounds, cost * 4096 + i) FROM (
            SELECT d.k + 1 AS k, b.j, a.j AS i, d.cost + b.l * (b.rows - a.rows) - (b.tokens - a.tokens) AS cost, list_append(d.bounds, b.l) AS bounds
            FROM d JOIN h a ON a.j = d.j JOIN h b ON b.j > a.j WHERE d.k < (SELECT k FROM m)) GROUP BY k, j),
    o AS (SELECT d.bounds, m.shards FROM d JOIN m ON d.k = m.k AND d.j = m.last),
    c AS (SELECT q.*, CASE WHEN length > 0 THEN len(list_filter(bounds, lambda b: b < length)) END AS bucket, bounds,
        floor((CAST(CAST('0x' || substr(md5('3:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || piece), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 * shards) AS shard FROM q LEFT JOIN o ON true),
    r AS (SELECT *, bounds[bucket + 1] AS bucket_len, row_number() OVER (PARTITION BY bucket ORDER BY shard, doc_id NULLS FIRST, piece, n_tokens) - 1 AS rank FROM c)
    SELECT doc_id, n_tokens, piece, start, length, CAST(bucket AS INTEGER) AS bucket, CAST(bucket_len AS INTEGER) AS bucket_len,
        CASE WHEN length > 0 THEN CAST(rank // greatest({budget} // bucket_len, 1) AS BIGINT) END AS batch FROM r"""

#: Exact keys, water-filling by windows, and one prefix sum a source.
_OP4 = r"""
    WITH q AS (SELECT doc_id, min(CASE quality WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 END) AS w FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        -ln((CAST(CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / coalesce(q.w, 1.0) AS key
        FROM documents LEFT JOIN q USING (doc_id)),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (ARRAY[5.0, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight FROM d GROUP BY source),
    f AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total,
        coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
        sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s),
    l AS (SELECT *, max(CASE WHEN cap / weight >= (total - spent) / open THEN (total - spent) / open END) OVER () AS level FROM f),
    t AS (SELECT source, source_size, least(cap, coalesce(weight * level, cap)) AS target FROM l),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
    r AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
        FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
    c AS (SELECT *, epochs + CASE WHEN rest > 0 AND size > 0 AND prefix - size / 2.0 <= rest THEN 1 ELSE 0 END AS copies FROM r)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM c"""

#: All pairs that share a shingle, and the closure of the links.
_OP7 = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
    r(doc, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc, l.y FROM r JOIN links l ON l.x = r.seen),
    m AS (SELECT doc, min(seen) AS component_id FROM r GROUP BY doc)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc = d.doc_id"""

#: Chains by index of the content words; texts and edited texts side by side.
_OP8 = r"""
    WITH o AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id, text) AS pos, count(*) OVER () AS total FROM documents),
    p AS (SELECT a.doc_id, a.pos, a.n, a.pos % a.total + 1 AS after, a.text, substr(a.text, 1, a.n - a.n // 2) || substr(b.text, 1, a.n // 2) AS edited FROM o a JOIN o b ON b.pos = a.pos % a.total + 1),
    x AS (SELECT pos, false AS is_edited, text FROM p UNION ALL SELECT pos, true, edited FROM p),
    w AS (SELECT pos, is_edited, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM x),
    c AS (SELECT *, list_filter(ws, lambda w: NOT list_contains([{common}], w)) AS content, list_filter(list_transform(ws, lambda w, i: CASE WHEN list_contains([{common}], w) THEN i - 1 END), lambda i: i IS NOT NULL) AS anchors FROM w),
    f AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(anchors, lambda i, a: CASE WHEN i - a + 3 <= len(content) THEN ws[i + 1] || ' ' || content[i - a + 2] || ' ' || content[i - a + 3] END), lambda s: s IS NOT NULL))) AS main,
        list_sort(list_distinct(list_filter(list_concat([CASE WHEN len(content) >= 2 THEN '^ ' || content[1] || ' ' || content[2] END], list_transform(content, lambda w, i: CASE WHEN md5(w) < '2' AND i + 2 <= len(content) THEN w || ' ' || content[i + 1] || ' ' || content[i + 2] END)), lambda s: s IS NOT NULL))) AS hashed FROM c),
    g AS (SELECT pos, is_edited, CASE WHEN len(main) > 0 THEN main WHEN len(hashed) > 0 THEN hashed WHEN len(ws) > 0 THEN ['^^ ' || array_to_string(ws, ' ')] ELSE [] END AS sigs FROM f),
    r AS (SELECT p.doc_id, p.n, p.edited, a.sigs AS a, e.sigs AS e, b.sigs AS b FROM p JOIN g a ON a.pos = p.pos AND NOT a.is_edited JOIN g e ON e.pos = p.pos AND e.is_edited JOIN g b ON b.pos = p.after AND NOT b.is_edited)
    SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, len(a) || '-' || sha256(array_to_string(a, ',')) AS fingerprint, len(e) || '-' || sha256(array_to_string(e, ',')) AS edited_fingerprint,
        {near_e}::DOUBLE AS near_edited, {near_b}::DOUBLE AS near_next FROM r"""


def _near_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    apart = f"least(len({a}), len({b})) < {spotsigs.LEAST} * greatest(len({a}), len({b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1 WHEN len({a}) = 0 OR len({b}) = 0 OR {apart} THEN 0 ELSE {both} / (len({a}) + len({b}) - {both}) END"


def _op8() -> str:
    common = ", ".join(f"'{w}'" for w in sorted(set(spotsigs.ANCHORS)))
    return _OP8.replace("{common}", common).replace("{near_e}", _near_sql("a", "e")).replace("{near_b}", _near_sql("a", "b"))


def _op3() -> str:
    sizes = {"max_len": packing.MAX_LEN, "buckets": packing.BUCKETS, "shard_rows": packing.SHARD_ROWS, "budget": packing.BUDGET}
    return reduce(lambda sql, x: sql.replace(f"{{{x[0]}}}", str(x[1])), sizes.items(), _OP3)


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator: fitted models and digests of images it can't."""
    found = {"op3_packing": _op3(), "op4_mixing": _OP4, "op7_minhash": _OP7, "op8_spotsigs": _op8()}
    return {name: " ".join(sql.split()) for name, sql in found.items()}
