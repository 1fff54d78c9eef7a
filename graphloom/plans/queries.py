"""Registered queries: every operator of the engine over the synthetic tables, with its SQL oracle.

A query is a function (spark, sf_dir) -> DataFrame decorated with `query(sql)`; the SQL runs on the same tables
and gives the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import lexical
from graphloom.operators import closure, graphs, ids, lists, resolve
from graphloom.operators.tokens import instances, tokens
from graphloom.plans import converted, registry  # noqa: F401  converted registers its queries
from graphloom.plans.registry import Query, query
from graphloom.sources.express import recognised
from graphloom.sources.spf import assemble

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    WITH l AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '#' ELSE ' ' END || translate(text, ';' || chr(10) || chr(13), ',  ') || CASE role WHEN 'assistant' THEN ';' ELSE '' END AS line FROM conversations),
    s AS (SELECT *, coalesce(sum(CASE WHEN contains(line, ';') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM l),
    b AS (SELECT *, max(CASE WHEN line LIKE '#%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, seg ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS begun FROM s)
    SELECT conv_id, CAST(seg AS BIGINT) AS ord, string_agg(trim(line), '' ORDER BY turn) AS text FROM b WHERE begun = 1 GROUP BY conv_id, seg""")
def statement_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _table(spark, sf_dir, "conversations")
    line = F.concat(F.when(F.col("role") == "user", "#").otherwise(" "), F.translate("text", ";\n\r", ",  "), F.when(F.col("role") == "assistant", ";").otherwise(""))
    return assemble(talk.select("conv_id", "turn", line.alias("line")), ("conv_id",), ("turn",))


@query("""
    SELECT p_partkey, CASE WHEN contains(h, 'IFC2X3') THEN 'IFC2X3_TC1' WHEN contains(h, 'IFC4x3') OR contains(h, 'IFC4X3') THEN 'IFC4x3_RC1'
        WHEN contains(h, 'IFC4x1') OR contains(h, 'IFC4X1') THEN 'IFC4x1' WHEN contains(h, 'IFC4') THEN 'IFC4_ADD2_TC1' ELSE '' END AS schema
    FROM (SELECT p_partkey, 'FILE_SCHEMA((''' || CASE p_size % 6 WHEN 0 THEN 'IFC2X3' WHEN 1 THEN 'IFC4X3_RC1' WHEN 2 THEN 'IFC4X1' WHEN 3 THEN 'IFC4X2' WHEN 4 THEN 'IFC4' ELSE p_type END || '''));' AS h FROM part)""")
def schema_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_type")
    for i, known in enumerate(("IFC2X3", "IFC4X3_RC1", "IFC4X1", "IFC4X2", "IFC4")):
        name = F.when(F.col("p_size") % 6 == i, known).otherwise(name)
    header = F.concat(F.lit("FILE_SCHEMA(('"), name, F.lit("'));"))
    return _table(spark, sf_dir, "part").select("p_partkey", lexical.sniff_schema(header).alias("schema"))


_SCHEMAS = ("ifc2x3_final", "IFC2X3_TC1", "IFC4", "Ifc4_Add1", "IFC4_ADD2", "IFC4_ADD2_TC1", "IFC4X1", "IFC4x3_RC1", "IFC4x2", "")


@query(f"""
    SELECT p_partkey, schema, lower(schema) IN ('ifc2x3_final', 'ifc2x3_tc1', 'ifc4', 'ifc4_add1', 'ifc4_add2', 'ifc4_add2_tc1', 'ifc4x1', 'ifc4x3_rc1') AS recognised
    FROM (SELECT p_partkey, CASE WHEN p_size % 11 = 10 THEN p_type ELSE {list(_SCHEMAS)}[CAST(p_size % 11 + 1 AS INTEGER)] END AS schema FROM part)""")
def schema_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.get(F.array(*map(F.lit, _SCHEMAS)), (F.col("p_size") % 11).cast("int"))
    named = _table(spark, sf_dir, "part").select("p_partkey", F.coalesce(listed, "p_type").alias("schema"))
    return named.withColumn("recognised", recognised("schema"))


def _part_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.regexp_replace("p_name", " ", "','")
    text = F.concat(F.lit("#"), F.col("p_partkey").cast("string"), F.lit("= PART('"), names, F.lit("',("), F.col("p_size").cast("string"), F.lit(",$),#"), F.col("p_size").cast("string"), F.lit(");"))
    return _table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("ord"), text.alias("text"))


@query("""
    WITH w AS (SELECT p_brand AS file, p_partkey AS line_num, p_size, string_split(p_name, ' ') AS words FROM part)
    SELECT file, line_num, CAST(i - 1 AS VARCHAR) AS path, 1 AS depth, 'literal' AS kind, chr(39) || words[i] AS lexeme, CAST(NULL AS BIGINT) AS ref_line FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM w)
    UNION ALL SELECT file, line_num, CAST(len(words) AS VARCHAR), 1, 'list', NULL, NULL FROM w
    UNION ALL SELECT file, line_num, CAST(len(words) AS VARCHAR) || '.0', 2, 'literal', CAST(p_size AS VARCHAR), NULL FROM w
    UNION ALL SELECT file, line_num, CAST(len(words) AS VARCHAR) || '.1', 2, 'null_marker', '$', NULL FROM w
    UNION ALL SELECT file, line_num, CAST(len(words) + 1 AS VARCHAR), 1, 'ref', '#' || p_size, CAST(p_size AS BIGINT) FROM w""")
def tokenize_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(_part_statements(spark, sf_dir)).withColumn("path", F.array_join("path", "."))


@query("""
    SELECT p_brand AS file, p_partkey AS ord, p_partkey AS line_num, 'PART' AS name, ' PART(''' || replace(p_name, ' ', ''',''') || ''',(' || p_size || ',$),#' || p_size || ');' AS raw FROM part""")
def statement_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances(_part_statements(spark, sf_dir)).drop("text")


@query("""
    SELECT page_id, CASE WHEN strpos(url, '=') > 0 THEN substr(url, strpos(url, '=') + 1) ELSE url END AS raw,
        coalesce(try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT), -9223372036854775808) AS number FROM pages""")
def raw_after_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.locate("=", F.col("url")) > 0, F.expr("substring(url, locate('=', url) + 1)")).otherwise(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), lexical.to_long(F.regexp_extract("url", "/([0-9]+)", 1)).alias("number"))


@query("""
    SELECT doc_id, CAST(least(len(string_split(text, chr(10))), 4) AS BIGINT) AS kept, CAST(greatest(len(string_split(text, chr(10))) - 4, 0) AS BIGINT) AS overflow FROM documents""")
def arity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the SQL's least and greatest skip nulls: a null text fills all 4 slots
    values = F.coalesce(F.split("text", "\n"), F.array_repeat(F.lit(""), 4))
    slots = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(values).alias("slot", "value"))
    fits = F.col("slot") < 4
    return slots.groupBy("doc_id").agg(F.count(F.when(fits, 1)).alias("kept"), F.count(F.when(~fits, 1)).alias("overflow"))


@query("SELECT doc_id, md5(replace(replace(text, '''', ''), '=', '')) AS digest, CAST(length(replace(replace(text, '''', ''), '=', '')) AS BIGINT) AS n FROM documents")
def filter_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = lexical.strip_extras("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(plain.cast("binary")).alias("digest"), F.length(plain).cast("long").alias("n"))


@query("SELECT page_id, replace(url, '.', '') AS plain FROM pages")
def filter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", lexical.strip_points("url").alias("plain"))


@query("SELECT event_id, trim(event_type) AS kind, upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS capital, 'http://e/' || event_type || '_' || event_id AS iri, 'has' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS property, substr(event_type || '_List', 1, length(event_type)) AS element FROM events")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _table(spark, sf_dir, "events").select(
        "event_id",
        lexical.trim_control(F.concat(F.lit(" \t"), kind, F.lit("\n"))).alias("kind"),
        lexical.capitalised(kind).alias("capital"),
        lexical.iri(F.lit("http://e/"), kind, "event_id").alias("iri"),
        lexical.value_property(kind).alias("property"),
        lexical.strip_list_suffix(F.concat(kind, F.lit("_List"))).alias("element"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def ref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey")


@query("""
    WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents)
    SELECT l.doc_id AS label_id, coalesce(c.canonical, l.doc_id) AS ref FROM labels l LEFT JOIN c ON c.doc_id = l.doc_id AND c.canonical <> c.doc_id""")
def ref_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = resolve.canonical(_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("same")), ["same"], "doc_id").where("doc_id != canonical")
    refs = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), F.col("doc_id").alias("ref"))
    return resolve.redirect(refs, "ref", renamed.select("doc_id", "canonical"), "doc_id", "canonical")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def ref_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = _table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return resolve.dangling(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", large, "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def file_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bad = _table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return resolve.abort_groups(orders, bad, ["o_orderkey"])


@query("SELECT n_nationkey, coalesce(e.r_name, 'TYPE_' || t.r_name) AS cls FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 2) e ON e.r_regionkey = n_regionkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 4) t ON t.r_regionkey = n_regionkey")
def class_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = _table(spark, sf_dir, "region")
    entity = regions.where("r_regionkey < 2").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("entity"))
    kind = regions.where("r_regionkey < 4").select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("TYPE_"), "r_name").alias("type"))
    found = _table(spark, sf_dir, "nation").join(F.broadcast(entity), "n_regionkey", "left").join(F.broadcast(kind), "n_regionkey", "left")
    return found.select("n_nationkey", F.coalesce("entity", "type").alias("cls"))


_SLOTS = ((1, "name_Root", "Label"), (2, "owner_Root", "Person"), (3, "points_Curve", "Point_List"), (5, "kind_Curve", "KindEnum"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, property, range_class FROM lineitem JOIN (VALUES {', '.join(str(x) for x in _SLOTS)}) c(pos, property, range_class) ON l_linenumber = pos")
def attribute_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.createDataFrame(list(_SLOTS), "l_linenumber int, property string, range_class string")
    return _table(spark, sf_dir, "lineitem").join(F.broadcast(catalog), "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "property", "range_class")


_LABELS = (("P", "http://e/PENDING"), ("F", "http://e/FINISHED"))


def _by_label(spark: SparkSession, df: DataFrame, lexeme: str, labels: tuple, how: str) -> DataFrame:
    known = spark.createDataFrame(list(labels), "label string, individual string")
    return df.withColumn("label", F.upper(lexical.strip_points(lexeme))).join(F.broadcast(known), "label", how)


@query(f"SELECT o_orderkey, individual FROM orders JOIN (VALUES {', '.join(str(x) for x in _LABELS)}) c(label, individual) ON upper(replace('.' || lower(o_orderstatus) || '.', '.', '')) = label")
def enum_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _table(spark, sf_dir, "orders").withColumn("lexeme", F.concat(F.lit("."), F.lower("o_orderstatus"), F.lit(".")))
    return _by_label(spark, marked, "lexeme", _LABELS, "inner").select("o_orderkey", "individual")


@query("SELECT event_id, event_type FROM events WHERE upper(event_type) NOT IN ('VIEW', 'CLICK', 'SIGNUP')")
def enum_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = tuple((x, x) for x in ("VIEW", "CLICK", "SIGNUP"))
    return _by_label(spark, _table(spark, sf_dir, "events"), "event_type", labels, "left_anti").select("event_id", "event_type")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents")
def dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("same"))
    return resolve.canonical(docs, ["same"], "doc_id").select("doc_id", "canonical")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS i FROM documents) WHERE i = 1")
def dedup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("same"))
    return resolve.survivors(docs, ["same"], "doc_id").select("doc_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return resolve.last_wins(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""
    SELECT l_returnflag, l_linestatus, quantity, l_orderkey, l_linenumber, l_partkey, dense_rank() OVER (ORDER BY l_returnflag, l_linestatus, quantity) AS node FROM (
        SELECT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS quantity, l_orderkey, l_linenumber, l_partkey,
            row_number() OVER (PARTITION BY l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem) WHERE i = 1""")
def literal_intern(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    items = _table(spark, sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("long"))
    keys, order = ["l_returnflag", "l_linestatus", "quantity"], ["l_orderkey", "l_linenumber", "l_partkey"]
    # one row a distinct literal is left when they are numbered
    return ids.first_of(items, keys, order, order).withColumn("node", F.dense_rank().over(Window.orderBy(*keys)).cast("long"))


@query("SELECT o_orderstatus, greatest(count(*), max(o_orderkey)) + 1 AS seed FROM orders GROUP BY o_orderstatus")
def id_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.seed(_table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderkey")


@query("""
    SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, takes, CAST(sum(takes) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
    FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS takes FROM lineitem)""")
def id_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").withColumn("takes", (F.col("l_linestatus") == "O").cast("int"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    summed = ids.running(items, ["l_returnflag"], F.floor(F.col("l_orderkey") / 4096), order, "takes", "upto")
    return summed.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "takes", "upto")


@query("SELECT l_suppkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_suppkey")
def type_triple_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("first_order"), "l_linenumber")
    return ids.first_of(items, ["l_suppkey"], ["first_order", "l_linenumber"], ["first_order"])


_NATION_TRIPLES = """
    SELECT 'nation_' || n_nationkey AS subject, 'type' AS predicate, 'Nation' AS object FROM nation
    UNION ALL SELECT 'nation_' || n_nationkey, 'name', n_name FROM nation
    UNION ALL SELECT 'nation_' || n_nationkey, 'region', 'region_' || r_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'region_' || r_regionkey, 'type', 'Region' FROM region
    UNION ALL SELECT 'region_' || r_regionkey, 'name', r_name FROM region"""


@query(_NATION_TRIPLES)
def triples_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, nations = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    at = lambda kind, key: lexical.iri(F.lit(""), F.lit(kind), key)
    joined = nations.join(F.broadcast(regions), nations["n_regionkey"] == regions["r_regionkey"], "left")
    first = graphs.unpivot(joined, at("nation", "n_nationkey"), {"type": F.lit("Nation"), "name": F.col("n_name"), "region": at("region", "r_regionkey")})
    return first.unionByName(graphs.unpivot(regions, at("region", "r_regionkey"), {"type": F.lit("Region"), "name": F.col("r_name")}))


@query("""
    SELECT p_partkey, 'hasString' AS predicate, p_name AS lexical, 'string' AS datatype FROM part
    UNION ALL SELECT p_partkey, 'hasInteger', CAST(p_size AS VARCHAR), 'integer' FROM part
    UNION ALL SELECT p_partkey, 'hasBoolean', CASE p_size % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END, 'boolean' FROM part WHERE p_size % 3 < 2
    UNION ALL SELECT p_partkey, 'hasLogical', CASE p_size % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' ELSE 'UNKNOWN' END, 'logical' FROM part""")
def typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexeme = F.element_at(F.array(F.lit(".T."), F.lit(".f."), F.lit(".U.")), F.col("p_size") % 3 + 1)
    values = (("string", F.col("p_name")), ("integer", F.col("p_size").cast("string")), ("boolean", lexical.boolean_lexical(lexeme)), ("logical", lexical.logical_name(lexeme)))
    pairs = F.array(*[F.struct(lexical.value_property(F.lit(x)).alias("predicate"), v.alias("lexical"), F.lit(x).alias("datatype")) for x, v in values])
    return _table(spark, sf_dir, "part").select("p_partkey", F.explode(pairs).alias("x")).select("p_partkey", "x.*").where("lexical is not null")


@query("""
    SELECT vec_id, CAST(i AS INTEGER) AS node, CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) AS contents, CAST(CASE WHEN i < len(embedding) THEN i + 1 END AS INTEGER) AS next_node
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def list_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = lists.list_nodes(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nodes.withColumn("contents", F.floor(F.col("contents").cast("double") * 1000))


@query("""
    WITH x AS (SELECT o_custkey, o_orderkey, l_partkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) AS j, count(*) OVER (PARTITION BY o_orderkey) AS n,
        dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    y AS (SELECT *, max(i) OVER (PARTITION BY o_custkey) AS m FROM x)
    SELECT o_custkey, CAST(i AS INTEGER) AS outer_node, CAST(j AS INTEGER) AS inner_node, l_partkey AS contents, CAST(CASE WHEN j < n THEN j + 1 END AS INTEGER) AS next_inner, CAST(CASE WHEN i < m THEN i + 1 END AS INTEGER) AS next_outer FROM y""")
def list_of_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("parts"))
    items = items.select("l_orderkey", F.transform("parts", lambda x: x["l_partkey"]).alias("parts"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nested = orders.join(items, orders["o_orderkey"] == items["l_orderkey"]).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "parts"))).alias("orders"))
    return lists.nested_nodes(nested.select("o_custkey", F.transform("orders", lambda x: x["parts"]).alias("orders")), "o_custkey", "orders")


@query("SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def set_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.set_edges(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("""
    WITH RECURSIVE e AS (SELECT 'customer_' || c_custkey AS sub, 'nation_' || c_nationkey AS super FROM customer UNION SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation UNION SELECT 'region_' || r_regionkey, 'world' FROM region),
    up AS (SELECT sub, super FROM e UNION ALL SELECT up.sub, e.super FROM up JOIN e ON e.sub = up.super) SELECT DISTINCT sub, super FROM up""")
def class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda kind, key: F.concat(F.lit(kind + "_"), F.col(key).cast("string"))
    edges = _table(spark, sf_dir, "customer").select(at("customer", "c_custkey").alias("sub"), at("nation", "c_nationkey").alias("super"))
    edges = edges.union(_table(spark, sf_dir, "nation").select(at("nation", "n_nationkey"), at("region", "n_regionkey")))
    edges = edges.union(_table(spark, sf_dir, "region").select(at("region", "r_regionkey"), F.lit("world")))
    return closure.closure(edges, "sub", "super")


@query("SELECT 'base' AS subject, 'type' AS predicate, 'Ontology' AS object UNION ALL SELECT 'base', 'imports', 'ontology' UNION ALL SELECT 'region_' || r_regionkey, 'name', r_name FROM region")
def prolog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    prolog = graphs.constants(spark, [("base", "type", "Ontology"), ("base", "imports", "ontology")])
    return prolog.unionByName(graphs.unpivot(_table(spark, sf_dir, "region"), lexical.iri(F.lit(""), F.lit("region"), "r_regionkey"), {"name": F.col("r_name")}))


def _edges(spark: SparkSession, sf_dir: str, name: str, nation: str, key: str) -> DataFrame:
    return _table(spark, sf_dir, name).select(F.concat(F.lit("nation_"), F.col(nation).cast("string")).alias("subject"), F.lit("holds").alias("predicate"), (F.col(key) % 40).cast("string").alias("object"))


_A = "SELECT 'nation_' || c_nationkey AS subject, 'holds' AS predicate, CAST(c_custkey % 40 AS VARCHAR) AS object FROM customer"
_B = "SELECT 'nation_' || s_nationkey AS subject, 'holds' AS predicate, CAST(s_suppkey % 40 AS VARCHAR) AS object FROM supplier"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _edges(spark, sf_dir, "customer", "c_nationkey", "c_custkey"), _edges(spark, sf_dir, "supplier", "s_nationkey", "s_suppkey")


@query(f"{_A} UNION {_B}")
def graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.union(*_both(spark, sf_dir))


@query(f"{_A} INTERSECT {_B}")
def graph_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.intersect(*_both(spark, sf_dir))


@query(f"{_A} EXCEPT {_B}")
def graph_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.difference(*_both(spark, sf_dir))


@query(f"SELECT (SELECT count(*) FROM ({_A} EXCEPT ALL {_B})) AS only_left, (SELECT count(*) FROM ({_B} EXCEPT ALL {_A})) AS only_right")
def graph_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.compare(*_both(spark, sf_dir))


@query(f"""
    WITH t AS ({_NATION_TRIPLES}),
    o AS (SELECT *, row_number() OVER (ORDER BY object, subject, predicate) AS i FROM t),
    c AS (SELECT *, sum(CASE WHEN prev IS DISTINCT FROM subject THEN 1 ELSE 0 END) OVER (ORDER BY i) AS run FROM (SELECT *, lag(subject) OVER (ORDER BY i) AS prev FROM o))
    SELECT subject, min(object) AS first_object, subject || ' ' || string_agg(predicate || ' ' || object, ' ; ' ORDER BY i) || ' .' AS block FROM c GROUP BY subject, run""")
def turtle_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = triples_unpivot(spark, sf_dir).withColumn("graph", F.lit(0)).withColumn("subject_order", F.col("subject"))
    line = F.concat_ws(" ", "predicate", "object")
    blocks = graphs.blocks(triples, ["graph"], ["object", "subject_order", "predicate"], "subject", line)
    return blocks.select("subject", F.col("at.object").alias("first_object"), F.concat("subject", F.lit(" "), F.array_join("lines", " ; "), F.lit(" .")).alias("block"))


@query("SELECT CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicates FROM documents")
def diagnostics_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = _table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("same")).agg(F.count("*").alias("n"))
    return same.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def queries() -> dict[str, Query]:
    """Those of this module and of `converted`."""
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
