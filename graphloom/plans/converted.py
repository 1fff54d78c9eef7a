"""Registered queries that run the whole conversion over exchange files rendered from `part` and `supplier`.

Eight files of a small schema of our own: suppliers are instances with two scalars, parts are instances with a scalar,
a reference, an enumeration, a typed select, a list, a list of lists and a boolean; one statement a file holds a set and
a list of references. Files 0 to 2 convert; 3 has a dangling reference; 4 an unknown name, which ends it there; 5
values behind the last slot; 6 a reference to an unknown name; the schema of 7 is none. The SQL states what
comes out: it lists the nodes and literals of a statement in the order in which they take ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.convert import Conversion
from graphloom.plans.registry import query
from graphloom.sources.express import EXPRESS_NS, LIST_NS, parse_express
from graphloom.sources.spf import assemble, schemas

FILES = 8
BASE = "http://example.org/r/"
NAME = "IFC4_ADD2_TC1"
SCHEMA = """
SCHEMA SHOP;
TYPE Label = STRING; END_TYPE;
TYPE Amount = REAL; END_TYPE;
TYPE Flag = BOOLEAN; END_TYPE;
TYPE State = ENUMERATION OF (O, F, P); END_TYPE;
TYPE Value = SELECT (Label, Amount); END_TYPE;
ENTITY Thing; Name : OPTIONAL Label; END_ENTITY;
ENTITY Seller SUBTYPE OF (Thing); Balance : OPTIONAL Amount; END_ENTITY;
ENTITY Good SUBTYPE OF (Thing);
  Source : Seller;
  Status : State;
  Worth : Value;
  Sizes : LIST [1:?] OF Amount;
  Pairs : LIST [1:?] OF LIST [1:?] OF Amount;
  Open : Flag;
END_ENTITY;
ENTITY Bundle; Goods : SET [1:?] OF Good; Ranked : LIST [1:?] OF Good; END_ENTITY;
END_SCHEMA;
"""
CATALOG = parse_express(SCHEMA, NAME)


def _text(*parts: Column | str | int) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, block, row, part, line) of the rendered files; a statement of a part has two lines."""
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    goods = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size", (p % FILES).alias("n"))
    sellers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", (s % FILES).alias("n"))
    a, b = _text(p % 7, ".5"), _text(p % 5, ".25")
    worth = F.when(p % 2 == 0, _text("LABEL('P", p % 50, "')")).otherwise(_text("AMOUNT(", p % 60, ".75)"))
    status = F.when(p % 17 == 0, "X").otherwise(F.element_at(F.array(*map(F.lit, "OFP")), (F.col("p_size") % 3 + 1).cast("int")))
    flag = F.when(p % 11 == 0, ".x.").when(p % 3 == 0, ".F.").otherwise(".T.")
    head = _text("#", 2 * p + 3, "= GOOD('", F.col("p_brand"), "',#", 2 * (F.col("n") + 1), ",")
    rest = _text("  .", status, ".,", worth, ",(", a, ",", b, "),((", a, ",", b, "),(", b, ")),", flag, "); ")
    of_good = goods.select("n", F.posexplode(F.array(head, rest)).alias("k", "line"), (2 * p + 3).alias("at")).select("n", (F.col("at") * 2 + F.col("k")).alias("row"), "line")
    name = F.when(s % 10 == 0, "$").otherwise(_text("'", F.col("s_name"), "'"))
    entity = F.when(F.col("n") == 6, "NOTHING").otherwise("SELLER")
    of_seller = sellers.select("n", (4 * s + 4).alias("row"), _text("#", 2 * s + 2, "= ", entity, "(", name, ",", s % 97, ".5", F.when(s % 5 == 0, ",'more'").otherwise(""), ");").alias("line"))
    first = _first_three(goods)
    listed = F.array_join(F.transform("refs", lambda x: _text("#", x)), ",")
    bundle = first.select("n", F.lit(2).alias("row"), _text("#1= BUNDLE((", listed, F.when(F.col("n") == 3, ",#0").when(F.col("n") == 6, ",#14").otherwise(""), "),(", listed, "));").alias("line"))
    names = F.when(F.col("n") == 7, "OTHER").otherwise("IFC4")
    header = first.select("n", F.lit(-1).alias("row"), _text("FILE_SCHEMA(('", names, "'));").alias("line"))
    odd = spark.createDataFrame([(4, 2 * 501, "#501= NOTHING(1);"), (5, 2 * 3, "#3= BUNDLE((#13),(#13),(1,2));")], "n long, row long, line string")
    found = header.unionByName(bundle).unionByName(of_seller).unionByName(of_good).unionByName(odd)
    return found.select(_text("f", F.col("n")).alias("file"), F.lit(0).alias("block"), F.col("row").cast("long").alias("row"), F.lit(0).alias("part"), "line")


def _first_three(goods: DataFrame) -> DataFrame:
    """(n, refs): line numbers of the second to fourth part of each file, by partial aggregates."""
    p = F.col("p_partkey")
    each = [F.min(F.when(F.floor(p / FILES) == k, 2 * p + 3)).alias(f"ref{k}") for k in (1, 2, 3)]
    return goods.groupBy("n").agg(*each).select("n", F.array("ref1", "ref2", "ref3").alias("refs"))


def conversion(spark: SparkSession, sf_dir: str) -> Conversion:
    made = lines(spark, sf_dir)
    return Conversion(assemble(made), schemas(made), {NAME: CATALOG}, BASE)


# The same in SQL: statements, files that convert, and what takes ids in order (line, k).
_FILES_SQL = """
    g AS (SELECT p_partkey AS p, p_brand AS name, p_size AS size, p_partkey % 8 AS n, 2 * p_partkey + 3 AS line, (p_partkey % 7) || '.5' AS a, (p_partkey % 5) || '.25' AS b,
        CASE WHEN p_partkey % 17 = 0 THEN 'X' ELSE substr('OFP', CAST(p_size % 3 + 1 AS INTEGER), 1) END AS status,
        CASE WHEN p_partkey % 2 = 0 THEN 'P' || (p_partkey % 50) ELSE (p_partkey % 60) || '.75' END AS worth,
        CASE WHEN p_partkey % 11 = 0 THEN '.x.' WHEN p_partkey % 3 = 0 THEN '.F.' ELSE '.T.' END AS flag FROM part),
    s AS (SELECT s_suppkey AS s, s_name AS name, s_suppkey % 8 AS n, 2 * s_suppkey + 2 AS line, (s_suppkey % 97) || '.5' AS balance FROM supplier),
    files AS (SELECT n, CASE n WHEN 3 THEN 'DANGLING' WHEN 5 THEN 'FAILED' WHEN 6 THEN 'FAILED' WHEN 7 THEN 'UNKNOWN_SCHEMA' ELSE 'OK' END AS state,
        CASE n WHEN 4 THEN 501 WHEN 6 THEN (SELECT min(line) FROM s WHERE n = 6) END AS cutoff FROM (SELECT DISTINCT n FROM g))"""
_TAKES_SQL = f"""{_FILES_SQL},
    ok AS (SELECT * FROM files WHERE state = 'OK'),
    people AS (SELECT n, line, 'Seller' AS cls FROM s UNION ALL SELECT n, line, 'Good' FROM g UNION ALL SELECT n, 1, 'Bundle' FROM files UNION ALL SELECT 4, 501, 'NOTHING'),
    seed AS (SELECT n, greatest(count(*), max(line)) + 1 AS seed FROM people GROUP BY n),
    live AS (SELECT people.n, line, cls FROM people JOIN ok ON ok.n = people.n WHERE cutoff IS NULL OR line < cutoff),
    k(k, kind, cls, col, sub, pred) AS (VALUES
        (0, 'literal', 'Label', 'name', NULL, '*name_Thing'), (3, 'literal', '', 'worth', NULL, '*worth_Good'), (10, 'node', 'Amount_List', '', NULL, '*sizes_Good'), (11, 'node', 'Amount_List', '', 10, '+hasNext'),
        (12, 'literal', 'Amount', 'a', 10, '+hasContents'), (13, 'literal', 'Amount', 'b', 11, '+hasContents'), (20, 'node', 'Amount_List', '', 26, '+hasContents'), (21, 'node', 'Amount_List', '', 20, '+hasNext'),
        (22, 'literal', 'Amount', 'a', 20, '+hasContents'), (23, 'literal', 'Amount', 'b', 21, '+hasContents'), (24, 'node', 'Amount_List', '', 27, '+hasContents'), (25, 'literal', 'Amount', 'b', 24, '+hasContents'),
        (26, 'node', 'Amount_List_List', '', NULL, '*pairs_Good'), (27, 'node', 'Amount_List_List', '', 26, '+hasNext'), (30, 'literal', 'Flag', 'flag', NULL, '*open_Good')),
    takes AS (
        SELECT n, line, k, kind, CASE WHEN col = 'worth' THEN CASE WHEN p % 2 = 0 THEN 'Label' ELSE 'Amount' END ELSE cls END AS cls,
            CASE col WHEN 'name' THEN name WHEN 'worth' THEN worth WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'flag' THEN flag END AS lexical, sub, pred FROM g CROSS JOIN k
        UNION ALL SELECT n, line, 0, 'literal', 'Label', name, NULL, '*name_Thing' FROM s WHERE s % 10 <> 0
        UNION ALL SELECT n, line, 1, 'literal', 'Amount', balance, NULL, '*balance_Seller' FROM s
        UNION ALL SELECT n, 1, i, 'node', 'Good_List', NULL, CASE WHEN i > 1 THEN i - 1 END, CASE WHEN i > 1 THEN '+hasNext' ELSE '*ranked_Bundle' END FROM files CROSS JOIN (VALUES (1), (2), (3)) AS t(i)),
    due AS (SELECT t.*, CASE WHEN kind = 'literal' THEN CASE t.cls WHEN 'Label' THEN 'string' WHEN 'Amount' THEN 'double' ELSE 'boolean' END END AS xsd FROM takes t JOIN live ON live.n = t.n AND live.line = t.line),
    fresh AS (SELECT *, kind = 'node' OR row_number() OVER (PARTITION BY n, kind, xsd, lexical ORDER BY line, k) = 1 AS fresh FROM due),
    upto AS (SELECT fresh.*, seed.seed - 1 + sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY fresh.n ORDER BY line, k) AS own FROM fresh JOIN seed ON seed.n = fresh.n),
    numbered AS (SELECT *, CAST(CASE WHEN kind = 'node' THEN own ELSE first_value(own) OVER (PARTITION BY n, kind, xsd, lexical ORDER BY line, k) END AS BIGINT) AS id FROM upto)"""


@query(f"WITH {_FILES_SQL} SELECT 'f' || n AS file, CASE WHEN n = 7 THEN '' ELSE '{NAME}' END AS schema, state, CAST(cutoff AS BIGINT) AS cutoff FROM files")
def convert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion(spark, sf_dir).status


@query(f"""
    WITH {_FILES_SQL},
    said AS (
        SELECT n, line, 'ERROR 4' AS code FROM s WHERE s % 5 = 0 AND n <> 6 AND n <> 7 UNION ALL SELECT n, line, 'ERROR 2' FROM s WHERE n = 6 UNION ALL SELECT 4, 501, 'ERROR 2'
        UNION ALL SELECT n, line, 'ERROR 9' FROM g WHERE p % 17 = 0 AND n <> 7 UNION ALL SELECT n, line, 'WARNING 10' FROM g WHERE p % 11 = 0 AND n <> 7
        UNION ALL SELECT 3, 1, 'ERROR 7' UNION ALL SELECT 5, 3, 'FAILED' UNION ALL SELECT n, NULL, state FROM files WHERE state <> 'OK')
    SELECT 'f' || n AS file, CAST(line AS BIGINT) AS line_num, code, CASE WHEN code LIKE 'WARNING%' THEN 'warning' ELSE 'error' END AS severity FROM said""")
def convert_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion(spark, sf_dir).diagnostics.select("file", "line_num", "code", "severity")


@query(f"WITH {_TAKES_SQL} SELECT 'f' || n AS file, CAST(line AS BIGINT) AS line_num, kind, cls, xsd, lexical, id, fresh FROM numbered")
def convert_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion(spark, sf_dir).numbered.select("file", "line_num", "kind", "cls", "xsd", "lexical", "id", "fresh")


_RDF, _OWL, _XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"


@query(f"""
    WITH {_TAKES_SQL},
    iris AS (SELECT *, '{BASE}' || cls || '_' || id AS iri FROM numbered),
    named AS (SELECT n, line, '{BASE}' || cls || '_' || line AS iri, cls FROM live),
    refs AS (SELECT n, line AS ref, p // 8 AS i FROM g WHERE p // 8 BETWEEN 1 AND 3),
    t(n, subject, predicate, object, object_kind, datatype) AS (
        SELECT n, '{BASE}', '{_RDF}type', '{_OWL}Ontology', 'iri', NULL FROM ok UNION ALL SELECT n, '{BASE}', '{_OWL}imports', '{CATALOG.namespace}', 'iri', NULL FROM ok
        UNION ALL SELECT n, iri, '{_RDF}type', '{CATALOG.namespace}' || cls, 'iri', NULL FROM named
        UNION ALL SELECT n, iri, '{_RDF}type', '{CATALOG.namespace}' || cls, 'iri', NULL FROM iris WHERE fresh
        UNION ALL SELECT n, iri, '{EXPRESS_NS}has' || upper(substr(xsd, 1, 1)) || substr(xsd, 2), CASE WHEN xsd <> 'boolean' THEN lexical WHEN lexical = '.T.' THEN 'true' ELSE 'false' END, 'literal', '{_XSD}' || xsd
            FROM iris WHERE fresh AND kind = 'literal' AND lexical <> '.x.'
        UNION ALL SELECT i.n, coalesce(o.iri, named.iri), CASE WHEN i.pred LIKE '+%' THEN '{LIST_NS}' ELSE '{CATALOG.namespace}' END || substr(i.pred, 2), i.iri, 'iri', NULL
            FROM iris i JOIN named ON named.n = i.n AND named.line = i.line LEFT JOIN iris o ON o.n = i.n AND o.line = i.line AND o.k = i.sub
        UNION ALL SELECT g.n, named.iri, '{CATALOG.namespace}source_Good', '{BASE}Seller_' || (2 * (g.n + 1)), 'iri', NULL FROM g JOIN named ON named.n = g.n AND named.line = g.line
        UNION ALL SELECT g.n, named.iri, '{CATALOG.namespace}status_Good', '{CATALOG.namespace}' || status, 'iri', NULL FROM g JOIN named ON named.n = g.n AND named.line = g.line WHERE status <> 'X'
        UNION ALL SELECT refs.n, '{BASE}Bundle_1', '{CATALOG.namespace}goods_Bundle', '{BASE}Good_' || ref, 'iri', NULL FROM refs JOIN ok ON ok.n = refs.n
        UNION ALL SELECT refs.n, i.iri, '{LIST_NS}hasContents', '{BASE}Good_' || ref, 'iri', NULL FROM refs JOIN iris i ON i.n = refs.n AND i.line = 1 AND i.k = refs.i)
    SELECT DISTINCT 'f' || n AS file, subject, predicate, object, object_kind, datatype FROM t""")
def convert_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion(spark, sf_dir).graph()
