import pytest

from graphloom.functions import lexical
from graphloom.operators import graphs, ids, resolve
from graphloom.operators.tokens import split_statement, tokens
from graphloom.sources.express import parse_express
from graphloom.sources.spf import assemble
from pyspark.sql import functions as F

from mini import SCHEMA

CATALOG = parse_express(SCHEMA)


def test_catalog():
    assert CATALOG.schema == "MINI" and len(CATALOG.entities) == 14
    assert [a.property for a in CATALOG.attributes["SpecialUnit"]] == ["dimensions_Unit", "kind_Unit", "factor_SpecialUnit"]
    assert [a.property for a in CATALOG.attributes["Person"]] == ["name_Root", "family_Person", "given_Person"]
    assert CATALOG.attributes["PointList"][0].range_class == "Length_List_List"
    assert CATALOG.attributes["Assignment"][0].range_class == "Unit"
    assert CATALOG.xsd("PositiveLength") == "double" and CATALOG.xsd("Value") is None
    assert CATALOG.is_a("Angle", "OWLList") and CATALOG.content("Angle") == "INTEGER"
    assert CATALOG.content("Length_List_List") == "Length_List"
    assert CATALOG.label("UnitKind", ".Metre.") == "METRE" and CATALOG.label("UnitKind", ".MILE.") is None
    assert CATALOG.closure("SpecialUnit") == ["Unit"]


def test_catalog_tables(spark):
    attributes = CATALOG.attribute_table(spark)
    assert attributes.where("is_list").select("entity").distinct().count() == 7
    assert CATALOG.enum_table(spark).count() == 3
    assert CATALOG.entity_table(spark).where("name = 'Person'").first()["arity"] == 3
    assert CATALOG.type_table(spark).count() == len(CATALOG.types)
    assert {tuple(r) for r in CATALOG.closure_table(spark).where("sub = 'PositiveLength'").collect()} == {("PositiveLength", "Length"), ("PositiveLength", "REAL")}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("#1= A();", (1, "A", " A();", [])),
        ("# 1 2 =A B('x(y),''z',(#1,(2,3)),$);tail)", (12, "AB", "A B('x(y),''z',(#1,(2,3)),$);tail)", ["'x(y),'z", ["#1", ["2", "3"]], "$"])),
        ("#1=A(,,x,);", (1, "A", "A(,,x,);", ["x"])),
        ("#1=A;", (1, "A", "A;", [])),
        ("#1=A('open", (1, "A", "A('open", [])),
        ("#5 A()", (None, "", "5 A()", [])),
        ("#=A()", (-(1 << 63), "A", "A()", [])),
    ],
)
def test_split_statement(text, expected):
    assert split_statement(text) == expected


def test_tokens(spark):
    df = spark.createDataFrame([("f", "#1=A('x',(#2,.T.),LABEL($,*));")], "file string, text string")
    rows = [(list(r["path"]), r["kind"], r["lexeme"], r["ref_line"]) for r in tokens(df).collect()]
    assert rows == [([0], "literal", "'x", None), ([1], "list", None, None), ([1, 0], "ref", "#2", 2), ([1, 1], "literal", ".T.", None), ([2], "typename", "LABEL", None), ([3], "list", None, None), ([3, 0], "null_marker", "$", None), ([3, 1], "star", "*", None)]


def test_lexical(spark):
    row = spark.range(1).select(
        lexical.to_long(F.lit("x1")).alias("a"), lexical.to_long(F.lit("99999999999999999999")).alias("b"), lexical.to_long(F.lit("-12")).alias("c"),
        lexical.last_word(F.lit("LIST [1:2] OF Point;")).alias("d"), lexical.class_key(F.lit("Point")).alias("e"), lexical.logical_name(F.lit(".x.")).alias("f"),
        lexical.default_base(F.lit("2020-01-02 03:04:05").cast("timestamp")).alias("g"), lexical.sniff_schema(F.lit("FILE_SCHEMA(('ABC'));")).alias("h"),
    ).first()
    assert tuple(row) == (lexical.NO_NUMBER, lexical.NO_NUMBER, -12, "Point", "POINT", None, "http://example.org/resources20200102_030405/", "")


def test_assemble_unterminated(spark):
    lines = [(0, "DATA;"), (1, "#1=A("), (2, " 1"), (3, ");"), (4, "x"), (5, "#2=B("), (6, "'a")]
    df = spark.createDataFrame([("f", i, x) for i, x in lines], "file string, n int, line string")
    assert [r["text"] for r in assemble(df, ("file",), ("n",)).orderBy("ord").collect()] == ["#1=A(1);", "#2=B('a"]


def test_ids_running_matches_plain_sum(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id", "id % 2 as takes")
    got = {r["id"]: r["upto"] for r in ids.running(df, ["g"], F.floor(F.col("id") / 64), ["id"], "takes", "upto").collect()}
    sums = {0: 0, 1: 0, 2: 0}
    for i in range(1000):
        sums[i % 3] += i % 2
        assert got[i] == sums[i % 3]


def test_graph_algebra(spark):
    a = graphs.constants(spark, [("s", "p", "1"), ("s", "p", "1"), ("s", "p", "2")])
    b = graphs.constants(spark, [("s", "p", "2"), ("t", "p", "3")])
    assert graphs.union(a, b).count() == 3 and graphs.intersect(a, b).count() == 1 and graphs.difference(a, b).count() == 1
    assert tuple(graphs.compare(a, b).first()) == (2, 1)
    assert graphs.equal(a, a) and not graphs.equal(a, a.distinct())
    assert tuple(graphs.compare(a.limit(0), a.limit(0)).first()) == (0, 0)


def test_resolve(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 3)], "k int, v string, o int")
    assert {tuple(r) for r in resolve.last_wins(df, ["k"], ["o"]).collect()} == {(1, "y", 2), (2, "x", 3)}
    assert {r["o"] for r in resolve.survivors(df, ["v"], "o").collect()} == {1, 2}
