"""Null groups, cycles, and Turtle files that executors write."""

import glob

from graphloom.operators import closure, ids, resolve
from graphloom.plans.convert import convert
from graphloom.sources import sinks
from graphloom.sources.express import parse_express

from mini import BASE, SCHEMA, envelope


def test_null_groups_stay(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, x long")
    summed = ids.running(df, ["k"], df["x"] * 0, ["x"], "x", "upto")
    assert {tuple(r) for r in summed.collect()} == {("a", 1, 1), (None, 2, 2), (None, 3, 5)}
    assert {tuple(r) for r in resolve.canonical(df, ["k"], "x").collect()} == {("a", 1, 1), (None, 2, 2), (None, 3, 2)}


def test_closure_of_long_paths_and_cycles(spark):
    chain = [(i, i + 1) for i in range(150)]  # longer than a recursive query may go
    df = spark.createDataFrame([*chain, (900, 901), (901, 900), (None, 5), (5, None)], "sub long, super long")
    got = {tuple(r) for r in closure.closure(df, "sub", "super").collect()}
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 151)} | {(a, b) for a in (900, 901) for b in (900, 901)}
    assert closure.closure(df.limit(0), "sub", "super").count() == 0


def test_turtle_folders_are_whole_files(spark, tmp_path):
    for folder, name in (("x", "first"), ("y", "second")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "same.ifc").write_text(envelope(f"#1= PERSON('{name}');"))
    catalog = parse_express(SCHEMA, "IFC4_ADD2_TC1")
    sinks.write_turtle_folders(convert(spark, str(tmp_path / "in"), {"IFC4_ADD2_TC1": catalog}, BASE), str(tmp_path / "out"))
    files = glob.glob(str(tmp_path / "out" / "name=same.ifc-*" / "*.txt"))
    texts = sorted(open(f, encoding="utf-8", newline="").read() for f in files)
    assert len(texts) == 2  # equal names of different folders stay apart
    for text, name in zip(texts, ("first", "second")):
        assert text.startswith(sinks.header(BASE, catalog.ontology)) and text.count("@prefix") == 7 and f'"{name}"' in text
