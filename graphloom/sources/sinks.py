"""Sinks: Turtle text, Parquet, other graphs, and callbacks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graphs
from graphloom.plans.convert import OWL, RDF_TYPE, XSD_NS, Conversion
from graphloom.sources.express import EXPRESS_NS, LIST_NS

RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
#: Literals of these types are written bare if their form allows it.
_BARE = {"integer": r"^[+-]?[0-9]+$", "double": r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+$", "boolean": "^(?:true|false)$"}


def prefixes(base: str, ontology: str) -> list[tuple[str, str]]:
    """The seven prefixes of a converted file, in order."""
    return [("ifc", ontology + "#"), ("inst", base), ("list", LIST_NS), ("express", EXPRESS_NS), ("rdf", RDF_NS), ("xsd", XSD_NS), ("owl", OWL)]


def _term(value: Column, table: list[tuple[str, str]]) -> Column:
    """Address as a prefixed name where its local part allows it, else in angle brackets."""
    out = F.concat(F.lit("<"), value, F.lit(">"))
    for prefix, ns in reversed(table):
        local = value.substr(F.lit(len(ns) + 1), F.length(value))
        out = F.when(value.startswith(ns) & local.rlike("^(?:[A-Za-z0-9_][A-Za-z0-9_-]*)?$"), F.concat(F.lit(prefix + ":"), local)).otherwise(out)
    return out


def _literal(lexical: Column, datatype: Column) -> Column:
    text = F.regexp_replace(lexical, r"\\", r"\\\\")
    for mark, escaped in (('"', r'\\"'), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        text = F.regexp_replace(text, mark, escaped)
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    kind = F.substring_index(datatype, "#", -1)
    out = F.when(kind == "string", quoted).otherwise(F.concat(quoted, F.lit("^^xsd:"), kind))
    for name, form in _BARE.items():
        out = F.when((kind == name) & lexical.rlike(form), lexical).otherwise(out)
    return out


def turtle(conversion: Conversion) -> DataFrame:
    """(file, at, block): a Turtle block for each run of triples of one subject, in order of `at`.

    Order inside a file is that in which the graph grows; a subject may have several blocks.
    """
    triples = conversion.triples.join(F.broadcast(conversion.schemas), "file")
    lines = F.lit(None).cast("string")
    subjects = F.lit(None).cast("string")
    for schema, catalog in conversion.catalogs.items():
        table = prefixes(conversion.base, catalog.ontology)
        value = F.when(F.col("object_kind") == "iri", _term(F.col("object"), table)).otherwise(_literal(F.col("object"), F.col("datatype")))
        lines = F.when(F.col("schema") == schema, F.concat_ws(" ", F.when(F.col("predicate") == RDF_TYPE, "rdf:type").otherwise(_term(F.col("predicate"), table)), value)).otherwise(lines)
        subjects = F.when(F.col("schema") == schema, _term(F.col("subject"), table)).otherwise(subjects)
    made = triples.withColumns({"shown": subjects, "text": lines})
    blocks = graphs.blocks(made, ["file"], ["line_num", "step", "part"], "shown", F.col("text"))
    return blocks.select("file", "at", F.concat("shown", F.lit(" "), F.array_join("lines", " ;\n        "), F.lit(" .\n")).alias("block"))


def header(base: str, ontology: str) -> str:
    """Comment lines and prefixes at the head of a Turtle file."""
    comments = f"# baseURI: {base}\r\n# imports: {ontology}\r\n\r\n"
    return comments + f"@base <{base}> .\n" + "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in prefixes(base, ontology)) + "\n"


def write_turtle(conversion: Conversion, target: Callable[[str], str]) -> list[str]:
    """Writes one Turtle file beside each input; `target` names it. Returns the names.

    Blocks come to the driver one partition at a time and go straight to their file, so memory holds one
    partition. Files that don't convert keep the header alone. Use `write_turtle_folders` for large outputs.
    """
    ontology = {r["file"]: conversion.catalogs[r["schema"]].ontology if r["schema"] in conversion.catalogs else "" for r in conversion.schemas.collect()}
    written = []
    for file, name in sorted(ontology.items()):
        path = target(file)
        with open(path, "w", encoding="utf-8", newline="") as out:
            out.write(header(conversion.base, name))
        written.append(path)
    ordered = turtle(conversion).orderBy("file", "at").select("file", "block")
    open_file, out = None, None
    for r in ordered.toLocalIterator():
        if r["file"] != open_file:
            if out:
                out.close()
            open_file, out = r["file"], open(target(r["file"]), "a", encoding="utf-8", newline="")  # noqa: SIM115
        out.write(r["block"] + "\n")
    if out:
        out.close()
    return written


def turtle_files(conversion: Conversion) -> DataFrame:
    """(name, at, block) of whole Turtle files: the header of each file with a catalog, then its blocks by `at`.

    name is the last part of the file's address and a digest of all of it, so equal names of different folders
    stay apart. A file that doesn't convert keeps the header alone.
    """
    heads = conversion.spark.createDataFrame([(s, header(conversion.base, c.ontology)) for s, c in conversion.catalogs.items()], "schema string, block string")
    blocks = turtle(conversion)
    first = conversion.schemas.join(F.broadcast(heads), "schema").select("file", F.lit(None).cast(blocks.schema["at"].dataType).alias("at"), "block")
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"[^A-Za-z0-9._-]", "_")
    return first.unionByName(blocks).select(F.concat(stem, F.lit("-"), F.substring(F.sha2("file", 256), 1, 16)).alias("name"), "at", "block")


def write_turtle_folders(conversion: Conversion, path: str) -> None:
    """A valid Turtle file in a folder for each input file, written by the executors."""
    rows = turtle_files(conversion).repartition("name").sortWithinPartitions("name", F.col("at").asc_nulls_first())
    rows.select("name", F.col("block").alias("value")).write.partitionBy("name").option("maxRecordsPerFile", 0).text(path)


def write_parquet(conversion: Conversion, path: str) -> None:
    """Triples as Parquet, a folder for each predicate's last part, so that readers prune."""
    conversion.triples.withColumn("name", F.regexp_extract("predicate", r"([^/#]*)$", 1)).write.partitionBy("name").parquet(path)


def add_to_graph(conversion: Conversion, graph: DataFrame) -> DataFrame:
    """An existing graph (subject, predicate, object, object_kind, datatype) with the converted triples."""
    return graphs.union(graph, conversion.graph().select(*graph.columns))


class TripleStream(Protocol):
    """Receiver of one file's graph in the order in which it grows; it lives in an executor's Python worker."""

    def start(self) -> None: ...
    def base(self, address: str) -> None: ...
    def prefix(self, name: str, namespace: str) -> None: ...
    def triple(self, subject: str, predicate: str, value: str, kind: str, datatype: str | None) -> None: ...
    def finish(self) -> None: ...


def stream_files(conversion: Conversion, receiver: Callable[[str], TripleStream]) -> None:
    """Passes each file whose schema has a catalog to a receiver of its own, made on an executor by `receiver(file)`.

    A receiver gets start, base, the seven prefixes, the triples by line number, step and part, and finish; a file
    that doesn't convert has no triples. Files are spread over the executors; one file goes to one receiver in
    order, sorted by Spark, which spills. An error of a receiver fails its task, and a task that Spark repeats
    makes new receivers, which start again.
    """
    base = conversion.base
    known = {schema: prefixes(base, catalog.ontology) for schema, catalog in conversion.catalogs.items()}
    order = ["line_num", "step", "part"]
    terms = ["subject", "predicate", "object", "object_kind", "datatype"]
    # a left join, so that files without triples have a row too
    files = conversion.schemas.where(F.col("schema").isin(*known))
    rows = files.join(conversion.triples.select("file", *order, *terms), "file", "left")

    def consume(rows: Iterator) -> None:
        for file, own in groupby(rows, lambda r: r["file"]):
            out = None
            for r in own:
                if out is None:
                    out = receiver(file)
                    out.start()
                    out.base(base)
                    for name, namespace in known[r["schema"]]:
                        out.prefix(name, namespace)
                if r["subject"] is not None:
                    out.triple(*(r[c] for c in terms))
            out.finish()

    rows.repartition("file").sortWithinPartitions("file", *order).foreachPartition(consume)


def for_each_partition(conversion: Conversion, consume: Callable[[Iterator], None]) -> None:
    """Passes the triples to a callback on the executors, one iterator of rows a partition."""
    conversion.triples.foreachPartition(consume)


def beside(file: str) -> str:
    """Local path of an input address with the ending .ttl."""
    return os.path.splitext(file.removeprefix("file://").removeprefix("file:"))[0] + ".ttl"
