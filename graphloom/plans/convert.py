"""Conversion of exchange files to typed triples: one plan for any number of files.

    lines -> statements -> instances (last of a number wins, duplicates removed on request)
          -> events (Python, one statement at a time) -> references, files that fail, ids (joins, sums)
          -> triples and diagnostics

All tables carry `file`; a folder is one job. Order inside a file is that of line numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.lexical import boolean_lexical, iri, logical_name, value_property
from graphloom.operators import ids, resolve
from graphloom.operators.events import events
from graphloom.operators.tokens import instances
from graphloom.scratch import drop_scratch, materialize
from graphloom.sources.express import EXPRESS_NS, Catalog, recognised
from graphloom.sources.spf import read_statements

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
OWL = "http://www.w3.org/2002/07/owl#"
XSD_NS = "http://www.w3.org/2001/XMLSchema#"
TRIPLE = ["file", "line_num", "step", "part", "subject", "predicate", "object", "object_kind", "datatype"]
#: Line numbers of a block of ids.
ID_BLOCK = 1 << 16


@dataclass
class Conversion:
    """A conversion and its tables. Parsed statements, schemas, instances, events, status and numbered are written to
    the shared folder when they are first asked for, which ends their lineage and reads each file twice in all; the
    others are lazy plans over these.

    remove_duplicates: instances of equal text after the number become the first of them.
    """

    statements: DataFrame  # file, ord, text
    sniffed: DataFrame  # file, schema
    catalogs: dict[str, Catalog]
    base: str
    remove_duplicates: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.statements.sparkSession

    @cached_property
    def parsed(self) -> DataFrame:
        """file, ord, line_num, name, raw, text of every statement."""
        return materialize(instances(self.statements), "parsed")

    @cached_property
    def schemas(self) -> DataFrame:
        """file, schema."""
        return materialize(self.sniffed, "schemas")

    @cached_property
    def instances(self) -> DataFrame:
        """file, line_num, ord, name, raw, text, schema; one row a line number."""
        parsed = self.parsed.where("line_num is not null")
        return materialize(resolve.last_wins(parsed, ["file", "line_num"], ["ord"]).join(self.schemas, "file"), "instances")

    @cached_property
    def renamed(self) -> DataFrame:
        """file, dup_line, canon_line of removed duplicates."""
        same = resolve.canonical(self.instances.select("file", "line_num", "raw"), ["file", "raw"], "line_num", "canon_line")
        return same.where("line_num != canon_line").select("file", F.col("line_num").alias("dup_line"), "canon_line")

    @cached_property
    def kept(self) -> DataFrame:
        if not self.remove_duplicates:
            return self.instances
        return resolve.survivors(self.instances, ["file", "raw"], "line_num")

    @cached_property
    def _names(self) -> DataFrame:
        """schema, name, cls, is_entity: what an instance's name can mean; entities go first."""
        rows = [(s, k, n, True) for s, c in self.catalogs.items() for k, n in c.entities.items()]
        rows += [(s, k, t.name, False) for s, c in self.catalogs.items() for k, t in c.types.items() if k not in c.entities]
        return self.spark.createDataFrame(rows, "schema string, name string, cls string, is_entity boolean")

    @cached_property
    def classed(self) -> DataFrame:
        """file, line_num, cls, is_entity of every kept instance; null cls for an unknown name."""
        return self.kept.select("file", "schema", "line_num", "name").join(F.broadcast(self._names), ["schema", "name"], "left").drop("schema", "name")

    @cached_property
    def events(self) -> DataFrame:
        found = events(self.kept.select("file", "schema", "text"), self.catalogs)
        if self.remove_duplicates:
            found = resolve.redirect(found, "ref_line", self.renamed, "dup_line", "canon_line", ("file",))
        return materialize(found, "events")  # several tables read it

    @cached_property
    def status(self) -> DataFrame:
        """file, schema, state, cutoff: state OK, DANGLING, FAILED or UNKNOWN_SCHEMA; rows from line number
        `cutoff` on, that of the first unknown name, are not converted."""
        cutoff = self.classed.where("cls is null").groupBy("file").agg(F.min("line_num").alias("cutoff"))
        refs = self.events.where("kind = 'ref'").select("file", "ref_line").distinct()
        lost = resolve.dangling(refs, "ref_line", self.classed, "line_num", ("file",)).select("file").distinct()
        early = self.events.join(cutoff, "file", "left").where("cutoff is null or line_num < cutoff")
        voided = early.where("kind = 'fail'").select("file")
        target = self.classed.select("file", F.col("line_num").alias("ref_line"), "cls", "is_entity")
        broken = early.where("kind = 'touch'").select("file", "ref_line", "types_too").join(target, ["file", "ref_line"]).where("cls is null or (not is_entity and not types_too)").select("file")
        known = F.col("schema").isin(*self.catalogs) if self.catalogs else F.lit(False)
        marked = self.schemas.join(cutoff, "file", "left")
        marked = marked.join(lost.withColumn("_lost", F.lit(True)), "file", "left")
        marked = marked.join(voided.union(broken).distinct().withColumn("_void", F.lit(True)), "file", "left")
        state = F.when(~known, "UNKNOWN_SCHEMA").when(F.col("_lost"), "DANGLING").when(F.col("_void"), "FAILED").otherwise("OK")
        cut = F.when(known, F.col("cutoff")).alias("cutoff")
        return materialize(marked.select("file", "schema", state.alias("state"), cut), "status")

    @cached_property
    def live(self) -> DataFrame:
        """Events that take part in the graph, with the file's schema."""
        good = self.status.where("state = 'OK'").select("file", "cutoff")
        return self.events.join(good, "file").where("cutoff is null or line_num < cutoff").drop("cutoff")

    @cached_property
    def numbered(self) -> DataFrame:
        """file, line_num, step, kind, cls, xsd, lexical, id, fresh of nodes and literals.

        A literal that occurred before has the id and class of its first occurrence and isn't fresh.
        """
        asked = self.live.where("kind in ('node', 'gap', 'literal')").select("file", "line_num", "step", "kind", "cls", "xsd", "lexical")
        first = ids.first_of(asked.where("kind = 'literal'"), ["file", "xsd", "lexical"], ["line_num", "step"], ["line_num", "step", "cls"])
        first = first.withColumnsRenamed({"line_num": "first_line", "step": "first_step", "cls": "first_cls"})
        marked = asked.join(first, ["file", "xsd", "lexical"], "left")
        fresh = F.col("first_line").isNull() | (F.col("first_line") == F.col("line_num")) & (F.col("first_step") == F.col("step"))
        marked = marked.withColumn("fresh", fresh).withColumn("takes", fresh.cast("long"))
        summed = ids.running(marked, ["file"], F.floor(F.col("line_num") / ID_BLOCK), ["line_num", "step"], "takes", "upto")
        placed = summed.join(ids.seed(self.parsed, ["file"], "line_num"), "file").withColumn("id", F.col("seed") + F.col("upto") - 1)
        own = placed.where("fresh and kind = 'literal'").select("file", F.col("line_num").alias("first_line"), F.col("step").alias("first_step"), F.col("id").alias("first_id"))
        joined = placed.join(own, ["file", "first_line", "first_step"], "left")
        return materialize(joined.select("file", "line_num", "step", "kind", F.coalesce("first_cls", "cls").alias("cls"), "xsd", "lexical", F.coalesce("first_id", "id").alias("id"), "fresh"), "numbered")

    def _class_iri(self, cls: str = "cls") -> Column:
        """Class address by the file's schema; primitives and lists of them are EXPRESS's own."""
        plain = F.regexp_replace(cls, "(_List)+$", "")
        own = F.lit(None).cast("string")
        for name, catalog in self.catalogs.items():
            own = F.when(F.col("schema") == name, F.concat(F.lit(catalog.namespace), F.col(cls))).otherwise(own)
        return F.when(plain.isin("STRING", "REAL", "INTEGER", "BINARY", "BOOLEAN", "LOGICAL", "NUMBER"), F.concat(F.lit(EXPRESS_NS), F.col(cls))).otherwise(own)

    @cached_property
    def triples(self) -> DataFrame:
        """Columns TRIPLE, one row a triple of every file that converts; order is (line_num, step, part)."""
        base = F.lit(self.base)
        kind_iri, nothing = F.lit("iri").alias("object_kind"), F.lit(None).cast("string").alias("datatype")
        schemas = F.broadcast(self.schemas)
        made = self.numbered.where("kind != 'gap'").withColumn("iri", iri(base, "cls", "id"))
        people = self.classed.withColumn("iri", iri(base, "cls", "line_num")).select("file", F.col("line_num").alias("ref_line"), "cls", "iri")

        at = ["file", "line_num", "step"]
        first = ids.first_of(self.live.where("kind = 'touch'"), ["file", "ref_line"], ["line_num", "step"], ["line_num", "step"])
        typed = first.join(people, ["file", "ref_line"]).select(*at, "cls", "iri").unionByName(made.where("fresh").select(*at, "cls", "iri"))
        typed = typed.join(schemas, "file").select(*at, F.lit(0).alias("part"), F.col("iri").alias("subject"), F.lit(RDF_TYPE).alias("predicate"), self._class_iri().alias("object"), kind_iri, nothing)

        xsd, lexical = F.col("xsd"), F.col("lexical")
        logical = xsd == "logical"
        value = F.when(logical, F.concat(F.lit(EXPRESS_NS), logical_name(lexical))).when(xsd == "boolean", boolean_lexical(lexical)).otherwise(lexical)
        values = made.where("fresh and kind = 'literal'").select(
            *at, F.lit(1).alias("part"), F.col("iri").alias("subject"), F.concat(F.lit(EXPRESS_NS), value_property(xsd)).alias("predicate"), value.alias("object"),
            F.when(logical, "iri").otherwise("literal").alias("object_kind"), F.when(~logical, F.concat(F.lit(XSD_NS), xsd)).alias("datatype"),
        ).where("object is not null")

        edges = self.live.where("kind = 'edge'").select(*at, "subject_step", "predicate", "object_step", "object_iri", "ref_line")
        node = lambda name: made.select("file", "line_num", F.col("step").alias(f"{name}_step"), F.col("iri").alias(f"{name}_node"))
        edges = edges.join(node("subject"), ["file", "line_num", "subject_step"], "left").join(node("object"), ["file", "line_num", "object_step"], "left")
        own = people.select("file", F.col("ref_line").alias("line_num"), F.col("iri").alias("self"))
        edges = edges.join(people.drop("cls"), ["file", "ref_line"], "left").join(own, ["file", "line_num"])
        edges = edges.select(*at, F.lit(2).alias("part"), F.coalesce("subject_node", "self").alias("subject"), "predicate", F.coalesce("object_iri", "object_node", "iri").alias("object"), kind_iri, nothing)
        return self.prolog.unionByName(typed).unionByName(values).unionByName(edges).select(*TRIPLE)

    @cached_property
    def prolog(self) -> DataFrame:
        """The two triples that every converted file begins with."""
        rows = [(s, i, p, o) for s, c in self.catalogs.items() for i, (p, o) in enumerate(((RDF_TYPE, OWL + "Ontology"), (OWL + "imports", c.namespace)))]
        constant = self.spark.createDataFrame(rows, "schema string, step int, predicate string, object string")
        good = self.status.where("state = 'OK'").select("file", "schema")
        return good.join(F.broadcast(constant), "schema").select(
            "file", F.lit(-1).cast("long").alias("line_num"), "step", F.lit(0).alias("part"), F.lit(self.base).alias("subject"), "predicate", "object", F.lit("iri").alias("object_kind"), F.lit(None).cast("string").alias("datatype")
        )

    def release(self) -> None:
        """Deletes the written tables; plans over them can't run any more, new ones write them again."""
        for name in ("parsed", "schemas", "instances", "events", "status", "numbered"):
            if name in self.__dict__:
                drop_scratch(self.__dict__[name])
        for name in [n for n, x in vars(type(self)).items() if isinstance(x, cached_property)]:
            self.__dict__.pop(name, None)

    @cached_property
    def diagnostics(self) -> DataFrame:
        """file, line_num, code, severity, message: what was odd, dangling, unknown or void."""
        said = self.events.where("kind in ('diag', 'fail')").select("file", "line_num", "code", "message")
        refs = self.events.where("kind = 'ref'").select("file", "line_num", "ref_line", "code")
        lost = resolve.dangling(refs, "ref_line", self.classed, "line_num", ("file",))
        lost = lost.select("file", "line_num", "code", F.concat(F.lit("no line "), F.col("ref_line").cast("string")).alias("message"))
        about = F.when(F.col("state") != "UNKNOWN_SCHEMA", F.col("schema")).when(recognised("schema"), F.concat(F.lit("no catalog of "), "schema")).otherwise("no recognised schema")
        files = self.status.where("state != 'OK'").select("file", F.lit(None).cast("long").alias("line_num"), F.col("state").alias("code"), about.alias("message"))
        found = said.unionByName(lost).unionByName(files)
        severity = F.when(F.col("code").startswith("WARNING"), "warning").otherwise("error")
        return found.select("file", "line_num", "code", severity.alias("severity"), "message")

    def graph(self) -> DataFrame:
        """Set of triples without order: file, subject, predicate, object, object_kind, datatype."""
        return self.triples.drop("line_num", "step", "part").dropDuplicates()


def convert(spark: SparkSession, paths: str | list[str], catalogs: dict[str, Catalog], base: str, remove_duplicates: bool = False, glob: str | None = "*.ifc") -> Conversion:
    """Conversion of all files in `paths` (files or folders) by the catalogs of their schemas.

    `base` is the address that all resources begin with; it is a parameter, so equal inputs give equal graphs.
    """
    statements, schemas = read_statements(spark, *([paths] if isinstance(paths, str) else paths), glob=glob)
    return Conversion(statements, schemas, catalogs, base, remove_duplicates)
