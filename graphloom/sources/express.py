"""EXPRESS schema reader and the catalog that conversion asks.

The reader takes TYPE and ENTITY declarations and skips the rest (rules, functions, inverse and unique
clauses, comments). A catalog answers, for each class, whether it is an enumeration, a select or a list, which
xsd type its literals have, and what its lists contain; for each entity, its attributes in file order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPRESS_NS = "https://w3id.org/express#"
LIST_NS = "https://w3id.org/list#"
ONTOLOGY_ROOT = "http://standards.buildingsmart.org/IFC/DEV/"

# Folders of the published ontologies, xsd types of the EXPRESS primitives.
ONTOLOGY_FOLDER = {
    "IFC2X3_Final": "IFC2x3/FINAL/",
    "IFC2X3_TC1": "IFC2x3/TC1/",
    "IFC4": "IFC4/FINAL/",
    "IFC4_ADD1": "IFC4/ADD1/",
    "IFC4_ADD2": "IFC4/ADD2/",
    "IFC4_ADD2_TC1": "IFC4/ADD2_TC1/",
    "IFC4x1": "IFC4_1/",
    "IFC4x3_RC1": "IFC4_3/RC1/",
}
XSD = {"STRING": "string", "REAL": "double", "INTEGER": "integer", "BINARY": "hexBinary", "BOOLEAN": "boolean", "LOGICAL": "logical", "NUMBER": "double"}


def recognised(schema: Column | str) -> Column:
    """Whether a schema has a published ontology, in either case; false for null and the empty name."""
    names = F.col(schema) if isinstance(schema, str) else schema
    return F.coalesce(F.lower(names).isin(*(x.lower() for x in ONTOLOGY_FOLDER)), F.lit(False))


@dataclass(frozen=True)
class Attribute:
    name: str
    declared_in: str
    range_class: str  # local class name, `X_List` for lists of X
    optional: bool = False

    @property
    def property(self) -> str:
        return f"{self.name[0].lower()}{self.name[1:]}_{self.declared_in}"


@dataclass(frozen=True)
class TypeDef:
    name: str
    kind: str  # defined, enumeration, select
    underlying: str = ""  # class that it specialises: primitive, type or `X_List`
    items: tuple[str, ...] = ()  # enumeration labels or select members
    element: str = ""  # last word of the declaration: what a list type holds


@dataclass
class Catalog:
    schema: str
    entities: dict[str, str] = field(default_factory=dict)  # upper case to name
    supers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    own: dict[str, tuple[Attribute, ...]] = field(default_factory=dict)
    types: dict[str, TypeDef] = field(default_factory=dict)  # by upper case

    @property
    def ontology(self) -> str:
        return ONTOLOGY_ROOT + ONTOLOGY_FOLDER.get(self.schema, f"{self.schema}/") + "OWL"

    @property
    def namespace(self) -> str:
        return self.ontology + "#"

    @cached_property
    def attributes(self) -> dict[str, tuple[Attribute, ...]]:
        """Attributes of each entity, inherited ones first."""
        done: dict[str, tuple[Attribute, ...]] = {}

        def of(name: str, open_: tuple[str, ...] = ()) -> tuple[Attribute, ...]:
            if name not in done:
                if name in open_:
                    raise ValueError(f"{name} is its own supertype")
                got: list[Attribute] = []
                for s in self.supers.get(name, ()):
                    got += [a for a in of(s, (*open_, name)) if a not in got]
                done[name] = (*got, *self.own.get(name, ()))
            return done[name]

        for name in self.entities.values():
            of(name)
        return done

    def type_of(self, word: str) -> TypeDef | None:
        return self.types.get(word.upper())

    def supers_of(self, cls: str) -> tuple[str, ...]:
        """Direct superclasses of a class, `X_List` and the group classes included."""
        if cls.endswith("_List"):
            return ("OWLList",)
        found = list(self.supers.get(cls, ()))
        if t := self.types.get(cls.upper()):
            found += {"enumeration": ["ENUMERATION"], "select": ["SELECT"]}.get(t.kind, [t.underlying])
        return tuple(found)

    def closure(self, cls: str) -> list[str]:
        """All superclasses of a class, nearest first."""
        seen, queue = [], list(self.supers_of(cls))
        while queue:
            c = queue.pop(0)
            if c not in seen:
                seen.append(c)
                queue += self.supers_of(c)
        return seen

    def is_a(self, cls: str, group: str) -> bool:
        """group: ENUMERATION, SELECT or OWLList."""
        return group in self._groups(cls)

    def _groups(self, cls: str) -> frozenset[str]:
        if cls not in self._group_memo:
            self._group_memo[cls] = frozenset(self.closure(cls))
        return self._group_memo[cls]

    @cached_property
    def _group_memo(self) -> dict[str, frozenset[str]]:
        return {}

    def exists(self, cls: str) -> bool:
        plain = cls
        while plain.endswith("_List"):
            plain = plain[:-5]
        return plain in XSD or plain.upper() in self.types or plain.upper() in self.entities

    def xsd(self, cls: str) -> str | None:
        """xsd type of a class's literals."""
        if cls in XSD:
            return XSD[cls]
        return next((XSD[c] for c in XSD if c in self._groups(cls)), None)

    def content(self, cls: str) -> str | None:
        """Class that a list class holds; None if that can't be told."""
        chain = [cls, *self.closure(cls)]
        for p in XSD:
            if f"{p}_List" in chain:
                return p
        if cls.endswith("_List"):
            return cls[:-5]
        if "OWLList" in chain:
            return cls[:-5] if self.exists(cls[:-5]) else None
        return None

    def class_iri(self, cls: str) -> str:
        plain = cls
        while plain.endswith("_List"):
            plain = plain[:-5]
        return (EXPRESS_NS if plain in XSD else self.namespace) + cls

    def label(self, cls: str, lexeme: str) -> str | None:
        """Individual of an enumeration for a lexeme such as `.METRE.`, in either case."""
        t = self.types.get(cls.upper())
        wanted = lexeme.replace(".", "").upper()
        return next((x for x in t.items if x.upper() == wanted), None) if t and t.kind == "enumeration" else None

    # the same as tables, to be joined or looked at
    def entity_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, n, len(self.attributes[n])) for k, n in self.entities.items()]
        return spark.createDataFrame(rows, "entity_key string, name string, arity int")

    def attribute_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (e, i, a.name, a.declared_in, a.property, a.range_class, a.optional, self.is_a(a.range_class, "OWLList"), self.is_a(a.range_class, "ENUMERATION"), self.is_a(a.range_class, "SELECT"), self.xsd(a.range_class))
            for e, attrs in self.attributes.items()
            for i, a in enumerate(attrs)
        ]
        return spark.createDataFrame(rows, "entity string, pos int, name string, declared_in string, property string, range_class string, optional boolean, is_list boolean, is_enum boolean, is_select boolean, xsd string")

    def type_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, t.name, t.kind, t.underlying, t.element) for k, t in self.types.items()], "type_key string, name string, kind string, underlying string, element string")

    def enum_table(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, x.upper(), self.namespace + x) for t in self.types.values() if t.kind == "enumeration" for x in t.items]
        return spark.createDataFrame(rows, "class string, label string, individual string")

    def closure_table(self, spark: SparkSession) -> DataFrame:
        names = [*self.entities.values(), *(t.name for t in self.types.values())]
        return spark.createDataFrame([(n, s) for n in names for s in self.closure(n)], "sub string, super string")


_COMMENT = re.compile(r"\(\*.*?\*\)|--[^\n]*", re.S)
_STRING = re.compile(r"'[^']*'")
_DECLARATION = re.compile(r"\bTYPE\s+(\w+)\s*=\s*(.*?);(.*?)\bEND_TYPE\b|\bENTITY\s+(\w+)\b(.*?)\bEND_ENTITY\b", re.S | re.I)
_AGGREGATE = re.compile(r"^(LIST|ARRAY|SET|BAG)\b\s*(?:\[[^\]]*\])?\s*OF\s+(?:UNIQUE\s+|OPTIONAL\s+)*(.*)$", re.S | re.I)
_CLAUSE = re.compile(r"^\s*(?:DERIVE|INVERSE|UNIQUE|WHERE)\b", re.I | re.M)


def _range(text: str) -> str:
    """Class of a type expression: lists and arrays give `X_List`, sets and bags their element."""
    text = " ".join(text.split())
    if m := _AGGREGATE.match(text):
        inner = _range(m[2])
        return inner + "_List" if m[1].upper() in ("LIST", "ARRAY") else inner
    word = re.match(r"\w+", text)
    if not word:
        raise ValueError(f"no type in {text!r}")
    return word[0].upper() if word[0].upper() in XSD else word[0]


def parse_express(text: str, schema: str = "") -> Catalog:
    """Catalog of an EXPRESS schema; `schema` overrides the name in its SCHEMA line."""
    text = _STRING.sub("''", _COMMENT.sub(" ", text))
    named = re.search(r"\bSCHEMA\s+(\w+)", text, re.I)
    out = Catalog(schema or (named[1] if named else ""))
    for m in _DECLARATION.finditer(text):
        if m[1]:
            body = " ".join(m[2].split())
            kind = "enumeration" if re.match(r"(?:EXTENSIBLE\s+)?(?:GENERIC_ENTITY\s+)?ENUMERATION\b", body, re.I) else "select" if re.match(r"(?:EXTENSIBLE\s+)?(?:GENERIC_ENTITY\s+)?SELECT\b", body, re.I) else "defined"
            if kind == "defined":
                out.types[m[1].upper()] = TypeDef(m[1], kind, _range(body), (), body.split(" ")[-1].partition("(")[0])
            else:
                inside = re.search(r"\(([^)]*)\)", body)
                items = tuple(x.strip() for x in inside[1].split(",") if x.strip()) if inside else ()
                out.types[m[1].upper()] = TypeDef(m[1], kind, "", items)
            continue
        name, body = m[4], m[5]
        head, _, rest = body.partition(";")
        if sup := re.search(r"\bSUBTYPE\s+OF\s*\(([^)]*)\)", head, re.I):
            out.supers[name] = tuple(x.strip() for x in sup[1].split(","))
        explicit = rest[: c.start()] if (c := _CLAUSE.search(rest)) else rest
        attributes = []
        for part in explicit.split(";"):
            names, colon, kind = part.partition(":")
            if not colon or "\\" in names:  # a redeclaration keeps the inherited slot
                continue
            kind = kind.strip()
            optional = bool(re.match(r"OPTIONAL\b", kind, re.I))
            kind = re.sub(r"^OPTIONAL\s+", "", kind, flags=re.I)
            attributes += [Attribute(n.strip(), name, _range(kind), optional) for n in names.split(",")]
        out.entities[name.upper()] = name
        out.own[name] = tuple(attributes)
    return out


def load_catalog(spark: SparkSession, path: str, schema: str = "") -> Catalog:
    """`parse_express` of a file that Spark reads; the path may be remote."""
    rows = spark.read.text(path, wholetext=True).head(1)
    if not rows:
        raise ValueError(f"no schema in {path}")
    return parse_express(rows[0]["value"], schema)
