"""From one statement to events: what its arguments ask of the graph, before references and ids are known.

A statement is planned by itself against the catalog. Steps count from 0 in the order in which the graph
grows. Kinds of events:

touch    the instance `ref_line` is mentioned: its type triple is due, once a file
node     a list node of class `cls` that takes the next id
literal  a literal node of class `cls`, `xsd` and `lexical`; one per file and (xsd, lexical), the first takes an id
gap      an id that nothing uses
edge     a triple whose ends are this instance, nodes and literals by step, other instances, or addresses
ref      a reference that must exist, whatever becomes of it
diag     a diagnostic; `fail` one that voids the file

Lists become chains of nodes; all nodes of a list come before its contents, inner lists before outer ones.
Other collections become one edge an element.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.operators.tokens import Tree, reference, split_statement
from graphloom.sources.express import LIST_NS, XSD, Attribute, Catalog

HAS_CONTENTS, HAS_NEXT = LIST_NS + "hasContents", LIST_NS + "hasNext"
_FIELDS = (
    ("line_num", "bigint"), ("step", "int"), ("kind", "string"), ("cls", "string"), ("xsd", "string"), ("lexical", "string"), ("ref_line", "bigint"),
    ("types_too", "boolean"), ("subject_step", "int"), ("predicate", "string"), ("object_step", "int"), ("object_iri", "string"), ("code", "string"), ("message", "string"),
)
SCHEMA = "file string, " + ", ".join(f"{n} {t}" for n, t in _FIELDS)


def plain(lexeme: str) -> str:
    """Lexical form: no apostrophes, no equals signs."""
    return lexeme.replace("'", "").replace("=", "")


class Ref(int):
    """A resolved reference in an argument tree."""


def resolved(args: Tree, depth: int = 1) -> Tree:
    """References up to the third level as Ref; deeper ones stay text."""
    if depth > 3:
        return args
    return [resolved(x, depth + 1) if isinstance(x, list) else Ref(reference(x)) if x.startswith("#") else x for x in args]


class Failure(Exception):
    """The statement can't be converted and voids its file."""


class Plan:
    """Events of one instance."""

    def __init__(self, catalog: Catalog, line_num: int) -> None:
        self.catalog, self.line_num, self.rows, self.step = catalog, line_num, [], 0

    def add(self, kind: str, **values) -> int:
        step, self.step = self.step, self.step + 1
        self.rows.append({"line_num": self.line_num, "step": step, "kind": kind, **values})
        return step

    def diag(self, code: str, message: str = "") -> None:
        self.add("diag", code=code, message=message)

    def edge(self, subject: int | None, predicate: str, *, step: int | None = None, ref: Ref | None = None, iri: str | None = None) -> None:
        self.add("edge", subject_step=subject, predicate=predicate, object_step=step, ref_line=ref, object_iri=iri)

    def mention(self, subject: int | None, predicate: str, ref: Ref, types_too: bool = False) -> None:
        self.add("touch", ref_line=ref, types_too=types_too)
        self.edge(subject, predicate, ref=ref)

    def literal(self, subject: int | None, predicate: str, cls: str, lexical: str, code: str = "ERROR 1") -> None:
        """A literal node and the edge to it; none for a class without an xsd type."""
        xsd = self.catalog.xsd(cls)
        if xsd is None:
            self.diag(code, f"no xsd type of {cls}: {lexical}")
            return
        if xsd == "boolean" and lexical.upper() not in (".T.", ".F."):
            self.diag("WARNING 10", lexical)
        if xsd == "logical" and lexical.upper() not in (".T.", ".F.", ".U."):
            self.diag("WARNING 9", lexical)
        made = self.add("literal", cls=cls, xsd=xsd, lexical=lexical)
        self.edge(subject, predicate, step=made)

    def chain(self, nodes: list[int], fill) -> None:
        """hasContents by `fill(node, i)` and hasNext of nodes in order."""
        for i, node in enumerate(nodes):
            fill(node, i)
            if i + 1 < len(nodes):
                self.edge(node, HAS_NEXT, step=nodes[i + 1])

    def literal_chain(self, nodes: list[int], cls: str, lexicals: list[str]) -> None:
        if self.catalog.xsd(cls) is None:
            self.diag("ERROR 5", f"no xsd type of {cls}")
            return
        self.chain(nodes, lambda node, i: self.literal(node, HAS_CONTENTS, cls, lexicals[i]))


def plan_entity(plan: Plan, name: str, args: Tree) -> None:
    """Walks the arguments along the attribute slots; a type keyword stays on its slot, all else moves on."""
    catalog = plan.catalog
    slots = catalog.attributes[catalog.entities[name]]
    slot, kept = 0, None  # kept: type keyword that waits for its value
    for arg in args:
        attribute = slots[slot] if slot < len(slots) else None
        if isinstance(arg, Ref):
            if attribute is None:
                plan.diag("WARNING 3", f"no slot {slot}")
            else:
                plan.mention(None, catalog.namespace + attribute.property, arg)
        elif isinstance(arg, list):
            kept = plan_list(plan, attribute, arg, kept)
        elif arg not in ("$", "*"):
            if t := catalog.type_of(arg):
                kept = t.name
                continue
            if attribute is None:
                plan.diag("ERROR 4", f"no slot {slot}: {arg}")
            else:
                plan_scalar(plan, attribute, arg)
        slot += 1


def plan_scalar(plan: Plan, attribute: Attribute, lexeme: str) -> None:
    catalog, cls = plan.catalog, attribute.range_class
    predicate = catalog.namespace + attribute.property
    if catalog.is_a(cls, "ENUMERATION"):
        _individual(plan, predicate, cls, plain(lexeme))
    elif catalog.is_a(cls, "OWLList"):
        plan.diag("WARNING 5", f"list expected: {lexeme}")
    else:
        plan.literal(None, predicate, cls, plain(lexeme))


def _individual(plan: Plan, predicate: str, cls: str, lexical: str) -> None:
    label = plan.catalog.label(cls, lexical)
    if label is None:
        plan.diag("ERROR 9", f"no individual of {cls}: {lexical}")
    else:
        plan.edge(None, predicate, iri=plan.catalog.namespace + label)


def plan_list(plan: Plan, attribute: Attribute | None, args: Tree, kept: str | None) -> str | None:
    """A parenthesised argument. Returns the type keyword that is still waiting behind it."""
    catalog = plan.catalog
    predicate = catalog.namespace + attribute.property if attribute else ""
    cls = attribute.range_class if attribute else ""
    is_list = bool(attribute) and catalog.is_a(cls, "OWLList")
    literals: list[str] = []
    heads: list[int] = []  # inner lists that an outer one links
    for x in args:
        if isinstance(x, Ref):
            if attribute is None:
                plan.diag("WARNING 13", "no slot for a reference")
            elif not is_list:
                plan.mention(None, predicate, x)
            elif catalog.is_a(cls[:-5], "OWLList"):
                plan.diag("ERROR 22", "reference where a list is due")
            else:
                _reference_chain(plan, predicate, cls, args)
                break
        elif isinstance(x, list):
            if kept is not None:
                kept = _typed_inner(plan, attribute, x, kept, literals, heads)
            else:
                _plain_inner(plan, attribute, is_list, cls, x, literals, heads)
                literals.clear()
        elif t := catalog.type_of(x):
            if kept is None:
                kept = t.name
            elif t.name != kept:
                plan.diag("WARNING 37", f"{kept} and {t.name} in one list")
        else:
            literals.append(plain(x))
    if literals:
        if attribute is None:
            raise Failure("values behind the last slot")
        _close_literals(plan, predicate, cls, is_list, literals, kept)
        kept = None
    if heads and attribute is not None:
        _outer_chain(plan, predicate, cls, heads)
    return kept


def _reference_chain(plan: Plan, predicate: str, cls: str, args: Tree) -> None:
    refs = [x for x in args if isinstance(x, Ref)]
    nodes = []
    for i, _ in enumerate(refs):
        nodes.append(plan.add("node", cls=cls))
        if i == 0 and isinstance(args[0], Ref):  # the head is linked only if the list begins with a reference
            plan.edge(None, predicate, step=nodes[0])
    plan.chain(nodes, lambda node, i: plan.mention(node, HAS_CONTENTS, refs[i], types_too=True))


def _typed_inner(plan: Plan, attribute: Attribute | None, inner: Tree, kept: str | None, literals: list[str], heads: list[int]) -> str | None:
    """A list behind a type keyword: plain values are its value, a list in it is a list of that type."""
    catalog = plan.catalog
    for y in inner:
        if isinstance(y, Ref):
            plan.diag("WARNING 30", "reference in a typed list")
        elif not isinstance(y, list):
            literals.append(plain(y))
        else:
            for z in y:
                if isinstance(z, list | Ref):
                    plan.diag("WARNING 31", "unhandled element of a typed list")
                else:
                    literals.append(plain(z))
            if attribute is not None:
                t = catalog.type_of(kept) if kept else None
                if t is None:
                    raise Failure("a second list behind one type keyword")
                head = plan.add("node", cls=t.name)
                content = t.element
                if content in XSD or not catalog.exists(content):
                    raise Failure(f"{t.name} holds no class of the schema")
                if catalog.is_a(content, "OWLList"):
                    plan.diag("WARNING 27", content)
                elif literals:
                    nodes = [head, *(plan.add("node", cls=t.name) for _ in literals[1:])]
                    plan.literal_chain(nodes, content, list(literals))
                heads.append(head)
            kept = None
            literals.clear()
    return kept


def _plain_inner(plan: Plan, attribute: Attribute | None, is_list: bool, cls: str, inner: Tree, literals: list[str], heads: list[int]) -> None:
    """A list in a list: of values or of references, in a chain of the element class."""
    catalog = plan.catalog
    refs = []
    for y in inner:
        if isinstance(y, Ref):
            refs.append(y)
        elif isinstance(y, list):
            plan.diag("ERROR 19", "list of list of list")
        else:
            literals.append(plain(y))
    if attribute is None:
        return
    if not is_list:
        plan.diag("ERROR 23", f"{cls} is no list")
        return
    node_class = cls[:-5]
    head = plan.add("node", cls=node_class)
    heads.append(head)
    items = refs or literals
    if not items:
        return
    content = catalog.content(node_class)
    if content is None:
        raise Failure(f"no content class of {node_class}")
    if catalog.is_a(content, "OWLList"):
        plan.diag("WARNING 27", content)
        return
    nodes = [head, *(plan.add("node", cls=node_class) for _ in items[1:])]
    if not refs:
        plan.literal_chain(nodes, content, list(literals))
        return

    def fill(node: int, i: int) -> None:
        plan.add("touch", ref_line=refs[i], types_too=False)
        plan.add("gap")  # an id goes unused for each reference
        plan.edge(node, HAS_CONTENTS, ref=refs[i])

    plan.chain(nodes, fill)


def _close_literals(plan: Plan, predicate: str, cls: str, is_list: bool, literals: list[str], kept: str | None) -> None:
    catalog = plan.catalog
    if is_list:
        content = kept or catalog.content(cls)
        if content is None or not catalog.exists(content):
            plan.diag("ERROR 14", f"no content class of {cls}")
        elif catalog.is_a(content, "OWLList"):
            plan.diag("WARNING 28", content)
        else:
            nodes = []
            for i, _ in enumerate(literals):
                nodes.append(plan.add("node", cls=cls))
                if i == 0:
                    plan.edge(None, predicate, step=nodes[0])
            plan.literal_chain(nodes, content, literals)
    elif kept is not None:
        if catalog.is_a(kept, "ENUMERATION"):
            _individual(plan, predicate, kept, literals[0])
        elif catalog.is_a(kept, "OWLList"):
            plan.diag("WARNING 24", kept)
        else:
            plan.literal(None, predicate, kept, literals[0])
        if len(literals) > 1:
            plan.diag("WARNING 37", "only the first value is taken")
    else:
        for x in literals:
            plan.literal(None, predicate, cls, x)


def _outer_chain(plan: Plan, predicate: str, cls: str, heads: list[int]) -> None:
    if plan.catalog.content(cls) is None:
        plan.diag("WARNING 29", f"no content class of {cls}")
        return
    before = None
    for i, head in enumerate(heads):
        node = plan.add("node", cls=cls)
        if i == 0:
            plan.edge(None, predicate, step=node)
        else:
            plan.edge(before, HAS_NEXT, step=node)
        plan.edge(node, HAS_CONTENTS, step=head)
        before = node


def plan_statement(catalog: Catalog, text: str) -> list[dict]:
    """Events of one statement; one without a number has none. Unknown names get an ERROR 2."""
    number, name, _, tree = split_statement(text)
    if number is None:
        return []
    plan = Plan(catalog, number)
    args = resolved(tree)
    stack = [(args, 6)]  # a lost reference is an ERROR 6, 7 or 8 by its depth
    while stack:
        inner, code = stack.pop()
        for x in inner:
            if isinstance(x, Ref):
                plan.add("ref", ref_line=x, code=f"ERROR {code}")
            elif isinstance(x, list):
                stack.append((x, code + 1))
    if name in catalog.entities:
        plan.add("touch", ref_line=number, types_too=True)
        try:
            plan_entity(plan, name, args)
        except Failure as e:
            plan.add("fail", code="FAILED", message=str(e))
    elif name in catalog.types:
        plan.add("touch", ref_line=number, types_too=True)
        for x in args:
            plan.diag("WARNING 1" if not isinstance(x, list | Ref) else "WARNING 2" if isinstance(x, Ref) else "WARNING 20", "value of a TYPE line")
    else:
        plan.diag("ERROR 2", f"unknown name {name}")
    return plan.rows


def events(statements: DataFrame, catalogs: dict[str, Catalog]) -> DataFrame:
    """Events of statements (file, schema, text); a schema without a catalog gives none."""

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for file, name, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name in catalogs:
                    out += ({"file": file, **row} for row in plan_statement(catalogs[name], text))
            yield pa.RecordBatch.from_pylist(out, schema)

    return statements.select("file", "schema", "text").mapInArrow(run, SCHEMA)
