import pytest

from graphloom.plans.convert import RDF_TYPE, Conversion, convert
from graphloom.sources import sinks
from graphloom.sources.express import EXPRESS_NS, LIST_NS, parse_express
from graphloom.streaming import convert_stream

from mini import BASE, SCHEMA, envelope

CATALOG = parse_express(SCHEMA, "IFC4_ADD2_TC1")
NS = CATALOG.namespace
SHORT = {NS: "", BASE: ":", EXPRESS_NS: "x:", LIST_NS: "l:"}


def short(iri: str) -> str:
    if iri == RDF_TYPE:
        return "a"
    return next((s + iri[len(ns):] for ns, s in SHORT.items() if iri.startswith(ns)), iri)


class Files:
    """Converts several files in one job and shows each one's triples."""

    def __init__(self, spark, folder, files: dict[str, str], **options):
        for name, text in files.items():
            path = folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text.encode())
        self.conversion = convert(spark, str(folder), {"IFC4_ADD2_TC1": CATALOG}, BASE, **options)
        rows = self.conversion.triples.orderBy("file", "line_num", "step", "part").collect()
        self.triples: dict[str, list[str]] = {}
        for r in rows:
            if r["line_num"] >= 0:
                self.triples.setdefault(self.stem(r["file"]), []).append(f"{short(r['subject'])} {short(r['predicate'])} {short(r['object']) if r['object_kind'] == 'iri' else repr(r['object'])}")
        self.states = {self.stem(r["file"]): (r["state"], r["cutoff"]) for r in self.conversion.status.collect()}
        self.codes: dict[str, list[str]] = {}
        for r in self.conversion.diagnostics.collect():
            self.codes.setdefault(self.stem(r["file"]), []).append(r["code"])

    @staticmethod
    def stem(file: str) -> str:
        return file.rpartition("/")[2].partition(".")[0]


CASES = {
    "reference": ("#1= CURVE($,(#2,#3,#2),.U.);", "#2= POINT((0.,0.));", "#3= POINT($);"),
    "enumeration": ("#7= UNIT(*,.metre.);", "#8= UNIT(*,.mile.);"),
    "typed": ("#3= PROPERTY(POSITIVELENGTH(12.));", "#4= SPECIALUNIT(*,.SECOND.,LENGTH(0.5));"),
    "setref": ("#5= ASSIGNMENT((#6,#7));", "#6= UNIT(*,.METRE.);", "#7= UNIT($,$);"),
    "string": ("#1= PERSON($,'O''Neil=x','a;b');",),
    "dangling": ("#1= PERSON('x');", "#2= UNIT(#9,.METRE.);"),
    "danglinglist": ("#2= ASSIGNMENT((#31));",),
    "unknown": ("#1= PERSON('x');", "#2= NOTHING('x');", "#3= PERSON('y');"),
    "overflow": ("#2= PATTERN((1),'more',#2);",),
    "listoflist": ("#1= POINTLIST(((0.,1.,2.),(0.,0.,5.)));",),
    "setlit": ("#1= PATTERN((1,2,1));",),
    "reflists": ("#1= SURFACE(((#2,#3),(#3)));", "#2= POINT($);", "#3= POINT($);"),
    "listtype": ("#1= SITE((49,5),.T.,'0FF');", "#2= SITE($,.maybe.,$);"),
    "choices": ("#1= CHOICES((LABEL('N'),LABEL('M')));", "#2= CHOICES((LABEL('N'),COUNT(3)));"),
    "segments": ("#1= POLYCURVE((LINE((1,2)),ARC((2,3,4))));",),
    "empty": ("#1= POINT(());", "#2= PATTERN(());", "#3= POINTLIST((()));"),
    "overwritten": ("#1= PERSON('first');", "#1= PERSON('second');", "#12= PERSON('third');"),
    "multiline": ("#1= PERSON('a',", "  'b' ,", "'c');", "   #2= PERSON('ignored');", "", "#3= PERSON('x'); #4= PERSON('lost');"),
    "literalpast": ("#1= POINT((1.),(2.));",),
    "typeline": ("#1= LABEL('x');", "#2= PERSON($);"),
    "typeref": ("#1= UNIT(#2,.METRE.);", "#2= LABEL('x');"),
    "deep": ("#1= POINTLIST((((1.))));",),
    "shared": ("#1= PERSON('5','5');", "#2= PATTERN((5));", "#3= PROPERTY(COUNT(5));"),
    "blanks": ("#1= PERSON( ' lead trail ' , , 'c' );",),
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    return Files(spark, tmp_path_factory.mktemp("in"), {f"sub/{name}.ifc": envelope(*data, end="\r\n" if name == "typed" else "\n") for name, data in CASES.items()} | {"other.ifc": envelope("#1= PERSON('x');", schema="IFC2X3"), "note.txt": "#1= PERSON('no');"})


EXPECTED = {
    # nodes of a list come first, then contents; the repeated reference has its own node
    "reference": [
        ":Curve_1 a Curve", ":Point_List_4 a Point_List", ":Curve_1 points_Curve :Point_List_4", ":Point_List_5 a Point_List", ":Point_List_6 a Point_List",
        ":Point_2 a Point", ":Point_List_4 l:hasContents :Point_2", ":Point_List_4 l:hasNext :Point_List_5", ":Point_3 a Point", ":Point_List_5 l:hasContents :Point_3",
        ":Point_List_5 l:hasNext :Point_List_6", ":Point_List_6 l:hasContents :Point_2", ":Tri_7 a Tri", ":Tri_7 x:hasLogical x:UNKNOWN", ":Curve_1 closed_Curve :Tri_7",
        ":Length_List_8 a Length_List", ":Point_2 coordinates_Point :Length_List_8", ":Length_List_9 a Length_List", ":Length_10 a Length", ":Length_10 x:hasDouble '0.'",
        ":Length_List_8 l:hasContents :Length_10", ":Length_List_8 l:hasNext :Length_List_9", ":Length_List_9 l:hasContents :Length_10",
    ],
    "enumeration": [":Unit_7 a Unit", ":Unit_7 kind_Unit METRE", ":Unit_8 a Unit"],
    "typed": [":Property_3 a Property", ":PositiveLength_5 a PositiveLength", ":PositiveLength_5 x:hasDouble '12.'", ":Property_3 nominal_Property :PositiveLength_5", ":SpecialUnit_4 a SpecialUnit", ":SpecialUnit_4 kind_Unit SECOND", ":Length_6 a Length", ":Length_6 x:hasDouble '0.5'", ":SpecialUnit_4 factor_SpecialUnit :Length_6"],
    "setref": [":Assignment_5 a Assignment", ":Unit_6 a Unit", ":Assignment_5 units_Assignment :Unit_6", ":Unit_7 a Unit", ":Assignment_5 units_Assignment :Unit_7", ":Unit_6 kind_Unit METRE"],
    "string": [":Person_1 a Person", ":Label_2 a Label", ":Label_2 x:hasString 'ONeilx'", ":Person_1 family_Person :Label_2", ":Label_3 a Label", ":Label_3 x:hasString 'a;b'", ":Person_1 given_Person :Label_3"],
    "unknown": [":Person_1 a Person", ":Label_4 a Label", ":Label_4 x:hasString 'x'", ":Person_1 name_Root :Label_4"],
    "overflow": [":Pattern_2 a Pattern", ":DayNumber_3 a DayNumber", ":DayNumber_3 x:hasInteger '1'", ":Pattern_2 days_Pattern :DayNumber_3"],
    "listoflist": [
        ":PointList_1 a PointList", ":Length_List_2 a Length_List", ":Length_List_3 a Length_List", ":Length_List_4 a Length_List", ":Length_5 a Length", ":Length_5 x:hasDouble '0.'", ":Length_List_2 l:hasContents :Length_5",
        ":Length_List_2 l:hasNext :Length_List_3", ":Length_6 a Length", ":Length_6 x:hasDouble '1.'", ":Length_List_3 l:hasContents :Length_6", ":Length_List_3 l:hasNext :Length_List_4", ":Length_7 a Length", ":Length_7 x:hasDouble '2.'",
        ":Length_List_4 l:hasContents :Length_7", ":Length_List_8 a Length_List", ":Length_List_9 a Length_List", ":Length_List_10 a Length_List", ":Length_List_8 l:hasContents :Length_5", ":Length_List_8 l:hasNext :Length_List_9",
        ":Length_List_9 l:hasContents :Length_5", ":Length_List_9 l:hasNext :Length_List_10", ":Length_11 a Length", ":Length_11 x:hasDouble '5.'", ":Length_List_10 l:hasContents :Length_11",
        ":Length_List_List_12 a Length_List_List", ":PointList_1 coordinates_PointList :Length_List_List_12", ":Length_List_List_12 l:hasContents :Length_List_2", ":Length_List_List_13 a Length_List_List", ":Length_List_List_12 l:hasNext :Length_List_List_13", ":Length_List_List_13 l:hasContents :Length_List_8",
    ],
    "setlit": [":Pattern_1 a Pattern", ":DayNumber_2 a DayNumber", ":DayNumber_2 x:hasInteger '1'", ":Pattern_1 days_Pattern :DayNumber_2", ":DayNumber_3 a DayNumber", ":DayNumber_3 x:hasInteger '2'", ":Pattern_1 days_Pattern :DayNumber_3", ":Pattern_1 days_Pattern :DayNumber_2"],
    # each reference of an inner list leaves an id unused: 4, 5, then 6 and 7 are gaps
    "reflists": [
        ":Surface_1 a Surface", ":Point_List_4 a Point_List", ":Point_List_5 a Point_List", ":Point_2 a Point", ":Point_List_4 l:hasContents :Point_2", ":Point_List_4 l:hasNext :Point_List_5", ":Point_3 a Point", ":Point_List_5 l:hasContents :Point_3",
        ":Point_List_8 a Point_List", ":Point_List_8 l:hasContents :Point_3", ":Point_List_List_10 a Point_List_List", ":Surface_1 points_Surface :Point_List_List_10", ":Point_List_List_10 l:hasContents :Point_List_4",
        ":Point_List_List_11 a Point_List_List", ":Point_List_List_10 l:hasNext :Point_List_List_11", ":Point_List_List_11 l:hasContents :Point_List_8",
    ],
    "listtype": [
        ":Site_1 a Site", ":Angle_3 a Angle", ":Site_1 latitude_Site :Angle_3", ":Angle_4 a Angle", ":INTEGER_5 a x:INTEGER", ":INTEGER_5 x:hasInteger '49'", ":Angle_3 l:hasContents :INTEGER_5", ":Angle_3 l:hasNext :Angle_4",
        ":INTEGER_6 a x:INTEGER", ":INTEGER_6 x:hasInteger '5'", ":Angle_4 l:hasContents :INTEGER_6", ":Flag_7 a Flag", ":Flag_7 x:hasBoolean 'true'", ":Site_1 done_Site :Flag_7", ":Code_8 a Code", ":Code_8 x:hasHexBinary '0FF'", ":Site_1 raw_Site :Code_8",
        ":Site_2 a Site", ":Flag_9 a Flag", ":Site_2 done_Site :Flag_9",
    ],
    # the first keyword wins for all values of the second list
    "choices": [
        ":Choices_1 a Choices", ":Value_List_3 a Value_List", ":Choices_1 values_Choices :Value_List_3", ":Value_List_4 a Value_List", ":Label_5 a Label", ":Label_5 x:hasString 'N'", ":Value_List_3 l:hasContents :Label_5", ":Value_List_3 l:hasNext :Value_List_4",
        ":Label_6 a Label", ":Label_6 x:hasString 'M'", ":Value_List_4 l:hasContents :Label_6", ":Choices_2 a Choices", ":Value_List_7 a Value_List", ":Choices_2 values_Choices :Value_List_7", ":Value_List_8 a Value_List", ":Value_List_7 l:hasContents :Label_5",
        ":Value_List_7 l:hasNext :Value_List_8", ":Label_9 a Label", ":Label_9 x:hasString '3'", ":Value_List_8 l:hasContents :Label_9",
    ],
    "segments": [
        ":PolyCurve_1 a PolyCurve", ":Line_2 a Line", ":Line_3 a Line", ":Count_4 a Count", ":Count_4 x:hasInteger '1'", ":Line_2 l:hasContents :Count_4", ":Line_2 l:hasNext :Line_3", ":Count_5 a Count", ":Count_5 x:hasInteger '2'", ":Line_3 l:hasContents :Count_5",
        ":Arc_6 a Arc", ":Arc_7 a Arc", ":Arc_8 a Arc", ":Arc_6 l:hasContents :Count_5", ":Arc_6 l:hasNext :Arc_7", ":Count_9 a Count", ":Count_9 x:hasInteger '3'", ":Arc_7 l:hasContents :Count_9", ":Arc_7 l:hasNext :Arc_8", ":Count_10 a Count", ":Count_10 x:hasInteger '4'", ":Arc_8 l:hasContents :Count_10",
        ":Segment_List_11 a Segment_List", ":PolyCurve_1 segments_PolyCurve :Segment_List_11", ":Segment_List_11 l:hasContents :Line_2", ":Segment_List_12 a Segment_List", ":Segment_List_11 l:hasNext :Segment_List_12", ":Segment_List_12 l:hasContents :Arc_6",
    ],
    "empty": [":Point_1 a Point", ":Pattern_2 a Pattern", ":PointList_3 a PointList", ":Length_List_4 a Length_List", ":Length_List_List_5 a Length_List_List", ":PointList_3 coordinates_PointList :Length_List_List_5", ":Length_List_List_5 l:hasContents :Length_List_4"],
    # three statements were read, but the greatest number is 12
    "overwritten": [":Person_1 a Person", ":Label_13 a Label", ":Label_13 x:hasString 'second'", ":Person_1 name_Root :Label_13", ":Person_12 a Person", ":Label_14 a Label", ":Label_14 x:hasString 'third'", ":Person_12 name_Root :Label_14"],
    "multiline": [":Person_1 a Person", ":Label_4 a Label", ":Label_4 x:hasString 'a'", ":Person_1 name_Root :Label_4", ":Label_5 a Label", ":Label_5 x:hasString 'b'", ":Person_1 family_Person :Label_5", ":Label_6 a Label", ":Label_6 x:hasString 'c'", ":Person_1 given_Person :Label_6", ":Person_3 a Person", ":Label_7 a Label", ":Label_7 x:hasString 'x'", ":Person_3 name_Root :Label_7"],
    "typeline": [":Label_1 a Label", ":Person_2 a Person"],
    # one literal node for equal values of one xsd type, whatever class asks first
    "shared": [
        ":Person_1 a Person", ":Label_4 a Label", ":Label_4 x:hasString '5'", ":Person_1 name_Root :Label_4", ":Person_1 family_Person :Label_4", ":Pattern_2 a Pattern", ":DayNumber_5 a DayNumber", ":DayNumber_5 x:hasInteger '5'", ":Pattern_2 days_Pattern :DayNumber_5",
        ":Property_3 a Property", ":Property_3 nominal_Property :DayNumber_5",
    ],
    # leading blanks of a string stay, trailing ones go; an empty argument is no slot
    "blanks": [":Person_1 a Person", ":Label_2 a Label", ":Label_2 x:hasString ' lead trail'", ":Person_1 name_Root :Label_2", ":Label_3 a Label", ":Label_3 x:hasString 'c'", ":Person_1 family_Person :Label_3"],
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_triples(files, name):
    assert sorted(files.triples.get(name, [])) == sorted(EXPECTED[name])


def test_failures_void_their_file_alone(files):
    assert {k: v for k, v in files.states.items() if v != ("OK", None)} == {
        "dangling": ("DANGLING", None), "danglinglist": ("DANGLING", None), "unknown": ("OK", 2), "literalpast": ("FAILED", None), "typeref": ("FAILED", None), "other": ("UNKNOWN_SCHEMA", None),
    }
    for name in ("dangling", "danglinglist", "literalpast", "typeref", "other"):
        assert name not in files.triples
    assert "note" not in files.states


def test_diagnostics(files):
    assert files.codes["enumeration"] == ["ERROR 9"]
    assert sorted(files.codes["dangling"]) == ["DANGLING", "ERROR 6"]
    assert sorted(files.codes["danglinglist"]) == ["DANGLING", "ERROR 7"]
    assert files.codes["unknown"] == ["ERROR 2"]
    assert sorted(files.codes["overflow"]) == ["ERROR 4", "WARNING 3"]
    assert files.codes["choices"] == ["WARNING 37"]
    assert files.codes["listtype"] == ["WARNING 10"]
    assert files.codes["deep"] == ["ERROR 19"]


def test_prolog(files):
    rows = files.conversion.prolog.where("file like '%string.ifc'").orderBy("step").collect()
    assert [(r["subject"], r["predicate"], r["object"]) for r in rows] == [(BASE, RDF_TYPE, "http://www.w3.org/2002/07/owl#Ontology"), (BASE, "http://www.w3.org/2002/07/owl#imports", NS)]


def test_duplicates(spark, tmp_path):
    data = ("#1= UNIT(#2,.METRE.);", "#4= UNIT(#3,.METRE.);", "#2= PERSON('a');", "#3= PERSON('a');", "#5=  PERSON('a');")
    got = Files(spark, tmp_path, {"d.ifc": envelope(*data)}, remove_duplicates=True)
    # #3 becomes #2; #4 equals #1 only after that and stays; the blank before #5's name keeps it apart
    assert [t for t in got.triples["d"] if " a " in t and "Label" not in t] == [":Unit_1 a Unit", ":Person_2 a Person", ":Unit_4 a Unit", ":Person_5 a Person"]
    assert ":Unit_4 dimensions_Unit :Person_2" in got.triples["d"]
    assert [tuple(r)[1:] for r in got.conversion.renamed.collect()] == [(3, 2)]


def test_turtle_round_trip(spark, files, tmp_path):
    (tmp_path / "a.ifc").write_text(envelope("#1= PERSON('say \"x\" \\ y');", "#2= POINT((1.,2.E3));"))
    (tmp_path / "b.ifc").write_text(envelope("#1= UNIT(#2,.METRE.);"))
    conversion = convert(spark, str(tmp_path), {"IFC4_ADD2_TC1": CATALOG}, BASE)
    assert sorted(sinks.write_turtle(conversion, sinks.beside)) == [str(tmp_path / "a.ttl"), str(tmp_path / "b.ttl")]
    text = (tmp_path / "a.ttl").read_text()
    assert text.startswith("# baseURI: " + BASE) and "@prefix inst: <" + BASE + "> ." in text
    assert 'express:hasString "say \\"x\\" \\\\ y"' in text
    assert 'express:hasDouble "1."^^xsd:double' in text and "express:hasDouble 2.E3" in text
    body = text[text.index("inst: rdf:type"):]
    assert body.startswith("inst: rdf:type owl:Ontology ;\n        owl:imports ifc: .\n\ninst:Person_1 rdf:type ifc:Person .\n")
    assert (tmp_path / "b.ttl").read_bytes().decode() == sinks.header(BASE, CATALOG.ontology)
    graph = sinks.add_to_graph(conversion, conversion.graph().drop("file"))
    assert graph.count() == conversion.graph().count()
    sinks.write_parquet(conversion, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == conversion.triples.count()
    sinks.write_turtle_folders(conversion, str(tmp_path / "blocks"))
    assert spark.read.text(str(tmp_path / "blocks")).count() > 0


def test_stream(spark, tmp_path):
    folder, found = tmp_path / "in", {}
    folder.mkdir()
    (folder / "a.ifc").write_text(envelope(*CASES["segments"]))

    def sink(conversion: Conversion, batch: int) -> None:
        found[batch] = conversion.triples.count()

    for _ in range(2):  # the second run finds nothing new
        convert_stream(spark, str(folder), {"IFC4_ADD2_TC1": CATALOG}, BASE, sink, str(tmp_path / "check")).awaitTermination()
    assert found == {0: len(EXPECTED["segments"]) + 2}
    (folder / "b.ifc").write_text(envelope(*CASES["setlit"]))
    convert_stream(spark, str(folder), {"IFC4_ADD2_TC1": CATALOG}, BASE, sink, str(tmp_path / "check")).awaitTermination()
    assert found == {0: len(EXPECTED["segments"]) + 2, 1: len(EXPECTED["setlit"]) + 2}


def test_receivers_get_files_in_order(files, tmp_path):
    class Recorder:
        """Writes what it receives to a file when it is finished."""

        def __init__(self, folder: str, file: str) -> None:
            self.path, self.said = f"{folder}/{file.rpartition('/')[2]}.txt", []

        def start(self) -> None:
            self.said.append("start")

        def base(self, address: str) -> None:
            self.said.append(f"base {address}")

        def prefix(self, name: str, namespace: str) -> None:
            self.said.append(f"prefix {name} {namespace}")

        def triple(self, subject, predicate, value, kind, datatype) -> None:
            self.said.append("\t".join((subject, predicate, kind, value)))

        def finish(self) -> None:
            with open(self.path, "w") as out:
                out.write("\n".join([*self.said, "finish"]))

    def shown(line: str) -> str:
        subject, predicate, kind, value = line.split("\t")
        return f"{short(subject)} {short(predicate)} {short(value) if kind == 'iri' else repr(value)}"

    folder = str(tmp_path)
    sinks.stream_files(files.conversion, lambda file: Recorder(folder, file))
    head = ["start", f"base {BASE}", *(f"prefix {p} {ns}" for p, ns in sinks.prefixes(BASE, CATALOG.ontology))]
    for name, expected in EXPECTED.items():
        said = (tmp_path / f"{name}.ifc.txt").read_text().split("\n")
        assert said[:9] == head and said[-1] == "finish" and [shown(x) for x in said[11:-1]] == expected, name
    assert (tmp_path / "dangling.ifc.txt").read_text().split("\n") == [*head, "finish"]
    assert not (tmp_path / "other.ifc.txt").exists()


def test_files_without_a_catalog_say_why(spark, tmp_path):
    got = Files(spark, tmp_path, {"known.ifc": envelope(schema="IFC2X3"), "none.ifc": envelope(schema="OTHER")})
    said = {got.stem(r["file"]): r["message"] for r in got.conversion.diagnostics.collect()}
    assert said == {"known": "no catalog of IFC2X3_TC1", "none": "no recognised schema"}


def test_folder_without_files(spark, tmp_path):
    from graphloom.sources.spf import list_files

    assert list_files(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.txt").write_text("1")
    assert [r["file"].rpartition("/")[2] for r in list_files(spark, str(tmp_path)).collect()] == ["one.txt"]


def test_sparse_numbers_and_blocks(spark, tmp_path):
    far = 1 << 33
    got = Files(spark, tmp_path, {"s.ifc": envelope(f"#{far}= PERSON('b','a');", "#70000= PERSON('a');", "#5= PERSON('a');")})
    assert sorted(t for t in got.triples["s"] if "Label" in t.split()[0]) == sorted([f":Label_{far + 1} a Label", f":Label_{far + 1} x:hasString 'a'", f":Label_{far + 2} a Label", f":Label_{far + 2} x:hasString 'b'"])


def test_command_line(spark, tmp_path, capsys):
    from graphloom.__main__ import main

    (tmp_path / "mini.exp").write_text(SCHEMA)
    (tmp_path / "a.ifc").write_text(envelope("#1= PERSON('x');", "#2= NOTHING();"))
    assert main(["--schema", f"IFC4_ADD2_TC1={tmp_path}/mini.exp", "--base", BASE, str(tmp_path / "a.ifc"), str(tmp_path / "out.ttl")]) == 0
    assert "inst:Person_1 rdf:type ifc:Person" in (tmp_path / "out.ttl").read_text()
    assert "unknown name at #2" in capsys.readouterr().err
    assert main(["--schema", f"IFC4_ADD2_TC1={tmp_path}/mini.exp", "--base", BASE, "--dir", str(tmp_path), "--to", str(tmp_path / "ttl")]) == 0
    parts = [p for p in (tmp_path / "ttl").rglob("*.txt")]
    assert len(parts) == 1 and "inst:Person_1 rdf:type ifc:Person" in parts[0].read_text() and parts[0].read_text().startswith("# baseURI: ")
    for bad in (["--schema", "x=y"], ["--schema", "x=y", "--to", "z", "a", "b"]):
        with pytest.raises(SystemExit):
            main(bad)
