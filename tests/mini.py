"""A small EXPRESS schema of our own, and files of its statements."""

SCHEMA = """
SCHEMA MINI; (* a comment with ENTITY Not; END_ENTITY; *)
TYPE Label = STRING; END_TYPE;
TYPE Length = REAL; END_TYPE;
TYPE PositiveLength = Length; WHERE WR1 : SELF > 0.; END_TYPE;
TYPE Count = INTEGER; END_TYPE;
TYPE DayNumber = INTEGER; END_TYPE;
TYPE Flag = BOOLEAN; END_TYPE;
TYPE Tri = LOGICAL; END_TYPE;
TYPE Code = BINARY; END_TYPE;
TYPE Angle = LIST [3:4] OF INTEGER; END_TYPE;
TYPE Line = LIST [2:2] OF Count; END_TYPE;
TYPE Arc = LIST [3:3] OF Count; END_TYPE;
TYPE Segment = SELECT (Arc, Line); END_TYPE;
TYPE Value = SELECT (Label, Length, PositiveLength, Count, Flag); END_TYPE;
TYPE UnitKind = ENUMERATION OF (METRE, SECOND, USERDEFINED); END_TYPE;
ENTITY Root ABSTRACT SUPERTYPE OF (ONEOF (Person, Curve));
  Name : OPTIONAL Label;
 INVERSE
  Uses : SET OF Other FOR Owner;
 WHERE
  WR1 : EXISTS(Name);
END_ENTITY;
ENTITY Person SUBTYPE OF (Root);
  Family, Given : OPTIONAL Label;
END_ENTITY;
ENTITY Unit;
  Dimensions : Root;
  Kind : UnitKind;
END_ENTITY;
ENTITY SpecialUnit SUBTYPE OF (Unit);
  Factor : Value;
 DERIVE
  SELF\\Unit.Dimensions : Root := ?;
END_ENTITY;
ENTITY Assignment; Units : SET [1:?] OF Unit; END_ENTITY;
ENTITY Point; Coordinates : LIST [1:3] OF Length; END_ENTITY;
ENTITY PointList; Coordinates : LIST [1:?] OF LIST [3:3] OF Length; END_ENTITY;
ENTITY Curve SUBTYPE OF (Root); Points : LIST [2:?] OF Point; Closed : Tri; END_ENTITY;
ENTITY Surface; Points : LIST [2:?] OF LIST [2:?] OF Point; END_ENTITY;
ENTITY Pattern; Days : OPTIONAL SET [1:?] OF DayNumber; END_ENTITY;
ENTITY Site; Latitude : OPTIONAL Angle; Done : OPTIONAL Flag; Raw : OPTIONAL Code; END_ENTITY;
ENTITY Choices; Values : LIST [1:?] OF UNIQUE Value; END_ENTITY;
ENTITY PolyCurve; Segments : OPTIONAL LIST [1:?] OF Segment; END_ENTITY;
ENTITY Property; Nominal : OPTIONAL Value; END_ENTITY;
END_SCHEMA;
"""

DATA = "/root/testdata"
BASE = "http://example.org/r/"


def envelope(*data: str, schema: str = "IFC4", end: str = "\n") -> str:
    return end.join(["ISO-10303-21;", "HEADER;", f"FILE_SCHEMA(('{schema}'));", "ENDSEC;", "DATA;", *data, "ENDSEC;", "END-ISO-10303-21;", ""])
