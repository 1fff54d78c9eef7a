"""Column functions over lexical forms. All of them are built-in expressions and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an unreadable number becomes.
NO_NUMBER = -(1 << 63)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_extras(x: Column | str) -> Column:
    """Without apostrophes and equals signs, wherever they stand."""
    return F.translate(_col(x), "'=", "")


def strip_points(x: Column | str) -> Column:
    """Without full stops."""
    return F.translate(_col(x), ".", "")


def trim_control(x: Column | str) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(_col(x), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def to_long(x: Column | str) -> Column:
    """Whole number of a text of digits, NO_NUMBER for any other text."""
    x = _col(x)
    return F.coalesce(F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("bigint")), F.lit(NO_NUMBER))


def capitalised(x: Column | str) -> Column:
    x = _col(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))


def value_property(xsd: Column | str) -> Column:
    """Name of the property that carries a literal of an xsd type."""
    return F.concat(F.lit("has"), capitalised(xsd))


def strip_list_suffix(x: Column | str) -> Column:
    """Class name of a list without its five last characters."""
    x = _col(x)
    return x.substr(F.lit(1), F.length(x) - 5)


def last_word(x: Column | str) -> Column:
    """Last blank-separated word, without semicolons."""
    return F.translate(F.element_at(F.split(_col(x), " "), -1), ";", "")


def iri(base: Column | str, name: Column | str, number: Column | str) -> Column:
    return F.concat(_col(base), _col(name), F.lit("_"), _col(number).cast("string"))


def class_key(x: Column | str) -> Column:
    """Form of a class name that catalog lookups use."""
    return F.upper(_col(x))


def boolean_lexical(x: Column | str) -> Column:
    """true or false of .T. and .F. in either case, else null."""
    x = F.upper(_col(x))
    return F.when(x == ".T.", "true").when(x == ".F.", "false")


def logical_name(x: Column | str) -> Column:
    """TRUE, FALSE or UNKNOWN of .T., .F. and .U., else null."""
    x = F.upper(_col(x))
    return F.when(x == ".T.", "TRUE").when(x == ".F.", "FALSE").when(x == ".U.", "UNKNOWN")


def default_base(stamp: Column | None = None, root: str = "http://example.org/") -> Column:
    """Base address with a time stamp; pass `stamp` for the same one again."""
    stamp = F.current_timestamp() if stamp is None else stamp
    return F.concat(F.lit(root + "resources"), F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit("/"))


def sniff_schema(header: Column | str) -> Column:
    """Schema of a FILE_SCHEMA header line: the first rule that matches, empty without one."""
    h = _col(header)
    found = F.when(h.contains("IFC2X3"), "IFC2X3_TC1")
    found = found.when(h.contains("IFC4x3") | h.contains("IFC4X3"), "IFC4x3_RC1")
    found = found.when(h.contains("IFC4x1") | h.contains("IFC4X1"), "IFC4x1")
    return found.when(h.contains("IFC4"), "IFC4_ADD2_TC1").otherwise("")
