"""Statement tokenizer: arguments as a table of tokens, since Spark has no recursive type."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PIECE = re.compile(r"'([^']*)'?|([(),])|([^'(),]+)")
#: Characters that count as blanks around a lexeme.
BLANK = "".join(map(chr, range(33)))

Tree = list["str | Tree"]


def split_statement(text: str) -> tuple[int | None, str, str, Tree]:
    """Line number, entity name, raw text behind the first `=`, and arguments of a statement `#N= NAME(...);`.

    Arguments are strings and nested lists. A quoted string keeps its opening apostrophe, which tells it from
    references and keywords; doubled apostrophes give two such pieces. An argument with nothing in it gives no
    element. What follows the closing parenthesis is left out.
    """
    head, equals, raw = text[1:].partition("=")
    digits = re.sub(r"\D", "", head)
    if not equals:
        return None, "", text[1:], []
    number = int(digits) if digits and int(digits) < 1 << 63 else -(1 << 63)
    m = re.match(r"[^(;]*", raw)
    name = "".join(m[0].split())
    args: Tree = []
    if m.end() == len(raw) or raw[m.end()] == ";":
        return number, name, raw, args
    stack, now, word = [], args, ""

    def close() -> None:
        nonlocal word
        word = word.strip(BLANK)
        if word:
            now.append(word)
        word = ""

    for piece in _PIECE.finditer(raw, m.end() + 1):
        mark = piece[2]
        if mark is None:
            word += "'" + piece[1] if piece[1] is not None else piece[3]
            continue
        close()
        if mark == "(":
            inner: Tree = []
            now.append(inner)
            stack.append(now)
            now = inner
        elif mark == ")":
            if not stack:
                break
            now = stack.pop()
    return number, name, raw, args


def walk(args: Tree, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], "str | None"]]:
    """Elements of a tree in order as (path, lexeme); a list has no lexeme."""
    for i, x in enumerate(args):
        at = (*path, i)
        if isinstance(x, list):
            yield at, None
            yield from walk(x, at)
        else:
            yield at, x


def kind_of(lexeme: str | None) -> str:
    if lexeme is None:
        return "list"
    if lexeme == "$":
        return "null_marker"
    if lexeme == "*":
        return "star"
    if lexeme.startswith("#"):
        return "ref"
    return "typename" if re.fullmatch(r"[A-Za-z]\w*", lexeme) else "literal"


def reference(lexeme: str) -> int:
    """Line number of a reference `#N`; no statement has the number of an unreadable one."""
    return int(lexeme[1:]) if re.fullmatch(r"[+-]?[0-9]{1,18}", lexeme[1:]) else -(1 << 63)


def instances(statements: DataFrame) -> DataFrame:
    """(file, ord, line_num, name, raw, text) of statements (file, ord, text) in built-in expressions."""
    body = F.expr("substring(text, 2)")
    raw = F.when(F.locate("=", body) > 0, F.expr("substring(text, locate('=', text, 2) + 1)")).otherwise(body)
    number = F.regexp_replace(F.substring_index(body, "=", 1), r"[^0-9]", "")
    number = F.when(F.locate("=", body) > 0, F.coalesce(number.try_cast("bigint"), F.lit(-(1 << 63))))
    name = F.regexp_replace(F.regexp_extract(raw, r"^([^(;]*)", 1), r"\s", "")
    return statements.select("file", "ord", number.alias("line_num"), name.alias("name"), raw.alias("raw"), "text")


def tokens(statements: DataFrame) -> DataFrame:
    """(file, line_num, path, depth, kind, lexeme, ref_line) of all arguments of statements (file, text)."""
    schema = "file string, line_num long, path array<int>, depth int, kind string, lexeme string, ref_line long"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [("file", pa.string()), ("line_num", pa.int64()), ("path", pa.list_(pa.int32())), ("depth", pa.int32()), ("kind", pa.string()), ("lexeme", pa.string()), ("ref_line", pa.int64())]
        for batch in batches:
            rows = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number, _, _, args = split_statement(text)
                for path, lexeme in walk(args):
                    kind = kind_of(lexeme)
                    rows.append((file, number, list(path), len(path), kind, lexeme, reference(lexeme) if kind == "ref" else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True)], [n for n, _ in types])

    return statements.select("file", "text").mapInArrow(run, schema)
