"""CREATE TABLE text -> Spark schema, for loading a dump by its own definitions (both dialects)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

_WORD = r"(?:`(?:[^`]|``)+`|\"(?:[^\"]|\"\")+\"|[\w$]+)"
_CREATE = re.compile(rf"\s*CREATE\s+(?:(?:GLOBAL|LOCAL|TEMP|TEMPORARY|UNLOGGED|FOREIGN)\s+)*TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?P<name>{_WORD}(?:\s*\.\s*{_WORD})*)\s*\(", re.I)
_COLUMN = re.compile(rf"\s*(?P<name>{_WORD})\s+(?P<type>[A-Za-z_][\w]*(?:\s+(?:VARYING|PRECISION))?)\s*(?:\((?P<args>[^)]*)\))?(?P<rest>.*)$", re.I | re.S)
_KEY = re.compile(rf"\s*(?:CONSTRAINT\s+{_WORD}\s+)?PRIMARY\s+KEY\s*\((?P<cols>[^)]*)\)", re.I)
#: Items of the column list that define no column (fixed values).
_NO_COLUMN = re.compile(r"\s*(?:CONSTRAINT|PRIMARY\s+KEY|UNIQUE|KEY|INDEX|FULLTEXT|SPATIAL|FOREIGN\s+KEY|CHECK|EXCLUDE|LIKE)\b(?!\s*[`\"]?\s*(?:int|varchar|text)\b)", re.I)
#: Type names by the Spark type that holds all their values (fixed values).
_TYPES = {
    T.ByteType(): "tinyint", T.ShortType(): "smallint int2 smallserial year", T.IntegerType(): "int integer mediumint int4 serial",
    T.LongType(): "bigint int8 bigserial", T.FloatType(): "float real float4", T.DoubleType(): "double float8", T.BooleanType(): "boolean bool",
    T.DateType(): "date", T.TimestampNTZType(): "datetime timestamp", T.TimestampType(): "timestamptz",
    T.BinaryType(): "blob tinyblob mediumblob longblob binary varbinary bytea bit",
}
_BY_NAME = {name: kind for kind, names in _TYPES.items() for name in names.split()}
#: The next wider type, for unsigned columns.
_WIDER = {"tinyint": T.ShortType(), "smallint": T.IntegerType(), "mediumint": T.IntegerType(), "int": T.LongType(), "integer": T.LongType(), "bigint": T.DecimalType(20, 0)}


@dataclass
class TableDef:
    """``filled``: columns whose value the server makes up (counters, sequences, generated ones); ``required``: not null, no default."""

    name: str
    schema: T.StructType
    defaults: dict[str, str] = field(default_factory=dict)
    primary_key: list[str] = field(default_factory=list)
    namespace: str | None = None
    filled: set[str] = field(default_factory=set)
    required: set[str] = field(default_factory=set)
    lengths: dict[str, int] = field(default_factory=dict)


def _plain(name: str) -> str:
    quote = name[0] if name[0] in "`\"" else ""
    return name[1:-1].replace(quote * 2, quote) if quote else name


def name_parts(qualified: str) -> list[str]:
    """The parts of a possibly qualified and quoted name, unquoted."""
    return [_plain(x) for x in re.findall(_WORD, qualified)]


def _qualified(qualified: str) -> tuple[str | None, str]:
    parts = name_parts(qualified)
    return (parts[-2] if len(parts) > 1 else None), parts[-1]


def _items(text: str) -> list[str]:
    """The comma-separated items up to the closing parenthesis; quotes and inner parentheses are skipped."""
    out, depth, begin = [], 0, 0
    for m in re.finditer(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|[(),]", text):
        mark = m.group()
        depth += (mark == "(") - (mark == ")")
        if depth < 0:
            return [*out, text[begin : m.start()]]
        if mark == "," and not depth:
            out.append(text[begin : m.start()])
            begin = m.end()
    raise ValueError("CREATE TABLE without its closing parenthesis")


def spark_type(name: str, args: str | None, rest: str, dialect: str) -> T.DataType:
    word = re.sub(r"\s+", " ", name.lower())
    if word in ("decimal", "numeric", "dec", "fixed"):
        n = [int(x) for x in re.findall(r"\d+", args or "")]
        return T.DecimalType(min(n[0], 38), n[1] if len(n) > 1 else 0) if n else T.DecimalType(10, 0) if dialect == "mysql" else T.DecimalType(38, 18)
    if word == "tinyint" and (args or "").strip() == "1":
        return T.BooleanType() if dialect == "mysql" and not re.search(r"\bUNSIGNED\b", rest, re.I) else T.ShortType()
    if re.match(r"\s*UNSIGNED\b", rest, re.I) and word in _WIDER:
        return _WIDER[word]
    if word == "double precision":
        return T.DoubleType()
    if word == "timestamp" and re.match(r"\s*WITH\s+TIME\s+ZONE", rest, re.I):
        return T.TimestampType()
    return T.StringType() if re.match(r"\s*\[", rest) else _BY_NAME.get(word, T.StringType())


def parse_create_table(stmt: str, dialect: str = "mysql") -> TableDef | None:
    """The table that a statement defines, None for any other statement.

    Types that Spark has no counterpart for (text, json, uuid, enum, arrays, time, ...) are strings. Defaults are the
    raw text behind DEFAULT, without sequences (``nextval``).
    """
    m = _CREATE.match(stmt)
    if not m:
        return None
    namespace, name = _qualified(m.group("name"))
    fields, defaults, key, filled, needed, lengths = [], {}, [], set(), set(), {}
    for item in _items(stmt[m.end() :]):
        if pk := _KEY.match(item):
            key = [_plain(c) for c in re.findall(_WORD, pk.group("cols"))]
        if _NO_COLUMN.match(item):
            continue
        c = _COLUMN.match(item)
        if not c:
            raise ValueError(f"cannot read column {item.strip()[:60]!r} of table {name}")
        column, rest = _plain(c.group("name")), c.group("rest")
        if re.search(r"\bPRIMARY\s+KEY\b", rest, re.I):
            key = [column]
        if d := re.search(r"\bDEFAULT\s+('(?:[^'\\]|\\.|'')*'|[^\s,]+)", rest, re.I):
            if not d.group(1).lower().startswith("nextval("):
                defaults[column] = d.group(1)
        if re.match(r"(?:VAR)?CHAR|CHARACTER", c.group("type"), re.I) and (c.group("args") or "").strip().isdigit():
            lengths[column] = int(c.group("args"))
        if _FILLED.search(rest) or "serial" in c.group("type").lower():
            filled.add(column)
        if re.search(r"\bNOT\s+NULL\b", rest, re.I):
            needed.add(column)
        fields.append(T.StructField(column, spark_type(c.group("type"), c.group("args"), rest, dialect)))
    return TableDef(name, T.StructType(fields), defaults, key, namespace, filled, needed - set(defaults) - filled, lengths)


def rename_table(stmt: str, old: str, new: str) -> str:
    """a CREATE TABLE statement with the name ``old`` (quoted or not, qualified or not) replaced by ``new``; else as it is."""
    m = _CREATE.match(stmt)
    if not m or name_parts(m.group("name"))[-1] != old:
        return stmt
    last = list(re.finditer(_WORD, m.group("name")))[-1]
    quote = last.group()[0] if last.group()[0] in "`\"" else "" if re.fullmatch(r"[A-Za-z_]\w*", new) else '"'
    at = m.start("name")
    return stmt[: at + last.start()] + quote + new.replace(quote, quote * 2 if quote else "") + quote + stmt[at + last.end() :]


# ---------------------------------------------------------------------------
# statements that decide which rows of a dump stay, and where they go
# ---------------------------------------------------------------------------
_NAME = rf"{_WORD}(?:\s*\.\s*{_WORD})*"
_NAMES = rf"(?P<names>(?:ONLY\s+)?{_NAME}(?:\s*\*)?(?:\s*,\s*(?:ONLY\s+)?{_NAME}(?:\s*\*)?)*)"
_END = r"\s*;?\s*$"
_SCOPES = [
    ("use", re.compile(rf"\s*USE\s+(?P<names>{_WORD}){_END}", re.I)),
    ("use", re.compile(rf"\s*SET\s+(?:SESSION\s+|LOCAL\s+)?search_path\s*(?:=|\bTO\b)\s*(?P<names>'[^']*'|{_WORD})(?:\s*,.*)?{_END}", re.I | re.S)),
    ("use", re.compile(rf"\s*SELECT\s+pg_catalog\.set_config\(\s*'search_path'\s*,\s*(?P<names>'[^']*').*{_END}", re.I | re.S)),
    ("drop", re.compile(rf"\s*DROP\s+(?:TEMPORARY\s+|FOREIGN\s+)?TABLES?\s+(?:IF\s+EXISTS\s+)?{_NAMES}\s*(?:CASCADE|RESTRICT)?{_END}", re.I)),
    ("drop_all", re.compile(rf"\s*DROP\s+(?:DATABASE|SCHEMA)\s+(?:IF\s+EXISTS\s+)?(?P<names>{_WORD})\s*(?:CASCADE|RESTRICT)?{_END}", re.I)),
    ("clear", re.compile(rf"\s*TRUNCATE\s+(?:TABLE\s+)?{_NAMES}\s*(?:RESTART\s+IDENTITY|CONTINUE\s+IDENTITY)?\s*(?:CASCADE|RESTRICT)?{_END}", re.I)),
    ("clear", re.compile(rf"\s*DELETE\s+FROM\s+(?P<names>{_NAME}){_END}", re.I)),
    ("key", re.compile(rf"\s*ALTER\s+TABLE\s+(?:ONLY\s+)?(?P<names>{_NAME})\s+ADD\s+(?:CONSTRAINT\s+{_WORD}\s+)?PRIMARY\s+KEY\s*\((?P<cols>[^)]*)\){_END}", re.I)),
    ("like", re.compile(rf"\s*CREATE\s+(?:TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?P<names>{_NAME})\s*\(?\s*LIKE\s+(?P<cols>{_NAME})[^,]*{_END}", re.I)),
]
#: Statements that move rows or columns elsewhere, which a load doesn't follow.
_MOVES = re.compile(rf"\s*(?:RENAME\s+TABLE\b|ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{_NAME}\s+(?:RENAME\b(?!\s+(?:INDEX|KEY|CONSTRAINT)\b)|SET\s+SCHEMA\b))", re.I)
_FILLED = re.compile(r"\bAUTO_INCREMENT\b|\bGENERATED\b|\bIDENTITY\b|\bnextval\s*\(|\bAS\s*\(", re.I)


@dataclass
class Scope:
    """What a statement does to the tables of a dump: the namespace it enters, or (namespace, table) pairs it concerns."""

    kind: str
    names: list[tuple[str | None, str]]
    columns: list[str] = field(default_factory=list)


def moves(stmt: str) -> bool:
    """Whether a statement renames a table or a column, or takes a table to another namespace."""
    return bool(_MOVES.match(stmt))


def scope_of(stmt: str) -> Scope | None:
    """The scope statement that ``stmt`` is, if any; CREATE TABLE with its columns has the kind ``create``."""
    for kind, pattern in _SCOPES:
        if m := pattern.match(stmt):
            text = m.group("names")
            if kind in ("use", "drop_all"):
                name = text[1:-1] if text.startswith("'") else _plain(text)
                return Scope(kind, [(None, "" if name.lower() in ("", "pg_catalog") else name)])
            names = [_qualified(re.sub(r"^ONLY\s+", "", x.strip(), flags=re.I)) for x in _split_names(text)]
            return Scope(kind, names, name_parts(m.group("cols")) if kind in ("key", "like") else [])
    m = _CREATE.match(stmt)
    return Scope("create", [_qualified(m.group("name"))]) if m else None


def _split_names(text: str) -> list[str]:
    return re.findall(rf"(?:ONLY\s+)?{_NAME}", text, re.I)
