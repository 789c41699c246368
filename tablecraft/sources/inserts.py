"""INSERT statements -> typed rows of the target table.

The Python part only tokenises each statement's tuples into raw text
fields (Arrow batches out); every type conversion is a Spark expression
(``try_cast``, ``unhex``, ``from_json``) so it runs in the JVM. A value
that does not convert marks its row (and so its statement) bad, which the
loader turns into a failed batch (A13).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ddl import moves, name_parts, scope_of
from ..functions.dialect import norm_dialect

_NAME = r"(?:`(?:[^`]|``)+`|\"(?:[^\"]|\"\")+\"|[\w$]+)"
#: INSERT or REPLACE with their modifiers, a table name with up to two qualifiers, the columns, VALUES.
_INTO = rf"""\s*(?:INSERT|REPLACE)(?:\s+(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY))?(?:\s+IGNORE)?(?:\s+INTO)?\s+(?P<name>{_NAME}(?:\s*\.\s*{_NAME}){{0,2}})"""
_HEAD = re.compile(
    _INTO + r"""\s*(?:\((?P<cols>(?:`(?:[^`]|``)*`|\"(?:[^\"]|\"\")*\"|[^)`\"])*)\))?\s*(?:OVERRIDING\s+(?:SYSTEM|USER)\s+VALUE\s+)?VALUES?\s*""",
    re.I | re.S,
)
_PART = re.compile(_NAME, re.S)
_VERB = re.compile(r"\s*(INSERT|REPLACE)(?:\s+(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY))?(\s+IGNORE\b)?", re.I)
#: What may follow the tuples: it concerns rows that are already in the target.
_TAIL = re.compile(r"\s*(?:AS\s+\w+\s+)?ON\s+(?:DUPLICATE\s+KEY\s+UPDATE|CONFLICT)\b", re.I)
#: Statements that hold no rows: definitions, session settings, transactions, locks.
_NO_ROWS = re.compile(r"\s*(?:(?:CREATE|DROP|ALTER|SET|USE|LOCK|UNLOCK|START|BEGIN|COMMIT|ROLLBACK|ANALYZE|GRANT|REVOKE|COMMENT|SELECT\s+pg_catalog|TRUNCATE|DELIMITER|VACUUM|OPTIMIZE|FLUSH)\b|;|$)", re.I)
#: Marks the raw text of a hex literal; other text that starts with MARK has it doubled.
MARK, HEX = "\x01", "\x01x"
#: Marks bit literals, and stands for the keyword DEFAULT.
BIT, DEFAULT = "\x01b", "\x01d"
#: Between column names that are kept in one string.
JOINT = "\x1f"
_IDENT = re.compile(r"\s*(?:`((?:[^`]|``)*)`|\"((?:[^\"]|\"\")*)\"|([^,\s]+))\s*(?:,|$)", re.S)

_VALUE = {
    "mysql": re.compile(
        r"""\s*(?:(?P<null>NULL)\b
        |(?:_\w+\s*)?'(?P<s>(?:[^'\\]+|\\.|'')*)'
        |(?:_\w+\s*)?[xX]'(?P<hex>[0-9A-Fa-f]*)'
        |(?:_\w+\s+)?0x(?P<hex0>[0-9A-Fa-f]+)\b
        |[bB]'(?P<bits>[01]*)'
        |0b(?P<bits0>[01]+)\b
        |(?P<default>DEFAULT)\b
        |(?P<num>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)
        |(?P<bool>TRUE|FALSE)\b
        |"(?P<d>(?:[^"\\]+|\\.|"")*)")\s*""",
        re.X | re.S | re.I,
    ),
    "postgres": re.compile(
        r"""\s*(?:(?P<null>NULL)\b
        |'(?P<s>(?:[^']+|'')*)'
        |E'(?P<e>(?:[^'\\]+|\\.|'')*)'
        |[xX]'(?P<hex>[0-9A-Fa-f]*)'
        |[bB]'(?P<bits>[01]*)'
        |(?P<default>DEFAULT)\b
        |(?P<num>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)
        |(?P<bool>TRUE|FALSE)\b)\s*(?:::\s*[\w" ]+(?:\(\s*\d+\s*(?:,\s*\d+\s*)?\))?(?:\[\])*\s*)*""",
        re.X | re.S | re.I,
    ),
}

# MySQL backslash escapes when reading string literals.
_MYSQL_UNESCAPE = {"0": "\x00", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a", "%": "\\%", "_": "\\_"}
_BS = re.compile(r"\\(.)", re.S)


def _unescape_mysql(s: str) -> str:
    if "\\" in s:
        s = _BS.sub(lambda m: _MYSQL_UNESCAPE.get(m.group(1), m.group(1)), s)
    return s.replace("''", "'") if "''" in s else s


# Escapes of Postgres E-strings beside octal, \\x and \\u ones.
_PG_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_PG_ESCAPE = re.compile(r"\\(?:([0-7]{1,3})|x([0-9A-Fa-f]{1,2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))|''", re.S)


def _unescape_pg(s: str) -> str:
    def one(m: re.Match) -> str:
        octal, byte, short, long, char = m.groups()
        if char:
            return _PG_ESCAPES.get(char, char)
        code = int(octal, 8) if octal else int(byte or short or long or "27", 16)
        return chr(code)

    return _PG_ESCAPE.sub(one, s)


def _text(s: str) -> str:
    return MARK + s if s.startswith(MARK) else s


def table_name(qualified: str) -> str:
    """The last part of a possibly qualified and quoted name."""
    part = _PART.findall(qualified)[-1]
    quote = part[0] if part[0] in "`\"" else ""
    return part[1:-1].replace(quote * 2, quote) if quote else part


# One value token (no groups inside) per dialect, for the whole-tuple fast path.
_TOKEN = {
    "mysql": r"""(NULL\b|'(?:[^'\\]++|\\.)*+'|[xX]'[0-9A-Fa-f]*+'|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|TRUE\b|FALSE\b|"(?:[^"\\]++|\\.)*+")""",
    "postgres": r"""(NULL\b|'(?:[^']++|'')*+'|[xX]'[0-9A-Fa-f]*+'|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|TRUE\b|FALSE\b)""",
}
_TUPLES: dict = {}
_SEP = re.compile(r"\s*(,|;|$)\s*", re.S)


def _tuple_re(dialect: str, width: int):
    key = (dialect, width)
    if key not in _TUPLES:
        t = _TOKEN[dialect]
        _TUPLES[key] = re.compile(r"\s*\(\s*" + r"\s*,\s*".join([t] * width) + r"\s*\)", re.S | re.I)
    return _TUPLES[key]


_NEEDS_CONVERSION = frozenset("'\"xXnN")


def _value(tok: str, mysql: bool):
    c = tok[0]
    if c == "'" or c == '"':
        raw = tok[1:-1]
        if mysql:
            return _text(_unescape_mysql(raw) if ("\\" in raw or "''" in raw or '""' in raw) else raw)
        return _text(raw.replace("''", "'") if "''" in raw else raw)
    if c == "x" or c == "X":
        return HEX + tok[2:-1]
    if c == "N" or c == "n":
        return None
    return tok


def _fast_rows(stmt: str, pos: int, width: int, d: str):
    """All tuples with one regex match each, or None when the text needs the general parser."""
    tre, mysql, rows, n = _tuple_re(d, width), d == "mysql", [], len(stmt)
    while True:
        m = tre.match(stmt, pos)
        if m is None:
            return None
        rows.append([_value(g, mysql) if g[0] in _NEEDS_CONVERSION else g for g in m.groups()])
        sm = _SEP.match(stmt, m.end())
        if sm is None:
            return None
        sep = sm.group(1)
        pos = sm.end()
        if sep == ",":
            continue
        if pos >= n:
            return rows
        return None


#: Shortest text of tuples that is worth a pass by arrays.
ARRAY_BYTES = 2048
#: What a byte outside quotes is: 0 part of a value, 1 white space, 2 to 5 one of ``,();``.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t\n\r\x0b\x0c")] = 1
_KIND[list(b",();")] = [2, 3, 4, 5]
_KIND = _KIND.tobytes()
_PLAIN = r"^(?i:TRUE|FALSE|[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:E[-+]?[0-9]+)?)$"


def _array_rows(text: bytes, mysql: bool) -> tuple[pa.Array, int] | None:
    """The values of all tuples in order, and the width of a tuple; None when the text needs another parser.

    As in ``_fast_rows``, but a few passes over all bytes at once, for text without escapes and literals that need a
    mark. Quotes alternate, so a byte is inside a string after an odd number of them.
    """
    if b"\x01" in text or (mysql and b"\\" in text):
        return None
    buf = np.frombuffer(text, np.uint8)
    quote = buf == 39
    inside = np.logical_xor.accumulate(quote)  # an opening quote is, a closing one is not
    kind = np.frombuffer(text.translate(_KIND), np.uint8) * ~(quote | inside)
    cuts = np.flatnonzero(kind > 1)
    marks = kind[cuts]
    if inside[-1:].any() or not len(cuts):
        return None
    if marks[-1] == 5:
        marks[-1] = 2  # as if another tuple followed
    else:
        marks, cuts = np.append(marks, np.uint8(2)), np.append(cuts, len(buf))
    width = int(np.argmax(marks == 4))
    shape = np.array([3] + [2] * (width - 1) + [4, 2], np.uint8) if width else marks[:0]
    if not width or len(marks) % len(shape) or (marks.reshape(-1, len(shape)) != shape).any():
        return None
    content = kind == 0
    held = np.flatnonzero(content)
    before = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[cuts].reshape(-1, width + 2)
    ends = before(content)  # content before each of ``,();``
    # none before, between and behind the tuples
    if ends[-1, -1] != len(held) or ends[0, 0] or (ends[:, -1] != ends[:, -2]).any() or (ends[1:, 0] != ends[:-1, -1]).any():
        return None
    a, b = ends[:, :-2].ravel(), ends[:, 1:-1].ravel()
    if (b <= a).any():
        return None
    first, last = held[a], held[b - 1]
    bare = before(content & ~quote & ~inside)
    outside = (bare[:, 1:-1] - bare[:, :-2]).ravel()
    plain = outside == b - a
    if (last - first + 1 != b - a).any() or ((outside > 0) & ~plain).any():
        return None
    keep = content & ~quote
    keep[1:] |= quote[1:] & inside[1:] & quote[:-1] & ~inside[:-1]  # the second of a doubled quote
    offsets = np.zeros(len(a) + 1, np.int32)
    offsets[1:] = np.cumsum(keep, dtype=np.int32)[last]
    kept, lengths = buf[keep], np.diff(offsets)
    none = plain & (lengths == 4)
    for i, c in enumerate(b"null"):
        none[none] = (buf[first[none] + i] | 32) == c
    data, ends = pa.py_buffer(kept), pa.py_buffer(offsets)
    # a sign, digits and at most one point; whatever else stands outside quotes is matched by itself
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[offsets])
    digits, points = sums((kept >= 48) & (kept <= 57)), sums(kept == 46)
    signs = (buf[first] == 43) | (buf[first] == 45)
    other = plain & ~none & ~((digits > 0) & (points < 2) & (digits + points + signs == lengths))
    if other.any() and not pc.all(pc.match_substring_regex(pa.StringArray.from_buffers(len(a), ends, data).filter(pa.array(other)), _PLAIN)).as_py():
        return None
    values = pa.StringArray.from_buffers(len(a), ends, data, pa.py_buffer(np.packbits(~none, bitorder="little")) if none.any() else None)
    return values, width


def _raw(m: re.Match, d: str) -> str | None:
    """The raw text of a matched value."""
    kind, text = m.lastgroup, m.group(m.lastgroup)
    if kind == "null":
        return None
    if kind in ("s", "d"):
        return _text(_unescape_mysql(text) if d == "mysql" else text.replace("''", "'"))
    if kind == "e":
        return _text(_unescape_pg(text))
    if kind in ("hex", "hex0"):
        return HEX + text
    if kind in ("bits", "bits0"):
        return BIT + text
    return DEFAULT if kind == "default" else text


def constant(text: str, dialect: str) -> tuple[bool, str | None]:
    """Whether a default is a constant, and its raw text."""
    d, text = norm_dialect(dialect), text.strip()
    while text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    m = _VALUE[d].fullmatch(text)
    return (True, _raw(m, d)) if m and m.lastgroup != "default" else (False, None)


@dataclass
class Insert:
    """A decoded INSERT: its columns (None: all), rows of raw text, and what it does where a key is there already.

    ``mode``: i (an error), r (replaces), g (keeps the old row), u (sets ``updates`` to the new values), x (computes).
    """

    columns: list[str] | None
    rows: list[list[str | None]]
    mode: str = "i"
    updates: list[str] = field(default_factory=list)
    target: list[str] | None = None


_CONFLICT = re.compile(rf"\s*ON\s+CONFLICT\s*(?:\((?P<target>[^)]*)\)|ON\s+CONSTRAINT\s+{_NAME})?\s*DO\s+(?:(?P<nothing>NOTHING)|UPDATE\s+SET\s+(?P<sets>.*?))\s*(?:RETURNING\b.*)?;?\s*$", re.I | re.S)
_DUPLICATE = re.compile(r"\s*(?:AS\s+(?P<alias>\w+)\s+)?ON\s+DUPLICATE\s+KEY\s+UPDATE\s+(?P<sets>.*?);?\s*$", re.I | re.S)
_SET = re.compile(rf"\s*(?:{_NAME}\s*\.\s*)?(?P<to>{_NAME})\s*=\s*(?:VALUES\s*\(\s*(?P<from>{_NAME})\s*\)|(?P<of>{_NAME})\s*\.\s*(?P<col>{_NAME}))\s*(?:,|$)", re.I | re.S)


def _assignments(text: str, alias: str) -> list[str] | None:
    """The columns that a list of assignments sets to their new values, None where it does anything else."""
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _SET.match(text, at)
        if not m or (m.group("of") and table_name(m.group("of")).lower() != alias):
            return None
        to, source = table_name(m.group("to")), table_name(m.group("from") or m.group("col"))
        if to.lower() != source.lower():
            return None
        out.append(to)
        at = m.end()
    return out


def _tail(stmt: str, pos: int, mode: str) -> Insert | None:
    """What the text behind the tuples says about existing keys; None where it cannot be read."""
    if m := _CONFLICT.match(stmt, pos):
        target = [table_name(x) for x in m.group("target").split(",")] if m.group("target") else None
        if m.group("nothing"):
            return Insert(None, [], "g", target=target)
        sets = _assignments(m.group("sets"), "excluded")
        return Insert(None, [], "x" if sets is None else "u", sets or [], target)
    if m := _DUPLICATE.match(stmt, pos):
        sets = _assignments(m.group("sets"), (m.group("alias") or "").lower())
        return Insert(None, [], "x" if sets is None else "u", sets or [])
    return Insert(None, [], mode) if _TAIL.match(stmt, pos) else None


def _width(stmt: str, pos: int, vre: re.Pattern) -> int | None:
    """Number of values of the tuple at ``pos``."""
    m = re.compile(r"\s*\(").match(stmt, pos)
    n, pos = 0, m.end() if m else len(stmt)
    while (vm := vre.match(stmt, pos)) and vm.end() > pos:
        n, pos = n + 1, vm.end() + 1
        if stmt[vm.end() : pos] != ",":
            return n
    return None


def _head(stmt: str) -> tuple[int, str, list[str] | None]:
    """Where the tuples begin, the mode that the verb stands for, and the columns (None: all)."""
    m = _HEAD.match(stmt)
    if not m:
        raise ValueError("not an INSERT ... VALUES statement")
    verb = _VERB.match(stmt)
    mode = "r" if verb.group(1).upper() == "REPLACE" else "g" if verb.group(2) else "i"
    cols = None
    if m.group("cols") is not None:
        cols = []
        for im in _IDENT.finditer(m.group("cols")):
            a, b, c = im.groups()
            cols.append(a.replace("``", "`") if a is not None else b.replace('""', '"') if b is not None else c)
    return m.end(), mode, cols


def parse_upsert(stmt: str, dialect: str = "mysql", width: int | None = None, arrays: bool = False) -> Insert:
    """An INSERT or REPLACE statement, decoded. Raises ValueError on bad text.

    With a known tuple width (column list, ``width``, or that of the first tuple) whole tuples are matched in one regex
    each; anything unusual falls back to the value-by-value parser. With ``arrays``, ``rows`` of a long and plain
    statement are an Arrow array of lists.
    """
    d = norm_dialect(dialect)
    start, mode, cols = _head(stmt)
    if arrays and len(stmt) - start >= ARRAY_BYTES and (found := _array_rows(stmt[start:].encode("utf-8", "surrogatepass"), d == "mysql")):
        values, w = found
        return Insert(cols, pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, w, dtype=np.int32)), values), mode)
    vre = _VALUE[d]
    w = len(cols) if cols is not None else width or _width(stmt, start, vre)
    if w:
        fast = _fast_rows(stmt, start, w, d)
        if fast is not None:
            return Insert(cols, fast, mode)
    pos, n, rows = start, len(stmt), []
    while True:
        while pos < n and stmt[pos].isspace():
            pos += 1
        if pos >= n or stmt[pos] != "(":
            raise ValueError(f"expected '(' at offset {pos}")
        pos += 1
        vals = []
        while True:
            vm = vre.match(stmt, pos)
            if not vm or vm.end() == pos:
                raise ValueError(f"bad value at offset {pos}")
            vals.append(_raw(vm, d))
            pos = vm.end()
            if pos < n and stmt[pos] == ",":
                pos += 1
                continue
            if pos < n and stmt[pos] == ")":
                pos += 1
                break
            raise ValueError(f"expected ',' or ')' at offset {pos}")
        rows.append(vals)
        while pos < n and stmt[pos].isspace():
            pos += 1
        if pos < n and stmt[pos] == ",":
            pos += 1
            continue
        if pos >= n or stmt[pos] == ";":
            rest = stmt[pos + 1 :].strip() if pos < n else ""
            if rest:
                raise ValueError("text after the statement end")
            return Insert(cols, rows, mode)
        if (tail := _tail(stmt, pos, mode)) is not None:
            return Insert(cols, rows, tail.mode, tail.updates, tail.target)
        raise ValueError(f"expected ',' or ';' at offset {pos}")


def parse_insert(stmt: str, dialect: str = "mysql", width: int | None = None):
    """(columns or None, list of tuples of raw text / None). Raises ValueError on bad text."""
    got = parse_upsert(stmt, dialect, width)
    return got.columns, got.rows


GENERIC_DDL = "_table string, _file string, _stmt_no long, _bad boolean, _error string, _vals array<string>"


#: Rows, and characters of their values, that a task holds before it passes them on.
FLUSH_ROWS, FLUSH_CHARS = 4096, 16 << 20


def _rows_of(stmt: str, names: list[str], dialect: str) -> list[list]:
    """The statement's rows in the order of ``names``; absent columns are null."""
    given, rows = parse_insert(stmt, dialect, width=len(names))
    if given is not None and len(given) != len(set(given)):
        raise ValueError("duplicate column in INSERT")
    if given is not None and (unknown := [c for c in given if c not in names]):
        raise ValueError(f"unknown column {unknown[0]}")
    width = len(given) if given is not None else len(names)
    for r in rows:
        if len(r) != width:
            raise ValueError(f"row has {len(r)} values, expected {width}")
    if given is None or given == names:
        return rows
    at = [given.index(c) if c in given else -1 for c in names]
    return [[r[i] if i >= 0 else None for i in at] for r in rows]


def _tokenize_all(columns: dict[str, list[str]], dialect: str, skip_others: bool):
    """One pass over all statements: rows of every wanted table as text arrays.

    A statement that yields no rows although it should (unreadable, of an unknown table or kind) gives one bad row.
    """
    schema = pa.schema([("_table", pa.string()), ("_file", pa.string()), ("_stmt_no", pa.int64()), ("_bad", pa.bool_()),
                        ("_error", pa.string()), ("_vals", pa.list_(pa.string()))])
    into = re.compile(_INTO, re.I | re.S)

    def decoded(stmt: str):
        """(table, rows, error); no table and no error for a statement without rows."""
        m = into.match(stmt)
        if not m:
            return None, [], None if _NO_ROWS.match(stmt) else f"statement kind {stmt.split(None, 1)[0][:20]} is not loaded"
        table = table_name(m.group("name"))
        if table not in columns:
            return None, [], None if skip_others else f"no schema for table {table}"
        try:
            return table, _rows_of(stmt, columns[table], dialect), None
        except ValueError as e:
            return table, [], str(e)

    def run(batches):
        out, held = {k: [] for k in schema.names}, 0
        for b in batches:
            for f, no, s in zip(b.column("file").to_pylist(), b.column("stmt_no").to_pylist(), b.column("stmt").to_pylist()):
                table, rows, error = decoded(s)
                for r in rows if error is None else [None]:
                    for k, v in zip(schema.names, (table, f, no, error is not None, error, r)):
                        out[k].append(v)
                held += len(s)
                if len(out["_table"]) >= FLUSH_ROWS or held >= FLUSH_CHARS:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out, held = {k: [] for k in schema.names}, 0
        if out["_table"]:
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def decode_all(stmts: DataFrame, schemas: dict[str, T.StructType], dialect: str = "mysql", skip_others: bool = False) -> DataFrame:
    """S5 for many tables in one pass: DataFrame(_table, _file, _stmt_no, _bad, _error, _vals).

    ``skip_others`` passes over INSERTs of tables without a schema; otherwise they are bad.
    """
    cols = {t: [f.name for f in s.fields] for t, s in schemas.items()}
    return stmts.select("file", "stmt_no", "stmt").mapInArrow(_tokenize_all(cols, norm_dialect(dialect), skip_others), GENERIC_DDL)


# ---------------------------------------------------------------------------
# decoding before any schema is known
# ---------------------------------------------------------------------------
#: Between namespace and name in ``_table``.
DOT = "\x02"
RAW_DDL = ("_table string, _kind string, _file string, _stmt_no long, _row_no int, _mode string, _cols string, _sets string, "
           "_width int, _error string, _stmt string, _vals array<string>")


def table_key(qualified: str) -> str:
    """Namespace (if any) and name of a written table name, as in ``_table``."""
    return DOT.join(name_parts(qualified)[-2:])


def _raw_rows(dialect: str, wanted: frozenset[str] | None):
    schema = pa.schema([("_table", pa.string()), ("_kind", pa.string()), ("_file", pa.string()), ("_stmt_no", pa.int64()), ("_row_no", pa.int32()), ("_mode", pa.string()),
                        ("_cols", pa.string()), ("_sets", pa.string()), ("_width", pa.int32()), ("_error", pa.string()), ("_stmt", pa.string()), ("_vals", pa.list_(pa.string()))])
    into = re.compile(_INTO, re.I | re.S)

    def decoded(stmt: str):
        """(table, kind, decoded INSERT, error) of a statement; all None for one that concerns no rows."""
        m = into.match(stmt)
        if not m:
            if (scope := scope_of(stmt)) is not None:
                return None, scope.kind, None, None
            if _NO_ROWS.match(stmt) and not moves(stmt):
                return None, None, None, None
            return None, None, None, f"statement kind {stmt.split(None, 1)[0][:20]} is not loaded"
        if wanted is not None and table_name(m.group("name")) not in wanted:
            return None, None, None, None
        table = table_key(m.group("name"))
        try:
            ins = parse_upsert(stmt, dialect, arrays=True)
            if ins.columns is not None and len({c.lower() for c in ins.columns}) != len(ins.columns):
                return table, None, None, "duplicate column in INSERT"
            if not isinstance(ins.rows, pa.Array) and (wide := next((r for r in ins.rows if len(r) != len(ins.rows[0])), None)):
                return table, None, None, f"row has {len(wide)} values, expected {len(ins.rows[0])}"
            if ins.columns is not None and len(ins.rows[0]) != len(ins.columns):
                return table, None, None, f"row has {len(ins.rows[0])} values, expected {len(ins.columns)}"
            return table, None, ins, None
        except ValueError as e:
            return table, None, None, str(e)

    def packed(out: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(out, schema=schema)

    def run(batches):
        # rows as lists, and whole statements as batches
        out, pieces, held, rows = {k: [] for k in schema.names}, [], 0, 0
        for b in batches:
            for f, no, s in zip(b.column("file").to_pylist(), b.column("stmt_no").to_pylist(), b.column("stmt").to_pylist()):
                table, kind, ins, error = decoded(s)
                if ins is None:
                    if kind is None and error is None:
                        continue
                    one = (table, kind, f, no, 0, None, None, None, None, error, s, None)
                    for k, v in zip(schema.names, one):
                        out[k].append(v)
                    rows += 1
                else:
                    n, arrays = len(ins.rows), isinstance(ins.rows, pa.Array)
                    flags = "" if arrays else ("d" if any(DEFAULT in r for r in ins.rows) else "") if "default" in s or "DEFAULT" in s or "Default" in s else ""
                    if not arrays and any(v is not None and v.startswith(MARK) for r in ins.rows for v in r):
                        flags += "m"
                    cols = None if ins.columns is None else JOINT.join(ins.columns)
                    sets = JOINT.join([*ins.updates, "", *ins.target]) if ins.target else JOINT.join(ins.updates) if ins.updates else None
                    same = {"_table": table, "_kind": None, "_file": f, "_stmt_no": no, "_mode": ins.mode + flags, "_cols": cols, "_sets": sets, "_width": len(ins.rows[0]), "_error": None, "_stmt": None}
                    if arrays:
                        made = {k: pa.repeat(pa.scalar(v, schema.field(k).type), n) for k, v in same.items()} | {"_row_no": pa.array(np.arange(n, dtype=np.int32)), "_vals": ins.rows}
                        pieces.append(pa.RecordBatch.from_arrays([made[k] for k in schema.names], schema=schema))
                    else:
                        for k, v in same.items():
                            out[k].extend([v] * n)
                        out["_row_no"].extend(range(n))
                        out["_vals"].extend(ins.rows)
                    rows += n
                held += len(s)
                if rows >= FLUSH_ROWS or held >= FLUSH_CHARS:
                    if out["_table"]:
                        pieces.append(packed(out))
                    yield from pa.Table.from_batches(pieces).combine_chunks().to_batches()
                    out, pieces, held, rows = {k: [] for k in schema.names}, [], 0, 0
        if out["_table"]:
            pieces.append(packed(out))
        if pieces:
            yield from pa.Table.from_batches(pieces).combine_chunks().to_batches()

    return run


def decode_raw(stmts: DataFrame, dialect: str = "mysql", wanted: list[str] | None = None) -> DataFrame:
    """One pass over all statements, before any schema is known (RAW_DDL).

    A row per tuple of an INSERT with its raw values; a row with ``_kind`` and the text for every statement that decides
    over tables or namespaces; a row with ``_error`` and the text for every statement that cannot be loaded. With
    ``wanted`` (plain names) INSERTs of other tables are passed over.
    """
    return stmts.select("file", "stmt_no", "stmt").mapInArrow(_raw_rows(norm_dialect(dialect), None if wanted is None else frozenset(wanted)), RAW_DDL)


def typed_rows(generic: DataFrame, schema: T.StructType, dialect: str = "mysql") -> DataFrame:
    """Typed columns of one table from the generic decoded rows (+ _file, _stmt_no, _bad, _error)."""
    raw = [F.col("_vals")[i] for i in range(len(schema.fields))]
    vals = [typed(r, f.dataType, dialect).alias(f.name) for r, f in zip(raw, schema.fields)]
    bad = F.col("_bad")
    for r, f in zip(raw, schema.fields):
        bad = bad | (r.isNotNull() & typed(r, f.dataType, dialect).isNull())
    err = F.coalesce(F.col("_error"), F.when(bad, F.lit("value does not convert to the column type")))
    return generic.select("_file", "_stmt_no", bad.alias("_bad"), err.alias("_error"), *vals)


def typed(raw: Column, dtype: T.DataType, dialect: str, marked: bool = True) -> Column:
    """Raw literal text -> value of ``dtype`` (null when it does not convert).

    Without ``marked`` no text starts with MARK, and the expression is a small one.
    A hex literal is bytes: as they are in a binary column, their UTF-8 text in any other. Text in a binary column is
    its UTF-8 bytes, but for Postgres' own hex form.
    """
    if not marked:
        if isinstance(dtype, T.StringType):
            return raw
        if isinstance(dtype, T.BooleanType):
            return F.lower(raw).try_cast("boolean")
        if isinstance(dtype, T.AtomicType) and not isinstance(dtype, T.BinaryType):
            return raw.try_cast(dtype)
    is_hex = raw.startswith(HEX)
    bytes_ = F.try_to_binary(F.substring(raw, F.lit(len(HEX) + 1), F.length(raw)), F.lit("hex"))
    bits = F.substring(raw, F.lit(len(BIT) + 1), F.length(raw))
    plain = F.when(raw.startswith(MARK) & ~raw.startswith(BIT), F.substring(raw, F.lit(2), F.length(raw))).when(raw.startswith(BIT), F.conv(bits, 2, 10)).otherwise(raw)
    if isinstance(dtype, T.BinaryType):
        size = (F.ceil(F.length(bits) / 8) * 2).cast("int")
        text = F.when(raw.startswith(BIT), F.unhex(F.lpad(F.conv(bits, 2, 16), size, "0"))).otherwise(F.encode(plain, "UTF-8"))
        if norm_dialect(dialect) == "postgres":
            text = F.when(plain.startswith("\\x"), F.try_to_binary(F.substring(plain, F.lit(3), F.length(plain)), F.lit("hex"))).otherwise(text)
        return F.when(is_hex, bytes_).otherwise(text)
    text = F.when(is_hex, F.try_validate_utf8(bytes_.cast("string"))).otherwise(plain)
    if isinstance(dtype, T.StringType):
        return text
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, dtype)
    if isinstance(dtype, T.BooleanType):
        return F.lower(text).try_cast("boolean")
    return text.try_cast(dtype)


def decode_inserts(stmts: DataFrame, table: str, schema: T.StructType, dialect: str = "mysql", keep_meta: bool = False) -> DataFrame:
    """Rows of ``table`` from its INSERT statements.

    ``stmts`` needs (file, stmt_no, stmt). With ``keep_meta`` the result also
    has ``_file``, ``_stmt_no``, ``_bad`` (tokenising or conversion failed) and ``_error``.
    """
    rows = typed_rows(decode_all(stmts, {table: schema}, dialect, skip_others=True).where(F.col("_table") == table), schema, dialect)
    return rows if keep_meta else rows.where(~F.col("_bad")).select(*[f.name for f in schema.fields])
