"""Byte automaton that splits SQL text into statements (pure Python helper).

Rules (dialect ``mysql``): strings open and close on ' " ` (doubled quotes
work as close+open); a backslash inside a string escapes the next byte;
outside strings ``--`` and ``#`` start a comment to the line feed (the line
feed is swallowed) and ``/* ... */`` is a block comment (not nested);
``;`` outside strings ends a statement and stays in its text; a dropped
comment becomes one space. What stands in an executable comment
(``/*!50001 ... */``, ``/*M! ... */``) is part of its statement. Dialect
``postgres``: backslash is no escape, ``#`` is no comment and no comment is executable.

The automaton is driven by compiled regular expressions: in the normal state
one possessive match consumes plain text and whole string literals, so Python
runs once per statement end or comment, not per byte or per quote.
"""

from __future__ import annotations

import re

N, Q1, Q2, Q3, B, L = 0, 1, 2, 3, 4, 5
STATE_NAMES = {N: "normal", Q1: "single_quote", Q2: "double_quote", Q3: "backtick", B: "block_comment", L: "line_comment"}

_SEMI, _HASH, _DASH, _SLASH, _STAR, _BSL = ord(";"), ord("#"), ord("-"), ord("/"), ord("*"), ord("\\")
_QUOTE_STATE = {ord("'"): Q1, ord('"'): Q2, ord("`"): Q3}


class Automaton:
    def __init__(self, dialect: str = "mysql"):
        d = dialect.lower()
        if d in ("mysql", "mariadb"):
            # one match consumes plain text and whole string literals; it stops at ; # -- /* or at
            # a string that does not close inside the window (possessive: no backtracking)
            self.re_bulk = re.compile(
                rb"""(?:[^'"`;#/\-]++|'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|`(?:[^`\\]++|\\.)*+`|-(?=[^-])|/(?=[^*]))*+""",
                re.S,
            )
            self.re_q = {Q1: re.compile(rb"[\\']"), Q2: re.compile(rb'[\\"]'), Q3: re.compile(rb"[\\`]")}
        elif d in ("postgres", "postgresql", "pg"):
            self.re_bulk = re.compile(rb"""(?:[^'"`;/\-]++|'[^']*+'|"[^"]*+"|`[^`]*+`|-(?=[^-])|/(?=[^*]))*+""", re.S)
            self.re_q = {Q1: re.compile(rb"'"), Q2: re.compile(rb'"'), Q3: re.compile(rb"`")}
        else:
            raise ValueError(f"unknown dialect {dialect}")
        self.dialect = d
        self.executable = d in ("mysql", "mariadb")

    def advance(self, buf: bytes, pos: int, st: int, stop: int, final: bool, semis: list | None = None,
                comments: list | None = None, base: int = 0) -> tuple[int, int, int]:
        """Run from (pos, st) over ``buf`` until the first token boundary >= ``stop``.

        When ``final`` is false the last byte of ``buf`` is never consumed as a
        token start (it may need its successor). Positions appended to
        ``semis`` / ``comments`` are ``base``-shifted. Returns (pos, state, n_semicolons).
        """
        n = len(buf)
        stop = min(stop, n if final else n - 1)
        re_bulk, re_q = self.re_bulk, self.re_q
        nsemi = 0
        while pos < stop:
            if st == N:
                p = re_bulk.match(buf, pos, min(stop + 1, n)).end()
                if p >= stop:
                    pos = p
                    break
                c = buf[p]
                if c == _SEMI:
                    nsemi += 1
                    if semis is not None:
                        semis.append(base + p)
                    pos = p + 1
                elif c in _QUOTE_STATE:  # a string that does not close inside the window
                    st = _QUOTE_STATE[c]
                    pos = p + 1
                elif c == _HASH:
                    if comments is not None:
                        comments.append(base + p)
                    st, pos = L, p + 1
                elif c == _DASH or c == _SLASH:
                    nxt = buf[p + 1] if p + 1 < n else -1
                    if c == _DASH and nxt == _DASH:
                        if comments is not None:
                            comments.append(base + p)
                        st, pos = L, p + 2
                    elif c == _SLASH and nxt == _STAR:
                        if comments is not None:
                            comments.append(base + p)
                        st, pos = B, p + 2
                    else:  # a lone - or / as the very last byte of the input
                        pos = p + 1
            elif st == L:
                p = buf.find(b"\n", pos, stop)
                if p < 0:
                    pos = stop
                    break
                if comments is not None:
                    comments.append(base + p + 1)
                st, pos = N, p + 1
            elif st == B:
                p = buf.find(b"*/", pos, min(stop + 1, n))
                if p < 0 or p >= stop:
                    pos = stop
                    break
                if comments is not None:
                    comments.append(base + p + 2)
                st, pos = N, p + 2
            else:
                m = re_q[st].search(buf, pos, stop)
                if m is None:
                    pos = stop
                    break
                p = m.start()
                if buf[p] == _BSL:
                    pos = p + 2
                else:
                    st, pos = N, p + 1
        return pos, st, nsemi


_EXECUTABLE = re.compile(rb"/\*M?!(?:\d{5,6})?(.*?)(?:\*/)?$", re.S)


def strip_comments(text: bytes, start: int, spans: list[tuple[int, int]], executable: bool = False) -> bytes:
    """Replace each comment span (absolute offsets) inside ``text`` by one space; an ``executable`` one by its content."""
    if not spans:
        return text
    out, cur = [], 0
    for cs, ce in spans:
        a, b = max(cs - start, 0), min(ce - start, len(text))
        if b <= cur or a >= len(text):
            continue
        a = max(a, cur)
        out.append(text[cur:a])
        inner = _EXECUTABLE.match(text[a:b]) if executable and text[a : a + 4].startswith((b"/*!", b"/*M!")) else None
        out.append(b" " + inner.group(1) + b" " if inner else b" ")
        cur = b
    out.append(text[cur:])
    return b"".join(out)


def split_all(data: bytes, dialect: str = "mysql", max_bytes: int | None = None) -> list[tuple[int, int, bytes]]:
    """Sequential split of a whole buffer: (byte_start, byte_end, text) per statement.

    Used for small inputs and as the reference the parallel reader is tested against.
    """
    a = Automaton(dialect)
    semis: list[int] = []
    marks: list[int] = []
    a.advance(data, 0, N, len(data), True, semis, marks)
    spans = _pair(marks, len(data))
    out = []
    start = 0
    for q in semis + ([len(data)] if (not semis or semis[-1] + 1 < len(data)) else []):
        end = q + 1 if q < len(data) else len(data)
        if end > start:
            if max_bytes is not None and end - start > max_bytes:
                raise ValueError(f"statement exceeds maximum size of {max_bytes} bytes")
            out.append((start, end, strip_comments(data[start:end], start, [s for s in spans if s[1] > start and s[0] < end], a.executable)))
        start = end
    return out


def _pair(marks: list[int], eof: int) -> list[tuple[int, int]]:
    spans = [(marks[i], marks[i + 1] if i + 1 < len(marks) else eof) for i in range(0, len(marks), 2)]
    return spans
