"""A tiny byte-at-a-time statement splitter written straight from the rules,
used only as the reference the regex automaton is tested against."""


def split_bytes(data: bytes, dialect: str = "mysql"):
    mysql = dialect == "mysql"
    out, buf, start = [], bytearray(), 0
    i, n = 0, len(data)
    in_str, qch, esc = False, 0, False
    while i < n:
        b = data[i]
        if esc:
            buf.append(b); esc = False; i += 1; continue
        if in_str:
            buf.append(b)
            if mysql and b == 0x5C:
                esc = True
            elif b == qch:
                in_str = False
            i += 1
            continue
        if b in (0x27, 0x22, 0x60):
            in_str, qch = True, b; buf.append(b); i += 1; continue
        if (b == 0x2D and i + 1 < n and data[i + 1] == 0x2D) or (mysql and b == 0x23):
            j = data.find(b"\n", i)
            i = n if j < 0 else j + 1
            buf.append(0x20)
            continue
        if b == 0x2F and i + 1 < n and data[i + 1] == 0x2A:
            j = data.find(b"*/", i + 2)
            i = n if j < 0 else j + 2
            buf.append(0x20)
            continue
        buf.append(b)
        i += 1
        if b == 0x3B:
            out.append((start, i, bytes(buf))); buf = bytearray(); start = i
    if start < n:
        out.append((start, n, bytes(buf)))
    return out
