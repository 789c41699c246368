"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never end up in one token, so the text
may be cut between them: the fragments are encoded independently and their ids concatenated. The pairs are
computed from the vocabulary when it is loaded. They are used twice:

* on the text: a space after a non-space character is such a pair in vocabularies whose pre-tokeniser keeps
  leading spaces, and so are a line feed and its neighbours (both are verified against the pairs, else the text
  stays whole). A pre-token never crosses such a place, and the white space that the pattern looks ahead for
  lies right of it, so these cuts change no pre-token. A fragment is mostly one word with its punctuation;
* inside each pre-token of a fragment, between any two bytes that form such a pair.

What is left is merged by rank. Ids of fragments are remembered in each task up to ``CACHE`` fragments, after
which the memory is emptied; results do not depend on it. Long fragments are merged with a heap, so that time
stays near linear in the length of a text without spaces.

Defined results: a null text is an empty one; an empty text has no ids; the special token's string in a text is
its one id; ids outside the vocabulary decode to nothing; null ids are skipped; other columns pass unchanged,
columns with the result's names are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

#: The pre-tokeniser's pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 800_000
#: Rank of a pair that is never merged.
NEVER = (1 << 60, -1)
#: Fragments longer than this are merged with a heap.
HEAP_FROM = 48
#: Texts longer than this are not remembered as one fragment.
LONG = 400


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The vocabulary in a tokenizers JSON file and the encoder and decoder over it."""

    def __init__(self, path: str, cache: int | None = None):
        self.cache = CACHE if cache is None else cache
        spec = json.loads(open(path, encoding="utf-8").read())
        byte_of, model = _byte_letters(), spec["model"]
        to_bytes = lambda token: bytes(byte_of[c] for c in token)
        ids = {to_bytes(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        self.bytes_of = {i: t for t, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.name_of = {i: str(i) for i in self.bytes_of}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left id, right id): (rank, merged id)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate((to_bytes(a), to_bytes(b)) for a, b in merges)}
        #: Pairs of bytes inside some token; any other pair is a forced boundary.
        self.inside = {(t[i], t[i + 1]) for t in ids for i in range(len(t) - 1)}
        #: Tokens whose bytes merge to the token itself.
        self.alone: dict[bytes, int] = {}
        self.alone = {t: i for t, i in ids.items() if len(t) <= HEAP_FROM and self._merge(t) == [i]}
        space = ord(" ")
        self.cut_at_space = not any(b == space and a not in b"\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0" and a < 0x80 for a, b in self.inside)
        line, white = ord("\n"), b"\t\n\v\f\r "
        self.cut_at_line = not any(line in (a, b) and max(a, b) < 0x80 and {a, b} - {*white} for a, b in self.inside)
        self.pattern = regex.compile(PATTERN)
        #: A space after white space: there a look-ahead of the pattern would cross the cut.
        blanks = [chr(c) for c in range(0x3001) if regex.match(r"\s", chr(c))]
        self.unsafe = [c + " " for c in blanks]
        #: A line feed beside other white space: it belongs to a longer pre-token.
        self.unsafe_line = [*[c + "\n" for c in blanks], *["\n" + c for c in blanks]]
        self.safe_cut = regex.compile(r"(?<=\S)(?= )")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[str, bytes]] = {}

    def _merge(self, piece: bytes) -> list[int]:
        """The ids of one fragment, merged pair by pair in the order of ranks."""
        if (whole := self.alone.get(piece)) is not None:
            return [whole]
        ids = [self.byte_ids[b] for b in piece]
        if len(ids) > HEAP_FROM:
            return self._merge_long(ids)
        get, last = self.merges.get, NEVER
        ranks = [get(pair, last) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) is not last:
            at = ranks.index(best)
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), last)
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), last)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with linked neighbours and a heap of (rank, position)."""
        n, merges = len(ids), self.merges
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (found := merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [x for x in ids if x >= 0]

    def _pieces(self, token: bytes) -> list[bytes]:
        """A pre-token, cut at its forced boundaries."""
        inside = self.inside
        cuts = [i for i, pair in enumerate(zip(token, token[1:]), 1) if pair not in inside]
        if not cuts:
            return [token]
        return [token[a:b] for a, b in zip([0, *cuts], [*cuts, len(token)])]

    def _token(self, text: str) -> tuple[str, bytes]:
        """Of a pre-token: its ids as comma-joined decimals, and what they decode to."""
        ids = [i for piece in self._pieces(text.encode("utf-8", "replace")) for i in self._merge(piece)]
        name = self.name_of
        return ",".join([name[i] for i in ids]), self.decode_bytes(ids)

    def _fragments(self, text: str) -> list[str]:
        """``text`` cut before each space that follows a non-space character, and around lone line feeds."""
        if not self.cut_at_space:
            return [text]
        if any([x in text for x in self.unsafe]):
            return self.safe_cut.split(text)
        if "\0" in text:
            return self.safe_cut.split(text)
        cut = text.replace(" ", "\0 ")
        if self.cut_at_line and not any([x in text for x in self.unsafe_line]):
            cut = cut.replace("\n", "\0\n\0")
        return cut.split("\0")

    def _learn(self, text: str) -> tuple[str, bytes]:
        """The same of a fragment, joined from its pre-tokens; both are remembered."""
        tokens, known = self.pattern.findall(text), self.known
        if len(known) >= self.cache:
            known.clear()
        if len(tokens) == 1:
            found = self._token(text)
        else:
            each = []
            for t in tokens:
                if (one := known.get(t)) is None:
                    one = self._token(t)
                    if len(t) <= LONG:
                        known[t] = one
                each.append(one)
            found = (",".join([x[0] for x in each]), b"".join([x[1] for x in each]))
        if len(text) <= LONG:
            known[text] = found
        return found

    def parts(self, text: str | None) -> list[tuple[str, bytes]]:
        """Ids and decoded bytes of a text's fragments in order."""
        if not text:
            return []
        known, learn, out = self.known.get, self._learn, []
        for i, plain in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                out.append((str(self.special[plain]), plain.encode()))
            elif plain:
                out += [known(x) or learn(x) for x in self._fragments(plain) if x]
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_array(text).tolist()

    def encode_array(self, text: str | None) -> np.ndarray:
        joined = ",".join([ids for ids, _ in self.parts(text) if ids])
        return np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32)

    def decode_bytes(self, ids) -> bytes:
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids])

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        ids = np.asarray(ids)
        return self.decode_bytes(ids[~np.isnan(ids)].astype(int).tolist() if ids.dtype.kind == "f" else ids.tolist()).decode("utf-8", "replace")


_LOADED: dict[tuple[str, int], Bpe] = {}


def tokenizer(path: str, cache: int = CACHE) -> Bpe:
    """The tokenizer of a file, loaded once in each Python process."""
    if (path, cache) not in _LOADED:
        _LOADED[path, cache] = Bpe(path, cache)
    return _LOADED[path, cache]


def vocabulary() -> str:
    """The installed vocabulary file; its place is the same on the driver and all executors."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the array of ids of ``text`` as column ``out``."""
    path = path or vocabulary()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([tokenizer(path).encode_array(t) for t in texts], dtype=object)

    return docs.withColumn(out, ids(F.col(f"`{text}`")))


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with the text of the id array ``ids`` as column ``out``; null ids give a null text."""
    path = path or vocabulary()

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        return pd.Series([tokenizer(path).decode(r) for r in rows], dtype=object)

    return tokens.withColumn(out, texts(F.col(f"`{ids}`")))


def checked(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "coded", cache: int = CACHE) -> DataFrame:
    """``docs`` with a struct ``out``: the ids of ``text``, and whether they decode to it (null: empty).

    ``cache``: fragments that a task remembers.
    """
    path = path or vocabulary()

    @F.pandas_udf("ids array<int>, exact boolean")
    def coded(texts: pd.Series) -> pd.DataFrame:
        bpe = tokenizer(path, cache)
        ids = [bpe.encode_array(t) for t in texts]
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "exact": [bpe.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]})

    return docs.withColumn(out, coded(F.col(f"`{text}`")))


def digests(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "coded") -> DataFrame:
    """``docs`` with a struct ``out``: n_tokens, ids_sha256 and decoded_sha256 of its encoded and decoded text.

    The ids never leave the task, which matters when only their count or a comparison is wanted.
    """
    path = path or vocabulary()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def coded(texts: pd.Series) -> pd.DataFrame:
        bpe, rows = tokenizer(path), []
        for t in texts:
            parts = bpe.parts(t)
            joined = ",".join([x[0] for x in parts if x[0]])
            back = b"".join([x[1] for x in parts]).decode("utf-8", "replace").encode()
            rows.append((joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(out, coded(F.col(f"`{text}`")))


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded again."""
    return digests(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "coded.*")
