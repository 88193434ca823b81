"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string BPE's encoding has one last token; a token may follow the last token of the rest only
if BPE, run on the two alone, leaves them as they are.  Storing that last token per prefix encodes in one pass, makes
appending exact (old entries stay), and confines an edit: entries before it stay, and entries after it are recomputed
only until they agree with the old ones for as long as the longest token.

Texts are first split by the tokenizer's pattern; within a task, the encoding of each distinct piece is kept in a
bounded dictionary.  Vocabularies are files whose path is a parameter.

Defined results: a null text counts as empty and has no tokens (the digests are those of the empty string); very long
pieces take time in proportion to their length; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces whose encoding a task keeps at most; then it starts anew.
KEPT_PIECES = 800_000
NONE = -1


class PrefixCoder:
    """Encoder and decoder over a rank table {bytes: id}."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.reach = max(map(len, ranks))
        self.tails = {b[i:]: NONE for b in ranks for i in range(1, len(b))} | ranks  # every end of a token, with its id if it is one
        self.parts = {i: (i, i) for b, i in ranks.items() if len(b) == 1}
        self.merged: dict[tuple[int, int], int] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        for i in sorted(self.bytes_of):
            b = self.bytes_of[i]
            if len(b) == 1:
                continue
            for cut in range(len(b) - 1, 0, -1):
                left, right = ranks.get(b[:cut], i), ranks.get(b[cut:], i)
                if left < i and right < i and self._may_follow(left, right):
                    self.parts[i] = (left, right)
                    self.merged[left, right] = i
                    break
            else:
                self.parts[i] = (i, i)
        self.follows.clear()

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart: undo merges at the seam, latest first, looking for an earlier one across it."""
        bound = 1 << 62
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            inner_left, inner_right = self.parts[left][1], self.parts[right][0]
            if inner_left == left and inner_right == right:
                return True
            if inner_right == right or (inner_left != left and left > right):
                bound, left = left, inner_left
            else:
                bound, right = right + 1, inner_right

    def may_follow(self, left: int, right: int) -> bool:
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            known = self.follows[left, right] = self._may_follow(left, right)
        return known

    def prefixes(self, data: bytes, last: list[int] | None = None, until: int | None = None) -> list[int]:
        """Last token of each prefix (up to until); with last, only of those that it lacks (an append)."""
        last = [] if last is None else last
        tails, follows = self.tails.get, self.follows.get
        for end in range(len(last) + 1, (len(data) if until is None else until) + 1):
            found = NONE
            for start in range(end - 1, -1, -1):
                token = tails(data[start:end])
                if token is None:
                    break
                if token >= 0:
                    if not start:
                        found = token
                        break
                    pair = last[start - 1], token
                    known = follows(pair)
                    if known or (known is None and self.may_follow(*pair)):
                        found = token
                        break
            if found < 0:
                raise ValueError("the vocabulary lacks a byte")
            last.append(found)
        return last

    def edited(self, old: bytes, last: list[int], at: int, removed: int, put: bytes) -> tuple[bytes, list[int]]:
        """Bytes and prefix table after old[at:at+removed] gave way to put, reusing what the edit does not reach."""
        data = old[:at] + put + old[at + removed :]
        table, shift, same = last[:at], len(put) - removed, 0
        for end in range(at + 1, len(data) + 1):
            token = self.prefixes(data, table, end)[-1]
            if end > at + len(put):
                same = same + 1 if last[end - shift - 1] == token and end - at - len(put) >= 1 else 0
                if same >= self.reach:
                    table.extend(last[end - shift :])
                    break
        return data, table

    def tokens(self, data: bytes, last: list[int] | None = None) -> list[int]:
        last = self.prefixes(data) if last is None else last
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def coder(path: str) -> PrefixCoder:
    with open(path, "rb") as f:
        return PrefixCoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def latin(pattern: str) -> str:
    """The same pattern for texts below U+0100, with the character classes spelled out: the plain re module is faster."""
    members = {c: "".join(re.escape(chr(i)) for i in range(256) if regex.match(c, chr(i))) for c in (r"\s", r"\p{L}", r"\p{N}")}
    inside = False
    out = []
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        if part in members:
            out.append(members[part] if inside else f"[{members[part]}]")
        elif part == r"\S":
            out.append(f"[^{members[chr(92) + 's']}]")
        else:
            inside = {"[": True, "]": False}.get(part, inside)
            out.append(part)
    return "".join(out)


class TextCoder:
    """Splits texts by a pattern and encodes each piece; keeps the pieces it has seen."""

    def __init__(self, path: str, pattern: str):
        self.coder, self.split_any, self.split_latin = coder(path), regex.compile(pattern).findall, re.compile(latin(pattern)).findall
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encodes new pieces in byte order: each takes over the prefix table of what it shares with the one before."""
        if len(self.ids) > KEPT_PIECES:
            self.ids.clear()
            self.raw.clear()
        ids, raw, c = self.ids, self.raw, self.coder
        before, last = b"", []
        for data in sorted(p.encode() for p in pieces if p not in ids):
            same, most = 0, min(len(before), len(data))
            while same < most and before[same] == data[same]:
                same += 1
            del last[same:]
            before = data
            found = c.tokens(data, c.prefixes(data, last))
            piece = data.decode()
            ids[piece] = " ".join(map(str, found))
            raw[piece] = c.decode(found)

    def split(self, text: str) -> list[str]:
        return self.split_latin(text) if text.isascii() or max(text) < "\u0100" else self.split_any(text)

    def encode_all(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Per text, the ids joined by spaces, and the bytes that they decode to."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        ids, raw = self.ids.__getitem__, self.raw.__getitem__
        for pieces in split:
            yield " ".join(map(ids, pieces)), b"".join(map(raw, pieces))

    def encode(self, text: str) -> tuple[str, bytes]:
        return next(self.encode_all([text]))

    def ids_of(self, text: str) -> list[int]:
        return [int(x) for x in self.encode(text)[0].split()]


@lru_cache(maxsize=4)
def text_coder(path: str, pattern: str) -> TextCoder:
    return TextCoder(path, pattern)


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file, as the machine that asks sees it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(column: pa.Array, chars: int = 1_500_000) -> Iterator[list[str]]:
    """Texts of a column in lists of about so many characters; nulls are empty texts."""
    out, size = [], 0
    for text in column:
        out.append(text.as_py() or "")
        size += len(out[-1])
        if size > chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode_documents(docs: DataFrame, name: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = text_coder(vocabulary(name), pattern)
        for batch in batches:
            n, ids_sha, raw_sha, lists = [], [], [], []
            for ids, raw in (x for texts in chunks(batch.column(1)) for x in c.encode_all(texts)):
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                raw_sha.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    lists.append(list(map(int, ids.split())))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(raw_sha)] + ([pa.array(lists, pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"{text_col} as text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
