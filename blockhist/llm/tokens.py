"""Token counts by byte-pair merging, without making the tokens.

A text is cut at the special strings (one token each) and by the pre-tokeniser's pattern. In every
distinct piece the adjacent pair of lowest rank is merged again and again, the leftmost of equals:
the pairs wait in a heap, the symbols stand in a linked list, so a piece of n bytes costs
O(n log n) however long it is. The count is the bytes less the merges.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .names import with_struct

#: Pieces whose count a task remembers.
REMEMBERED = 300_000
#: The pre-tokeniser's pattern for this family of vocabularies, with the white space
#: it knows written out.
BLANK = r"\t-\r\x20\x85\xA0  -     　"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+"
           rf"|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters for themselves, the others in turn from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in printable}
    for i, b in enumerate(b for b in range(256) if b not in printable):
        out[chr(0x100 + i)] = b
    return out


def read_vocabulary(path: str) -> dict:
    """Merge ranks and special strings of a byte-level tokenizer file; read on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    back = byte_symbols()
    ranks = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks[bytes(back[c] for c in left), bytes(back[c] for c in right)] = rank
    return {"ranks": ranks, "special": [t["content"] for t in spec["added_tokens"]],
            "prefix_space": bool(spec["pre_tokenizer"].get("add_prefix_space"))}


class Counter:
    def __init__(self, vocabulary: dict):
        self.ranks, self.prefix = vocabulary["ranks"], " " if vocabulary["prefix_space"] else ""
        special = sorted(vocabulary["special"], key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Symbols left of one piece."""
        n = len(piece)
        symbol = [piece[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.ranks.get, []
        for i in range(n - 1):
            if (r := rank((symbol[i], symbol[i + 1]))) is not None:
                heap.append((r, i, symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = a + b, b""
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbol[i], symbol[k]))
            h = before[i]
            if h >= 0 and (r := rank((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (r, h, symbol[h], symbol[i]))
        return left

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, known = 0, self.known
        for piece in self.pieces(self.prefix + text if self.prefix and not text.startswith(" ") else text):
            n = known.get(piece)
            if n is None:
                n = self.merged(piece.encode())
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


def count_tokens(docs: DataFrame, vocabulary: dict, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (text and any others) with one more column, the struct ``tokens`` (or ``tokens_`` if
    that name is taken): n_bytes, n_tokens. ``carry`` names the columns to return, all by default.

    A null or empty text has no bytes and no tokens. Special strings inside a text are one token
    each. Nothing is added at either end, no text is cut. The vocabulary has a fixed size and is
    sent to every executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        counter = Counter(shared.value)

        def judge(column):
            texts = [t.as_py() or "" for t in column]
            return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([counter.count(t) for t in texts], pa.int64())]
        return judge
    return with_struct(docs, "tokens", "text", pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64())]), start, carry)
