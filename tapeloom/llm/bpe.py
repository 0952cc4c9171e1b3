"""Byte-level BPE encoding and decoding as a monoid: halves are encoded alone, neighbours are joined at their boundary.

A text is halved down to small leaves. An encoded segment is a list of pieces (matches of the pattern) with the ids of each. Two
segments are joined by splitting and encoding a window about their boundary anew: it starts with two pieces of each side and grows
until its outermost pieces come out as they were. What lies outside is then proved stable: a piece that is matched again as it was
leaves those before it alone (an alternative of the pattern looks no further than the piece that follows), and from a place where
the old and the new pieces meet, matching goes on as before (the pattern never looks back).

The same holds within a long piece, on tokens: halves are merged alone, and a window of tokens about the boundary is merged anew
until the pairs at its ends are stable, that is, until the bytes of both tokens of the pair encode to just these two. A row of tokens
is the encoding of its bytes if that holds of each of its pairs, so all that lies outside stays. Joining is associative and the empty
segment is its unit, so segments may be joined in any tree.
"""

from __future__ import annotations

import functools
import heapq
from array import array

from pyspark.sql import DataFrame

from .common import add_columns

#: Characters of a leaf of the text's tree, bytes of a leaf of a piece's tree, remembered pieces.
LEAF, BYTES, MEMORY = 1_024, 24, 500_000
#: Beyond every rank: the two don't join.
NONE = 1 << 40
#: Pieces of each side with which a window starts.
START = 2


class Merges:
    """Byte-pair merges of one piece: of all neighbours, those whose joint bytes have the least rank are joined first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {rank: token for token, rank in ranks.items()}
        self.stable_pairs: dict[tuple[int, int], bool] = {}

    def direct(self, piece: bytes) -> list[int]:
        """All merges of a short run of bytes, one after the other."""
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        known = [rank(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while known and (best := min(known)) != NONE:
            i = known.index(best)
            joint = parts[i] = parts[i] + parts.pop(i + 1)
            del known[i]
            if i:
                known[i - 1] = rank(parts[i - 1] + joint, NONE)
            if i < len(known):
                known[i] = rank(joint + parts[i + 1], NONE)
        return [self.ranks[x] for x in parts]

    def queued(self, piece: bytes) -> list[int]:
        """The same for a longer run: a queue of neighbours by rank and place, so that time grows with n log n."""
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = after[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two was joined to another since
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(queue, (r, a, len(parts[a]) + len(parts[b])))
        return [ranks[x] for x in parts if x is not None]

    def window(self, piece: bytes) -> list[int]:
        return self.direct(piece) if len(piece) <= 64 else self.queued(piece)

    def stable(self, x: int, y: int) -> bool:
        """Whether the bytes of two tokens encode to just these two."""
        known = self.stable_pairs.get((x, y))
        if known is None:
            known = self.window(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
            if len(self.stable_pairs) < MEMORY:
                self.stable_pairs[x, y] = known
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """Tokens of the bytes of ``a`` followed by those of ``b``."""
        if not a or not b:
            return a or b
        i = j = 1
        while True:
            made = self.window(b"".join(map(self.bytes_of.__getitem__, a[len(a) - i :] + b[:j])))
            left = i == len(a) or self.stable(a[-i - 1], made[0])
            right = j == len(b) or self.stable(made[-1], b[j])
            if left and right:
                return a[: len(a) - i] + made + b[j:]
            i, j = i if left else min(len(a), 2 * i), j if right else min(len(b), 2 * j)

    def encode(self, piece: bytes) -> list[int]:
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        if len(piece) <= BYTES:
            return self.direct(piece)
        middle = len(piece) // 2
        return self.join(self.encode(piece[:middle]), self.encode(piece[middle:]))


class Codec:
    """Encodes and decodes whole texts by a tree of joins. Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF):
        import base64

        import regex

        with open(ranks_path, "rb") as lines:
            self.merges = Merges({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})
        self.split = regex.compile(pattern).findall
        self.leaf, self.memory = leaf, {}

    def piece(self, text: str) -> bytes:
        ids = self.memory.get(text)
        if ids is None:
            ids = array("I", self.merges.encode(text.encode("utf-8", "replace"))).tobytes()
            if len(text) < 64 and len(self.memory) < MEMORY:
                self.memory[text] = ids
        return ids

    def pieces(self, text: str) -> tuple[list[str], list[bytes]]:
        known, piece, parts = self.memory.get, self.piece, self.split(text)
        return parts, [known(x) or piece(x) for x in parts]

    def join(self, a: tuple[list[str], list[bytes]], b: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        """The segment of ``a`` followed by ``b``. ``a`` is extended in place."""
        if not a[0] or not b[0]:
            return a if a[0] else b
        i, j = min(START, len(a[0])), min(START, len(b[0]))
        while True:
            parts = self.split("".join(a[0][len(a[0]) - i :]) + "".join(b[0][:j]))
            left = i == len(a[0]) or parts[0] == a[0][-i]
            right = j == len(b[0]) or parts[-1] == b[0][j - 1]
            if left and right:
                break
            i, j = i if left else min(len(a[0]), 2 * i), j if right else min(len(b[0]), 2 * j)
        met = (a[0][-1] + b[0][0], a[1][-1], b[1][0])  # a long piece that was cut: its halves are encoded already
        ids = [self.joined(*met[1:]) if len(x) > 64 and x == met[0] else self.piece(x) for x in parts]
        del a[0][len(a[0]) - i :], a[1][len(a[1]) - i :]
        for whole, window, rest in zip(a, (parts, ids), b, strict=True):
            whole += window
            whole += rest[j:]
        return a

    def joined(self, a: bytes, b: bytes) -> bytes:
        return array("I", self.merges.join(array("I", a).tolist(), array("I", b).tolist())).tobytes()

    def segment(self, text: str, start: int, end: int) -> tuple[list[str], list[bytes]]:
        if end - start <= self.leaf:
            return self.pieces(text[start:end])
        middle = (start + end) // 2
        return self.join(self.segment(text, start, middle), self.segment(text, middle, end))

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.segment(text, 0, len(text))[1]) if text else b""

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens; halves are decoded alone and concatenated up the tree."""
        if len(ids) <= 4 * self.leaf:
            return b"".join(map(self.merges.bytes_of.__getitem__, memoryview(ids).cast("I")))
        middle = len(ids) // 8 * 4
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@functools.lru_cache(maxsize=1)
def codec_of(ranks_path: str, pattern: str, leaf: int) -> Codec:
    """One codec for all tasks of a Python worker: what it remembers of pieces stays."""
    return Codec(ranks_path, pattern, leaf)


def encode(documents: DataFrame, ranks_path: str, pattern: str, decoded: bool = True, leaf: int = LEAF) -> DataFrame:
    """``documents`` with token_ids (binary: little-endian unsigned 32-bit integers) of the whole text and, if asked for,
    decoded (binary: the bytes that those ids stand for). A null text counts as empty and gives no ids; nulls elsewhere, repeated rows
    and repeated ids pass through; an empty table stays empty. Columns called token_ids or decoded are replaced, others pass through.
    A text without any white space takes time that grows with n log n as well."""

    def make():
        codec = codec_of(ranks_path, pattern, leaf)

        def f(texts):
            ids = [codec.encode(t) for t in texts]
            return {"token_ids": ids} | ({"decoded": [codec.decode(x) for x in ids]} if decoded else {})

        return f

    return add_columns(documents, ["text"], [("token_ids", "binary")] + [("decoded", "binary")] * decoded, make)
