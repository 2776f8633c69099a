"""Byte-level BPE encoding and decoding as reductions over a tree.

Encoding a piece is a monoid: the encodings of its two halves determine the encoding of the whole.
``_join`` puts two encodings together. Where the tokens at the seam may stand side by side, the two
are concatenated. Otherwise a window around the seam is encoded again and grows, on the side that is
not settled, until the tokens just outside may stand next to the new ones.

That test is exact. A token sequence is the BPE encoding of its bytes if and only if every adjacent
pair of it is the encoding of its own bytes: a merge across a seam that BPE would make in the whole
sequence is made in the pair alone as well. So once the two pairs at the window's ends hold, no token
further out can change.

Texts are cut into the pieces of the tokenizer's pattern first, and pieces are encoded on their own,
as the vocabulary's own library does. Words recur, so the packed ids of a word (with its leading
space) are remembered, in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setframe.llm.columns import ship, struct_array, texts

LEAF_BYTES = 16
SHORT_BYTES = 16
NO_RANK = 1 << 62
#: Entries that a worker's tables remember: words, short strings, pairs of tokens; some 70 MB in all.
REMEMBERED_WORDS, REMEMBERED_SHORT, REMEMBERED_PAIRS = 3 << 17, 1 << 16, 1 << 16
REMEMBERED_CHARS = 64
_BLOCK_IDS = 1 << 16
#: Kinds of characters around single spaces: a pattern that puts such a space inside a piece, or at
#: its end, is not taken word by word.
_PROBE = " ".join(["a", "Bc", "1", "23", ",", ".", "'s", "d'e", "é", "世界", "-", "(f)", "g_h", "#", "😀", "i"])
# A space that does not start a piece: before white space or at the end.
_LOOSE_SPACE = re.compile(r" (?=\s|\Z)")


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in data.splitlines() if line)}


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Recent(dict):
    """A table of at most ``limit`` entries. When half of them are new, all older ones go; what
    is looked up again in time is new again. A missing key is computed by ``made``."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit = limit
        self._older: dict = {}

    def __missing__(self, key):
        value = self._older.get(key)
        if value is None:
            value = self.made(key)
            if not self.worth(key):
                return value
        if len(self) >= self.limit // 2:
            self._older = dict(self)
            self.clear()
        self[key] = value
        return value

    def made(self, key):
        raise NotImplementedError

    def worth(self, key) -> bool:
        return True


class _Words(_Recent):
    """Packed ids by word; words not seen before are encoded when looked up.

    A word of ASCII letters is one piece, and a full stop or comma after it another.
    """

    def __init__(self, codec: BytePairCodec, lead: str) -> None:
        super().__init__(REMEMBERED_WORDS)
        self.codec, self.lead = codec, lead

    def worth(self, word: str) -> bool:
        return len(word) <= REMEMBERED_CHARS

    def made(self, word: str) -> bytes:
        stem = word[:-1]
        if word.isalpha() and word.isascii():
            return pack_ids(self.codec.encode_piece((self.lead + word).encode()))
        if stem.isalpha() and word.isascii() and word[-1] in ".,":
            return self[stem] + self.codec.pack(word[-1])
        return self.codec.pack(self.lead + word)


class _Short(_Recent):
    """The encoding of short strings: leaves and windows recur all the time."""

    def __init__(self, codec: BytePairCodec) -> None:
        super().__init__(REMEMBERED_SHORT)
        self.codec = codec

    def made(self, data: bytes) -> list[int]:
        return self.codec.merge(data)


class _Adjoining(_Recent):
    """Whether two tokens may stand side by side."""

    def __init__(self, codec: BytePairCodec) -> None:
        super().__init__(REMEMBERED_PAIRS)
        self.codec = codec

    def made(self, pair: tuple[int, int]) -> bool:
        a, b = pair
        return self.codec.merge(self.codec.token[a] + self.codec.token[b]) == [a, b]


class BytePairCodec:
    """Encode and decode by the ranks of a vocabulary that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self._short, self._pairs = _Short(self), _Adjoining(self)
        self._first, self._later = _Words(self, ""), _Words(self, " ")
        pieces = self.pattern.findall(_PROBE)
        self._by_word = "".join(pieces) == _PROBE and not any(" " in p[1:] for p in pieces)

    # ---- one piece ----------------------------------------------------------------------

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token is that token."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        # Words are remembered as such; only parts of longer pieces go through the tables.
        return self.merge(piece) if len(piece) <= LEAF_BYTES else self._tree(piece)

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self._merged(data)
        # A power of two on the left keeps the halves of periodic texts aligned.
        middle = 1 << (len(data) - 1).bit_length() - 1
        return self._join(self._tree(data[:middle]), self._tree(data[middle:]))

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self._may_adjoin(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self._merged(self.decode(left[-i:] + right[:j]))
            left_holds = i == len(left) or self._may_adjoin(left[-i - 1], window[0])
            right_holds = j == len(right) or self._may_adjoin(window[-1], right[j])
            if left_holds and right_holds:
                return left[:len(left) - i] + window + right[j:]
            i = i if left_holds else min(len(left), 2 * i)
            j = j if right_holds else min(len(right), 2 * j)

    def _may_adjoin(self, a: int, b: int) -> bool:
        return self._pairs[a, b]

    def _merged(self, data: bytes) -> list[int]:
        """``merge``, remembering short strings."""
        return self._short[data] if len(data) <= SHORT_BYTES else self.merge(data)

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: merge the pair of lowest rank, the leftmost of equals, while there is one."""
        if len(data) > SHORT_BYTES:
            return self._merge_by_queue(data)
        parts, get = [data[i:i + 1] for i in range(len(data))], self.ranks.get
        costs = [get(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (least := min(costs)) < NO_RANK:
            i = costs.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], NO_RANK)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
        return [self.ranks[p] for p in parts]

    def _merge_by_queue(self, data: bytes) -> list[int]:
        """The same for long strings, in time n log n."""
        ranks, n = self.ranks, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end, alive = list(range(1, n + 1)), [True] * n
        queue = [(rank, i, i + 2) for i in range(n - 1)
                 if (rank := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                rank = ranks.get(data[i:end[after[i]]])
                if rank is not None:
                    heapq.heappush(queue, (rank, i, end[after[i]]))
            if before[i] >= 0:
                rank = ranks.get(data[before[i]:stop])
                if rank is not None:
                    heapq.heappush(queue, (rank, before[i], stop))
        return [ranks[data[i:end[i]]] for i in range(n) if alive[i]]

    # ---- texts --------------------------------------------------------------------------

    def pack(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers, piece by piece."""
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.encode_piece(piece.encode())
        return pack_ids(ids)

    def encode(self, text: str) -> bytes:
        """Like ``pack``, word by word: a space before a visible character starts a piece, so a
        text without loose spaces is the concatenation of its words. Where the pattern has spaces
        elsewhere, the text is taken whole."""
        if not self._by_word or _LOOSE_SPACE.search(text):
            return self.pack(text)
        first, *later = text.split(" ")
        return self._first[first] + b"".join(map(self._later.__getitem__, later))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode_packed(self, packed: bytes) -> bytes:
        """The bytes of packed ids: blocks are decoded and concatenated up a tree."""
        ids = np.frombuffer(packed, "<u4")
        if len(ids) <= _BLOCK_IDS:
            return self.decode(ids.tolist())
        middle = 4 * (len(ids) // 2)
        return self.decode_packed(packed[:middle]) + self.decode_packed(packed[middle:])


@lru_cache(maxsize=2)
def codec_of(data: bytes, pattern: str) -> BytePairCodec:
    """One codec for each worker process and vocabulary."""
    return BytePairCodec(parse_ranks(data), pattern)


class Vocabulary:
    """A vocabulary file (fixed size, under a megabyte) sent to the workers once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        ship(spark)
        with open(path, "rb") as file:
            self._data = spark.sparkContext.broadcast(file.read())
        self._pattern = pattern

    def codec(self) -> BytePairCodec:
        return codec_of(self._data.value, self._pattern)

    def __reduce__(self):
        return _restored, (self._data, self._pattern)


def _restored(data, pattern: str) -> Vocabulary:
    out = object.__new__(Vocabulary)
    out._data, out._pattern = data, pattern
    return out


def encoded(text: str | Column, vocabulary: Vocabulary) -> Column:
    """Token ids of a text column as ``binary``, little-endian unsigned 32-bit; NULL reads as empty."""
    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        codec = vocabulary.codec()
        return pa.array([codec.encode(t) for t in texts(values)], pa.binary())
    return encode(text)


def decoded(ids: str | Column, vocabulary: Vocabulary) -> Column:
    """The bytes of ids made by :func:`encoded`; NULL stays NULL."""
    @F.arrow_udf("binary")
    def decode(values: pa.Array) -> pa.Array:
        codec = vocabulary.codec()
        return pa.array([None if v is None else codec.decode_packed(v)
                         for v in values.to_pylist()], pa.binary())
    return decode(ids)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Encode and decode every text and return digests of both directions.

    One row for every input row (repeated rows and NULL keys included): the key, ``n_tokens``,
    ``ids_sha256`` over the packed ids, ``decoded_sha256`` over the decoded bytes. NULL and empty
    texts have no tokens. Other columns are not read. There is no shuffle.
    """
    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digest(values: pa.Array) -> pa.Array:
        codec, n, ids_hex, text_hex = vocabulary.codec(), [], [], []
        for value in texts(values):
            packed = codec.encode(value)
            n.append(len(packed) // 4)
            ids_hex.append(hashlib.sha256(packed).hexdigest())
            text_hex.append(hashlib.sha256(codec.decode_packed(packed)).hexdigest())
        return struct_array(n_tokens=pa.array(n, pa.int64()),
                            ids_sha256=pa.array(ids_hex, pa.string()),
                            decoded_sha256=pa.array(text_hex, pa.string()))
    return docs.select(F.col(key), digest(text).alias("digest")).select(key, "digest.*")
