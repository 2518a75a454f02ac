"""Byte-level BPE with a given rank table: encoding and decoding.

Pieces (matches of the split pattern) that are no token themselves are merged
many at a time: pieces of similar length fill the rows of a padded matrix of
token ids; in each round every row merges its leftmost pair of least rank (found
by a hashed pair lookup), closes the gap, and rows without a pair left leave the
matrix.  Pieces longer than ``LONG_PIECE`` bytes, where a row would cost the
square of its length, are merged with a heap; the result is the same.

``encode`` gives the ids as packed little-endian unsigned 32-bit integers
(binary); ``decode`` gives the bytes of packed ids.

Defined cases: null or empty text: no ids; long texts are split and hashed into
pieces in bounded groups; equal rows get equal ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import bound_batches, share

LONG_PIECE = 512
GROUP_CHARS = 1 << 18       # characters of text that are encoded together
GROUP_PIECES = 1 << 16      # pieces of one long text that are encoded together
CACHE_PIECES = 1 << 17      # different pieces whose ids a task remembers
BLOCK_CELLS = 1 << 18       # cells of one padded matrix
MAX_RANK_FILE = 64 << 20
NO_RANK = np.int32(2**31 - 1)


def read_ranks(path: str) -> bytes:
    """The rank file (lines of base64 token and rank); its size is checked, as it
    is sent to the tasks."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE + 1)
    if len(data) > MAX_RANK_FILE:
        raise ValueError(f"rank file larger than {MAX_RANK_FILE} bytes: {path}")
    return data


class PairTable:
    """Open-addressing hash table (left id, right id) -> merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(left)) - 1).bit_length() + 1)
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], merged[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(64 - self.bits - 3)).astype(np.int64) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NO_RANK where the pair does not merge or an id is padding (negative)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], NO_RANK)
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            seen = self.keys[slot[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        out[(left < 0) | (right < 0)] = NO_RANK
        return out


class Vocabulary:
    """Token bytes by id, ids by bytes, and the pair table, from a rank file."""

    def __init__(self, rank_file: bytes):
        rows = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in rows}
        top = max(self.ids.values(), default=-1) + 1
        self.tokens = [b""] * top
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, top)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.tokens) or b"\0", np.uint8)

    @cached_property
    def pairs(self) -> PairTable:
        splits = [(self.ids[t[:k]], self.ids[t[k:]], rank) for t, rank in self.ids.items()
                  for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        left, right, merged = np.array(splits, np.int64).reshape(-1, 3).T
        return PairTable(left, right, merged.astype(np.int32))

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length: one padded row each."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        at = np.arange(width)
        inside = at < lengths[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        ranks = np.concatenate([ranks, np.full((len(pieces), 1), NO_RANK, np.int32)], axis=1)
        out: list = [None] * len(pieces)
        where = np.arange(len(pieces))
        while len(where):
            best = ranks.argmin(axis=1)  # the leftmost of the least
            rows = np.arange(len(where))
            least = ranks[rows, best]
            done = least == NO_RANK
            for r in np.flatnonzero(done).tolist():
                out[where[r]] = ids[r][ids[r] >= 0]
            if done.any():
                keep = ~done
                ids, ranks, where, best, least = ids[keep], ranks[keep], where[keep], best[keep], least[keep]
                if not len(where):
                    break
                used = int((ids >= 0).sum(axis=1).max())
                ids, ranks = ids[:, :used], ranks[:, :used]
                rows = np.arange(len(where))
            width = ids.shape[1]
            ids[rows, best] = least
            source = np.arange(width) + (np.arange(width) > best[:, None])
            closed = np.minimum(source, width - 1)
            ids = np.take_along_axis(ids, closed, axis=1)
            ids[:, -1] = -1
            # the rank of the merged pair goes; those of its two neighbours are looked up again
            ranks = np.take_along_axis(ranks, closed, axis=1)
            ranks[:, -1] = NO_RANK
            after = np.minimum(best + 1, width - 1)
            ranks[rows, best] = np.where(best + 1 < width, self.pairs.get(ids[rows, best], ids[rows, after]), NO_RANK)
            has_left = np.flatnonzero(best > 0)
            prev = best[has_left] - 1
            ranks[has_left, prev] = self.pairs.get(ids[has_left, prev], ids[has_left, prev + 1])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: the same merges from a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        none = int(NO_RANK)
        rank_at = [*first, none]
        heap = [(r, k) for k, r in enumerate(first) if r != none]
        heapq.heapify(heap)
        alive = [True] * n
        tokens, known = self.tokens, self.ids
        while heap:
            r, k = heapq.heappop(heap)
            if not alive[k] or rank_at[k] != r:
                continue
            gone = after[k]
            ids[k], alive[gone] = r, False
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            for p in (before[k], k):
                if p < 0:
                    continue
                q = after[p]
                rank_at[p] = known.get(tokens[ids[p]] + tokens[ids[q]], none) if q < n else none
                if rank_at[p] != none:
                    heapq.heappush(heap, (rank_at[p], p))
        return np.array([x for x, a in zip(ids, alive) if a], np.int32)

    def merge_all(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of any pieces, bucket by bucket of length."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            token = self.ids.get(piece)
            if token is not None:
                out[k] = np.array([token], np.int32)
            elif len(piece) > LONG_PIECE:
                out[k] = self.merge_long(piece)
            else:  # widths 2, 3, ... 16, then powers of two
                n = len(piece)
                buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(k)
        for width, members in buckets.items():
            step = max(1, BLOCK_CELLS // width)
            for at in range(0, len(members), step):
                part = members[at:at + step]
                for k, ids in zip(part, self.merge_rows([pieces[k] for k in part])):
                    out[k] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a list of ids, gathered from the flat token bytes."""
        parts = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at:at + (1 << 18)].astype(np.int64)
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            take = np.repeat(self.starts[part] - (ends - lengths), lengths) + np.arange(ends[-1])
            parts.append(self.flat[take].tobytes())
        return b"".join(parts)


class Encoder:
    """Encodes texts; remembers the ids of up to ``CACHE_PIECES`` different pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.starts, self.lengths = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.used = 0

    def learn(self, pieces: list[str]) -> None:
        found = self.vocabulary.merge_all([p.encode() for p in pieces])
        if not found:
            return
        n, lengths = len(self.place), np.fromiter(map(len, found), np.int64, len(found))
        total = int(lengths.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + len(found) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.ids[self.used:self.used + total] = np.concatenate(found)
        self.lengths[n:n + len(found)] = lengths
        self.starts[n:n + len(found)] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.place.update(zip(pieces, range(n, n + len(pieces))))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in a row, and the number of ids of each piece."""
        if len(self.place) > CACHE_PIECES:
            self.forget()
        self.learn(list(set(pieces).difference(self.place)))
        at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        take = np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[take], lengths

    def encode_long(self, text: str) -> bytes:
        matches = (m[0] for m in self.pattern.finditer(text))
        out = []
        while part := list(islice(matches, GROUP_PIECES)):
            out.append(self.encode_pieces(part)[0].astype("<u4").tobytes())
        return b"".join(out)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        found = [self.pattern.findall(t) for t in texts]
        ids, lengths = self.encode_pieces(list(chain.from_iterable(found)))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([len(f) for f in found])]
        packed, out, at = memoryview(ids.astype("<u4").tobytes()), [], 0
        for end in (ends * 4).tolist():
            out.append(bytes(packed[at:end]))
            at = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for t in texts:
            if size + len(t) > GROUP_CHARS and group:
                out += self.encode_batch(group)
                group, size = [], 0
            if len(t) > GROUP_CHARS:
                out.append(self.encode_long(t))
            else:
                group.append(t)
                size += len(t)
        return out + (self.encode_batch(group) if group else [])


@lru_cache(maxsize=2)
def _vocabulary(rank_file: bytes) -> Vocabulary:
    """One vocabulary per Python worker, kept between its tasks."""
    return Vocabulary(rank_file)


@lru_cache(maxsize=2)
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(_vocabulary(rank_file), pattern)


def bpe_encode(spark: SparkSession, text: Column, rank_path: str, pattern: str) -> Column:
    """Packed ids of a text column (null: no ids)."""
    bound_batches(spark)
    ranks = share(spark, read_ranks(rank_path))

    @F.pandas_udf(T.BinaryType())
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(ranks(), pattern)
        for texts in batches:
            yield pd.Series(encoder.encode([t or "" for t in texts]), dtype=object)

    return encode(text)


CHECKED = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType()),
                        T.StructField("round_trip", T.BooleanType())])


def bpe_round_trip(spark: SparkSession, text: Column, rank_path: str, pattern: str, keep_decoded: bool = True) -> Column:
    """Struct column (ids, decoded, round_trip) of a text column: the packed ids,
    the bytes that they decode to (null without ``keep_decoded``), and whether
    those are the bytes of the text.  One Python worker does both ways."""
    bound_batches(spark)
    ranks = share(spark, read_ranks(rank_path))

    @F.pandas_udf(CHECKED)
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(ranks(), pattern)
        for texts in batches:
            ids = encoder.encode([t or "" for t in texts])
            decoded, same = [], []
            for packed, t in zip(ids, texts):
                back = encoder.vocabulary.decode(np.frombuffer(packed, "<u4"))
                same.append(back == (t or "").encode())
                decoded.append(back if keep_decoded else None)
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(decoded, dtype=object), "round_trip": same})

    return both(text)


def bpe_decode(spark: SparkSession, ids: Column, rank_path: str) -> Column:
    """Bytes of a column of packed ids (null: no bytes)."""
    bound_batches(spark)
    ranks = share(spark, read_ranks(rank_path))

    @F.pandas_udf(T.BinaryType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = _vocabulary(ranks())
        for packed in batches:
            yield pd.Series([vocabulary.decode(np.frombuffer(p or b"", "<u4")) for p in packed], dtype=object)

    return decode(ids)
