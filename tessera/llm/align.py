"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes,
and how often each pair of tokens does so in the corpus.

Each text is encoded as space + text by A (a byte-level BPE) and as text by B (a
sentencepiece model, which puts the space in front).  Byte offsets where tokens of
both end cut the tokens into groups; an A and a B token are linked where their
byte ranges overlap.

Pairs are counted by inverted bitmaps.  Documents are numbered (block, place) as
they are read; a block has at most ``BLOCK_DOCS`` documents.  Per block and pair
there is one compressed bitmap of the documents that hold the pair (plane -1), the
union over its batches, and one per binary digit of the links beyond the first
(planes 0, 1, ...).  A bitmap is the sorted 16-bit places of its documents, or
``BLOCK_DOCS`` bits where those are shorter.  Bitmaps of different blocks have no
document in common, so popcounts add up: plane -1 counts documents, and a link
count is the sum of popcounts weighted 1 (plane -1) and 2**plane.  The bitmaps,
joined with the counts of their pairs and dealt out by block, return the scores of
the documents.  Neither texts nor document-pair rows are shuffled, a frequent
pair has a row per block and plane, and no task holds more than a block.

Defined cases: a null or empty text, and one whose tokens do not spell space + text
(say one with U+2581, which B writes for a space), has no tokens: zeros, '' as
groups and scores 0.  Equal rows are separate documents with equal results; a
repeated or null document id is carried along; empty table: no rows; other
columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.session import bound_batches, share, write_shared

BLOCK_DOCS = 1 << 14
BLOCK_LINKS = 1 << 22       # links after which a block is closed, too
GROUP_BYTES = 1 << 20       # bytes of text that are aligned together
LONG_WORD = 1 << 13         # characters of a word or gap from which on the merges of A are left to its own library
MAX_FILE = 64 << 20

_LONG = re.compile(rf"\S{{{LONG_WORD}}}|\s{{{LONG_WORD}}}")


def read_file(path: str) -> bytes:
    """A vocabulary file; its size is checked, as it is sent to the tasks."""
    with open(path, "rb") as f:
        data = f.read(MAX_FILE + 1)
    if len(data) > MAX_FILE:
        raise ValueError(f"vocabulary file larger than {MAX_FILE} bytes: {path}")
    return data


def byte_of_letter() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, reversed: printable
    bytes stand for themselves, the others for the letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def as_ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(lengths.sum())), lengths


class ByteLevel:
    """Tokenizer A from its JSON file.

    Merges are done by rank (tiktoken) where that is known to give the same ids:
    the merges are listed in the order of the ids they make, and every token that
    a merge makes is what its own text is encoded to.  Then an adjacent pair that
    spells a token is the listed pair of that token: up to there its bytes were
    merged as in the token alone.  Otherwise, and for texts with very long words,
    the library of the file encodes."""

    def __init__(self, data: bytes):
        self.library = Tokenizer.from_str(data.decode())
        self.library.encode_special_tokens = True
        spec = json.loads(data)
        letters = byte_of_letter()
        vocabulary = spec["model"]["vocab"]
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, k in vocabulary.items():
            self.bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.fast = self._by_rank(spec, vocabulary)

    def _by_rank(self, spec: dict, vocabulary: dict[str, int]) -> tiktoken.Encoding | None:
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [vocabulary[m] for m in made]
        known = {c: vocabulary[c] for c in byte_of_letter() if c in vocabulary} | dict(zip(made, order))
        plain = (split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer")
                 and not model.get("dropout") and len(known) == 256 + len(made) and order == sorted(order)
                 and max(known[c] for c in byte_of_letter()) < min(order, default=256))
        if not plain or any([t.id for t in self.library.model.tokenize(m)] != [k] for m, k in zip(made, order)):
            return None
        from public_tokenizers import PATTERN  # the split of byte-level pre-tokenizers
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.bytes[k]: k for k in known.values()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return [self.fast.encode_ordinary(t) if len(t) < LONG_WORD or not _LONG.search(t)
                else self.library.encode(t, add_special_tokens=False).ids for t in texts]


class Pieces:
    """Tokenizer B from its model file."""

    def __init__(self, data: bytes):
        self.library = SentencePieceProcessor(model_proto=data)
        n = self.library.piece_size()
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.library.is_byte(k) else p.replace("▁", " ").encode()
                      for k, p in enumerate(self.library.id_to_piece(list(range(n))))]
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, n)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@dataclass
class Aligned:
    """Per text: counts and groups; ``pair`` and ``place`` of every link, by text."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pair: np.ndarray
    place: np.ndarray


class Aligner:
    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.width = len(self.b.bytes)
        # a token in the groups string, followed by nothing, a comma, a bar or a semicolon
        most = max(len(self.a.bytes), len(self.b.bytes))
        self.shown = [f"{k}{end}" for k in range(most) for end in ("", ",", "|", ";")]

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none for a text that they do not both spell."""
        some = [t for t in texts if t]
        both = zip(some, self.a.encode([f" {t}" for t in some]), self.b.encode(some) if some else [])
        a, b = [], []
        for t in texts:
            if not t:
                ids_a, ids_b = [], []
            else:
                _, ids_a, ids_b = next(both)
                want = f" {t}".encode()
                if b"".join(map(self.a.bytes.__getitem__, ids_a)) != want or b"".join(map(self.b.bytes.__getitem__, ids_b)) != want:
                    ids_a, ids_b = [], []
            a.append(ids_a)
            b.append(ids_b)
        return a, b

    def align(self, texts: list[str | None]) -> Aligned:
        a, b = self.tokens(texts)
        (ids_a, n_a), (ids_b, n_b) = as_ids(a), as_ids(b)
        n = len(texts)
        doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        # all texts on one line of bytes: the end of a text is an end of both
        end_a, end_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        again = np.flatnonzero(ends[1:] == ends[:-1])
        common = ends[again]
        ends = np.delete(ends, again)
        # between neighbouring ends exactly one pair of tokens overlaps
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        place = doc_a[at_a]
        doc_of_group = doc_a[np.searchsorted(end_a, common)]
        # the tokens in the order of the groups, A before B
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        group = np.concatenate([np.searchsorted(common, end_a), np.searchsorted(common, end_b)])
        block = 2 * group + side
        order = np.argsort(block, kind="stable")
        block, ids, doc = block[order], np.concatenate([ids_a, ids_b])[order], np.concatenate([doc_a, doc_b])[order]
        sign = np.ones(len(ids), np.int64)
        sign[:-1] += np.where(block[1:] == block[:-1], 0, 1 + (block[:-1] & 1))
        cut = np.searchsorted(doc, np.arange(n + 1))
        sign[cut[1:][cut[1:] > cut[:-1]] - 1] = 0
        shown = list(map(self.shown.__getitem__, (4 * ids + sign).tolist()))
        groups = ["".join(shown[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return Aligned(n_a, n_b, np.bincount(doc_of_group, minlength=n), np.bincount(place, minlength=n), groups,
                       ids_a[at_a] * self.width + ids_b[at_b], place)


def bitmaps(pair: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The links of one block as bitmaps: pair, plane, popcount, bits."""
    key, links = np.unique(pair * BLOCK_DOCS + place, return_counts=True)
    pair, place = key // BLOCK_DOCS, (key % BLOCK_DOCS).astype("<u2")
    out = []
    for plane in range(-1, int((links.max(initial=1) - 1)).bit_length()):
        chosen = np.flatnonzero((links - 1 >> plane) & 1) if plane >= 0 else np.arange(len(pair))
        if not len(chosen):
            continue
        of, held = pair[chosen], place[chosen]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        count = np.diff(np.append(first, len(of)))
        raw = memoryview(held.tobytes())
        bits = [bytes(raw[2 * x:2 * (x + n)]) for x, n in zip(first.tolist(), count.tolist())]
        for k in np.flatnonzero(2 * count >= BLOCK_DOCS // 8).tolist():
            one = np.zeros(BLOCK_DOCS, bool)
            one[held[first[k]:first[k] + count[k]]] = True
            bits[k] = np.packbits(one, bitorder="little").tobytes()
        out.append((of[first], np.full(len(first), plane), count, bits))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), []
    pairs, planes, counts, bits = zip(*out)
    return np.concatenate(pairs), np.concatenate(planes), np.concatenate(counts), list(chain.from_iterable(bits))


def places(bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every document in a list of bitmaps."""
    dense = np.fromiter((len(x) == BLOCK_DOCS // 8 for x in bits), bool, len(bits))
    rows, held = [], []
    sparse = np.flatnonzero(~dense)
    if len(sparse):
        chosen = [bits[k] for k in sparse.tolist()]
        rows.append(np.repeat(sparse, np.fromiter(map(len, chosen), np.int64, len(chosen)) // 2))
        held.append(np.frombuffer(b"".join(chosen), "<u2").astype(np.int64))
    for k in np.flatnonzero(dense).tolist():
        held.append(np.flatnonzero(np.unpackbits(np.frombuffer(bits[k], np.uint8), bitorder="little")))
        rows.append(np.full(len(held[-1]), k))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(held)


@lru_cache(maxsize=1)
def _aligner(a: bytes, b: bytes) -> Aligner:
    """One pair of tokenizers per Python worker, kept between its tasks."""
    return Aligner(a, b)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum([0, *(len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1))])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + GROUP_BYTES, "right")) - 1)
            yield batch.slice(at, min(to - at, BLOCK_DOCS))
            at += min(to - at, BLOCK_DOCS)


DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups string"
POSTING = "pair long, plane int, n_docs long, bits binary"


def align_documents(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id",
                    text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The aligned documents (block, place, doc_id, n_a, n_b, n_groups, n_links,
    groups) and the bitmaps of their pairs (block, pair, plane, n_docs, bits), both
    read from one table in the shared folder.  A pair is A id * size of B + B id."""
    bound_batches(spark)
    a, b = share(spark, read_file(a_path)), share(spark, read_file(b_path))
    key = T.StructField("doc_id", docs.schema[doc_id].dataType)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), key,
                           *T._parse_datatype_string(DOCUMENT), *T._parse_datatype_string(POSTING)])
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(schema)

    def batch_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in out], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a(), b())
        block, used = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        links = 0

        def postings() -> Iterator[pa.RecordBatch]:
            pair, plane, n, bits = bitmaps(*(np.concatenate(x) for x in zip(*held)))
            for at in range(0, len(bits), 1 << 15):
                part = slice(at, at + (1 << 15))
                size = len(bits[part])
                yield batch_of({"block": pa.array(np.full(size, block)), "pair": pa.array(pair[part]), "plane": pa.array(plane[part]),
                                "n_docs": pa.array(n[part]), "bits": pa.array(bits[part], pa.binary())})

        for batch in _grouped(batches):
            n = batch.num_rows
            if held and (used + n > BLOCK_DOCS or links >= BLOCK_LINKS):
                yield from postings()
                block, used, held, links = block + 1, 0, [], 0
            found = aligner.align(batch.column(1).to_pylist())
            yield batch_of({"block": pa.array(np.full(n, block)), "place": pa.array(used + np.arange(n)), "doc_id": batch.column(0),
                            **{c: pa.array(getattr(found, c)) for c in ("n_a", "n_b", "n_groups", "n_links", "groups")}})
            held.append((found.pair, found.place + used))
            used, links = used + n, links + len(found.pair)
        if held:
            yield from postings()

    stored = write_shared(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema), "alignment")
    return (stored.where("place IS NOT NULL").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"),
            stored.where("pair IS NOT NULL").select("block", "pair", "plane", "n_docs", "bits"))


def pair_counts(postings: DataFrame, n_b_ids: int) -> DataFrame:
    """pair, a_id, b_id, n_docs, n_links, best (no pair of its B id has more links)."""
    weight = F.when(F.col("plane") < 0, F.lit(1)).otherwise(F.expr("shiftleft(1L, plane)"))
    counted = postings.groupBy("pair").agg(F.sum(F.when(F.col("plane") < 0, F.col("n_docs"))).alias("n_docs"),
                                           F.sum(F.col("n_docs") * weight).alias("n_links"))
    ids = counted.select("pair", F.expr(f"pair div {n_b_ids}").alias("a_id"), (F.col("pair") % n_b_ids).alias("b_id"), "n_docs", "n_links")
    return ids.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b_id")))


def document_scores(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """block, place, n_best, count_sum: over the links of a document, how many belong
    to a best pair, and the sum of the link counts of their pairs."""
    scored = (postings.join(pairs.select("pair", "n_links", "best").hint("merge"), "pair").select("block", "plane", "bits", "n_links", "best")
              .repartition("block").sortWithinPartitions("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, None

        def result() -> pa.RecordBatch:
            held = np.flatnonzero(sums[1])  # a link's pair has at least itself
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), block)), pa.array(held.astype(np.int32)),
                                               pa.array(sums[0][held]), pa.array(sums[1][held])], ["block", "place", "n_best", "count_sum"])

        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            for at, to in zip(cut := np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), np.append(cut[1:], len(blocks))):
                if blocks[at] != block:
                    if sums is not None:
                        yield result()
                    block, sums = int(blocks[at]), np.zeros((2, BLOCK_DOCS), np.int64)
                part = batch.slice(at, to - at)
                plane, counts, best = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 3, 4))
                weight = np.left_shift(1, np.maximum(plane, 0))
                row, place = places(part.column(2).to_pylist())
                np.add.at(sums[0], place, (weight * best)[row])
                np.add.at(sums[1], place, (weight * counts)[row])
        if sums is not None:
            yield result()

    return scored.mapInArrow(run, "block long, place int, n_best long, count_sum long")


def alignment_scores(spark: SparkSession, documents: DataFrame, postings: DataFrame, n_b_ids: int) -> DataFrame:
    """``documents`` (block, place and any columns) with n_best and count_sum."""
    scores = document_scores(postings, pair_counts(postings, n_b_ids))
    joined = documents.join(scores, ["block", "place"], "left")
    return joined.select(*[c for c in documents.columns if c not in ("block", "place")],
                         *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")])


def piece_count(b_path: str) -> int:
    return SentencePieceProcessor(model_proto=read_file(b_path)).piece_size()
