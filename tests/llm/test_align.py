"""Cross-tokenizer alignment against a plain two-pointer walk over both token lists."""
import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_TINY
from llm_cases import documents, empty_documents
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm import align
from tessera.llm.queries import A_PATH, B_PATH, QUERIES


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    letters = align.byte_of_letter()

    def bytes_a(k):
        return bytes(letters[c] for c in a.id_to_token(k))

    def bytes_b(k):
        piece = b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("\u2581", " ").encode()

    def walk(text):
        """(ids of A, ids of B, groups, links) or None."""
        if not text:
            return None
        ids_a, ids_b, want = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text), f" {text}".encode()
        spelt_a, spelt_b = [bytes_a(k) for k in ids_a], [bytes_b(k) for k in ids_b]
        if b"".join(spelt_a) != want or b"".join(spelt_b) != want:
            return None
        i = j = 0
        end_a, end_b = len(spelt_a[0]), len(spelt_b[0])
        links, groups = [], [([ids_a[0]], [ids_b[0]])]
        while True:
            links.append((ids_a[i], ids_b[j]))
            next_a, next_b = end_a <= end_b, end_b <= end_a
            i, j = i + next_a, j + next_b
            if i == len(ids_a):
                break
            if next_a and next_b:
                groups.append(([], []))
            if next_a:
                end_a += len(spelt_a[i])
                groups[-1][0].append(ids_a[i])
            if next_b:
                end_b += len(spelt_b[j])
                groups[-1][1].append(ids_b[j])
        return ids_a, ids_b, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), links, len(groups)
    return walk


def wanted(plain, docs):
    found = [(d, plain(t)) for d, t in docs]
    count = Counter(x for _, f in found if f for x in f[3])
    top = {}
    for (_, b), c in count.items():
        top[b] = max(top.get(b, 0), c)
    return sorted([(d, 0, 0, 0, 0, "", 0, 0) if f is None else
                   (d, len(f[0]), len(f[1]), f[4], len(f[3]), hashlib.sha256(f[2].encode()).hexdigest(),
                    sum(count[x] == top[x[1]] for x in f[3]), sum(count[x] for x in f[3])) for d, f in found], key=str)


def digests(spark, docs):
    from pyspark.sql import functions as F
    table, postings = align.align_documents(spark, docs, A_PATH, B_PATH)
    short = table.withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    return align.alignment_scores(spark, short, postings, align.piece_count(B_PATH))


def test_query_12_matches_brute_force(spark, plain):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_tokenizer_alignment"](spark, SF_TINY).collect()), key=str) == wanted(plain, docs)


def test_alignment_of_awkward_rows(spark, plain):
    texts = ["\u2581 lower block", "<s> <|endoftext|> </s> <unk>", "a\u0000b\x01", " lead and trail  ", "\n\n\t x", "😀😀 né", "e\u0301", "the " * 3000, "\ufffd"]
    docs = documents(spark).select("doc_id", "text", "words", "label")
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, "w", "l") for i, t in enumerate(texts)], docs.schema)).repartition(5)
    got = sorted((tuple(r) for r in digests(spark, docs).collect()), key=str)
    want = wanted(plain, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got == want and (100, 0, 0, 0, 0, "", 0, 0) in got
    assert digests(spark, empty_documents(spark)).collect() == []


def test_small_blocks_and_dense_bitmaps_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    pair, place = rng.integers(0, 5, 60_000), rng.integers(0, 9_000, 60_000)
    pairs, planes, counts, bits = align.bitmaps(pair, place)
    assert any(len(x) == align.BLOCK_DOCS // 8 for x in bits) and any(len(x) < align.BLOCK_DOCS // 8 for x in bits)
    row, held = align.places(bits)
    got = Counter()
    for r, p in zip(row.tolist(), held.tolist()):
        got[int(pairs[r]), p] += 1 if planes[r] < 0 else 2 ** int(planes[r])
    assert got == Counter(zip(pair.tolist(), place.tolist()))
    assert np.bincount(row, minlength=len(bits)).tolist() == counts.tolist()


def test_pair_counts_are_exact(spark, plain):
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text")
    _, postings = align.align_documents(spark, docs, A_PATH, B_PATH)
    got = {(r["a_id"], r["b_id"]): (r["n_docs"], r["n_links"]) for r in align.pair_counts(postings, align.piece_count(B_PATH)).collect()}
    links, holders = Counter(), Counter()
    for r in docs.collect():
        found = plain(r["text"])
        links.update(found[3] if found else [])
        holders.update(set(found[3]) if found else [])
    assert got == {k: (holders[k], n) for k, n in links.items()}


def test_merges_by_rank_equal_the_library():
    with open(A_PATH, "rb") as f:
        level = align.ByteLevel(f.read())
    assert level.fast is not None
    points = [chr(k) for k in range(0, 0x110000, 7) if not 0xD800 <= k < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}{c}b" for c in points[k:k + 100]) for k in range(0, len(points), 100)]
    texts += ["a" * 20_000, " " * 9_000 + "x", "\n" * 9_000, "ab c" * 4_000, "don't WE'LL 's"]
    want = [e.ids for e in level.library.encode_batch(texts, add_special_tokens=False)]
    assert level.encode(texts) == want
