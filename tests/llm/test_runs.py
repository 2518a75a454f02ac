"""Periodic runs against brute force over all starts and periods."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF_TINY
from llm_cases import documents, empty_documents
from pyspark.sql import functions as F

from tessera.llm import runs
from tessera.llm.queries import QUERIES


def plain_runs(words):
    """Every maximal stretch of every period, and the check that no smaller period has it."""
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    w, out = np.array([code[x] for x in words], np.int64), []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]]).astype(np.int8)
        edge = np.diff(same)
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            start, length = i, j - i + q
            part = w[start:start + length]
            if length >= max(6, 4 * q) and not any((part[p:] == part[:-p]).all() for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, letters = rng.randint(0, 70), rng.choice([1, 2, 3, 8])
    words = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
    if n and rng.random() < .6:
        p, a = rng.randint(1, 12), rng.randrange(n)
        words = [words[i] if i < a else words[a + (i - a) % p] if a + (i - a) % p < n else b"y" for i in range(n)]
        words = words + words if rng.random() < .5 else words
        if rng.random() < .3:
            words[rng.randrange(len(words))] = b"z"
    return words


def test_runs_match_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        texts = [random_words(rng) for _ in range(rng.randint(0, 4))]
        assert runs.find_runs(texts) == [plain_runs(w) for w in texts]


def test_runs_inside_runs_and_very_long_texts():
    text = ([b"a"] * 7 + [b"b"]) * 4
    assert runs.find_runs([text]) == [plain_runs(text)] == [[(0, 7, 1), (0, 32, 8), (8, 7, 1), (16, 7, 1), (24, 7, 1)]]
    assert runs.find_runs([[b"word"] * 200_000, []]) == [[(0, 200_000, 1)], []]
    long = [str(i % 50_000).encode() for i in range(200_000)]
    assert runs.find_runs([long]) == [[(0, 200_000, 50_000)]]
    assert runs.collapse([b"x", *[b"a", b"b"] * 4, b"y"], [(1, 8, 2)]) == "x a b y"


def plain_query(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {x for s, length, q in found for x in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_11_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF_TINY).collect()}
    assert got == {plain_query(*r) for r in docs} and len(docs) > 100


@pytest.mark.parametrize("group", [runs.GROUP_WORDS, 3])
def test_runs_of_awkward_rows(spark, group, monkeypatch):
    monkeypatch.setattr(runs, "GROUP_WORDS", group)
    docs = documents(spark)
    got = docs.select("text", runs.periodic_runs(spark, F.col("text")).alias("r"), "words", "label").collect()
    assert len(got) == 11
    for r in got:
        words = runs.words_of(r["text"])
        assert r["r"]["n_words"] == len(words)
        if len(words) < 100:
            assert [tuple(x) for x in r["r"]["runs"]] == plain_runs(words) and r["r"]["collapsed"] == b" ".join(words).decode()
        else:
            assert [tuple(x) for x in r["r"]["runs"]] == [(0, 30_000, 1)]
            assert r["r"]["collapsed"] == "word " + "x" * 20_000
    assert empty_documents(spark).select(runs.periodic_runs(spark, F.col("text"))).collect() == []
