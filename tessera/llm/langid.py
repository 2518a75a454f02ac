"""Language identification with rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3
letters of lower-cased words, word borders as a space), most frequent first.  A
document's own profile is compared to each language's by the out-of-place
distance: the sum over the document's n-grams of the difference of ranks, or
the profile length where the language does not have the n-gram.

Defined cases: text null or without a letter: language ``und``, score 0; no
learned language: ``und``, score 0; equal distances: the first language in
alphabetical order; equal counts: the n-gram with smaller code points first.
The text is read whole, in blocks, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import bound_batches, drop_shared, write_shared

UNDETERMINED = "und"
PROFILE_SIZE = 300
#: Different labelled texts per language that a profile is learned from (expected number).
TRAIN_DOCS = 2000
BLOCK_CHARS = 1 << 20
BROADCAST_LANGUAGES = 10_000
SPACE = 32

PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("runner_up", T.StringType()), T.StructField("n_letters", T.LongType())])

_IS_LETTER: dict[int, bool] = {}


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of non-letters as one
    space, with a space at both ends."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), dtype=np.uint32)
    ascii_letter = (codes >= 97) & (codes <= 122)
    letter = ascii_letter
    other = codes > 127
    if other.any():
        letter = ascii_letter.copy()
        for c in np.unique(codes[other]).tolist():
            known = _IS_LETTER.get(c)
            if known is None:
                known = _IS_LETTER[c] = chr(c).isalpha()
            if known:
                letter |= codes == c
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]  # the first non-letter after a letter stands for the whole run
    return np.where(letter, codes, np.uint32(SPACE))[kept]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """N-gram keys (21 bits per code point) in ascending order, and their counts."""
    codes = letter_codes(text)
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for at in range(0, len(codes), BLOCK_CHARS):
        # n-grams that start in the block; two more codes complete the last ones
        c = codes[at:at + BLOCK_CHARS + 2].astype(np.uint64)
        n_one = min(BLOCK_CHARS, len(codes) - at)
        one = c[:n_one]
        two = (c[:-1][:n_one] << np.uint64(21)) | c[1:][:n_one]
        three = (two[:len(c) - 2] << np.uint64(21)) | c[2:]
        inner = c[1:-1] != SPACE
        k, n = np.unique(np.concatenate([one[one != SPACE], two, three[inner]]), return_counts=True)
        if len(keys):
            k, where = np.unique(np.concatenate([keys, k]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([counts, n])).astype(np.int64)
        keys, counts = k, n
    return keys, counts


def top_keys(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return keys[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE,
                   train_docs: int = TRAIN_DOCS) -> dict[str, list[int]]:
    """Profiles of the languages in ``docs`` (rows with null text or language
    are not used).

    Each language is learned from an expected ``train_docs`` different texts,
    chosen by their hash, or from all when there are fewer; copies of a text
    count once.  Only the profiles (``size`` keys per language) reach the driver.
    """
    bound_batches(docs.sparkSession)
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    # copies go before the count, so a language of few texts keeps them all
    different = labelled.select("lang", F.xxhash64("text").alias("hash")).distinct()
    shares = write_shared(different.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(train_docs)) / F.count("*")).alias("share")), "shares")
    # a checked number of languages is sent to the texts; beyond it Spark plans the join
    few = shares.count() <= BROADCAST_LANGUAGES
    chosen = (labelled.join(F.broadcast(shares) if few else shares, "lang")
              .where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
              .select("lang", "text").distinct())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, group in pdf.groupby("lang"):
                counted = [ngram_counts(t) for t in group["text"]]
                keys, where = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([c for _, c in counted]), minlength=len(keys))
                yield pd.DataFrame({"lang": name, "gram": keys.astype(np.int64), "n": n.astype(np.int64)})

    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (chosen.mapInPandas(count, "lang string, gram long, n long")
           .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
           .withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= size))
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "place", "gram").collect()):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    drop_shared(shares)
    return profiles


class RankTable:
    """Ranks of all profiles' n-grams, one column per language."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(profiles)
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], dtype=np.uint64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int32)  # the last row: unknown n-gram
        for j, name in enumerate(self.langs):
            own = np.array(profiles[name], dtype=np.uint64)
            self.ranks[np.searchsorted(self.keys, own), j] = np.arange(len(own))

    def distances(self, doc: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, doc)
        at[at == len(self.keys)] = 0
        ranks = self.ranks[np.where(self.keys[at] == doc, at, len(self.keys))]
        apart = np.abs(ranks - np.arange(len(doc), dtype=np.int32)[:, None])
        return np.where(ranks < 0, self.size, apart).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float, str | None, int]:
        if not text or not self.langs:
            return UNDETERMINED, 0.0, None, 0
        keys, counts = ngram_counts(text)
        letters = int(counts[keys < 1 << 21].sum())
        if not letters:
            return UNDETERMINED, 0.0, None, 0
        doc = top_keys(keys, counts, self.size)
        apart = self.distances(doc)
        order = np.argsort(apart, kind="stable")
        score = max(0.0, 1.0 - float(apart[order[0]]) / (self.size * len(doc)))
        return self.langs[order[0]], score, self.langs[order[1]] if len(order) > 1 else None, letters


def detect_language(text: Column, profiles: dict[str, list[int]], size: int = PROFILE_SIZE) -> Column:
    """Struct column (lang_pred, score, runner_up, n_letters) of a text column.
    ``score`` is 1 less the smallest distance over the largest possible one."""

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = RankTable(profiles, size)
        for texts in batches:
            yield pd.DataFrame([table.predict(t) for t in texts], columns=PREDICTION.names)

    return predict(text)
