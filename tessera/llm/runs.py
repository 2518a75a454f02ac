"""Periodic runs of words: stretches that repeat a block of words, and a text
without the repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and length >= max(MIN_WORDS, MIN_PERIODS * q) that no neighbouring word
extends keeping period q.

An online sparse diagonal DP over the words of a text: each word's earlier
occurrences increment the match lengths of their lags; a lag that does not match
any more ends its diagonal, which is emitted at once if the run is long enough.
The DP is sparse, as a word of a long text has many earlier occurrences: lag q
counts only where the block of the last 2**k >= q words (the least such power)
occurred q words earlier and not nearer.  No run is lost by that: a run has at
least MIN_PERIODS periods, so such a block lies inside of it, and within a run the
nearest earlier occurrence of a block of at least q words is exactly q words away;
a lag that is no smallest period never counts, as its blocks occur nearer.  Blocks
are named by doubling, and a block that does not recur is not doubled.  Work is
O(n log n) for n words whatever they are, ordinary texts leave after a few
doublings; memory is linear in the longest text.

Words are the matches of ``[^\\x20\\x09-\\x0D]+``.  Null, empty and blank texts have no
words, no runs and an empty collapsed text; equal rows get equal results; an
empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.session import bound_batches

MIN_WORDS, MIN_PERIODS = 6, 4
GROUP_WORDS = 1 << 18       # words of several texts that are scanned together

RUNS = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"

Run = tuple[int, int, int]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: bytes split at exactly the white space of the pattern."""
    return (text or "").encode().split()


def recurrences(names: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For block sizes 1, 2, 4, ...: the size, the places of blocks whose nearest
    earlier occurrence is more than half a size and at most a size away, and those
    lags.  ``names``: a number per word, different in different texts."""
    at, size = np.arange(len(names)), 1
    while len(at) and (size == 1 or size * MIN_PERIODS < 2 * longest):
        order = np.argsort(names, kind="stable")
        ranked = names[order]
        same = ranked[1:] == ranked[:-1]
        before, after = order[:-1], order[1:]
        lag = at[after] - at[before]
        near = same & (lag <= size) & (2 * lag > size)
        yield size, at[after[near]], lag[near]
        recurs = np.zeros(len(at), bool)
        recurs[before[same]] = recurs[after[same]] = True
        rank = np.empty(len(at), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(~same)])
        halves, rank = at[recurs], rank[recurs]
        right = np.searchsorted(halves, halves + size)
        whole = np.flatnonzero(right < len(halves))
        whole = whole[halves[right[whole]] == halves[whole] + size]
        at, names = halves[whole], rank[whole] * len(order) + rank[right[whole]]
        size *= 2


def diagonals(seen: Iterator[tuple[int, int, int]]) -> list[Run]:
    """The DP: ``seen`` are (word, lag, block size) by word; the runs by start, then period."""
    out: list[Run] = []
    active: dict[int, int] = {}     # lag -> words matched up to ``last``
    matched: dict[int, int] = {}    # the same up to ``now``
    last, now = -2, -2

    def end(ended: dict[int, int], word: int) -> None:
        for lag, length in ended.items():
            if length + lag >= max(MIN_WORDS, MIN_PERIODS * lag):
                out.append((word + 1 - length - lag, length + lag, lag))

    for word, lag, size in seen:
        if word != now:
            end(active, last)
            active, last, matched, now = matched, now, {}, word
            if now != last + 1:
                end(active, last)
                active = {}
        matched[lag] = active.pop(lag, size - 1) + 1
    end(active, last)
    end(matched, now)
    return sorted(out, key=lambda run: (run[0], run[2]))


def find_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, given as its words."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(lengths.sum())
    number = defaultdict(count().__next__)
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, total)
    names = words + np.repeat(np.arange(len(texts)), lengths) * max(1, len(number))
    found = [(at + size - 1, lag, np.full(len(at), size)) for size, at, lag in recurrences(names, int(lengths.max(initial=0)))]
    out: list[list[Run]] = [[] for _ in texts]
    if not found:
        return out
    word, lag, size = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(word, kind="stable")
    word, lag, size = word[order], lag[order], size[order]
    starts = np.cumsum(lengths) - lengths
    cut = np.searchsorted(word, np.append(starts, total))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        part = slice(cut[k], cut[k + 1])
        out[k] = diagonals(zip((word[part] - starts[k]).tolist(), lag[part].tolist(), size[part].tolist()))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> str:
    """The words without those that a run holds after its first period, joined by a space."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period:start + length] = False
        words = [words[k] for k in np.flatnonzero(kept).tolist()]
    return b" ".join(words).decode()


def _grouped(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    group: list[list[bytes]] = []
    size = 0
    for text in texts:
        words = words_of(text)
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _batch(texts: pa.Array) -> pa.StructArray:
    n_words, offsets, flat, collapsed = [], [0], [], []
    for group in _grouped(texts.to_pylist()):
        for words, runs in zip(group, find_runs(group)):
            n_words.append(len(words))
            flat += runs
            offsets.append(len(flat))
            collapsed.append(collapse(words, runs))
    parts = np.array(flat, np.int64).reshape(-1, 3).T
    runs = pa.StructArray.from_arrays([pa.array(x) for x in parts], ["start", "length", "period"])
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array(collapsed, pa.string())],
        ["n_words", "runs", "collapsed"])


def periodic_runs(spark, text: Column) -> Column:
    """Struct column (n_words, runs, collapsed) of a text column: ``runs`` by start,
    then period; ``collapsed`` the text without the repetitions."""
    bound_batches(spark)

    @F.arrow_udf(RUNS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _batch(texts)

    return scan(text)
