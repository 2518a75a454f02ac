"""Language-model scores by cross-entropy difference.

Two character trigram models, of the target documents and of all documents
(the background), share one vocabulary (the code points of the corpus), order,
smoothing and padding.  A document's score is the mean over its characters of
the loss under the target model less the loss under the background model
(natural logarithms): the lower, the more like the target.

Smoothing, from the lower order up: p1 = (c + 1) / (N + V), and
pn = w * count / context count + (1 - w) * p(n-1) where the context was seen,
p(n-1) where not, with w = ``WEIGHT``.

All counts cover all documents.  Every trigram that is scored has been counted
in the background, so the model is one table (trigram, two losses).  It is sent
to the tasks in parts of at most ``PART_ROWS`` rows; each part adds its share of
every document's loss, so the model may grow beyond any task's memory.

Defined cases: null or empty text: no tokens and null losses; no target
document: the target model is the uniform one over the vocabulary; repeated
rows count repeatedly; a text is read whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.frames import with_scalars
from tessera.session import bound_batches, drop_shared, share, write_shared

WEIGHT = 0.75
PART_ROWS = 1 << 21
GROUP_CHARS = 1 << 21
MASK = (1 << 21) - 1


def trigram_keys(text: str) -> Iterator[np.ndarray]:
    """Keys (21 bits per code point) of the trigrams that end at each character;
    two zeros stand before the first.  In blocks."""
    codes = np.zeros(len(text) + 2, np.uint32)
    codes[2:] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for at in range(0, len(text), GROUP_CHARS):
        c = codes[at:at + GROUP_CHARS + 2].astype(np.int64)
        yield (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(gram, n_all, n_target) over ``docs`` (text, target): counted in groups
    of texts inside the tasks, then summed by Spark."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            tagged, n = np.unique(np.concatenate(parts), return_counts=True)
            gram, target = tagged >> np.uint64(1), (tagged & np.uint64(1)).astype(bool)
            return pd.DataFrame({"gram": gram.astype(np.int64), "n_all": n, "n_target": np.where(target, n, 0)})

        for pdf in batches:
            for text, target in zip(pdf["text"], pdf["target"]):
                for keys in trigram_keys(text or ""):
                    parts.append((keys.astype(np.uint64) << np.uint64(1)) | np.uint64(bool(target)))
                    size += len(keys)
                    if size >= GROUP_CHARS:
                        yield flush()
                        parts, size = [], 0
        if parts:
            yield flush()

    return (docs.select("text", "target").mapInPandas(count, "gram long, n_all long, n_target long")
            .groupBy("gram").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target")))


def losses(counts: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """(gram, loss_target, loss_all) of every counted trigram."""
    def sums(key: str, name: str) -> DataFrame:
        return counts.groupBy(F.expr(key).alias(name)).agg(
            F.sum("n_all").alias(f"{name}_all"), F.sum("n_target").alias(f"{name}_target"))

    keys = {"abx": "shiftright(gram, 21)", "bc": f"gram & {(1 << 42) - 1}", "bx": f"shiftright(gram, 21) & {MASK}",
            "c": f"gram & {MASK}"}
    out = counts.select("gram", "n_all", "n_target", *[F.expr(k).alias(n) for n, k in keys.items()])
    for name, key in keys.items():
        out = out.join(sums(key, name), name)
    whole = counts.agg(F.sum("n_all").alias("total_all"), F.sum("n_target").alias("total_target"),
                       F.countDistinct(F.expr(keys["c"])).alias("V"))
    out = with_scalars(out, whole)

    def loss(of: str):
        p = (F.col(f"c_{of}") + 1) / (F.col(f"total_{of}") + F.col("V"))
        for top, context in ((f"bc_{of}", f"bx_{of}"), (f"n_{of}", f"abx_{of}")):
            seen = F.col(context) > 0
            p = F.when(seen, weight * F.col(top) / F.when(seen, F.col(context)) + (1 - weight) * p).otherwise(p)
        return -F.log(p)

    return out.select("gram", loss("target").alias("loss_target"), loss("all").alias("loss_all"))


SUMS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("loss_target", T.DoubleType()),
                     T.StructField("loss_all", T.DoubleType())])


def _add_part(docs: DataFrame, part: DataFrame) -> DataFrame:
    """``docs`` (at, doc_id, text) to (at, doc_id, n_tokens, loss_target, loss_all): sums over the
    trigrams of one part of the model."""
    rows = part.toPandas().sort_values("gram")
    model = share(docs.sparkSession, (rows["gram"].to_numpy(np.int64), rows["loss_target"].to_numpy(float),
                                      rows["loss_all"].to_numpy(float)))

    @F.pandas_udf(SUMS)
    def sums(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams, target, background = model()
        for texts in batches:
            out = np.zeros((len(texts), 3))
            for k, text in enumerate(texts):
                for keys in trigram_keys(text or ""):
                    at = np.searchsorted(grams, keys)
                    at[at == len(grams)] = 0
                    at = at[grams[at] == keys] if len(grams) else at[:0]  # every trigram is in exactly one part
                    out[k] += len(at), target[at].sum(), background[at].sum()
            yield pd.DataFrame({"n_tokens": out[:, 0].astype(np.int64), "loss_target": out[:, 1], "loss_all": out[:, 2]})

    return docs.select("at", "doc_id", sums("text").alias("s")).select("at", "doc_id", "s.*")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, text: str = "text", doc_id: str = "doc_id",
                             weight: float = WEIGHT, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per document: doc_id, n_tokens, loss_target, loss_all and score
    (their difference).  ``targets``: the doc_id of the target documents."""
    bound_batches(docs.sparkSession)
    # the target ids grow with the corpus: never broadcast, whatever their size now
    wanted = targets.select(F.col("doc_id").alias("_target")).where("_target is not null").distinct().hint("merge")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = write_shared(rows.join(wanted, rows["doc_id"] == wanted["_target"], "left")
                        .select("doc_id", "text", F.col("_target").isNotNull().alias("target"),
                                F.monotonically_increasing_id().alias("at")), "lm-docs")
    counts = write_shared(count_trigrams(rows), "lm-counts")
    model = write_shared(losses(counts, weight), "lm-model")
    n_parts = max(1, -(-model.count() // part_rows))
    part_of = F.pmod(F.xxhash64("gram"), F.lit(n_parts))
    done = [_add_part(rows, model.where(part_of == k)) for k in range(n_parts)]
    sums = reduce(DataFrame.union, done)
    if n_parts > 1:
        sums = sums.groupBy("at", "doc_id").agg(*[F.sum(c).alias(c) for c in SUMS.names])
    drop_shared(counts)
    mean_target, mean_all = (F.col(c) / F.when(F.col("n_tokens") > 0, F.col("n_tokens")) for c in ("loss_target", "loss_all"))
    return sums.select("doc_id", "n_tokens", mean_target.alias("loss_target"), mean_all.alias("loss_all"),
                       (mean_target - mean_all).alias("score"))


def oracle(weight: float = WEIGHT) -> str:
    """The scores in DuckDB SQL, target: documents labelled quality 1 and not toxic."""
    w, v = weight, 1 - weight
    return f"""
WITH t AS (SELECT DISTINCT doc_id FROM (
             SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic IS NULL THEN NULL WHEN quality = 1 THEN 'high' END AS d
             FROM labels) WHERE d = 'high' AND doc_id IS NOT NULL),
docs AS (SELECT row_number() OVER () AS pos, doc_id, text, doc_id IN (SELECT doc_id FROM t) AS target FROM documents),
lists AS (SELECT pos, target, string_split(text, '') AS l FROM docs WHERE length(text) > 0),
chars AS (SELECT pos, target, unnest(l) AS c, unnest(list_concat([''], l[1:len(l) - 1])) AS b,
                 unnest(list_concat(['', ''], l[1:greatest(len(l) - 2, 0)])) AS a FROM lists),
grams AS (SELECT pos, target, a, b, c, count(*) AS k FROM chars WHERE c IS NOT NULL GROUP BY ALL),
n AS (SELECT a, b, c, sum(k) AS n_all, coalesce(sum(k) FILTER (WHERE target), 0) AS n_t FROM grams GROUP BY ALL),
abx AS (SELECT a, b, sum(n_all) AS x_all, sum(n_t) AS x_t FROM n GROUP BY ALL),
bc AS (SELECT b, c, sum(n_all) AS bc_all, sum(n_t) AS bc_t FROM n GROUP BY ALL),
bx AS (SELECT b, sum(n_all) AS bx_all, sum(n_t) AS bx_t FROM n GROUP BY ALL),
c1 AS (SELECT c, sum(n_all) AS c_all, sum(n_t) AS c_t FROM n GROUP BY ALL),
s AS (SELECT sum(n_all) AS s_all, sum(n_t) AS s_t, count(DISTINCT c) AS v FROM n),
p1 AS (SELECT *, (c_all + 1.0) / (s_all + v) AS q_all, (c_t + 1.0) / (s_t + v) AS q_t
       FROM n JOIN abx USING (a, b) JOIN bc USING (b, c) JOIN bx USING (b) JOIN c1 USING (c), s),
p2 AS (SELECT *, CASE WHEN bx_all > 0 THEN {w} * bc_all / bx_all + {v} * q_all ELSE q_all END AS r_all,
              CASE WHEN bx_t > 0 THEN {w} * bc_t / bx_t + {v} * q_t ELSE q_t END AS r_t FROM p1),
p3 AS (SELECT a, b, c, -ln(CASE WHEN x_all > 0 THEN {w} * n_all / x_all + {v} * r_all ELSE r_all END) AS l_all,
              -ln(CASE WHEN x_t > 0 THEN {w} * n_t / x_t + {v} * r_t ELSE r_t END) AS l_t FROM p2),
m AS (SELECT pos, sum(k)::BIGINT AS n_tokens, sum(k * l_t) / sum(k) AS l_t, sum(k * l_all) / sum(k) AS l_all
      FROM grams JOIN p3 USING (a, b, c) GROUP BY pos)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, round(l_t, 6) AS loss_target, round(l_all, 6) AS loss_all,
       round(l_t - l_all, 6) + 0.0 AS score
FROM docs LEFT JOIN m USING (pos)"""
