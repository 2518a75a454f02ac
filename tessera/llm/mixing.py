"""Mixing sources to target weights by soft domain membership.

1. A multinomial logistic regression, fitted on labelled documents, predicts
   each document's posterior over the domains.
2. Distributed projected least squares finds a nonnegative rate per document so that the expected token totals of the domains match the targets:
   minimise  1/2 sum_d (share_d - target_d)^2 + anchor/2 sum_i c_i (r_i - 1)^2
   over 0 <= r_i (<= max_rate), with c_i the document's share of all tokens and
   share_d = sum_i c_i p_id r_i.  At the optimum the projected gradient is 0:
   every rate is that of its posterior, clip(1 - p_i . residual / anchor), with
   residual = share - target.  Newton steps on the residual end when this holds
   to ``TOLERANCE``, and a fit that does not reach it raises.  The iterations
   run over the token totals of equal posteriors.  Posteriors are rounded to ``POSTERIOR_STEP``: the number of
   their different values, and so the cost of an iteration, has a bound that
   the corpus does not move.
3. ``copies`` turns a rate into whole copies: its integer part, plus one with
   the probability of its fraction (by a hash of the id and the text).

Defined cases: null or empty text: no tokens, the posterior of an empty
document; documents without tokens get the rate of their posterior but do not
move the totals; no tokens at all: every rate 1; fewer than two labelled
domains: every document belongs to the one labelled (or, with no label, to the
first domain by name); a domain without labelled documents has posterior 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import drop_shared, write_shared

#: Bound on the labelled documents that the classifier is fitted on (expected number), and the least share of it of a domain.
LABELLED_DOCS = 6000
LEAST_DOCS = 50
FEATURES = 1 << 16
POSTERIOR_STEP = 1e-3
#: Difference between the residual that the rates are made from and the one that they have, at which the fit ends.
TOLERANCE = 1e-10
#: Fractions of a Newton step that are compared in one pass.
STEPS = 0.5 ** np.arange(16)
BLANKS = "[ \\t-\\r]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS), lambda w: w != "")


def even_bound(sizes: list[int], total: int) -> float:
    """The bound per group at which groups of these sizes have ``total`` members
    together (infinite when they have no more)."""
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > total:
            return total / (len(sizes) - k)
        total -= n
    return math.inf


def fit_domains(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, domains: list[str],
                labelled_docs: int = LABELLED_DOCS, features: int = FEATURES, max_iter: int = 30):
    """Classifier of word lists: ``labels`` has doc_id and domain.

    Documents are taken from ``labels`` by a hash of their id up to an expected
    ``labelled_docs``, as evenly over the domains as their sizes allow (all of a
    small domain, at least an expected ``LEAST_DOCS`` of a large one); an id with
    several labels uses the smallest domain name.  Returns (model, domains in the
    order of its classes, how many documents one of each stands for): posteriors
    times these numbers are those at the domains' own frequencies.  model is None
    when fewer than two domains have labelled documents.
    """
    one = labels.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    one = one.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    counts = {r["domain"]: r["count"] for r in one.groupBy("domain").count().collect()}
    most = max(LEAST_DOCS, even_bound(list(counts.values()), labelled_docs))
    shares = {d: min(1.0, most / n) for d, n in counts.items()}
    share = F.coalesce(*[F.when(F.col("domain") == d, F.lit(x)) for d, x in shares.items()], F.lit(1.0))
    sample = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # the sample has a bound, so it is sent to the documents and no text is shuffled
    train = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
             .join(F.broadcast(sample), "doc_id")
             .select(words_of(F.col("text")).alias("words"), F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).alias("domain")))
    train = write_shared(train.repartition(8), "labelled")
    seen = sorted(r["domain"] - 1 for r in train.select("domain").distinct().collect())
    model = None
    if len(seen) > 1:
        position = F.create_map(*[F.lit(float(x)) if i % 2 else F.lit(x) for k, d in enumerate(seen) for i, x in enumerate((d + 1, k))])
        stages = [HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True),
                  LogisticRegression(labelCol="label", regParam=0.01, maxIter=max_iter, family="multinomial", standardization=False,
                                     probabilityCol="posterior")]
        model = Pipeline(stages=stages).fit(train.withColumn("label", position[F.col("domain").cast("int")]))
    drop_shared(train)
    return model, [domains[d] for d in seen], [1.0 / shares[domains[d]] for d in seen]


def with_posteriors(docs: DataFrame, model, seen: list[str], stand_for: list[float], domains: list[str], text: str) -> DataFrame:
    """``docs`` plus the struct column ``_mix`` (tokens, posterior by domain)."""
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), words_of(docs[f"`{text}`"]).alias("words"))
    if model is None:
        only = seen[0] if seen else domains[0]
        scored = held.withColumn("p", F.array(*[F.lit(float(d == only)) for d in domains]))
    else:
        scored = model.transform(held).withColumn("q", vector_to_array("posterior"))
        if set(stand_for) != {1.0}:
            scored = scored.withColumn("q", F.zip_with("q", F.array(*map(F.lit, stand_for)), lambda x, w: x * w))
            scored = scored.withColumn("total", F.aggregate("q", F.lit(0.0), lambda a, x: a + x)).withColumn("q", F.transform("q", lambda x: x / F.col("total")))
        scored = scored.withColumn("q", F.transform("q", lambda x: F.round(x / POSTERIOR_STEP) * POSTERIOR_STEP))
        scored = scored.withColumn("p", F.array(*[F.col("q")[seen.index(d)] if d in seen else F.lit(0.0) for d in domains]))
    return scored.select("_row.*", F.struct(F.size("words").cast("long").alias("tokens"), F.col("p").alias("posterior")).alias("_mix"))


def _replay(p: np.ndarray, residuals: list[np.ndarray], anchor: float, max_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates of the last residual, and the rates before they are clipped (all 1
    with no residual)."""
    free = 1.0 - p @ residuals[-1] / anchor if residuals else np.ones(len(p))
    return np.clip(free, 0.0, max_rate), free


def fit_rates(totals: DataFrame, targets: np.ndarray, anchor: float, max_rate: float, iterations: int) -> list[np.ndarray]:
    """Residuals (share less target) of each iteration: the last defines every rate.

    ``totals``: c (share of all tokens) and p (posterior).  The residual y of the
    optimum is the minimum of the dual 1/2 |y|^2 + y.target - sum_i c_i m(p_i.y),
    with m(u) the least of u r + anchor/2 (r - 1)^2 over the rates; its gradient
    is y + target - share.  Each iteration is one Spark aggregation of value,
    share and curvature at every fraction of the step.
    """
    width = len(targets)
    size = 1 + width + width * width

    def sums_at(tries: list[np.ndarray]) -> np.ndarray:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(tries), size))
            for pdf in batches:
                if len(pdf):
                    p, c = np.stack(pdf["p"].to_numpy()), pdf["c"].to_numpy(float)
                    for k, y in enumerate(tries):
                        rate, free = _replay(p, [y], anchor, max_rate)
                        inner = c * ((free > 0.0) & (free < max_rate)) / anchor
                        out[k, 0] += c @ ((p @ y) * rate + anchor / 2.0 * (rate - 1.0) ** 2)
                        out[k, 1:1 + width] += (c * rate) @ p
                        out[k, 1 + width:] += ((p * inner[:, None]).T @ p).ravel()
            yield pd.DataFrame({"at": np.arange(out.size), "sum": out.ravel()})

        found = totals.mapInPandas(partial, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect()
        out = np.zeros(len(tries) * size)
        for r in found:
            out[r["at"]] = r["sum"]
        return out.reshape(len(tries), size)

    residuals: list[np.ndarray] = []
    tries, least = [np.zeros(width)], math.inf
    for _ in range(iterations):
        sums = sums_at(tries)
        values = [0.5 * y @ y + y @ targets - x[0] for y, x in zip(tries, sums)]
        slopes = [y + targets - x[1:1 + width] for y, x in zip(tries, sums)]
        # near the optimum the values are equal but for rounding, and the slopes decide
        allowed = [k for k, v in enumerate(values) if v <= least + 1e-13 * (1.0 + abs(v))] or [int(np.argmin(values))]
        clear = min(values) < least - 1e-9
        best = int(np.argmin(values)) if clear else min(allowed, key=lambda k: np.abs(slopes[k]).max())
        y, least = tries[best], min(least, values[best])
        residuals.append(y)
        if np.abs(slopes[best]).max() <= TOLERANCE:
            return residuals
        step = np.linalg.solve(np.eye(width) + sums[best, 1 + width:].reshape(width, width), slopes[best])
        tries = [y - f * step for f in STEPS]
    raise RuntimeError(f"rates not fitted after {iterations} iterations: projected gradient {np.abs(slopes[best]).max():.3g}")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], text: str = "text", doc_id: str = "doc_id",
        anchor: float = 1e-3, max_rate: float = float("inf"), iterations: int = 200,
        labelled_docs: int = LABELLED_DOCS) -> DataFrame:
    """``docs`` plus the struct column ``_mix``: tokens, posterior (array in the
    order of the sorted domain names of ``targets``), rate and copies.

    ``targets``: share of all tokens per domain (normalised to sum to 1).
    """
    domains = sorted(targets)
    wanted = np.array([targets[d] for d in domains], float)
    wanted = wanted / wanted.sum()
    model, seen, stand_for = fit_domains(docs, labels, text, doc_id, domains, labelled_docs)
    scored = write_shared(with_posteriors(docs, model, seen, stand_for, domains, text), "posteriors")
    sums = scored.groupBy(F.col("_mix.posterior").alias("p")).agg(F.sum("_mix.tokens").alias("tokens"))
    sums = write_shared(sums, "posterior-totals")
    everything = sums.agg(F.sum("tokens")).first()[0] or 0
    residuals: list[np.ndarray] = []
    if everything:
        residuals = fit_rates(sums.select("p", (F.col("tokens") / everything).alias("c")), wanted, anchor, max_rate, iterations)
    drop_shared(sums)

    @F.pandas_udf(T.DoubleType())
    def rate_of(posteriors: pd.Series) -> pd.Series:
        if not len(posteriors):
            return pd.Series([], dtype=float)
        return pd.Series(_replay(np.stack(posteriors.to_numpy()), residuals, anchor, max_rate)[0])

    rated = scored.withColumn("_rate", rate_of(F.col("_mix.posterior")))
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1_000_000)) / 1_000_000
    copies = F.floor("_rate") + F.when(draw < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return rated.select(*[f"`{c}`" for c in docs.columns], F.struct(
        "_mix.tokens", "_mix.posterior", F.col("_rate").alias("rate"), copies.cast("long").alias("copies")).alias("_mix"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a labels table: ``toxic``, else ``high`` or ``low`` by
    quality; rows with a null label that is needed are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic").isNull(), None) \
              .when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")
