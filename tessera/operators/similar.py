"""Set fingerprints and Tanimoto neighbours (FX1, FX2, JN10-JN12, JN15, WN3,
AG9, PR21, PR22, ML21).

Fingerprints are sorted arrays of set positions computed inside each row
(no shuffle).  Neighbours are exact: ``setsearch`` compares tiles of bit rows,
prunes by set size and merges the k best.  The equi-join on positions
(``strategy="equijoin"``) gives the same rows for sets with few common positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.frames import with_scalars
from tessera.operators import postings, setsearch
from tessera.session import write_shared

N_BITS = 2048
# fixed values: the applicability-domain settings and the overlap bands
AD_K = 5
AD_SIGMA = 2.0
OVERLAP_BANDS = [(0.5, "substantially"), (0.25, "partially")]
OVERLAP_BAND_ELSE = "only marginally"


# ------------------------------------------------------------------ fingerprints
def token_fingerprint(text: Column | str, n_bits: int = N_BITS, pattern: str = "[ \n]+") -> Column:
    """FX1: distinct md5-hashed token positions of the trimmed text, sorted.

    Tokens are split on ``pattern``; empty tokens are dropped.  Built-in
    higher-order functions only (no Python UDF)."""
    t = F.col(text) if isinstance(text, str) else text
    toks = F.array_distinct(F.filter(F.split(F.trim(t), pattern), lambda x: x != ""))
    pos = F.transform(toks, lambda x: F.pmod(
        F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint"), F.lit(n_bits)).cast("int"))
    return F.array_sort(F.array_distinct(pos))


def core_fingerprint(core: Column | str, whole: Column | str, n_bits: int = N_BITS) -> Column:
    """FX2: fingerprint of a caller-supplied core text, falling back to the
    whole text when the core is empty."""
    core = F.col(core) if isinstance(core, str) else core
    whole = F.col(whole) if isinstance(whole, str) else whole
    return token_fingerprint(F.coalesce(F.nullif(F.trim(core), F.lit("")), whole), n_bits)


# ------------------------------------------------------------------ pair intersections
def _by_id(side: DataFrame, name: str) -> DataFrame:
    """A row per id: its positions (of all its rows) and the sizes of its rows."""
    size = F.coalesce(F.size("bits"), F.lit(-(1 << 30)))
    return side.where(F.col(name).isNotNull()).groupBy(name).agg(
        F.flatten(F.collect_list(F.col("bits").cast("array<int>"))).alias("bits"), F.collect_list(size.cast("int")).alias("extras"))


def topk_neighbours(queries: DataFrame, refs: DataFrame, k: int = 1, exclude_self: bool = False,
                    strategy: str = "tiles", n_bits: int = N_BITS, part: int = setsearch.PART) -> DataFrame:
    """WN3: the k most similar references per query (Tanimoto), ties by
    reference id.  Inputs: ``queries(qid, bits)``, ``refs(rid, bits)``.

    Returns (qid, rid, sim, nn_rank) with nn_rank 1..k; queries with fewer
    than k overlapping references get fewer rows (callers pad)."""
    if strategy == "tiles":
        return setsearch.search(queries, refs, k, exclude_self, n_bits, part)
    if strategy != "equijoin":
        raise ValueError(f"unknown strategy {strategy!r}")
    res = postings.pairs(_by_id(queries, "qid"), _by_id(refs, "rid"), postings.k_best(k), exclude_self)
    best = Window.partitionBy("qid").orderBy(F.col("sim").desc(), F.col("rid").asc())
    return res.withColumn("nn_rank", F.row_number().over(best)).where(F.col("nn_rank") <= k)


def nearest_neighbour(queries: DataFrame, refs: DataFrame, ref_label: DataFrame, **kw) -> DataFrame:
    """JN10: per query the most similar reference (ties -> lowest reference
    id) and its label.  A query that shares nothing with any reference gets
    the lowest reference id at similarity 0 (explicit padding)."""
    top = topk_neighbours(queries, refs, 1, **kw).select("qid", "rid", "sim")
    first_ref = refs.agg(F.min("rid").alias("_first"))
    allq = with_scalars(queries.select("qid"), first_ref)
    out = allq.join(top, "qid", "left").select(
        "qid", F.coalesce("rid", "_first").alias("rid"), F.coalesce("sim", F.lit(0.0)).alias("sim"))
    return out.join(ref_label, "rid", "left")


def knn_mean_distance(queries: DataFrame, refs: DataFrame, k: int = AD_K,
                      exclude_self: bool = False, **kw) -> DataFrame:
    """JN11: mean Tanimoto distance to the k nearest references, missing
    neighbours (no shared position) padded with distance 1; k is capped at
    the number of available references."""
    n_ref = refs.agg(F.count(F.lit(1)).alias("_n"))
    top = topk_neighbours(queries, refs, k, exclude_self=exclude_self, **kw)
    available = F.col("_n") - (1 if exclude_self else 0)
    return _mean_distance(with_scalars(queries.select("qid"), n_ref), top, F.least(F.lit(k), available)).select("qid", "knn_distance")


def _mean_distance(queries: DataFrame, top: DataFrame, kk: Column) -> DataFrame:
    agg = top.groupBy("qid").agg(F.sum(1.0 - F.col("sim")).alias("_sd"), F.count(F.lit(1)).alias("_c"))
    missing = kk - F.coalesce("_c", F.lit(0))
    return queries.join(agg, "qid", "left").withColumn(
        "knn_distance", F.when(kk > 0, (F.coalesce("_sd", F.lit(0.0)) + missing * 1.0) / kk))


def _threshold(distances: DataFrame, sigma: float) -> DataFrame:
    return distances.agg((F.avg("knn_distance") + sigma * F.stddev_pop("knn_distance")).alias("ad_threshold"),
                         F.avg("knn_distance").alias("mean_knn_distance"),
                         F.stddev_pop("knn_distance").alias("sd_knn_distance"))


def ad_threshold(train: DataFrame, k: int = AD_K, sigma: float = AD_SIGMA, **kw) -> DataFrame:
    """JN12: threshold = mean + sigma * population sd of each training row's
    kNN distance to the *other* training rows (all rows, no sampling)."""
    return _threshold(knn_mean_distance(train, train.withColumnRenamed("qid", "rid"), k, exclude_self=True, **kw), sigma)


def applicability(queries: DataFrame, train: DataFrame, k: int = AD_K, sigma: float = AD_SIGMA, **kw) -> DataFrame:
    """JN11 + JN12 + PR22 from one search: (qid, knn_distance, ad_threshold, ad) of the
    queries.  ``train(rid, bits)`` and ``queries(qid, bits)`` have no id in common."""
    both = queries.select("qid", "bits").unionByName(train.select(F.col("rid").alias("qid"), "bits"))
    top = topk_neighbours(both, train, k, exclude_self=True, **kw)
    sides = queries.select("qid", F.lit(0).alias("_own")).unionByName(train.select(F.col("rid").alias("qid"), F.lit(1).alias("_own")))
    sized = with_scalars(sides, train.agg(F.count(F.lit(1)).alias("_n")))
    found = write_shared(_mean_distance(sized, top, F.least(F.lit(k), F.col("_n") - F.col("_own"))).select("qid", "_own", "knn_distance"), "distances")
    threshold = _threshold(found.where("_own = 1"), sigma).select("ad_threshold")
    return with_scalars(found.where("_own = 0").select("qid", "knn_distance"), threshold).withColumn(
        "ad", ad_kernel("knn_distance", "ad_threshold"))


def ad_kernel(dist: Column | str, thr: Column | str) -> Column:
    """PR22: clip(exp(-(d/thr)^2), 0, 1); in-domain when >= 0.5; missing where the
    distance or the threshold is."""
    d = F.col(dist) if isinstance(dist, str) else dist
    t = F.col(thr) if isinstance(thr, str) else thr
    known = d.isNotNull() & ~F.isnan(d) & t.isNotNull() & ~F.isnan(t)
    return F.when(known, F.least(F.greatest(F.exp(-F.pow(d / F.greatest(t, F.lit(1e-9)), 2)), F.lit(0.0)), F.lit(1.0)))


def overlap_summary(nn: DataFrame, active_col: str = "nn_active", floor: float = 0.4) -> DataFrame:
    """AG9: share of nearest neighbours that are active, median NN similarity,
    share strictly above the floor, with the PR21 band of the active share."""
    from tessera.operators.rank import exact_quantile
    nn = write_shared(nn.select(active_col, "sim"), "nearest")  # the search runs once, not once per statistic
    base = nn.agg(F.count(F.lit(1)).alias("n_queries"),
                  F.avg(F.col(active_col).cast("double")).alias("frac_nn_active"),
                  F.avg((F.col("sim") > floor).cast("double")).alias("frac_nn_similarity_above"))
    med = exact_quantile(nn, "sim", [], 0.5).withColumnRenamed("quantile", "median_nn_similarity")
    out = with_scalars(base, med)
    return out.withColumn("band", band(F.col("frac_nn_active")))


def band(x: Column) -> Column:
    """PR21: >= 0.5 substantially, >= 0.25 partially, else only marginally."""
    expr = None
    for t, name in OVERLAP_BANDS:
        expr = F.when(x >= t, name) if expr is None else expr.when(x >= t, name)
    return expr.otherwise(OVERLAP_BAND_ELSE)


def minhash_join(queries: DataFrame, refs: DataFrame, threshold: float = 0.6,
                 num_tables: int = 8, seed: int = 42, n_bits: int = N_BITS) -> DataFrame:
    """JN15: approximate similarity join with MinHash LSH, then exact verify.

    Sparse binary vectors come from a fixed-vocabulary vectoriser (position i
    -> index i, JVM-side, deterministic), the MinHashes from ``MinHashLSH``; a pair is
    a candidate if it agrees in one of them.  Candidates of dense sets are most of all
    pairs (three in four at a similarity of 0.17 with eight hashes), so they are
    not joined with their vectors: ``postings`` counts shared positions block by
    block, keeps pairs within the distance and of those the candidates.  Recall is
    below 1 by design; the exact operators above are the reference."""
    from pyspark.ml.feature import MinHashLSH
    from pyspark.ml.functions import vector_to_array

    from tessera.functions.descriptors import fingerprint_vector

    def prep(df, id_col):
        tok = df.where(F.size("bits") > 0).select(
            id_col, "bits", F.transform("bits", lambda x: x.cast("string")).alias("_tok"))
        return fingerprint_vector("_tok", "features", n_bits).transform(tok)

    qv, rv = prep(queries, "qid"), prep(refs, "rid")
    model = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=num_tables,
                       seed=seed).fit(rv)

    def marked(df):
        """Every different (id, set) once, with its MinHashes."""
        hashes = F.array(*[vector_to_array(F.col("hashes")[t])[0].cast("int") for t in range(num_tables)])
        return model.transform(df).select(df.columns[0], F.col("bits").cast("array<int>").alias("bits"), hashes.alias("extras")).distinct()

    # distances strictly below the bound are kept: the bound itself counts here
    return postings.pairs(marked(qv), marked(rv), postings.within(threshold + 1e-9))


def pca_map(df: DataFrame, id_col: str, features: str, k: int = 2) -> DataFrame:
    """ML21 (re-aimed): 2-D coordinates of the feature space by PCA."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = df.select(id_col, array_to_vector(features).alias("_v"))
    t = PCA(k=k, inputCol="_v", outputCol="_pc").fit(v).transform(v)
    arr = vector_to_array(t["_pc"])
    return t.select(id_col, *[arr[i].alias(f"pc{i + 1}") for i in range(k)])
