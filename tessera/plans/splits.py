"""Split queries (SP1-SP5, ST4) on F-EMB and F-DOCS."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import split as sp
from tessera.plans import fixtures as fx
from tessera.plans.registry import query
from tessera.plans.sql_fixtures import DOCS, with_
from tessera.sources.tables import table

_H = "('0x' || substr(md5('{seed}:' || {col}::VARCHAR), 1, 8))::BIGINT"


def _h(col: str, seed: int = 42) -> str:
    return _H.format(seed=seed, col=col)


def _emb(spark, sf_dir):
    return fx.embeddings(spark, sf_dir).select("id", "y")


@query("sp01_hash_kfold", f"""
SELECT vec_id AS id, {_h('vec_id')} % 5 AS fold FROM embeddings""")
def sp01_hash_kfold(spark, sf_dir):
    return sp.hash_kfold(_emb(spark, sf_dir), "id", 5).select("id", "fold")


@query("sp02_stratified_kfold", f"""
WITH e AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, {_h('vec_id')} AS h FROM embeddings)
SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY h, id) - 1) % 5 AS fold FROM e""")
def sp02_stratified_kfold(spark, sf_dir):
    return sp.stratified_kfold(_emb(spark, sf_dir), "id", "y", 5).select("id", "y", "fold")


def _sss_sql(n_rep: int, frac: float) -> str:
    parts = []
    for r in range(n_rep):
        parts.append(f"""
  SELECT {r} AS repeat, id, y,
         CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {_h('id', 42 + r)}, id) - 1
                   < round_even({frac} * count(*) OVER (PARTITION BY y), 0) THEN 'train' ELSE 'test' END AS set
  FROM e""")
    return "\n  UNION ALL".join(parts)


@query("sp03_stratified_shuffle", """
WITH e AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings)
SELECT * FROM (""" + _sss_sql(4, 0.7) + ")")
def sp03_stratified_shuffle(spark, sf_dir):
    """SP3: four stratified 70/30 shuffles over all embeddings."""
    return sp.stratified_shuffle(_emb(spark, sf_dir), "id", "y", 4, 0.7).select(
        "repeat", "id", "y", "set")


@query("sp04_group_kfold", with_(DOCS) + f"""
SELECT doc_id, grp, {_h('grp')} % 5 AS fold FROM docs""")
def sp04_group_kfold(spark, sf_dir):
    d = fx.docs(spark, sf_dir).select("doc_id", "grp")
    return sp.group_kfold(d, "grp", 5).select("doc_id", "grp", "fold")


@query("sp04_balanced_group_kfold", with_(DOCS) + f"""
, g AS (SELECT grp, count(*) AS n, sum(coalesce(quality, 0)) * 2 >= count(*) AS s FROM docs GROUP BY grp),
p AS (SELECT grp, (row_number() OVER (PARTITION BY s ORDER BY n DESC, {_h('grp')}, grp) - 1) % 10 AS place FROM g)
SELECT doc_id, docs.grp, CASE WHEN place < 5 THEN place ELSE 9 - place END AS fold
FROM docs JOIN p ON docs.grp IS NOT DISTINCT FROM p.grp""")
def sp04_balanced_group_kfold(spark, sf_dir):
    """SP4: folds balanced in size and class over whole groups."""
    d = fx.docs(spark, sf_dir).select("doc_id", "grp", "quality")
    return sp.balanced_group_kfold(d, "grp", 5, label="quality").select("doc_id", "grp", "fold")


@query("sp05_split_registry", with_(DOCS) + """
, e AS (SELECT doc_id AS id, coalesce(quality, 0) AS y, grp FROM docs)
SELECT split_id, set, y, count(*) AS n FROM (
  SELECT printf('random_%02d', repeat) AS split_id, set, y FROM (""" + _sss_sql(10, 0.8) + """)
  UNION ALL
  SELECT 'grouped_00', CASE WHEN """ + _h('grp') + """ % 5 = 0 THEN 'test' ELSE 'train' END, y FROM e)
GROUP BY ALL""")
def sp05_split_registry(spark, sf_dir):
    """SP5: registry sizes per (split, set, class) over all documents."""
    d = fx.docs(spark, sf_dir).select("doc_id", F.coalesce("quality", F.lit(0)).alias("y"), "grp")
    reg = sp.split_registry(d, "doc_id", "y", "grp", n_random=10)
    return reg.groupBy("split_id", "set", "y").agg(F.count(F.lit(1)).alias("n"))


@query("st04_size_grid", """
WITH ps AS (SELECT DISTINCT len(embedding) AS p FROM embeddings
            UNION SELECT count(DISTINCT p_size) FROM part),
g AS (SELECT p, i FROM ps, range(90) t(i))
SELECT DISTINCT p::INTEGER AS p,
       least(greatest(round_even(i * ((p - 2) / 89.0) + 2.0, 0)::INTEGER, 2), p)::INTEGER AS m FROM g""")
def st04_size_grid(spark, sf_dir):
    """ST4: candidate feature counts for p taken from the data (embedding width,
    number of distinct part sizes)."""
    p1 = table(spark, sf_dir, "embeddings").select(F.size("embedding").alias("p"))
    p2 = table(spark, sf_dir, "part").select("p_size").distinct().agg(F.count(F.lit(1)).cast("int").alias("p"))
    ps = p1.unionByName(p2).distinct()
    return sp.size_grid_frame(ps)
