"""The fixtures of ``tessera.plans.fixtures`` written as DuckDB CTEs.

These are independent SQL definitions used only by the oracle; nothing in
the Spark path reads them.
"""

PANEL_LONG = """
panel_wide AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'R' THEN 'inactive'
              WHEN 'N' THEN 'screen' END AS cohort,
         l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount,
         nullif(l_tax, 0.03::DOUBLE) AS tax,
         l_extendedprice * (1 - l_discount) AS net_price, p_retailprice AS retail_price
  FROM lineitem JOIN part ON l_partkey = p_partkey),
panel_long AS (
  SELECT * FROM (UNPIVOT panel_wide ON quantity, extendedprice, discount, tax, net_price, retail_price
                 INTO NAME target VALUE score)
  WHERE score IS NOT NULL),
targets(ord, target, role) AS (VALUES
  (1, 'quantity', 'volume'), (2, 'extendedprice', 'price'), (3, 'discount', 'rate'),
  (4, 'tax', 'rate'), (5, 'net_price', 'price'), (6, 'retail_price', 'list'))
"""

SCORES = """
scores AS (
  SELECT event_id AS id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS y,
         event_id % 5 AS fold,
         (((event_id * 2654435761) % 4294967296 % 700
           + 300 * CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) / 1000.0)::DOUBLE AS p_a,
         (((event_id * 40503 + 7) % 65536 % 800
           + 200 * CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) / 1000.0)::DOUBLE AS p_b
  FROM events),
scores_long AS (
  SELECT fold, id, y, 'a' AS model, p_a AS p FROM scores
  UNION ALL SELECT fold, id, y, 'b', p_b FROM scores
  UNION ALL SELECT fold, id, y, 'veto', p_a * p_b FROM scores
  UNION ALL SELECT fold, id, y, 'mean', 0.5 * (p_a + p_b) FROM scores)
"""

DOCS = """
docs AS (
  SELECT d.doc_id, sha256(lower(trim(d.text))) AS key, d.source AS grp, d.lang, d.n_chars,
         l.quality, l.toxic,
         CASE WHEN l.quality = 1 THEN 'active' WHEN l.quality = 0 THEN 'inactive'
              ELSE 'screen' END AS cohort,
         d.text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

TOKENS = """
doc_tokens AS (
  SELECT doc_id, unnest(string_split_regex(trim(text), '[ \\n]+')) AS tok FROM documents),
doc_bits AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 2048 AS bit
  FROM doc_tokens WHERE tok <> ''),
doc_size AS (SELECT doc_id, count(*) AS nbits FROM doc_bits GROUP BY doc_id)
"""

STORED = """
stored AS (
  SELECT doc_id AS ligand,
         CASE WHEN (doc_id * 2654435761) % 4294967296 % 10 <> 4
              THEN (((doc_id * 2246822519) % 4294967296 % 1000) / 1000.0)::DOUBLE END AS proba_dmpnn,
         ((((doc_id * 40503 + 7) % 65536) % 1000) / 1000.0)::DOUBLE AS proba_hgb,
         (((((doc_id * 2246822519) % 4294967296 % 1000) / 1000.0)
           + ((((doc_id * 40503 + 7) % 65536) % 1000) / 1000.0)) / 2.0)::DOUBLE AS prob
  FROM documents WHERE (doc_id * 2654435761) % 4294967296 % 10 >= 3)
"""

DOSE = """
dose AS (
  SELECT p_partkey AS id, p_brand AS population, p_retailprice AS mw,
         (p_size / 10.0)::DOUBLE AS p_value_a, ((p_partkey % 97) / 12.0)::DOUBLE AS p_value_b
  FROM part)
"""

EMB_LONG = """
emb_long AS (
  SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y,
         ('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 8))::BIGINT % 5 <> 0 AS is_train,
         unnest(range(len(embedding)))::INTEGER AS j, unnest(embedding)::DOUBLE AS value
  FROM embeddings)
"""


def with_(*ctes: str) -> str:
    """Join CTE bodies into one WITH clause."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
