"""The corpus pipeline, stage by stage, against brute force."""
import base64

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import tiktoken
from conftest import SF_TINY
from llm_cases import SCHEMA, documents, empty_documents
from test_pairs import plain_fingerprint, roots_of

from tessera.llm import mixing, secrets


def test_pipeline_matches_brute_force(spark):
    source = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    docs, kept = source, {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF_TINY)
        kept[name] = docs.collect()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == source.columns
    rows = sorted(map(tuple, source.collect()))
    # 1: a document without a letter goes
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(map(tuple, kept["language ID"])) == lettered
    # 2: the smallest id of each component stays
    prints = [plain_fingerprint(r[1]) for r in lettered]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    first = sorted(lettered[k] for k in set(roots_of(len(prints), links)))
    assert sorted(map(tuple, kept["SimHash near-dedup"])) == first
    # 3: masked texts, all documents
    masked = [(i, secrets.redacted(t), g, s, len(secrets.redacted(t)) if secrets.redacted(t) != t else n) for i, t, g, s, n in first]
    assert sorted(map(tuple, kept["secret scans"])) == masked
    # 4: a part of these rows, as the operator's copies say
    mixed = sorted(map(tuple, kept["mixing sources to target weights"]))
    assert set(mixed) <= set(masked) and len(mixed) == len(set(mixed)) and len(mixed) > len(masked) / 2
    labels = mixing.label_domains(spark.read.parquet(f"{SF_TINY}/labels.parquet"))
    toxic = {r["doc_id"] for r in labels.where("domain = 'toxic'").collect()}
    assert np.mean([r[0] in toxic for r in mixed]) < np.mean([r[0] in toxic for r in masked])
    # 5: the public encoder's ids
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(pipeline.RANK_PATH, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r[0]: r[1] for r in mixed}
    assert sorted(r["doc_id"] for r in kept["byte-level BPE"]) == sorted(texts)
    for r in kept["byte-level BPE"]:
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(texts[r["doc_id"]]) and r["round_trip"]


def test_stages_on_awkward_rows(spark):
    docs = documents(spark)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for _, stage in pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, SF_TINY)
        assert docs.count() <= before
        if stage is not pipeline.tokens:
            assert docs.columns == names
    assert {r["doc_id"] for r in docs.collect()} <= {1, 5, 8, 9, None}


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(6, "one two three four", "en", "s", 18)] * 3 + [(7, "five six seven eight nine", None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs, SF_TINY).collect()) == [6, 7]


def test_stages_on_an_empty_table(spark):
    docs = empty_documents(spark)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF_TINY)
        assert docs.count() == 0
