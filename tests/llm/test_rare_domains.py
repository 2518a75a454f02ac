"""Source mixing: a rare domain of a large labels table is learned."""
import math

from tessera.llm import mixing


def test_rare_domain_is_learned(spark):
    names = ["high", "low", "toxic"]
    domains = ["toxic" if i in (17, 1234) else names[i % 4 == 0] for i in range(4000)]
    docs = spark.createDataFrame([(i, f"{d} word{i % 7}") for i, d in enumerate(domains)], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(domains)), "doc_id long, domain string")
    model, seen, stand_for = mixing.fit_domains(docs, labels, "text", "doc_id", names, labelled_docs=200, features=1 << 10)
    assert seen == names
    p = mixing.with_posteriors(docs, model, seen, stand_for, names, "text").toPandas()["_mix"].map(lambda m: m["posterior"])
    assert abs(sum(x[0] for x in p) / 4000 - 0.75) < 0.1 and sum(x[2] for x in p) / 4000 < 0.05
    assert max(range(4000), key=lambda i: p[i][2]) in (17, 1234)


def test_even_bound():
    assert mixing.even_bound([10, 20, 30], 60) == math.inf and mixing.even_bound([], 60) == math.inf
    assert mixing.even_bound([10, 200, 300], 60) == 25 and mixing.even_bound([200, 300], 60) == 30
