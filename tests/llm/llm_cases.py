"""Small tables with awkward rows, shared by the tests of the llm operators."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, shard string, "
          "component_id long, fp long, label string, words string")


def documents(spark):
    long_text = "word " * 30_000 + "x" * 20_000
    rows = [(1, "The cat sat on the mat and the dog sat too.", "en"), (2, None, "en"), (3, "", None), (4, "  \t\n ", "fr"),
            (5, long_text, "en"), (6, "The cat sat on the mat and the dog sat too.", "en"),
            (6, "The cat sat on the mat and the dog sat too.", "en"), (None, "Le chat est sur la table avec le chien.", "fr"),
            (7, "12345 !!! ???", None), (8, "Le chat est sur la table avec le chien.", "fr"), (9, "🙂 é ß 日本", None)]
    return spark.createDataFrame(
        [(i, t, g, "s", None if t is None else len(t), 0.5, "z", 77, 3, "l", "w") for i, t, g in rows], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
