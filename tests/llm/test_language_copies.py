"""Language ID: a language that consists mostly of copies."""
from tessera.llm import langid


def test_a_language_of_copies_is_learned(spark):
    texts = [("fr", f"Le chat {w} est sur la table avec le chien.") for w in ("noir", "blanc", "gris")]
    plain = spark.createDataFrame(texts, "lang string, text string")
    copies = spark.createDataFrame([texts[0]] * 3000 + texts[1:] + [("en", f"The cat number {i} sat on the mat") for i in range(500)], "lang string, text string")
    profiles = langid.learn_profiles(copies.repartition(4), train_docs=10)
    assert set(profiles) == {"en", "fr"}
    assert profiles["fr"] == langid.learn_profiles(plain)["fr"]
