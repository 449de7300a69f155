"""Small tables for the tests of the text operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, n long, word string"
WORDS = "the of and ering thanble shtion onre edha wher inon estin lyou atre thon nded heing ousto erver".split()


def documents(spark, texts, ids=None):
    """Rows with columns whose names operators use themselves."""
    rows = [((ids or range(len(texts)))[i], t, "en", f"src{i % 5}", len(t or ""), 1.0, "row", 5, "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "er", "x9", "."]) for _ in range(n))
