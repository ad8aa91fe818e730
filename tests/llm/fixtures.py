"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

LONG = "lorem ipsum dolor sit amet " * 4000

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, held_out string, fp int, bucket string"

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and the cat", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and the cat", "en", "a"),
    (3, "Der schnelle braune Fuchs springt über den faulen Hund und die Katze", "de", "b"),
    (3, "Der schnelle braune Fuchs springt über den faulen Hund und die Katze", "de", "b"),
    (4, None, "en", None),
    (5, "", None, "a"),
    (6, "123 456 !!! ???", "en", "b"),
    (7, LONG, "la", "a"),
    (8, "word", None, None),
    (None, "A text without an id, of some length, in English words", "en", "c"),
    (None, None, None, None),
    (9, "   \n\t ", "en", "a"),
    (10, "日本語 のテキスト 🎉 naïve \u0001 control", "ja", "c"),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 0.5, "x", 7, "y") for i, t, lang, s in rows], DOC_SCHEMA).repartition(3)
