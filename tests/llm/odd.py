"""Rows that no operator may fail on."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, n_words string, score string, held_out string, fp string, key string, ids string, `odd name` string, rid string, row string, length string"


def odd_docs(spark, more=()):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
    texts = [
        (1, "a b c " * 30), (1, "a b c " * 30), (2, None), (None, "no id here at all"), (None, None), (3, ""), (4, " \t\n\x0b "), (5, long), (6, "one"), (7, "One"), (8, "é ü ñ \U0001f600 日本語 text"), (9, "a\n\na\nb\na"),
        (10, "x" * 5000), (11, "password=abcdef12 AKIA" + "A" * 20), *more,
    ]
    return spark.createDataFrame([(i, t, "en" if i else None, f"s{(i or 0) % 3}" if i != 9 else None, len(t) if t else None, *["x"] * 11) for i, t in texts], SCHEMA)


def none_of(df):
    return df.where("false")
