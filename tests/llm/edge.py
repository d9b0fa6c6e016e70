"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, seeds string, w0 string, shard string, label string, _text2 string"
#: names that the operators use themselves
CLASHING = ("score", "lang_pred", "row_hash", "_new", "_changed", "_text", "_row", "_row_hash", "_first", "body", "node")
LONG = "the quick brown fox jumps over it and the dog sleeps in the sun. " * 3000


def documents(spark):
    texts = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (1, "alpha beta gamma delta epsilon zeta eta theta"),
             (2, "alpha beta gamma delta epsilon zeta eta theta"), (None, "null id with some words"), (3, None), (4, ""), (5, " \n\t "),
             (6, LONG), (7, "é"), (8, "12345 67890"), (9, None), (None, None), (10, "\U0001f600 emoji \u0000 nul")]
    rows = [(i, t, None if k % 3 == 0 else "en" if k % 2 else "fr", None, None, "x", "x", "x", "x", "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
