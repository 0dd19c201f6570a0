"""Documents with everything that may go wrong, and frames of them."""

EDGES = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one two"), (6, "one two"), (6, "one two"), (None, "no id here at all"), (8, "Émile a\u0001b 😀 ñandú " * 3), (9, "word " * 30000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df):
    """With extra columns named like those that operators add or use inside."""
    from pyspark.sql import functions as F

    for name in ("ledger", "spans", "fp", "h", "hits", "_text", "_words", "token_ids", "rid", "count", "Text2", "ws", "copy", "_doc", "score", "end"):
        df = df.withColumn(name, F.lit("kept"))
    return df
