"""Rows that every text operator must stand."""

LONG = "word%d " * 20000 % tuple(range(20000))
TEXTS = [None, "", " \n\t ", "one", "one two", "Ünïcode 漢字 ՘ \U0001f600", LONG, "same text here, twice", "same text here, twice", "<|endoftext|> inside <|endoftext|>"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, key int, spans int, label int"


def documents(spark, texts=TEXTS, ids=None, sources=None):
    """Documents with columns whose names the operators use for themselves; one row without id, one id twice."""
    ids = ids or [*range(len(texts) - 2), None, 0][: len(texts)]
    rows = [(i, t, None, sources[n] if sources else f"s{n % 3}", None, "x", "y", 1, 2, 3) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
