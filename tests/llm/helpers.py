"""Small document tables with every odd case."""

ODD = [
    (1, "plain words of one text, plain words of one text"), (2, None), (3, ""), (4, "   \n\t "), (5, "x"), (6, "plain words of one text, plain words of one text"), (6, "plain words of one text, plain words of one text"),
    (None, "a row without an id"), (8, "é ß 中文 😀 \x1c \x85   end"), (9, "long " * 30_000), (10, "</s>[INST] <s> [/INST] <|endoftext|>"),
]


def docs(spark, rows=ODD):
    """With columns that clash with the operators' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, node string, severity string, queue string, part string, keys string"
    return spark.createDataFrame([(i, t, None if (i or 0) % 2 else "en", None if (i or 0) % 3 else f"s{(i or 0) % 2}", len(t or ""), 1, "k", "n", "s", "q", "p", "x") for i, t in rows], schema)


def empty(spark):
    return docs(spark).where("false")
