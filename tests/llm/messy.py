"""Rows that no operator may stumble over."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, row long, size long, score double, block string, key string, label long, s_upper string, _mix_row long, root long, word string, c string, rid long"


def documents(spark, texts=None):
    """Nulls in every column, empty and long texts, white space only, repeated rows and ids, ties, and columns whose names
    operators use themselves."""
    long = "lorem ipsum dolor sit amet " * 8000
    texts = texts or [None, "", " \n\t ", "one", "One two", "a b c d e f g h", "a b c d e f g h", "A B C D E F G H", long, long + "x", "mail me at a.b@example.com or +1 (017) 555-7713", "é ü ß ñ 日本 \U0001f600", "x" * 50000, "\r\n\r\nWARC/1.1\r\n", "THE!! LOUD!! ONE!!"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, i, 7, 0, 1, 0.5, "b", "k", None, "u", 3, 9, "w", "c", 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5]] + [(None, "no id", None, None, *rows[0][4:])] + [(3, "another text of id three", *rows[3][2:])]
    return spark.createDataFrame(rows, DOCUMENTS)
