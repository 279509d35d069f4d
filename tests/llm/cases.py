"""Rows that every operator has to take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k2 string, bucket int, id string, fp string, n int, shard string"
LINE = "the quick brown fox jumps over the lazy dog and runs along the river bank until night falls on the town at last "
LONG = "".join(f"word{i % 977} Élan{i % 31}'s  " for i in range(9000))


def rows():
    texts = [None, "", " \t\n", LINE, LINE, LINE + "once more", "x" + LINE * 4, LONG, LONG + "end", "a" * 3000, "token = abcdef123", "ü" * 400, "1 2 3", "password: 'hunter22' AKIA" + "Z9" * 10 + " " + "0123456789abcdef" * 2, "　é" + LINE + "ß", "q" * 99, "q" * 100]
    out = [(i, t, ["en", "de", None][i % 3], "s", None, "x", 1, "y", "z", 2, "w") for i, t in enumerate(texts)]
    return [*out, out[3], out[7], (None, LINE, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (5, "another text under the same id", "en", "s", 1, "x", 1, "y", "z", 2, "w"), (-7, LINE + "once more", "en", "s", 1, "x", 1, "y", "z", 2, "w")]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def sf(name):
    return f"/root/testdata/{name}"
