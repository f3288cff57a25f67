"""Documents with every awkward case: nulls, empty and blank texts, repeated rows, ties, clashing column names, long texts."""

from pyspark.sql import functions as F

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
PROSE = " ".join(WORDS)


def documents(spark):
    rows = [
        (1, PROSE + " a b c d e f g", "en"), (1, PROSE + " a b c d e f g", "en"), (2, PROSE + " a b c d e f g", "en"), (3, PROSE.upper() + " a b c d e f g", None),
        (4, None, "en"), (5, "", "en"), (6, " \n\t ", None), (None, "words of a row without an id", "fr"), (7, "two words", "fr"), (8, "Two  WORDS", "fr"),
        (9, "\n".join(f"line {i} of a long text with some words in it" for i in range(3000)), "en"), (10, "é" * 5000, "fr"), (11, "x " * 3000, None), (12, "😀 ½ ² 12.5 <|endoftext|> ok", "de"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clashing = ("row", "words", "rep", "h1", "n", "n_lines", "n_removed", "class_id", "held_out", "_row", "all", "score", "n_chars")
    return docs.select("*", *(F.lit(1).alias(c) for c in clashing)).repartition(3)
