"""Documents with the awkward rows that every operator must bear."""

from lexitide.llm.common import text_of  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blob string, fp string, component_id long, len long, again string, node long, span string"


def docs_of(spark, rows):
    """Columns that clash with the operators' own names hold rubbish."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", -5, 3, "z", 9, "q") for i, t in rows], SCHEMA)


LONG = " ".join(f"word{i % 997} thing{i % 13}" for i in range(30_000))
AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "One"), (5, "one two three"), (6, LONG), (7, LONG), (7, LONG), (8, LONG + " end"), (None, "null id"), (None, "null id"), (9, "null id"), (10, "é" * 50 + " 😀 日本"), (11, "a\x00b c d e"), (12, "null id")]
