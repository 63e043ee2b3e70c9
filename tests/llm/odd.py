"""Documents with everything that may go wrong in them."""

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(30_000))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, keep_id string, ident string, "
          "shard string, node string, __sha string")


def row(doc_id, text, source="s0"):
    return (doc_id, text, "en", source, len(text or ""), "x", "y", "z", "n", "s")


ROWS = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "Same Text here"), row(5, "same text HERE"), row(5, "same text HERE"),
        row(6, LONG), row(7, LONG.upper()), row(8, "one"), row(None, "no id at all"), row(None, "no id at all"), row(9, "\n".join(["a line"] * 50)),
        row(10, "É é Ünï 中国 🙂 same", None), row(11, "Same Text here", None), row(12, "x" * 20_000)]


def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
