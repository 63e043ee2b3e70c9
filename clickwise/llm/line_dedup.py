"""Line dedup by a deletion-neighbourhood join (DataFrame functions only).

A line (between line feeds) is a list of words (between single blanks).  Two
lines match when they are equal, or when both have NEAR_WORDS words or more and
one word put in, left out or replaced turns one into the other.  A line is
dropped when it matches an earlier one, by (doc_id, line number).

Every variant of a line with one word deleted is a hashed key; so is the line
itself.  Lines that equal each other without the word at the same place are one
replacement apart; a line that equals another without one word is one insertion
apart.  All members of a key match its earliest member, so each key needs only
that one (a map-side combined minimum): no pairs within a group.  The match found
is then verified on the words themselves.

Before any variant is made, lines that cannot have a match are put aside,
exactly: one edit leaves the first or the last half of a line as it is, so a
line that shares neither half with another line needs no variants.  Variants'
hashes are XORs of word-and-place hashes taken from running XORs, so a line of n
words costs n steps, however long it is.

Defined results: null and empty texts have no lines to drop; lines under
MIN_WORDS words always stay; a null doc_id comes before all others; rows that
repeat doc_id and text are one document; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clickwise.llm.common import broadcast_if_small, materialise

MIN_WORDS, NEAR_WORDS = 3, 8


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (of the text), line_no, line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"),
                       F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _name(line: Column) -> Column:
    """A line's 128-bit name."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _half_keys() -> Column:
    """The halves that one edit leaves: for the shorter line's length n or n - 1,
    its first n div 2 words and its last n - n div 2."""
    def keys(n: str) -> list[Column]:
        return [F.expr(f"xxhash64({n}, 'first', substring_index(line, ' ', cast({n} div 2 as int)))"),
                F.expr(f"xxhash64({n}, 'last', substring_index(line, ' ', cast({n} div 2 - {n} as int)))")]
    return F.array(*keys("n"), *keys("(n - 1)"))


def _variants(lines: DataFrame) -> DataFrame:
    """key, line, place: each single deletion as a replacement key (place i) and as
    an insertion key (place -2 - i), and the line itself (place -1)."""
    line = W.partitionBy("line")
    upto = line.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    words = (lines.select("line", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
                  .withColumn("p", F.xxhash64("word", "i")).withColumn("q", F.xxhash64("word", F.col("i") - 1)).drop("word")
                  .withColumn("p_upto", F.bit_xor("p").over(upto)).withColumn("q_upto", F.bit_xor("q").over(upto))
                  .withColumn("q_all", F.bit_xor("q").over(line)))
    # Before the deleted word as it was, after it one place to the left.
    rest = words.withColumn("rest", F.col("p_upto").bitwiseXOR(F.col("p")).bitwiseXOR(F.col("q_all")).bitwiseXOR(F.col("q_upto")))
    keys = F.array(F.struct(F.xxhash64(F.lit("replace"), "rest", "n", "i").alias("key"), F.col("i").alias("place")),
                   F.struct(F.xxhash64(F.lit("insert"), "rest", F.col("n") - 1).alias("key"), (-2 - F.col("i")).alias("place")))
    whole = F.struct(F.xxhash64(F.lit("insert"), "p_upto", "n").alias("key"), F.lit(-1).alias("place"))
    all_keys = F.when(F.col("i") == F.col("n") - 1, F.concat(keys, F.array(whole))).otherwise(keys)
    return rest.select("line", F.explode(all_keys).alias("k")).select("k.key", "line", "k.place")


def near_lines(docs: DataFrame, occ: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """line, match: lines within one word's edit of an earlier line, with that line.
    ``occ`` has the occurrences: line, halves, at."""
    halves = occ.filter("halves IS NOT NULL").select("line", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("line.a").alias("lo"), F.max("line.a").alias("hi")).filter("lo != hi").select("half")
    wanted = materialise(halves.join(shared, "half", "left_semi").select("line").distinct())
    chosen = materialise(occ.join(broadcast_if_small(wanted), "line", "left_semi").groupBy("line").agg(F.min("at").alias("first")))
    # The words of each line are read where the line stands first.
    texts = (_lines(docs, id_col, text_col)
             .select(_name(F.col("line")).alias("line"), F.col("line").alias("text"), F.struct("doc_id", "mark", "line_no").alias("at")))
    lines = materialise(texts.join(broadcast_if_small(chosen), "line").filter(F.col("at").eqNullSafe(F.col("first")))
                             .select("line", "first", F.split("text", " ").alias("w")).dropDuplicates(["line"]))
    keyed = _variants(lines).repartition("key")
    met = materialise(keyed.join(keyed.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi")
                           .join(lines.select("line", "first"), "line")
                           .withColumn("kind", F.when(F.col("place") >= 0, "r").when(F.col("place") == -1, "w").otherwise("d"))
                           .withColumn("place", F.when(F.col("place") < -1, -2 - F.col("place")).otherwise(F.col("place"))))
    of_kind = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("first", "line", "place"))).alias(kind)
    best = met.groupBy("key").agg(of_kind("r"), of_kind("d"), of_kind("w"))
    # A replacement matches its key's earliest; a longer line the whole line; the whole line the earliest longer one.
    other = F.when(F.col("kind") == "r", F.col("r")).when(F.col("kind") == "d", F.col("w")).otherwise(F.col("d"))
    found = (met.join(best, "key").withColumn("other", other).filter(F.col("other.first") < F.col("first"))
                .select("line", F.col("other.line").alias("match"), "kind",
                        F.when(F.col("kind") == "w", F.col("other.place")).otherwise(F.col("place")).alias("place")))
    words = lines.select("line", "w")
    pairs = found.join(words, "line").join(words.select(F.col("line").alias("match"), F.col("w").alias("mw")), "match")
    without = lambda w: F.concat(F.slice(w, F.lit(1), F.col("place")), F.slice(w, F.col("place") + 2, F.size(w)))
    same = (F.when(F.col("kind") == "r", without(F.col("w")) == without(F.col("mw")))
             .when(F.col("kind") == "d", without(F.col("w")) == F.col("mw")).otherwise(F.col("w") == without(F.col("mw"))))
    return pairs.filter(same).groupBy("line").agg(F.min("match").alias("match"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark, n_lines, dropped (sorted line numbers) per document."""
    n = F.expr("1 + length(line) - length(replace(line, ' ', ''))")
    occ = materialise(_lines(docs, id_col, text_col).withColumn("n", n)
                      .select(F.struct("doc_id", "mark", "line_no").alias("at"), F.when(F.col("n") >= MIN_WORDS, _name(F.col("line"))).alias("line"),
                              F.when(F.col("n") >= NEAR_WORDS, _half_keys()).alias("halves")))
    again = (occ.filter("line IS NOT NULL").groupBy("line").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
                .select("line", "first"))
    near = near_lines(docs, occ, id_col, text_col).select("line", F.lit(True).alias("near"))
    # Only repeated and near lines; every other line stays.
    verdict = materialise(again.join(near, "line", "full"))
    return (occ.select("at", "line").join(broadcast_if_small(verdict), "line", "left")
               .withColumn("gone", F.col("near").isNotNull() | (F.col("first").isNotNull() & ~F.col("at").eqNullSafe(F.col("first"))))
               .groupBy("at.doc_id", "at.mark")
               .agg(F.countDistinct("at.line_no").alias("n_lines"), F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("at.line_no")))).alias("dropped")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without its dropped lines, n_lines, dropped, per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    gone = dropped_lines(docs, id_col, text_col).withColumnsRenamed({"doc_id": "__doc", "mark": "__mark"})
    return (rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")))
                .select("doc_id", F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(F.filter(
                    F.split("text", "\n"), lambda x, i: ~F.array_contains("dropped", i)), "\n")).alias("text"), "n_lines", "dropped"))
