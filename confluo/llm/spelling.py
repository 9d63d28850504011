"""Spelling variants of a vocabulary: words one edit apart, without pairs.

Words that differ by one replaced character share a wildcard group: the same position, prefix and suffix. A group's size
and its two most frequent words say all its members need. A word with one character deleted is looked up among the words:
that gives both ends of an insertion or deletion, and each word puts together what it finds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read, write

#: Stands for any character at its place in a group's key; in no word.
WILD = "\u0000"
#: Longer words take part only if another of about their length begins or ends with the same ENDS letters, as near ones do.
EXACT, ENDS = 64, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of at least least_length letters that occur least_count times or more in all whole texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. Where every divides the checksum of
    `id:word`, the occurrence loses the letter at the checksum modulo the length (every = 0: never). Null and empty texts
    have no words; a null id counts as an empty one; repeated rows count each; an empty table gives an empty result.
    Occurrences are counted where they are read, before the shuffle, so a frequent word is a row a task.
    """
    word = F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0)))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), word.alias("word"))
    if every:
        words = words.where(F.length("word") >= least_length)
        h = F.crc32(F.concat_ws(":", "doc_id", "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        less = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        words = words.select("word", h.alias("h"), less.alias("less")).select(F.when(F.col("h") % every == 0, F.col("less")).otherwise(F.col("word")).alias("word"))
    words = words.where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _best(n, word):
    """Orders candidates: most frequent first, then by code points."""
    return F.struct((-n).alias("n"), word.alias("word"))


def _without(i):
    """The word before and after the character at i (from 1)."""
    return F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)


def _taking_part(words: DataFrame) -> DataFrame:
    """The words that may have near ones: all but long ones whose first and last letters no other long word has."""
    ends = F.array(F.concat(F.lit("<"), F.left("word", F.lit(ENDS))), F.concat(F.lit(">"), F.right("word", F.lit(ENDS))))
    ends = words.where(F.length("word") >= EXACT).select("word", F.explode(ends).alias("end"))
    crowded = ends.join(ends.groupBy("end").count().where("count > 1"), "end", "left_semi").select("word").distinct()
    long = F.length("word") > EXACT
    return words.where(~long).union(words.where(long).join(crowded, "word", "left_semi"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near (how many other words are exactly one inserted, deleted or replaced character away) and best
    (struct of -n and word: the most frequent of these, of equals the first by code points; null if none).

    words: distinct words and their n; a word of m letters makes m rows of its length (see _taking_part for long ones). No pair of words becomes a row for being in one group: a group of the same position,
    prefix and suffix has one word for each character there is, and gives each member its size less one and the first of its
    two best words that isn't the member. A word looks up what is left of it without one character, a row for each distinct
    rest; what finds a word both ways is added up by word, before and after the shuffle. Null words are left out.
    """
    words = words.where("word is not null").select("word", "n")
    at = F.col("i")
    placed = _taking_part(words).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    groups = Window.partitionBy("key")
    ranked = groups.orderBy(F.desc("n"), "word")
    members = placed.select("word", "n", F.concat(_without(at)[0], F.lit(WILD), _without(at)[1]).alias("key")).select(
        "word",
        (F.count("*").over(groups) - 1).alias("n_near"),
        F.when(F.row_number().over(ranked) == 1, F.lead(_best(F.col("n"), F.col("word"))).over(ranked)).otherwise(F.first(_best(F.col("n"), F.col("word"))).over(ranked)).alias("best"),
    )
    replaced = members.where("n_near > 0")
    # Of equal neighbours the first is deleted, so a rest stands once.
    fresh = (at == 1) | (F.substr("word", at, F.lit(1)) != F.substr("word", at - 1, F.lit(1)))
    rests = placed.where(fresh & (F.length("word") > 1)).select(F.concat(*_without(at)).alias("rest"), F.col("word").alias("longer"), F.col("n").alias("longer_n"))
    met = rests.join(words, F.col("rest") == F.col("word"))
    ends = F.array(
        F.struct(F.col("word").alias("word"), _best(F.col("longer_n"), F.col("longer")).alias("best")),
        F.struct(F.col("longer").alias("word"), _best(F.col("n"), F.col("word")).alias("best")),
    )
    indels = met.select(F.explode(ends).alias("e")).select("e.word", F.lit(1).cast("long").alias("n_near"), "e.best")
    found = replaced.unionByName(indels).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "best")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words and their n.

    form is a word's most frequent near word (see near_words), if that has times the word's n at least, else null; root is
    the last form on the way from form to form, the word itself without one. times is 2 or more, so the way ends after at
    most the logarithm of the greatest n, and roots are found in the logarithm of that many rounds, each a written table.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    old = Scratch(words.sparkSession)
    try:
        known = old.write(words, "spelling-words")
        found = near_words(known())
        takes = -F.col("best.n") >= times * F.col("n")
        formed = write(found.select("word", F.when(takes, F.col("best.word")).alias("form"), "n", "n_near", F.when(takes, -F.col("best.n")).alias("form_n")), "spelling-forms")
        # The way from each word that has a form: after every round twice as far.
        way = old.write(formed().where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
        while True:
            further = way().select(F.col("word").alias("root"), F.col("root").alias("next"))
            step = way().join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            step = old.write(step, "spelling-roots")
            moved, way = not step().where("moved").isEmpty(), lambda step=step: step().select("word", "root")
            if not moved:
                break
        roots = write(way(), "spelling-roots")
    finally:
        old.clear()
    return formed().join(roots(), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(read(spark, sf_dir, "documents")))
