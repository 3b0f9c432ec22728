"""Spelling variant grouping: words one edit apart, met by asymmetric q-chunks, and followed to their most frequent form.

A word of L code points contributes two disjoint chunks of L // 2 code points, its first and its last; every word contributes all
its positional grams of the lengths that partners one longer, one shorter or as long have as chunks. One edit leaves one of the two chunks whole and moves
it by one place at most, so each pair one edit apart meets at some (gram, place): the chunks go to their place and to the two beside it. What
meets is verified by edit distance.

Words that share a chunk can be many (a common prefix). Where a (gram, place) would give its words more than MEET candidates each, on
average, its words meet by deletion variants besides: words one edit apart share one, and a variant has few words, whatever the
number of words in the vocabulary. So candidates stay in proportion to the words, and no pair is lost.

Defined cases: a null or empty text has no runs; texts of any length are read whole; an empty table gives no rows. A null id counts as empty
text where `slipped` hashes it. Repeated rows count again. Words of fewer than two code points are near none. Of near words with the same count, the least in
code-point order is the form. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS_LOW, LETTERS_UP, write_shared

#: Letters of a word once A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
#: Candidates a word may have at a (gram, place), on average, before deletion variants are asked for too. Changes the plan, not the rows.
MEET = 256


def runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, run) for each maximal run of letters of the whole texts, A-Z lower-cased."""
    low = F.translate(F.col(text), LETTERS_UP, LETTERS_LOW)
    return docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))


def slipped(run: Column, ident: Column, every: int) -> Column:
    """The run, or where `every` divides h, the unsigned crc32 of `<ident>:<run>`, the run without its code point h % length."""
    h = F.crc32(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of a column `word`: the words long and frequent enough, with their occurrences."""
    long_enough = words.where(F.length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _grams(q: Column) -> Column:
    last = F.length("word") - q
    places = F.when((q > 0) & (last >= 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda p: F.struct(F.substring(F.col("word"), p + 1, q).alias("gram"), p.alias("place")))


def _gram_side(words: DataFrame) -> DataFrame:
    """Every positional gram of a word, of the two lengths that a partner's chunks can have."""
    short, long = ((F.length("word") - 1) / 2).cast("int"), ((F.length("word") + 1) / 2).cast("int")
    both = F.concat(_grams(short), F.when(long > short, _grams(long)).otherwise(F.array().cast("array<struct<gram:string,place:int>>")))
    return words.select("word", "n", F.inline(both))


def _chunk_side(words: DataFrame) -> DataFrame:
    """The two disjoint chunks of a word, each at its place and at the two beside it."""
    q = (F.length("word") / 2).cast("int")
    around = [F.struct(F.substring(F.col("word"), at + 1, q).alias("gram"), (at + s).alias("place")) for at in (F.lit(0), F.length("word") - q) for s in (-1, 0, 1)]
    return words.select("word", "n", F.inline(F.array_distinct(F.array(*around)))).where("place >= 0")


def _variants() -> Column:
    """The word and the word without one of its code points, each once."""
    shorter = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word"))))
    return F.array_distinct(F.concat(F.array("word"), shorter))


def near_pairs(words: DataFrame, meet: int = MEET) -> DataFrame:
    """(a, n_a, b, n_b), a < b: all pairs of distinct words, each a row (word, n), that one inserted, deleted or replaced code point parts."""
    words = words.where(F.length("word") >= 2)
    chunk, gram = _chunk_side(words), _gram_side(words)
    sizes = chunk.select("gram", "place", F.lit(1).alias("c"), F.lit(0).alias("g")).unionByName(gram.select("gram", "place", F.lit(0).alias("c"), F.lit(1).alias("g")))
    sizes = sizes.groupBy("gram", "place").agg(F.sum("c").alias("c"), F.sum("g").alias("g"))
    hot = write_shared(sizes.where(F.col("c") * F.col("g") > meet * (F.col("c") + F.col("g"))).select("gram", "place", F.lit(True).alias("hot")), "hot-grams")

    def side(rows: DataFrame, word: str, n: str) -> DataFrame:
        marked = rows.join(hot, ["gram", "place"], "left")
        return marked.select("gram", "place", F.col("word").alias(word), F.col("n").alias(n), F.explode(F.when(F.col("hot"), _variants()).otherwise(F.array(F.lit("")))).alias("variant"))

    met = side(chunk, "a", "n_a").join(side(gram, "b", "n_b"), ["gram", "place", "variant"]).where("a < b AND abs(length(a) - length(b)) <= 1")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, at most `steps` of them, doubling what a round follows."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        at = write_shared(at, "roots")
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return at


def variants(words: DataFrame, ratio: int = 5, meet: int = MEET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n): each word's most frequent near word if that has at least `ratio` times its occurrences, and where
    these forms lead. Counts grow by `ratio` at each step, so a chain of forms has no cycle and at most log(most / least) steps.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could lead in a circle")
    words = write_shared(words.select("word", "n"), "words")
    pairs = near_pairs(words, meet)
    each = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("m")))))
    best = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"), F.max("n").alias("own"))
    good = -F.col("best.m") >= ratio * F.col("own")
    best = write_shared(best.select("word", "n_near", F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "near")
    ends = words.agg(F.min("n"), F.max("n")).first()
    steps = 0
    while ends[0] and ends[0] * ratio ** (steps + 1) <= ends[1]:
        steps += 1
    roots = _roots(best.where("form IS NOT NULL"), steps)
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
