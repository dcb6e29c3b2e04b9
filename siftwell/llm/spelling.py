"""Spelling variants by anagram hashing: words that differ in one letter, and the frequent form that each belongs to.

A word's key is the sum of its letters' fifth powers, whatever their order. Taking a letter away takes its power from the key, so the
keys "of all but one letter" of a word lead to what is near it:

* the key of a word without a letter is the key of a word that lacks this letter (addition and removal);
* two words' keys without a letter each are equal where one letter stands for another (exchange).

So each word brings its own key and one for each of its different letters into one join, which replaces a search over all exchange
values. Words that meet have the same letters but one; the order of these is verified. Keys that more than GROUP rows share (long
anagrams) are joined by the letters in their order as well: at most one word for each letter of the alphabet is left at a place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_lookup, stage

#: Rows of one key that are compared with each other; beyond, they meet by their letters in order.
GROUP = 64
#: Keys are sums modulo a prime, so no word is too long for them.
PRIME = (1 << 61) - 1
#: Runs of letters (as a Java pattern of what stands between them).
NOT_LETTERS = r"[^A-Za-zÀ-ÿ]+"


def letter_value(letter: Column) -> Column:
    """The fifth power of a letter's code point (of its last 12 bits: letters that share them only meet more often)."""
    x = F.ascii(letter).cast("long") % 4096
    return x * x * x * x * x


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda key, letter: (key + letter_value(letter)) % PRIME)


def count_words(docs: DataFrame, *, min_length: int = 6, min_count: int = 5, respell=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters A-Z, a-z and U+00C0 to U+00FF of all whole texts, A-Z lower-cased, and how often each occurs.

    ``respell`` (a function of the columns id and run) may change each run first. Of the results those of at least ``min_length`` code
    points and ``min_count`` occurrences are returned. Null and empty texts have no runs; a very long text is one array of runs in a
    task. Repeated rows count each. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(F.split(text, NOT_LETTERS), lambda r: F.length(r) >= min_length)).alias("run"))
    words = runs.select((respell(F.col("id"), F.col("run")) if respell else F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of different ``word`` values that one added, removed or exchanged letter turns into each other, both ways.

    Null words have no pairs; repeated rows count once; an empty table has none. The words must be at least one code point long.
    """
    base = words.select("word").distinct().where("word IS NOT NULL").withColumn("key", anagram_key(F.col("word"))).withColumn("long", F.length("word"))
    letter = F.explode(F.array_distinct(F.split("word", "")))
    less = base.select("word", letter.alias("letter"), "key", "long")
    less = less.select("word", "letter", F.xxhash64(F.pmod(F.col("key") - letter_value(F.col("letter")), F.lit(PRIME)), F.col("long") - 1).alias("key"))
    rows = base.select("word", F.lit(None).cast("string").alias("letter"), F.xxhash64("key", "long").alias("key")).unionByName(less)
    crowded = cut(rows.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.lit(True).alias("crowded")))
    rows = stage(join_lookup(rows, crowded, "key", crowded.count(), F.col("word")))
    usual, many = rows.where("crowded IS NULL"), rows.where("crowded")

    a, b = usual.select("key", F.col("word").alias("a"), F.col("letter").alias("a_letter")), usual.select("key", F.col("word").alias("b"), F.col("letter").alias("b_letter"))
    meet = ((F.col("a_letter").isNull() & F.col("b_letter").isNotNull()) | (F.col("a_letter") < F.col("b_letter"))) & (F.levenshtein("a", "b", 1) == 1)
    pairs = a.join(b, "key").where(meet).select("a", "b")

    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda k: F.substring(F.col("word"), k, F.lit(1)) == F.col("letter"))
    placed = many.where("letter IS NOT NULL").select("word", "letter", "key", F.explode(places).alias("place"))
    rest = F.concat(F.substring(F.col("word"), F.lit(1), F.col("place") - 1), F.substring(F.col("word"), F.col("place") + 1, F.length("word")))
    placed = placed.withColumn("rest", rest)
    c, d = placed.select("key", "place", "rest", F.col("word").alias("a"), F.col("letter").alias("a_letter")), placed.select("key", "place", "rest", F.col("word").alias("b"), F.col("letter").alias("b_letter"))
    exchanged = c.join(d, ["key", "place", "rest"]).where("a_letter < b_letter").select("a", "b")
    whole = many.where("letter IS NULL").select("key", F.col("word").alias("a"))
    added = placed.select("key", F.col("rest").alias("a"), F.col("word").alias("b")).join(whole, ["key", "a"]).select("a", "b")

    found = pairs.unionByName(exchanged).unionByName(added)
    both = found.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p"))
    return both.select("p.*").distinct()


def group_variants(counts: DataFrame, *, ratio: int = 5, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word: how many words are near it; of these the most frequent one (ties: the
    smallest in code-point order) if it occurs ``ratio`` times as often at least, else null; and where following forms ends.

    Counts of repeated words are added up; rows with a null word are left out; null counts are 0. An empty table gives an empty result.
    Other columns are ignored. Counts grow by ``ratio`` with each form (a word of no occurrences has none), so following doubles its steps
    a known number of times.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variant")
    words = counts.where(F.col(word_col).isNotNull()).groupBy(F.col(word_col).alias("word")).agg(F.sum(F.coalesce(F.col(n_col).cast("long"), F.lit(0))).alias("n"))
    words = stage(words)
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best"))
    is_form = (F.col("n") > 0) & (-F.col("best.order") >= F.col("n") * ratio)
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.order")).alias("form_n"))
    found = stage(found)
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = found.agg(F.max("form_n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(1, math.log(most) / math.log(ratio) + 1)))):
        roots = stage(roots)
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
