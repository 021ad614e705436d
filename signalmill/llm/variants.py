"""Spelling variants: words one edit apart, grouped under their commonest form, by a rare-first prefix filter of positional bigrams.

Bigrams are ordered by how many words hold them, and those of a word by this and by place. One edit takes at most two bigrams of a word and
adds at most two; the others stay in order, so that the first of these is one of the three rarest of either word, at places that agree to
within the edit. Only the three are joined; what meets is verified by the edit distance inside the join. DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bigrams of a word that are joined: one more than an edit can change.
PREFIX = 3
#: Code points of words: a-z and U+00C0 to U+00FF, so that there are LETTERS**2 bigrams at most.
LETTERS = 26 + 64
#: Words of a posting that one task compares at least; a posting of more is dealt over salts, MOST_SPLIT postings at most.
POSTING, MOST_SPLIT = 1_000, 10_000


def word_counts(df: DataFrame, doc_id: Column, text: Column, noise: int = 199, least: int = 6, times: int = 5) -> DataFrame:
    """(word, n): words of at least `least` code points that occur at least `times` times, where a run of letters loses one code point if
    `noise` divides its CRC. Counts are summed before the shuffle."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    runs = df.select(F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    code = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = code.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def bigrams(word: Column) -> Column:
    """Each pair of neighbouring letters, as a number below LETTERS**2."""
    letters = F.transform(F.split(word, ""), lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(F.ascii(c) - 192 + 26))
    return F.element_at(F.transform(F.array(letters), lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: a * LETTERS + b)), 1)


def rarest(vocabulary: DataFrame) -> DataFrame:
    """(word, n, size, rank, pos): each word's PREFIX rarest bigrams. What is collected is the count of each bigram, LETTERS**2 numbers
    at most."""
    counts = vocabulary.select(F.explode(bigrams(F.col("word"))).alias("g")).groupBy("g").count().collect()
    ranks = ["0"] * LETTERS**2
    for k, r in enumerate(sorted(counts, key=lambda r: (r["count"], r["g"]))):
        ranks[r["g"]] = str(k)
    rank = F.split(F.lit(",".join(ranks)), ",").cast("array<int>")
    placed = vocabulary.withColumn("items", F.sort_array(F.transform(bigrams(F.col("word")), lambda g, i: F.struct(F.get(rank, g).alias("rank"), i.alias("pos")))))
    held = placed.select("word", "n", F.length("word").alias("size"), F.explode(F.slice("items", 1, PREFIX)).alias("item"))
    return held.select("word", "n", "size", "item.rank", "item.pos")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, na, b, nb): words of a stored vocabulary (word, n) that are one edit apart, each pair once. The shorter word looks where
    the edit can have put its bigram: at the same place of words as long; there or one further on of words longer by one. A posting of many
    words is dealt over salts, to each of which those who look there are copied."""
    spark = vocabulary.sparkSession
    held = common.materialise(spark, rarest(vocabulary), "variants-bigrams")
    key = ["rank", "pos", "size"]
    sizes = held.groupBy(*key).agg(F.count("*").alias("rows"))
    most = max(POSTING, -(-held.count() // MOST_SPLIT))
    hot = F.broadcast(sizes.where(F.col("rows") > most).select(*key, F.ceil(F.col("rows") / most).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    # One edit leaves the front or the back half of the shorter word as it is; that is compared, by hashes, before the distance is worked out.
    front = lambda n: F.xxhash64(F.substring("word", F.lit(1), n))
    back = lambda n: F.xxhash64(F.substring("word", F.col("size") - n + 1, n))
    half = lambda n: F.floor(n / 2).cast("int")
    size, less = F.col("size"), F.col("size") - 1
    halves = F.struct(*(x.alias(c) for c, x in (("front", front(half(size))), ("back", back(size - half(size))), ("front_less", front(half(less))), ("back_less", back(less - half(less))))))
    there = held.join(hot, key, "left").select(*key, F.pmod(F.xxhash64("word"), salts).cast("int").alias("salt"), F.col("word").alias("b"), F.col("n").alias("nb"), halves.alias("there"))
    spots = F.array(*(F.struct((F.col("pos") + p).alias("pos"), (F.col("size") + s).alias("size")) for p, s in ((0, 0), (0, 1), (1, 1))))
    look = held.select("rank", F.explode(spots).alias("spot"), F.col("word").alias("a"), F.col("n").alias("na"), F.col("size").alias("own"), front(half(size)).alias("front"), back(size - half(size)).alias("back"))
    look = look.select("rank", "spot.pos", "spot.size", "a", "na", "own", "front", "back").join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    shorter = F.col("own") < F.col("size")
    same = lambda c: F.col(c) == F.when(shorter, F.col(f"there.{c}_less")).otherwise(F.col(f"there.{c}"))
    ordered = shorter | (F.col("a") < F.col("b"))
    met = look.join(there, [*key, "salt"]).where(ordered & (same("front") | same("back")) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "na", "b", "nb").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of stored (word, form): the last form that forms lead to. Each form is commoner by a factor, so that chains are short; a turn
    doubles the way that all have gone."""
    spark, far = forms.sparkSession, forms.select("word", F.col("form").alias("root"))
    while not far.join(forms.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        on = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = common.materialise(spark, far.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variants-roots")
    return far


def spelling_variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = 199, least: int = 6, times: int = 5, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of df's texts (word_counts). Two words are near if one inserted, deleted or replaced
    code point makes one of the other. form: the near word of largest n, of these the first in code-point order, if it occurs `factor`
    times as often; root: where forms lead to, the word itself without any.

    Null and empty texts have no words; a null doc_id counts as an empty id; repeated rows count as often as they come; texts and words of any
    length are taken whole; an empty table gives no rows; other columns aren't read."""
    spark = df.sparkSession
    vocabulary = common.materialise(spark, word_counts(df, df[doc_id], df[text], noise, least, times), "variants-words")
    pairs = common.materialise(spark, near_words(vocabulary), "variants-near")
    both = pairs.toDF("word", "n", "near", "near_n").unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best")
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    fit = -F.col("best.k") >= factor * F.col("n")
    near = near.select("word", "n_near", F.when(fit, F.col("best.near")).alias("form"), F.when(fit, -F.col("best.k")).alias("form_n"))
    near = common.materialise(spark, near, "variants-forms")
    led = roots(near.where("form IS NOT NULL").select("word", "form"))
    out = vocabulary.join(near, "word", "left").join(led, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
