"""Groups of spelling variants by permuterm rotations.

A word of n code points, marked with a terminator, has n + 1 rotations. The rotation that ends in the code point at place i spells, before that
code point, everything else of the word: that prefix is the key of the word with place i skipped. Sorted by key, the words of one key that
skip a place differ by one replacement there, and a word whose whole rotation is the key lacks the skipped code point, an insertion or deletion. A key and a
code point fix a word, so a group has at most one member for each letter of the alphabet and one more, however many words there are.

The sorted groups are scanned, not paired: each member gets how many neighbours it meets there and the best of them from the group's
counts and its first two members. A pair that differs by a replacement meets in one group. A pair that differs by an insertion meets once for each
place of a run of equal code points; only the first place of a run counts.

Forms: the near word of largest count (ties: smallest in code-point order) if it has at least ``ratio`` times the word's own count. Counts at least double along forms,
so roots are found by doubling the steps, in a number of rounds that is the logarithm of a logarithm of the largest count.

Nulls and edges: a null or empty text has no words; a null doc_id counts as an empty one in the hash; repeated rows count each time; an empty table
gives no words; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bondwise.llm.text import ascii_lower, ensure
from bondwise.session import cut, cut_measured, forget

# fixed values: what a word is
LETTERS = r"[A-Za-zÀ-ÿ]+"
END = "$"
MIN_LENGTH, MIN_COUNT, RATIO, SLIP = 5, 3, 2, 97


def slipped(doc_id: Column, run: Column, slip: int = SLIP) -> Column:
    """A lower-cased run, without one code point where the hash of document and run is divisible by ``slip``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % slip == 0, less).otherwise(run)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): words of all texts, long and frequent enough."""
    docs = ensure(docs.select("doc_id", "text"), text="string")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(LETTERS), F.lit(0))).alias("run"))
    # a run too short to give a word goes before it is hashed
    words = runs.filter(F.char_length("run") >= min_length).select(slipped(F.col("doc_id"), F.col("run"), slip).alias("word"))
    return words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, whole, first, word, n): every key of every word; ``first`` where the skipped code point starts a run of equals.

    The marked word written twice holds all rotations as slices.
    """
    size = F.char_length("word")
    marked = words.withColumn("twice", F.concat("word", F.lit(END), "word", F.lit(END)))
    each = marked.withColumn("i", F.explode(F.sequence(F.lit(1), size + 1)))
    # the rotation that starts after place i; place size + 1 is the terminator, whose rotation is the marked word itself
    skips = F.when(F.col("i") <= size, F.struct(
        F.substring("twice", F.col("i") + 1, size).alias("key"), F.lit(False).alias("whole"),
        ((F.col("i") == 1) | (F.substring("twice", F.col("i"), F.lit(1)) != F.substring("twice", F.col("i") - 1, F.lit(1)))).alias("first"),
    ))
    wholes = F.struct(F.substring("twice", F.col("i"), size + 1).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("first"))
    both = each.select("word", "n", F.explode(F.filter(F.array(skips, wholes), lambda e: e.isNotNull())).alias("r"))
    return both.select("r.*", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): how many words are near, and the near word of largest count; only words that have one."""
    group = W.partitionBy("key")
    ranked = group.orderBy(F.desc("n"), "word").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("best"))
    scanned = rotations(words).select(
        "word", "whole", "first",
        F.count_if(~F.col("whole")).over(ranked).alias("skips"), F.count_if("first").over(ranked).alias("firsts"), F.bool_or("whole").over(ranked).alias("has_whole"),
        F.first(one).over(ranked).alias("a"), F.nth_value(one, 2).over(ranked).alias("b"),
    ).filter("b is not null")
    met = F.when(F.col("whole"), F.col("firsts")).otherwise(F.col("skips") - 1 + (F.col("has_whole") & F.col("first")).cast("int"))
    best = F.when(F.col("a.best") == F.col("word"), F.col("b")).otherwise(F.col("a"))
    per = scanned.select("word", met.alias("met"), best.alias("best")).groupBy("word").agg(F.sum("met").alias("n_near"), F.min("best").alias("top"))
    return per.select("word", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form). Each round doubles the steps taken; words that have arrived leave the loop."""
    links = cut(forms.select("word", F.col("form").alias("to")), "form-links")
    done, walking = [], links
    while True:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        step = walking.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNull().alias("arrived"))
        step, seen = cut_measured(step, "form-steps", left=F.count_if(~F.col("arrived")))
        done.append(step.filter("arrived").select("word", F.col("to").alias("root")))
        if not seen["left"]:
            break
        walking = step.filter("not arrived").select("word", "to")
        # the links themselves double: a word whose target has a target skips to it
        jump = links.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"))
        before, links = links, cut(jump, "form-links")
        forget(before)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: float = RATIO, slip: int = SLIP) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words."""
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word, or forms could go round in circles")
    words = cut(word_counts(docs, min_length, min_count, slip), "words")
    near = neighbours(words)
    takes = F.col("best_n") >= F.lit(ratio) * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")
    )
    found = cut(found, "forms")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
