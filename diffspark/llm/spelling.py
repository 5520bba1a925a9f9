"""Spelling variants: words one edit apart, found under a reduced alphabet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.llm._common import ascii_lower, checkpoint

#: Runs of Latin letters.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Symbols that letters are hashed to.
SYMBOLS = 8


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """A word with each code point replaced by one of ``symbols`` letters, by its hash."""
    points = F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))
    return F.array_join(F.transform(points, lambda c: F.char(97 + F.pmod(F.xxhash64(c), F.lit(symbols)))), "")


def neighbourhood(form: Column, symbols: int = SYMBOLS) -> Column:
    """The distinct words of the reduced alphabet within one inserted, deleted or replaced symbol of ``form``, itself included."""
    letters = F.array(*(F.lit(chr(97 + k)) for k in range(symbols)))
    size = F.char_length(form)
    places = F.sequence(F.lit(1), size + 1)  # one past the end takes an insertion alone
    head = lambda i: F.substring(form, F.lit(1), i - 1)
    rest = lambda i: F.substring(form, i, size)
    deleted = F.transform(places, lambda i: F.concat(head(i), rest(i + 1)))
    inserted = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda s: F.concat(head(i), s, rest(i)))))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda s: F.when(i <= size, F.concat(head(i), s, rest(i + 1))).otherwise(form))))
    return F.array_distinct(F.concat(deleted, replaced, inserted))


def near_words(vocabulary: DataFrame, *, symbols: int = SYMBOLS) -> DataFrame:
    """All ordered pairs of different words of ``vocabulary`` (word, n) that are one edit of a code point apart: word, n, other, other_n.

    Words one edit apart are at most one edit apart under the reduced alphabet too. The distinct reduced words are spread over their full neighbourhoods and joined with themselves, the pairs of reduced words that are found are joined with their words, and each pair is verified on the original strings. A reduced word that many words share is split by Spark as a join's hot key.
    """
    forms = vocabulary.select("word", "n", reduced(F.col("word"), symbols).alias("form"))
    every = forms.select("form").distinct()
    spread = every.select(F.col("form").alias("of"), F.explode(neighbourhood(F.col("form"), symbols)).alias("form"))
    met = spread.join(every, "form").select("of", "form")
    left = forms.select("word", "n", F.col("form").alias("of")).join(met, "of")
    right = forms.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "form")
    return left.join(right, "form").where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")


def spelling_variants(vocabulary: DataFrame, *, symbols: int = SYMBOLS, ratio: int = 5) -> DataFrame:
    """Group the words of ``vocabulary`` (word, n) with the spelling that they vary: word, form, root, n, n_near, form_n.

    n_near: words one edit apart. form: of these the one of largest n (ties: the first in code-point order), if that n is at least ``ratio`` times the word's own; form_n its n. root: the last word of the chain of forms. Counts grow along a chain by ``ratio`` (2 at least), so it is short, and pointers over it are doubled in a few joins.

    Defined cases: the n of repeated words are added; a null word or n has no row, nor has a word whose n isn't positive; a word without near words is its own root, with n_near 0; an empty table gives an empty table; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio is at least 2")
    words = checkpoint(vocabulary.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")).where("n > 0"))
    best = F.min(F.struct((-F.col("other_n")).alias("least"), F.col("other").alias("form")))
    near = near_words(words, symbols=symbols).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", F.col("best.form").alias("_form"), (-F.col("best.least")).alias("_form_n"), (-F.col("best.least") >= ratio * F.col("n")).alias("_is"))
    near = near.select("word", "n_near", F.when(F.col("_is"), F.col("_form")).alias("form"), F.when(F.col("_is"), F.col("_form_n")).alias("form_n"))
    out = checkpoint(words.join(near, "word", "left"))
    links = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = checkpoint(links.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "root")
    out = out.join(links.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def occurrences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_chars: int = 6, drop_one_in: int | None = None) -> DataFrame:
    """The letter runs of every whole text, A-Z lower-cased, of at least ``least_chars`` code points: word, a row each.

    drop_one_in: a run whose crc32 (of "id:run", in UTF-8) it divides loses its code point crc32 % length; what is left counts by its own length. A null text has no runs, a null id counts as an empty one.
    """
    run = F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(LETTERS), F.lit(0))).alias("word")
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), run).where(F.char_length("word") >= least_chars)
    if drop_one_in is None:
        return runs.select("word")
    h, size = F.col("h"), F.char_length("word")
    at = (h % size).cast("int")
    less = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, size))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat_ws(":", "id", "word"), "UTF-8")))
    return runs.select(F.when(h % drop_one_in == 0, less).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= least_chars)


def vocabulary(words: DataFrame, *, least: int = 5) -> DataFrame:
    """word, n of the words that occur ``least`` times or more."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
