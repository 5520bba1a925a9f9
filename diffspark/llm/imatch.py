"""I-Match document fingerprints over randomised lexicon subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.llm._common import ascii_lower, checkpoint

#: Chance that a subset keeps a term, for each of the subsets: long documents are told apart by the sparse ones, short ones by the dense ones.
RATES = (1 / 32,) * 8 + (1 / 128,) * 8 + (1 / 512,) * 8 + (1 / 2048,) * 4
#: Bits of idf = log2(documents / documents with the term) between which a term counts.
BAND = (2.0, 10.0)
NONE = "." * 8


def terms(text: Column) -> Column:
    """Distinct lower-cased words of a text, in no order."""
    return F.array_remove(F.array_distinct(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+")), "")


def lexicon(docs: DataFrame, *, doc_id: str, text: str, band=BAND, rates=RATES, seed: int = 7) -> DataFrame:
    """The terms whose idf lies within ``band`` and that a subset keeps: term, subsets (bit k: in subset k).

    A term counts once for each document. The table has at most ``2**band[1]`` times the mean number of distinct terms of a document, whatever the number of documents, since the documents that hold its terms can't be more than that.
    """
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("_df"))
    kept = counts.where((F.col("_df") >= 2) & (n >= F.col("_df") * 2.0 ** band[0]) & (n <= F.col("_df") * 2.0 ** band[1]))
    bits = F.lit(0)
    for k, rate in enumerate(rates):
        digits = F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{k // 8}"), "term")), 1 + 4 * (k % 8), 4)
        bits = bits + F.when(F.conv(digits, 16, 10).cast("int") < int(rate * 65536), 1 << k).otherwise(0)
    # Tied to the counts, so that the optimiser doesn't hash every word of every document in a filter below the aggregation.
    return kept.select("term", F.when(F.col("_df") >= 2, bits).alias("subsets")).where("subsets <> 0")


def fingerprints(texts: DataFrame, words: DataFrame, *, n_subsets: int = len(RATES)) -> DataFrame:
    """Fingerprints of ``texts(range, key, text)`` over the lexicon ``words``: range, key, fingerprint. Rows dealt out by range stay where they are.

    For each subset the document's terms that it keeps are sorted and hashed; the fingerprint joins the hashes with '-'. A subset without a term gives dots. A text without any kept term has no row here; see ``plain``.
    """
    split = texts.select("range", "key", F.explode(terms(F.col("text"))).alias("term"))
    found = split.join(words, "term").groupBy("range", "key").agg(F.array_sort(F.collect_list(F.struct("term", "subsets"))).alias("_terms"))

    def subset(k: Column) -> Column:
        own = F.filter("_terms", lambda t: F.getbit(t["subsets"], k) == 1)
        return F.when(F.size(own) == 0, NONE).otherwise(F.substring(F.md5(F.array_join(F.transform(own, lambda t: t["term"]), " ")), 1, 8))

    joined = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_subsets - 1)), subset), "-")
    return found.select("range", "key", joined.alias("fingerprint"))


def plain(text: Column) -> Column:
    """The fingerprint of a text in which no subset keeps a term: the hash of the lower-cased text."""
    return F.concat(F.lit("all:"), F.md5(ascii_lower(text)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either text has a term; 1 or 0 where a fingerprint is plain."""
    pairs = F.arrays_zip(F.split(a, "-").alias("a"), F.split(b, "-").alias("b"))
    used = F.filter(pairs, lambda p: (p["a"] != NONE) | (p["b"] != NONE))
    same = F.filter(used, lambda p: p["a"] == p["b"])
    whole = a.startswith("all:") | b.startswith("all:")
    return F.when(a == b, 1.0).when(whole, 0.0).otherwise(F.size(same) / F.size(used))


def with_next(docs: DataFrame, *, doc_id: str, text: str, per_range: int = 2000, spans: int = 1 << 16) -> DataFrame:
    """Each row and its successor in descending order of id, the last one's being the first: range, place, id, text, next_range, next_place, next_text.

    The ids between the least and the largest are cut into parts of equal width, as many as would have ``per_range`` rows each if the ids were spread evenly, but ``spans`` at most, and the rows of each part, between its own least and largest id, into ranges of equal width of about ``per_range`` rows; a part of one id alone, and the null ids, are cut by a hash of the text. So ids that cluster get ranges of their own. A row's successor is read by a window within its range, and a range's last row has the first row of the next range that isn't empty. As a whole, only the parts are ordered, ``spans`` rows at most, a bound that lets them be broadcast too.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = docs.agg(F.min(doc_id).alias("low"), F.max(doc_id).alias("high"), F.count("*").alias("n")).first()
    spans = max(1, min(spans, -(-seen["n"] // per_range)))
    high = 0.0 if seen["high"] is None else float(seen["high"])
    width = max(1.0, (high - float(seen["low"] or 0) + 1) / spans) if seen["low"] is not None else 1.0
    span = F.coalesce(F.least(F.lit(spans - 1), F.floor((F.lit(high) - F.col("id").cast("double")) / width)), F.lit(spans)).cast("long")
    parts = docs.select(F.col(doc_id).alias("id")).select("id", span.alias("_span")).groupBy("_span").agg(F.count("*").alias("n"), F.min("id").cast("double").alias("low"), F.max("id").cast("double").alias("high"))
    parts = checkpoint(parts.withColumn("_ranges", F.ceil(F.col("n") / per_range)))
    inside = F.floor((F.col("high") - F.col("id").cast("double")) / F.greatest(F.lit(1.0), (F.col("high") - F.col("low") + 1) / F.col("_ranges")))
    part = F.when(F.coalesce(F.col("low") == F.col("high"), F.lit(True)), F.pmod(F.xxhash64("text"), F.col("_ranges"))).otherwise(F.least(inside, F.col("_ranges") - 1))
    # A part of large ids may hold two ids that are one double; they stay in one range then.
    part = F.when((F.col("low") == F.col("high")) & (F.abs("high") >= 2.0**53), F.lit(0)).otherwise(part)
    rows = rows.withColumn("_span", span).join(F.broadcast(parts), "_span").select("id", "text", (F.col("_span") * (1 << 40) + part.cast("long")).alias("range"))
    names = checkpoint(rows.select("range").distinct()).select("range", F.shiftright("range", 40).alias("_span"))
    order = W.partitionBy("range").orderBy(F.col("id").desc_nulls_last(), "text")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("_next", F.lead(F.struct("range", "place", "text")).over(order)).withColumn("_first", F.lag(F.lit(1)).over(order).isNull())
    # Told by a lag, not by place 1, which Spark would take for a limit by group and shuffle all texts once more for.
    heads = rows.where("_first").select("range", F.struct("range", "place", "text").alias("_head"))
    within = names.withColumn("_to", F.lead("range").over(W.partitionBy("_span").orderBy("range")))
    firsts = names.groupBy("_span").agg(F.min("range").alias("first"))
    after = W.orderBy("_span")
    follow = firsts.select("_span", F.coalesce(F.lead("first").over(after), F.first("first").over(after)).alias("_then"))
    links = within.join(follow, "_span").select("range", F.coalesce("_to", "_then").alias("_to"))
    links = links.join(heads.select(F.col("range").alias("_to"), "_head"), "_to").select("range", "_head")
    follower = F.coalesce("_next", "_head")
    return rows.join(links, "range").select("range", "place", "id", "text", *(follower[c].alias(f"next_{c}") for c in ("range", "place", "text")))


def imatch(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", band=BAND, rates=RATES, seed: int = 7, most_sent: int = 2_000_000) -> DataFrame:
    """I-Match fingerprints of all rows of ``docs``, of each row's text edited with its successor's, and their likeness.

    Terms are the distinct lower-cased words whose inverse document frequency lies within ``band``; each of several randomised lexicon subsets keeps a hashed share of them; the sorted terms that a subset keeps are hashed. A document changes the hash of those subsets only that keep one of the changed terms, so the share of equal hashes tells how alike two documents are. DataFrame functions only: terms are exploded and joined with the lexicon in the task that reads them, so that only a row for each document is shuffled beside the text itself; a lexicon of more than ``most_sent`` terms isn't broadcast, and Spark joins it by a shuffle.

    The edited text is the text with its last third (rounded down) replaced by the first as many code points (or all) of the next document's in descending order of id; after the last comes the first.

    Returns ``doc_id``, n_chars (long), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Defined cases: a null text is empty; a text in which no subset keeps a term, the empty one too, is fingerprinted by its own lower-cased hash; ids may lie anywhere in the range of a long; null ids come last; rows of one id come in order of text (of a hash of it first, where one id or the null ids fill a part of the ids alone); repeated rows give a row each; a single row is its own successor; an empty table gives an empty table; other columns are not read.
    """
    words = checkpoint(lexicon(docs, doc_id=doc_id, text=text, band=band, rates=rates, seed=seed))
    if words.count() <= most_sent:
        words = F.broadcast(words)
    n = F.char_length("text")
    part = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next_text"), F.lit(1), part))
    pairs = with_next(docs, doc_id=doc_id, text=text).withColumn("edited", edited)
    versions = F.explode(F.array(F.struct((F.col("place") * 2).alias("key"), "text"), F.struct((F.col("place") * 2 + 1).alias("key"), F.col("edited").alias("text"))))
    found = fingerprints(pairs.select("range", versions.alias("v")).select("range", "v.key", "v.text"), words, n_subsets=len(rates))
    both = found.groupBy("range", F.shiftright("key", 1).alias("place")).agg(*(F.max(F.when(F.col("key") % 2 == k, F.col("fingerprint"))).alias(c) for k, c in enumerate(("_own", "_edited"))))
    rows = pairs.select("range", "place", F.col("id").alias("_id"), "next_range", "next_place", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), plain(F.col("text")).alias("_plain"), plain(F.col("edited")).alias("_plain_edited"))
    rows = rows.join(both, ["range", "place"], "left").withColumn("fingerprint", F.coalesce("_own", "_plain")).withColumn("edited_fingerprint", F.coalesce("_edited", "_plain_edited"))
    rows = checkpoint(rows.drop("_own", "_edited", "_plain", "_plain_edited"))
    nexts = rows.select(F.col("range").alias("next_range"), F.col("place").alias("next_place"), F.col("fingerprint").alias("_next"))
    out = rows.join(nexts, ["next_range", "next_place"])
    own = F.col("fingerprint")
    return out.select(F.col("_id").alias(doc_id), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(own, F.col("edited_fingerprint")).alias("near_edited"), likeness(own, F.col("_next")).alias("near_next"))
