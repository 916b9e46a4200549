"""I-Match fingerprints of documents, with DataFrame functions only.

Method: document frequencies of all terms are counted over all documents.  The lexicon keeps
the terms within an inverse-document-frequency band: those in more than one document, and in no more than a
share ``COMMON`` of them; its size has no bound.  It is never sent anywhere whole.  A text's own terms lie
below the band only if too common (such terms are few at any size: at most the mean number of a text's terms
divided by ``COMMON``) and above it only if in no other document; the count remembers that document, which gets
a list of them.  Terms that arise where an edited text is cut are looked up by a join on the term's hash.
A text's distinct lexicon terms are sorted and hashed once per randomised sub-lexicon.
Sub-lexicons keep from a half down to 1/256 of the terms, so that long and short texts both
have some that hold a few of their terms.  Likeness is the share of sub-lexicons, among those that
hold a term of either text, whose hashes agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import GROUP_ROWS
from tabulon.session import stored

COMMON = 0.05  # share of documents above which a term is too common
LEVELS, PER_LEVEL = 8, 4  # sub-lexicons keep 1/2, 1/4, ... of the terms
FIRST = -(1 << 63)  # stands for a null id: it comes first


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct lower-case runs of letters and digits."""
    found = F.split(F.lower(text), "[^\\p{L}\\p{N}]+")
    return F.array_remove(F.array_distinct(F.transform(found, lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def frequencies(base: DataFrame) -> DataFrame:
    """(term, df, k, h): the number of rows that hold each term and, where it is one, that row's id and text hash."""
    held = base.select("k", "h", F.explode(terms(F.col("text"))).alias("term"))
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("k").alias("k"), F.min("h").alias("h"))


def sub_hashes(listed: Column, fallback: Column) -> Column:
    """32-bit hashes of the sorted terms in each sub-lexicon (null: none); of ``fallback`` if no term is in the lexicon."""
    def within(found: Column, k: int) -> Column:
        return F.filter(found, lambda t: F.xxhash64(t, F.lit(k)).bitwiseAND(F.lit((2 << k // PER_LEVEL) - 1)) == 0)

    def hashes(found: Column) -> Column:
        each = F.array(*[F.xxhash64(within(found, k)) for k in range(LEVELS * PER_LEVEL)])
        return F.transform(each, lambda h: F.when(h != 42, h))  # the hash of an empty array is its seed

    # the lambda binds the sorted terms, which would otherwise be sorted anew for every sub-lexicon
    bound = F.transform(F.array(F.sort_array(listed)), hashes)[0]
    numbers = F.sequence(F.lit(0), F.lit(LEVELS * PER_LEVEL - 1))
    long_hashes = F.when(F.size(listed) > 0, bound).otherwise(F.transform(numbers, lambda k: F.xxhash64(fallback, k)))
    return F.transform(long_hashes, lambda h: F.shiftright(h, 32).cast("int"))


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes among the sub-lexicons that hold a term of either text."""
    numbers = f"sequence(0, {LEVELS * PER_LEVEL - 1})"
    return F.expr(f"""cast(size(filter({numbers}, k -> {a}[k] = {b}[k])) as double)
        / greatest(1, size(filter({numbers}, k -> {a}[k] is not null or {b}[k] is not null)))""")


def as_text(name: str) -> Column:
    """Eight hex digits per sub-lexicon; zeros where it holds no term."""
    return F.lower(F.concat_ws("", F.transform(name, lambda h: F.lpad(F.hex(
        F.coalesce(h.cast("long"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"))))


def successors(docs: DataFrame) -> DataFrame:
    """(k, next): each id's next larger one (the last one's is the first).

    Ids are sorted by range; only one row per range meets in the window that joins the ranges.
    """
    ids = docs.select("k").distinct()
    n = docs.count()
    ranged = stored(ids.repartitionByRange(max(1, -(-n // GROUP_ROWS)), "k").withColumn("part", F.spark_partition_id()))
    firsts = ranged.groupBy("part").agg(F.min("k").alias("first"))
    after = firsts.selectExpr("part", "coalesce(lead(first) over (order by first), min(first) over ()) as later")
    inside = ranged.selectExpr("k", "part", "lead(k) over (partition by part order by k) as inner")
    return inside.join(after, "part").select("k", F.coalesce("inner", "later").alias("next"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text replaces the last half of the characters (rounded down) by the
    first as many (or all) of the next document.  Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.  Null texts count as empty, a
    null id comes first, repeated rows (same id and text) give one row; of different texts
    with one id, the one with the smallest hash counts as the next document.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("k"), text.alias("text"), F.xxhash64(text).alias("h"),
                       F.char_length(text).cast("long").alias("n_chars"))
    counted = stored(frequencies(base))
    most = max(2.0, COMMON * docs.count())
    common = F.broadcast(counted.where(F.col("df") > most).agg(F.collect_list("term").alias("common")))
    rare = counted.where("df = 1").groupBy("k", "h").agg(F.collect_list("term").alias("rare"))
    keyed = stored(base.select("k", "h", "n_chars").distinct())
    order = successors(keyed)
    none = F.array().cast("array<long>")
    known = stored(keyed.join(order, "k").join(rare, ["k", "h"], "left").select(
        "k", "h", "n_chars", "next", F.coalesce("rare", none).alias("rare")))
    first = keyed.groupBy("k").agg(F.min("h").alias("h"))
    # which text each one is followed by; the joins with texts below read one shuffle of them,
    # which works only while all use all columns of ``base``
    takers = known.select(F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.expr("n_chars div 2").alias("need"),
                          F.col("next").alias("k")).join(first, "k").join(known.select("k", "h", "rare"), ["k", "h"])
    heads = base.join(takers, ["k", "h"]).select(
        F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.col("rare").alias("next_rare"),
        F.expr("substring(text, 1, int(least(need, n_chars)))").alias("head"), terms(F.col("text")).alias("whole")).select(
        "k", "h", "next_rare", "head", F.array_except(terms(F.col("head")), "whole").alias("cut"))
    edited = base.join(heads, ["k", "h"]).select("k", "h", "n_chars", "next_rare", terms(F.col("text")).alias("own"), F.expr(
        "concat(substring(text, 1, int(n_chars - n_chars div 2)), substring(head, 1, int(n_chars div 2)))").alias("edited"),
        F.array_except(terms(F.col("head")), "cut").alias("taken"))
    edited = edited.select("k", "h", "n_chars", "next_rare", "own", "edited", "taken", terms(F.col("edited")).alias("t"))
    # terms of neither text: those of words that were cut or joined
    unknown = F.array_except("t", F.concat("own", "taken", "next_rare"))
    band = counted.where((F.col("df") >= 2) & (F.col("df") <= most)).select("term")
    more = edited.select("k", "h", F.explode(unknown).alias("term")).join(band, "term", "left_semi").groupBy("k", "h").agg(
        F.collect_set("term").alias("more"))
    both = edited.join(known.select("k", "h", "next", "rare"), ["k", "h"]).join(more, ["k", "h"], "left").crossJoin(common)
    listed = F.array_except("own", F.concat("common", "rare"))
    changed = F.concat(
        F.array_except("t", F.concat("common", "rare", "next_rare", unknown)), F.coalesce("more", none))
    printed = stored(both.select(
        "k", "h", "next", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.xxhash64("edited").alias("fallback"), listed.alias("listed"), changed.alias("changed")).select(
        "k", "h", "next", "n_chars", "edited_sha256", sub_hashes(F.col("listed"), F.col("h")).alias("hashes"),
        sub_hashes(F.col("changed"), F.col("fallback")).alias("edited_hashes")).groupBy("k", "h").agg(
        *[F.first(c).alias(c) for c in ("next", "n_chars", "edited_sha256", "hashes", "edited_hashes")]))
    following = printed.groupBy("k").agg(F.min_by("hashes", "h").alias("next_hashes"))
    joined = printed.join(following.withColumnRenamed("k", "next"), "next")
    return joined.select(
        F.when(F.col("k") != FIRST, F.col("k")).alias("doc_id"), "n_chars", "edited_sha256", as_text("hashes").alias("fingerprint"),
        as_text("edited_hashes").alias("edited_fingerprint"), likeness("hashes", "edited_hashes").alias("near_edited"),
        likeness("hashes", "next_hashes").alias("near_next"))
