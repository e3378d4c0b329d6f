"""Document fingerprints by SpotSigs, in DataFrame functions only.

Words are lower-cased runs of letters and digits. Common words (``ANCHORS``) are spots: each
spot with the next ``CHAIN`` content words (words that are no anchors) within ``REACH`` words
forms a signature, hashed to 32 bits. A text's fingerprint is the set of its signatures, as
sorted hexadecimal text, 8 digits each. Anchors without a content word in reach give none. In
a text of fewer than ``FEW`` signatures every word is a spot, so that short texts compare
too; one without words has one signature for the whole of it.

Two fingerprints are compared by Jaccard similarity, pruned by set length: sets fall into
classes by the logarithm of their length, and sets whose classes lie so far apart that the
similarity cannot reach ``FLOOR`` are not compared at all (0).

``with_next`` puts the next document, by ascending id, beside each one without a global
sort: ids are cut into ranges of ``RANGE``, and each range gets the first document of the
range that follows as a guest.

Defined cases: null texts count as empty; empty texts have the empty fingerprint, like only
each other; rows of one id follow each other by hash of their text, rows without an id come
last; a single row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from potluck.llm.common import doc_input

# Common words of English, French, German and Spanish: fixed values, a parameter.
ANCHORS = [
    "the", "a", "an", "of", "to", "in", "and", "is", "was", "are", "be", "that", "it", "for", "on", "with", "as",
    "by", "at", "this", "or", "from",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "est", "en", "que", "qui", "dans", "pour", "sur", "par",
    "pas", "avec", "il", "au",
    "der", "die", "das", "den", "dem", "ein", "eine", "und", "ist", "zu", "von", "mit", "auf", "sich", "nicht",
    "el", "los", "las", "del", "una", "y", "es", "por", "para", "con", "se", "no", "al", "lo", "su",
]
CHAIN = 2
REACH = 6
FEW = 4
FLOOR = 0.05
RANGE = 1024                 # ids; a power of two
BROADCAST_ROWS = 200_000     # first documents of ranges broadcast at most


def with_signatures(df: DataFrame, text: str, out: str, anchors: list[str] | None = None) -> DataFrame:
    """``df`` with the sorted signature set of column ``text`` in column ``out``."""
    anchors = sorted(set(ANCHORS if anchors is None else anchors))
    w, spots, found = f"{out}_w", f"{out}_spots", f"{out}_found"

    def signature(i: Column) -> Column:
        chain = F.filter(F.slice(F.col(w), i + 2, F.lit(REACH)), lambda x: ~x.isin(anchors))
        return F.when(F.size(chain) > 0, F.hash(F.get(F.col(w), i), F.slice(chain, 1, CHAIN)))

    def every(i: Column) -> Column:
        chain = F.filter(F.slice(F.col(w), i + 2, F.lit(REACH)), lambda x: ~x.isin(anchors))
        return F.hash(F.get(F.col(w), i), F.slice(chain, 1, CHAIN))

    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    return (df.withColumn(w, F.filter(F.split(lowered, r"[^\p{L}\p{N}]+"), lambda x: x != ""))
            .withColumn(spots, F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: F.get(F.col(w), i).isin(anchors)))
            .withColumn(found, F.array_compact(F.transform(F.col(spots), signature)))
            .withColumn(found, F.when(F.size(found) >= FEW, F.col(found)).when(
                F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1), every)))
            .withColumn(out, F.when(F.size(found) > 0, F.sort_array(F.array_distinct(found)))
                        .when(F.coalesce(F.col(text), F.lit("")) != "", F.array(F.hash(F.col(text))))
                        .otherwise(F.array().cast("array<int>")))
            .drop(w, spots, found))


def fingerprint(signatures: str) -> Column:
    """The set as text: 8 hexadecimal digits for each signature, in order."""
    return F.array_join(F.transform(F.col(signatures), lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def length_class(signatures: str) -> Column:
    """Class of a set by its length; classes k apart differ in length by 2**(k-1) at least."""
    return F.floor(F.log2(F.greatest(F.size(signatures), F.lit(1)).cast("double")))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets; 0 where their lengths rule out ``FLOOR``."""
    shared = F.size(F.array_intersect(a, b))
    far = F.abs(length_class(a) - length_class(b)) > 1 + math.ceil(math.log2(1 / FLOOR))
    one_empty = (F.size(a) == 0) != (F.size(b) == 0)
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when(far | one_empty, F.lit(0.0))
            .otherwise(shared / (F.size(a) + F.size(b) - shared)))


def with_next(docs: DataFrame, columns: list[str], prepare=lambda df: df) -> DataFrame:
    """``docs`` (doc_id, text) after ``prepare``, with ``next``: a struct of the ``columns`` of
    the document that follows by id; after the last, of the first."""
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    range_of = F.call_function("shiftright", "doc_id", F.lit(RANGE.bit_length() - 1))
    rows = docs.withColumn("tie", tie).withColumn(
        "rng", F.coalesce(range_of, F.lit(2**62)))
    place = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc_id"), F.col("tie").alias("tie"))
    firsts = rows.groupBy("rng").agg(F.min(place).alias("place"))
    # one row per RANGE documents; the last range is followed by the first
    order = Window.orderBy("rng")
    wrap = F.first("place").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    guests = firsts.select(F.col("rng").alias("to"), F.coalesce(F.lead("place").over(order), wrap).alias("of")) \
        .select("to", F.col("of.doc_id").alias("of_id"), F.col("of.tie").alias("of_tie"))
    if docs.select(F.countDistinct(range_of)).first()[0] <= BROADCAST_ROWS:
        guests = F.broadcast(guests)
    added = (rows.join(guests, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("tie") == F.col("of_tie")))
             .withColumn("rng", F.col("to")).drop("to", "of_id", "of_tie")
             .dropDuplicates(["rng"]).withColumn("guest", F.lit(True)))
    both = prepare(rows.withColumn("guest", F.lit(False)).unionByName(added))
    within = Window.partitionBy("rng").orderBy("guest", F.col("doc_id").isNull(), "doc_id", "tie")
    # plain columns: a struct would be built, and shuffled, beside the columns themselves
    follow = F.struct(*[F.lead(c).over(within).alias(c) for c in columns])
    return (both.withColumn("next", follow)
            .where(~F.col("guest")).drop("guest", "rng", "tie"))


def spotsigs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, signature set, fingerprint; then the text with
    its last half replaced by the beginning of the next document: edited, its fingerprint,
    and the likeness to it and to the next document."""
    rows = doc_input(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    beside = with_next(rows, ["text", "sigs"], lambda df: with_signatures(df, "text", "sigs"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = beside.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half),
        F.substring(F.col("next.text"), F.lit(1), half)))
    edited = edited.withColumn("next_sigs", F.col("next.sigs"))
    done = with_signatures(edited, "edited", "edited_sigs")
    return done.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sigs", "edited",
                       F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint("sigs").alias("fingerprint"),
                       fingerprint("edited_sigs").alias("edited_fingerprint"),
                       likeness("sigs", "edited_sigs").alias("near_edited"),
                       likeness("sigs", "next_sigs").alias("near_next"))
