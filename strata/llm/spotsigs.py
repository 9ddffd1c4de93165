"""SpotSigs document fingerprints, with DataFrame functions only.

Text is lower-cased and reduced to letters and digits. Wherever one of the common words of
``ANCHORS`` stands, it and the next two content words (words that are no anchors) form a spot
signature, hashed to 48 bits; the fingerprint is the set of a text's signatures. Common words
stand all over natural text, so the set follows its wording closely and ignores case,
punctuation and layout. Where text has none (lists, repeated words), each word without an
anchor among the eight words from it on is a signature of its own; a text that has neither is
fingerprinted by its single words.

Two fingerprints are compared by Jaccard similarity. ``similar_pairs`` finds all pairs at a
threshold: texts of equal fingerprints are one class; classes are partitioned by set length so
that partners stand in the same or the next partition; within it only sets that share one of
their few rarest signatures meet (a pair at the threshold must), their lengths must be within
the threshold of each other, and what is left is compared exactly.

Neighbours in id order come from one shuffle of the texts into ranges of ids (boundaries from
approximate percentiles, any of which are right); each range also gets the first row of the
next one, so no window spans all rows.

Defined cases: null texts count as empty; empty texts have an empty fingerprint, of likeness 1
to another empty one and 0 to any other; equal texts have equal fingerprints; rows with equal
ids follow each other in text order; null ids come first; the only row of a table is its own
next; an empty table gives no row. A run of more than eight anchors counts the ninth as a
content word. Only ``doc_id`` and ``text`` are read, so extra columns cannot clash.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm import common

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the", "is", "of", "and", "to", "was", "that", "with", "for", "by",
    "le", "les", "des", "est", "et", "un", "pour", "sur", "que", "qui",
    "der", "die", "das", "und", "ist", "den", "ein", "von", "mit", "zu",
    "el", "los", "las", "una", "por", "con", "del", "su", "se", "de",
)
CHAIN = 2
GAP = 8
THRESHOLD = 0.8
ROWS_PER_RANGE = 4000
MAX_RANGES = 10_000


def _anchor_pattern(anchors=ANCHORS) -> str:
    """An anchor as a whole word, by first letters: few alternatives are tried at a word."""
    by_letter: dict[str, list[str]] = {}
    for word in anchors:
        by_letter.setdefault(word[0], []).append(word[1:])
    return rf"(?<![^ ])({'|'.join(f'{c}(?:{'|'.join(rest)})' for c, rest in by_letter.items())})(?= )"


#: Stands before every anchor once anchors are marked; normalised text holds no such character.
_MARK = "\x01"


def _pattern(chain: int = CHAIN) -> str:
    """Zero-width at a word of marked text; group 1 is an anchor, the anchors skipped and ``chain``
    content words, or a word with no anchor among the ``GAP`` words from it on."""
    anchor, content = f"{_MARK}[^ ]+ ", f"[^{_MARK} ][^ ]* "
    spot = anchor + rf"(?:{anchor}){{0,8}}+[^ ]+ " * chain
    return rf"(?<![^ ])(?=({spot}|(?!(?:{content}){{0,{GAP - 1}}}+{_MARK}){content}))"


def normalised(text: Column) -> Column:
    return F.concat(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def with_signatures(df: DataFrame, text: str, out: str, anchors=ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted distinct 48-bit signatures of a text column.

    In steps, so that each of the costly pattern passes over a text runs once.
    """
    plain, found, parts = (f"__strata_{x}" for x in ("plain", "found", "parts"))
    marked = F.regexp_replace(F.col(plain), _anchor_pattern(anchors), f"{_MARK}$1")
    # Anchors inside a chain were skipped; only the one that starts it belongs to the signature.
    bare = F.regexp_replace(F.col(found), rf"(?<= ){_MARK}[^ ]+ (?!\n|$)", "")
    words = F.replace(F.rtrim(F.col(plain)), F.lit(" "), F.lit("\n"))
    none = F.array().cast("array<string>")
    steps = (
        (plain, normalised(F.col(text))),
        (found, F.array_join(F.regexp_extract_all(marked, F.lit(_pattern(chain)), F.lit(1)), "\n")),
        (parts, F.when(F.col(plain) == " ", none).otherwise(F.split(F.when(F.col(found) != "", bare).otherwise(words), "\n"))),
        (out, F.sort_array(F.array_distinct(F.transform(parts, lambda s: F.xxhash64(s).bitwiseAND(F.lit((1 << 48) - 1)))))),
    )
    for name, column in steps:
        df = df.withColumn(name, column)
    return df.drop(plain, found, parts)


def fingerprint(signature_set: Column) -> Column:
    return F.array_join(signature_set.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; of two empty ones 1."""
    both = F.size(F.array_intersect(a, b))
    apart = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when(apart, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _ranges(docs: DataFrame) -> tuple[Column, list]:
    """Range number of a doc_id, and per non-empty range its first id, ascending."""
    n = docs.count()
    k = max(1, min(MAX_RANGES, math.ceil(n / ROWS_PER_RANGE)))
    bounds = []
    if k > 1:
        shares = F.array(*[F.lit(i / k) for i in range(1, k)])
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 2 * k))).alias("b")).first()["b"] or []))
    number = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    # At most MAX_RANGES rows of two numbers.
    firsts = docs.select(number.alias("range"), "doc_id").groupBy("range").agg(F.min(F.struct("doc_id")).alias("first")).orderBy("range").collect()
    return number, [(r["range"], r["first"]["doc_id"]) for r in firsts]


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """``docs`` (doc_id, text, carried columns) with ``next_<column>`` of the row that follows in id order."""
    columns = ("text", *carried)
    number, firsts = _ranges(docs.select("doc_id"))
    if not firsts:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    placed = docs.withColumns({"range": number, "guest": F.lit(0)})
    previous = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    # The first rows of each range visit the range before it; those of the first range visit the last.
    ids = [i for i in previous if i is not None]
    is_first = F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if None in previous else F.lit(False))
    to = F.create_map(*[F.lit(x) for i in ids for x in (i, previous[i])])[F.col("doc_id")] if ids else F.lit(None)
    if None in previous:
        to = F.when(F.col("doc_id").isNull(), previous[None]).otherwise(to)
    guests = docs.where(is_first).withColumns({"range": to.cast("int"), "guest": F.lit(1)})
    order = Window.partitionBy("range").orderBy("guest", "doc_id", "text")
    following = placed.unionByName(guests).select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return following.where("guest = 0").drop("range", "guest")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_signatures(docs, "text", "set"), "set")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "set", "next_set", edited.alias("edited"))
    rows = with_signatures(rows, "edited", "edited_set")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("set")).alias("fingerprint"), fingerprint(F.col("edited_set")).alias("edited_fingerprint"),
        likeness(F.col("set"), F.col("edited_set")).alias("near_edited"), likeness(F.col("set"), F.col("next_set")).alias("near_next"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id) of every row with a signature, and (class_id, set) of every class.

    A class holds the rows of equal fingerprints; its id is the smallest doc_id.
    """
    rows = with_signatures(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), "text", "set").where(F.size("set") > 0)
    rows = rows.withColumn("key", F.sha2(fingerprint(F.col("set")).cast("binary"), 256))
    named = rows.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("set").alias("set"))
    return rows.select("doc_id", "key").join(named.select("key", "class_id"), "key").select("doc_id", "class_id"), named.select("class_id", "set")


def similar_pairs(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of all classes a < b whose sets reach the Jaccard ``threshold``."""
    # Rare signatures first: the few that partners must share are seldom common ones.
    cells = sets.select("class_id", F.size("set").alias("n"), F.explode("set").alias("signature"))
    times = cells.groupBy("signature").agg(F.count("*").alias("times"))
    ranked = cells.join(times, "signature").groupBy("class_id", "n").agg(F.sort_array(F.collect_list(F.struct("times", "signature"))).alias("ranked"))
    # Lengths within the threshold of each other fall into the same or neighbouring partitions.
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold))).cast("int")
    first = F.slice(F.col("ranked.signature"), F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    entries = ranked.select("class_id", "n", part.alias("part"), F.explode(first).alias("signature"))
    left = entries.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    pairs = (left.alias("l").join(entries.alias("r"), ["part", "signature"])
             .where((F.col("l.class_id") != F.col("r.class_id")) & (F.col("l.n") <= F.col("r.n")) & (F.col("l.n") >= F.col("r.n") * F.lit(threshold) - 1e-9))
             .select(F.least("l.class_id", "r.class_id").alias("a"), F.greatest("l.class_id", "r.class_id").alias("b")).distinct())
    side = lambda x: sets.select(F.col("class_id").alias(x), F.col("set").alias(f"set_{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .select("a", "b", likeness(F.col("set_a"), F.col("set_b")).alias("similarity")).where(F.col("similarity") >= threshold))
