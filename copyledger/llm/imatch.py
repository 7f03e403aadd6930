"""Document fingerprints by I-Match: terms of a middle document frequency,
sorted and hashed under several randomised lexicon subsets. DataFrame functions
only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from copyledger.llm.common import read_table, settled

LEAST_SHARE, MOST_SHARE = 0.001, 0.2
# Slots of the broadcast lexicon; a slot holds a few terms.
SLOTS = 65_536
# Subset 0 is the whole lexicon; the others keep a quarter down to a 256th, so
# that for short and long texts some hold a term or two. A term belongs to a
# subset if these bits of its two further hashes are all zero.
SUBSETS = 16
_BITS = [0] + [2 + r % 7 for r in range(1, SUBSETS)]
_SEPARATORS = r"[^\p{L}\p{N}]+"


def term_hashes(text: Column) -> Column:
    """Distinct terms (runs of letters and digits, lower case) as 64-bit hashes."""
    words = F.filter(F.split(F.lower(text), _SEPARATORS), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(term): terms in at least ``least`` and at most ``most`` of all rows of
    ``docs`` (text).

    It never has more than (distinct terms of an average document) / ``least``
    rows, whatever the number of documents: each takes up that share of them.
    """
    total = docs.count()
    terms = docs.select(F.explode(term_hashes(F.col("text"))).alias("term"))
    frequencies = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return frequencies.where((F.col("df") >= least * total) & (F.col("df") <= max(most * total, 1))).select("term")


def lexicon_slots(terms: DataFrame) -> DataFrame:
    """One row with the lexicon as an array of SLOTS arrays: a term lies in the slot
    of its remainder, so that looking one up does not search the lexicon."""
    filled = terms.groupBy(F.pmod("term", F.lit(SLOTS)).alias("slot")).agg(F.collect_list("term").alias("terms"))
    every = terms.sparkSession.range(SLOTS).select(F.col("id").alias("slot"))
    none = F.array().cast("array<bigint>")
    rows = every.join(filled, "slot", "left").select("slot", F.coalesce("terms", none).alias("terms"))
    ordered = F.sort_array(F.collect_list(F.struct("slot", "terms")))
    return rows.agg(F.transform(ordered, lambda s: s["terms"]).alias("slots"))


def band_terms(text: Column, slots: Column) -> Column:
    """Sorted distinct terms of ``text`` that are in the lexicon."""

    def known(term: Column) -> Column:
        return F.array_contains(F.get(slots, F.pmod(term, F.lit(SLOTS)).cast("int")), term)

    return F.sort_array(F.filter(term_hashes(text), known))


def subset_hashes(terms: Column) -> Column:
    """One hash per subset over its sorted terms; '-' for none."""
    draws = F.transform(
        terms,
        lambda t: F.struct(t.alias("t"), F.xxhash64(t, F.lit(1)).alias("x"), F.xxhash64(t, F.lit(2)).alias("y")),
    )

    def digits(chosen: Column) -> Column:
        wide = F.lpad(F.hex(F.xxhash64(F.transform(chosen, lambda s: s["t"]))), 16, "0")
        return F.when(F.size(chosen) == 0, F.lit("-")).otherwise(F.lower(F.substring(wide, 1, 8)))

    def zero(name: str, mask: int):
        return lambda s: s[name].bitwiseAND(F.lit(mask)) == 0

    subsets, used = [draws], {"x": 0, "y": 0}
    for bits in _BITS[1:]:
        name = "x" if used["x"] + bits <= 62 else "y"
        subsets.append(F.filter(F.col("_draws"), zero(name, (2**bits - 1) << used[name])))
        used[name] += bits
    return draws, F.transform(F.array(F.col("_draws"), *subsets[1:]), digits)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that are not empty in both; 1 for
    equal fingerprints."""
    either = F.zip_with(a, b, lambda x, y: F.when((x == "-") & (y == "-"), 0).when(x == y, 1).otherwise(-1))
    equal = F.size(F.filter(either, lambda v: v == 1))
    counted = F.size(F.filter(either, lambda v: v != 0))
    return F.when(counted == 0, F.lit(1.0)).otherwise(equal / counted)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with their place in falling doc_id order: ``o`` rises as doc_id falls
    (null last), ``k`` orders rows of one doc_id."""
    text = F.coalesce("text", F.lit(""))
    order = F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit(2**63 - 1))
    return docs.select("doc_id", text.alias("text"), order.alias("o"), F.xxhash64(text).alias("k"))


def ring(rows: DataFrame) -> DataFrame:
    """Distinct (o, k) of keyed rows with doc_id, copies, n (code points), the next
    in order (next_o, next_k) and the previous with its length (prev_o, prev_k,
    prev_n); the last is followed by the first.

    Keys are ranged over tasks and settled; neighbours across a border come from
    the first and last key of each range, one row per task.
    """
    ids = rows.groupBy("o", "k", "doc_id").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("n"))
    placed = settled(ids.repartitionByRange("o", "k").withColumn("part", F.spark_partition_id()))
    here = F.struct("o", "k", "n")
    inside = W.partitionBy("part").orderBy("o", "k")
    ends = placed.groupBy("part").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    parts = W.orderBy("part")
    whole = parts.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    borders = ends.select(
        "part",
        F.coalesce(F.lead("first").over(parts), F.first("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(parts), F.last("last").over(whole)).alias("before"),
    )
    return (
        placed.withColumn("next", F.lead(here).over(inside))
        .withColumn("prev", F.lag(here).over(inside))
        .join(F.broadcast(borders), "part")
        .withColumn("next", F.coalesce("next", "after"))
        .withColumn("prev", F.coalesce("prev", "before"))
        .select(
            "o", "k", "doc_id", "copies", "n",
            F.col("next.o").alias("next_o"), F.col("next.k").alias("next_k"),
            F.col("prev.o").alias("prev_o"), F.col("prev.k").alias("prev_k"), F.col("prev.n").alias("prev_n"),
        )
    )


def with_fingerprint(rows: DataFrame, text: str, slots: Column, name: str) -> DataFrame:
    """``rows`` with the subset hashes of a text column as array ``name``. The
    lexicon column is used once, so that it is not copied into the rows."""
    draws, hashes = subset_hashes(F.col("_band"))
    banded = rows.withColumn("_slots", slots).withColumn("_band", band_terms(F.col(text), F.col("_slots"))).drop("_slots")
    return banded.withColumn("_draws", draws).withColumn(name, hashes).drop("_band", "_draws")


def edited_fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text) and of their edited texts: the last
    half of the code points replaced by as many from the start of the next
    document in falling doc_id order (all of it where shorter; after the last
    comes the first).

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The lexicon goes to all tasks; see its bound there.

    Null text counts as empty; an empty set of terms gives a fingerprint of
    dashes. A null doc_id comes last in order. Rows of one doc_id follow each
    other by text; repeated rows share one place and each returns its row. Other
    columns are ignored.
    """
    rows = _keyed(docs)
    terms = settled(lexicon(rows, least, most))
    order = settled(ring(rows))
    placed = rows.select("o", "k", "text").join(order.select("o", "k", "n", "prev_o", "prev_k", "prev_n"), ["o", "k"])
    half = F.floor(F.col("n") / 2).cast("int")
    heads = F.expr("substring(text, 1, n - cast(floor(n / 2) as int))")
    tails = placed.select(
        F.col("prev_o").alias("o"), F.col("prev_k").alias("k"), F.expr("substring(text, 1, cast(floor(prev_n / 2) as int))").alias("tail")
    )
    own = placed.select("o", "k", "text", heads.alias("head"), half.alias("half"))
    edited = own.join(tails, ["o", "k"]).select("o", "k", "text", F.concat("head", "tail").alias("edited"))
    slots = lexicon_slots(terms).scalar()
    hashed = edited.select("o", "k", "text", "edited", F.sha2("edited", 256).alias("sha"))
    for text in ("text", "edited"):
        hashed = with_fingerprint(hashed, text, slots, f"{text}_fp")
    made = settled(hashed.select("o", "k", "sha", "text_fp", "edited_fp").dropDuplicates(["o", "k"]))
    following = made.select(F.col("o").alias("next_o"), F.col("k").alias("next_k"), F.col("text_fp").alias("next_fp"))
    full = order.select("o", "k", "doc_id", "copies", "n", "next_o", "next_k").join(made, ["o", "k"]).join(
        following, ["next_o", "next_k"]
    )
    return full.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        F.array_join("text_fp", " ").alias("fingerprint"),
        F.array_join("edited_fp", " ").alias("edited_fingerprint"),
        likeness(F.col("text_fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("text_fp"), F.col("next_fp")).alias("near_next"),
    )


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))
