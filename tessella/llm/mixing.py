"""Mixing sources to target weights: capped water-filling, then whole and fractional seeded repetitions.

Targets: the words to take in all are shared among the sources by weight; a source whose share is above its cap
(most_epochs times its size) is clamped to it, what it can't take is shared again by weight among the others, and so on
until no share is above its cap. Each round is one aggregate over one row a source; the clamped set only grows, so it
ends. What is left to share and the weights that share it are whole numbers, so a target is one product and one quotient.

Sampling: a source repeats each document floor(target / size) times, and the documents that come first in the order of
a seeded hash once more, up to the fraction that is left, so that a source ends within half a document of its target.
The hash order is never sorted as a whole: sizes are summed a source and hash bucket (combined before the shuffle),
the bucket where the fraction ends is found, and only its documents are ordered. What comes of it is one threshold a
source, which every document compares with its own hash: no document is moved but by the join with the small table of
sources, broadcast when it has at most FEW rows and otherwise a shuffled join that AQE splits where a source is hot.

Only DataFrame functions are used.

Defined cases: null or empty text has size 0 and is taken 0 times over; sources of size 0 have target 0; the null
source is a source, last in order; repeated rows stand beside each other in hash order and are taken alike; rows with
equal ids are told apart by size; an empty table gives none; other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._shared import reliable

WORD = r"[^\x20\x09-\x0D]+"
#: Most sources that are broadcast: a row of them is under 200 bytes and a name.
FEW = 10_000
#: Hash buckets a source: four hexadecimal digits of the md5 of seed and id.
DIGITS = 4


def size_of(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(names: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """names (one column source, distinct) with a weight: the weights again and again, by code point, null last.

    Ranked without bringing all names into one task: sorted within ranges, and the counts of the ranges, a few rows,
    summed up.
    """
    parts = max(1, min(64, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    laid = reliable(names.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    counts = laid.groupBy("part").agg(F.count("*").alias("n"))  # as many rows as ranges
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    place = F.pmod(F.row_number().over(inside) - 1 + F.col("before"), F.lit(len(weights)))
    ranked = laid.join(F.broadcast(before), "part")
    return ranked.select("source", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long").alias("weight"))


def water_fill(sources: DataFrame, total: int | None = None, most_epochs: int = 3) -> DataFrame:
    """sources (source, size, weight) with target double; total None: the sum of the sizes.

    Sources without words or weight get 0. If total is above all caps, each source has its cap.
    """
    able = (F.col("size") > 0) & (F.col("weight") > 0)
    cap = (F.col("size") * F.lit(most_epochs)).cast("decimal(19,0)")
    all_words, rest_weight = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(able, F.col("weight"))), F.lit(0))).first()
    left = all_words if total is None else total
    rest, clamped, clamps = left, 0, F.lit(False)
    weight_all = rest_weight
    while True:
        over = F.lit(False) if rest_weight <= 0 else able & (cap * F.lit(rest_weight).cast("decimal(19,0)") < F.col("weight").cast("decimal(19,0)") * F.lit(rest).cast("decimal(19,0)"))
        clamps = clamps | over
        n, words, weight = sources.where(clamps).agg(F.count("*"), F.coalesce(F.sum(F.col("size") * most_epochs), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == clamped:
            break
        clamped, rest, rest_weight = n, left - words, weight_all - weight
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(max(rest_weight, 1)))
    return sources.withColumn("target", F.when(~able, F.lit(0.0)).when(clamps, (F.col("size") * most_epochs).cast("double")).otherwise(share))


def _key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(seed), doc_id.cast("string")).cast("binary"))


def plan(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, most_epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a source: source, source_size, weight, target, whole repetitions, and the threshold of the fractional one.

    weights: (source, weight); None for 5, 2, 1, repeating.
    """
    sized = reliable(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), size_of(F.col(text_col)).alias("size")).withColumn("key", _key(F.col("id"), seed)))
    sums = reliable(sized.groupBy("source").agg(F.sum("size").alias("size")))
    weights = cyclic_weights(sums.select("source")) if weights is None else weights
    w = weights.select(F.col("source").alias("named"), F.col("weight").cast("long").alias("weight"))
    filled = water_fill(reliable(sums.join(w, sums.source.eqNullSafe(w.named)).select("source", "size", "weight")), total, most_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    epochs = reliable(filled.withColumn("whole", whole).withColumn("wanted", F.when(F.col("size") > 0, F.col("target") - F.col("whole") * F.col("size")).otherwise(0.0)))
    # the bucket of the hash order in which the fraction ends
    bucket = F.substring("key", 1, DIGITS)
    by_bucket = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))  # at most 16 ** DIGITS rows a source
    e = epochs.select(F.col("source").alias("named"), "wanted")
    sums_upto = by_bucket.withColumn("upto", upto)
    reach = _with_sources(sums_upto, e, "wanted")
    ends = reliable(reach.where((F.col("upto") > F.col("wanted")) & (F.col("upto") - F.col("words") <= F.col("wanted"))).select("source", "bucket", (F.col("upto") - F.col("words")).alias("before"), "wanted"))
    inside = sized.select(F.col("source").alias("own"), "id", "size", "key", bucket.alias("place"))
    near = inside.join(ends, inside.own.eqNullSafe(ends.source) & (inside.place == ends.bucket))
    order = Window.partitionBy("source").orderBy("key", "id", "size")
    summed = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    taken = near.withColumn("summed", summed).where((F.col("size") > 0) & (F.col("summed") - F.col("size") / 2 <= F.col("wanted")))
    last = taken.groupBy("source", "bucket").agg(F.max(F.struct("key", "id", "size")).alias("last"))
    known = ends.select("source", "bucket").join(last.select(F.col("source").alias("s2"), "last"), F.col("source").eqNullSafe(F.col("s2")), "left").select(F.col("source").alias("named"), "bucket", "last")
    all_sources = epochs.select("source", F.col("size").alias("source_size"), "weight", "target", "whole", "wanted")
    return reliable(all_sources.join(known, all_sources.source.eqNullSafe(known.named), "left").drop("named"))


def _with_sources(rows: DataFrame, sources: DataFrame, *columns: str) -> DataFrame:
    """rows (with source) joined with sources (named, ...): broadcast only if counted and few."""
    few = sources.limit(FEW + 1).count() <= FEW
    kept = sources.select("named", *columns)
    return rows.join(F.broadcast(kept) if few else kept, rows.source.eqNullSafe(kept.named)).drop("named")


def mix(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, most_epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs and three struct fields in mix_: size, source_size and target of the row, and copies, how often the mix takes it."""
    sources = plan(docs, weights, total, most_epochs, seed, id_col, text_col, source_col)
    held = ["source", "source_size", "target", "whole", "bucket", "last"]
    s = sources.select(*[F.col(c).alias(f"_mix_{c}") for c in held])
    if sources.limit(FEW + 1).count() <= FEW:
        s = F.broadcast(s)
    d = docs.withColumn("_mix_size", size_of(F.col(text_col))).withColumn("_mix_key", _key(F.col(id_col), seed))
    met = d.join(s, F.col(source_col).eqNullSafe(F.col("_mix_source")))
    own = F.struct(F.col("_mix_key").alias("key"), F.col(id_col).alias("id"), F.col("_mix_size").alias("size"))
    place = F.substring("_mix_key", 1, DIGITS)
    extra = F.when(place < F.col("_mix_bucket"), True).otherwise(F.coalesce((place == F.col("_mix_bucket")) & (own <= F.col("_mix_last")), F.lit(False)))
    copies = F.when(F.col("_mix_size") > 0, F.col("_mix_whole") + extra.cast("long")).otherwise(F.lit(0)).cast("long")
    return met.select(*docs.columns, F.struct(F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), copies.alias("copies")).alias("mix_"))
