"""Document fingerprints by threshold-scaled sketches.

A sketch keeps every distinct shingle hash (five words, A-Z lower-cased) that is at most THRESHOLD, a fixed 1/16 of all
64-bit values, and besides the FLOOR least hashes, so that short texts aren't left with nothing. Both parts merge: the
sketch of a union is the union of sketches, cut by the same rule. A sketch with fewer shingles than it would keep anyway
is complete and says so. Two sketches are compared below the lower of the values up to which each is whole, which gives
unbiased estimates of containment and resemblance also for texts of very unequal length.

As text: "=" if complete, else "~", then the kept hashes in order, 16 lowercase hexadecimal digits each.

Defined cases: null text is empty text; a text of 1 to 4 words is one shingle; a text without words has the sketch "=",
is wholly contained in any other and resembles only another such one; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import SLICE_BYTES, importable, raw
from tessella.llm._tokens import LOWER, gram_hashes, word_hashes, words

THRESHOLD = np.uint64((1 << 64) // 16 - 1)
FLOOR, WORDS = 16, 5
ALL = np.uint64((1 << 64) - 1)


def cut(hashes: np.ndarray) -> tuple[np.ndarray, bool]:
    """The sketch of a set of hashes, and whether it is complete."""
    kept = np.unique(hashes)
    n = max(int(np.searchsorted(kept, THRESHOLD, side="right")), FLOOR)
    return kept[:n], len(kept) <= n


def sketches(column: pa.Array, k: int = WORDS) -> list[tuple[np.ndarray, bool]]:
    """The sketch of each text of an Arrow string column."""
    data, offsets = raw(column)
    starts, ends, bounds = words(data, offsets)
    hashes = word_hashes(LOWER[data], starts, ends)
    grams, before = gram_hashes(hashes, bounds, k)
    return [cut(grams[a:b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]


def merge(a: tuple[np.ndarray, bool], b: tuple[np.ndarray, bool]) -> tuple[np.ndarray, bool]:
    """The sketch of all shingles of both."""
    kept, whole = cut(np.concatenate([a[0], b[0]]))
    return kept, whole and a[1] and b[1]


def encode(sketch: tuple[np.ndarray, bool]) -> str:
    return "~="[sketch[1]] + sketch[0].astype(">u8").tobytes().hex()


def decode(text: str) -> tuple[np.ndarray, bool]:
    return np.frombuffer(bytes.fromhex(text[1:]), ">u8").astype(np.uint64), text[0] == "="


def compare(a: tuple[np.ndarray, bool], b: tuple[np.ndarray, bool]) -> tuple[float, float]:
    """Estimates of how much of a's shingles b holds, and of their resemblance (common to all)."""
    upto = min(ALL if whole else max(THRESHOLD, kept[-1]) for kept, whole in (a, b))
    x, y = (kept[: np.searchsorted(kept, upto, side="right")] for kept, _ in (a, b))
    if not len(x) or not len(y):
        return float(not len(x)), float(len(x) == len(y))
    common = int(np.isin(x, y, assume_unique=True).sum())
    return common / len(x), common / (len(x) + len(y) - common)


def _between(id_col: Column, cuts: list, group: int = 64) -> Column:
    """How many of the cuts, ascending, are at most the id; null: 0. Two steps, so that it stays cheap for thousands."""

    def within(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= id_col))

    if len(cuts) <= group:
        return F.coalesce(within(F.array(*map(F.lit, cuts))), F.lit(0)) if cuts else F.lit(0)
    groups = [cuts[i : i + group] for i in range(0, len(cuts), group)]
    at = F.greatest(within(F.array(*[F.lit(g[0]) for g in groups])) - 1, F.lit(0))
    return F.coalesce(at * group + within(F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), at + 1)), F.lit(0))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, guest, id, text), laid out so that a document's next one follows it in its partition.

    The ids are cut into ranges at some of their own values; the first row of each range also goes, as a guest, to the
    end of the range before, and the very first one to the end of the last. So the texts are shuffled once, no range
    depends on another, and no task holds more than its range. Ascending id, null ids first, then by text.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("id"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)]
    some = ids.agg(F.percentile_approx("id", F.array(*map(F.lit, shares)), F.lit(max(10_000, 20 * parts))).alias("cuts") if shares else F.lit(None).alias("cuts"), F.min("id").alias("least"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    cuts = sorted({c for c in some.cuts or [] if c > some.least or some.nulls})
    part = _between(F.col("id"), cuts)
    opens = F.lit(False)
    if some.least is not None or some.nulls:
        very_first = F.col("id").isNull() if some.nulls else F.col("id") == F.lit(some.least)
        opens = F.coalesce(very_first, F.lit(False)) | F.coalesce(F.array_contains(F.array(*map(F.lit, cuts)), F.col("id")) if cuts else F.lit(False), F.lit(False))
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("part") - 1, F.lit(len(cuts) + 1)).alias("part"), F.lit(True).alias("guest"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("part", part)
    laid = rows.select("id", "text", F.explode(F.when(opens, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    # rows of equal id all go as guests; the first of them in order is the one that is used
    return laid.select("at.*", "id", "text").repartitionById(len(cuts) + 1, F.col("part").cast("int")).sortWithinPartitions("guest", "id", "text")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, resembles_edited, resembles_next).

    The edited text is the text whose last n_chars // 2 code points are replaced by the first as many (or all) of the
    next document's. near: share of the text's shingles that the other holds; resembles: share of the common ones in all.
    """
    importable(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def flush(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts)]
        own, other = sketches(pa.array(texts, pa.large_string())), sketches(pa.array(edited, pa.large_string()))
        after = [*own[1:], *sketches(pa.array(nexts[-1:], pa.large_string()))]
        to_edited, to_next = zip(*map(compare, own, other)), zip(*map(compare, own, after))
        (a, b), (c, d) = to_edited, to_next
        return pa.RecordBatch.from_pydict({
            "id": ids, "n_chars": pa.array(map(len, texts), pa.int64()), "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": [*map(encode, own)], "edited_fingerprint": [*map(encode, other)], "near_edited": a, "near_next": c, "resembles_edited": b, "resembles_next": d,
        } | ({"id": pa.array(ids, pa.int64())} if kind == "bigint" else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, past = [], [], 0, False
        for batch in batches:
            for i, t, g in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("guest").to_pylist()):
                if past:
                    continue
                past = g
                # a slice ends when the next document is known
                if texts and (size > SLICE_BYTES // 2 or past):
                    yield flush(ids, texts, [*texts[1:], t])
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)

    return with_next(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, resembles_edited double, resembles_next double")
