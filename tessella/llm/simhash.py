"""Near-duplicate documents by SimHash: pigeonhole blocks, Hamming check, connected components.

Fingerprint: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of k words (repeats included, joined by a space; a
shorter text gives its whole sequence, none gives fingerprint zero). A bit is set if it is set in over half of the
shingles' XXH64 values (seed 42).

Links: fingerprints of 64 bits are cut into four blocks of 16. Two that differ in at most 2 bits agree in at least two
whole blocks, so they meet under at least one of the six pairs of blocks; these keys of 32 bits are joined, and each
meeting is verified by its Hamming distance. Equal fingerprints count once, so groups of copies, however large, are one
node. A key that more than CROWD different fingerprints share isn't paired out: its members are joined on midpoints
instead (each fingerprint under itself and under each of its 64 one-bit neighbours; two at distance 1 or 2 share one),
where no key can hold more than 65. Both ways are exact.
For links up to 3 bits it is six blocks of which three are shared, and midpoints at distance 1 from one and 2 from the
other.

Defined cases: null text is empty text; null ids take part and their component is null unless an id is reachable;
repeated rows come back as often; columns other than the two named are passed over; an empty table gives none.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import SMALL_BYTES, map_text, raw, reliable, table
from tessella.llm._tokens import LOWER, words
from tessella.llm.components import components

#: Different fingerprints under one key that are compared with each other; larger keys go by midpoints.
CROWD = 64
#: Blocks of the fingerprint and how many of them two must share, by the largest distance of a link.
SPLITS = {2: (4, 2), 3: (6, 3)}


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle of each document in order, and how many come before each document."""
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    before = np.concatenate([[0], np.cumsum(counts)])
    # the words of the batch with one space after each, so that a shingle is one run of bytes
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    packed = np.full(to[-1], 0x20, np.uint8)
    inside = np.repeat(starts - to[:-1], size) + (np.arange(size.sum()) + np.repeat(np.arange(len(size)), size))
    packed[inside - np.repeat(starts - to[:-1], size)] = LOWER[data[inside]]
    doc = np.repeat(np.arange(len(n)), counts)
    first = np.arange(before[-1]) - before[doc] + bounds[doc]
    last = np.minimum(first + k, bounds[doc + 1])
    text, h = packed.tobytes(), xxhash.xxh64_intdigest
    got = [h(text[a:b], 42) for a, b in zip(to[first].tolist(), (to[last] - 1).tolist())]
    return np.array(got, np.uint64), before


def fingerprints_of(column: pa.Array, k: int) -> np.ndarray:
    """The fingerprint of each text of an Arrow string column."""
    data, offsets = raw(column)
    starts, ends, bounds = words(data, offsets)
    return _folded(*_digests(data, starts, ends, bounds, k))


def _folded(digests: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The fingerprint of each document's shingles."""
    out = np.zeros(len(before) - 1, np.uint64)
    full = np.flatnonzero(np.diff(before))
    step = 1 << 16
    sums = np.zeros((len(out), 64), np.int64)
    for at in range(0, len(digests), step):  # bounded: a very long text goes through in pieces
        part = digests[at : at + step]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        doc = np.searchsorted(before, np.arange(at, at + len(part)), side="right") - 1
        edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        sums[doc[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    over = sums * 2 > np.diff(before)[:, None]
    out[full] = np.packbits(over[full], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(id, fp long) of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "fp": pa.array(fingerprints_of(batch.column(1), k).view(np.int64))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, fp long", limit=SMALL_BYTES)


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """(u, v), u < v, of different fingerprints (column fp, distinct) at most so many bits apart (2 or 3): every such pair."""
    n, agree = SPLITS[most]
    edge = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edge, edge[1:])]
    keys = []
    for number, own in enumerate(itertools.combinations(range(n), agree)):
        key = F.lit(number).cast("long")
        for i in own:
            key = F.shiftleft(key, edge[i + 1] - edge[i]).bitwiseOR(block[i])
        keys.append(key)
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = reliable(keyed.join(sizes, "key"))
    few, many = met.where(F.col("n") <= CROWD), met.where(F.col("n") > CROWD).select("fp").distinct()

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.select("key", F.col("fp").alias("u")).join(b.select("key", F.col("fp").alias("v")), "key")
        ordered = both.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        return ordered.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most)

    def ball(x: DataFrame) -> DataFrame:
        """Each fingerprint under itself and its one-bit neighbours."""
        flips = [(1 << i) - (1 << 64) * (i == 63) for i in range(64)]
        return x.select("fp", F.explode(F.array("key", *[F.col("key").bitwiseXOR(F.lit(f)) for f in flips])).alias("key"))

    near = ball(many.select("fp", F.col("fp").alias("key")))
    return pairs(few, few).union(pairs(near, near if most == 2 else ball(near).distinct())).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, most: int = 2) -> DataFrame:
    """(id, fp long, component): one row a document, component the smallest id that links reach, its own included."""
    got = reliable(fingerprints(docs, id_col, text_col, k))
    nodes = got.groupBy("fp").agg(F.min("id").alias("least"))
    roots = reliable(components(links(nodes.select("fp"), most)))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    of = reliable(named.join(smallest, "root").select("fp", "component"))
    return got.join(of, "fp").select("id", "fp", "component")


def groups(rows: DataFrame, k: int = 5, most: int = 3) -> DataFrame:
    """(key, component long) of rows (key struct, text): linked up to so many bits, or by a Jaccard similarity of their shingles of at least 4/5."""
    from tessella.llm import jaccard

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = raw(batch.column(1))
        digests, before = _digests(data, *words(data, offsets), k)
        values, sets = jaccard.distinct(digests, before)
        return {"key": batch.column(0), "fp": pa.array(_folded(digests, before).view(np.int64)), "name": pa.array(jaccard.names_of(values, sets), pa.int64()), "n": pa.array(np.diff(sets))}

    kind = rows.schema["key"].dataType.simpleString()
    got = table(map_text(rows.select("key", "text"), run, f"key {kind}, fp long, name long, n long", limit=SMALL_BYTES))
    first = reliable(got.where("name is not null").groupBy("name").agg(F.min("fp").alias("fp"), F.first("n").alias("n")))
    # sets that are equal, counted otherwise, may have several fingerprints
    same = got.join(first.select("name", F.col("fp").alias("b")), "name").where("fp <> b").select(F.col("fp").alias("u"), F.col("b").alias("v"))
    roots = reliable(components(links(got.select("fp").distinct(), most).union(same)))
    named = reliable(first.join(roots, F.col("fp") == F.col("node"), "left").select("name", "n", F.coalesce("root", "fp").alias("component")))
    over = jaccard.joined(rows, named, k).select(F.col("node").alias("component"), F.col("root").alias("to"))
    of = got.join(roots, F.col("fp") == F.col("node"), "left").select("key", F.coalesce("root", "fp").alias("component"))
    return of.join(over, "component", "left").select("key", F.coalesce("to", "component").alias("component"))
