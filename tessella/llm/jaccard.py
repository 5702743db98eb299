"""Links between sets of k-word shingles whose Jaccard similarity is at least 4/5: no such pair is left apart, by prefixes.

Of two sets that similar, each shares at least ceil(4 n / 5) of its n shingles with the other. So if all sets are sorted
in one order, and d = n - ceil(4 n / 5) is what a set may lack, the first d + 1 + d // 2 of each have at least
1 + d // 2 in common, for the lesser d of the two (the prefix that ends first has no others that may be lacking): only
prefixes meet, and each pair that has so many is verified over the whole sets. Any order is right; shingles that many
sets have come last, the rarer of them first, so that they are in a prefix only where a set has little else. They are
counted on whole sets, as those that are in no prefix by their hash would take the places of the ones put last. Equal
sets are one node.

What is asked for is who reaches whom, so pairs of sets that are in one component already are never made. First every
set meets one other, that with the least name under most of its shingles, which joins groups of near copies in a number
of pairs that grows with their members; then all pairs across the components that are left are counted.

Prefixes go once over the network, 16 bytes a shingle; a shingle of a single set ends there. Frequent ones are spread by
set. Texts aren't moved: the sets to be verified are picked in a second pass by a bitmap of fixed size of their names.

Shingles are those of tessella.llm.simhash (XXH64, seed 42). A text without words has no set and meets none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import simhash
from tessella.llm._shared import SMALL_BYTES, importable, raw, reliable, slices, table
from tessella.llm._tokens import words
from tessella.llm.components import components

#: Sets with a shingle beyond which it is put last, counted on one set of SAMPLE, and how many such shingles are told to the workers at most.
HOT, SAMPLE, HOTS = 32, 8, 1 << 20
#: Tasks over which a frequent shingle's sets are spread, and bits of the bitmap of names.
SPREAD, BITS = 64, 1 << 24


def sets_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text, ascending, and how many come before each text."""
    data, offsets = raw(column)
    return distinct(*simhash._digests(data, *words(data, offsets), k))


def distinct(digests: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sets_of, from the digests in order."""
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((digests, doc))
    doc, digests = doc[order], digests[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (digests[1:] != digests[:-1])
    return digests[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(before) - 1))]).astype(np.int64)


def names_of(values: np.ndarray, before: np.ndarray) -> list[int | None]:
    """A hash of each set, null for none."""
    return [xxhash.xxh64_intdigest(values[a:b].tobytes(), 7) - (1 << 63) if b > a else None for a, b in zip(before[:-1].tolist(), before[1:].tolist())]


def _each_set(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Name, place of the first and number of the shingles of each set, and the shingles; a set comes once a task."""
    seen: set[int] = set()
    for batch in slices(batches, "text", SMALL_BYTES):
        values, before = sets_of(batch.column("text"), k)
        names = names_of(values, before)
        fresh = [i for i, x in enumerate(names) if x is not None and x not in seen and not seen.add(x)]
        n, first = np.diff(before)[fresh], before[:-1][fresh]
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        yield np.array([names[i] for i in fresh], np.int64), n, values[at]


def frequent(rows: DataFrame, k: int) -> np.ndarray:
    """The shingles that HOT sets of rows (text) have, as far as one set of SAMPLE tells, the rarest first; the HOTS most frequent at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, n, values in _each_set(batches, k):
            yield pa.RecordBatch.from_pydict({"token": pa.array(values[np.repeat(names % SAMPLE == 0, n)].view(np.int64))})

    importable(rows.sparkSession)
    # a set counts once a task: to count one twice only puts its shingles later
    told = rows.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE >= HOT)
    return np.array([r.token for r in told.orderBy(F.desc("n"), "token").limit(HOTS).collect()], np.int64).view(np.uint64)[::-1]


def prefixes(rows: DataFrame, k: int, hot: np.ndarray) -> DataFrame:
    """(token, name, often) of the prefix of every set of rows (text); the shingles hot come last, in their order."""
    by_value = np.argsort(hot)
    told = rows.sparkSession.sparkContext.broadcast((hot[by_value], by_value + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = told.value
        for names, n, values in _each_set(batches, k):
            doc = np.repeat(np.arange(len(n)), n)
            late = np.zeros(len(values), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                late = np.where(known[at] == values, place[at], 0)
            order = np.lexsort((values, late, doc))
            lack = n - (4 * n + 4) // 5
            mine = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) < (lack + 1 + lack // 2)[doc]
            yield pa.RecordBatch.from_pydict({"token": pa.array(values[order][mine].view(np.int64)), "name": pa.array(names[doc[mine]]), "often": pa.array(late[order][mine] > 0)})

    importable(rows.sparkSession)
    return rows.select("text").mapInArrow(run, "token long, name long, often boolean")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of token and name, each once, those of tokens that several sets have, or that are frequent."""
    last = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    for batch in batches:
        token, name, keep = (np.concatenate([a, batch.column(c).to_numpy(zero_copy_only=False)]) for c, a in enumerate(last))
        if not len(token):
            continue
        same = token[1:] == token[:-1]
        new = np.append(True, ~same | (name[1:] != name[:-1]))
        token, name, keep = token[new], name[new], keep[new]
        same = token[1:] == token[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        last = [token[-1:], name[-1:], keep[-1:]]
        yield pa.RecordBatch.from_pydict({"token": token[:-1][keep[:-1]], "name": name[:-1][keep[:-1]]})
    yield pa.RecordBatch.from_pydict({"token": last[0][last[2]], "name": last[1][last[2]]})


def verified(rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Of pairs (u, v) of names those at 4/5 or more; rows has the texts."""
    bit = F.col("name").bitwiseAND(F.lit(BITS - 1))
    bits = pairs.select(F.explode(F.array("u", "v")).alias("name")).groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("w")).toArrow()
    asked = np.zeros(BITS >> 6, np.int64)  # of fixed size
    asked[bits["at"].to_numpy()] = bits["w"].to_numpy()
    told = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, n, values in _each_set(batches, k):
            place = names & (BITS - 1)
            good = (told.value[place >> 6] >> (place & 63)) & 1 == 1
            own = values[np.repeat(good, n)].view(np.int64)
            before = np.concatenate([[0], np.cumsum(n[good])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"name": pa.array(names[good]), "own": pa.ListArray.from_arrays(pa.array(before), pa.array(own))})

    whole = table(rows.select("text").mapInArrow(run, "name long, own array<long>").dropDuplicates(["name"]))
    both = pairs.join(whole.select(F.col("name").alias("u"), F.col("own").alias("p")), "u").join(whole.select(F.col("name").alias("v"), F.col("own").alias("q")), "v")
    common = F.size(F.array_intersect("p", "q"))
    return reliable(both.where(5 * common >= 4 * (F.size("p") + F.size("q") - common)).select("u", "v"))


def joined(rows: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(node, root) of the components that sets at 4/5 or more join. rows has text; names the name of each different set, its size n, and its component so far."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = prefixes(rows, k, frequent(rows, k)).repartition(parts, "token", F.when(F.col("often"), F.pmod("name", F.lit(SPREAD))))
    held = table(met.sortWithinPartitions("token", "name").mapInArrow(_shared, "token long, name long"))
    held = table(held.join(names, "name").select("token", "name", "n", "component"))

    def across(held: DataFrame, u: DataFrame) -> DataFrame:
        """(u, v, m, n): sets under a common token, of a size that allows it and of different components; how many tokens they meet under, and the size of the smaller."""
        v = held.select("token", F.col("name").alias("v"), F.col("n").alias("y"), F.col("component").alias("d"))
        near = u.join(v, "token").where("u < v AND c <> d AND 5 * least(x, y) >= 4 * greatest(x, y)")
        return near.groupBy("u", "v").agg(F.count("*").alias("m"), F.first(F.least("x", "y")).alias("n"), F.first("c").alias("c"), F.first("d").alias("d"))

    def links(pairs: DataFrame) -> DataFrame:
        """Links of components from those pairs that are verified."""
        good = verified(rows, pairs.select("u", "v"), k)
        return good.join(pairs, ["u", "v"]).select(F.col("c").alias("u"), F.col("d").alias("v"))

    least = held.groupBy("token").agg(F.min(F.struct("name", "n", "component")).alias("x")).select("token", F.col("x.name").alias("u"), F.col("x.n").alias("x"), F.col("x.component").alias("c"))
    one = across(held, least).groupBy("v").agg(F.max_by(F.struct("u", "c", "d"), F.struct("m", "u")).alias("x"), F.max("m").alias("m")).where("m > 1")
    first = links(reliable(one.select("x.u", "v", "x.c", "x.d")))
    roots = reliable(components(first))
    held = table(held.join(roots, F.col("component") == F.col("node"), "left").select("token", "name", "n", F.coalesce("root", "component").alias("component")))
    # a token whose sets are all of one component has done its work
    left = held.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("token")
    held = reliable(held.join(left, "token", "left_semi"))
    every = across(held, held.select("token", F.col("name").alias("u"), F.col("n").alias("x"), F.col("component").alias("c")))
    rest = links(reliable(every.where("m > (n - (4 * n + 4) div 5) div 2").select("u", "v", "c", "d")))
    more = reliable(components(rest))
    # a component of the second round is a root, or has none yet
    over = roots.join(more.select(F.col("node").alias("r"), F.col("root").alias("to")), F.col("root") == F.col("r"), "left").select("node", F.coalesce("to", "root").alias("root"))
    return reliable(over.union(more.join(roots, "node", "left_anti").select("node", "root")))
