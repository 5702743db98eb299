"""Substring dedup by repeated-phrase automata: every word covered by a window of WINDOW words that starts elsewhere too.

Words are [^\\x20\\x09-\\x0D]+, unchanged. What is to be removed is judged on the input, over all rows.

1. Anchors. In every window the least hash of its GRAM-word sequences is its anchor; equal windows have equal anchors.
   Only windows whose anchor occurs twice can recur. Anchors are counted with partial sums and joined back to the texts.
2. Equal texts are one from here on, with their number; a text is shuffled once.
3. A run of windows with one recurring anchor is a segment; equal segments of an anchor are one, with their number. An
   anchor with more than HOT occurrences is split: each of its windows is then a segment under its own hash.
4. Shards. All segments of an anchor, of all documents, meet in one task, which takes bounded groups of anchors: passages
   of WINDOW words that are counted twice are confirmed (the words themselves are compared, not hashes) and compiled, each
   once, into Aho-Corasick automata of bounded size over word numbers; every segment is streamed through them to locate
   every occurrence. A segment goes to the shard of its anchor only, where all that it can repeat is: no document needs to
   meet the automata of other shards.
5. Located ranges go back to the texts by the segments' hashes (128 bits), and the texts are cut.

Defined cases: null text has no words; windows may overlap within a document (a word repeated 36 times is two equal
windows); repeated rows are copies, and so cut like copies; a text of under WINDOW words is never cut; an empty table
gives none; null and repeated ids are carried along; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import importable, map_text, raw, slices, table
from tessella.llm._tokens import BASE, mix, word_hashes, words

WINDOW, GRAM = 35, 8
#: Occurrences of an anchor above which its windows are told apart by their own hashes.
HOT = 20_000
#: Words of the segments that are streamed through one shard's automata, and passages in one automaton.
SHARD_WORDS, MACHINE = 8_000, 40_000


def _slide(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w successive values."""
    least, span = x, 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (w - span)], least[w - span :]) if w > span else least


def _chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k successive words, over document borders too."""
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(BASE) + hashes[j : len(hashes) - k + 1 + j])
    return out


def runs_of(column: pa.Array, window: int = WINDOW) -> tuple:
    """words(...) of the texts, their hashes, and for each run of windows with one anchor: anchor, first window, end window, text's number."""
    data, offsets = raw(column)
    starts, ends, bounds = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return data, starts, ends, bounds, hashes, none.astype(np.uint64), none, none, none
    gram = min(GRAM, window)
    anchors = _slide(_chain(hashes, gram), window - gram + 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    a, d = anchors[at], doc[at]
    edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])])) if len(at) else none
    stop = np.append(edge[1:], len(at)).astype(np.int64) if len(at) else none
    return data, starts, ends, bounds, hashes, a[edge], at[edge], at[stop - 1] + 1, d[edge]


def _sown(hashes: np.ndarray, anchor: np.ndarray, first: np.ndarray, stop: np.ndarray, window: int) -> np.ndarray:
    """Whether a run's anchor stands at two places within it, so that its own windows may repeat."""
    if not len(anchor):
        return np.zeros(0, bool)
    grams = _chain(hashes, min(GRAM, window))
    span = stop - first + window - min(GRAM, window)
    to = np.concatenate([[0], np.cumsum(span)])
    place = np.arange(to[-1]) - np.repeat(to[:-1] - first, span)
    return np.add.reduceat((grams[place] == np.repeat(anchor, span)).astype(np.int64), to[:-1]) > 1


def _pack(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words with one space after each, and the place of each word in them (one more than words)."""
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(to[-1], 0x20, np.uint8)
    shift = np.repeat(to[:-1] - starts, size)
    place = np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)
    out[place] = data[place - shift]
    return out.tobytes(), to


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, k1, k2) of every run, two rows where the anchor stands twice in it."""

    def run(batch: pa.RecordBatch) -> dict:
        *_, hashes, anchor, first, stop, doc = runs_of(batch.column(2), window)
        twice = 1 + _sown(hashes, anchor, first, stop, window)
        anchor, doc = np.repeat(anchor, twice), np.repeat(doc, twice)
        return {"anchor": _long(anchor), "k1": batch.column(0).take(pa.array(doc)), "k2": batch.column(1).take(pa.array(doc))}

    return map_text(docs.select("k1", "k2", "text"), run, "anchor long, k1 long, k2 long")


def cut_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> tuple[list[str], np.ndarray]:
    """sha256 of each text's kept words joined by a space, and how many are gone."""
    kept = ~gone
    packed, to = _pack(data, starts[kept], ends[kept])
    upto = np.concatenate([[0], np.cumsum(kept)])
    first, last = upto[bounds[:-1]], upto[bounds[1:]]
    digests = [hashlib.sha256(packed[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(to[first].tolist(), to[last].tolist())]
    return digests, np.diff(bounds) - (last - first)


WIDE = "kind int, k1 long, k2 long, n int, anchor long, text string, h1 long, h2 long, at int, digest string"


def _split(texts: DataFrame, window: int) -> DataFrame:
    """From texts (k1, k2, m, text, hits, hot): finished rows (kind 0), segments (kind 1), and texts yet to be cut (kind 2)."""
    types = pa.schema([("kind", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("text", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            column = batch.column("text")
            data, starts, ends, bounds, hashes, anchor, first, stop, doc = runs_of(column, window)
            k1, k2, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "m"))
            keys = {}
            for which in ("hits", "hot"):
                lists = batch.column(which)
                if lists.null_count:
                    lists = lists.fill_null([])
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                # a text's number with its anchor: mixed, and so safe to look up across texts
                keys[which] = np.unique(mix(flat ^ mix(owner.astype(np.uint64))))
            own = mix(anchor ^ mix(doc.astype(np.uint64)))
            is_hot = np.isin(own, keys["hot"])
            good = np.isin(own, keys["hits"]) | is_hot
            some = np.zeros(len(k1), bool)
            some[doc[good]] = True
            packed, to = _pack(data, starts, ends)
            rows: list[tuple] = []
            if is_hot.any():
                each = np.flatnonzero(is_hot)
                a = np.concatenate([np.arange(first[i], stop[i]) for i in each])
                owner = np.repeat(doc[each], stop[each] - first[each])
                grams = _chain(hashes, window)
                parts = [(grams[a], a, a + 1, owner)]
            else:
                parts = []
            plain = good & ~is_hot
            parts.append((anchor[plain], first[plain], stop[plain], doc[plain]))
            for s_anchor, a, b, d in parts:
                at, end = to[a].tolist(), (to[b + window - 1] - 1).tolist()
                segment = [packed[x:y] for x, y in zip(at, end)]
                h = np.array([xxhash.xxh3_128_intdigest(x) for x in segment], object)
                h1 = np.array([int(x) & 0xFFFFFFFFFFFFFFFF for x in h], np.uint64)
                h2 = np.array([int(x) >> 64 for x in h], np.uint64) ^ s_anchor
                rows.append((np.full(len(a), 1, np.int32), k1[d], k2[d], m[d].astype(np.int32), s_anchor.view(np.int64), pa.array(segment, pa.binary()).cast(pa.string()), h1.view(np.int64), h2.view(np.int64), (a - bounds[d]).astype(np.int32), pa.nulls(len(a), pa.string())))
            left = np.flatnonzero(some)
            none = pa.nulls(len(left), pa.int64())
            rows.append((np.full(len(left), 2, np.int32), k1[left], k2[left], np.diff(bounds)[left].astype(np.int32), none, column.take(pa.array(left)), none, none, none.cast(pa.int32()), none.cast(pa.string())))
            # a text without a recurring anchor stays whole
            done = np.flatnonzero(~some)
            digests, _ = cut_words(data, starts, ends, bounds, np.zeros(len(starts), bool))
            none = pa.nulls(len(done), pa.int64())
            rows.append((np.zeros(len(done), np.int32), k1[done], k2[done], np.diff(bounds)[done].astype(np.int32), none, none.cast(pa.string()), none, none, none.cast(pa.int32()), pa.array([digests[i] for i in done.tolist()], pa.string())))
            for r in rows:
                if len(r[0]):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in r], schema=types)

    importable(texts.sparkSession)
    return texts.mapInArrow(run, WIDE)


def automaton(passages: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for x in passages:
        found.add_word(x)
    found.make_automaton()
    return found


def coded(segments: list[str]) -> list[str]:
    """Each segment with a character for each word, the same for equal words."""
    numbers: dict[str, int] = {}
    out = []
    for s in segments:
        n = [numbers.setdefault(w, len(numbers)) for w in s.split(" ")]
        out.append("".join([chr(x + 1 if x < 0xD7FF else x + 0x801) for x in n]))  # no surrogates
    return out


def confirmed(codes: list[str], counts: list[int], window: int) -> list[str]:
    """Passages of window words that stand at least twice, each once; counts: how often a segment stands."""
    seen: Counter[str] = Counter()
    for s, n in zip(codes, counts):
        for i in range(len(s) - window + 1):
            seen[s[i : i + window]] += n
    return [x for x, n in seen.items() if n > 1]


def locate(segments: list[str], counts: list[int], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each segment the ranges of words covered by confirmed passages, found by streaming every segment through automata of at most MACHINE passages."""
    codes = coded(segments)
    passages = confirmed(codes, counts, window)
    ends: list[list[int]] = [[] for _ in codes]
    for at in range(0, len(passages), MACHINE):
        machine = automaton(passages[at : at + MACHINE])
        for own, s in zip(ends, codes):
            own += [last for last, _ in machine.iter(s)]
    out = []
    for own in ends:
        e = np.sort(np.array(own, np.int64))
        cut = np.flatnonzero(np.diff(e) > window) + 1
        first, last = e[np.append(0, cut)] if len(e) else e, e[np.append(cut, len(e)) - 1] if len(e) else e
        out.append(list(zip((first - window + 1).tolist(), (last + 1).tolist())))
    return out


def _located(segments: DataFrame, window: int) -> DataFrame:
    """(h1, h2, from, to) of every segment that holds recurring windows, in words from the segment's start."""
    most = SHARD_WORDS
    each = segments.groupBy("anchor", "text", "h1", "h2").agg(F.sum("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            found = locate(held[0], held[1], window)
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = [r for x in found for r in x]
            got = {"h1": [held[2][i] for i in owner], "h2": [held[3][i] for i in owner], "from": [a for a, _ in flat], "to": [b for _, b in flat]}
            return pa.RecordBatch.from_pydict(got, schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("from", pa.int32()), ("to", pa.int32())]))

        for batch in batches:
            for a, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "text", "n", "h1", "h2"))):
                if size > most and a != last:
                    yield flush()
                    held, size = [[], [], [], []], 0
                for x, y in zip(held, row):
                    x.append(y)
                size, last = size + row[0].count(" ") + 1, a
        if held[0]:
            yield flush()

    importable(segments.sparkSession)
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "h1 long, h2 long, `from` int, `to` int")


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with k1, k2, 128 bits of hash of the text, and the text as text (null: empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("_text", text).withColumn("k1", F.xxhash64("_text")).withColumn("k2", F.xxhash64(F.lit(7), F.col("_text"))).withColumn("text", F.col("_text")).drop("_text")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The work up to the ranges: (k1, k2, n words, digest) of texts that stay whole, (k1, k2, n, text) of the others, and (k1, k2, ranges)."""
    rows = keyed(docs.select(F.col(text_col).alias("text"))).select("k1", "k2", "text")
    anchors = _anchors(rows, window)
    twice = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    hits = anchors.join(twice, "anchor").groupBy("k1", "k2").agg(F.collect_set(F.when(F.col("n") <= HOT, F.col("anchor"))).alias("hits"), F.collect_set(F.when(F.col("n") > HOT, F.col("anchor"))).alias("hot"))
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("m"))
    split = table(_split(texts.join(hits, ["k1", "k2"], "left"), window), "kind")
    segments = split.where("kind = 1")
    places = segments.select("h1", "h2", "k1", "k2", "at").join(_located(segments, window), ["h1", "h2"])
    ranges = places.groupBy("k1", "k2").agg(F.collect_list(F.struct((F.col("at") + F.col("from")).alias("a"), (F.col("at") + F.col("to")).alias("b"))).alias("ranges"))
    return split.where("kind = 0").select("k1", "k2", "n", "digest"), split.where("kind = 2").select("k1", "k2", "n", "text"), ranges


def _gone(batch: pa.RecordBatch, bounds: np.ndarray) -> np.ndarray:
    """Which words of the texts the ranges cover."""
    lists = batch.column("ranges")
    if lists.null_count:
        lists = lists.fill_null([])
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    step = np.zeros(bounds[-1] + 1, np.int64)
    if len(flat):
        np.add.at(step, bounds[owner] + flat.field("a").to_numpy(zero_copy_only=False), 1)
        np.add.at(step, bounds[owner] + flat.field("b").to_numpy(zero_copy_only=False), -1)
    return np.cumsum(step)[:-1] > 0


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words long, n_removed long, kept_sha256) of every row."""
    whole, others, ranges = repeated(docs, id_col, text_col, window)

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = raw(batch.column("text"))
        starts, ends, bounds = words(data, offsets)
        digests, removed = cut_words(data, starts, ends, bounds, _gone(batch, bounds))
        return {"k1": batch.column("k1"), "k2": batch.column("k2"), "n_words": pa.array(np.diff(bounds).astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array(digests, pa.string())}

    done = map_text(others.join(ranges, ["k1", "k2"], "left").select("k1", "k2", "text", "ranges"), run, "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string")
    same = whole.select("k1", "k2", F.col("n").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"))
    own = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "k1", "k2")
    return own.join(done.union(same), ["k1", "k2"]).select("id", "n_words", "n_removed", "kept_sha256")


def cut_texts(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with text_col replaced by its kept words, joined by one space; texts without recurring windows stay as they are."""
    _, others, ranges = repeated(docs, text_col, text_col, window)

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = raw(batch.column("text"))
        starts, ends, bounds = words(data, offsets)
        kept = ~_gone(batch, bounds)
        packed, to = _pack(data, starts[kept], ends[kept])
        upto = np.concatenate([[0], np.cumsum(kept)])
        a, b = to[upto[bounds[:-1]]].tolist(), to[upto[bounds[1:]]].tolist()
        return {"k1": batch.column("k1"), "k2": batch.column("k2"), "_kept": pa.array([packed[x : y - 1].decode() if y > x else "" for x, y in zip(a, b)], pa.string())}

    done = map_text(others.join(ranges, ["k1", "k2"]).select("k1", "k2", "text", "ranges"), run, "k1 long, k2 long, _kept string")
    own = docs.withColumn("_k1", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn("_k2", F.xxhash64(F.lit(7), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    met = own.join(done.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), ["_k1", "_k2"], "left")
    return met.withColumn(text_col, F.coalesce("_kept", text_col)).select(*docs.columns)
