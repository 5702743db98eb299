"""Line dedup by pairwise alignment: lines that a later document has in common with an earlier one, in order, go.

Lines are the text cut at \\n; lines without words are never compared. Documents are ordered by id (null last), then by
a hash of the text. Rows equal in id and text are one document; of documents equal in text alone the first stands for all
in what follows, and the later ones lose every line that has words, if these are MIN_WORDS or more.

1. Overlaps. Every line's hash is counted over different texts. A line of several texts chooses for each later one the
   first that has it, and the first that has it as often; a rare one (in at most RARE texts) every earlier one. So the
   pairs of a line grow with its texts and not with their square, and every common line meets its first holders.
2. Alignment. Each chosen pair is aligned over all lines that both have, however frequent, by patience diff: equal ends,
   then lines that are single on both sides in longest ascending order, then the same between them.
3. Aligned lines that follow each other in the later document (lines without words between them don't count) are a
   block; blocks of at least MIN_WORDS words are deleted from the later document.

Only hashes and places of shared lines move, and the texts once, to be cut. A line that a third of all documents share
is one small row for each different text; counts are combined before the shuffle, and skewed joins are split by AQE.

Defined cases: null text has no lines and stays null; an empty text is one line without words; documents of which all is
deleted stay as empty texts; repeated rows stay and are cut alike; null ids with different texts are different documents;
an empty table gives none; other columns are carried in a struct, so their names don't matter; a very long text is one row
and its lines are looked up by place. The column added is called lines_, with more underscores where that name is taken.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import importable, table

RARE, MIN_WORDS = 4, 3
WORD = r"[^\x20\x09-\x0D]+"


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two sequences, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        in_a, in_b = Counter(a[i:n]), Counter(b[j:m])
        place = {x: p for p, x in enumerate(b[j:m], j) if in_b[x] == 1}
        single = [(p, place[x]) for p, x in enumerate(a[i:n], i) if in_a[x] == 1 and x in place]
        # the longest run of singles that ascends on both sides
        tops: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for s, (_, q) in enumerate(single):
            at = bisect_left(tops, q)
            if at == len(tops):
                tops.append(q)
                ends.append(s)
            else:
                tops[at], ends[at] = q, s
            back.append(ends[at - 1] if at else -1)
        chain, s = [], ends[-1] if ends else -1
        while s >= 0:
            chain.append(single[s])
            s = back[s]
        chain.reverse()
        out += chain
        if chain:
            edges = [(i - 1, j - 1), *chain, (n, m)]
            todo += [(p + 1, q, r + 1, t) for (p, r), (q, t) in zip(edges, edges[1:])]
    return sorted(out)


def aligned(shared: list[tuple], min_words: int = MIN_WORDS) -> list[int]:
    """Places in the later document that go. shared: for each common line its key, places in the earlier and (place, number among the lines with words, words) in the later document."""
    a = sorted((p, k) for k, first, _ in shared for p in first)
    b = sorted((p, o, w, k) for k, _, later in shared for p, o, w in later)
    pairs = patience([k for _, k in a], [x[3] for x in b])
    gone: list[int] = []
    block: list[tuple] = []
    last = None
    for i, j in [*pairs, (None, None)]:
        if j is not None and last is not None and b[j][1] == b[last][1] + 1:
            block.append(b[j])
        else:
            if sum(x[2] for x in block) >= min_words:
                gone += [x[0] for x in block]
            block = [b[j]] if j is not None else []
        last = j
    return gone


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, t1, t2): t1, t2 are 128 bits of hash of the text; rows without a text are left out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    return rows.select("id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(11), "text").alias("t2"))


def shared_lines(rows: DataFrame) -> DataFrame:
    """(h, g, doc, places): of lines that several texts have the place, number among lines with words, and words in each; doc: last, id, t1, t2 in order of documents."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(3), x).alias("g"), i.alias("at"), _words(x).alias("words")))
    full = rows.select("id", "t1", "t2", F.posexplode(F.filter(line, lambda x: x["words"] > 0)).alias("n", "line"))
    each = table(full.select("id", "t1", "t2", "n", "line.*"))
    spans = [f(c).alias(f"{c}{n}") for c in ("t1", "t2") for n, f in enumerate((F.min, F.max))]
    several = each.groupBy("h", "g").agg(*spans).where("t10 <> t11 OR t20 <> t21").select("h", "g")
    held = each.join(several, ["h", "g"], "left_semi").groupBy("h", "g", "t1", "t2").agg(F.min("id").alias("id"), F.sort_array(F.collect_set(F.struct("at", "n", "words"))).alias("places"))
    return held.select("h", "g", F.struct(F.col("id").isNull().alias("last"), "id", "t1", "t2").alias("doc"), "places")


def chosen_pairs(held: DataFrame, rare: int = RARE) -> DataFrame:
    """(t1, t2, earlier, h, g, before, places) of every pair that is to be aligned and every line that both have; before: places in the earlier."""
    counted = held.groupBy("h", "g").agg(F.count("*").alias("docs"), F.min(F.struct("doc", F.col("places.at").alias("at"))).alias("first")).where("docs > 1")
    common = held.join(counted, ["h", "g"])
    first = common.where(F.col("doc") > F.col("first.doc")).select("doc", F.col("first.doc").alias("earlier"), "h", "g", F.col("first.at").alias("before"), "places")
    few = common.where(F.col("docs") <= rare).select("h", "g", "doc", "places", "first")
    other = few.select("h", "g", F.col("doc").alias("earlier"), F.col("places.at").alias("before")).join(few, ["h", "g"])
    other = other.where((F.col("doc") > F.col("earlier")) & (F.col("earlier") > F.col("first.doc"))).select("doc", "earlier", "h", "g", "before", "places")
    linked = first.union(other).select("doc.t1", "doc.t2", "earlier", "h", "g", "before", "places")
    # the first that has it as often as the later one, where that isn't the first of all
    times = held.groupBy("h", "g", F.size("places").alias("m")).agg(F.min("doc").alias("peer"), F.count("*").alias("peers")).where("peers > 1")
    peers = common.where(F.col("docs") > rare).withColumn("m", F.size("places")).join(times, ["h", "g", "m"]).where((F.col("doc") > F.col("peer")) & (F.col("peer") > F.col("first.doc")))
    pairs = linked.select("t1", "t2", "earlier").union(peers.select("doc.t1", "doc.t2", F.col("peer").alias("earlier")))
    chosen = pairs.groupBy("t1", "t2").agg(F.collect_set("earlier").alias("earliers"))
    often = common.where(F.col("docs") > rare).select("h", "g", "doc", "places", F.col("first.doc").alias("start"))
    later = often.where(F.col("doc") > F.col("start")).select("doc.t1", "doc.t2", F.struct("h", "g", "start", "places").alias("line"))
    asked = chosen.join(later.groupBy("t1", "t2").agg(F.collect_list("line").alias("lines")), ["t1", "t2"]).select("t1", "t2", "lines", F.explode("earliers").alias("earlier"))
    # a line that starts at the earlier one is among linked, one that starts after it isn't in it
    asked = asked.select("t1", "t2", "earlier", F.explode(F.filter("lines", lambda x: x["start"] < F.col("earlier"))).alias("line")).select("t1", "t2", "earlier", "line.h", "line.g", "line.places")
    rest = asked.join(often.select("h", "g", F.col("doc").alias("earlier"), F.col("places.at").alias("before")), ["h", "g", "earlier"])
    return linked.union(rest.select("t1", "t2", "earlier", "h", "g", "before", "places"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """(t1, t2, gone array<boolean>): for each text that loses lines, whether the line at a place goes, up to the last that does."""
    held = table(shared_lines(_named(docs, id_col, text_col)))
    pairs = chosen_pairs(held, rare).select("t1", "t2", F.xxhash64("earlier").alias("other"), F.struct("h", "g").alias("key"), "before", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, doc, shared, gone, out = None, None, [], set(), []

        def close() -> None:
            nonlocal shared
            if shared:
                gone.update(aligned(shared, min_words))
            shared = []

        for batch in batches:
            for t1, t2, other, key, before, places in zip(*(c.to_pylist() for c in batch.columns)):
                if (t1, t2, other) != pair:
                    close()
                    pair = (t1, t2, other)
                if (t1, t2) != doc:
                    if gone:
                        out.append((*doc, _mask(gone)))
                    doc, gone = (t1, t2), set()
                shared.append(((key["h"], key["g"]), before, [(p["at"], p["n"], p["words"]) for p in places]))
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        close()
        if gone:
            out.append((*doc, _mask(gone)))
        yield _rows(out)

    importable(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, "t1", "t2").sortWithinPartitions("t1", "t2", "other").mapInArrow(run, "t1 long, t2 long, gone array<boolean>")


def _mask(gone: set[int]) -> np.ndarray:
    out = np.zeros(max(gone) + 1, bool)
    out[list(gone)] = True
    return out


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"t1": pa.array([x[0] for x in out], pa.int64()), "t2": pa.array([x[1] for x in out], pa.int64()), "gone": pa.array([x[2] for x in out], pa.list_(pa.bool_()))})


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the deleted lines cut from text_col, and a struct lines_ of n_lines and n_removed."""
    lost = removals(docs, id_col, text_col, rare, min_words)
    of = _named(docs, id_col, text_col).groupBy("t1", "t2").agg(F.min("id").alias("least"), F.max("id").alias("most"), (F.count("*") > F.count("id")).alias("without"))
    copied = of.where(F.col("least").isNotNull() & ((F.col("least") != F.col("most")) | F.col("without"))).select("t1", "t2", "least")
    both = lost.join(copied, ["t1", "t2"], "full")
    name = "lines_"
    while name in docs.columns:
        name += "_"
    text = F.col(text_col).cast("string")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(11), text).alias("t2"))
    met = own.join(both, ["t1", "t2"], "left")
    lines = F.split("text", "\n")
    copy = F.coalesce(F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least")) & (_words(F.col("text")) >= min_words), F.lit(False))
    stays = F.when(copy, F.filter(lines, lambda x: ~x.rlike(WORD))).when(F.col("gone").isNotNull(), F.filter(lines, lambda x, i: ~F.coalesce(F.get("gone", i), F.lit(False)))).otherwise(lines)
    cut = met.select("row", "text", F.when(F.col("text").isNotNull(), lines).alias("lines"), F.when(F.col("text").isNotNull(), stays).alias("stays"), (copy | F.col("gone").isNotNull()).alias("hit"))
    n, m = F.coalesce(F.size("lines"), F.lit(0)).cast("long"), F.coalesce(F.size("lines") - F.size("stays"), F.lit(0)).cast("long")
    kept = F.when(F.col("hit") & F.col("text").isNotNull(), F.array_join("stays", "\n")).otherwise(F.col(f"row.`{text_col}`"))
    info = F.when(F.col("text").isNull(), F.struct(F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))).otherwise(F.struct(n.alias("n_lines"), m.alias("n_removed")))
    return cut.select(*[kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns], info.alias(name))
