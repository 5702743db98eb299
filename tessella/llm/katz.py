"""Language-model scores by Katz backoff over words and pairs of words.

Tokens: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, then one end. A pair is a token after its context: the token before
it, or the start of the text. Counts come from the training rows; all rows are scored.

Model. A count r up to K keeps the share d_r of Katz's Good-Turing discount (1 - 0.5 / r where the counts of counts give
none between 0 and 1); a larger one loses TAIL, so that every context keeps something for unseen tokens. What the words
lose altogether is the probability of an unknown word, one event beside the V known ones. P(v | u) = (c - loss) / C(u)
for a pair seen c times, else alpha(u) P(v), and P(v) after a context never seen; alpha(u) = loss of u's pairs / C(u) /
(1 - sum of P(v) over u's pairs), so every context's probabilities add up to 1.

Distribution. The texts are read three times in the same partitions and cut into groups of about GROUP tokens.
1. Each group asks, for its different words, for their counts: a compressed array for each of as many parts as there are
   shuffle partitions. A part adds up and answers in the order of the question, into a table partitioned by the input
   partition that asks.
2. Knowing these counts, each group asks for its different pairs, sent by context, with its own counts of them. A part
   adds up the pairs and what alpha needs for each context, and answers in the same way. A context more frequent than
   an eighth of a part (at most 8 times as many as parts, known from step 1) is spread over parts in proportion, by pair;
   the sums of these few, at most 16 times as many rows as parts, are added up in a table of their own.
3. Each group reads its answers and evaluates every token: pair, else backoff, else unknown.
A group moves its different words and pairs only, a byte or two each on the way back, and no text; every array belongs
to one group and one part, so memory is bounded; nothing is capped. Lost tasks are run again from input and tables.

The input must give the same rows in the same partitions each time it is read, as a stored table does; stored=False has
it written into the shared folder first. A group whose answers don't fit its words is an error, never a wrong score.

Defined cases: null text is empty text (one token, the end); a null id trains; repeated rows count as often; other
columns are passed over; without training rows every token is unknown, with probability 1; an empty table gives none.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import importable, raw, shared_dir, slices, table
from tessella.llm._tokens import BASE, LOWER, mix, word_hashes, words

K, TAIL, GROUP = 5, 0.01, 1_000_000
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000002)
ANSWER = "pid int, g int, part int, blob binary, u long, m array<long>, b double"
SCHEMA = pa.schema([("pid", pa.int32()), ("g", pa.int32()), ("part", pa.int32()), ("blob", pa.binary()), ("u", pa.int64()), ("m", pa.list_(pa.int64())), ("b", pa.float64())])
#: Input partitions that stand for sums over all.
SUMS, OFTEN = -1, -2


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed: whole numbers in the narrowest kind that holds them, hashes (ascending) as differences, byte by byte."""
    narrow = []
    for a in arrays:
        if a.dtype == np.int64:
            a = a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
        elif a.dtype == np.uint64:
            a = np.diff(a, prepend=np.zeros(1, np.uint64)).view(np.uint8).reshape(-1, 8).T.copy()
        narrow.append(a)
    return zstandard.compress(pickle.dumps(narrow, 5), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for a in pickle.loads(zstandard.decompress(blob)):
        if a.ndim == 2:
            a = np.cumsum(np.ascontiguousarray(a.T).view(np.uint64).ravel(), dtype=np.uint64)
        elif a.dtype.kind == "u":
            a = a.astype(np.int64)
        out.append(a)
    return out


def discounts(seen: np.ndarray) -> np.ndarray:
    """What a count of 1 to K loses, from the numbers of things counted 1 to K + 1 times."""
    n = seen.astype(float)
    out = np.full(K, 0.5)
    rest = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        if n[r - 1] and n[r] and rest < 1:
            d = ((r + 1) * n[r] / n[r - 1] / r - rest) / (1 - rest)
            if 0.01 < d < 0.9999:
                out[r - 1] = r * (1 - d)
    return out


def loss_of(c: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """What each count loses; 0 of 0."""
    return np.concatenate([[0.0], lost, [TAIL]])[np.minimum(c, K + 1)]


class Words:
    """Probabilities of single tokens by their count."""

    def __init__(self, m: np.ndarray):
        """m: numbers of words counted 1 to K + 1 times, of words, of tokens."""
        self.lost, self.v, self.n = discounts(m[: K + 1]), int(m[K + 1]), int(m[K + 2])
        beyond = self.v - m[:K].sum()
        gone = (m[:K] * self.lost).sum() + beyond * TAIL
        self.unknown = gone / self.n if self.n else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (c - loss_of(c, self.lost)) / max(self.n, 1), self.unknown)


class Group:
    """Tokens of some texts: v, their contexts, and the different words and pairs among them."""

    def __init__(self, v: np.ndarray, n: np.ndarray, held: np.ndarray, ids: list):
        self.n, self.held, self.ids = n, held, ids
        self.word, self.at = np.unique(v, return_inverse=True)
        self.trains = np.repeat(~held, n)

    def counts(self) -> np.ndarray:
        return np.bincount(self.at[self.trains], minlength=len(self.word))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context and word of each different pair (the start is one more than the words), the pair of each token, and the training count of each pair."""
        before = np.concatenate([[0], self.at[:-1]])
        before[np.concatenate([[0], np.cumsum(self.n)[:-1]])] = len(self.word)
        code, which = np.unique(before * (len(self.word) + 1) + self.at, return_inverse=True)
        return code // (len(self.word) + 1), code % (len(self.word) + 1), which, np.bincount(which[self.trains], minlength=len(code))

    def context_hashes(self) -> np.ndarray:
        return np.append(self.word, START)


def groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Group]:
    """The same groups each time that a partition is read."""
    v, n, held, ids, size = [], [], [], [], 0
    for batch in slices(batches, "text"):
        data, offsets = raw(batch.column("text"))
        data = LOWER[data]
        starts, ends, bounds = words(data, offsets)
        v.append(np.insert(word_hashes(data, starts, ends), bounds[1:], END))
        n.append(np.diff(bounds) + 1)
        held.append(batch.column("held").to_numpy(zero_copy_only=False).astype(bool))
        ids.append(batch.column("id"))
        size += len(v[-1])
        if size >= most:
            yield Group(np.concatenate(v), np.concatenate(n), np.concatenate(held), ids)
            v, n, held, ids, size = [], [], [], [], 0
    if v:
        yield Group(np.concatenate(v), np.concatenate(n), np.concatenate(held), ids)


def _row(pid: int, g: int, part: int, blob: bytes | None = None, u: int | None = None, m=None, b: float | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"pid": [pid], "g": [g], "part": [part], "blob": [blob], "u": [u], "m": [m], "b": [b]}, schema=SCHEMA)


def _cuts(part: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(part, np.arange(parts + 1))


def _word_order(g: Group, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The different words by part and hash, and where each part begins."""
    part = (g.word % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, _cuts(part[order], parts)


def _answers(folder: str, pid: int) -> dict[int, dict[int, bytes]]:
    """By group and part what a table answers to an input partition, still packed."""
    files, path = pyarrow.fs.FileSystem.from_uri(f"{folder}/pid={pid}")
    out: dict[int, dict[int, bytes]] = {}
    if files.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return out
    for info in files.get_file_info(pyarrow.fs.FileSelector(path)):
        if info.base_name.endswith(".parquet"):
            t = pyarrow.parquet.read_table(info.path, filesystem=files, columns=["g", "part", "blob"], partitioning=None)
            for g, part, blob in zip(t["g"].to_pylist(), t["part"].to_pylist(), t["blob"].to_pylist()):
                out.setdefault(g, {})[part] = blob
    return out


def _sum(x: np.ndarray) -> np.ndarray:
    """A checksum of what is asked, as an array of one."""
    return np.array([int(mix(x * np.uint64(BASE)).sum(dtype=np.uint64)) >> 1], np.int64)


def _fit(asked: np.ndarray, answered: np.ndarray, size: int) -> None:
    """An answer must have the size and the checksum of its question: texts that come in other groups are an error, never a wrong score."""
    if len(asked) != size or _sum(asked)[0] != answered[0]:
        raise RuntimeError("the texts came in other partitions than before: use stored=False")


def _word_counts(g: Group, answers: dict[int, bytes], parts: int) -> np.ndarray:
    order, cut = _word_order(g, parts)
    out = np.zeros(len(order), np.int64)
    for p in range(parts):
        own = order[cut[p] : cut[p + 1]]
        got, check = unpack(answers[p]) if p in answers else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        if len(own) or len(got):
            _fit(g.word[own], check, len(got))
        out[own] = got
    return out


def _pair_order(g: Group, c: np.ndarray, parts: int, often: float) -> tuple:
    """The pairs by part, context and word; where each part begins; context, word, training count of each; and the pair of each token."""
    u, v, which, n = g.pairs()
    hashes = g.context_hashes()
    total = _contexts(g, c)
    over = np.maximum(np.ceil(total[u] / often), 1).astype(np.uint64)
    part = ((hashes[u] % np.uint64(parts) + mix(hashes[u] * np.uint64(BASE) + g.word[v]) % over) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return u[order], v[order], n[order], _cuts(part[order], parts), place[which]


def _contexts(g: Group, c: np.ndarray) -> np.ndarray:
    """How often each word, and at the end the start, is a context in training: a word as often as it stands, the start as often as the end does."""
    at = np.searchsorted(g.word, END)
    return np.append(np.where(g.word == END, 0, c), c[at] if at < len(c) and g.word[at] == END else 0)


def _part_rows(batches: Iterator[pa.RecordBatch]) -> tuple[list[tuple], list[list[np.ndarray]]]:
    where, blobs = [], []
    for batch in batches:
        for pid, g, part, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
            where.append((pid, g, part))
            blobs.append(unpack(blob))
    return where, blobs


def _stored(df: DataFrame, parts: int) -> str:
    """Writes answers, by the input partition that asked; gives the folder."""
    folder = f"{shared_dir(df.sparkSession)}/counts-{uuid.uuid4().hex}"
    df.repartitionById(parts, F.pmod(F.col("pid"), F.lit(parts))).write.partitionBy("pid").parquet(folder)
    return folder


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; held_out: a condition on the rows that don't train."""
    spark = docs.sparkSession
    importable(spark)
    parts, most = int(spark.conf.get("spark.sql.shuffle.partitions")), GROUP
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    if not stored:
        rows = table(rows)

    # 1. words

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        for number, g in enumerate(groups(batches, most)):
            order, cut = _word_order(g, parts)
            n = g.counts()
            for p in range(parts):
                own = order[cut[p] : cut[p + 1]]
                if len(own):
                    yield _row(pid, number, p, pack(g.word[own], n[own]))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, blobs = _part_rows(batches)
        if not blobs:
            return
        _, at = np.unique(np.concatenate([w for w, _ in blobs]), return_inverse=True)
        c = np.bincount(at, np.concatenate([n for _, n in blobs])).astype(np.int64)
        yield _row(SUMS, 0, where[0][2], m=[*np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2].tolist(), int((c > 0).sum()), int(c.sum())])
        first = 0
        for (pid, g, part), (w, _) in zip(where, blobs):
            yield _row(pid, g, part, pack(c[at[first : first + len(w)]], _sum(w)))
            first += len(w)

    asked = rows.mapInArrow(ask_words, ANSWER).repartitionById(parts, F.col("part"))
    word_folder = _stored(asked.mapInArrow(count_words, ANSWER), parts)

    def sums(folder: str, n: int) -> np.ndarray:
        got = spark.read.schema(ANSWER).parquet(folder).where(F.col("pid") == SUMS).agg(*[F.coalesce(F.sum(F.col("m")[i]), F.lit(0)) for i in range(n)]).first()
        return np.array(got, np.int64)

    single = Words(sums(word_folder, K + 3))
    often = max(single.n / (8 * parts), 1.0)

    # 2. pairs

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        answers = _answers(word_folder, pid)
        for number, g in enumerate(groups(batches, most)):
            c = _word_counts(g, answers.get(number, {}), parts)
            u, v, n, cut, _ = _pair_order(g, c, parts, often)
            hashes, total = g.context_hashes(), _contexts(g, c)
            for p in range(parts):
                own = slice(cut[p], cut[p + 1])
                if cut[p] < cut[p + 1]:
                    context, run = np.unique(u[own], return_counts=True)
                    word, place = np.unique(v[own], return_inverse=True)
                    yield _row(pid, number, p, pack(hashes[context], run, (total[context] > often).astype(np.int64), g.word[word], c[word], place, n[own]))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, blobs = _part_rows(batches)
        if not blobs:
            return
        u = np.concatenate([np.repeat(b[0], b[1]) for b in blobs])
        v = np.concatenate([b[3][b[5]] for b in blobs])
        cv = np.concatenate([b[4][b[5]] for b in blobs])
        wide = np.concatenate([np.repeat(b[2], b[1]) for b in blobs])
        _, first, at = np.unique(mix(u * np.uint64(BASE) + v), return_index=True, return_inverse=True)
        c = np.bincount(at, np.concatenate([b[6] for b in blobs])).astype(np.int64)
        yield _row(SUMS, 0, where[0][2], m=np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2].tolist())
        seen = first[c > 0]
        context, of = np.unique(u, return_inverse=True)
        own = of[seen]
        level = np.minimum(c[c > 0], K + 1) - 1
        m = np.bincount(own * (K + 1) + level, minlength=len(context) * (K + 1)).reshape(-1, K + 1)
        b = np.bincount(own, single(cv[seen]), len(context))
        spread = np.zeros(len(context), bool)
        spread[of] = wide == 1
        for i in np.flatnonzero(spread).tolist():
            yield _row(OFTEN, 0, where[0][2], u=int(context[i : i + 1].view(np.int64)[0]), m=m[i].tolist(), b=float(b[i]))
        at_pair = 0
        for (pid, g, part), blob in zip(where, blobs):
            i = np.searchsorted(context, blob[0])
            yield _row(pid, g, part, pack(c[at[at_pair : at_pair + len(blob[5])]], *m[i].T, b[i], _sum(blob[0])))
            at_pair += len(blob[5])

    asked = rows.mapInArrow(ask_pairs, ANSWER).repartitionById(parts, F.col("part"))
    pair_folder = _stored(asked.mapInArrow(count_pairs, ANSWER), parts)
    lost = discounts(sums(pair_folder, K + 1))
    common = spark.read.schema(ANSWER).parquet(pair_folder).where(F.col("pid") == OFTEN)
    few = common.groupBy("u").agg(*[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(K + 1)], F.sum("b").alias("b")).collect()  # at most 8 times as many as parts
    wide_u = np.array([r.u for r in few], np.int64).view(np.uint64)
    wide = np.array([[*r[1:]] for r in few], np.float64).reshape(-1, K + 2)[np.argsort(wide_u)]
    wide_u = np.sort(wide_u)

    # 3. tokens

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        of_words, of_pairs = _answers(word_folder, pid), _answers(pair_folder, pid)
        for number, g in enumerate(groups(batches, most)):
            c = _word_counts(g, of_words.get(number, {}), parts)
            u, v, n, cut, which = _pair_order(g, c, parts, often)
            got = of_pairs.get(number, {})
            hashes, total = g.context_hashes(), _contexts(g, c)
            pair = np.zeros(len(u), np.int64)
            gone, held = np.zeros(len(hashes)), np.zeros(len(hashes))
            weights = np.concatenate([lost, [TAIL]])
            for p in range(parts):
                own = slice(cut[p], cut[p + 1])
                if cut[p] == cut[p + 1]:
                    continue
                context = np.unique(u[own])
                if p not in got:
                    raise RuntimeError("the texts came in other partitions than before: use stored=False")
                blob = unpack(got[p])
                _fit(hashes[context], blob[-1], len(blob[1]))
                if cut[p + 1] - cut[p] != len(blob[0]):
                    raise RuntimeError("the texts came in other partitions than before: use stored=False")
                pair[own] = blob[0]
                gone[context] = sum(w * m for w, m in zip(weights, blob[1 : K + 2]))
                held[context] = blob[K + 2]
            if len(wide_u):
                i = np.minimum(np.searchsorted(wide_u, hashes), len(wide_u) - 1)
                hit = (wide_u[i] == hashes) & (total > often)
                gone[hit], held[hit] = wide[i[hit], : K + 1] @ weights, wide[i[hit], K + 1]
            some = np.maximum(total, 1)
            alpha = np.where(total > 0, gone / some / np.maximum(1 - held, single.unknown), 1.0)
            p_word = single(c)
            known = pair > 0
            p = np.where(known, (pair - loss_of(pair, lost)) / some[u], alpha[u] * p_word[v])
            start = np.concatenate([[0], np.cumsum(g.n)[:-1]])
            base = np.log10((c + 1) / (single.n + single.v + 1))
            yield pa.RecordBatch.from_pydict({
                "id": pa.concat_arrays(g.ids), "held_out": pa.array(g.held), "n_tokens": pa.array(g.n.astype(np.int64)), "n_known": pa.array(np.add.reduceat((c > 0)[g.at].astype(np.int64), start)),
                "train_tokens": pa.array(np.full(len(g.n), single.n)), "base_score": pa.array(np.add.reduceat(base[g.at], start)), "score": pa.array(np.add.reduceat(np.log10(p)[which], start)),
            })

    return rows.mapInArrow(evaluate, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
