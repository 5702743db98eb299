"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The vocabulary is a JSON file of the tokenizers library of this make: NFC, runs of white space to one space, lower case;
contractions, runs of letters, single numbers and runs of other signs as words; bytes as signs; an end-of-word suffix.

1. The words of all texts are counted, and the LEXICON most frequent ones taken (bounded by that parameter).
2. They are compiled into the minimal acyclic automaton, suffixes shared, each edge with a number to add: the sum along
   a word's path is its row in a table of id lists. Automaton and table are one file in the shared folder, which the
   workers map into memory.
3. Every slice of texts is cut into words by array operations; its different words walk the automaton all at once; words
   that it doesn't hold are merged pair by pair, lowest rank first, as the ranks demand, and kept in a bounded cache.

Ids don't depend on what the lexicon holds. Special tokens are found in the raw text and encoded as such.

Defined cases: null text is empty text; an empty text has no ids and decodes to an empty text; null and repeated ids are
carried along; other columns are passed over; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._shared import SMALL_BYTES, importable, reliable, shared_dir, slices
from tessella.llm._tokens import BASE, INVERSE, mix, powers

LEXICON, CACHE = 65_536, 200_000
#: Longest word, in bytes, that the lexicon takes.
LONGEST = 48
SPACE, LETTER, NUMBER, OTHER = range(4)


def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


_TABLE: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return _TABLE[0]


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """Tokens by id, ids of the bytes inside and at the end of a word, and the merges: pair -> (rank, id)."""

    tokens: list[str]
    inside: list[int]
    at_end: list[int]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            x = json.load(file)
        model, steps = x["model"], [n["type"] for n in x["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"] or x["decoder"] or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in x["added_tokens"]):
            raise ValueError(f"{path}: a vocabulary of another make")
        ids, end, signs = model["vocab"], model["end_of_word_suffix"], byte_signs()
        special = {t["content"]: t["id"] for t in x["added_tokens"]}
        tokens = [""] * (1 + max([*ids.values(), *special.values()]))
        for t, i in [*ids.items(), *special.items()]:
            tokens[i] = t
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls(tokens, [ids[s] for s in signs], [ids[s + end] for s in signs], {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}, special)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the adjacent pair of lowest rank, the leftmost of them, is merged until none is left."""
        ids, rank = [*(self.inside[b] for b in word[:-1]), self.at_end[word[-1]]], self.merges
        if len(ids) > 64:
            return self._merge_long(ids)
        found = [rank.get(p) for p in zip(ids, ids[1:])]
        while True:
            best, at = None, -1
            for i, m in enumerate(found):
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = rank.get((ids[at - 1], ids[at]))
            if at < len(ids) - 1:
                found[at] = rank.get((ids[at], ids[at + 1]))


    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        rank, n = self.merges, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, p, m[1]) for i, p in enumerate(zip(ids, ids[1:])) if (m := rank.get(p))]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b), new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, (ids[x], ids[y]), m[1]))
        return [i for i in ids if i >= 0]


class Lexicon:
    """The minimal acyclic automaton of a set of words, with numbers on its edges, and each word's list of ids."""

    ARRAYS = (("keys", np.int64), ("to", np.int32), ("add", np.int32), ("final", np.uint8), ("begin", np.int32), ("ids", np.int32))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__ |= arrays

    @classmethod
    def compile(cls, words: list[bytes], ids: list[list[int]]) -> Lexicon:
        """words sorted and distinct; ids of each."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, edges) of finished states

        def finish(final: bool, edges: list[tuple[int, int]]) -> int:
            key = final, tuple(edges)
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        open_: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]  # states along the last word
        last = b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            for at in range(len(last), common, -1):
                done = finish(*open_.pop())
                open_[-1][1].append((last[at - 1], done))
            open_ += [(False, []) for _ in word[common:]]
            open_[-1] = (True, open_[-1][1])
            last = word
        for at in range(len(last), 0, -1):
            done = finish(*open_.pop())
            open_[-1][1].append((last[at - 1], done))
        root = finish(*open_.pop())
        below = [0] * len(states)  # words that end in or below a state; children are finished before their parents
        keys, to, add = [], [], []
        for s, (final, edges) in enumerate(states):
            n = int(final)
            for b, t in edges:
                keys.append(s * 256 + b)
                to.append(t)
                add.append(n)
                n += below[t]
            below[s] = n
        begin = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        flat = [i for x in ids for i in x]
        finals = [f for f, _ in states]
        return cls(keys=np.array([*keys, 1 << 62], np.int64), to=np.array([*to, 0], np.int32), add=np.array([*add, 0], np.int32), final=np.array([*finals, root & 255, root >> 8 & 255, root >> 16 & 255, root >> 24], np.uint8), begin=begin.astype(np.int32), ids=np.array(flat, np.int32))

    def dump(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, n), t) for n, t in self.ARRAYS]
        head = np.array([len(a) for a in arrays], np.int64)
        return head.tobytes() + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def map(cls, path: str) -> Lexicon:
        """The arrays of a file, mapped into memory and not read before they are used."""
        data = np.memmap(path, np.uint8, "r")
        sizes, at, found = data[: 8 * len(cls.ARRAYS)].view(np.int64), 8 * len(cls.ARRAYS), {}
        for (name, kind), n in zip(cls.ARRAYS, sizes.tolist()):
            size = n * np.dtype(kind).itemsize
            found[name] = data[at : at + size].view(kind)
            at += size + -size % 8
        return cls(**found)

    def rows(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The row of each word (bytes of data), -1 for words that it doesn't hold; all words take one step at a time."""
        root = int(np.ascontiguousarray(self.final[-4:]).view(np.uint32)[0])
        state, total = np.full(len(starts), root, np.int64), np.zeros(len(starts), np.int64)
        alive = np.flatnonzero((size > 0) & (size <= LONGEST))
        out = np.full(len(starts), -1, np.int64)
        step = 0
        while len(alive):
            ended = size[alive] == step
            stop = alive[ended]
            good = stop[self.final[state[stop]] == 1]
            out[good] = total[good]
            alive = alive[~ended]
            key = state[alive] * 256 + data[starts[alive] + step]
            edge = np.searchsorted(self.keys, key)
            known = self.keys[edge] == key
            alive, edge = alive[known], edge[known]
            state[alive] = self.to[edge]
            total[alive] += self.add[edge]
            step += 1
        return out


def lower(text: str) -> str:
    """NFC, then each sign lower-cased by itself: no final sigma."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def cut(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts (as lower gives them) as one, and in code points the start and end of each word, and the words before each text."""
    whole = "\n".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[points]
    if not len(points):
        none = np.zeros(0, np.int64)
        return whole, none, none, np.zeros(len(texts) + 1, np.int64)
    new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(points))
    # an apostrophe alone before s, t, m, d, re, ve or ll takes these letters
    first = np.flatnonzero((points[starts] == 0x27) & (ends - starts == 1) & (ends < len(points)))
    if len(first):
        a, b = points[np.minimum(ends[first], len(points) - 1)], points[np.minimum(ends[first] + 1, len(points) - 1)]
        two = (ends[first] + 1 < len(points)) & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
        take = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, np.where(two, 2, 0))
        ends[first] += take
        starts[first[take > 0] + 1] += take[take > 0]
    good = (kind[np.minimum(starts, len(points) - 1)] != SPACE) & (starts < ends)
    starts, ends = starts[good], ends[good]
    size = np.array([len(t) + 1 for t in texts])
    return whole, starts, ends, np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))


def different(whole: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a text: where each different one stands first, how often, and which of them each word is."""
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points + np.uint64(0x51ED)) * powers(BASE, len(points)))])
    hashes = mix((total[ends] - total[starts]) * powers(INVERSE, len(points) + 1)[starts] + (ends - starts).astype(np.uint64))
    _, at, which, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    return at, n, which


def count_words(docs: DataFrame, text_col: str = "text", special: tuple[str, ...] = ()) -> DataFrame:
    """(word binary, n) over all texts."""
    importable(docs.sparkSession)
    marks = re.compile("|".join(map(re.escape, special))) if special else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL_BYTES):
            texts = [t for t in batch.column(0).to_pylist() if t]
            if marks:
                texts = [p for t in texts for p in (marks.split(t) if "<|" in t else (t,))]
            whole, starts, ends, _ = cut([*map(lower, texts)])
            at, n, _ = different(whole, starts, ends)
            words = [whole[a:b].encode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "n": pa.array(n.astype(np.int64))})

    each = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def share(spark: SparkSession, data: bytes, name: str) -> str:
    """Writes bytes into the shared folder; gives a path that every executor can open, or the name of a file that Spark hands out."""
    uri = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(data)
    finally:
        out.close()
    if uri.startswith("file:"):
        return re.sub("^file:/*", "/", uri)
    spark.sparkContext.addFile(uri)
    return name


def lexicon(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", size: int = LEXICON) -> Lexicon:
    """The lexicon of the most frequent words of all texts: every word at least as frequent as the bar that lets at most size words in.

    The bar is found in the histogram of counts, so the driver gets no more than size words and no candidates.
    """
    counted = reliable(count_words(docs, text_col, tuple(vocabulary.special)).where((F.octet_length("word") <= LONGEST) & (F.col("n") > 1)))
    upto = F.sum("words").over(Window.orderBy(F.desc("n")))  # as many rows as different counts: under the root of twice the words
    bar = counted.groupBy("n").agg(F.count("*").alias("words")).select("n", upto.alias("upto")).where(F.col("upto") <= size).agg(F.min("n")).first()[0]
    words = sorted(bytes(r.word) for r in counted.where(F.col("n") >= (bar or 1 << 62)).collect())  # bounded by size
    return Lexicon.compile(words, [vocabulary.merge(w) for w in words])


class Coder:
    """Encodes slices of texts in a worker."""

    def __init__(self, vocabulary: Vocabulary, known: Lexicon):
        self.vocabulary, self.known, self.cache = vocabulary, known, {}
        self.marks = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids before each."""
        pieces, owner, marks = [], [], {}
        for n, t in enumerate(texts):
            for p in self.marks.split(t) if self.marks and "<|" in t else (t,):
                if p in self.vocabulary.special:
                    marks[len(pieces)] = self.vocabulary.special[p]
                    p = ""
                pieces.append(lower(p))
                owner.append(n)
        whole, starts, ends, bounds = cut(pieces)
        at, _, which = different(whole, starts, ends)
        words = [whole[a:b].encode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        size = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        rows = self.known.rows(np.frombuffer(b"".join(words), np.uint8), begin[:-1], size)
        unseen = np.flatnonzero(rows < 0)
        merged = []
        for i in unseen.tolist():
            got = self.cache.get(words[i])
            if got is None:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                got = self.cache[words[i]] = self.vocabulary.merge(words[i])
            merged.append(got)
        # the lexicon's table, then the merged words, then the special tokens
        table = self.known.ids
        more = np.array([i for x in merged for i in x] + [*marks.values()], np.int64)
        first = np.zeros(len(words) + len(marks), np.int64)
        length = np.ones(len(words) + len(marks), np.int64)
        held = np.flatnonzero(rows >= 0)
        first[held] = self.known.begin[rows[held]]
        length[held] = self.known.begin[rows[held] + 1] - first[held]
        sizes = np.array([len(x) for x in merged], np.int64)
        length[unseen] = sizes
        first[unseen] = len(table) + np.concatenate([[0], np.cumsum(sizes)])[:-1]
        first[len(words) :] = len(table) + sizes.sum() + np.arange(len(marks))
        owner, piece = np.array(owner, np.int64), np.repeat(np.arange(len(pieces)), np.diff(bounds))
        if marks:
            spots = np.array([*marks], np.int64)
            place = np.searchsorted(piece, spots)
            which = np.insert(which, place, len(words) + np.arange(len(marks)))
            piece = np.insert(piece, place, spots)
        n = length[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        index = np.repeat(first[which] - upto[:-1], n) + np.arange(upto[-1])
        ids = np.zeros(len(index), np.uint32)
        low = index < len(table)
        ids[low] = table[index[low]]
        ids[~low] = more[index[~low] - len(table)]
        return ids, upto[np.searchsorted(owner[piece], np.arange(len(texts) + 1))]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.vocabulary.tokens[i] for i in ids])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = LEXICON, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens long, ids_sha256, decoded_sha256), with_ids also ids array<int> and decoded, of every row.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the decoded text in UTF-8.
    """
    spark = docs.sparkSession
    importable(spark)
    vocabulary = Vocabulary.load(path)
    where = share(spark, lexicon(docs, vocabulary, text_col, size).dump(), f"lexicon-{uuid.uuid4().hex}.bin")
    held = spark.sparkContext.broadcast(vocabulary)  # the vocabulary file, of fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value, Lexicon.map(where if where.startswith("/") else SparkFiles.get(where)))
        for batch in slices(batches, "text", SMALL_BYTES):
            ids, upto = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            data, to, every = ids.astype("<u4").tobytes(), upto.tolist(), ids.tolist()
            decoded = [coder.decode(every[a:b]) for a, b in zip(to, to[1:])]
            got = {"id": batch.column("id"), "n_tokens": pa.array(np.diff(upto)), "ids_sha256": [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(to, to[1:])], "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded]}
            if with_ids:
                got |= {"ids": pa.ListArray.from_arrays(upto.astype(np.int32), ids.astype(np.int32)), "decoded": decoded}
            yield pa.RecordBatch.from_pydict(got)

    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
