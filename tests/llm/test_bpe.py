import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, id string, n_tokens int"


def texts():
    r = random.Random(9)
    signs = ["a", "E", "é", "ß", "İ", "Σ", "σς", "́", "é", "'s", "'re ", "'", "''ll", "!'s", "l's's", "'VE", "'lx", "12", "½", "²", "٣", "_", "$$$", " ", "\n\t", "\xa0", "　", "​", "漢字", "\U0001f600", "ǅ", "K", "the", "tion", "|", "<|", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\x00", "\x85", "\x1f", "퟿", "가", "ｱ"]
    out = [None, "", " ", "'", "'s", "<|endoftext|>", "a<|endoftext|>B<|startoftext|><|endoftext|>"]
    out += ["".join(r.choices(signs, k=r.choice([1, 2, 5, 30]))) for _ in range(600)]
    out += [" ".join("".join(r.choices("abcdeionrst", k=r.randrange(1, 9))) for _ in range(n)) for n in (50, 50, 30_000)]
    return out + ["x" * 70_000 + " y", out[-1]]


def test_same_as_the_library(spark):
    rows = [(i, t, "z", 0) for i, t in enumerate(texts())] + [(None, "null id", "", 0), (3, "again", "", 0)]
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    want = []
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i if i is not None else -1, ids, t.decode(ids, skip_special_tokens=False)))
    got = [(r.id if r.id is not None else -1, r.ids, r.decoded, r) for r in bpe.encode(spark.createDataFrame(rows, SCHEMA).repartition(4), PATH, size=300, with_ids=True).collect()]
    got.sort(key=lambda x: x[:3])
    for a, b in zip(got, sorted(want)):
        assert a[:3] == b
        assert a[3].n_tokens == len(b[1]) and a[3].ids_sha256 == hashlib.sha256(np.array(b[1], "<u4").tobytes()).hexdigest()
        assert a[3].decoded_sha256 == hashlib.sha256(b[2].encode()).hexdigest()
    assert len(got) == len(want)


def test_lexicon_is_a_minimal_automaton(tmp_path):
    r = random.Random(1)
    words = sorted({bytes(r.choices(b"abc", k=r.randrange(1, 7))) for _ in range(400)})
    ids = [[n, n + 1][: 1 + n % 2] for n in range(len(words))]
    path = tmp_path / "x"
    path.write_bytes(bpe.Lexicon.compile(words, ids).dump())
    x = bpe.Lexicon.map(str(path))
    asked = [*words, b"d", b"abcabcabc", b"", *(w + b"c" for w in words)]
    begin = np.cumsum([0] + [len(w) for w in asked])
    rows = x.rows(np.frombuffer(b"".join(asked), np.uint8), begin[:-1], np.diff(begin))
    place = {w: n for n, w in enumerate(words)}
    assert rows.tolist() == [place.get(w, -1) for w in asked]
    assert all(x.ids[x.begin[n] : x.begin[n + 1]].tolist() == ids[n] for n in range(len(words)))
    endings = {frozenset(v[len(w[:i]) :] for v in words if v.startswith(w[:i])) for w in words for i in range(len(w) + 1)}
    assert len(x.final) - 4 == len(endings)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_workers_hold_little_beside_a_large_batch(spark, monkeypatch):
    docs, taken = spark.createDataFrame([(1, "a word", "", 0)], SCHEMA), []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: taken.append(f) or real(self, f, schema))
    bpe.encode(docs, PATH)
    text = pa.array([" ".join(random.Random(i).choices(["a", "word", "of", "texts"], k=2_000)) for i in range(300)])
    for f, columns in zip(taken, ({"text": text}, {"id": pa.array(range(300)), "text": text}), strict=True):
        batch = pa.RecordBatch.from_pydict(columns)
        tracemalloc.start()
        try:
            assert sum(1 for _ in f(iter([batch])))
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert peak < 80 << 20
