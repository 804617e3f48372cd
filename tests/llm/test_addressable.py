"""op9: exact round trips, random access, brute force against the library."""

import urllib.parse
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioscope.llm import addressable as A
from folioscope.llm.common import runs as plain_runs
from folioscope.llm.tokens import tokenizer_path

ROWS = [(3, "A word, two  words\n\nCafé 日本 😀 it's"), (1, ""), (2, None), (None, "x"), (7, "same same"), (7, "other"), (4, "longer " * 3000)]


@pytest.mark.parametrize("n", [1, 7, 8, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [10, 300, 70_000, 2**32 - 1])
def test_every_position(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    s = A.Segment(A.build([5, None], np.array([n // 2, n - n // 2]), ids))
    assert (s.take(np.arange(n)) == ids).all() and s.doc_ids == [5, None]
    for b, e in ((0, n), (n // 3, n // 2), (n - 1, n)):
        assert (s.slice(b, e) == ids[b:e]).all()
    bounds = np.unique([0, n // 5, n // 3, n // 3 + 1, n - 1, n])
    assert [x.tolist() for x in s.slices(bounds)] == [ids[b:e].tolist() for b, e in zip(bounds, bounds[1:], strict=False)]


def test_against_library(spark):
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(*r, "extra") for r in ROWS], "doc_id long, text string, start string")
    got = A.read_back(A.write(docs, tokenizer_path("word_bpe_49k.json"))).orderBy("start").collect()
    at, want = 0, []
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 7, 7]
    for d, x in ROWS:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)


def test_files_by_offset(spark, monkeypatch):
    """Any id of a written file is reached with a few bytes, and the files hold the documents in order."""
    monkeypatch.setattr(A, "runs", lambda sizes: plain_runs(sizes, 3000))
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [(k, f"text {k} of many words, " * (k % 40)) for k in range(200)]
    files = A.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer_path("word_bpe_49k.json")).orderBy("part", "file").collect()
    want = [i for _, x in rows for i in [*t.encode(x, add_special_tokens=False).ids, 1]]
    at = 0
    for f in files:
        with open(urllib.parse.unquote(f.path.removeprefix("file:")), "rb") as source:
            assert source.read() == bytes(f.content) and len(list(A.segments(bytes(f.content)))) > 1
            reader = A.FileReader(source)
            assert reader.n_ids == f.ids
            for k in [0, 1, f.ids // 2, *range(7, f.ids, 97), f.ids - 1]:
                before = reader.bytes_read
                assert reader[k] == want[at + k] and reader.bytes_read - before <= 2 * (1 + 64 + 4)
            with pytest.raises(IndexError):
                reader[f.ids]
        at += f.ids
    assert at == len(want)


def test_contents_in_bounded_values(spark):
    """A partition of many codes is several files, none of them large, and what joins on the way back are small rows, not contents."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        docs = spark.range(300).selectExpr("id AS doc_id", "repeat('many, words of 7 and ', 7000) AS text")
        files = A.write(docs, tokenizer_path("word_bpe_49k.json"))
        rows = files.selectExpr("part", "file", "before", "ids", "length(content) AS n").orderBy("part", "file").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert {r.part for r in rows} == {0} and sum(r.n for r in rows) > 20 << 20 and max(r.n for r in rows) < 8 << 20
    assert [r.before for r in rows] == [sum(x.ids for x in rows[:k]) for k in range(len(rows))]
    read = A.read_back(files)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")
    first, *more = read.orderBy("start").collect()
    assert len(more) == 299 and all(r.n_tokens == first.n_tokens and r.ids_crc32 == first.ids_crc32 and r.start == r.doc_id * first.n_tokens for r in more)


def test_empty_table(spark):
    assert A.read_back(A.write(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path("word_bpe_49k.json"))).count() == 0


def test_word_encoder_on_made_up_texts():
    import random

    from folioscope.llm.tokens import WordEncoder

    path, rng = tokenizer_path("word_bpe_49k.json"), random.Random(9)
    library, code = Tokenizer.from_file(path), WordEncoder(path)
    parts = ["a", "B", " ", "\n", "\t", "\x85", "\xa0", ".", ",", "'s", "'", "é", "E\N{COMBINING ACUTE ACCENT}", "word.", ",\N{COMBINING ACUTE ACCENT}.", "日", "1", "#", "\x01", "\x1c", "<|endoftext|>", "<|startoftext|>", "ß", "Σ", "İ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000)] + ["", "x" * 3000]
    for k in range(0, len(texts), 150):
        part = texts[k : k + 150]
        ids, n = code.encode_run(part)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
