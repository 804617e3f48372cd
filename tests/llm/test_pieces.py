"""op1: N-best scores against all segmentations, decoding, and the table's columns."""

import random
import resource
import time
import zlib

import numpy as np
import pytest
import sentencepiece

from folioscope.llm import pieces as S
from folioscope.llm.tokens import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
PARTS = ["a", "b", "th", "e", " ", "  ", "\n", "é", "日", "😀", ".", ",", "'s", "ing", "The", "\t", "1", "##"]


@pytest.fixture(scope="module")
def model():
    return S.Lattice(PATH, 3)


def all_paths(model, text):
    """Scores and ids of every segmentation."""
    found = {0: [(0.0, ())]}
    for j in range(1, len(text) + 1):
        found[j] = []
        for i in range(max(0, j - 20), j):
            if text[i:j] in model.pieces:
                s, k = model.pieces[text[i:j]]
                found[j] += [(a + s, (*p, k)) for a, p in found[i]]
        if text[j - 1] not in model.pieces:
            found[j] += [(a + model.unknown, (*p, *model.spell(text[j - 1]))) for a, p in found[j - 1]]
    return sorted(found[len(text)], key=lambda x: -x[0])


def test_search_against_all_segmentations(model):
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 6))).replace(" ", S.SPACE)[:12]
        want = all_paths(model, text)
        got = model.search(text, 5)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:5]], rel=1e-12)
        assert len({p for _, p in got}) == len(got) and all((pytest.approx(s, rel=1e-12), p) in [(s2, p2) for s2, p2 in want] for s, p in got)


def test_search_looks_up_no_piece_again(model, monkeypatch):
    """The backward search takes the edges that the forward pass has met; it looked up every possible length at every node it took."""

    class Counted(dict):
        looked_up = 0

        def get(self, *key):
            Counted.looked_up += 1
            return dict.get(self, *key)

    texts = ["▁segmentations,", "▁日本thing", "x" * 50, "####"]
    want = [model.search(t, 3) for t in texts]
    monkeypatch.setattr(model, "pieces", Counted(model.pieces))
    assert [model.search(t, 3) for t in texts] == want and Counted.looked_up == 0


@pytest.mark.parametrize("whole", [True, False])
def test_search_without_listed_edges(model, monkeypatch, whole):
    """Longer segments look their edges up instead; paths, scores and ties are the same, with scores that need rounding too."""
    rng = random.Random(6)
    if not whole:
        real = {p: (-rng.choice([0.1, 0.2, 0.3, 9 * rng.random()]), k) for p, (_, k) in model.pieces.items()}
        for name, value in [("pieces", real), ("prefixes", model.prefixes | real), ("unknown", -20.0), ("whole", False)]:
            monkeypatch.setattr(model, name, value)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 40))).replace(" ", S.SPACE) for _ in range(300)] + ["=" * 90, "a" * 90]
    listed = [model.search(t, 4) for t in texts]
    for text, found in zip(texts, listed, strict=True):
        if len(text) <= 10:
            assert [s for s, _ in found] == pytest.approx([s for s, _ in all_paths(model, text)[:4]], rel=1e-12)
    monkeypatch.setattr(S, "LISTED", 0)
    assert [model.search(t, 4) for t in texts] == listed


def test_segments_against_the_whole_lattice(model):
    rng = random.Random(2)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(400)] + ["", "x" * 3000, "\0 a\0", "▁a▁▁b"]
    for (ids, paths), text in zip(model.segment(texts), texts, strict=True):
        want = model.search(model.library.normalize(text) if text else "", 3)
        assert [s for s, _ in paths] == pytest.approx([s for s, _ in want], rel=1e-9)
        assert len(ids) == paths[0][1]
        if "▁" not in text:
            assert model.decode(ids.tolist()) == text


def test_library_encoding_and_decoding(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(1, "Hello  world\n\nfoo é日本 😀"), (2, None), (3, ""), (None, " lead"), (5, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    coded = S.encode(docs, PATH)
    assert {str(r.doc_id): r.ids for r in coded.collect()} == {str(d): sp.encode(t or "") for d, t in rows}
    back = {str(r.doc_id): r.text for r in S.decode(coded, PATH).collect()}
    assert back == {str(d): t or "" for d, t in rows}


def test_table(spark, model):
    rows = [(1, "Some text. And more"), (2, None), (3, ""), (None, "x"), (5, "word " * 9000), (5, "word " * 9000)]
    got = S.segment(spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, score string"), PATH).collect()
    assert len(got) == 6
    for r in got:
        text = next(t or "" for d, t in rows if d == r.doc_id)
        want = model.search(model.library.normalize(text), 3) if text else [(0.0, ())]
        assert r.path_scores == pytest.approx([s for s, _ in want], rel=1e-9) and r.score == r.path_scores[0] and r.restored
        assert r.n_bytes == len(text.encode()) and r.n_pieces == len(want[0][1])
        if len(text) < 100:
            assert r.ids_crc32 == zlib.crc32(np.array(want[0][1], "<u4").tobytes())
    assert S.segment(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_runs_of_one_character(model):
    """All paths of a run tie with others; the search stays in proportion to its length."""
    for c in "=a":
        began = time.time()
        (ids, paths), = model.segment([c * 20_000])
        assert time.time() - began < 10 and len(paths) == 3 and model.decode(ids) == c * 20_000
    want = sorted((s for s, _ in all_paths(model, "=" * 14)), reverse=True)
    assert [s for s, _ in model.search("=" * 14, 40)] == pytest.approx(want[:40])


def test_long_texts_in_parts(model, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["one", "Two,", "x" * 30, "日本", "3.5", "line\n", "  "], k=k)) for k in (3, 90, 400)] + ["=" * 500 + " a" * 300]
    want = model.segment(texts)
    monkeypatch.setattr(S, "PART", 64)
    for (ids, paths), (ids2, paths2) in zip(model.segment(texts), want, strict=True):
        assert ids.tolist() == ids2.tolist() and [s for s, _ in paths] == pytest.approx([s for s, _ in paths2]) and paths[0] == paths2[0]
    assert all("".join(model.parts(t)) == t for t in texts)


def test_twenty_megabytes(model):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(5000)]
    text = " ".join(rng.choices(words, k=3_100_000))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    (ids, paths), = model.segment([text])
    assert len(ids) == paths[0][1] and model.decode(ids) == text
    assert time.time() - began < 90 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_200_000
