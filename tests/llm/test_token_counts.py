"""op2: against the tokenizers library, on made-up text and on a table."""

import random
import resource
import time

import numpy as np
from tokenizers import Tokenizer

from folioscope.llm import token_counts as C
from folioscope.llm.tokens import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "\x85", "\xa0", "\N{IDEOGRAPHIC SPACE}", "'", "'s", "'ll", "'re", "the", " tokenization", "ing", "é", "e\N{COMBINING ACUTE ACCENT}", "日", "1", "\N{ARABIC-INDIC DIGIT THREE}", "!", "#", "😀", "\x1c", "<|endoftext|>", "ß", "Z"]


def test_random_texts_and_dropped_states():
    library, rng = Tokenizer.from_file(PATH), random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(4000)] + ["", "x" * 5000, "ab" * 3000, " " * 700]
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    for limit in (C.MAX_STATES, 50):
        t = C.Transducer(PATH, max_states=limit)
        assert np.concatenate([t.count(texts[k : k + 300]) for k in range(0, len(texts), 300)]).tolist() == want


def test_classes_agree_with_the_library_on_every_character():
    library, t = Tokenizer.from_file(PATH), C.Transducer(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b1{chr(c)} {chr(c)}\n" for c in points[k : k + 256]) for k in range(0, len(points), 256)]
    want = [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert t.count(texts).tolist() == want


def test_table(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(1, "one two"), (2, None), (None, ""), (3, "word " * 2000), (3, "word " * 2000)]
    got = C.count_tokens(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_tokens string"), PATH).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert C.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_long_pre_tokens_and_chunks(monkeypatch):
    """Runs over many chunks, with few states (maps are composed) and with many (walked one after the other), at all places of a chunk."""
    library, rng, t = Tokenizer.from_file(PATH), random.Random(6), C.Transducer(PATH)
    texts = ["a" * 3000, "=" * 4000, "ab" * 2000, "日" * 900, "".join(rng.choices("abcdefghijkl", k=5000)), "x " + "é" * 2100 + " end", "'" * 700]
    texts += ["q" * k + rng.choice([" ", "\n", "!"]) + "a" * rng.randint(0, 900) for k in range(200, 330)]
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert t.count(texts).tolist() == want and [int(t.count([x])[0]) for x in texts] == want
    for states, chunk in ((1, 256), (16, 16), (16, 7)):
        monkeypatch.setattr(C, "MAP_STATES", states)
        monkeypatch.setattr(C, "CHUNK", chunk)
        for limit in (C.MAX_STATES, 60):
            assert C.Transducer(PATH, t.classes, limit).count(texts).tolist() == want


def test_long_texts_are_cut_where_a_pre_token_begins(monkeypatch):
    library, rng, t = Tokenizer.from_file(PATH), random.Random(7), C.Transducer(PATH)
    text = "".join(rng.choices([*PARTS, " word", " it's", "\n\n"], k=6000))
    monkeypatch.setattr(C, "PART", 50)
    assert len(list(t.cut(text))) > 50 and "".join(t.cut(text)) == text
    assert t.count([text, "", text]).tolist() == [n := len(library.encode(text, add_special_tokens=False).ids), 0, n]


def test_states_stay_within_their_bound():
    """A text that makes a state of every fifth byte, and 20 MB of words."""
    library, rng, t = Tokenizer.from_file(PATH), random.Random(8), C.Transducer(PATH, max_states=20_000)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(40_000))
    most = []
    drop = t.counter._drop_states
    t.counter._drop_states = lambda *live: most.append(len(t.counter.states)) or drop(*live)
    assert t.count([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
    assert len(most) > 1 and max(most) < 20_000 + len(text) // C.CHUNK + 1000
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=3_100_000))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert 3_100_000 < t.count([long])[0] < len(long)
    assert time.time() - began < 90 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 800_000
