"""op6: the winnowing guarantee, and the whole result against a sequential brute force."""

import random
import re
import time

import numpy as np

from folioscope.llm import line_dedup as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(line):
    return tuple("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(line))


def brute(rows):
    """Text left of each (order key, text); rows in order. Fingerprints by the operator's hashes, all else by plain comparison."""
    lines = [[(k, norm(x)) for k, x in enumerate((t or "").split("\n")) if norm(x)] for _, t in rows]
    first, out = {}, []
    for d, (_, text) in enumerate(rows):
        mine = [x for _, x in lines[d]]
        hashes = np.array([hash(x) & (2**64 - 1) for x in mine], np.uint64)
        texts = L.Texts([text or ""])
        texts.lines()
        worded = np.flatnonzero(np.diff(texts.line_word))
        hashes = L.RangeHash(texts.word_hashes(), L.WORD_BASE)(texts.line_word[worded], texts.line_word[worded + 1])
        grams, places = L.fingerprints(hashes, np.array([len(x) for x in mine], np.int64))
        gone = set()
        for g, p in zip(grams.tolist(), places.tolist(), strict=True):
            if g not in first:
                first[g] = d, p
                continue
            e, q = first[g]
            theirs = [x for _, x in lines[e]]
            a = 0
            while p - a > 0 and q - a > 0 and mine[p - a - 1] == theirs[q - a - 1]:
                a += 1
            b = 0
            while p + b < len(mine) and q + b < len(theirs) and mine[p + b] == theirs[q + b]:
                b += 1
            gone |= set(range(p - a, p + b))
        numbers = {lines[d][p][0] for p in gone}
        for p in gone:
            if p + 1 in gone:
                numbers |= set(range(lines[d][p][0], lines[d][p + 1][0]))
        out.append(text if not numbers else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in numbers))
    return out


def made_up():
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)] + ["É", "日本", "#"]
    line = lambda a, b: " ".join(rng.choices(words, k=rng.randint(a, b)))
    passages = [[line(4, 30) for _ in range(rng.randint(2, 8))] for _ in range(8)] + [[line(60, 80)] for _ in range(4)]
    rows = []
    for k in range(160):
        body = [line(1, 25) for _ in range(rng.randint(0, 8))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            p = p[rng.randint(0, 1) :] if rng.random() < 0.3 else p
            body[at:at] = [x.upper() if rng.random() < 0.2 else x for x in p] if rng.random() < 0.7 else [y for x in p for y in (x, " ")]
        rows.append((k, "\n".join(body)))
    rows += [(161, None), (162, ""), (163, "\n\n"), (164, "\n".join([line(20, 20)] * 300)), (165, " ".join(rng.choices(words, k=20000)))]
    return [*rows, (166, rows[3][1]), (167, rows[3][1]), (168, rows[165 - 1][1])]


def test_equal_runs_share_a_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(200):
        words = rng.integers(1, 30, 40)
        hashes = rng.integers(0, 2**63, 40).astype(np.uint64)
        a, b = sorted(rng.integers(0, 40, 2))
        if words[a:b].sum() < L.WINDOW_WORDS:
            continue
        pad = rng.integers(1, 30, 5)
        other_h, other_w = np.concatenate([rng.integers(0, 2**63, 5).astype(np.uint64), hashes[a:b], rng.integers(0, 2**63, 5).astype(np.uint64)]), np.concatenate([pad, words[a:b], pad])
        inside = {(g, p - a) for g, p in zip(*(x.tolist() for x in L.fingerprints(hashes, words)), strict=True)}
        assert inside & {(g, p - 5) for g, p in zip(*(x.tolist() for x in L.fingerprints(other_h, other_w)), strict=True)}


def test_against_brute_force(spark):
    rows = made_up()
    docs = spark.createDataFrame([(*r, "s", 9, "row") for r in rows], "doc_id long, text string, source string, N_lines int, row string").repartition(6)
    got = L.dedup(docs).orderBy("doc_id").collect()
    want = brute(rows)
    assert [r.text for r in got] == want
    assert sum(r.removed_lines for r in got) > 100 and {r.source for r in got} == {"s"} and got[0].row == "row" and got[0].N_lines == 9 and got[3].n_lines_ == len(rows[3][1].split("\n"))
    for r, (_, t), w in zip(got, rows, want, strict=True):
        assert r.removed_words == len(WORD.findall(t or "")) - len(WORD.findall(w or ""))
    assert L.dedup(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"word{k}" for k in range(60))
    got = L.dedup(spark.createDataFrame([(None, text), (5, text), (5, text)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("5", ""), ("5", text), ("None", "")]


def test_long_documents_cost_in_proportion(spark):
    """Two copies of 80,000 lines, and as many equal lines, within a time."""
    text = "\n".join(f"line {k} of words {k * k % 997} and {k % 13}" for k in range(80_000))
    equal = "\n".join(["the same line again and again"] * 80_000)
    docs = spark.createDataFrame([(1, text), (2, text), (3, equal)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in L.dedup(docs).collect()}
    took = time.time() - began
    assert got[1].text == text and got[2].text == "" and got[2].removed_lines == 80_000
    assert got[3].removed_lines > 79_000 and got[3].text.startswith("the same line again and again")
    assert took < 45, took


def test_repeats_caught(spark):
    """Of the lines in runs of WINDOW_WORDS words or more that occur earlier, the share that goes: none stays whole, most go altogether."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    after = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, repeated, left = set(), 0, 0
    for d, text in rows:
        mine = set()
        for lines, count in ((text or "", True), (after[d] or "", False)):
            words = [x for line in lines.split("\n") for x in [norm(line)] if x]
            for i in range(len(words)):
                size, j = 0, i
                while j < len(words) and size < L.WINDOW_WORDS:
                    size, j = size + len(words[j]), j + 1
                if size >= L.WINDOW_WORDS:
                    run = hash(tuple(words[i:j]))
                    if count:
                        mine.add(run)
                        repeated += run in seen
                    else:
                        left += run in seen
        seen |= mine
    assert repeated > 100 and left <= 0.01 * repeated, (repeated, left)
