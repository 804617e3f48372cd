"""op4: groups against brute force over all pairs of full sets."""

import random
import re

import numpy as np

from folioscope.llm import near_dup as N
from folioscope.llm.textkit import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(folded)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for k, (d, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(d)
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [x for x in groups[root(k)] if x is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[k]), c, d == c))
    return out


def made_up(n=260, seed=8):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)] + ["É", "\xa0x"]
    base = [rng.choices(words, k=rng.randint(1, 90)) for _ in range(40)]
    rows = []
    for k in range(n):
        b = list(base[0] if rng.random() < 0.4 else rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((k, " ".join(x.upper() if rng.random() < 0.1 else x for x in b).replace(" ", rng.choice([" ", "\n", "  "]))))
    long = " ".join(rng.choices(words, k=15000))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, long), (n + 4, long + " end"), (None, rows[0][1]), (n + 5, "a b c d"), (n + 6, "A B  c d"), (n + 7, "x"), (None, "only here")]
    return [*rows, rows[5], rows[5]]


def test_sets_and_signature():
    texts = [t or "" for _, t in made_up()]
    assert [len(s) for s in Texts(texts).shingles(5)] == [len(shingles(t)) for t in texts]
    s = Texts(texts).shingles(5)[3]
    assert len(np.frombuffer(N.signature(s), "<u4")) == 72 and N.set_name(s) == N.set_name(s.copy())


def test_groups(spark, monkeypatch):
    rows = made_up()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, kept int, node string").repartition(4)
    want = sorted(map(str, brute(rows)))
    assert len({w[2] for w in brute(rows)}) < len(rows) - 80  # there are groups to find
    for block in (512, 7):
        monkeypatch.setattr(N, "BLOCK", block)
        assert sorted(str(tuple(r)) for r in N.find_groups(docs).collect()) == want


def test_large_groups_cost_rows_in_proportion(spark, monkeypatch):
    """Near copies of one text beside a few others: the rows dealt to blocks are a small multiple of the members, and every link counts."""
    monkeypatch.setattr(N, "BLOCK", 32)
    dealt = []
    plain = N.by_blocks
    monkeypatch.setattr(N, "by_blocks", lambda blocks, key: dealt.append((key, blocks.count())) or plain(blocks, key))
    for n in (200, 600):
        rng, base, dealt[:] = random.Random(n), [f"b{k}" for k in range(200)], []
        rows = []
        for k in range(n):
            b = list(base)
            b[rng.randrange(200)] = f"x{k}"
            rows.append((k, " ".join(b)))
        half = base[:100] + [f"h{k}" for k in range(100)]
        rows += [(n + k, " ".join([*half[:199], f"y{k}"])) for k in range(3)]
        got = {r.doc_id: r.component_id for r in N.find_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {k: 0 if k < n else n for k in range(n + 3)}
        clusters = sum(c for key, c in dealt if key == "cluster")
        assert clusters <= 3 * n, dealt
        assert sum(c for key, c in dealt if key == "key") <= 3 * N.BANDS * n, dealt


def test_a_group_whose_pivots_do_not_reach_all(spark, monkeypatch):
    """A chain of texts, each near to the next ones only: what no pivot settles is compared in blocks."""
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = [(k, " ".join(f"w{j}" for j in range(4 * k, 4 * k + 120))) for k in range(150)]
    assert all(r.component_id == 0 for r in N.find_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_one_python_operator_for_each_tested_member(spark, monkeypatch):
    """Members of large clusters are compared with their pivots where their sets are made: two operators in a row keep two workers for each core."""
    monkeypatch.setattr(N, "BLOCK", 16)
    plans, plain = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name, **o: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or plain(df, name, **o))
    base = [f"b{k}" for k in range(120)]
    rows = [(k, " ".join([*base[:60], f"x{k}", *base[60:]])) for k in range(60)]
    assert all(r.component_id == 0 for r in N.find_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    tested = [p.count("MapInArrow") for name, p in plans if name == "near-tested"]
    assert len(tested) == 2 and tested == [1, 1]


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 3000)).astype(np.uint64)) for _ in range(30)]
    got = N.overlaps(sets)
    for a in range(30):
        for b in range(30):
            assert a == b or got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_components(spark):
    rng, edges = random.Random(3), []
    for c in range(30):
        path = [c * 100 + k for k in range(rng.randint(2, 40))]
        rng.shuffle(path)
        edges += [(f"{a:016d}".encode(), f"{b:016d}".encode()) for a, b in zip(path, path[1:], strict=False)]
    got = {int(bytes(r.node)): int(bytes(r.root)) for r in N.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")).collect()}
    for node, root in got.items():
        assert node // 100 == root // 100 and root == min(k for k in got if k // 100 == node // 100)
    assert len(got) == len({x for e in edges for x in e})


def test_empty_table(spark):
    assert N.find_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
