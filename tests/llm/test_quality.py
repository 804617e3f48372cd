"""op8: base features and the verdict against a plain brute force."""

import random
import re
from collections import Counter, defaultdict

from folioscope.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    n = Counter(windows)
    inside = {k + d for k, w in enumerate(windows) if n[w] > 1 for d in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def verdicts(rows, least, share, depleted):
    """For each row: kept and removed words."""
    normal = lambda x: " ".join(WORD.findall(fold(x)))
    seen, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text or "")
        for x in (text or "").split("\n"):
            if normal(x):
                seen[host, normal(x)].add(text)
    out = []
    for d, text, host in rows:
        n_words, *_, n_repeat = base(text or "")
        gone = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if normal(x) and len(seen[host, normal(x)]) > max(least, share * len(hosts[host]) / 100))
        failed = n_words < 20 or 100 * n_repeat > 30 * n_words
        out.append((d, *base(text or ""), failed, not failed and 100 * gone <= depleted * n_words, gone))
    return out


def made_up():
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "gamma\x0bdelta", "é日", "#tag", "a|b", "<x>", "\xa0hard", "1", "ZED"]
    common = ["Share this Page now", "All rights reserved here today and always", "x y z"]
    rows = []
    for k in range(300):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 14))) for _ in range(rng.randint(0, 6))]
        lines += [rng.choice(common).upper() if rng.random() < 0.5 else rng.choice(common) for _ in range(rng.randint(0, 3))]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), f"h{k % 3}" if k % 7 else None))
    rows += [(301, None, "h0"), (None, "", "h0"), (302, "a b c d e f g h " * 30, "h1"), (303, "long " * 30000, "h2"), (303, "long " * 30000, "h2")]
    copy = "\n".join(f"line number {k} of a copied text" for k in range(6))
    return rows + [(400 + k, copy, "h0") for k in range(40)] + [(500 + k, "All rights reserved here today and always\n" * 4 + "some few other words", "h1") for k in range(2)]


def test_base_features():
    texts = [t or "" for _, t, _ in made_up()]
    m = Q.measure(texts)
    got = list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [base(t) for t in texts]


def test_verdicts(spark):
    rows = made_up()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, row int, host string").repartition(5)
    for least, share, depleted in ((10, 5, 70), (3, 1, 20)):
        got = Q.rules(docs, least=least, share=share, depleted=depleted).collect()
        mine = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.removed_words) for r in got]
        assert sorted(map(str, mine)) == sorted(map(str, verdicts(rows, least, share, depleted)))
        assert any(r.removed_words for r in got)
    assert Q.rules(docs.limit(0)).count() == 0
