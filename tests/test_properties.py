"""Made-up inputs against independent plain-Python definitions; each example is a batch of rows."""

import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import arrays as A
from folioscope.functions import geometry as G
from folioscope.functions import text as T
from folioscope.operators import blocks, records, routing, sequences, tables

batch = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow, HealthCheck.data_too_large])
number = st.one_of(st.integers(-5, 1010).map(str), st.floats(-5, 1010).map(str), st.sampled_from(["a", "", "1_0", "nan", "inf", "1e2", ".5", "5.", "+3", "0x1", "1__0", "٣"]))


def box(values):
    if len(values) != 4:
        return []
    try:
        n = [int(float(v)) for v in values]
    except (ValueError, OverflowError):
        return []
    return n if all(0 <= v <= 1000 for v in n) and n[0] < n[2] and n[1] < n[3] else []


@batch
@given(st.lists(st.lists(number, min_size=3, max_size=5), min_size=150, max_size=250))
def test_boxes(spark, rows):
    rows = [[v for v in r if v != "٣"] for r in rows]  # digits of other scripts are no numbers here
    got = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v array<string>").select("k", G.valid_box(F.col("v")).alias("b")).collect()
    assert {r.k: r.b for r in got} == {k: box(r) for k, r in enumerate(rows)}


piece = st.sampled_from(["<|det|>", "<|/det|>", "text [1,2,3,4]", "title [1 , 2;3 4]", "x", "\n", "\n\n", " ", "[non-text]", "figure [1,2]", "image", "[", "]", "é\xa0", "\t"])


def split_records(raw):
    out, rest = [], raw
    head, mark, rest = rest.partition("<|det|>")
    if head.strip():
        out.append((None, head.strip()))
    while mark:
        meta, closed, rest = rest.partition("<|/det|>")
        if not closed:
            return out
        content, mark, rest = rest.partition("<|det|>")
        main, blank, tail = content.rstrip().partition("\n\n")
        out.append((meta, main.rstrip()))
        if blank and tail.strip():
            out.append((None, tail.strip()))
    return out


def parse(raw):
    out = []
    for meta, content in split_records(raw):
        s = content.strip()
        if meta is None:
            noise = s.lower() in ("[non-text]", "[non text]", "[non_text]") or ("<|det|>" in s and "<|/det|>" not in s) or re.fullmatch(r"[a-z][\w-]*\s*\[[\d\s,.-]*\]", s, re.I)
            if not noise:
                out.append(("text", [], s))
        elif s:
            m = meta.strip()
            body = m[m.find("[") + 1 :]
            inside = body[: body.find("]")] if "[" in m and "]" in body else ""
            out.append((m.split("[", 1)[0].strip() or "text", box([v for v in re.split(r"[,;\s]+", inside) if v]), s))
    return out


@batch
@given(st.lists(st.lists(piece, max_size=14).map("".join), min_size=150, max_size=250))
def test_detections(spark, raws):
    got = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string").select("k", records.detections(F.col("raw")).alias("d")).collect()
    assert {r.k: [(d.type, d.bbox, d.text) for d in r.d] for r in got} == {k: parse(r) for k, r in enumerate(raws)}


kind = st.sampled_from(["title", "image", "table", "page_number", "text", "formula"])


@batch
@given(st.lists(st.lists(kind, max_size=12), min_size=100, max_size=150))
def test_blocks(spark, rows):
    def want(types):
        out = []
        for k, t in enumerate(types):
            if t in ("text", "formula"):
                if out and out[-1][0] == "paragraph":
                    out[-1] = ("paragraph", out[-1][1] + f"\nt{k}")
                else:
                    out.append(("paragraph", f"t{k}"))
            else:
                out.append(("heading" if t == "title" else t, f"t{k}"))
        return out

    made = [(n, [(t, [], f"t{k}") for k, t in enumerate(types)]) for n, types in enumerate(rows)]
    got = spark.createDataFrame(made, "n int, d array<struct<type:string,bbox:array<int>,text:string>>").select("n", blocks.blocks(F.col("d")).alias("b")).collect()
    assert {r.n: [(b.block_type, b.text) for b in r.b] for r in got} == {n: want(t) for n, t in enumerate(rows)}


@batch
@given(st.lists(st.lists(st.integers(0, 60), max_size=15), min_size=100, max_size=150), st.integers(0, 8))
def test_folds(spark, rows, gap):
    def kept(values):
        out = []
        for v in sorted(values):
            if not out or v - out[-1] > gap:
                out.append(v)
        return out

    def centers(values):
        groups = []
        for v in sorted(values):
            if groups and v - groups[-1][-1] <= gap:
                groups[-1].append(v)
            else:
                groups.append([v])
        return [round(sum(g) / len(g), 9) for g in groups]

    def columns(values):
        x, h = sorted(values), len(values) // 2
        if len(x) < 6:
            return 1
        span = max(1.0, x[-1] - x[0])
        return 2 if x[h] - x[h - 1] > 0.25 * span and x[h - 1] - x[0] < 0.5 * span and x[-1] - x[h] < 0.5 * span else 1

    df = spark.createDataFrame([(n, [float(v) for v in r], r) for n, r in enumerate(rows)], "n int, v array<double>, i array<int>")
    got = df.select("n", A.dedupe_bounds(F.col("v"), gap).alias("d"), A.cluster(F.col("v"), gap).alias("c"), routing.column_count(F.col("v")).alias("k"), sequences.banned(F.col("i"), 2, 9).alias("b")).collect()
    for r in got:
        values = rows[r.n]
        assert r.d == kept(values) and [round(c, 9) for c in r.c] == centers(values) and r.k == columns(values)
        first = max(0, len(values) - 9)
        assert r.b == sorted({values[k + 1] for k in range(first, len(values) - 1) if values[k] == values[-1]})


@batch
@given(st.lists(st.text(alphabet="|a \n1", max_size=30), min_size=150, max_size=250))
def test_quality_and_repetition(spark, contents):
    def quality(content):
        lines = [x for x in content.strip().splitlines() if x.strip()]
        widths = [n for n in (len([c for c in x.split("|") if c.strip()]) for x in lines) if n]
        if len(lines) < 2 or not widths:
            return 0.0
        modal = max(Counter(widths).values()) / len(widths)
        fill = sum(widths) / (max(widths) * len(widths))
        return round(modal * 0.5 + fill * 0.3 + modal * 0.2, 3)

    def repeats(text):
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        most = max(Counter(lines).values(), default=0)
        return len(lines) >= 3 and most >= 3 and most / len(lines) >= 0.5

    got = spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "k int, c string").select("k", tables.quality(F.col("c")).alias("q"), records.is_repetitive(F.col("c")).alias("r"), T.split_lines(F.col("c")).alias("l"), T.strip(F.col("c")).alias("s")).collect()
    for r in got:
        c = contents[r.k]
        assert abs(r.q - quality(c)) < 0.0011 and r.r == repeats(c) and r.l == c.splitlines() and r.s == c.strip()


@batch
@given(st.lists(st.text(max_size=12), min_size=150, max_size=250))
def test_text(spark, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    got = spark.createDataFrame([(k, c) for k, c in enumerate(texts)], "k int, c string").select("k", T.strip(F.col("c")).alias("s"), T.split_lines(F.col("c")).alias("l"), T.escape_html(F.col("c")).alias("e"), T.suspicious_count(F.col("c")).alias("n")).collect()
    for r in got:
        c = texts[r.k]
        assert r.s == c.strip() and r.l == c.splitlines()
        assert r.e == c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
        assert r.n == sum(x == "\N{REPLACEMENT CHARACTER}" or 0xE000 <= ord(x) <= 0xF8FF or (ord(x) < 32 and x not in "\t\n\r") for x in c)
