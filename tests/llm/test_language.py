"""op3: held-out accuracy, defined results, equal texts."""

import math
import unicodedata
import zlib

import pytest

from folioscope.llm import language as L

TABLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(L.documents(spark, TABLE, "doc_id", "text", "lang"))


def test_held_out_accuracy(spark, model):
    docs = L.documents(spark, TABLE, "doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in L.identify(L.documents(spark, TABLE, "doc_id", "text"), model).collect()}
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) and 0 <= got[d.doc_id].score <= 1 for d in docs)
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held)


def test_defined_results(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "日"), (None, "The and of to"), (5, "The and of to"), (6, "x" * 300000), (6, "x" * 300000)]
    docs = spark.createDataFrame([(*r, 0.5, "q") for r in rows], "doc_id long, text string, score double, lang string")
    got = L.identify(docs, model).collect()
    by = {(r.doc_id): r for r in got}
    assert len(got) == 8 and [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by[4].lang_pred != "und" and by[None].held_out is False
    assert (by[None].lang_pred, by[None].score) == (by[5].lang_pred, by[5].score)
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.lang for r in kept.collect()} == {by[k].lang_pred for k in (4, 5, 6)} and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "6", "6", "None"]
    assert L.identify(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.fit(docs) is None and L.identify(docs, None).first().lang_pred == "und"


def test_neighbours_do_not_matter(model):
    texts = ["Der die das und", "the of and", "le la les", "x"]
    assert [model.predict([t])[0][0] for t in texts] == model.predict(texts)[0]


def test_single_language_and_other_families(spark):
    rows = [(k, f"{a} {a}{k % 3} {a}", c) for k in range(60) for a, c in (("alpha beta", "xx"), ("gamma zeta", "yy"), ("omega rho", "ru"), ("eta phi", "uk"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.fit(docs)
    assert m.names == ["slavic", "xx", "yy"] and [x[1:] for x in m.pairs] == [("ru", "uk")]
    assert m.predict(["alpha beta alpha", "eta phi", "omega rho"])[0] == ["xx", "uk", "ru"]
    assert L.fit(docs.where("lang = 'xx'")).predict(["any"])[0] == ["xx"]


def test_copies_do_not_thin_the_sample(spark, monkeypatch):
    """A language of many copies of few texts gives all of them to the sample."""
    rows = spark.range(60000).selectExpr("id AS doc_id", "concat('alpha beta ', id % 20) AS text", "'xx' AS lang")
    rows = rows.union(spark.range(1000).selectExpr("id", "concat('gamma zeta ', id)", "'yy'"))
    model, labels = L.Model, []
    monkeypatch.setattr(L, "Model", lambda names, x: labels.extend(names) or model(names, x))
    assert L.fit(rows).predict(["alpha beta 3", "gamma zeta 5"])[0] == ["xx", "yy"]
    assert labels.count("xx") == 20 and labels.count("yy") == L.PER_LANGUAGE


def plain_prediction(model, text):
    """Language and score of one text by counting its n-grams one by one and plain sums."""
    if not any(unicodedata.category(c).startswith("L") for c in text):
        return "und", 0.0
    folded = [b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 32 for b in text.encode()] + [32, 32]
    spread = lambda x: (x * 2654435761 % 2**32) >> 20
    buckets = []
    for k in range(len(folded) - 2):
        two = (folded[k] * 257 + folded[k + 1]) % 2**32
        buckets += [spread(two), spread((two * 263 + folded[k + 2] + 1) % 2**32)]
    chance = [1 / (1 + math.exp(-L.SLOPE * round(sum(float(model.weights[b, m]) for b in buckets) / len(buckets) + float(model.bias[m]), 6))) for m in range(model.weights.shape[1])]
    n = len(model.names)
    f = max(range(n), key=lambda k: (chance[k], -k))
    codes = model.families[model.names[f]]
    votes, sure = dict.fromkeys(codes, 0), dict.fromkeys(codes, 0.0)
    for k, (g, a, b) in enumerate(model.pairs):
        if g == model.names[f]:
            p = chance[n + k]
            votes[a if p >= 0.5 else b] += 1
            sure[a] += p / (len(codes) - 1)
            sure[b] += (1 - p) / (len(codes) - 1)
    best = max(codes, key=lambda c: (votes[c] + sure[c] / 2, -codes.index(c)))
    return best, chance[f] * (sure[best] if len(codes) > 1 else 1)


def test_against_plain_prediction(spark, model):
    rows = spark.read.parquet(TABLE + "/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rows = [(r.doc_id, r.text) for r in rows if len(r.text or "") < 3000][:300] + [(-1, "² ½ Ⅳ 12"), (-2, "ª"), (-3, "a\u0301"), (-4, "123")]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for d, t in rows:
        want = plain_prediction(model, t or "")
        assert got[d].lang_pred == want[0] and got[d].score == pytest.approx(want[1], abs=1e-5), (d, t)


def test_kept_by_language_and_score(spark, model):
    rows = [(1, "the of and to in the house of the people"), (2, "der die und das nicht ein Haus der Leute"), (3, "² ½ Ⅳ")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang int")
    seen = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert [seen[k].lang_pred for k in (1, 2, 3)] == ["en", "de", "und"]
    ids = lambda **more: sorted(r.doc_id for r in L.keep_identified(docs, model, **more).collect())
    assert ids(least=0.0) == [1, 2] and ids(wanted=("de",), least=0.0) == [2] and ids(least=1.01) == []
    assert {r.doc_id: r.lang for r in L.keep_identified(docs, model, least=0.0).collect()} == {1: "en", 2: "de"}
    assert {r.doc_id: r.found for r in L.keep_identified(docs.select("doc_id", "text"), model, least=0.0, into="found").collect()} == {1: "en", 2: "de"}
    assert L.keep_identified(docs, None).count() == 0


def test_many_languages(spark, monkeypatch):
    docs = spark.range(700).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 350) AS lang")
    seen = []
    monkeypatch.setattr(L, "Model", lambda names, x: seen.extend(names))
    L.fit(docs)
    assert 0 < len(set(seen)) <= L.MAX_LANGUAGES and len(seen) <= L.SAMPLE
