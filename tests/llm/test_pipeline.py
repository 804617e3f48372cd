"""The pipeline's stages against brute force, each on the input that it gets."""

import importlib.util
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("without the pipeline", allow_module_level=True)

import corpus_pipeline as P
import test_line_dedup
import test_near_dup
import test_quality


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", h, len(t or "")) for d, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_quality_stage(spark):
    rows = test_quality.made_up()
    got = P.apply_quality_rules(spark, table(spark, rows), "").collect()
    verdicts = test_quality.verdicts(rows, 10, 5, 70)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(v[0]) for v in verdicts if v[7])
    gone = {v[0]: v[8] for v in verdicts}
    for r in got:
        before = next(t for d, t, _ in rows if d == r.doc_id)
        assert len(test_quality.WORD.findall(before)) - len(test_quality.WORD.findall(r.text)) == gone[r.doc_id] and r.n_chars == len(r.text)


def test_line_stage(spark):
    rows = test_line_dedup.made_up()
    got = {r.doc_id: r.text for r in P.remove_repeated_lines(spark, table(spark, [(*r, "s") for r in rows]), "").collect()}
    assert got == {d: w for (d, _), w in zip(rows, test_line_dedup.brute(rows), strict=True) if test_line_dedup.WORD.search(w or "")}


def test_near_duplicate_stage(spark):
    rows = test_near_dup.made_up(150)
    got = [r.doc_id for r in P.remove_near_duplicates(spark, table(spark, [(*r, "s") for r in rows]), "").collect()]
    want = {(c if n else d, n == 0 and k) for k, (d, n, c, _) in enumerate(test_near_dup.brute(rows))}
    assert sorted(map(str, got)) == sorted(str(w[0]) for w in want)


def test_language_stage(spark):
    """Rows go by language and score, and lang is the predicted one."""
    from folioscope.llm import language as L

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = {r.doc_id: r for r in L.identify(docs, L.fit(docs)).collect()}
    got = {r.doc_id: r.lang for r in P.identify_language(spark, docs, "").collect()}
    assert got == {d: r.lang_pred for d, r in seen.items() if r.lang_pred != "und" and r.score >= L.LEAST_SCORE} and len(got) > 900


def test_results_outlive_another_run(spark, tmp_path):
    """Results of operators, of a stage and of a first run can be read after a second run."""
    from folioscope.llm import near_dup, sharding

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(folder + "/documents.parquet")
    held = [near_dup.query(spark, folder), sharding.query(spark, folder), P.apply_quality_rules(spark, docs, folder), P.remove_repeated_lines(spark, docs, folder), P.remove_near_duplicates(spark, docs, folder), P.run(spark, folder)]
    before = [x.count() for x in held]
    again = P.run(spark, folder).count()
    assert [x.count() for x in held] == before and before[:2] == [200, 200] and again == before[-1]


def test_stages_on_files_copy_nothing(spark, monkeypatch):
    """Rows read from Parquet files are named by their places, also where rows are repeated and files are several."""
    from folioscope.llm import common

    rows = test_line_dedup.made_up()
    folder = common.materialize(table(spark, [(*r, "s") for r in rows]), "test-rows")
    names, plain = [], common.materialize
    for module in (P.line_dedup, P.near_dup, P.quality, common):
        monkeypatch.setattr(module, "materialize", lambda df, name, **more: names.append(name) or plain(df, name, **more))
    assert common.read_from_files(folder) and not common.read_from_files(folder.where("doc_id > 1"))
    for stage in (P.apply_quality_rules, P.remove_repeated_lines, P.remove_near_duplicates):
        in_memory = sorted(map(str, stage(spark, table(spark, [(*r, "s") for r in rows]), "").collect()))
        names.clear()
        assert sorted(map(str, stage(spark, folder, "").collect())) == in_memory and "keyed" not in names


def test_run(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "length", "offset"} <= set(got.columns) and got.count() > 100
    assert [n for n, _ in P.STAGES] == ["language ID", "quality rules", "line dedup", "MinHash near-dedup", "packing"]
