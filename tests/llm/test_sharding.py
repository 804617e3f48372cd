"""op5: the curve's law of neighbours, the rows law, and the whole assignment against brute force."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.llm import sharding as S


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    n = 1 << bits
    cells = spark.range(n**dims).select(*((F.col("id") / n**k).cast("long") % n for k in range(dims))).toDF(*(f"x{k}" for k in range(dims)))
    rows = cells.select(S.hilbert_index([F.col(c).cast("int") for c in cells.columns], bits).alias("h"), *cells.columns).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(n**dims))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)) == 1


@pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 500])
def test_rows_law(spark, n):
    rows = [(i if i % 7 else None, "tëxt " * (i % 11) if i % 5 else None, f"src{i % 3}" if i % 4 else None, "en", i % 50, 1) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, shard int")
    got = S.assign(docs).collect()
    assert len(got) == n
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(by.get(k, [])) for k in range(24)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(r.hilbert, r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in ordered]
    assert keys == sorted(keys)
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 5}", "en", i) for i in range(100)], "doc_id long, text string, source string, lang string, n_chars long")
    found = S.write_shards(docs, f"{tmp_path}/out", 4).collect()
    assert sorted(r.rows for r in found) == [25] * 4 and spark.read.parquet(f"{tmp_path}/out").select("text").distinct().count() == 100


def test_strings_with_a_common_prefix(spark):
    """Sources that differ behind their first bytes have levels, and so cells of the curve, of their own."""
    docs = spark.createDataFrame([(i, f"text {i}", f"https://www.example{i % 8}.org", "en", 7) for i in range(400)], "doc_id long, text string, source string, lang string, n_chars long")
    cells = {r.source: r.n for r in S.assign(docs, carry=("source",)).groupBy("source").agg(F.count_distinct("hilbert").alias("n")).collect()}
    assert set(cells.values()) == {1} and len(cells) == 8
    assert S.assign(docs).select("hilbert").distinct().count() == 8
    assert S.quantiles(docs, "source", 8) == [f"https://www.example{k}.org" for k in range(7)]


@pytest.mark.parametrize("n", [0, 1, 40, 300])
def test_against_sql(spark, tmp_path, n):
    """Levels, curve, ranks, shards and checksums of the query against its DuckDB statement, with nulls, ties and equal metadata."""
    rows = [(i, None if i % 9 == 0 else "tëxt 日 " * (i % 7), None if i % 8 == 0 else f"https://host{i * i % 23}", None if i % 5 == 0 else ("en", "de", "fr")[i % 3], None if i % 11 == 0 else i * 37 % 101) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = S.query(spark, str(tmp_path))
    result = db.execute(S.ORACLE_SQL)
    at = [[d[0] for d in result.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[k] for k in at) for r in result.fetchall())
