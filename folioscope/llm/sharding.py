"""Hilbert-curve ordering of documents into shards, with DataFrame functions only.

Three metadata dimensions (host, language, characters) are quantised to 16 levels each at their exact
quantiles, a table-driven Hilbert curve turns the levels into one index, and the documents in the
order of (index, doc_id, crc) are cut into runs. Rows of a run are near each other
in all three dimensions, so a file's minima and maxima prune reads along any of them. The law is
``rows``: the counts of two shards differ by one at most.

The order is made by a range exchange, so a hot host is dealt over many tasks by doc_id and by a
row salt; global places come from a prefix sum over one row for each partition of the written table.

Defined results: null metadata is level 0; a null text has no bytes and the crc of no bytes; rows
that are equal in everything are dealt in any order (their values are equal); an empty table gives
no rows; extra columns are ignored unless asked for with ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, join_bases, materialize, prefix_bases, release

QUERY = "op5_hilbert_shards"
SHARDS = 24
BITS = 4
#: Size of a document besides its text.
FIXED_BYTES = 8


def curve_table(dims: int) -> list[int]:
    """The Hilbert curve as a transducer: entry [state << dims | cell] is next state << dims | digit.

    A state is (entry corner, direction); cells are walked in Gray-code order, turned by the state
    (after Hamilton's construction of compact Hilbert indices).
    """
    size, full = 1 << dims, (1 << dims) - 1
    turn = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims) % dims)) & full if k % dims else x
    back = lambda x, k: turn(x, -k % dims)
    gray = lambda x: x ^ (x >> 1)
    order = {gray(w): w for w in range(size)}
    ones = lambda x: next(k for k in range(dims + 1) if not x >> k & 1)
    states, table, at = {(0, 0): 0}, [], 0
    while at < len(states):
        entry, direction = list(states)[at]
        for cell in range(size):
            digit = order[back(cell ^ entry, direction + 1)]
            inside = 0 if digit == 0 else gray(2 * ((digit - 1) // 2))
            along = 0 if digit == 0 else ones(digit - 1 if digit % 2 == 0 else digit) % dims
            after = entry ^ turn(inside, direction + 1), (direction + along + 1) % dims
            table.append(states.setdefault(after, len(states)) << dims | digit)
        at += 1
    return table


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """The place on the curve of a cell given by its level in each dimension."""
    dims = len(levels)
    table = F.lit(curve_table(dims))
    state, index = F.lit(0), F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        cell = F.lit(0)
        for k, level in enumerate(levels):
            cell = cell + F.shiftright(level, b).bitwiseAND(F.lit(1)) * (1 << dims - 1 - k)
        step = F.get(table, F.shiftright(state, dims) * (1 << dims) + cell)
        index = index * (1 << dims) + step.bitwiseAND(F.lit((1 << dims) - 1))
        state = step
    return index


def quantiles(docs: DataFrame, dim: str, parts: int) -> list:
    """parts - 1 exact quantiles of whole values from their grouped counts, summed up in range order; a quantile below the least value is left out."""
    counts = docs.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("n"))
    ranged = materialize(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "shard-values")
    bases = prefix_bases(ranged.groupBy("part").agg(F.sum("n").alias("total")), "part", "total")
    up_to = F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    total = ranged.agg(F.sum("n")).first()[0] or 0
    row = join_bases(ranged, bases, "part").select("value", up_to.alias("up_to")).agg(*(F.min(F.when(F.col("up_to") * parts >= k * total, F.col("value"))).alias(f"q{k}") for k in range(1, parts))).first()
    release(ranged)
    return [x for x in row if x is not None]


def placed(docs: DataFrame, dims: list[str], bits: int = BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row with hilbert and rank, its place in the order of the curve, and total, the number of rows; written once."""
    levels = []
    for d in dims:
        level = F.lit(0)
        for cut in quantiles(docs, d, 1 << bits):
            level = level + F.coalesce((F.col(d) >= F.lit(cut)).cast("int"), F.lit(0))
        levels.append(level)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(raw) + FIXED_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), hilbert_index(levels, bits).alias("hilbert"), *carry, F.monotonically_increasing_id().alias("salt")
    )
    order = ["hilbert", "doc_id", "text_crc32", "salt"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    written = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "shards")
    part = F.shiftright("place", 33)
    bases = prefix_bases(written.groupBy(part.alias("part")).agg(F.count("*").alias("n")), "part", "n")
    located = join_bases(written.withColumn("part", part), bases, "part")
    rank = F.col("base") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return located.withColumn("total", F.lit(written.count())).withColumn("rank", rank).drop("part", "base", "place")


def assign(docs: DataFrame, shards: int = SHARDS, dims: tuple[str, ...] = ("source", "lang", "n_chars"), carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its shard and its slot there."""
    rows = placed(docs, list(dims), carry=carry).withColumn("shard", F.expr(f"(rank * {shards}) div greatest(total, 1)"))
    begin = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - begin).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert", *carry
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dims: tuple[str, ...] = ("source", "lang", "n_chars"), rows_per_file: int = 1_000_000) -> DataFrame:
    """Write one folder of Parquet files for each shard, texts included, each file a run of the curve; returns each shard's minima and maxima.

    Rows are dealt by ranges of (shard, slot), so a shard is the work of as many tasks as its share of the rows.
    """
    out = assign(docs, shards, dims, carry=tuple(c for c in dict.fromkeys((*dims, "text"))))
    ordered = out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.parquet(path)
    return back.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir, "doc_id", "text", "source", "lang", "n_chars"))


def _oracle() -> str:
    """The query in SQL: quantiles by running counts, the curve by its table, crc32 (polynomial 0xEDB88320, reflected) by its table over the bytes in hexadecimal."""
    parts, crc = 1 << BITS, []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        crc.append(k)
    dims = ("source", "lang", "n_chars")
    cuts = ", ".join(
        f"q_{d} AS (SELECT list(q) AS cuts FROM (SELECT k, min(v) AS q FROM (SELECT {d} AS v, sum(count(*)) OVER (ORDER BY {d}) AS up_to, sum(count(*)) OVER () AS total FROM documents WHERE {d} IS NOT NULL GROUP BY {d}), range(1, {parts}) AS k(k) WHERE up_to * {parts} >= k * total GROUP BY k))"
        for d in dims
    )
    levels = ", ".join(f"coalesce(len(list_filter((SELECT cuts FROM q_{d}), lambda q: q <= {d})), 0)::INT AS l{k}" for k, d in enumerate(dims))
    walk, table = "SELECT *, 0 AS state, 0::BIGINT AS h FROM leveled", f"{curve_table(len(dims))}::INT[]"
    for b in range(BITS - 1, -1, -1):
        cell = " + ".join(f"((l{k} >> {b}) & 1) * {1 << len(dims) - 1 - k}" for k in range(len(dims)))
        walk = f"SELECT * EXCLUDE (state, h, step), step >> {len(dims)} AS state, h * {1 << len(dims)} + (step & {(1 << len(dims)) - 1}) AS h FROM (SELECT *, list_extract({table}, state * {1 << len(dims)} + {cell} + 1) AS step FROM ({walk}))"
    return f"""WITH {cuts}, leveled AS (SELECT doc_id, coalesce(text, '') AS t, {levels} FROM documents), curved AS ({walk}),
    summed AS (SELECT doc_id, octet_length(encode(t)) + {FIXED_BYTES} AS size, h, xor(list_reduce(list_transform(range(octet_length(encode(t))), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT),
      lambda c, b: xor(c >> 8, list_extract({crc}::BIGINT[], (xor(c, b) & 255) + 1)), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM (SELECT *, hex(encode(t)) AS x FROM curved)),
    ranked AS (SELECT *, row_number() OVER (ORDER BY h, doc_id NULLS FIRST, text_crc32) - 1 AS place, count(*) OVER () AS total FROM summed)
    SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (place * {SHARDS} // total)::INT AS shard, place - (place * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard, h AS hilbert FROM ranked"""


ORACLE_SQL = _oracle()
