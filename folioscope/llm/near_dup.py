"""Near-duplicate groups by min-max hashing, every link confirmed on the full shingle sets.

Each hash permutation gives two signature values of a document, the minimum and the maximum over its
shingles; both agree between two sets with a probability equal to their Jaccard similarity, so half
the hash evaluations of plain MinHash fill the bands. 36 permutations make 24 bands of three values
(12 of minima, 12 of maxima), which find a pair of similarity 0.75 with probability 1 - 2e-6.

1. Documents with equal shingle sets form a class; from here on classes are compared.
2. Band keys that several classes share are buckets. The members of a bucket are compared by their
   signatures; pairs whose sizes and signatures allow 0.75 (five standard deviations of slack) are
   plausible, and only a spanning forest of them is returned.
3. The components of the plausible pairs are clusters. Every member's shingle set goes to its
   cluster, where pairs are counted exactly by products of incidence blocks; again a spanning forest
   of the links is returned.
4. The components of the links are the groups.

No pair list is ever made. A bucket or cluster of BLOCK members at most is one block, in which all
pairs are compared. In a larger one every member is first compared with two pivots, its members of the
least and the greatest name; those that fit the pivot with more fits are settled, as they are in one
component with it. Pairs of two settled members need no look any more: only the others are dealt to
blocks, with each other and with the settled ones. So n members of which r are not settled cost 2 * n
rows for the pivots and, if r > 0, about 2 * n * r / BLOCK + n rows in blocks, which is in proportion to
n for a group of copies. Components come from alternating large- and small-star steps over written
tables.

Defined results: a text without words (null, empty, white space) has an empty set and is linked with
nothing; rows that share a doc_id are documents of their own; a null doc_id counts as larger than
any other, and ``kept`` is null-safe equality of doc_id and component_id; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASH_RUN_BYTES, Keyed, byte_sizes, column, documents, filled, is_small, join_measured, materialize, mix64, random_words, release, row_type, runs
from .textkit import Texts

QUERY = "op4_near_dup"
WORDS, PERCENT = 5, 75
PERMUTATIONS, BAND_ROWS = 36, 3
BANDS = 2 * PERMUTATIONS // BAND_ROWS
BLOCK = 512
#: Agreeing signature values that a pair of similarity 0.75 has but for five standard deviations.
LEAST_AGREEING = int(2 * PERMUTATIONS * 0.75 - 5 * (2 * PERMUTATIONS * 0.75 * 0.25) ** 0.5)
MULTIPLIERS = random_words(PERMUTATIONS, 1) | np.uint64(1)
SHIFTS = random_words(PERMUTATIONS, 2)

SIGNED = "row {}, doc_id long, text_hash long, n_shingles long, node binary, sketch binary"
EDGES = "a binary, b binary"


def signature(shingles: np.ndarray) -> bytes:
    """Minima, then maxima, of a set under all permutations: the upper halves of 64-bit values."""
    values = shingles[:, None] * MULTIPLIERS + SHIFTS
    return (np.concatenate([values.min(0), values.max(0)]) >> np.uint64(32)).astype("<u4").tobytes()


def set_name(shingles: np.ndarray) -> bytes:
    """128 bits that name a set of shingle hashes."""
    sums = np.array([mix64(shingles + np.uint64(k)).sum(dtype=np.uint64) for k in (3, 5)], np.uint64)
    return mix64(sums + np.uint64(len(shingles))).astype("<u8").tobytes()


def signed(docs: DataFrame) -> DataFrame:
    """SIGNED of docs (row, doc_id, text, text_hash); node and sketch are null for an empty set."""

    kind = SIGNED.format(row_type(docs))
    columns = ["row", *(x.split(" ")[0] for x in SIGNED.split(", ")[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(column(batch, "text"))
            for i, j in runs(byte_sizes(texts), HASH_RUN_BYTES):
                sets = Texts(texts[i:j].to_pylist()).shingles(WORDS)
                names = pa.array([set_name(s) if len(s) else None for s in sets], pa.binary())
                sketches = pa.array([signature(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*(column(batch, c)[i:j] for c in ("row", "doc_id", "text_hash")), pa.array([len(s) for s in sets], pa.int64()), names, sketches], columns)

    return docs.mapInArrow(run, kind)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups of rows that are sorted by keys, with the groups' offsets."""
    rest: pa.Table | None = None

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            v = table.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        at = bounds(table)
        if len(at) > 2:
            yield table.slice(0, at[-2]), at[:-1].tolist()
        rest = table.slice(at[-2]) if len(at) > 1 else table
    if rest is not None and rest.num_rows:
        yield rest, bounds(rest).tolist()


def in_blocks(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Deals rows of each key, of the given size, to blocks (key, one, two) that hold every pair of its rows together; side tells the row's part."""
    parts = F.expr(f"cast((`{size}` + {BLOCK - 1}) div {BLOCK} as int)")
    mine = rows.withColumn("side", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return mine.withColumn("one", F.least("side", "other")).withColumn("two", F.greatest("side", "other")).drop("other", size)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Deals rows of large groups (r of them not settled, s settled; ``settled`` marks them) to blocks that hold every pair with a row that is not settled."""
    parts = {c: F.expr(f"cast((`{c}` + {BLOCK - 1}) div {BLOCK} as int)") for c in ("r", "s")}
    mine = {c: F.pmod(F.xxhash64("node"), F.greatest(parts[c], F.lit(1))).cast("int") for c in ("r", "s")}
    place = lambda one, two, side: F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"), side.cast("int").alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    among = F.transform(upto(parts["r"]), lambda k: place(F.least(mine["r"], k), F.greatest(mine["r"], k), mine["r"]))
    across = F.transform(upto(parts["s"]), lambda k: place(mine["r"], parts["r"] + k, F.lit(-1)))
    met = F.transform(upto(parts["r"]), lambda k: place(k, parts["r"] + mine["s"], F.lit(-2)))
    at = F.explode(F.when(F.col("settled"), met).otherwise(F.concat(among, across)))
    return rows.select("*", at.alias("at")).select("*", "at.one", "at.two", "at.side").drop("at", "r", "s", "settled")


def linked(groups: DataFrame, key: str, members, compare, ends, fits) -> DataFrame:
    """EDGES that join the fitting pairs of every group of a written table of groups (key, m).

    members(groups) gives (key, node, more) of some groups, with their other columns; compare does a
    table of blocks; ends(groups) gives key, m, least and most, the members of the least and the greatest
    name; fits(groups) gives key, node, pivot of the members that fit least or most.
    """
    small = compare(in_blocks(members(groups.where(F.col("m") <= BLOCK)), key, "m"))
    large = groups.where(F.col("m") > BLOCK)
    if large.isEmpty():
        return small
    large = materialize(ends(large), "near-large")
    tested = materialize(fits(large), "near-tested")
    best = tested.groupBy(key, "pivot").agg(F.count("*").alias("c")).groupBy(key).agg(F.max_by("pivot", F.struct("c", "pivot")).alias("pivot"))
    star = materialize(tested.join(best, [key, "pivot"]).select(key, "node", "pivot").distinct(), "near-stars")
    release(tested)
    edges = small.union(star.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    settled = star.groupBy(key).agg(F.count("*").alias("s"))
    sizes = materialize(large.join(settled, key, "left").select(key, F.coalesce("s", F.lit(0)).alias("s"), (F.col("m") - F.coalesce("s", F.lit(0))).alias("r")).where("r > 0"), "near-rest")
    if sizes.isEmpty():
        return edges
    marked = members(sizes).join(star.select(key, "node", F.lit(True).alias("settled")), [key, "node"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    return edges.union(compare(dealt(marked, key)))


def by_blocks(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.repartition(key, "one", "two").sortWithinPartitions(key, "one", "two")


def forest(n: int, joined) -> list[tuple[int, int]]:
    """A spanning forest of n rows; joined(k) gives the rows after k that are joined with it."""
    label, out = np.arange(n), []
    for k in range(n - 1):
        found = joined(k)
        while len(found := found[label[found] != label[k]]):
            other = int(found[0])
            out.append((k, other))
            label[label == label[other]] = label[k]
    return out


def plausible(blocks: DataFrame) -> DataFrame:
    """EDGES of spanning forests of the plausible pairs in blocks of buckets (key, one, two, side, node, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in grouped(batches, ["key", "one", "two"]):
            nodes, n, side = table.column("node").to_pylist(), table.column("n").to_numpy(), table.column("side").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u4").reshape(-1, 2 * PERMUTATIONS)
            cross = table.column("one").to_numpy() != table.column("two").to_numpy()
            a, b = [], []
            for i, j in zip(at, at[1:], strict=False):
                own_n, own_side, own, apart = n[i:j], side[i:j], sketches[i:j], cross[i]

                def joined(k: int, own_n=own_n, own_side=own_side, own=own, apart=apart) -> np.ndarray:
                    least, most = np.minimum(own_n[k], own_n[k + 1 :]), np.maximum(own_n[k], own_n[k + 1 :])
                    fit = 100 * least >= PERCENT * most
                    if apart:
                        fit &= own_side[k + 1 :] != own_side[k]
                    rows = np.flatnonzero(fit)
                    return rows[(own[k + 1 + rows] == own[k]).sum(1) >= LEAST_AGREEING] + k + 1

                for x, y in forest(j - i, joined):
                    a.append(nodes[i + x])
                    b.append(nodes[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return by_blocks(blocks, "key").mapInArrow(run, EDGES)


def plausible_with_pivot(rows: DataFrame) -> DataFrame:
    """key, node, pivot of the rows (key, node, n, sketch, pivot, pivot_n, pivot_sketch) that are plausible with their pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(column(batch, c).to_pylist()), "<u4").reshape(-1, 2 * PERMUTATIONS) for c in ("sketch", "pivot_sketch"))
            n, m = (column(batch, c).to_numpy() for c in ("n", "pivot_n"))
            fit = (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & ((a == b).sum(1) >= LEAST_AGREEING)
            yield batch.select(["key", "node", "pivot"]).filter(pa.array(fit))

    return rows.mapInArrow(run, "key long, node binary, pivot binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all pairs' intersections, by products of incidence columns of shingles that two sets or more hold."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    values, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[which]
    row, place = row[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for first in range(0, int((counts > 1).sum()), 4096):
        i, j = np.searchsorted(place, [first, first + 4096])
        block = np.zeros((n, 4096), np.float32)
        block[row[i:j], place[i:j] - first] = 1
        out += block @ block.T
    return out.astype(np.int64)


def confirmed(blocks: DataFrame) -> DataFrame:
    """EDGES of spanning forests of the true links in blocks of clusters (cluster, one, two, side, node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in grouped(batches, ["cluster", "one", "two"]):
            nodes, side, data = table.column("node").to_pylist(), table.column("side").to_numpy(), table.column("shingles")
            cross = table.column("one").to_numpy() != table.column("two").to_numpy()
            a, b = [], []
            for i, j in zip(at, at[1:], strict=False):
                rows = list({nodes[k]: k for k in range(i, j)}.values())  # rows equal in doc_id and text come more than once
                sets = [np.frombuffer(data[k].as_py(), "<u8") for k in rows]
                sizes, own_side = np.array([len(s) for s in sets]), side[rows]
                if len(sets) < 2:
                    continue
                common = overlaps(sets)
                linked = 100 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common)
                if cross[i]:
                    linked &= own_side[:, None] != own_side[None, :]
                for x, y in forest(len(sets), lambda k, linked=linked: np.flatnonzero(linked[k, k + 1 :]) + k + 1):
                    a.append(nodes[rows[x]])
                    b.append(nodes[rows[y]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return by_blocks(blocks, "cluster").mapInArrow(run, EDGES)


def confirmed_with_pivots(rows: DataFrame) -> DataFrame:
    """cluster, node, pivot of the rows (cluster, node, text, least, most and these two's shingles) whose texts' sets are linked with a pivot.

    Sets are made and compared in one Python operator: two in a row would keep two workers for each core.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows_at, pivots = filled(column(batch, "text")), [], []
            named = [(column(batch, c), column(batch, f"{c}_shingles")) for c in ("least", "most")]
            for i, j in runs(byte_sizes(texts), HASH_RUN_BYTES):
                for k, own in enumerate(Texts(texts[i:j].to_pylist()).shingles(WORDS), i):
                    found = {}
                    for name, shingles in named:
                        pivot = np.frombuffer(shingles[k].as_buffer(), "<u8")
                        common = len(np.intersect1d(own, pivot, assume_unique=True))
                        if 100 * common >= PERCENT * (len(own) + len(pivot) - common):
                            found[name[k].as_py()] = None  # the two can be one
                    rows_at += [k] * len(found)
                    pivots += found
            at = pa.array(rows_at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(column(batch, c).take(at) for c in ("cluster", "node")), pa.array(pivots, pa.binary())], ["cluster", "node", "pivot"])

    return rows.mapInArrow(run, "cluster binary, node binary, pivot binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of all nodes of edges (a, b), by large- and small-star steps."""
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        after = materialize(small, "edges")
        found = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        release(now)
        now = after
        if found == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = found


def with_texts(nodes: DataFrame, docs: DataFrame, is_few: bool) -> DataFrame:
    """nodes (w_id, w_hash: doc_id and text hash of a text, and others) with that text, read again from docs (doc_id, text_hash, text); is_few: nodes are within a measured bound."""
    kept = [c for c in nodes.columns if c not in ("w_id", "w_hash")]
    met = docs.join(F.broadcast(nodes) if is_few else nodes, (F.col("text_hash") == F.col("w_hash")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    return met.select(*kept, "text")


def with_sets(nodes: DataFrame, docs: DataFrame, is_few: bool) -> DataFrame:
    """nodes as in ``with_texts``, with the shingles of their texts."""
    kept = [c for c in nodes.columns if c not in ("w_id", "w_hash")]
    kinds = dict(nodes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(column(batch, "text"))
            for i, j in runs(byte_sizes(texts), HASH_RUN_BYTES):
                sets = [s.astype("<u8").tobytes() for s in Texts(texts[i:j].to_pylist()).shingles(WORDS)]
                yield pa.RecordBatch.from_arrays([*(column(batch, c)[i:j] for c in kept), pa.array(sets, pa.binary())], [*kept, "shingles"])

    return with_texts(nodes, docs, is_few).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", shingles binary")


def with_pivots(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """rows (least, most and others), once for each of the two pivots, with the columns of a written table of pivots (pivot, others)."""
    each = rows.withColumn("pivot", F.explode(F.array_distinct(F.array("least", "most")))).drop("least", "most")
    return join_measured(each, pivots, "pivot", "inner")


def name_as(pivots: DataFrame, name: str) -> DataFrame:
    """A written table of pivots (pivot, shingles) under the names of the least or the most member."""
    out = pivots.toDF(name, f"{name}_shingles")
    out.written_to = pivots.written_to  # for its measured size
    return out


def pivots_of(large: DataFrame) -> DataFrame:
    return large.select(F.explode(F.array("least", "most")).alias("node")).distinct()


def plausible_edges(classes: DataFrame) -> DataFrame:
    """EDGES of the plausible pairs of classes (node, n, sketch), a written table."""
    width = 4 * BAND_ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sketch", k * width + 1, F.lit(width))))
    bands = classes.select(F.explode(keys).alias("key"), "node")
    shared = materialize(bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "near-buckets")
    placed = materialize(bands.join(F.broadcast(shared.select("key")) if is_small(shared) else shared.select("key"), "key"), "near-members")
    is_few = is_small(placed)
    sketched = classes.select("node", "n", "sketch")

    def members(some: DataFrame) -> DataFrame:
        """The written members of some buckets with their sketches; where the members fit a broadcast, the sketches stay where they are."""
        kept = placed.join(some, "key")
        return sketched.join(F.broadcast(kept) if is_few else kept, "node")

    def ends(large: DataFrame) -> DataFrame:
        return placed.join(large, "key").groupBy("key", "m").agg(F.min("node").alias("least"), F.max("node").alias("most"))

    def fits(large: DataFrame) -> DataFrame:
        pivots = materialize(pivots_of(large).join(sketched, "node").toDF("pivot", "pivot_n", "pivot_sketch"), "near-pivots")
        return plausible_with_pivot(with_pivots(members(large.drop("m")), pivots))

    return linked(shared, "key", members, plausible, ends, fits)


def confirmed_edges(clusters: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """EDGES of the true links inside clusters (node, cluster) of classes (node, rep)."""
    rep = classes.select("node", F.col("rep.doc_id").alias("w_id"), F.col("rep.text_hash").alias("w_hash"))
    wanted = materialize(clusters.join(rep, "node"), "near-wanted")
    is_few = is_small(wanted)
    sizes = materialize(wanted.groupBy("cluster").agg(F.count("*").alias("m")), "near-clusters")
    members = lambda some: with_sets(wanted.join(some, "cluster"), docs, is_few)
    ends = lambda large: wanted.join(large, "cluster").groupBy("cluster", "m").agg(F.min("node").alias("least"), F.max("node").alias("most"))

    def fits(large: DataFrame) -> DataFrame:
        sets = with_sets(wanted.join(pivots_of(large), "node").select(F.col("node").alias("pivot"), "w_id", "w_hash"), docs, is_few)
        pivots = materialize(sets.groupBy("pivot").agg(F.first("shingles").alias("shingles")), "near-pivots")
        rows = with_texts(wanted.join(large.drop("m"), "cluster"), docs, is_few)
        for c in ("least", "most"):
            rows = join_measured(rows, name_as(pivots, c), c, "inner")
        return confirmed_with_pivots(rows)

    return linked(sizes, "cluster", members, confirmed, ends, fits)


def group_rows(docs: DataFrame) -> DataFrame:
    """A written table of row, doc_id, n_shingles, component_id and group (null for an empty set) of every row of docs (row, doc_id, text)."""
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = materialize(signed(docs), "near-signed")
    classes = materialize(
        rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "near-classes"
    )
    clusters = components(plausible_edges(classes)).withColumnRenamed("root", "cluster")
    groups = components(confirmed_edges(clusters, classes, docs))
    placed = groups.join(classes.select("node", "least_id"), "node")
    named = placed.join(placed.groupBy("root").agg(F.min("least_id").alias("group_id")), "root").select("node", "group_id", "root")
    joined = classes.select("node", "least_id").join(named, "node", "left")
    ids = joined.select("node", F.when(F.col("root").isNotNull(), F.col("group_id")).otherwise(F.col("least_id")).alias("component_id"), F.coalesce("root", "node").alias("group"))
    out = rows.select("row", "doc_id", "n_shingles", "node").join(ids, "node", "left")
    found = materialize(out.select("row", "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "group"), "near-rows")
    release(rows, classes)
    return found


def find_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    out = group_rows(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, in_files: bool = False) -> DataFrame:
    """docs (any columns) with one row of each group, that of the smallest (doc_id, row); rows of empty sets stay. in_files: see ``Keyed``."""
    own = Keyed(docs, in_files)
    found = group_rows(own.select("doc_id", "text"))
    first = found.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")).select("first.row")
    kept = materialize(first.union(found.where(F.col("group").isNull()).select("row")), "near-kept")
    release(found)
    return own.restored(join_measured(own.table, kept, "row", "left_semi"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_groups(documents(spark, sf_dir, "doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT i.x, i.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2) i
  JOIN n p ON p.doc_id = i.x JOIN n q ON q.doc_id = i.y WHERE 100 * i.c >= 75 * (p.n + q.n - i.c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT l.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id, l.doc_id = l.component_id AS kept
FROM least l LEFT JOIN n ON n.doc_id = l.doc_id
"""
