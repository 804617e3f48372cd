"""Router scores to experts: gates, greedy, group-limited and bias-corrected top-k, load, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s.cast("double") - top.cast("double")))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def sigmoid(scores: Column) -> Column:
    return F.transform(scores, lambda s: 1 / (1 + F.exp(-s.cast("double"))))


def top(scores: Column, k: int) -> Column:
    """(score, expert) of the k largest; of equal scores the first expert."""
    pairs = F.transform(scores, lambda s, e: F.struct((-s).alias("down"), e.alias("expert")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["down"]).alias("score"), p["expert"].alias("expert")))


def kept_groups(scores: Column, n_experts: int, groups: int, keep: int, best: int = 1) -> Column:
    """Scores with those outside the best groups set to 0; a group counts by the sum of its best scores."""
    per = n_experts // groups
    value = lambda g: F.aggregate(F.slice(F.reverse(F.array_sort(F.slice(scores, g * per + 1, F.lit(per)))), 1, best), F.lit(0.0), lambda a, s: a + s)
    order = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.struct((-value(g)).alias("down"), g.alias("group")))), 1, keep)
    chosen = F.transform(order, lambda p: p["group"])
    return F.transform(scores, lambda s, e: F.when(F.array_contains(chosen, F.floor(e / per).cast("int")), s).otherwise(F.lit(0.0)))


def route(scores: Column, k: int, method: str = "greedy", n_experts: int = 64, groups: int = 1, keep: int = 1, bias: Column | None = None, normalize: bool = False, factor: float = 1.0) -> Column:
    """(weight, expert) of the chosen experts."""
    s = F.transform(scores, lambda v: v.cast("double"))
    if method == "greedy":
        chosen = top(s, k)
    elif method == "group_limited_greedy":
        chosen = top(kept_groups(s, n_experts, groups, keep), k)
    elif method == "noaux_tc":
        biased = F.zip_with(s, bias if bias is not None else F.transform(s, lambda _: F.lit(0.0)), lambda a, b: a + b)
        chosen = F.transform(top(kept_groups(biased, n_experts, groups, keep, best=2), k), lambda p: F.struct(F.get(s, p["expert"]).alias("score"), p["expert"].alias("expert")))
    else:
        raise ValueError(f"unknown method {method}")
    whole = F.aggregate(chosen, F.lit(0.0), lambda a, p: a + p["score"]) + 1e-20
    scale = (lambda p: p["score"] / whole * factor) if normalize and k > 1 else (lambda p: p["score"] * factor)
    return F.transform(chosen, lambda p: F.struct(scale(p).alias("weight"), p["expert"].alias("expert")))


def load(routed: DataFrame, chosen: str = "chosen") -> DataFrame:
    """expert, tokens, weight: how many rows each expert got, and their mean weight."""
    return routed.select(F.explode(chosen).alias("c")).groupBy("c.expert").agg(F.count("*").alias("tokens"), F.avg("c.weight").alias("weight"))


def auxiliary_loss(routed: DataFrame, scores: str, chosen: str, n_experts: int, k: int, alpha: float = 0.001) -> DataFrame:
    """aux_loss: load share times mean score over experts."""
    n = routed.agg(F.count("*").alias("n"))
    mean = routed.select(F.posexplode(scores).alias("expert", "score")).groupBy("expert").agg(F.avg("score").alias("mean_score"))
    share = load(routed, chosen).join(mean, "expert").crossJoin(F.broadcast(n))  # one row
    return share.agg((F.sum(F.col("tokens") / (F.col("n") * k) * n_experts * F.col("mean_score")) * alpha).alias("aux_loss"))


def dispatch(routed: DataFrame, key: str, chosen: str = "chosen", parts: int = 256) -> DataFrame:
    """key, expert, weight, slot: rows in the order of their experts, as they would be sent there; ``collect_back`` undoes it.

    key is a number. Its quantiles cut the rows into parts; slots are the rows of earlier parts, from a
    prefix sum over one count for each (expert, part), and the place inside the part, so an expert is
    the work of many tasks.
    """
    shares = [k / parts for k in range(1, parts)]
    cuts = sorted(set(routed.agg(F.percentile_approx(F.col(key).cast("double"), shares, 20 * parts).alias("q")).first()["q"] or []))
    part = F.size(F.filter(F.lit(cuts), lambda q: q < F.col(key))) if cuts else F.lit(0)
    each = routed.select(key, part.alias("part"), F.explode(chosen).alias("c")).select(key, "part", "c.expert", "c.weight")
    before = Window.partitionBy("expert").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.groupBy("expert", "part").agg(F.count("*").alias("n"))
    bases = counts.select("expert", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("expert", "part").orderBy(key)) - 1
    return each.withColumn("place", place).join(bases, ["expert", "part"]).select(key, "expert", "weight", (F.col("base") + F.col("place")).cast("long").alias("slot"))


def collect_back(answers: DataFrame, key: str, value: str) -> DataFrame:
    """Weighted sums of the experts' answers for each row."""
    return answers.groupBy(key).agg(F.sum(F.col(value) * F.col("weight")).alias(value))
