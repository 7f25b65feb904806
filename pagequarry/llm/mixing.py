"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A budget of tokens (words) flows down a domain - language - source tree. At each
node it is split among the children by weight; a child that cannot use its share,
with all epochs it may have, takes what it can, and the shortage goes to its
siblings by their weights before any of it reaches the siblings of an ancestor.
This is water-filling: with children in order of capacity / weight, all up to
some point take their capacity and the others share the rest by weight. It is
solved by running sums over the children of each node, a table as small as the
tree.

A leaf's budget buys whole epochs and then a prefix of one more: documents in the
order of md5(seed:epoch:doc_id), as long as the running sum of their tokens stays
within what is left. The running sum is split so that no leaf meets in one task:
tokens are summed by the first three hex digits of the md5, whole buckets below
the boundary are taken, and only the boundary bucket is summed row by row.

Nulls: null or unknown values of a level form a node "unknown"; documents without
words weigh nothing and are taken in each whole epoch. Rows with equal doc_id are
rows of their own and fall together in order; ties are ordered by tokens, and
equal rows are taken or left together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import broadcast_if_small, text_or_empty, words_of, written

#: Domain of a source, by the last digits of its name: four shelves of five sources.
DOMAINS = ("web", "books", "forums", "news")
#: Weights of the production mixture; what is not named weighs 10.
WEIGHTS = {"web": 40, "books": 30, "forums": 10, "news": 20, "en": 60, "de": 15, "fr": 15, "es": 10}
OTHER_WEIGHT = 10
#: The budget is this percentage of all tokens, and each document may be taken so often.
BUDGET_PERCENT = 80
MAX_EPOCHS = 2
SEED = 17
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The shelf of a source name such as src7; "unknown" for a name without a number."""
    number = F.regexp_extract(source, "(\\d{1,9})$", 1)
    return F.when(number == "", F.lit("unknown")).otherwise(F.get(F.array(*[F.lit(d) for d in DOMAINS]), (number.cast("int") % len(DOMAINS)).cast("int")))


def weight_of(name: Column, weights: dict[str, int] = WEIGHTS) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for key, value in weights.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast("long")


def leaves_of(docs: DataFrame) -> DataFrame:
    """docs with domain, lang, source as __pq_ columns of the tree, and the tokens of each row."""
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    return docs.withColumns({"__pq_domain": F.coalesce(domain_of(F.col("source")), F.lit("unknown")), "__pq_lang": known("lang"), "__pq_source": known("source"), "__pq_tokens": F.size(words_of(text_or_empty())).cast("long")})


def _fill(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Split each parent's ``budget`` among its children (name, weight, capacity): adds ``share``.

    Whole tokens; what rounding leaves goes to the children with the largest
    remainders, then by name.
    """
    by = Window.partitionBy(*[F.col(p) for p in parents]) if parents else Window.partitionBy(F.lit(1))
    order = by.orderBy(F.col("capacity") / F.col("weight"), name)
    df = children.withColumn("filled", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    df = df.withColumn("full", (wide("budget") - wide("filled")) * wide("weight") >= wide("capacity") * wide("weights"))
    df = df.withColumn("full", F.min(F.col("full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    df = df.withColumn("open_budget", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0)))
    df = df.withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(by))
    exact = F.expr("cast(open_budget as decimal(38,0)) * weight div open_weight")
    remainder = F.expr("(cast(open_budget as decimal(38,0)) * weight) % open_weight")
    df = df.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(exact)).withColumn("rest", F.when(~F.col("full"), remainder))
    df = df.withColumn("spare", F.col("budget") - F.sum("share").over(by))
    rank = F.row_number().over(by.orderBy(F.desc_nulls_last("rest"), name))
    df = df.withColumn("share", F.col("share") + F.when(~F.col("full") & (rank <= F.col("spare")) & (F.col("share") < F.col("capacity")), 1).otherwise(0))
    return df.drop("filled", "weights", "full", "open_budget", "open_weight", "rest", "spare")


def budgets(leaves: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """leaves (domain, lang, source, tokens) with share, the tokens each leaf may give: the tree from the top down."""
    leaves = leaves.where("tokens > 0").withColumn("capacity", F.col("tokens") * max_epochs)
    total = leaves.agg(F.expr(f"sum(tokens) * {budget_percent} div 100").alias("total"), F.sum("capacity").alias("all"))
    budget = total.select(F.least("total", "all").alias("budget"))
    above: list[str] = []
    node = None
    for level in LEVELS:
        keys = [*above, level]
        children = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(F.col(level), weights))
        children = children.crossJoin(F.broadcast(budget)) if node is None else children.join(node, above)
        # A table as small as the tree; written, as the levels' windows on top of each other are a plan that takes the driver much memory.
        node = written(_fill(children, above, level).select(*keys, F.col("share").alias("budget")), f"mix-{level}")
        above = keys
    return leaves.join(node, list(LEVELS)).select(*LEVELS, "tokens", F.col("budget").alias("share"))


def _order(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights: dict[str, int] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of docs that the mixture takes, once per epoch that takes them.

    docs needs doc_id, text, lang and source. Adds epoch (from 1), domain and
    n_tokens, replacing columns of these names; all other columns pass through.
    """
    full = "cast(share div tokens as int)"
    rows = leaves_of(docs)
    light = rows.select("doc_id", *[F.col(f"__pq_{k}").alias(k) for k in LEVELS], F.col("__pq_tokens").alias("n"))
    light = written(light, "mix-rows")
    leaves = written(light.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")), "mix-leaves")
    plan = budgets(leaves, budget_percent, max_epochs, weights)
    plan = leaves.join(plan.select(*LEVELS, "share"), list(LEVELS), "left")
    plan = plan.select(*LEVELS, F.expr(f"if(tokens = 0, 1, {full})").alias("full"), F.expr("if(tokens = 0, 0, share - share div tokens * tokens)").alias("left"))
    plan = broadcast_if_small(written(plan, "mix-plan"), 100_000)
    keyed = light.join(plan, list(LEVELS)).where("left > 0").withColumn("key", _order(F.col("full") + 1, seed))
    buckets = keyed.groupBy(*LEVELS, F.substring("key", 1, 3).alias("bucket"), "left").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    buckets = buckets.withColumn("upto", upto).where("upto > left")
    boundary = buckets.groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("b"), F.first("left").alias("left"))
    boundary = broadcast_if_small(written(boundary.select(*LEVELS, "b.bucket", "b.before", "left"), "mix-boundary"), 100_000)
    inside = keyed.drop("left").join(boundary, list(LEVELS)).where(F.substring("key", 1, 3) == F.col("bucket"))
    running = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key", "n").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("running", running + F.col("before")).where(F.col("running") <= F.col("left"))
    last = last.groupBy(*LEVELS).agg(F.max(F.struct("key", "n")).alias("last"))
    cut = boundary.select(*LEVELS, "bucket").join(last, list(LEVELS), "left")
    cut = broadcast_if_small(written(cut, "mix-cut"), 100_000)

    plan = plan.select(*[F.col(k).alias(f"__pq_{k}") for k in LEVELS], F.col("full").alias("__pq_full"), (F.col("left") > 0).alias("__pq_partly"))
    cut = cut.select(*[F.col(k).alias(f"__pq_{k}") for k in LEVELS], F.col("bucket").alias("__pq_bucket"), F.col("last").alias("__pq_last"))
    on = [f"__pq_{k}" for k in LEVELS]
    out = rows.join(plan, on).join(cut, on, "left").withColumn("__pq_key", _order(F.col("__pq_full") + 1, seed))
    mine = F.struct(F.col("__pq_key").alias("key"), F.col("__pq_tokens").alias("n"))
    below = F.col("__pq_bucket").isNull() | (F.substring("__pq_key", 1, 3) < F.col("__pq_bucket")) | F.coalesce(mine <= F.col("__pq_last"), F.lit(False))
    times = F.col("__pq_full") + (F.col("__pq_partly") & below).cast("int")
    out = out.withColumn("__pq_times", times).where("__pq_times > 0")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("__pq_times")))).withColumn("domain", F.col("__pq_domain")).withColumn("n_tokens", F.col("__pq_tokens"))
    return out.drop(*[c for c in out.columns if c.startswith("__pq_")])

