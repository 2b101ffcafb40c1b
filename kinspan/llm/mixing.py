"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A budget of tokens goes down from the root: children share their parent's by
weight, one that holds less than its share (in `epochs` passes) gives all it has, and its shortage goes to its siblings
by weight until all are full; only what a whole family cannot supply is short at the parent, where the parent's own
siblings take it up. A leaf's budget is whole epochs of its documents and a prefix, in tokens, of one more; an epoch's
order is the MD5 of seed, epoch and document. The prefix is found without sorting a leaf: tokens are summed by leaf and
bucket of the order's leading digits, whole buckets are in or out, and only the bucket in which the prefix ends is
sorted. Everything is DataFrame functions; no table by leaf is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.llm.common import NON_WS, read, stage

SHARE_OF_TOKENS, EPOCHS, SEED = 0.6, 2, 17
#: Hexadecimal digits that make a bucket of a leaf; one more for each 16-fold beyond LEAF documents in the largest leaf,
#: so that the one bucket that is sorted holds about LEAF / 16**DIGITS documents at any size.
DIGITS, LEAF = 2, 1 << 20
LEVELS = ("domain", "lang", "source")
MISSING = "(none)"
#: Target weights of the registered query and the pipeline: of a node against its siblings, by level (1 domain, 2 language,
#: 3 source) and name; 1 where they are silent.
WEIGHTS = [(1, "domain0", 3.0), (1, "domain1", 2.0), (1, "domain3", 0.5), (2, "en", 4.0), (2, "de", 2.0), (2, "fr", 1.5), (3, "src0", 0.25), (3, "src5", 2.0), (3, "src10", 3.0)]


def target_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "depth int, name string, weight double")


def default_domain(source: Column) -> Column:
    """The domain of a source name: its trailing number modulo 4, or `other`."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as int)") % 4).cast("string")))


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Fill `children` (capacity, weight, budget of their parent) to a common level within each parent; adds `given`."""
    # in order of capacity by weight, a child is full as long as the level that is left reaches it
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), *[c for c in LEVELS if c in children.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = children.withColumn("level", level).withColumn("full", F.col("capacity") <= F.col("weight") * F.col("level"))
    # the level at the first child that isn't full; it only falls after that
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent))
    return filled.withColumn("final", final).withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(F.col("weight") * F.col("final"))).drop("level", "full", "final")


def budgets(leaves: DataFrame, share: float, epochs: int, weights: DataFrame | None = None) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with `given`, the tokens to take from each."""
    leaves = leaves.withColumn("capacity", F.col("tokens").cast("double") * epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    given = None
    for depth in range(1, len(LEVELS) + 1):
        names, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = leaves.groupBy(*names).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        else:
            mine = weights.filter((F.col("depth") == depth) & (F.col("weight") > 0)).groupBy(F.col("name").alias(names[-1])).agg(F.max("weight").cast("double").alias("weight"))
            nodes = nodes.join(mine, names[-1], "left").fillna({"weight": 1.0})
        nodes = nodes.withColumn("budget", F.lit(float(total) * share)) if given is None else nodes.join(given.select(*parent, F.col("given").alias("budget")), parent)
        given = stage(share_out(nodes, parent), "budgets")
    return given.select(*LEVELS, "tokens", "given")


def mix(docs: DataFrame, share: float = SHARE_OF_TOKENS, epochs: int = EPOCHS, seed: int = SEED, weights: DataFrame | None = None) -> DataFrame:
    """Choose documents so that tokens follow the tree's weights; `share` of all tokens (white-space words) is wanted.

    Takes doc_id, text, lang, source; other columns are ignored. `weights` (depth 1 to 3, name, weight) weighs nodes
    against their siblings, 1 where it is silent, null or not above 0; the largest counts if it has several. Returns doc_id, domain, lang, source, n_tokens and copies (whole
    epochs and, if the prefix reaches it, one more), a row for each document with copies > 0. A null lang or source is
    the child "(none)". Documents without words supply nothing and are not chosen. A leaf's prefix ends with the
    document that reaches its budget; equal order values go by doc_id, so repeated rows count and are chosen together
    or one by one. A row without doc_id is ordered first by an empty name. An empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        default_domain(F.col("source")).alias("domain"),
        F.coalesce("lang", F.lit(MISSING)).alias("lang"),
        F.coalesce("source", F.lit(MISSING)).alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"{NON_WS}+")).cast("long").alias("n_tokens"),
    ).filter("n_tokens > 0")
    rows = stage(rows, "mixing")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    largest, digits = rows.groupBy(*LEVELS).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0], DIGITS
    while largest > LEAF * 16 ** (digits - DIGITS):
        digits += 1
    plan = budgets(leaves, share, epochs, weights)
    # whole epochs, and the tokens wanted of the next
    whole = F.floor(F.least(F.col("given"), F.col("tokens") * F.lit(float(epochs))) / F.col("tokens") + 1e-9)
    plan = stage(plan.withColumn("whole", whole.cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("given") - F.col("whole") * F.col("tokens"))).select(*LEVELS, "whole", F.when(F.col("rest") < 1e-6 * F.col("tokens"), 0.0).otherwise(F.col("rest")).alias("rest")), "plan")

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ordered = rows.join(plan, list(LEVELS)).withColumn("order", order).withColumn("bucket", F.substring("order", 1, digits))
    by_bucket = ordered.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("sum"))
    until = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(by_bucket.withColumn("before", F.coalesce(F.sum("sum").over(until), F.lit(0))).drop("sum"), "buckets")
    # written, so that its size is known where it is joined: a row for each leaf
    edge = stage(starts.join(plan, list(LEVELS)).filter("before < rest").groupBy(*LEVELS).agg(F.max(F.struct("before", "bucket")).alias("edge")), "edges")
    placed = ordered.join(edge, list(LEVELS), "left")
    columns = ["doc_id", *LEVELS, "n_tokens"]
    inside = placed.filter(F.col("edge").isNull() | (F.col("bucket") != F.col("edge.bucket"))).select(*columns, (F.col("whole") + F.coalesce((F.col("bucket") < F.col("edge.bucket")).cast("int"), F.lit(0))).alias("copies"))
    run = Window.partitionBy(*LEVELS).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = placed.filter(F.col("bucket") == F.col("edge.bucket")).withColumn("start", F.col("edge.before") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
    at_edge = at_edge.select(*columns, (F.col("whole") + (F.col("start") < F.col("rest")).cast("int")).alias("copies"))
    return inside.unionByName(at_edge).filter("copies > 0")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), weights=target_weights(spark))


def _level_sql(depth: int) -> str:
    """The common table expressions that share out one level: nodes, then `given`."""
    names, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
    keys, by = ", ".join(names), f"partition by {', '.join(parent)}" if parent else ""
    order = f"{by} order by capacity / weight, {keys}"
    budget = f"(select sum(tokens) from leaves)::double * {SHARE_OF_TOKENS}" if not parent else f"(select g.given from given{depth - 1} g where {' and '.join(f'g.{x} = n.{x}' for x in parent)})"
    return f"""
node{depth} as (select {keys}, sum(tokens)::double * {EPOCHS} capacity, sum(tokens) tokens from leaves group by {keys}),
want{depth} as (select n.*, coalesce(w.weight, 1.0) weight, {budget} budget from node{depth} n left join weights w on w.depth = {depth} and w.name = n.{names[-1]}),
level{depth} as (select *, (budget - coalesce(sum(capacity) over (PREV rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (PREV rows between current row and unbounded following) as lev from want{depth}),
final{depth} as (select *, capacity <= weight * lev as fits, max(case when not capacity <= weight * lev then lev end) over ({by}) as final from level{depth}),
given{depth} as (select {keys}, tokens, case when fits then capacity else weight * final end given from final{depth})""".replace("PREV", order)


OP6_SQL = rf"""
with weights as (select * from (values {", ".join(f"({d}, '{n}', {w}::double)" for d, n, w in WEIGHTS)}) v(depth, name, weight)),
docs as (
  select doc_id, coalesce(lang, '{MISSING}') lang, coalesce(source, '{MISSING}') source,
    case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' then 'other'
         else 'domain' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::int % 4) end as domain,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) n_tokens
  from documents
), words as (select * from docs where n_tokens > 0),
leaves as (select domain, lang, source, sum(n_tokens) tokens from words group by all),
{",".join(_level_sql(d) for d in (1, 2, 3))},
plan as (select domain, lang, source, tokens, given, floor(least(given, tokens * {EPOCHS}::double) / tokens + 1e-9)::int whole from given3),
wanted as (select *, case when greatest(0, given - whole * tokens) < 1e-6 * tokens then 0 else greatest(0, given - whole * tokens) end rest from plan),
run as (
  select w.*, p.whole, p.rest, coalesce(sum(n_tokens) over (partition by domain, lang, source order by md5('{SEED}:' || p.whole || ':' || coalesce(doc_id::varchar, '')), doc_id rows between unbounded preceding and 1 preceding), 0) as start
  from words w join wanted p using (domain, lang, source)
)
select doc_id, domain, lang, source, n_tokens, whole + (start < rest)::int as copies from run where whole + (start < rest)::int > 0
"""
