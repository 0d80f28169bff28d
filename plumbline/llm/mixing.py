"""Mixing sources to target weights by hierarchical budgeting (JVM only).

A tree domain > language > source hangs under one token budget. Capacities (tokens times `max_epochs`) are summed
bottom-up. Budgets go top-down: among siblings, each gets its weight's share, and whoever cannot use its share gives
the shortage to its siblings (water filling in closed form, one window per level); only what no sibling can take is
missing at the parent. Inside a leaf, every epoch is a seeded order of its documents: whole epochs are taken while
they fit, then the prefix of the next one whose tokens fit.

A leaf may hold a third of all rows, so a prefix is found in two levels: tokens are summed by the first three hex
digits of the order key (4096 buckets), whole buckets below the cut are taken as they are, and only rows of the one
bucket at the cut are sorted.

Defined cases: a null language or source is a leaf named "" ; a null text has one token, as has an empty one; rows
that repeat an id stay separate rows; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

P = "__m_"
BROADCAST_LEAVES = 100_000
DOMAINS = {f"src{i}": d for d, ids in {"web": range(0, 5), "books": range(5, 10), "forum": range(10, 15), "code": range(15, 20)}.items() for i in ids}
#: Weights are whole numbers; a name that is not listed weighs DEFAULT.
WEIGHTS = {"domain": {"web": 400, "books": 250, "forum": 200, "code": 150}, "lang": {"en": 600, "fr": 150, "de": 150, "es": 100}, "source": {}}
DEFAULT = 100
LEVELS = ("domain", "lang", "source")


def _pick(column, names: dict, default):
    out = None
    for k, v in names.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _shares(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Water filling: `nodes` has the parent's columns, the parent's budget, a weight and a capacity; adds `alloc`."""
    order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), name)
    group = Window.partitionBy(*parents)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    narrow = lambda c: F.col(c).cast("decimal(17,0)")
    n = (
        nodes.withColumn("b_rem", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_rem", F.sum("weight").over(after))
        .withColumn("full", wide("cap") * narrow("w_rem") <= wide("b_rem") * narrow("weight"))
        .withColumn("b_star", F.max(F.when(~F.col("full"), F.col("b_rem"))).over(group))
        .withColumn("w_star", F.max(F.when(~F.col("full"), F.col("w_rem"))).over(group))
        .withColumn("w_before", F.col("w_star") - F.col("w_rem"))
        .withColumn("w_upto", F.col("w_before") + F.col("weight"))
    )
    part = lambda c: F.expr(f"(cast(b_star as decimal(20,0)) * cast({c} as decimal(17,0))) div cast(w_star as decimal(17,0))")
    return n.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(part("w_upto") - part("w_before"))).drop(
        "b_rem", "w_rem", "full", "b_star", "w_star", "w_before", "w_upto"
    )


def leaf_budgets(leaves: DataFrame, budget: int | None = None, max_epochs: int = 2, weights: dict | None = None) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with the token budget of each in `alloc`.

    `budget` None: all tokens of one epoch. Never over what `max_epochs` epochs hold."""
    weights = weights or WEIGHTS
    cap = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    lang = cap.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domain = lang.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    everything = Window.partitionBy()
    asked = F.sum("tokens").over(everything) if budget is None else F.lit(int(budget))
    w = lambda level: _pick(F.col(level), weights.get(level, {}), DEFAULT).cast("long")
    domain = domain.withColumn("budget", F.least(asked, F.sum("cap").over(everything))).withColumn("weight", w("domain"))
    domain = _shares(domain, [], "domain").select("domain", F.col("alloc").alias("budget"))
    lang = _shares(lang.join(domain, "domain").withColumn("weight", w("lang")), ["domain"], "lang")
    lang = lang.select("domain", "lang", F.col("alloc").alias("budget"))
    return _shares(cap.join(lang, ["domain", "lang"]).withColumn("weight", w("source")), ["domain", "lang"], "source").select(
        *LEVELS, "tokens", "alloc"
    )


def order_key(seed: int, epoch, doc_id):
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, budget: int | None = None, max_epochs: int = 2, seed: int = 13, domains: dict | None = None, weights: dict | None = None, carry: list[str] | None = None) -> DataFrame:
    """Rows of docs chosen by the mixture, once per epoch that takes them, with prefixed columns: domain, lang,
    source, n_tokens, epoch."""
    domains = DOMAINS if domains is None else domains
    level = {"lang": F.coalesce(docs["lang"].cast("string"), F.lit("")), "source": F.coalesce(docs["source"].cast("string"), F.lit(""))}
    keep = docs.columns if carry is None else carry
    lean = common.materialize(
        docs.select(
            *[docs[f"`{c}`"] for c in keep],
            docs["doc_id"].alias(P + "id"),
            _pick(level["source"], domains, "other").alias(P + "domain"),
            level["lang"].alias(P + "lang"),
            level["source"].alias(P + "source"),
            F.greatest(F.size(common.words_of(docs["text"])), F.lit(1)).cast("long").alias(P + "n_tokens"),
        ),
        "mix",
    )
    leaf = [P + x for x in LEVELS]
    sums = lean.groupBy(*leaf).agg(F.sum(P + "n_tokens").alias("tokens"))
    sums = common.materialize(sums.select(*[F.col(P + x).alias(x) for x in LEVELS], "tokens"), "leaves")
    plan = leaf_budgets(sums, budget, max_epochs, weights)
    plan = plan.select(
        *[F.col(x).alias(P + x) for x in LEVELS],
        F.expr("alloc div tokens").cast("int").alias(P + "whole"),
        F.expr("alloc - (alloc div tokens) * tokens").alias(P + "rest"),
    )
    plan = common.materialize(plan, "plan")
    few = plan.count() <= BROADCAST_LEAVES
    small = F.broadcast if few else (lambda x: x)
    keyed = lean.join(small(plan), leaf).withColumn(P + "key", order_key(seed, F.col(P + "whole"), F.col(P + "id")))
    keyed = keyed.withColumn(P + "bucket", F.substring(P + "key", 1, 3))
    # Tokens by bucket of the order key, for leaves that take part of an epoch.
    per = keyed.where(F.col(P + "rest") > 0).groupBy(*leaf, P + "bucket", P + "rest").agg(F.sum(P + "n_tokens").alias(P + "t"))
    upto = Window.partitionBy(*leaf).orderBy(P + "bucket").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn(P + "upto", F.sum(P + "t").over(upto))
    cut = per.where(F.col(P + "upto") > F.col(P + "rest"))
    cut = cut.groupBy(*leaf).agg(F.min(F.struct(P + "bucket", (F.col(P + "upto") - F.col(P + "t")).alias(P + "before"))).alias(P + "c"))
    cut = common.materialize(cut.select(*leaf, F.col(P + "c." + P + "bucket").alias(P + "cut"), F.col(P + "c." + P + "before").alias(P + "before")), "cuts")
    dealt = keyed.join(small(cut), leaf, "left")
    taken = F.col(P + "rest") > 0
    sure = dealt.withColumn(
        P + "epochs", F.when(taken & (F.col(P + "bucket") < F.col(P + "cut")), F.col(P + "whole") + 1).otherwise(F.col(P + "whole"))
    ).where(F.col(P + "epochs") > 0)
    sure = sure.withColumn(P + "epoch", F.explode(F.sequence(F.lit(0), F.col(P + "epochs") - 1)))
    edge = dealt.where(taken & (F.col(P + "bucket") == F.col(P + "cut")))
    inside = Window.partitionBy(*leaf).orderBy(P + "key", P + "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn(P + "run", F.sum(P + "n_tokens").over(inside) + F.col(P + "before"))
    edge = edge.where(F.col(P + "run") <= F.col(P + "rest")).withColumn(P + "epoch", F.col(P + "whole"))
    out = [*[F.col(f"`{c}`") for c in keep], *[F.col(P + x) for x in (*LEVELS, "n_tokens", "epoch")]]
    return sure.select(*out).unionByName(edge.select(*out))


def mixing_query(docs: DataFrame) -> DataFrame:
    m = mix(docs.select("doc_id", "text", "lang", "source"), carry=["doc_id"])
    return m.select("doc_id", *[F.col(P + x).alias(x) for x in (*LEVELS, "n_tokens", "epoch")])


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture with the columns of docs only; a document that several epochs take is repeated."""
    return mix(docs, **options).select(*[F.col(f"`{c}`") for c in docs.columns])


def _case(column: str, names: dict, default) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {q(v)}" for k, v in names.items()) + f" ELSE {q(default)} END" if names else q(default)


def _share_sql(name: str, source: str, parents: str, level: str) -> str:
    part = f"PARTITION BY {parents}" if parents else ""
    keys = f"{parents}, {level}" if parents else level
    return f"""
{name}_a AS (SELECT *, (budget - coalesce(sum(cap) OVER ({part} ORDER BY cap::DOUBLE / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS b_rem,
  (sum(weight) OVER ({part} ORDER BY cap::DOUBLE / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS w_rem FROM {source}),
{name}_b AS (SELECT *, cap::HUGEINT * w_rem <= b_rem * weight AS full_ FROM {name}_a),
{name}_c AS (SELECT *, max(CASE WHEN NOT full_ THEN b_rem END) OVER ({part}) AS bs, max(CASE WHEN NOT full_ THEN w_rem END) OVER ({part}) AS ws FROM {name}_b),
{name} AS (SELECT {keys}, tokens, (CASE WHEN full_ THEN cap ELSE (bs * (ws - w_rem + weight)) // ws - (bs * (ws - w_rem)) // ws END)::BIGINT AS alloc FROM {name}_c)"""


MIXING_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_case("coalesce(source, '')", DOMAINS, 'other')} AS domain, coalesce(lang, '') AS lang,
         coalesce(source, '') AS source, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * 2)::BIGINT AS cap FROM d GROUP BY ALL),
l2 AS (SELECT domain, lang, sum(tokens)::BIGINT AS tokens, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL),
l1 AS (SELECT domain, sum(tokens)::BIGINT AS tokens, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL),
n1 AS (SELECT *, least(sum(tokens) OVER (), sum(cap) OVER ())::BIGINT AS budget, {_case('domain', WEIGHTS['domain'], DEFAULT)} AS weight FROM l1),
{_share_sql('s1', 'n1', '', 'domain')},
n2 AS (SELECT l2.*, s1.alloc AS budget, {_case('lang', WEIGHTS['lang'], DEFAULT)} AS weight FROM l2 JOIN s1 USING (domain)),
{_share_sql('s2', 'n2', 'domain', 'lang')},
n3 AS (SELECT leaves.*, s2.alloc AS budget, {DEFAULT} AS weight FROM leaves JOIN s2 USING (domain, lang)),
{_share_sql('s3', 'n3', 'domain, lang', 'source')},
k AS (
  SELECT d.*, (alloc // tokens)::INT AS whole, alloc % tokens AS rest, md5('13:' || (alloc // tokens)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM d JOIN s3 USING (domain, lang, source)),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole + (run <= rest)::INT))::INT AS epoch FROM r
"""
