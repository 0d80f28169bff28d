"""Quality rules with host-level verdicts (JVM only).

Each document is measured once. Its own rule failures are then aggregated by host; a host's failure rate is shrunk
towards the corpus with a beta prior fitted to all hosts by the method of moments; hosts whose shrunk rate exceeds
`host_limit` are rejected, and the verdict is joined back to their documents.

Defined cases: a null text has no words and fails the base rule; a null host is a host of its own; repeated rows
are judged each for itself; empty tables give empty results; other columns pass through untouched, also when their
names clash with ours (working columns carry a prefix). Equality of word triples is judged on a 64-bit hash of the
three words: for a text of n words a false repeat has probability below n*n/2**64.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

P = "__q_"
SYMBOLS = "#*$%&|<>"
#: Hosts tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_HOSTS = 100_000


def _repeat_words(w):
    """Words in 3-word windows found twice or more in the array w (a lambda variable, so it is computed once)."""
    triples = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - 2), lambda i: F.xxhash64(F.get(v, i - 1), F.get(v, i), F.get(v, i + 1)))
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def covered(h):
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        n = F.size(h)
        twice = lambda s: F.filter(s, lambda x, k: ((k > 0) & (x["h"] == F.get(s, k - 1)["h"])) | ((k < n - 1) & (x["h"] == F.get(s, k + 1)["h"])))
        places = bind(ranked, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        gaps = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
        return bind(places, gaps)

    found = bind(triples(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(found)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures of each whole text in columns named with the prefix."""
    own = F.col(f"`{text}`")
    t = F.coalesce(own, F.lit(""))
    base = docs.withColumn(P + "w", common.words_of(own))
    w = F.col(P + "w")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, common.BLANKS, "") != "")
    pair = F.get(F.transform(F.array(lines), lambda v: F.struct(F.size(v).alias("n"), F.size(F.array_distinct(v)).alias("d"))), F.lit(0))
    return (
        base.select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.size(w).cast("long").alias(P + "n_words"),
            F.length(F.translate(t, common.BLANKS, "")).cast("long").alias(P + "word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias(P + "n_symbols"),
            (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias(P + "n_shouts"),
            pair.alias(P + "lines"),
            F.get(F.transform(F.array(w), _repeat_words), F.lit(0)).cast("long").alias(P + "n_repeat_words"),
        )
        .withColumn(P + "n_lines", F.col(P + "lines.n").cast("long"))
        .withColumn(P + "n_dup_lines", (F.col(P + "lines.n") - F.col(P + "lines.d")).cast("long"))
        .drop(P + "lines")
    )


def judge(measured: DataFrame, symbol_pct: int = 30, dup_line_pct: int = 30, shout_pct: int = 50) -> DataFrame:
    """Adds base_failed (the contract's rule) and failed (any rule): symbols a word, repeated lines, shouting."""
    c = lambda x: F.col(P + x)
    base = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    soft = (
        (100 * c("n_symbols") > symbol_pct * c("n_words"))
        | (100 * c("n_dup_lines") > dup_line_pct * c("n_lines"))
        | (100 * c("n_shouts") > shout_pct * c("n_words"))
    )
    return measured.withColumn(P + "base_failed", base).withColumn(P + "failed", base | soft)


def host_verdicts(judged: DataFrame, host: str = "source", host_limit: float = 0.6) -> DataFrame:
    """(host key, rows, failures, shrunk rate, rejected): one row a host.

    Partial aggregation leaves one row per host and task, so a host with a third of all rows costs no more than
    another. The prior needs four sums over hosts, which is all that reaches the driver.
    """
    per = common.materialize(
        judged.groupBy(F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\x00null")).alias(P + "host")).agg(
            F.count("*").alias(P + "rows"), F.sum(F.col(P + "failed").cast("long")).alias(P + "bad")
        ),
        "hosts",
    )
    rate = F.col(P + "bad") / F.col(P + "rows")
    s = per.agg(F.count("*").alias("k"), F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v")).first()
    m, v = (s["m"] or 0.0), (s["v"] or 0.0)
    m = min(max(m, 1e-3), 1 - 1e-3)
    # Strength of the prior in documents: at least 2, at most 1000 (hosts that hardly differ).
    strength = min(max(m * (1 - m) / v - 1 if v > 0 else 1000.0, 2.0), 1000.0)
    shrunk = (F.col(P + "bad") + F.lit(m * strength)) / (F.col(P + "rows") + F.lit(strength))
    out = per.withColumn(P + "rate", shrunk).withColumn(P + "host_rejected", F.col(P + "rate") > host_limit)
    return F.broadcast(out) if s["k"] <= BROADCAST_HOSTS else out


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None, host_limit: float = 0.6) -> DataFrame:
    """Measures, base_failed and kept for every row, beside the columns in `carry` (all by default).

    The measured rows are written once to the shared folder: the host aggregate and the join back both read them.
    """
    lean = docs if carry is None else docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, host, text])])
    judged = judge(measure(lean, text))
    if carry is not None:
        judged = judged.drop(*({text} - set(carry)))
    judged = common.materialize(judged, "quality")
    hosts = host_verdicts(judged, host, host_limit).select(P + "host", P + "rate", P + "host_rejected")
    joined = judged.withColumn(P + "host", F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\x00null"))).join(hosts, P + "host", "left")
    return joined.withColumn(P + "kept", ~F.col(P + "failed") & ~F.coalesce(F.col(P + "host_rejected"), F.lit(False))).drop(P + "host")


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with their own columns only."""
    return apply_rules(docs, text, host).where(F.col(P + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_query(docs: DataFrame) -> DataFrame:
    c = lambda x: F.col(P + x).alias(x)
    out = apply_rules(docs.select("doc_id", "source", "text"), carry=["doc_id", "source"])
    return out.select("doc_id", *map(c, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")))


#: DuckDB SQL of quality_query at its default parameters.
QUALITY_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
tri AS (
  SELECT rid, i, hash(w[i], w[i+1], w[i+2]) AS h
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 4)),
twice AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, h) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, host, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_shouts,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
j AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words
          OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_shouts > 50 * n_words) AS failed FROM m),
h AS (SELECT host, count(*) AS n, sum(failed::INT) AS bad FROM j GROUP BY host),
s0 AS (SELECT avg(bad / n) AS m0, coalesce(var_samp(bad / n), 0) AS v FROM h),
s1 AS (SELECT least(greatest(m0, 0.001), 0.999) AS m, v FROM s0),
s AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1000.0) ELSE 1000.0 END AS k FROM s1),
b AS (SELECT host, (bad + m * k) / (n + k) > 0.6 AS host_rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT failed AND NOT host_rejected) AS kept, host_rejected
FROM j JOIN b USING (host)
"""
