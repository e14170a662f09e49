"""Mixing sources to target weights by Poisson replication.

Every document is repeated as often as a Poisson variable says whose mean is its
source's target repetition rate: target weight x budget / bytes of the source.  The
variable is the inverse of the Poisson distribution at a uniform value hashed from
(seed, doc_id), so that a document's count never depends on partitions or retries.  The
distribution's steps are computed once a source and joined to its documents.  A
rate above RATE_LIMIT is a sum of independent Poisson variables of at most that mean, each
with a seed of its own, which is the same distribution; no rate is cut.
Copies are exploded and put into one global random order by a second hash: the hash is
uniform, so its leading digits name the partition and nothing is sampled; every partition
is sorted, and their order is the hash's.

Target weights come as a small frame (source, weight) or, by default, from the bytes
of each source to the power ``alpha``.  ``budget_factor`` scales the output's bytes.

Defined results: a null source is a source of its own; a null or empty text weighs
nothing but is replicated alike; a source without bytes has rate 0 and goes; repeated
rows share a count; a row whose doc_id is null goes by its text's hash instead; sources
without a target weight go; an empty table gives no rows.  Further columns are carried
along, but incoming columns named replica or mix_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table, unit_hash

SEED = "mix-1"
ALPHA = 0.7
RATE_LIMIT = 64.0
STEPS_MOST = 256  # of a distribution; at RATE_LIMIT the rest is below 1e-60
DIGITS = 12  # hexadecimal digits of mix_key that name a partition


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k from 0, for rates up to RATE_LIMIT."""
    kmax = F.least(F.lit(STEPS_MOST), F.ceil(rate * 4 + 40)).cast("int")
    made = F.aggregate(
        F.sequence(F.lit(1), kmax - 1),
        F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("steps")),
        lambda a, k: F.struct(
            (a["p"] * rate / k).alias("p"),
            (a["c"] + a["p"] * rate / k).alias("c"),
            F.array_append(a["steps"], a["c"] + a["p"] * rate / k).alias("steps"),
        ),
    )
    return made["steps"]


def steps_below(u: Column, steps: Column) -> Column:
    """Least k with u <= P(X <= k)."""
    return F.size(F.filter(steps, lambda c: u > c))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The inverse distribution at u, for rates up to RATE_LIMIT."""
    return steps_below(u, poisson_steps(rate))


def poisson_parts(rate: Column) -> dict[str, Column]:
    """A rate of any size: pieces of mean RATE_LIMIT (their steps are ``full``), and the steps of
    what is left."""
    pieces = F.greatest(F.lit(0), F.ceil(rate / RATE_LIMIT) - 1).cast("int")
    return {"pieces": pieces, "steps": poisson_steps(rate - pieces * RATE_LIMIT), "full": F.when(pieces > 0, poisson_steps(F.lit(RATE_LIMIT)))}


def copies_of(seed: str, row: Column, pieces: Column, steps: Column, full: Column) -> Column:
    """A document's count: the sum over the parts, each at a uniform value of its own."""
    rest = steps_below(unit_hash(seed, row), steps)

    def piece(k: Column) -> Column:
        return steps_below(unit_hash(seed, F.lit("piece"), k.cast("string"), row), full)

    more = F.aggregate(F.sequence(F.lit(1), pieces), F.lit(0), lambda a, k: a + piece(k))
    return F.when(pieces > 0, rest + more).otherwise(rest)


def poisson_copies(seed: str, doc_id: Column, rate: Column) -> Column:
    """A Poisson variable of any rate for one row."""
    return copies_of(seed, doc_id, **poisson_parts(rate))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, budget_factor: float = 1.0) -> DataFrame:
    """A row per source: source, rate."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    sizes = saved(sizes)
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(alpha)))
    else:
        sizes = sizes.join(weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("weight")), F.expr("source <=> s")).drop("s")
    whole = sizes.agg(F.sum("bytes").cast("double").alias("total_bytes"), F.sum("weight").alias("total_weight"))
    rate = F.when(
        (F.col("bytes") > 0) & (F.col("total_weight") > 0),
        F.col("weight") / F.col("total_weight") * F.col("total_bytes") * F.lit(budget_factor) / F.col("bytes"),
    ).otherwise(0.0)
    # one row on the right: the totals
    return sizes.join(F.broadcast(whole)).select("source", rate.alias("rate"))


def row_name(doc_id: Column, text: Column) -> Column:
    """What a row's hashes go by: its doc_id, or where that is null its text's hash."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce(text, F.lit("")))))


def mix(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, budget_factor: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs' columns plus replica (from 0) and mix_key, in global order of mix_key."""
    docs = docs.drop("replica", "mix_key")
    rates = source_rates(docs, weights, alpha, budget_factor)
    # written: a source's steps are computed once, not with every row
    rates = saved(rates.select(F.col("source").alias("mixed source"), *(c.alias(f"mixed {name}") for name, c in poisson_parts(F.col("rate")).items())))
    name = row_name(F.col("doc_id"), F.col("text"))
    parts = [F.col(f"mixed {x}") for x in ("pieces", "steps", "full")]
    counted = docs.join(rates, F.expr("source <=> `mixed source`")).withColumn("mixed copies", copies_of(seed, name, *parts))
    each = F.explode(F.sequence(F.lit(0), F.col("mixed copies") - 1)).alias("replica")
    copies = counted.where("`mixed copies` > 0").select(*docs.columns, each)
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), name, F.col("replica").cast("string")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.floor(F.conv(F.substring("mix_key", 1, DIGITS), 16, 10).cast("double") * F.lit(n / 16**DIGITS)).cast("int")
    return copies.withColumn("mix_key", key).repartitionById(n, at).sortWithinPartitions("mix_key")


def op8_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


OP8_SQL = f"""
WITH RECURSIVE s AS (
  SELECT source, CAST(sum(strlen(text)) AS DOUBLE) AS bytes, pow(CAST(sum(strlen(text)) AS DOUBLE), {ALPHA}) AS weight FROM documents GROUP BY source
), w AS (
  SELECT source, weight / (SELECT sum(weight) FROM s) * (SELECT sum(bytes) FROM s) * 1.0 / bytes AS whole FROM s
), r AS (
  SELECT source, greatest(0, CAST(ceil(whole / {RATE_LIMIT}) AS INTEGER) - 1) AS pieces, whole - greatest(0, CAST(ceil(whole / {RATE_LIMIT}) AS INTEGER) - 1) * {RATE_LIMIT}::DOUBLE AS rate FROM w
), c(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM (SELECT source, rate FROM r UNION ALL SELECT '|full', {RATE_LIMIT}::DOUBLE)
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c WHERE k < least({STEPS_MOST}, ceil(rate * 4 + 40)) - 1
), d AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null|' || md5(coalesce(text, ''))) AS name FROM documents
), u AS (
  SELECT d.*, CASE WHEN k = 0 THEN d.source ELSE '|full' END AS steps,
    (CAST('0x' || substr(md5(CASE WHEN k = 0 THEN '{SEED}|' || name ELSE '{SEED}|piece|' || k || '|' || name END), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN r ON r.source = d.source, unnest(range(0, r.pieces + 1)) AS x(k)
), n AS (
  SELECT doc_id, text, lang, source, n_chars, name, CAST(sum((SELECT count(*) FROM c WHERE c.source = u.steps AND u.u > c.c)) AS BIGINT) AS copies
  FROM u GROUP BY doc_id, text, lang, source, n_chars, name
), x AS (
  SELECT doc_id, text, lang, source, n_chars, name, CAST(unnest(range(copies)) AS INTEGER) AS replica FROM n
)
SELECT doc_id, text, lang, source, n_chars, replica, md5('{SEED}|order|' || name || '|' || CAST(replica AS VARCHAR)) AS mix_key FROM x
"""
