"""Queries over models, prices and downgrades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import catalog as C
from spanloom.operators import ladder as L
from spanloom.plans.fixtures import oracle, table
from spanloom.plans.registry import query

AS_OF = "2026-01-15"
_SITES_SQL = """sites AS (SELECT k.name || '/' || r.node AS key, k.name AS model, CAST(round_even(avg(in_tokens), 0) AS BIGINT) AS avg_in, CAST(round_even(avg(out_tokens), 0) AS BIGINT) AS avg_out,
  count(*) % 5 = 0 AS mixed FROM (SELECT *, coalesce(node_hint, name) AS node FROM runs WHERE run_type = 'llm') r JOIN catalog k ON k.ord = r.model_ord GROUP BY ALL),
live AS (SELECT * FROM catalog WHERE callable AND NOT coalesce(CAST(retire_date AS DATE) <= DATE '2026-01-15' + 180, false)),
cur AS (SELECT s.*, c.provider AS provider0, c.tier AS tier0, c.tier_rank AS rank0, c.ord AS ord0, c.input AS in0, c.output AS out0 FROM sites s JOIN catalog c ON c.name = s.model)"""
_SAVE = "(avg_in * (in0 - input) + avg_out * (out0 - output))"
_NEXT = f"""next AS (SELECT key, name AS target FROM (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY tier_rank, coalesce(release, '') DESC, {_SAVE} DESC, ord) AS k
  FROM cur JOIN live ON provider = provider0 AND tier_rank > rank0 WHERE {_SAVE} > 0) WHERE k = 1)"""
_MIGRATE = "mig AS (SELECT name AS model, arg_min(target, path_ord) AS migrates_to FROM catalog JOIN migration ON regexp_matches(lower(name), pattern) GROUP BY name)"
_DOWN = f"""down AS (SELECT key, model, cheaper, reason, round_even((avg_in * (in0 - c.input) + avg_out * (out0 - c.output)) / 1e6 * 10000, 6) AS usd FROM (
  SELECT cur.*, coalesce(m.migrates_to, n.target) AS cheaper, CASE WHEN m.migrates_to IS NOT NULL THEN 'migration' ELSE 'cost-downgrade' END AS reason
  FROM cur LEFT JOIN mig m USING (model) LEFT JOIN next n USING (key) WHERE NOT mixed) x JOIN catalog c ON c.name = x.cheaper
  WHERE avg_in * (in0 - c.input) + avg_out * (out0 - c.output) > 0)"""


def sites(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "runs").where("run_type = 'llm'").withColumn("node", F.coalesce("node_hint", "name"))
    names = C.catalog(spark).select(F.col("ord").cast("long").alias("model_ord"), F.col("name").alias("model"))
    g = runs.join(F.broadcast(names), "model_ord").groupBy(F.concat_ws("/", "model", "node").alias("key"), "model")
    mean = lambda c: F.bround(F.avg(c)).cast("long")
    return g.agg(mean("in_tokens").alias("avg_in"), mean("out_tokens").alias("avg_out"), (F.count(F.lit(1)) % 5 == 0).alias("mixed"))


@query(oracle(f"WITH {_SITES_SQL}, {_NEXT} SELECT * FROM next", "runs"))
def ladder_next_cheaper(spark: SparkSession, d: str) -> DataFrame:
    return L.next_cheaper(sites(spark, d), C.catalog(spark), AS_OF)


@query(
    oracle(
        f"""WITH {_SITES_SQL} SELECT key, name AS target FROM (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY tier_rank, input DESC, ord) AS k
FROM cur JOIN live ON provider = provider0 AND tier_rank > rank0 WHERE input <= in0 AND output <= out0 AND (input < in0 OR output < out0)) WHERE k = 1""",
        "runs",
    )
)
def ladder_next_pareto(spark: SparkSession, d: str) -> DataFrame:
    return L.next_pareto(sites(spark, d), C.catalog(spark), AS_OF)


@query(oracle(f"WITH {_SITES_SQL} SELECT key, arg_min(name, ord) AS target FROM cur JOIN live ON provider = provider0 AND ord > ord0 GROUP BY key", "runs"))
def ladder_next_in_order(spark: SparkSession, d: str) -> DataFrame:
    return L.next_in_order(sites(spark, d), C.catalog(spark), AS_OF)


@query(
    oracle(
        f"""WITH {_SITES_SQL} SELECT key, arg_min(name, (provider_ord, ord)) AS target FROM cur JOIN live ON tier = tier0
WHERE open_weight AND coalesce(confidence, '') <> 'unverified' AND coalesce(purpose, '') <> 'moderation' AND {_SAVE} > 0 GROUP BY key""",
        "runs",
    )
)
def ladder_open_weight(spark: SparkSession, d: str) -> DataFrame:
    return L.open_weight(sites(spark, d), C.catalog(spark), AS_OF)


@query(oracle(f"WITH {_SITES_SQL}, {_NEXT}, {_MIGRATE}, {_DOWN} SELECT * FROM down", "runs"))
def ladder_downgrades(spark: SparkSession, d: str) -> DataFrame:
    return L.downgrades(sites(spark, d), C.catalog(spark), C.migrations(spark), AS_OF, 10_000).orderBy(F.desc("usd"), "key")


@query(
    oracle(
        f"""WITH {_SITES_SQL}, {_NEXT}, {_MIGRATE}, {_DOWN} SELECT s.key, s.model, round_even((avg_in * coalesce(c.input, 0) + avg_out * coalesce(c.output, 0)) / 1e6 * 10000, 6) AS cost,
  down.cheaper AS downgrade_to, coalesce(down.usd, 0.0) AS opportunity, coalesce(down.usd, 0) <> 0 AS testable FROM sites s LEFT JOIN catalog c ON c.name = s.model LEFT JOIN down ON down.key = s.key""",
        "runs",
    )
)
def ladder_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Call-sites priced on one basis of calls and ranked by what a cheaper model saves."""
    s, cat = sites(spark, d), C.catalog(spark)
    rows = L.funnel(s, L.downgrades(s, cat, C.migrations(spark), AS_OF, 10_000), cat, 10_000)
    return rows.orderBy(F.desc("opportunity"), F.desc("cost"), "key")


@query(
    oracle(
        f"""WITH {_SITES_SQL}, {_NEXT}, {_MIGRATE}, {_DOWN} SELECT reason, count(*) AS wins, CAST(sum(CAST(round_even(usd * 1000, 0) AS BIGINT)) AS BIGINT) AS mills, arg_max(key, (usd, key)) AS best FROM down GROUP BY reason""",
        "runs",
    )
)
def ladder_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = L.downgrades(sites(spark, d), C.catalog(spark), C.migrations(spark), AS_OF, 10_000)
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("wins"), F.sum(F.bround(F.col("usd") * 1000).cast("long")).alias("mills"), F.max_by("key", F.struct("usd", "key")).alias("best"))


def named(spark: SparkSession, d: str) -> DataFrame:
    """How many parts have each raw name."""
    return table(spark, d, "names").groupBy("raw").agg(F.count(F.lit(1)).alias("parts"))


_RAW_SQL = "raw AS (SELECT raw, count(*) AS parts FROM names GROUP BY raw)"
_CANONICAL = f"""{_RAW_SQL}, b AS (SELECT raw, parts, lower(trim(raw)) AS n, regexp_replace(lower(trim(raw)), '[-_/:](\\d{{6,8}}|v\\d+|latest|preview|exp)$', '') AS base FROM raw),
f AS (SELECT raw, arg_min(name, ord) AS fuzzy FROM b JOIN catalog ON n = lower(name) OR lower(name) = base OR starts_with(n, lower(name)) OR starts_with(base, lower(name)) OR starts_with(lower(name), base) GROUP BY raw),
canon AS (SELECT b.raw, b.parts, coalesce(c.name, a1.target, a2.target, f.fuzzy) AS model FROM b LEFT JOIN catalog c ON c.name = trim(b.raw) LEFT JOIN alias a1 ON a1.alias = b.n LEFT JOIN alias a2 ON a2.alias = b.base LEFT JOIN f ON f.raw = b.raw)"""


def canonical(spark: SparkSession, d: str) -> DataFrame:
    rows = named(spark, d)
    return rows.join(L.canonical(rows.select("raw"), C.catalog(spark), C.aliases(spark)), "raw").select("raw", "parts", "model")


@query(oracle(f"WITH {_CANONICAL} SELECT * FROM canon", "names"))
def catalog_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Raw model names of parts, and the catalog's model that each means."""
    return canonical(spark, d)


@query(
    oracle(
        f"""WITH {_RAW_SQL}, m AS (SELECT raw, name, ord FROM raw JOIN catalog ON regexp_matches(' ' || lower(trim(raw)) || ' ', '[^a-z0-9]' || replace(name, '.', '\\.') || '[^a-z0-9]'))
SELECT r.raw, r.parts, (SELECT arg_max(name, (length(name), -ord)) FROM m WHERE m.raw = r.raw) AS model FROM raw r""",
        "names",
    )
)
def catalog_bounded_name(spark: SparkSession, d: str) -> DataFrame:
    return L.bounded_name(named(spark, d), C.catalog(spark)).select("raw", "parts", "model")


@query(oracle(f"WITH {_CANONICAL}, u AS (SELECT model, CAST(sum(parts) AS BIGINT) AS parts FROM canon WHERE model IS NOT NULL GROUP BY model) SELECT model, parts, arg_min(target, path_ord) AS migrates_to FROM u JOIN migration ON regexp_matches(lower(model), pattern) GROUP BY model, parts", "names"))
def catalog_migrations(spark: SparkSession, d: str) -> DataFrame:
    """Models in use that their vendor moves on from, and by how many parts."""
    used = canonical(spark, d).where("model IS NOT NULL").groupBy("model").agg(F.sum("parts").alias("parts"))
    return L.migration(used.select("model"), C.migrations(spark)).join(used, "model")


@query(oracle(f"WITH {_CANONICAL} SELECT name, retire_date, CAST(sum(parts) AS BIGINT) AS parts FROM canon JOIN catalog ON name = model WHERE CAST(retire_date AS DATE) <= DATE '2026-01-15' + 180 GROUP BY ALL", "names"))
def catalog_retiring(spark: SparkSession, d: str) -> DataFrame:
    """Models in use that retire soon, and by how many parts they are used."""
    used = canonical(spark, d).where("model IS NOT NULL").groupBy(F.col("model").alias("name")).agg(F.sum("parts").alias("parts"))
    return L.retiring(C.catalog(spark), AS_OF).join(used, "name")


_FLAVOUR = """d AS (SELECT deployment, wire_name, max_output, mode FROM deployed),
m AS (SELECT wire_name, arg_max(name, (length(name), -ord)) AS model FROM (SELECT DISTINCT wire_name FROM d) JOIN catalog ON regexp_matches(' ' || lower(trim(wire_name)) || ' ', '[^a-z0-9]' || replace(name, '.', '\\.') || '[^a-z0-9]') GROUP BY wire_name),
r AS (SELECT d.*, m.model FROM d LEFT JOIN m USING (wire_name))"""


def deployed(spark: SparkSession, d: str) -> DataFrame:
    return L.bounded_name(table(spark, d, "deployed"), C.catalog(spark), "wire_name")


@query(
    oracle(
        f"WITH {_FLAVOUR} SELECT model, count(DISTINCT wire_name) AS flavours, arg_min(wire_name, (CASE WHEN wire_name = model THEN 0 ELSE 1 END, length(wire_name), wire_name)) AS pick FROM r WHERE model IS NOT NULL AND mode = 'chat' GROUP BY model",
        "deployed",
    )
)
def gateway_flavours(spark: SparkSession, d: str) -> DataFrame:
    rows = deployed(spark, d).where("model IS NOT NULL AND mode = 'chat'")
    order = F.struct(F.when(F.col("wire_name") == F.col("model"), 0).otherwise(1), F.length("wire_name"), F.col("wire_name"))
    return rows.groupBy("model").agg(F.count_distinct("wire_name").alias("flavours"), F.min_by("wire_name", order).alias("pick"))


@query(oracle(f"WITH {_FLAVOUR} SELECT CASE WHEN mode <> 'chat' THEN 'not chat' WHEN model IS NULL THEN 'uncatalogued' ELSE 'matched' END AS state, count(*) AS deployments FROM r GROUP BY ALL", "deployed"))
def gateway_coverage(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("mode") != "chat", "not chat").when(F.col("model").isNull(), "uncatalogued").otherwise("matched")
    return deployed(spark, d).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("deployments"))


@query(oracle(f"WITH {_FLAVOUR} SELECT name, provider FROM catalog WHERE name NOT IN (SELECT model FROM r WHERE model IS NOT NULL AND mode = 'chat' AND max_output >= 50)", "deployed"))
def gateway_not_served(spark: SparkSession, d: str) -> DataFrame:
    """Models that no chat deployment with room for an answer of 50 has."""
    served = deployed(spark, d).where("model IS NOT NULL AND mode = 'chat' AND max_output >= 50").select(F.col("model").alias("name"))
    return C.catalog(spark).join(served, "name", "left_anti").select("name", "provider")


@query(
    oracle(
        f"""WITH {_FLAVOUR}, g AS (SELECT model, max(max_output) AS gateway_max FROM r WHERE model IS NOT NULL GROUP BY model)
SELECT c.name, c.provider, c.tier, c.cache_mode, g.model IS NOT NULL AS served, CAST(coalesce(nullif(g.gateway_max, 0), nullif(c.max_output, 0), 32768) AS INT) AS max_output, coalesce(c.cache_min, 1024) AS cache_min FROM catalog c LEFT JOIN g ON g.model = c.name""",
        "deployed",
    )
)
def catalog_report(spark: SparkSession, d: str) -> DataFrame:
    g = deployed(spark, d).where("model IS NOT NULL").groupBy(F.col("model").alias("name")).agg(F.max("max_output").alias("gateway_max"))
    filled = lambda c: F.when(F.col(c) != 0, F.col(c))
    rows = C.catalog(spark).join(g.withColumn("served", F.lit(True)), "name", "left")
    return rows.select("name", "provider", "tier", "cache_mode", F.coalesce("served", F.lit(False)).alias("served"), F.coalesce(filled("gateway_max"), filled("max_output"), F.lit(32768)).alias("max_output"), F.coalesce("cache_min", F.lit(1024)).alias("cache_min"))


_SERVED = "ok AS (SELECT DISTINCT model FROM r WHERE model IS NOT NULL AND mode = 'chat' AND max_output >= 50)"
_SITES_SERVED = _SITES_SQL.replace("FROM catalog WHERE callable", "FROM catalog WHERE name IN (SELECT model FROM ok) AND callable")
_MIGRATE_SERVED = _MIGRATE.replace("mig AS (", "mig0 AS (") + ", mig AS (SELECT * FROM mig0 WHERE migrates_to IN (SELECT model FROM ok))"


def served(spark: SparkSession, d: str) -> DataFrame:
    return deployed(spark, d).where("model IS NOT NULL AND mode = 'chat' AND max_output >= 50").select("model")


@query(oracle(f"WITH {_FLAVOUR}, {_SERVED}, {_SITES_SERVED}, {_NEXT} SELECT * FROM next", "runs", "deployed"))
def ladder_next_served(spark: SparkSession, d: str) -> DataFrame:
    """The next cheaper model of those that the gateway serves with room for 50."""
    return L.next_cheaper(sites(spark, d), C.catalog(spark), AS_OF, served(spark, d))


@query(oracle(f"WITH {_FLAVOUR}, {_SERVED}, {_SITES_SERVED}, {_NEXT}, {_MIGRATE_SERVED}, {_DOWN} SELECT key, model, cheaper, reason, usd FROM down", "runs", "deployed"))
def ladder_downgrades_served(spark: SparkSession, d: str) -> DataFrame:
    """Downgrades to what the gateway serves: a vendor's target that isn't served gives way to the next cheaper model."""
    return L.downgrades(sites(spark, d), C.catalog(spark), C.migrations(spark), AS_OF, 10_000, served(spark, d))
