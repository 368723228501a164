"""Choosing a cheaper model for a call-site, and ranking call-sites by what that saves.

The catalog is a dimension of a few dozen rows: joins with it are broadcast by size, also those on inequalities.
``sites`` are rows (key, model, avg_in, avg_out), where model is a catalog name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETIRE_DAYS = 180


def canonical(raw: DataFrame, catalog: DataFrame, aliases: DataFrame, column: str = "raw") -> DataFrame:
    """``raw`` and ``model``: exact name, alias, alias without a date or version, else the first catalog name that
    equals, begins or is begun by it; null if none."""
    name, base = F.lower(F.trim(column)), F.regexp_replace(F.lower(F.trim(column)), r"[-_/:](\d{6,8}|v\d+|latest|preview|exp)$", "")
    names = raw.select(column).distinct().where(F.trim(column) != "").withColumn("n_", name).withColumn("b_", base)
    cat = catalog.select(F.col("name").alias("model_"), F.lower("name").alias("l_"), "ord")
    near = (F.col("n_") == F.col("l_")) | (F.col("l_") == F.col("b_")) | F.startswith("n_", "l_") | F.startswith("b_", "l_") | F.startswith("l_", "b_")
    fuzzy = names.join(F.broadcast(cat), near).groupBy(column).agg(F.min_by("model_", "ord").alias("fuzzy_"))
    exact = names.join(F.broadcast(catalog.select(F.col("name").alias("exact_"))), F.trim(column) == F.col("exact_"), "left")
    one = F.broadcast(aliases.select(F.col("alias").alias("n_"), F.col("target").alias("alias_")))
    two = F.broadcast(aliases.select(F.col("alias").alias("b_"), F.col("target").alias("base_")))
    found = exact.join(one, "n_", "left").join(two, "b_", "left").join(fuzzy, column, "left")
    found = found.select(column, F.coalesce("exact_", "alias_", "base_", "fuzzy_").alias("model"))
    return raw.join(found, column, "left")


def bounded_name(raw: DataFrame, catalog: DataFrame, column: str = "raw") -> DataFrame:
    """``raw`` and ``model``: the longest catalog name inside it that no letter or digit touches; null if none."""
    cat = catalog.select(F.col("name").alias("model_"), F.lower("name").alias("l_"), "ord")
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.col("l_"), F.lit(r"\E(?![\p{L}\p{N}])"))
    names = raw.select(column).distinct()
    found = names.join(F.broadcast(cat), F.regexp_like(F.lower(F.trim(column)), quoted)).groupBy(column)
    return raw.join(found.agg(F.max_by("model_", F.struct(F.length("model_"), -F.col("ord"))).alias("model")), column, "left")


def live(catalog: DataFrame, as_of: str) -> Column:
    """Callable, and not retiring within the horizon."""
    gone = F.to_date("retire_date") <= F.date_add(F.lit(as_of).cast("date"), RETIRE_DAYS)
    return F.col("callable") & ~F.coalesce(gone, F.lit(False))


def retiring(catalog: DataFrame, as_of: str, days: int = RETIRE_DAYS) -> DataFrame:
    return catalog.where(F.to_date("retire_date") <= F.date_add(F.lit(as_of).cast("date"), days)).select("name", "retire_date")


def _current(sites: DataFrame, catalog: DataFrame) -> DataFrame:
    own = catalog.select(F.col("name").alias("model"), F.col("provider").alias("provider0"), F.col("tier").alias("tier0"), F.col("tier_rank").alias("rank0"), F.col("ord").alias("ord0"), F.col("input").alias("in0"), F.col("output").alias("out0"))
    return sites.join(F.broadcast(own), "model")


def _saving() -> Column:
    return F.col("avg_in") * (F.col("in0") - F.col("input")) + F.col("avg_out") * (F.col("out0") - F.col("output"))


def _best(rows: DataFrame, *order: Column) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    return rows.withColumn("place_", first).where("place_ = 1").select("key", F.col("name").alias("target"))


def usable(catalog: DataFrame, as_of: str, served: DataFrame | None = None) -> DataFrame:
    """Catalog models that can be called; ``served`` (model): only those that a gateway serves.  No more rows than the catalog has,
    so the result may be broadcast."""
    rows = catalog.where(live(catalog, as_of))
    return rows if served is None else rows.join(served.select(F.col("model").alias("name")).distinct(), "name", "left_semi")


def next_cheaper(sites: DataFrame, catalog: DataFrame, as_of: str, served: DataFrame | None = None) -> DataFrame:
    """By the site's tokens: of the provider's models in lower tiers that save, the nearest tier's newest."""
    rows = _current(sites, catalog).join(F.broadcast(usable(catalog, as_of, served)), (F.col("provider") == F.col("provider0")) & (F.col("tier_rank") > F.col("rank0")))
    rows = rows.where(_saving() > 0)
    return _best(rows, F.col("tier_rank"), F.coalesce("release", F.lit("")).desc(), _saving().desc(), F.col("ord"))


def next_pareto(sites: DataFrame, catalog: DataFrame, as_of: str, served: DataFrame | None = None) -> DataFrame:
    """Without tokens: no price higher and one lower; the nearest tier's dearest input."""
    rows = _current(sites, catalog).join(F.broadcast(usable(catalog, as_of, served)), (F.col("provider") == F.col("provider0")) & (F.col("tier_rank") > F.col("rank0")))
    cheaper = (F.col("input") <= F.col("in0")) & (F.col("output") <= F.col("out0")) & ((F.col("input") < F.col("in0")) | (F.col("output") < F.col("out0")))
    return _best(rows.where(cheaper), F.col("tier_rank"), F.col("input").desc(), F.col("ord"))


def next_in_order(sites: DataFrame, catalog: DataFrame, as_of: str, served: DataFrame | None = None) -> DataFrame:
    """For models without a tier: the provider's next usable model in file order."""
    rows = _current(sites, catalog).join(F.broadcast(usable(catalog, as_of, served)), (F.col("provider") == F.col("provider0")) & (F.col("ord") > F.col("ord0")))
    return _best(rows, F.col("ord"))


def open_weight(sites: DataFrame, catalog: DataFrame, as_of: str) -> DataFrame:
    """The strongest open-weight model of the same tier that is priced for sure, no moderation model, and saves."""
    sure = (F.coalesce("confidence", F.lit("")) != "unverified") & (F.coalesce("purpose", F.lit("")) != "moderation") & F.col("open_weight")
    rows = _current(sites, catalog).join(F.broadcast(catalog.where(sure & live(catalog, as_of))), F.col("tier") == F.col("tier0"))
    return _best(rows.where(_saving() > 0), F.col("provider_ord"), F.col("ord"))


def migration(models: DataFrame, paths: DataFrame) -> DataFrame:
    """model and migrates_to: the target of the first path whose pattern matches the name."""
    found = models.join(F.broadcast(paths), F.regexp_like(F.lower("model"), F.col("pattern")))
    return found.groupBy("model").agg(F.min_by("target", "path_ord").alias("migrates_to"))


def downgrades(sites: DataFrame, catalog: DataFrame, paths: DataFrame, as_of: str, per_calls: int, served: DataFrame | None = None) -> DataFrame:
    """Candidates that save: the vendor's target where there is one (even if it saves nothing, there is no other), else
    the next cheaper model; ``served`` (model): of those alone that a gateway serves.  Sites of mixed models are left out."""
    single = sites.where(~F.col("mixed"))
    moved = single.join(F.broadcast(migration(single.select("model").distinct(), paths)), "model", "left")
    if served is not None:
        here = served.select(F.col("model").alias("migrates_to")).join(F.broadcast(paths.select(F.col("target").alias("migrates_to"))), "migrates_to", "left_semi").distinct()
        moved = moved.join(F.broadcast(here.withColumn("here_", F.lit(True))), "migrates_to", "left")  # no more rows than paths have targets
        moved = moved.withColumn("migrates_to", F.when(F.col("here_"), F.col("migrates_to"))).drop("here_")
    moved = moved.join(next_cheaper(single, catalog, as_of, served), "key", "left")
    moved = moved.withColumn("cheaper", F.coalesce("migrates_to", "target")).where("cheaper IS NOT NULL")
    moved = moved.withColumn("reason", F.when(F.col("migrates_to").isNotNull(), "migration").otherwise("cost-downgrade")).drop("target", "migrates_to")
    new = catalog.select(F.col("name").alias("cheaper"), "input", "output")
    rows = _current(moved, catalog).join(F.broadcast(new), "cheaper")
    return rows.withColumn("usd", F.bround(_saving() / 1e6 * per_calls, 6)).where(_saving() > 0).select("key", "model", "cheaper", "reason", "usd")


def funnel(sites: DataFrame, candidates: DataFrame, catalog: DataFrame, calls: int) -> DataFrame:
    """Every site with its cost and opportunity on one basis of calls."""
    price = catalog.select(F.col("name").alias("model"), "input", "output")
    zero = F.lit(0.0)
    rows = sites.join(F.broadcast(price), "model", "left").join(candidates.select("key", F.col("cheaper").alias("downgrade_to"), "usd"), "key", "left")
    cost = (F.col("avg_in") * F.coalesce("input", zero) + F.col("avg_out") * F.coalesce("output", zero)) / 1e6 * calls
    out = rows.select("key", "model", F.bround(cost, 6).alias("cost"), "downgrade_to", F.coalesce("usd", zero).alias("opportunity"))
    return out.withColumn("testable", F.col("opportunity") != 0)
