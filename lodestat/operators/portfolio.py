"""Snapshots of a portfolio: weights, differences, balance, returns, receipts.

A snapshot may list any number of positions, so totals are aggregates joined
back by date; only the dates themselves (one per snapshot) are windowed."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUTSIDE_TYPES = ("crypto", "copyportfolio", "etf")
UNPRICED_TYPES = ("crypto", "copyportfolio")
TYPE_BY_ID = {5: "stock", 6: "etf"}
ADVICE_COLUMNS = ("as_of", "symbol", "instrument_type", "quantity", "currency", "mv", "weight", "leverage")
PRIVATE = ("avg_open_price", "cost_basis", "owner")
LIMITS = dict(cash_low=5.0, cash_high=20.0, soft=10.0, hard=15.0, outside=25.0, count_low=10, count_high=25)


def with_weights(positions: DataFrame) -> DataFrame:
    total = positions.groupBy("as_of").agg(F.sum(F.rint(F.col("mv") * 100).cast("bigint")).alias("_t"))
    return positions.join(total, "as_of").withColumn("weight", F.col("mv") / (F.col("_t") / 100.0)).drop("_t")


def advice(positions: DataFrame) -> DataFrame:
    """Positions without any cost column."""
    return positions.select(*ADVICE_COLUMNS)


def assert_public(df: DataFrame) -> DataFrame:
    """Refuse a private name at any depth of the schema."""
    def walk(t, path):
        for f in getattr(t, "fields", []):
            if f.name in PRIVATE:
                raise ValueError(f"private column {path}{f.name}")
            walk(f.dataType, f"{path}{f.name}.")
        for inner in ("elementType", "valueType"):
            if hasattr(t, inner):
                walk(getattr(t, inner), path)
    walk(df.schema, "")
    return df


def instrument_type(type_id: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TYPE_BY_ID.items() for x in kv])
    return F.coalesce(F.try_element_at(known, type_id.try_cast("int")), F.lit("stock"))


def framework_status(positions: DataFrame, designations: DataFrame) -> DataFrame:
    """Latest designation per symbol, else the default of its instrument type."""
    latest = designations.groupBy("symbol").agg(F.max_by("status", F.struct("valid_from", "seq")).alias("_s"))
    default = F.when(F.col("instrument_type").isin(*OUTSIDE_TYPES), "outside_framework").otherwise("backfill_pending")
    return positions.join(latest, "symbol", "left").withColumn("status", F.coalesce("_s", default)).drop("_s")


def consecutive(snapshots: DataFrame) -> DataFrame:
    """(as_of, prev): one row per snapshot date."""
    return snapshots.select("as_of").distinct().select("as_of", F.lag("as_of").over(W.orderBy("as_of")).alias("prev"))


def snapshot_diff(positions: DataFrame, cash: DataFrame) -> DataFrame:
    """Changes between each snapshot and the one before it: appeared, disappeared,
    quantity_change, unexplained_cash; leverage_violation on every snapshot."""
    steps = consecutive(positions)
    now = positions.select("as_of", "symbol", "quantity", "leverage")
    before = (now.join(steps.select("as_of", F.col("prev")), "as_of").select(F.col("as_of").alias("p"), "symbol", F.col("quantity").alias("old"))
              .join(steps.where("prev IS NOT NULL").select(F.col("prev").alias("p"), F.col("as_of").alias("as_of")), "p").drop("p"))
    dated = now.join(steps.where("prev IS NOT NULL").select("as_of"), "as_of", "left_semi")
    both = dated.join(before, ["as_of", "symbol"], "full_outer")
    kind = F.when(F.col("old").isNull(), "appeared").when(F.col("quantity").isNull(), "disappeared").when(
        F.col("old") != F.col("quantity"), "quantity_change")
    moves = both.select("as_of", "symbol", kind.alias("kind"), F.col("old").alias("old_value"), F.col("quantity").alias("new_value")).where("kind IS NOT NULL")
    lever = now.where("leverage > 1").select("as_of", "symbol", F.lit("leverage_violation").alias("kind"), F.lit(1.0).alias("old_value"), F.col("leverage").alias("new_value"))
    explained = moves.where("kind IN ('disappeared', 'quantity_change')").select("as_of").distinct()
    c = cash.select("as_of", "cash", F.lag("cash").over(W.orderBy("as_of")).alias("old"))
    odd = (c.where(F.abs(F.col("cash") - F.col("old")) > 1.0).join(explained, "as_of", "left_anti").select(
        "as_of", F.lit(None).cast("bigint").alias("symbol"), F.lit("unexplained_cash").alias("kind"), F.col("old").alias("old_value"), (F.col("cash") - F.col("old")).alias("new_value")))
    return moves.unionByName(lever).unionByName(odd)


def lots_to_positions(lots: DataFrame, keys: list) -> DataFrame:
    """Lots of (units, amount, opened_at, leverage, is_buy, seq) as positions."""
    return lots.groupBy(*keys).agg(
        F.sum("units").alias("quantity"), F.sum("amount").alias("invested"), F.min("opened_at").alias("opened_at"), F.max("leverage").alias("leverage"),
        F.count("*").alias("lot_count"), F.when(F.min_by("is_buy", "seq"), "buy").otherwise("sell").alias("direction")).withColumn(
        "avg_open_price", F.try_divide("invested", "quantity"))


def to_eur(rows: DataFrame, rates: DataFrame, value: str = "mv") -> DataFrame:
    """Native values in EUR by the last close of the pair at or before the row's
    date; EUR is itself, a missing or non-positive rate is refused (NULL).
    rates: (currency, day, close), one row per day."""
    from lodestat.operators import asof
    # few currencies and many rows: each pair of currency and day finds its rate once
    pairs = rows.select(F.col("currency").alias("_cur"), F.col("as_of").alias("_day")).distinct()
    found = asof.asof_join(pairs.select(F.col("_cur").alias("currency"), F.col("_day").alias("as_of")), rates, "currency", "as_of", "day", ("close",))
    found = found.select(F.col("currency").alias("_cur"), F.col("as_of").alias("_day"), F.col("close").alias("_rate"))
    r = rows.join(found, (F.col("currency") == F.col("_cur")) & (F.col("as_of") == F.col("_day")), "left")
    rate = F.when(F.col("currency") == "EUR", 1.0).when(F.col("_rate") > 0, F.col("_rate"))
    return r.withColumn("eur", F.col(value) * rate).withColumn("fx_state", F.when(rate.isNull(), "refused").otherwise("ok")).drop("_cur", "_day", "_rate")


def balance(positions: DataFrame, cash: DataFrame) -> DataFrame:
    """Per snapshot: cash share and band, counts by status, cap breaches, outside
    and unpriced shares, leverage. positions carry weight and status."""
    t, w, s = LIMITS, F.col("weight") * 100, F.col("status")
    g = positions.groupBy("as_of").agg(
        F.sum("mv").alias("invested"), F.count_if(s == "framework").alias("n_framework"), F.count_if(s == "backfill_pending").alias("n_backfill"),
        F.count_if(s == "outside_framework").alias("n_outside"), F.count_if(w > t["soft"]).alias("soft_breaches"), F.count_if(w > t["hard"]).alias("hard_breaches"),
        F.coalesce(F.sum(F.when(s == "outside_framework", w)), F.lit(0.0)).alias("outside_pct"),
        F.coalesce(F.sum(F.when(F.col("instrument_type").isin(*UNPRICED_TYPES), F.col("mv"))), F.lit(0.0)).alias("_u"),
        F.count_if(F.col("leverage") > 1).alias("leverage_violations"))
    c = g.join(cash, "as_of", "left").withColumn("cash_pct", 100.0 * F.coalesce("cash", F.lit(0.0)) / (F.col("invested") + F.coalesce("cash", F.lit(0.0))))
    return c.select("as_of", "cash_pct", F.col("cash_pct").between(t["cash_low"], t["cash_high"]).alias("cash_in_band"), "n_framework", "n_backfill", "n_outside",
                    F.col("n_framework").between(t["count_low"], t["count_high"]).alias("count_in_band"), "soft_breaches", "hard_breaches", "outside_pct",
                    (F.col("outside_pct") <= t["outside"]).alias("outside_ok"), (100.0 * F.col("_u") / F.col("invested")).alias("unpriced_pct"), "leverage_violations")


def dietz(values: DataFrame) -> DataFrame:
    """Modified Dietz per snapshot pair and linked: values (as_of, value, flow).
    One row per snapshot date."""
    w = W.orderBy("as_of")
    v = values.withColumn("v0", F.lag("value").over(w)).where("v0 IS NOT NULL")
    base = F.col("v0") + 0.5 * F.col("flow")
    sub = v.withColumn("ret", F.when(base != 0, (F.col("value") - F.col("v0") - F.col("flow")) / base).otherwise(0.0))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    return sub.select("as_of", "ret", (F.product(1.0 + F.col("ret")).over(run) - 1.0).alias("linked"),
                      (F.abs("flow") / F.col("v0") * 100.0 > 5.0).alias("large_flow"))


def portfolio_series(holdings: DataFrame, bars: DataFrame, cash: Column) -> DataFrame:
    """Value per day: each holding's last close at or before the day times its
    quantity and rate, summed, plus cash. Instead of filling every holding on every
    day, each bar contributes its change of value on its own day, and the daily
    total is the running sum of changes (one row per day)."""
    w = W.partitionBy("symbol").orderBy("day")
    value = F.round(F.col("close") * F.col("quantity") * F.col("rate") * 100).cast("bigint")
    steps = bars.join(holdings, "symbol").withColumn("v", value)
    change = steps.withColumn("dv", F.col("v") - F.coalesce(F.lag("v").over(w), F.lit(0)))
    daily = change.groupBy("day").agg(F.sum("dv").alias("dv"))
    run = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return daily.select("day", (F.sum("dv").over(run) / 100.0 + cash).alias("value"))


def entry_verdict(rows: DataFrame, discount: float = 0.2) -> DataFrame:
    """PASS on any veto answer; BUY_READY at a discount to the fair band with
    conviction; else WATCH; with the size the conviction allows."""
    mid = (F.col("band_low") + F.col("band_high")) / 2.0
    size = F.create_map(*[F.lit(x) for kv in (("high", 5.0), ("medium", 3.0), ("low", 1.0)) for x in kv])
    verdict = F.when(F.col("vetoed"), "PASS").when((F.col("multiple") <= (1 - discount) * mid) & (F.col("conviction") != "low"), "BUY_READY").otherwise("WATCH")
    return rows.withColumn("verdict", verdict).withColumn("size_pct", F.when(F.col("verdict") == "BUY_READY", F.element_at(size, F.col("conviction"))))
