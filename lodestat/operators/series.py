"""Time series per symbol: returns, levels, drawdowns, moments, as-of growth.

A series holds one row per symbol and day (or period), so a window over one
symbol is bounded by the calendar, whatever the size of the input."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECOVERY_SLACK = 1e-9


def years(d0, d1) -> Column:
    return F.greatest(F.datediff(d1, d0) / 365.25, F.lit(1e-9))


def cagr_pct(d0, v0, d1, v1) -> Column:
    """Calendar-span growth per year, in percent."""
    return 100.0 * (F.pow(F.try_divide(v1, v0), 1.0 / years(d0, d1)) - 1.0)


def share_trend(obs: DataFrame, key: str = "entity", day: str = "end_day", value: str = "value") -> DataFrame:
    """Newest count against the one at or before a year earlier: the annualised
    trend falls back on the oldest count, the plain growth does not."""
    ends = W.partitionBy(key)
    tagged = obs.where(F.col(value) > 0).withColumn("_d1", F.max(day).over(ends))
    old = F.col(day) <= F.date_sub("_d1", 365)
    g = tagged.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max(day).alias("d1"), F.max_by(value, day).alias("v1"),
        F.min(day).alias("d00"), F.min_by(value, day).alias("v00"),
        F.max(F.when(old, F.col(day))).alias("dp"),
        F.max_by(F.when(old, F.col(value)), F.when(old, F.col(day))).alias("vp"))
    d0, v0 = F.coalesce("dp", "d00"), F.coalesce("vp", "v00")
    ok = (F.col("n") >= 2) & (F.datediff("d1", d0) / 365.25 >= 0.25)
    return g.select(
        key, F.when(ok, cagr_pct(d0, v0, F.col("d1"), F.col("v1"))).alias("trend_pct"),
        (100.0 * (F.col("v1") - F.col("vp")) / F.col("vp")).alias("yoy_pct"),
        F.when(F.col("vp").isNull(), "STALE").otherwise("FRESH").alias("yoy_state"))


def returns(bars: DataFrame, value: str = "adj_close", key: str = "symbol", day: str = "day") -> DataFrame:
    """Simple period returns; bars with no positive value are left out first."""
    w = W.partitionBy(key).orderBy(day)
    prev = F.lag(value).over(w)
    return (bars.where(F.col(value) > 0).withColumn("ret", F.col(value) / prev - 1.0)
            .where(F.col("ret").isNotNull()).select(key, day, "ret"))


def levels(bars: DataFrame, value: str = "adj_close", key: str = "symbol", day: str = "day") -> DataFrame:
    """Level series from 1.0, one level per bar. The product of (1 + return) from
    the first bar telescopes to value / first value."""
    w = W.partitionBy(key).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    return bars.where(F.col(value) > 0).select(
        key, day, (F.col(value) / F.first(value).over(w)).alias("level"))


def drawdown(points: DataFrame, value: str, key: str = "symbol", day: str = "day", slack: float = RECOVERY_SLACK) -> DataFrame:
    """Deepest fall from the running peak with its peak and trough days, and
    whether the peak was regained after the trough. Only positive peaks count.
    (key, drawdown, peak, peak_day, trough, trough_day, recovered, positive_peaks, bars)"""
    run = W.partitionBy(key).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy(day).rowsBetween(1, W.unboundedFollowing)
    # the first day of the running maximum: strictly higher levels move the peak
    peak = F.max(F.struct(F.col(value), (-F.unix_date(day)).alias("nd"))).over(run)
    best_later = F.max(value).over(ahead)
    p = points.select(key, day, F.col(value).alias("v"), peak.alias("pk"), best_later.alias("later"))
    p = p.select(key, day, "v", F.col(f"pk.{value}").alias("peak"),
                 F.date_from_unix_date(-F.col("pk.nd")).alias("peak_day"), "later")
    fall = F.when(F.col("peak") > 0, (F.col("v") - F.col("peak")) / F.col("peak"))
    p = p.withColumn("fall", fall)
    worst = F.min_by(F.struct("fall", "peak", "peak_day", F.col("v").alias("trough"),
                              F.col(day).alias("trough_day"), "later"),
                     F.when(F.col("fall").isNotNull(), F.struct("fall", day)))
    g = p.groupBy(key).agg(worst.alias("w"), F.count(F.lit(1)).alias("bars"),
                           F.coalesce(F.bool_or(F.col("peak") > 0), F.lit(False)).alias("positive_peaks"))
    return g.select(key, F.col("w.fall").alias("drawdown"), "w.peak", "w.peak_day", "w.trough", "w.trough_day",
                    F.coalesce(F.col("w.later") >= F.col("w.peak") * (1 - slack), F.lit(False))
                    .alias("recovered"), "positive_peaks", "bars")


def adjusted_skew(n: Column, g1: Column) -> Column:
    """Small-sample correction of the population skewness."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def adjusted_kurtosis(n: Column, g2: Column) -> Column:
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0))


def moments(rets: DataFrame, key: str = "symbol", min_side: int = 20) -> DataFrame:
    """Corrected skew and excess kurtosis, and the ratio of the 95th percentile of
    gains to the 5th of losses (linear, exact) where both sides hold enough."""
    r = F.col("ret")
    g = rets.groupBy(key).agg(
        F.count("ret").alias("n"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"),
        F.count(F.when(r > 0, 1)).alias("gains"), F.count(F.when(r < 0, 1)).alias("losses"),
        F.percentile(F.when(r > 0, r), F.lit(0.95)).alias("right"),
        F.percentile(F.when(r < 0, r), F.lit(0.05)).alias("left"))
    n = F.col("n").cast("double")
    enough = (F.col("gains") >= min_side) & (F.col("losses") >= min_side)
    return g.select(
        key, F.col("n").alias("bars"), adjusted_skew(n, F.col("g1")).alias("skew"),
        adjusted_kurtosis(n, F.col("g2")).alias("excess_kurtosis"), "gains", "losses",
        F.when(enough & (F.col("left") < 0), F.col("right") / F.abs("left")).alias("tail_ratio"))


def quarter_ticks(days: DataFrame, day: str = "day") -> DataFrame:
    """Last day of each calendar quarter that has one."""
    return (days.groupBy(F.trunc(day, "quarter").alias("_q")).agg(F.max(day).alias("tick")).select("tick"))


def following(ticks: DataFrame, tick: str = "tick") -> DataFrame:
    """Each tick with the next one. One row per quarter of the calendar."""
    return ticks.select(tick, F.lead(tick).over(W.orderBy(tick)).alias("next_tick"))


def weekdays_between(d0, d1) -> Column:
    """Weekdays strictly between two days, in closed form: whole weeks hold five,
    the rest is read off the day of week."""
    a, b = F.date_add(d0, 1), d1          # half-open [a, b)
    def upto(d):                          # weekdays from Monday 1970-01-05 up to d
        n = F.unix_date(d) - 4
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))
    return F.when(a < b, upto(b) - upto(a)).otherwise(F.lit(0))


def freshness(day, as_of, max_age: int = 45) -> Column:
    age = F.datediff(as_of, day)
    return F.when(age.between(0, max_age), "FRESH").otherwise("STALE")


def last_k_all(rows: DataFrame, key: str, day: str, k: int, cond: Column) -> DataFrame:
    """Whether the condition holds on all of the last k rows; NULL if fewer rows."""
    w = W.partitionBy(key).orderBy(F.desc(day))
    last = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return last.groupBy(key).agg(F.when(F.count("*") >= k, F.bool_and(cond)).alias("holds"))


def gram(rets: DataFrame, asset: str = "asset", day: str = "day", group: str = "portfolio") -> DataFrame:
    """Pair sums (group, a, b, n, sa, sb, saa, sbb, sab) over days on which every
    kept asset of the group has a return. Each task multiplies its own days as one
    matrix, so only one small matrix per task is shuffled, never a pair per day.
    A portfolio holds a bounded number of assets."""
    import numpy as np
    import pandas as pd

    kept = rets.groupBy(group).agg(F.countDistinct(asset).alias("_k"))
    vectors = (rets.groupBy(group, day).agg(F.array_sort(F.collect_list(F.struct(F.col(asset).alias("a"), F.col("ret").alias("r")))).alias("v"))
               .join(kept, group).where(F.size("v") == F.col("_k")).select(group, "v.a", "v.r"))

    def partial(batches):
        acc = {}
        for pdf in batches:
            for g, part in pdf.groupby(group):
                x = np.array(part["r"].tolist(), dtype=float)
                names = tuple(part["a"].iloc[0])
                n, s, m = acc.get((g, names), (0, 0.0, 0.0))
                acc[(g, names)] = (n + len(x), s + x.sum(axis=0), m + x.T @ x)
        for (g, names), (n, s, m) in acc.items():
            i, j = np.triu_indices(len(names), 1)
            a = np.array(names)
            yield pd.DataFrame({group: g, "a": a[i], "b": a[j], "n": n, "sa": s[i], "sb": s[j],
                                "saa": m[i, i], "sbb": m[j, j], "sab": m[i, j]})

    parts = vectors.mapInPandas(partial, f"{group} long, a long, b long, n long, sa double, sb double, saa double, sbb double, sab double")
    return parts.groupBy(group, "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])


def correlations(rets: DataFrame, min_obs: int = 120, **cols) -> DataFrame:
    """Pairwise correlation (group, a, b, rho) of assets with enough returns."""
    asset, group = cols.get("asset", "asset"), cols.get("group", "portfolio")
    enough = rets.groupBy(group, asset).agg(F.count("ret").alias("_n")).where(F.col("_n") >= min_obs).drop("_n")
    g = gram(rets.join(enough, [group, asset], "left_semi"), **cols)
    cov = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    var = (F.col("n") * F.col("saa") - F.pow("sa", 2)) * (F.col("n") * F.col("sbb") - F.pow("sb", 2))
    return g.select(group, "a", "b", (cov / F.sqrt(var)).alias("rho"))


def linkage_clusters(rho: DataFrame, threshold: float = 0.7, group: str = "portfolio") -> DataFrame:
    """Average-linkage clusters per portfolio at distance sqrt((1 - rho) / 2); a
    cluster is named by its smallest member. (group, asset, cluster)"""
    import numpy as np
    import pandas as pd

    cut = ((1.0 - threshold) / 2.0) ** 0.5

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {s: i for i, s in enumerate(names)}
        dist = np.full((len(names), len(names)), np.inf)
        d = np.sqrt(np.maximum(0.0, (1.0 - pdf["rho"].to_numpy()) / 2.0))
        ia, ib = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        dist[ia, ib] = dist[ib, ia] = d
        members = {i: [i] for i in range(len(names))}
        while len(members) > 1:
            i, j = np.unravel_index(np.argmin(dist), dist.shape)
            if dist[i, j] > cut:
                break
            wi, wj = len(members[i]), len(members[j])
            merged = (dist[i] * wi + dist[j] * wj) / (wi + wj)
            dist[i], dist[:, i] = merged, merged
            dist[i, i] = np.inf
            dist[j], dist[:, j] = np.inf, np.inf
            members[i] += members.pop(j)
        rows = [(names[m], min(names[x] for x in ms)) for ms in members.values() for m in ms]
        out = pd.DataFrame(rows, columns=["asset", "cluster"])
        out.insert(0, group, pdf[group].iloc[0])
        return out

    return rho.groupBy(group).applyInPandas(cluster, f"{group} long, asset long, cluster long")
