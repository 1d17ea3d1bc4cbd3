"""Universe, listings and security identity."""

from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog.registry import query, rnd, txt
from lodestat.functions import names
from lodestat.operators import listings
from lodestat.sources import files  # noqa: F401

U = f"WITH {R.SQL_UNIVERSE}"
SECTORS = ("ASIA", "EUROPE", "AMERICA")
LANDS = ("United States", "Netherlands", "Germany", "France")


def q(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


NORM = r"""regexp_replace(trim(regexp_replace(regexp_replace(split_part(lower(name), ' - ', 1), '\(.*?\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '""" + names.SUFFIX_TAIL + "', '')"


def rx(p):
    return p.replace("'", "''")


@query("universe_filter", f"""{U} SELECT symbol, 'core' AS mode FROM universe WHERE country IN {q(LANDS)} AND sector IN {q(SECTORS)} AND cap_bucket IN {q(listings.CAPS_DEFAULT)}
  UNION ALL SELECT symbol, 'broad' FROM universe WHERE country IN {q(LANDS)} AND sector NOT IN ('AFRICA') AND cap_bucket IN {q(listings.CAPS_BROAD)}""")
def universe_filter(spark, d):
    u = R.universe(spark, d)
    core = listings.universe_filter(u, countries=LANDS, sectors=SECTORS).select("symbol", F.lit("core").alias("mode"))
    wide = listings.universe_filter(u, broad=True, countries=LANDS, excluded=("AFRICA",)).select("symbol", F.lit("broad").alias("mode"))
    return core.unionByName(wide)


@query("derivative_line", f"""{U} SELECT symbol, name, regexp_matches(name, '{names.WARRANT}') OR (regexp_matches(name, '{names.UNIT}')
   AND NOT regexp_matches(name, '{names.COMMON_UNIT}')) AS derivative FROM universe""")
def derivative_line(spark, d):
    return R.universe(spark, d).select("symbol", "name", names.is_derivative_line(F.col("name")).alias("derivative"))


@query("name_key", f"{U} SELECT symbol, name, {NORM} AS key FROM universe")
def name_key(spark, d):
    return R.universe(spark, d).select("symbol", "name", names.name_key(F.col("name")).alias("key"))


@query("drop_derivative_symbols", f"""{U}, k AS (SELECT *, {NORM.replace('name', "'Company ' || (symbol // 3) || ' Inc'")} AS norm FROM universe)
  SELECT symbol, ticker FROM k WHERE NOT (length(ticker) > 1 AND right(ticker, 1) IN ('W', 'U') AND EXISTS (
    SELECT 1 FROM k s WHERE s.norm = k.norm AND s.ticker = left(k.ticker, length(k.ticker) - 1)))""")
def drop_derivative_symbols(spark, d):
    u = R.universe(spark, d).withColumn("name", F.concat(F.lit("Company "), F.expr("symbol div 3").cast("string"), F.lit(" Inc")))
    return listings.drop_derivative_symbols(u).select("symbol", "ticker")


@query("dedupe_listing", f"""{U}, k AS (SELECT *, {NORM} AS norm, CASE WHEN country = 'United States' AND exchange IN {q(names.US_PRIMARY_EXCHANGES)} THEN 0
    WHEN exchange IN {q(names.US_PRIMARY_EXCHANGES)} THEN 1 ELSE 2 END AS tier FROM universe)
  SELECT symbol, ticker, name FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY tier, length(ticker), ticker, symbol) AS rn FROM k) WHERE rn = 1""")
def dedupe_listing(spark, d):
    u = R.universe(spark, d).withColumn("_norm", names.name_key(F.col("name")))
    return listings.best_listing(u).select("symbol", "ticker", "name")


CLASSIFY = f"""CASE WHEN regexp_matches(name, '{names.DEBT}') THEN 'LISTED_DEBT' WHEN regexp_matches(name, '{names.FUND}') THEN 'FUND'
  WHEN regexp_matches(name, '{names.WARRANT_UNIT}') OR regexp_matches(upper(ticker), '-(WS|WU|W|U)$') THEN 'WARRANT_OR_UNIT'
  WHEN regexp_matches(name, '{names.PREFERRED}') OR regexp_matches(upper(ticker), '-P[A-Z]?$') THEN 'PREFERRED_SHARE'
  WHEN regexp_matches(name, '{names.ROYALTY_TRUST}') THEN 'ROYALTY_TRUST'
  WHEN sec AND cik IS NOT NULL AND upper(exchange) IN {q(names.SEC_PRIMARY_EXCHANGES)} THEN 'PRIMARY_ORDINARY_SHARE'
  WHEN country = 'Netherlands' AND upper(exchange) IN {q(names.DUTCH_PRIMARY_EXCHANGES)} THEN 'DUTCH_PRIMARY_ORDINARY_SHARE'
  WHEN country = 'United States' AND NOT sec THEN 'UNRESOLVED_SECONDARY_LISTING' ELSE 'UNKNOWN_INSTRUMENT' END"""


@query("classify_security", f"""{U}, c AS (SELECT *, cik IS NOT NULL AS sec FROM universe) SELECT symbol, {CLASSIFY} AS reason,
  CASE WHEN {CLASSIFY} LIKE '%PRIMARY_ORD%' THEN 'ELIGIBLE' WHEN {CLASSIFY} LIKE 'UN%' THEN 'REVIEW' ELSE 'INELIGIBLE' END AS eligibility FROM c""")
def classify_security(spark, d):
    c = names.classify(F.col("ticker"), F.col("name"), F.col("country"), F.col("exchange"), F.col("cik"), F.col("cik").isNotNull())
    return R.universe(spark, d).withColumn("c", c).select("symbol", "c.reason", "c.eligibility")


CURRENCY = f"""coalesce(nullif(upper(trim(currency)), ''), CASE WHEN upper(exchange) IN {q(names.SEC_PRIMARY_EXCHANGES)} THEN 'USD'
  WHEN upper(exchange) IN {q(names.DUTCH_PRIMARY_EXCHANGES)} THEN 'EUR' END)"""


@query("listing_currency", f"{U} SELECT symbol, {CURRENCY} AS currency FROM universe")
def listing_currency(spark, d):
    return R.universe(spark, d).select("symbol", names.listing_currency(F.col("currency"), F.col("exchange")).alias("currency"))


@query("home_exchange_filter", f"{U} SELECT symbol, country, exchange FROM universe WHERE " + " OR ".join(
    f"(country = '{c}' AND exchange IN {q(es)})" for c, es in listings.HOME_EXCHANGES.items()))
def home_exchange_filter(spark, d):
    return listings.home_lines(R.universe(spark, d)).select("symbol", "country", "exchange")


@query("sector_tier", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Core' WHEN p_partkey % 5 IN (1, 2) THEN 'Adjacent' ELSE 'Outside' END AS tier FROM part""")
def sector_tier(spark, d):
    k = F.col("p_partkey") % 5
    ind = F.when(k == 0, " Software").when(k == 1, "IT Services ").when(k == 2, "Capital Markets").when(k == 3, F.col("p_type"))
    return R.table(spark, d, "part").select("p_partkey", names.industry_tier(ind).alias("tier"))


@query("join_meta", f"""{R.SQL_FACTS and 'WITH ' + R.SQL_FACTS}, {R.SQL_UNIVERSE} SELECT f.entity, f.seq, f.value, u.sector, u.industry
  FROM facts f LEFT JOIN universe u ON u.symbol = f.entity""")
def join_meta(spark, d):
    """Facts with their listing's sector; an unknown entity keeps NULLs."""
    meta = R.universe(spark, d).select(F.col("symbol").alias("entity"), "sector", "industry")
    return R.facts(spark, d).select("entity", "seq", "value").join(meta, "entity", "left")


REGISTRY = """reg AS (SELECT upper(ticker) AS ticker, symbol // 6 AS cik, CASE WHEN symbol % 2 = 0 THEN 'Company ' || (symbol // 3) || ' Corp' ELSE 'Firm ' || symbol || ' Ltd' END AS name,
    CASE symbol % 4 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'Nasdaq' WHEN 2 THEN 'OTC' ELSE 'NYSE American' END AS exchange, symbol AS seq FROM universe WHERE symbol % 3 <> 2)"""


def _registry(u):
    k = F.col("symbol")
    return u.where(k % 3 != 2).select(
        F.upper("ticker").alias("ticker"), F.expr("symbol div 6").alias("cik"),
        F.when(k % 2 == 0, F.concat(F.lit("Company "), F.expr("symbol div 3").cast("string"), F.lit(" Corp"))).otherwise(
            F.concat(F.lit("Firm "), k.cast("string"), F.lit(" Ltd"))).alias("name"),
        F.when(k % 4 == 0, "NYSE").when(k % 4 == 1, "Nasdaq").when(k % 4 == 2, "OTC").otherwise("NYSE American").alias("exchange"), k.alias("seq"))


@query("identity_join", f"""{U}, {REGISTRY}, j AS (SELECT u.symbol, u.ticker, u.name, u.country, coalesce(r.exchange, u.exchange) AS exchange, r.cik, r.name AS reg_name, r.name IS NOT NULL AS sec, u.currency,
    r.name IS NOT NULL AND len(list_intersect(string_split({NORM.replace('name', 'r.name')}, ' '), string_split({NORM.replace('name', 'u.name')}, ' '))) > 0 AS agrees
    FROM universe u LEFT JOIN reg r ON r.ticker = upper(u.ticker)),
  g AS (SELECT cik, count(*) AS lines, bool_or(agrees) AS any_agrees FROM j WHERE cik IS NOT NULL GROUP BY cik),
  f AS (SELECT j.*, coalesce(lines > 1 AND any_agrees AND NOT agrees, false) AS conflict FROM j LEFT JOIN g ON g.cik = j.cik)
  SELECT symbol, cik, exchange, {CURRENCY} AS currency, CASE WHEN conflict THEN 'IDENTITY_CONFLICT' ELSE {CLASSIFY} END AS reason FROM f""")
def identity_join(spark, d):
    u = R.universe(spark, d)
    return listings.identity(u, _registry(u)).select("symbol", "cik", "exchange", "currency", "reason")


@query("semi_eligible", f"""{U}, c AS (SELECT *, cik IS NOT NULL AS sec FROM universe) SELECT l_suppkey AS symbol, count(*) AS lines FROM lineitem
  WHERE l_suppkey IN (SELECT symbol FROM c WHERE {CLASSIFY} LIKE '%PRIMARY_ORD%') GROUP BY l_suppkey""")
def semi_eligible(spark, d):
    ok = classify_security(spark, d).where("eligibility = 'ELIGIBLE'").select("symbol")
    li = R.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"))
    return li.join(ok, "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("lines"))


@query("canonical_line", f"""{U}, {REGISTRY}, v AS (SELECT *, contains(ticker, '-') AS dash FROM reg WHERE regexp_full_match(ticker, '[A-Z0-9]{{1,6}}(-[A-Z])?')),
  k AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY dash, length(ticker), seq) AS rn FROM v WHERE NOT dash OR NOT regexp_matches(ticker, '-[PWUR]$'))
  SELECT cik, ticker, exchange FROM k WHERE rn = 1 AND exchange IN ('NYSE', 'Nasdaq', 'NYSE American')""")
def canonical_line(spark, d):
    return listings.canonical_lines(_registry(R.universe(spark, d)), ("NYSE", "Nasdaq", "NYSE American")).drop("name")


@query("universe_extend", f"""{U}, {REGISTRY}, have AS (SELECT upper(ticker) AS ticker FROM universe WHERE symbol % 4 = 0),
  seen AS (SELECT cik FROM reg WHERE ticker IN (SELECT ticker FROM have)),
  v AS (SELECT *, contains(ticker, '-') AS dash FROM reg WHERE cik NOT IN (SELECT cik FROM seen) AND regexp_full_match(ticker, '[A-Z0-9]{{1,6}}(-[A-Z])?')),
  k AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY dash, length(ticker), seq) AS rn FROM v WHERE NOT dash OR NOT regexp_matches(ticker, '-[PWUR]$'))
  SELECT ticker, 'base' AS source FROM have UNION ALL SELECT ticker, 'registry' FROM k WHERE rn = 1 AND exchange IN ('NYSE', 'Nasdaq', 'NYSE American')
    AND ticker NOT IN (SELECT ticker FROM have)""")
def universe_extend(spark, d):
    """Base listings plus the canonical line of filers whose company is not present."""
    u = R.universe(spark, d)
    have, reg = u.where("symbol % 4 = 0").select(F.upper("ticker").alias("ticker")), _registry(u)
    seen = reg.join(have, "ticker", "left_semi").select("cik").distinct()
    add = listings.canonical_lines(reg.join(seen, "cik", "left_anti"), ("NYSE", "Nasdaq", "NYSE American")).select("ticker")
    return have.withColumn("source", F.lit("base")).unionByName(
        add.join(have, "ticker", "left_anti").withColumn("source", F.lit("registry")))


@query("rank_liquidity", f"""{U} SELECT symbol, cap_bucket FROM universe ORDER BY CASE cap_bucket WHEN 'Mega Cap' THEN 0 WHEN 'Large Cap' THEN 1
   WHEN 'Mid Cap' THEN 2 WHEN 'Small Cap' THEN 3 ELSE 4 END, ticker, symbol LIMIT 40""")
def rank_liquidity(spark, d):
    """Starter set: the 40 most liquid lines by cap bucket, unknown last."""
    u = R.universe(spark, d)
    return u.orderBy(listings.cap_rank(F.col("cap_bucket")), "ticker", "symbol").limit(40).select("symbol", "cap_bucket")


@query("symbol_variants", f"""{U} SELECT symbol, ticker, CASE WHEN contains(ticker, '-') THEN ticker || ',' || replace(ticker, '-', '.') ELSE ticker END AS variants FROM universe""")
def symbol_variants(spark, d):
    return R.universe(spark, d).select("symbol", "ticker", F.array_join(names.symbol_variants(F.col("ticker")), ",").alias("variants"))


@query("audit_summary", f"""{U}, c AS (SELECT *, cik IS NOT NULL AS sec FROM universe), r AS (SELECT {CLASSIFY} AS reason, coalesce(exchange, 'UNKNOWN') AS exchange FROM c)
  SELECT 'reason' AS facet, reason AS value, count(*) AS n FROM r GROUP BY reason UNION ALL SELECT 'exchange', exchange, count(*) FROM r GROUP BY exchange""")
def audit_summary(spark, d):
    rows = R.universe(spark, d).join(classify_security(spark, d), "symbol").withColumn("exchange", F.coalesce("exchange", F.lit("UNKNOWN")))
    return (rows.groupingSets([["reason"], ["exchange"]], "reason", "exchange").agg(F.count("*").alias("n"), F.grouping("reason").alias("g"))
            .select(F.when(F.col("g") == 0, "reason").otherwise("exchange").alias("facet"), F.coalesce("reason", "exchange").alias("value"), "n"))
