"""Universe and security master: filters, company dedupe, identity checks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import names

# fixed values: universe predicate and home venues
COUNTRIES = ("United States", "Netherlands")
CORE_SECTORS = ("Information Technology", "Health Care")
BROAD_EXCLUDED_SECTORS = ("Financials", "Real Estate")
CAPS_DEFAULT = ("Mega Cap", "Large Cap", "Mid Cap")
CAPS_BROAD = CAPS_DEFAULT + ("Small Cap",)
HOME_EXCHANGES = {
    "United States": ("NMS", "NYQ", "NGM", "NCM", "ASE", "PCX", "BATS", "NYS"), "United Kingdom": ("LSE",),
    "Germany": ("GER",), "France": ("PAR",), "Netherlands": ("AMS",), "Switzerland": ("EBS", "VTX"), "Italy": ("MIL",),
    "Spain": ("MCE",), "Sweden": ("STO",), "Denmark": ("CPH",), "Finland": ("HEL",), "Norway": ("OSL",), "Belgium": ("BRU",),
    "Ireland": ("ISE", "DUB"), "Portugal": ("LIS",), "Austria": ("VIE",), "Poland": ("WSE",), "Greece": ("ATH",),
    "Iceland": ("ICE",), "Luxembourg": ("LUX",)}
CAP_ORDER = ("mega_cap", "large_cap", "mid_cap", "small_cap")


def universe_filter(u: DataFrame, *, broad: bool = False, countries=COUNTRIES, sectors=CORE_SECTORS,
                    excluded=BROAD_EXCLUDED_SECTORS) -> DataFrame:
    base = u.where(F.col("name").isNotNull() & (F.trim("ticker") != "") & F.col("country").isin(*countries))
    if broad:
        return base.where(F.col("sector").isNotNull() & ~F.col("sector").isin(*excluded) & F.col("cap_bucket").isin(*CAPS_BROAD))
    return base.where(F.col("sector").isin(*sectors) & F.col("cap_bucket").isin(*CAPS_DEFAULT))


def drop_derivative_symbols(u: DataFrame) -> DataFrame:
    """Drop a symbol that is a sibling's symbol plus W or U in one company."""
    keyed = u.withColumn("_norm", names.name_key(F.col("name")))
    stems = keyed.select("_norm", F.col("ticker").alias("_stem")).distinct()
    stem = F.when(F.col("ticker").rlike(".[WU]$"), F.expr("left(ticker, length(ticker) - 1)"))
    return (keyed.withColumn("_stem", stem).join(stems, ["_norm", "_stem"], "left_anti").drop("_stem"))


def best_listing(u: DataFrame, key: str = "_norm") -> DataFrame:
    """One line per company: listing tier, then shortest symbol, then alphabetical;
    lines without a company key are all kept."""
    rank = F.struct(names.listing_tier(F.col("ticker"), F.col("exchange"), F.col("country")).alias("tier"),
                    F.length("ticker").alias("len"), F.col("ticker"), F.col("symbol"))
    cols = [c for c in u.columns if c != key]
    named = u.where(F.col(key) != "").groupBy(key).agg(F.min_by(F.struct(*cols), rank).alias("r"))
    return named.select("r.*").unionByName(u.where(F.col(key) == "").select(*cols))


def home_lines(u: DataFrame) -> DataFrame:
    """Lines on a home venue of their country; passed through if columns are missing."""
    if not {"country", "exchange"} <= set(u.columns):
        return u
    spark = u.sparkSession
    venues = spark.createDataFrame([(c, e) for c, es in HOME_EXCHANGES.items() for e in es], "country string, exchange string")
    return u.withColumns({"country": F.trim("country"), "exchange": F.trim("exchange")}).join(venues, ["country", "exchange"], "left_semi")


def canonical_lines(filers: DataFrame, exchanges) -> DataFrame:
    """One ticker per filer: dash-free ones first, else class suffixes; shortest,
    then file order; only kept exchanges."""
    t = F.col("ticker")
    valid = t.rlike("^[A-Z0-9]{1,6}(-[A-Z])?$")
    dash = t.contains("-")
    usable = filers.where(valid & (~dash | ~t.rlike("-[PWUR]$")))
    pick = usable.groupBy("cik").agg(F.min_by(F.struct("ticker", "exchange", "name"), F.struct(dash, F.length(t), F.col("seq"))).alias("r"))
    return pick.select("cik", "r.*").where(F.col("exchange").isin(*exchanges))


def identity(universe: DataFrame, registry: DataFrame) -> DataFrame:
    """Listings joined with the regulator's tickers and classified. A line whose
    name shares no word with the regulator's, while another line of the same filer
    does, goes to review. The per-filer word check is a grouped maximum, so the
    lines of one filer are never paired with each other."""
    reg = registry.select(F.upper("ticker").alias("ticker"), F.col("cik").alias("reg_cik"), F.col("name").alias("reg_name"),
                          F.col("exchange").alias("reg_exchange"))
    u = universe.drop("cik").withColumn("ticker", F.upper(F.trim("ticker"))).join(reg, "ticker", "left")
    words = F.split(names.name_key(F.col("reg_name")), " ")
    u = u.withColumn("_own", names.name_key(F.col("name")))
    u = u.withColumn("agrees", F.coalesce(F.arrays_overlap(words, F.split("_own", " ")), F.lit(False)))
    per_filer = (u.where("reg_cik IS NOT NULL").groupBy("reg_cik")
                 .agg(F.count("*").alias("lines"), F.bool_or("agrees").alias("any_agrees")))
    u = u.join(per_filer, "reg_cik", "left")
    exchange = F.coalesce("reg_exchange", "exchange")
    c = names.classify(F.col("ticker"), F.col("name"), F.col("country"), exchange, F.col("reg_cik"), F.col("reg_name").isNotNull())
    conflict = (F.col("lines") > 1) & F.col("any_agrees") & ~F.col("agrees")
    return (u.withColumn("c", c).select(
        "symbol", "ticker", "name", F.col("reg_cik").alias("cik"), exchange.alias("exchange"),
        names.listing_currency(F.col("currency"), exchange).alias("currency"),
        F.when(conflict, "UNKNOWN").otherwise(F.col("c.instrument")).alias("instrument"),
        F.when(conflict, "REVIEW").otherwise(F.col("c.eligibility")).alias("eligibility"),
        F.when(conflict, "IDENTITY_CONFLICT").otherwise(F.col("c.reason")).alias("reason")))


def cap_rank(bucket):
    b = F.replace(F.lower(F.trim(bucket)), F.lit(" "), F.lit("_"))
    rank = F.lit(len(CAP_ORDER))
    for i, name in reversed(list(enumerate(CAP_ORDER))):
        rank = F.when(b == name, i).otherwise(rank)
    return F.coalesce(rank, F.lit(len(CAP_ORDER)))
