"""Company names, listing classes and symbols as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: name suffixes that do not identify a company
SUFFIX_TOKENS = ("inc", "incorporated", "corp", "corporation", "company", "co", "plc", "nv", "sa", "se",
                 "ag", "ab", "ltd", "limited", "holding", "holdings", "group", "the", "adr", "ads", "adss",
                 "sponsored", "unsponsored", "registry", "shs", "shares")
# fixed values: exchanges and listing patterns
SEC_PRIMARY_EXCHANGES = ("NYSE", "NASDAQ", "NYSE AMERICAN")
DUTCH_PRIMARY_EXCHANGES = ("AMS", "EURONEXT AMSTERDAM")
US_PRIMARY_EXCHANGES = ("NMS", "NYQ", "NGM", "NCM", "NGS", "NAS", "ASE", "AMX", "PCX", "BTS")
DEBT = (r"(?i)\b(first mortgage bonds?|senior notes?|subordinated notes?|debentures?)\b"
        r"|\bnotes?\s+due\s+\d{4}\b|\bsr\s+nt\b")
FUND = r"(?i)\b(fund|exchange[- ]traded fund|closed[- ]end|investment company)\b"
WARRANT_UNIT = r"(?i)\b(warrants?|units?)\b"
WARRANT = r"(?i)\bwarrants?\b"
UNIT = r"(?i)\bunits?\b"
COMMON_UNIT = r"(?i)\bcommon units?\b"
PREFERRED = (r"(?i)\bpreferred(?: stock| shares?| securities)?\b|\bpreference shares?\b"
             r"|\bcum(?:ulative)?\s+pfd\b|\bdepositary shares?\b")
ROYALTY_TRUST = r"(?i)\broyalty trust\b"
CORE_INDUSTRIES = ("software", "health care technology")
ADJACENT_INDUSTRIES = ("it services", "semiconductors & semiconductor equipment",
                       "health care equipment & supplies", "life sciences tools & services",
                       "interactive media & services", "capital markets")

SUFFIX_TAIL = "( (" + "|".join(SUFFIX_TOKENS) + "|[a-z0-9]))+$"


def name_key(name) -> Column:
    """Company key: lower case, before " - ", no brackets, no punctuation, and
    trailing legal suffixes and single letters removed (one token always stays)."""
    s = F.element_at(F.split(F.lower(name), " - "), 1)
    s = F.regexp_replace(s, r"\(.*?\)", " ")
    s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    return F.regexp_replace(s, SUFFIX_TAIL, "")


def is_derivative_line(name: Column) -> Column:
    """Warrants always; units except common units."""
    return name.rlike(WARRANT) | (name.rlike(UNIT) & ~name.rlike(COMMON_UNIT))


def classify(symbol: Column, name: Column, country: Column, exchange: Column, cik: Column,
             sec_primary: Column) -> Column:
    """struct(instrument, eligibility, reason) by the first rule that holds."""
    sym = F.upper(F.trim(symbol))
    exch = F.upper(F.trim(F.coalesce(exchange, F.lit(""))))
    land = F.upper(F.trim(F.coalesce(country, F.lit(""))))

    def out(kind, state, reason):
        return F.struct(F.lit(kind).alias("instrument"), F.lit(state).alias("eligibility"), F.lit(reason).alias("reason"))

    return (
        F.when(name.rlike(DEBT), out("LISTED_DEBT", "INELIGIBLE", "LISTED_DEBT"))
        .when(name.rlike(FUND), out("FUND", "INELIGIBLE", "FUND"))
        .when(name.rlike(WARRANT_UNIT) | sym.rlike("-(WS|WU|W|U)$"), out("WARRANT_OR_UNIT", "INELIGIBLE", "WARRANT_OR_UNIT"))
        .when(name.rlike(PREFERRED) | sym.rlike("-P[A-Z]?$"), out("PREFERRED_SHARE", "INELIGIBLE", "PREFERRED_SHARE"))
        .when(name.rlike(ROYALTY_TRUST), out("ROYALTY_TRUST", "INELIGIBLE", "ROYALTY_TRUST"))
        .when(sec_primary & cik.isNotNull() & exch.isin(*SEC_PRIMARY_EXCHANGES),
              out("ORDINARY_SHARE", "ELIGIBLE", "PRIMARY_ORDINARY_SHARE"))
        .when(land.isin("NETHERLANDS", "NL") & exch.isin(*DUTCH_PRIMARY_EXCHANGES),
              out("ORDINARY_SHARE", "ELIGIBLE", "DUTCH_PRIMARY_ORDINARY_SHARE"))
        .when(land.isin("UNITED STATES", "US", "USA") & ~sec_primary, out("UNKNOWN", "REVIEW", "UNRESOLVED_SECONDARY_LISTING"))
        .otherwise(out("UNKNOWN", "REVIEW", "UNKNOWN_INSTRUMENT")))


def listing_currency(value: Column, exchange: Column) -> Column:
    exch = F.upper(F.trim(F.coalesce(exchange, F.lit(""))))
    return F.coalesce(F.nullif(F.upper(F.trim(value)), F.lit("")),
                      F.when(exch.isin(*SEC_PRIMARY_EXCHANGES), "USD").when(exch.isin(*DUTCH_PRIMARY_EXCHANGES), "EUR"))


def industry_tier(industry: Column) -> Column:
    ind = F.lower(F.trim(F.coalesce(industry, F.lit(""))))
    return F.when(ind.isin(*CORE_INDUSTRIES), "Core").when(ind.isin(*ADJACENT_INDUSTRIES), "Adjacent").otherwise("Outside")


def symbol_variants(symbol: Column) -> Column:
    """Class-suffix spellings a vendor may use, the given one first."""
    return F.array_distinct(F.array(symbol, F.replace(symbol, F.lit("-"), F.lit(".")), F.replace(symbol, F.lit("/"), F.lit("."))))


def listing_tier(symbol: Column, exchange: Column, country: Column) -> Column:
    """0 home line, 1 primary exchange, 2 plain symbol, 3 the rest."""
    plain = ~symbol.contains(".")
    primary = plain & F.upper(exchange).isin(*US_PRIMARY_EXCHANGES)
    home = ((country == "Netherlands") & symbol.endswith(".AS")) | ((country == "United States") & primary)
    return F.when(home, 0).when(primary, 1).when(plain, 2).otherwise(3)
