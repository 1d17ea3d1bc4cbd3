"""Statements as companies file them: tags and rows differ by company, and sums come in parts. The SQL side reads the same tags
as columns, one expression per label."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.functions import concepts as C
from lodestat.operators import statements as S
from lodestat.operators.rules import names

# tag -> its value, over the columns of a statement
TAGS = {
    "RevenueFromContractWithCustomerExcludingAssessedTax": "CASE WHEN entity % 3 = 0 THEN revenue END",
    "Revenues": "CASE WHEN entity % 3 = 1 THEN revenue WHEN entity % 15 = 0 THEN 2 * revenue END",
    "SalesRevenueNet": "CASE WHEN entity % 3 = 2 THEN revenue END",
    "GrossProfit": "CASE WHEN entity % 4 <> 0 THEN gross_profit END",
    "CostOfRevenue": "CASE WHEN entity % 2 = 0 THEN cost END",
    "CostOfGoodsSold": "cost",
    "OperatingIncomeLoss": "ebit",
    "NetIncomeLoss": "net_income",
    "ProfitLoss": "CASE WHEN entity % 2 = 0 THEN 1.25 * net_income END",
    "NetCashProvidedByUsedInOperatingActivities": "ocf",
    "PaymentsToAcquirePropertyPlantAndEquipment": "-capex",
    "ShareBasedCompensation": "sbc",
    "DepreciationDepletionAndAmortization": "CASE WHEN entity % 3 = 0 THEN da END",
    "DepreciationAndAmortization": "CASE WHEN entity % 3 = 1 THEN da END",
    "Depreciation": "0.5 * da",
    "AmortizationOfIntangibleAssets": "CASE WHEN entity % 6 <> 5 THEN 0.25 * da END",
    "PaymentsOfDividendsCommonStock": "CASE WHEN entity % 2 = 0 THEN dividends END",
    "PaymentsOfDividends": "CASE WHEN entity % 2 = 1 THEN dividends END",
    "PaymentsForRepurchaseOfCommonStock": "buybacks",
    "CashAndCashEquivalentsAtCarryingValue": "cash",
    "StockholdersEquity": "equity",
    "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest": "coalesce(equity + nci, nci)",
    "Assets": "total_assets",
    "AssetsCurrent": "current_assets",
    "LiabilitiesCurrent": "current_liabilities",
    "LongTermDebt": "CASE WHEN entity % 4 = 0 THEN debt END",
    "LongTermDebtNoncurrent": "CASE WHEN entity % 4 < 2 THEN 0.5 * debt END",
    "LongTermDebtCurrent": "CASE WHEN entity % 4 = 1 THEN 0.25 * debt END",
    "DebtCurrent": "CASE WHEN entity % 4 IN (1, 2) THEN 0.5 * debt END",
    "ShortTermBorrowings": "0.25 * debt",
}
# rows of a vendor's statement
ROWS = {
    "Total Revenue": "CASE WHEN entity % 3 <> 0 THEN revenue END",
    "Operating Revenue": "0.5 * revenue",
    "EBITDA": "CASE WHEN entity % 5 <> 0 THEN ebit + da END",
    "Normalized EBITDA": "ebit",
    "EBIT": "CASE WHEN entity % 4 <> 1 THEN ebit END",
    "Operating Income": "CASE WHEN entity % 4 <> 2 THEN 0.5 * ebit END",
    "Net Income": "net_income",
    "Net Income Continuous Operations": "CASE WHEN entity % 2 = 0 THEN 0.5 * net_income END",
    "Cash Cash Equivalents And Short Term Investments": "2 * cash",
    "Cash And Cash Equivalents": "CASE WHEN entity % 3 = 1 THEN cash END",
    "Common Stock Equity": "equity",
    "Stockholders Equity": "CASE WHEN entity % 2 = 1 THEN equity + coalesce(nci, 0) END",
    "Depreciation Amortization Depletion": "da",
    "Operating Cash Flow": "ocf",
    "Provision For Doubtful Accounts": "CASE WHEN entity % 2 = 0 THEN credit_loss END",
    "Provisionand Write Offof Assets": "CASE WHEN entity % 3 = 0 THEN 0.5 * credit_loss END",
    "Change In Loss Reserves": "CASE WHEN entity % 5 = 0 THEN -0.25 * credit_loss END",
    "Provision For Loan Lease And Other Losses": "CASE WHEN entity % 2 = 1 THEN 0.25 * sbc END",
    "Current Deferred Revenue": "CASE WHEN entity % 3 < 2 THEN 0.5 * deferred END",
    "Non Current Deferred Revenue": "CASE WHEN entity % 3 > 0 THEN 0.25 * deferred END",
    "Deferred Revenue": "deferred",
}
# labels that are filed under a tag of their own name
POINT_TAGS = (*(t for t in TAGS if t in names(C.POINTS)), *(c for c in S.BALANCE if c not in C.POINTS))
OWN = tuple(c for c in R.LABELS if c not in C.FLOWS and c not in C.POINTS)
FLOWS = {**C.FLOWS, **{c: (c,) for c in OWN if c not in S.BALANCE}}
POINTS = {**C.POINTS, **{c: (c,) for c in OWN if c in S.BALANCE}}


def _long(statements: DataFrame, cells: dict, name: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(t).alias(name), F.expr(e).cast("double").alias("value")) for t, e in cells.items()])
    return statements.select("entity", "scope", "period_end", F.explode(pairs).alias("p")).select("entity", "scope", "period_end", f"p.{name}", "p.value").where("value IS NOT NULL")


def rows(statements: DataFrame) -> DataFrame:
    """(entity, scope, period_end, row, value) of the vendor's rows."""
    return _long(statements, ROWS, "row")


def filed(statements: DataFrame) -> DataFrame:
    """Facts (entity, tag, start_day, end_day, filed, form, value, seq), filed 30 days after their end: flows over their span, the
    balance of a quarter at its day."""
    x = _long(statements, {**TAGS, **{c: c for c in OWN}}, "tag")
    point = F.col("tag").isin(*POINT_TAGS)
    start = F.when(~point, F.date_sub("period_end", F.when(F.col("scope") == "annual", 364).otherwise(89)))
    return x.where(~point | (F.col("scope") == "quarterly")).select(
        "entity", "tag", start.alias("start_day"), F.col("period_end").alias("end_day"), F.date_add("period_end", 30).alias("filed"),
        F.lit("10-Q").alias("form"), "value", F.lit(0).cast("bigint").alias("seq"))


# --- SQL: tags as columns, labels as expressions ------------------------------------------------

def _q(name: str) -> str:
    return f'"{name}"'


def _columns(cells: dict) -> str:
    return ", ".join(f"CAST({e} AS DOUBLE) AS {_q(t)}" for t, e in cells.items())


_REV = "coalesce(RevenueFromContractWithCustomerExcludingAssessedTax, Revenues, SalesRevenueNet)"
_COST = "coalesce(CostOfRevenue, CostOfGoodsSold)"
_CUR = "coalesce(LongTermDebtCurrent, DebtCurrent)"
LABEL_SQL = {
    "revenue": _REV,
    "gross_profit": f"coalesce(GrossProfit, {_REV} - {_COST})",
    "cost": _COST,
    "ebit": "OperatingIncomeLoss",
    "net_income": "NetIncomeLoss",
    "net_income_incl_nci": "coalesce(ProfitLoss, NetIncomeLoss)",
    "ocf": "NetCashProvidedByUsedInOperatingActivities",
    "capex": "-PaymentsToAcquirePropertyPlantAndEquipment",
    "sbc": "ShareBasedCompensation",
    "da": "coalesce(DepreciationDepletionAndAmortization, DepreciationAndAmortization, Depreciation + AmortizationOfIntangibleAssets)",
    "dividends": "coalesce(PaymentsOfDividendsCommonStock, PaymentsOfDividends)",
    "buybacks": "PaymentsForRepurchaseOfCommonStock",
    "cash": "CashAndCashEquivalentsAtCarryingValue",
    "equity": "StockholdersEquity",
    "total_assets": "Assets",
    "current_assets": "AssetsCurrent",
    "current_liabilities": "LiabilitiesCurrent",
    "debt": f"coalesce(LongTermDebt, CASE WHEN LongTermDebtNoncurrent IS NOT NULL OR {_CUR} IS NOT NULL THEN coalesce(LongTermDebtNoncurrent, 0) + coalesce({_CUR}, 0) + coalesce(ShortTermBorrowings, 0) END)",
    "nci": "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest - StockholdersEquity",
}
SQL_REPORTED = f"""{R.SQL_STATEMENTS.replace('stm AS (', 'stm_raw AS (')},
  tags AS (SELECT entity, scope, period_end, {_columns(TAGS)}, {', '.join(OWN)} FROM stm_raw),
  stm AS (SELECT entity, scope, period_end, {', '.join(f'{e} AS {c}' for c, e in LABEL_SQL.items())}, {', '.join(OWN)} FROM tags)"""
SQL_ROWS = f"{R.SQL_STATEMENTS}, vendor AS (SELECT entity, scope, period_end, {_columns(ROWS)} FROM stm)"



def reported_sql(sql: str) -> str:
    """The same SQL over statements made from tags."""
    return sql.replace(R.SQL_STATEMENTS, SQL_REPORTED)
