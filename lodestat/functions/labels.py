"""Canonical statement labels, veto reasons, first sentences, valuation texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tag -> labels
TAG_LABELS = {
    "RevenueFromContractWithCustomerExcludingAssessedTax": "Total Revenue", "Revenues": "Total Revenue", "SalesRevenueNet": "Total Revenue",
    "OperatingIncomeLoss": ("EBIT", "Operating Income"), "GrossProfit": "Gross Profit", "CostOfRevenue": "Cost Of Revenue", "CostOfGoodsAndServicesSold": "Cost Of Revenue",
    "NetIncomeLoss": "Net Income", "ProfitLoss": "Net Income Including Noncontrolling Interests", "NetCashProvidedByUsedInOperatingActivities": "Operating Cash Flow",
    "PaymentsToAcquirePropertyPlantAndEquipment": "Capital Expenditure", "ShareBasedCompensation": "Stock Based Compensation",
    "DepreciationDepletionAndAmortization": "Depreciation And Amortization", "DepreciationAndAmortization": "Depreciation And Amortization",
    "PaymentsOfDividendsCommonStock": "Cash Dividends Paid", "PaymentsOfDividends": "Cash Dividends Paid", "PaymentsForRepurchaseOfCommonStock": "Repurchase Of Capital Stock",
    "CashAndCashEquivalentsAtCarryingValue": "Cash And Cash Equivalents", "StockholdersEquity": "Stockholders Equity", "Assets": "Total Assets", "AssetsCurrent": "Current Assets",
    "LiabilitiesCurrent": "Current Liabilities", "Liabilities": "Total Liabilities", "Goodwill": "Goodwill", "IntangibleAssetsNetExcludingGoodwill": "Intangible Assets",
    "RetainedEarningsAccumulatedDeficit": "Retained Earnings", "DebtAndCapitalLeaseObligations": "Total Debt", "DebtLongtermAndShorttermCombinedAmount": "Total Debt",
    "InterestExpense": "Interest Expense", "InterestExpenseNonoperating": "Interest Expense", "ResearchAndDevelopmentExpense": "Research And Development",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest": "Pretax Income",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments": "Pretax Income",
    "IncomeTaxExpenseBenefit": "Income Tax Expense", "IncomeTaxesPaidNet": "Income Taxes Paid", "IncomeTaxesPaid": "Income Taxes Paid",
    "PaymentsToAcquireBusinessesNetOfCashAcquired": "Acquisitions", "PaymentsToAcquireBusinessesGross": "Acquisitions"}
# fixed values: normalised caption -> labels
CAPTION_LABELS = {
    "total revenue": "Total Revenue", "total revenues": "Total Revenue", "net revenue": "Total Revenue", "net revenues": "Total Revenue", "net sales": "Total Revenue", "revenue": "Total Revenue",
    "revenues": "Total Revenue", "operating income": ("EBIT", "Operating Income"), "operating income loss": ("EBIT", "Operating Income"), "gross profit": "Gross Profit", "cost of revenue": "Cost Of Revenue",
    "net income": "Net Income", "net cash provided by operating activities": "Operating Cash Flow", "net cash provided by used in operating activities": "Operating Cash Flow",
    "capital expenditures": "Capital Expenditure", "payments to acquire property plant and equipment": "Capital Expenditure", "stock based compensation": "Stock Based Compensation",
    "depreciation and amortization": "Depreciation And Amortization", "research and development expense": "Research And Development", "income tax expense benefit": "Income Tax Expense",
    "income taxes paid": "Income Taxes Paid", "cash and cash equivalents": "Cash And Cash Equivalents", "total assets": "Total Assets", "total liabilities": "Total Liabilities",
    "stockholders equity": "Stockholders Equity", "current assets": "Current Assets", "current liabilities": "Current Liabilities", "goodwill": "Goodwill", "retained earnings": "Retained Earnings"}
DISTRESS_YIELD_PCT = 15.0
# fixed values: tokens whose dot does not end a sentence
ABBREVIATIONS = ("Inc", "Corp", "Co", "Ltd", "plc", "LLC", "L.P", "S.A", "N.V", "U.S", "U.K", "E.U", "vs", "approx", "est", "cf", "e.g", "i.e",
                 "Mr", "Ms", "Dr", "St", "Jr", "Sr")


def _lookup(table: dict, key: Column) -> Column:
    """The labels of a key as an array; one label may stand alone in the table."""
    values = {k: (v,) if isinstance(v, str) else v for k, v in table.items()}
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), key)


def caption_key(caption: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(caption), "[^a-z0-9]+", " "))


def canonical_labels(tag: Column, caption: Column) -> Column:
    """Labels of the tag, else of its caption, as an array."""
    return F.coalesce(_lookup(TAG_LABELS, tag), _lookup(CAPTION_LABELS, caption_key(caption)))


def canonical_reason(reason: Column) -> Column:
    """Measured numbers masked; thresholds after a comparison sign are kept."""
    masked = F.regexp_replace(reason, r"(?<![<>=≤≥]\s{0,5})(?<![<>=≤≥]\s{0,5}[+-])(?<![\d.,])[+-]?\d+(?:[.,]\d+)?", "…")
    return F.trim(F.regexp_replace(masked, r"\s+", " "))


def valuation_signal(pct: Column, yield_pct: Column) -> Column:
    return (F.when(yield_pct >= DISTRESS_YIELD_PCT, "priced as if this cash flow will not last").when(pct >= 80, "appears inexpensive").when(pct >= 60, "somewhat inexpensive")
            .when(pct >= 40, "near the middle").when(pct >= 20, "somewhat demanding").otherwise("appears demanding"))


def first_sentence(text: Column, limit: int = 300) -> Column:
    """Text up to the first sentence end that does not follow an abbreviation or an
    initial; a sentence starts with a capital or a digit."""
    tokens = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    end = rf"(?<=[.!?])(?<!(?:^|\s)(?:{tokens}|\p{{Lu}})\.)\s+(?=[\"'(\[]?[A-Z0-9])"
    return F.trim(F.substring(F.split(F.trim(text), end, 2)[0], 1, limit))
