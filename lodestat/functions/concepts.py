"""Rules that turn filed tags and vendor rows into the labels of statements (see ``operators.rules``)."""

from lodestat.operators.rules import piece

# fixed values: standard tags of each label, in order of preference
REVENUE = ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet")
COST = ("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfServices", "CostOfGoodsSold", "CostOfSales")
OPERATING_INCOME = ("OperatingIncomeLoss",)
NET_INCOME = ("NetIncomeLoss",)
NET_INCOME_INCL_NCI = ("ProfitLoss", "NetIncomeLoss")
OPERATING_CASH = ("NetCashProvidedByUsedInOperatingActivities",)
CAPEX = ("PaymentsToAcquirePropertyPlantAndEquipment",)
STOCK_COMPENSATION = ("ShareBasedCompensation",)
DEPRECIATION_AMORTIZATION = ("DepreciationDepletionAndAmortization", "DepreciationAndAmortization")
DEPRECIATION_PARTS = ("Depreciation", "AmortizationOfIntangibleAssets")
DIVIDENDS = ("PaymentsOfDividendsCommonStock", "PaymentsOfDividends", "PaymentsOfDistributionsToAffiliates")
BUYBACKS = ("PaymentsForRepurchaseOfCommonStock",)
CASH = ("CashAndCashEquivalentsAtCarryingValue",)
EQUITY = ("StockholdersEquity",)
EQUITY_INCL_NCI = ("StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",)
ASSETS = ("Assets",)
CURRENT_ASSETS = ("AssetsCurrent",)
CURRENT_LIABILITIES = ("LiabilitiesCurrent",)
LONG_DEBT = ("LongTermDebt", "DebtAndCapitalLeaseObligations", "DebtLongtermAndShorttermCombinedAmount")
NONCURRENT_DEBT = ("LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligations")
CURRENT_DEBT = ("LongTermDebtCurrent", "DebtCurrent")
SHORT_DEBT = ("ShortTermBorrowings",)

# a sum of parts filed over exactly the same span stands for a tag of its own
COMPOSED = "DepreciationPlusAmortization"
SPANS = {COMPOSED: DEPRECIATION_PARTS}

FLOWS = {
    "revenue": REVENUE,
    "gross_profit": ((piece("GrossProfit"),), (piece(*REVENUE), piece(*COST, sign=-1))),
    "cost": COST,
    "ebit": OPERATING_INCOME,
    "net_income": NET_INCOME,
    "net_income_incl_nci": NET_INCOME_INCL_NCI,
    "ocf": OPERATING_CASH,
    "capex": ((piece(*CAPEX, sign=-1),),),
    "sbc": STOCK_COMPENSATION,
    "da": (*DEPRECIATION_AMORTIZATION, COMPOSED),
    "dividends": DIVIDENDS,
    "buybacks": BUYBACKS,
}
POINTS = {
    "cash": CASH,
    "equity": EQUITY,
    "total_assets": ASSETS,
    "current_assets": CURRENT_ASSETS,
    "current_liabilities": CURRENT_LIABILITIES,
    "debt": ((piece(*LONG_DEBT),), (piece(*NONCURRENT_DEBT, role="any"), piece(*CURRENT_DEBT, role="any"), piece(*SHORT_DEBT, role="extra"))),
    "nci": ((piece(*EQUITY_INCL_NCI), piece(*EQUITY, sign=-1)),),
    "working_capital": ((piece(*CURRENT_ASSETS), piece(*CURRENT_LIABILITIES, sign=-1)),),
}

# fixed values: rows of a vendor's statements, in order of preference
ROWS = {
    "revenue": ("Total Revenue", "Operating Revenue"),
    "ebitda": ("EBITDA", "Normalized EBITDA"),
    "ebit": ("EBIT", "Operating Income"),
    "net_income": ("Net Income",),
    "ni_incl_nci": ("Net Income Including Noncontrolling Interests", "Net Income Continuous Operations", "Net Income"),
    "gross_profit": ("Gross Profit",),
    "operating_income": ("Operating Income", "EBIT"),
    "interest_expense": ("Interest Expense",),
    "total_debt": ("Total Debt",),
    "cash": ("Cash And Cash Equivalents", "Cash Cash Equivalents And Short Term Investments"),
    "working_capital": ("Working Capital",),
    "total_assets": ("Total Assets",),
    "current_assets": ("Current Assets",),
    "current_liabilities": ("Current Liabilities",),
    "equity": ("Stockholders Equity", "Common Stock Equity"),
    "nci": ("Minority Interest",),
    "ocf": ("Operating Cash Flow",),
    "capex": ("Capital Expenditure",),
    "sbc": ("Stock Based Compensation",),
    "da": ("Depreciation And Amortization", "Depreciation Amortization Depletion"),
}
CREDIT_LOSS_ROWS = (
    "Provision For Doubtful Accounts",
    "Provisionand Write Offof Assets",
    "Change In Loss Reserves",
    "Provision For Loan Lease And Other Losses",
    "Allowance For Funds Used During Construction",
)
CREDIT_LOSS = {"credit_loss": (tuple(piece(row, role="any") for row in CREDIT_LOSS_ROWS),)}
DEFERRED = {"deferred": ((piece("Current Deferred Revenue"), piece("Non Current Deferred Revenue", role="extra")), (piece("Deferred Revenue"),))}
