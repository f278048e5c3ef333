"""The default universe of companies: a dimension table (ticker, name, sector, grp)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "ticker string, name string, sector string, grp string"

# fixed values: ticker | name | sector | business group
COMPANIES = """
RELIANCE.NS|Reliance Industries|Energy/Conglomerate|Reliance
TCS.NS|Tata Consultancy Services|IT|Tata
HDFCBANK.NS|HDFC Bank|Banking|HDFC
ICICIBANK.NS|ICICI Bank|Banking|
INFY.NS|Infosys|IT|
HINDUNILVR.NS|Hindustan Unilever|FMCG|
ITC.NS|ITC|FMCG|
SBIN.NS|State Bank of India|Banking|SBI
BHARTIARTL.NS|Bharti Airtel|Telecom|
KOTAKBANK.NS|Kotak Mahindra Bank|Banking|
LT.NS|Larsen & Toubro|Infrastructure|
BAJFINANCE.NS|Bajaj Finance|Financials|Bajaj
AXISBANK.NS|Axis Bank|Banking|
ASIANPAINT.NS|Asian Paints|Materials|
MARUTI.NS|Maruti Suzuki|Auto|
HCLTECH.NS|HCL Technologies|IT|
SUNPHARMA.NS|Sun Pharmaceutical|Pharma|
TITAN.NS|Titan Company|Consumer Durables|Tata
ULTRACEMCO.NS|UltraTech Cement|Cement|
WIPRO.NS|Wipro|IT|
NESTLEIND.NS|Nestle India|FMCG|
ONGC.NS|Oil & Natural Gas Corp|Energy|
NTPC.NS|NTPC|Utilities|
POWERGRID.NS|Power Grid Corp|Utilities|
M&M.NS|Mahindra & Mahindra|Auto|Mahindra
TATAMOTORS.NS|Tata Motors|Auto|Tata
TATASTEEL.NS|Tata Steel|Metals|Tata
JSWSTEEL.NS|JSW Steel|Metals|
ADANIENT.NS|Adani Enterprises|Conglomerate|Adani
ADANIPORTS.NS|Adani Ports & SEZ|Logistics|Adani
COALINDIA.NS|Coal India|Energy|
BAJAJFINSV.NS|Bajaj Finserv|Financials|Bajaj
HDFCLIFE.NS|HDFC Life Insurance|Insurance|HDFC
SBILIFE.NS|SBI Life Insurance|Insurance|SBI
BPCL.NS|Bharat Petroleum|Energy|
GRASIM.NS|Grasim Industries|Cement|
HINDALCO.NS|Hindalco Industries|Metals|
DIVISLAB.NS|Divi's Laboratories|Pharma|
DRREDDY.NS|Dr. Reddy's Laboratories|Pharma|
CIPLA.NS|Cipla|Pharma|
BRITANNIA.NS|Britannia Industries|FMCG|
EICHERMOT.NS|Eicher Motors|Auto|
HEROMOTOCO.NS|Hero MotoCorp|Auto|
BAJAJ-AUTO.NS|Bajaj Auto|Auto|Bajaj
TATACONSUM.NS|Tata Consumer Products|FMCG|Tata
APOLLOHOSP.NS|Apollo Hospitals|Healthcare|
INDUSINDBK.NS|IndusInd Bank|Banking|
TECHM.NS|Tech Mahindra|IT|
LTIM.NS|LTIMindtree|IT|
UPL.NS|UPL|Chemicals|
"""


def companies() -> list[tuple[str, str, str | None, str | None]]:
    rows = [line.split("|") for line in COMPANIES.strip().split("\n")]
    return [(t, n, s or None, g or None) for t, n, s, g in rows]


def universe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(companies(), SCHEMA)


def names(universe: DataFrame) -> DataFrame:
    """(ticker, name) for entity resolution."""
    return universe.select("ticker", "name")
