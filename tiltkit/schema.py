"""Schemas and closed domains of the option-volume data model.

Everything here is a plain constant. Names that the analysis depends on
(input column names, class labels, bucket labels, display orders, default
cut-offs) are fixed values of the study being reproduced and must not change.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values (must equal the study's labels and column names exactly).
# --------------------------------------------------------------------------

# Investor classes in the order the study lists them, with the raw buy/sell
# open-volume columns of the monthly option file that feed each class.
CLASS_SOURCES: dict[str, tuple[str, str]] = {
    "customer": ("customer_open_buy_volume", "customer_open_sell_volume"),
    "customer_100": ("customer_open_buy_volume_100", "customer_open_sell_volume_100"),
    "customer_100_199": ("customer_open_buy_volume_100_199", "customer_open_sell_volume_100_199"),
    "customer_199": ("customer_open_buy_volume_199", "customer_open_sell_volume_199"),
    "professional": ("professional_customer_open_buy_volume", "professional_customer_open_sell_volume"),
    "firm": ("firm_open_buy_volume", "firm_open_sell_volume"),
}

# Maturity buckets in display order; anything else is the string 'nan'.
MATURITIES = ("0_days", "1_7_days", "7_30_days", "30_90_days", "90_120_days", "120_days")
# Moneyness classes in display order; anything else is the string 'nan'.
MONEYNESS = ("itm", "otm", "atm")
UNCLASSIFIED = "nan"

# Forward-moneyness band (f = forward / strike): atm strictly inside.
FK_LOW, FK_HIGH = 0.975, 1.025
# Delta-moneyness band, delta in percent: atm strictly inside (45, 55).
DELTA_LOW, DELTA_HIGH = 45.0, 55.0

# Classes shown in the distribution / year / maturity tables.
TABLE_CLASSES = ("customer_100", "customer_100_199", "customer_199", "professional", "firm")
# Classes used in the discontinuity study and their default cut-offs (log price).
RDD_CLASSES = ("customer_100", "professional", "firm")
RDD_CUTOFFS = {"customer_100": 6.3, "professional": 6.3, "firm": 6.7}
RDD_PRICE_GRID = (3.0, 7.0, 100)      # linspace(3, 7, 100)
RDD_MCAP_GRID = (3.0, 7.0, 61)        # linspace(3, 7, 61)
RDD_MCAP_CUTOFF = 6.3
SHORT_MATURITIES = ("0_days", "1_7_days")
MAX_PRICE = 100000.0
FITTED_POINTS = 400
DEFAULT_GRID_POINTS = 101

# Quantiles of the distribution tables and their row labels.
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
QUANTILE_LABELS = ("5th", "25th", "Median", "75th", "95th")

# Contract multiplier applied to volumes in the distribution tables.
CONTRACT_MULTIPLIER = 100.0

# Regression terms and the comparison-table order.
TERMS = ("Intercept", "Z", "Xc", "Z:Xc")
TERM_ORDER = ("Z", "Xc", "Z:Xc", "Intercept")
# Two-sided normal critical values for p < .01, .05, .10.
Z_CRIT = ((2.5758293035489004, "***"), (1.959963984540054, "**"), (1.6448536269514722, "*"))

# Display labels.
PANEL_TITLES = {"C": "A. Call Options", "P": "B. Put Options"}

# --------------------------------------------------------------------------
# Derived names.
# --------------------------------------------------------------------------

CLASSES = tuple(CLASS_SOURCES)


def trade_col(cls: str) -> str:
    return f"{cls}_trade_volume"


def dollar_col(cls: str) -> str:
    return f"{cls}_dollar_trade_volume"


# The twelve measures of the yearly panel, in the study's order.
MEASURES = tuple(m for c in CLASSES for m in (trade_col(c), dollar_col(c)))
RAW_VOLUME_COLS = tuple(col for pair in CLASS_SOURCES.values() for col in pair)

PANEL_KEYS = ("date", "ticker", "f_k", "f_k_moneyness", "maturity", "cp_flag",
              "impl_volatility", "delta")

OPTION_MONTH = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("cp_flag", T.StringType()),
        T.StructField("dtm", T.IntegerType()),
        T.StructField("forward_price", T.DoubleType()),
        T.StructField("strike_price", T.DoubleType()),
        T.StructField("impl_volatility", T.DoubleType()),
        T.StructField("delta", T.DoubleType()),
        T.StructField("best_bid", T.DoubleType()),
        T.StructField("best_offer", T.DoubleType()),
    ]
    + [T.StructField(c, T.DoubleType()) for c in RAW_VOLUME_COLS]
)

OPEN_VOLUME = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("f_k", T.DoubleType()),
        T.StructField("f_k_moneyness", T.StringType()),
        T.StructField("maturity", T.StringType()),
        T.StructField("cp_flag", T.StringType()),
        T.StructField("impl_volatility", T.DoubleType()),
        T.StructField("delta", T.DoubleType()),
    ]
    + [T.StructField(m, T.DoubleType()) for m in MEASURES]
)

STOCK_DAILY = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("comnam", T.StringType()),
        T.StructField("prc", T.DoubleType()),
        T.StructField("shrout", T.DoubleType()),
    ]
)


def check_columns(df, schema: T.StructType, what: str) -> None:
    """Fail early when a frame lacks a column of the declared schema."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
