"""Classification expressions: maturity, forward moneyness, delta moneyness.

Each is one CASE expression; NULL inputs fall through to the 'nan' label,
exactly like an unmatched branch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DELTA_HIGH, DELTA_LOW, FK_HIGH, FK_LOW, UNCLASSIFIED
from .numeric import col


def maturity_bucket(dtm="dtm") -> Column:
    """Days to maturity: 0; (0,7]; (7,30]; (30,90]; (90,120]; >120; else 'nan'."""
    d = col(dtm)
    return (
        F.when(d == 0, "0_days")
        .when((d > 0) & (d <= 7), "1_7_days")
        .when((d > 7) & (d <= 30), "7_30_days")
        .when((d > 30) & (d <= 90), "30_90_days")
        .when((d > 90) & (d <= 120), "90_120_days")
        .when(d > 120, "120_days")
        .otherwise(UNCLASSIFIED)
    )


def forward_moneyness(f_k="f_k", cp_flag="cp_flag") -> Column:
    """Moneyness from forward/strike on the unrounded ratio.

    atm iff FK_LOW < f < FK_HIGH (either flag); below the band puts are itm and
    calls otm; above it the reverse.
    """
    f, cp = col(f_k), col(cp_flag)
    return (
        F.when((f > FK_LOW) & (f < FK_HIGH), "atm")
        .when((f <= FK_LOW) & (cp == "P"), "itm")
        .when((f <= FK_LOW) & (cp == "C"), "otm")
        .when((f >= FK_HIGH) & (cp == "P"), "otm")
        .when((f >= FK_HIGH) & (cp == "C"), "itm")
        .otherwise(UNCLASSIFIED)
    )


def delta_moneyness(delta="delta", cp_flag="cp_flag") -> Column:
    """Moneyness from delta in percent; branch order matters.

    Any flag with 45 < delta < 55 is atm; a call with delta in (-55, -45) is
    otm because the call branches come first.
    """
    d, cp = col(delta), col(cp_flag)
    return (
        F.when((d > DELTA_LOW) & (d < DELTA_HIGH), "atm")
        .when((d >= DELTA_HIGH) & (cp == "C"), "itm")
        .when((d <= DELTA_LOW) & (cp == "C"), "otm")
        .when((d > -DELTA_HIGH) & (d < -DELTA_LOW), "atm")
        .when((d <= -DELTA_HIGH) & (cp == "P"), "itm")
        .when((d >= -DELTA_LOW) & (cp == "P"), "otm")
        .otherwise(UNCLASSIFIED)
    )
