"""Pay text to (kind, low, high, monthly minimum), all in the JVM but for texts that NFKC changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import nfkc

# --- fixed values: pay kinds, number token, monthly factors -----------------------------------
PAY_KIND = r"(月薪|年薪|時薪|日薪|論件計酬|面議|待遇面議)"
PAY_NUMBER = r"([\d,]{3,})"
NEGOTIABLE = ("面議", "待遇面議")
MONTHLY_FACTOR = {"月薪": 1.0, "年薪": 1 / 12, "時薪": 176.0, "日薪": 22.0}
SMALLEST_AMOUNT = 100


def parse_pay(text: Column) -> Column:
    """Struct ``(kind, lo, hi, month_min)``; see the tests for the literal cases."""
    present = text.isNotNull() & text.rlike(r"(?U)\S")
    clean = nfkc(F.when(present, text))
    found = F.regexp_extract(clean, PAY_KIND, 1)
    negotiable = found.isin(*NEGOTIABLE)
    kind = F.when(negotiable, F.lit(NEGOTIABLE[0])).when(found != "", found)
    amounts = F.filter(
        F.transform(
            F.regexp_extract_all(clean, F.lit("(?U)" + PAY_NUMBER), F.lit(1)),
            lambda token: F.replace(token, F.lit(","), F.lit("")).try_cast("double")),
        lambda amount: amount >= SMALLEST_AMOUNT)
    usable = F.when(~negotiable & (F.size(amounts) > 0), amounts)
    lo = F.array_min(usable)
    hi = F.when(F.size(usable) > 1, F.array_max(usable))
    factor = F.lit(None).cast("double")
    for name, value in MONTHLY_FACTOR.items():
        factor = F.when(found == name, F.lit(value)).otherwise(factor)
    return F.struct(kind.alias("kind"), lo.alias("lo"), hi.alias("hi"), F.bround(lo * factor).alias("month_min"))
