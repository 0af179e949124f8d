"""Number-to-text the way JavaScript ``String(x)`` prints it.

Spark's text of a double holds the shortest digits that read back as the same
number, either plain (``0.05``) or with an exponent (``5.0E-4``).  JavaScript
prints the same digits plainly from 1e-6 up to 1e21 and with an exponent
(``1e-7``, ``1.5e+21``) beyond.  (Java before version 19 writes a digit too
many for a few doubles, the smallest ones among them; those differ.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_number_text(col: Column) -> Column:
    """JS text of a double column; NULL, NaN and infinities give NULL.

    Between 1e-3 and 1e7 the text is Spark's own without a trailing ``.0``.  The
    digits of an exponent are moved by a lambda, whose code is not generated
    anew for every column, so that wide structs stay within a method's 64 KB.
    """
    x = col.cast("double")
    text = F.abs(x).cast("string")
    usual = F.regexp_replace(text, r"\.0$", "")
    moved = F.get(F.transform(F.array(text), _without_exponent), F.lit(0))
    out = F.when(text.contains("E"), moved).otherwise(usual)
    out = F.when(x < 0, F.concat(F.lit("-"), out)).otherwise(out)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(out)


def _without_exponent(text: Column) -> Column:
    """JS text of a positive number's text ``d.dddE[-]n``."""
    pattern = r"^(\d+)\.(\d+)E(-?\d+)$"
    whole, part = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    power = F.regexp_extract(text, pattern, 3).try_cast("int")
    frac = F.regexp_replace(part, "0+$", "")
    digits = F.concat(whole, frac)
    at = F.length(whole) + power                      # places before the decimal point
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    small = F.concat(F.lit("0."), zeros(-at), F.regexp_replace(digits, "^0+", ""))
    large = F.concat(digits, zeros(at - F.length(digits)))
    middle = F.concat(F.substring(digits, F.lit(1), at), F.lit("."), F.substring(digits, at + 1, F.length(digits)))
    plain = F.when(at <= 0, small).when(F.length(digits) <= at, large).otherwise(middle)
    scientific = F.concat(whole, F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)), F.lit("e"),
                          F.when(power > 0, "+").otherwise(""), power.cast("string"))
    return F.when((power >= -6) & (power < 21), plain).otherwise(scientific)
