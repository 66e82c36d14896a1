"""String Column helpers.  All are native expressions (codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes: ASCII whitespace, the
# information separators 0x1C-0x1F, NEL, NBSP and the Unicode spaces.
_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TRIM_RE = rf"^{_WS}+|{_WS}+$"
# A cased letter (upper, lower, title case) — what str.title() keys on.
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_RUNS_RE = rf"([{_CASED}]+|[^{_CASED}]+)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Trim all leading/trailing whitespace (``trim`` only drops spaces)."""
    return F.regexp_replace(_c(x), _TRIM_RE, "")


def title_case(x) -> Column:
    """Title-case each run of cased letters: first upper, rest lower.

    ``us-EAST o'neil p2p 3d`` -> ``Us-East O'Neil P2P 3D``; plain
    ``initcap`` only splits on spaces.
    """
    runs = F.regexp_extract_all(_c(x), F.lit(_RUNS_RE), 1)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def normalize_label(x, null_label: str) -> Column:
    """strip + title-case; a missing value becomes ``null_label``."""
    return F.coalesce(title_case(strip_ws(x)), F.lit(null_label))


def null_if_token(x, tokens) -> Column:
    """Missing-value tokens (``NA``, ``null``, empty …) become NULL."""
    c = _c(x)
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def fixed2(x) -> Column:
    """``'{:.2f}'.format(x)``: round the exact binary value, ties to even.

    ``format_string('%.2f')`` rounds the shortest decimal text half-up
    (2.675 -> 2.68 where the binary value 2.67499… gives 2.67).  Here the
    candidate c = floor(|x|*100) is checked against the midpoint
    (2c+1)/200 exactly: |x|*200 = (|x|*8)*25 is split into p + e with
    Dekker's error-free product, so the comparison has no rounding error.
    """
    v = _c(x).cast("double")
    ax = F.abs(v)
    a8 = ax * F.lit(8.0)                       # exact (power of two)
    t = a8 * F.lit(134217729.0)                # 2^27 + 1 splitter
    hi = t - (t - a8)
    lo = a8 - hi
    p = a8 * F.lit(25.0)
    e = (hi * F.lit(25.0) - p) + lo * F.lit(25.0)   # a8*25 == p + e exactly
    c = F.floor(ax * F.lit(100.0)).cast("double")
    diff = (p - (c * F.lit(2.0) + F.lit(1.0))) + e
    n = (
        F.when(diff > 0, c + 1)
        .when(diff < 0, c)
        .when(F.pmod(c, F.lit(2.0)) == 0, c)
        .otherwise(c + 1)
    ).cast("long")
    body = F.concat(
        (n / 100).cast("long").cast("string"), F.lit("."),
        F.lpad((n % 100).cast("string"), 2, "0"),
    )
    # Python keeps the sign of negative zero ('-0.00').
    negative = (v < 0) | ((v == 0) & v.cast("string").startswith("-"))
    signed = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), body)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(v), F.lit("nan"))
        .when(v == F.lit(float("inf")), F.lit("inf"))
        .when(v == F.lit(float("-inf")), F.lit("-inf"))
        .when(ax < F.lit(1e13), signed)
        .otherwise(F.format_string("%.2f", v))
    )


def float_text(x) -> Column:
    """Python ``str(float)`` for the usual range: ``99000.0``, ``12345678.0``.

    ``cast(double as string)`` gives ``1.2345678E7``.  Whole numbers below
    1e16 print as integer + ``.0``; other finite values in [1e-4, 1e16)
    print positionally from the shortest digits.
    """
    v = _c(x).cast("double")
    ax = F.abs(v)
    whole = F.concat(v.cast("long").cast("string"), F.lit(".0"))
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(v), F.lit("nan"))
        .when(v == F.lit(float("inf")), F.lit("inf"))
        .when(v == F.lit(float("-inf")), F.lit("-inf"))
        .when((ax < F.lit(1e16)) & (v == F.floor(v).cast("double")), whole)
        .when((ax >= F.lit(1e-4)) & (ax < F.lit(1e16)),
              F.call_function("format_number", v, F.lit("0.0" + "#" * 24)))
        .otherwise(F.lower(v.cast("string")))
    )
