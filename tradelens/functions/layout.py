"""S4-S6 column helpers: display headers, value rendering, rendered text width.

The source sizes every output column to the widest rendered cell, header
included: 220 base units plus a per-character width of the Arial 10 font,
unknown characters counted as the width of ``'0'``, never less than 700. The
widths here are expressions, so a column profile is one distributed
aggregation instead of a pass over the cells on one machine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

# Arial 10 character widths used for column sizing, in the
# order the font table lists them (digits, lower case, upper case,
# punctuation). Units are 1/256 of the width of '0' in BIFF terms.
CHAR_WIDTHS = (
    ("0", 262.637), ("1", 262.637), ("2", 262.637), ("3", 262.637), ("4", 262.637),
    ("5", 262.637), ("6", 262.637), ("7", 262.637), ("8", 262.637), ("9", 262.637),
    ("a", 262.637), ("b", 262.637), ("c", 262.637), ("d", 262.637), ("e", 262.637),
    ("f", 146.015), ("g", 262.637), ("h", 262.637), ("i", 117.096), ("j", 88.178),
    ("k", 233.244), ("l", 88.178), ("m", 379.259), ("n", 262.637), ("o", 262.637),
    ("p", 262.637), ("q", 262.637), ("r", 175.407), ("s", 233.244), ("t", 117.096),
    ("u", 262.637), ("v", 203.852), ("w", 321.422), ("x", 203.852), ("y", 262.637),
    ("z", 233.244),
    ("A", 321.422), ("B", 321.422), ("C", 350.341), ("D", 350.341), ("E", 321.422),
    ("F", 291.556), ("G", 350.341), ("H", 321.422), ("I", 146.015), ("J", 262.637),
    ("K", 321.422), ("L", 262.637), ("M", 379.259), ("N", 321.422), ("O", 350.341),
    ("P", 321.422), ("Q", 350.341), ("R", 321.422), ("S", 321.422), ("T", 262.637),
    ("U", 321.422), ("V", 321.422), ("W", 496.356), ("X", 321.422), ("Y", 321.422),
    ("Z", 262.637),
    (" ", 146.015), ("!", 146.015), ('"', 175.407), ("#", 262.637), ("$", 262.637),
    ("%", 438.044), ("&", 321.422), ("'", 88.178), ("(", 175.407), (")", 175.407),
    ("*", 203.852), ("+", 291.556), (",", 146.015), ("-", 175.407), (".", 146.015),
    ("/", 146.015), (":", 146.015), (";", 146.015), ("<", 291.556), ("=", 291.556),
    (">", 291.556), ("?", 262.637), ("@", 496.356), ("[", 146.015), ("\\", 146.015),
    ("]", 146.015), ("^", 203.852), ("_", 262.637), ("`", 175.407), ("{", 175.407),
    ("|", 146.015), ("}", 175.407), ("~", 291.556),
)
BASE_UNITS = 220
MIN_UNITS = 700
DEFAULT_CHAR_WIDTH = 262.637  # an unknown character counts as '0'

_SUFFIX = re.compile(r"_\d+$")


def display_name(column: str) -> str:
    """Display name of a physical column: block suffix dropped, labels unnamed."""
    if column.startswith(("qty_label", "amt_label")):
        return ""
    return _SUFFIX.sub("", column)


def display_header(column: str) -> str:
    """Header text as shown: the display name title-cased (Python rules)."""
    return display_name(column).title()


_THOUSANDTHS = 1000


def _characters_by_width() -> dict[int, str]:
    """Width in thousandths of a unit -> all characters of that width."""
    out: dict[int, str] = {}
    for ch, width in CHAR_WIDTHS:
        key = round(width * _THOUSANDTHS)
        out[key] = out.get(key, "") + ch
    return out


def text_width(text: Column) -> Column:
    """Rendered width of ``text``: characters are counted by width (13 groups), in exact thousandths."""
    total = F.lit(BASE_UNITS * _THOUSANDTHS).cast("long")
    default = round(DEFAULT_CHAR_WIDTH * _THOUSANDTHS)
    total = total + F.length(text) * F.lit(default)
    for width, chars in _characters_by_width().items():
        if width != default:
            total = total + (F.length(text) - F.length(F.translate(text, chars, ""))) * F.lit(width - default)
    return total / F.lit(float(_THOUSANDTHS))


def python_text(col: Column, dtype: T.DataType) -> Column:
    """The value as Python's ``str`` would print it; NULL prints as ``None``.

    Doubles print positionally from 0.0001 to below 1e16 and with an exponent of
    two digits or more elsewhere; half seconds print with six digits. Other
    types print as Spark casts them to text, which agrees with Python.
    """
    s = col.cast("string")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        s = _python_double(col.cast("double"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        s = F.when(F.instr(s, ".") > 0, F.rpad(s, 26, "0")).otherwise(s)
    return F.coalesce(s, F.lit("None"))


def _python_double(value: Column) -> Column:
    text = value.cast("string")  # 12.5, 1.25E-5, NaN, Infinity
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_extract(text, r"^-?([0-9.]+)E", 1)
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0+$", "")
    whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
    rest = F.substring(digits, exponent + 2, F.length(digits))
    positional = F.when(exponent >= 0, F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest)))
    positional = positional.otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
    tail = F.substring(digits, F.lit(2), F.length(digits))
    power = F.abs(exponent).cast("string")
    power = F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power)
    scientific = F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""),
                          F.lit("e"), F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")), power)
    return (F.when(F.isnan(value), F.lit("nan"))
            .when(text.endswith("Infinity"), F.concat(sign, F.lit("inf")))
            .when(exponent.isNull(), text)
            .otherwise(F.concat(sign, F.when(exponent.between(-4, 15), positional).otherwise(scientific))))
