"""Numbers, money and measures as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .text import clean_text, fold_for_compare, let

DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"
# Fixed values, in order: token, currency, unit, whether it must stand as a word.
CURRENCIES = (
    ("تومان", "IRR", "toman", False), ("تومن", "IRR", "toman", False), ("toman", "IRR", "toman", True), ("tomaan", "IRR", "toman", True), ("irt", "IRR", "toman", True),
    ("ریال", "IRR", "rial", False), ("﷼", "IRR", "rial", False), ("rial", "IRR", "rial", True), ("irr", "IRR", None, True),
    ("$", "USD", None, False), ("usd", "USD", None, True), ("€", "EUR", None, False), ("eur", "EUR", None, True), ("£", "GBP", None, False), ("gbp", "GBP", None, True),
    ("₺", "TRY", None, False), ("try", "TRY", None, True), ("₽", "RUB", None, False), ("₹", "INR", None, False), ("aed", "AED", None, True), ("sar", "SAR", None, True),
)
GRAMS = {"g": 1.0, "kg": 1000.0, "lbs": 453.59237, "oz": 28.349523125}
MILLIMETRES = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4, "yd": 914.4}


def to_ascii_digits(c: Column) -> Column:
    return F.translate(c, *DIGITS)


def parse_number(c: Column, ambiguous: str = "grouping") -> Column:
    """struct(value, ambiguous) of the first number in a text; a null value if there is none.

    Of two kinds of separators the right-most is the decimal one; a repeated one groups; a lone one before exactly three
    digits, behind one to three that don't start with 0, is read as `ambiguous` says, and marked.
    """
    s = F.translate(to_ascii_digits(clean_text(c)), "٫٬،", ".,,")
    s = F.regexp_replace(s, "(?<=\\d)[\\s'’](?=\\d)", ",")
    tok = F.regexp_replace(F.regexp_extract(s, r"-?\d[\d.,]*|-?[.,]\d+", 0), "[.,]+$", "")

    def read(tok: Column) -> Column:
        without = lambda x: F.replace(tok, F.lit(x), F.lit(""))
        point = F.replace(tok, F.lit(","), F.lit("."))
        dots, commas = F.length(tok) - F.length(without(".")), F.length(tok) - F.length(without(","))
        last_dot = F.locate(".", F.reverse(tok)) < F.locate(",", F.reverse(tok))
        lone = ((dots + commas) == 1) & tok.rlike(r"^-?(?!0[.,])\d{1,3}[.,]\d{3}$")
        text = (
            F.when(tok.isin("", "-"), None)
            .when((dots > 0) & (commas > 0), F.when(last_dot, without(",")).otherwise(F.replace(without("."), F.lit(","), F.lit("."))))
            .when((dots > 1) | (commas > 1), F.translate(tok, ".,", ""))
            .when(lone, F.translate(tok, ".,", "") if ambiguous == "grouping" else point)
            .otherwise(point)
        )
        return F.struct(text.try_cast("double").alias("value"), F.coalesce(lone, F.lit(False)).alias("ambiguous"))

    return let(tok, read)


def round_to(c: Column, places: int = 6) -> Column:
    """Half up on the double as it is. From 2**53 / 10**places on, the scaled double has no fraction left to round."""
    return F.when(F.abs(c) < 2.0**53 / 10**places, F.floor(c * 10**places + 0.5) / 10**places).otherwise(c)


def format_decimal(c: Column, places: int = 6) -> Column:
    """No exponent, no zeros at the end; empty for null and what isn't finite. Whole numbers beyond 38 digits are left as the
    double's own text."""
    rounded = round_to(c, places)
    exact = rounded.try_cast(f"decimal(38,{places})").cast("string")
    exact = F.rtrim(F.rtrim(exact, F.lit("0")), F.lit(".")) if places else exact  # has a point, then
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "").otherwise(F.when(F.abs(rounded) < 1e30, exact).otherwise(rounded.cast("string")))


def detect_currency(c: Column) -> Column:
    """struct(currency, unit): the first token in order; a unit only from a word for it."""

    def first(folded: Column) -> Column:
        hit = F
        for token, currency, unit, word in CURRENCIES:
            ok = F.contains(folded, F.lit(token))
            ok = ok & folded.rlike(rf"(?<![\p{{L}}\p{{N}}]){token}(?![\p{{L}}\p{{N}}])") if word else ok
            hit = hit.when(ok, F.struct(F.lit(currency).alias("currency"), F.lit(unit).cast("string").alias("unit")))
        return hit.otherwise(F.lit(None).cast("struct<currency:string,unit:string>"))

    return let(fold_for_compare(c), first)


def parse_money(c: Column, default_currency: str | Column | None = None, default_unit: str | None = None, ambiguous: str = "grouping") -> Column:
    """struct(amount, currency, unit, ambiguous, unit_stated), null where the text has no number; without a currency it is empty. The
    default unit is for IRR without one. Each step is computed once."""

    def read(s: Column) -> Column:
        n, d = s["n"], s["d"]
        currency = F.coalesce(d["currency"], default_currency if isinstance(default_currency, Column) else F.lit(default_currency), F.lit(""))
        unit = F.coalesce(d["unit"], F.when(currency.isin("IRR", "IRT"), F.lit(default_unit)))
        return F.when(n["value"].isNotNull(), F.struct(n["value"].alias("amount"), currency.alias("currency"), unit.alias("unit"), n["ambiguous"].alias("ambiguous"), d["unit"].isNotNull().alias("unit_stated")))

    return let(F.struct(parse_number(c, ambiguous).alias("n"), detect_currency(c).alias("d")), read)


def convert_currency_unit(amount: Column, currency: Column, unit: Column, target: str) -> Column:
    """Toman and rial into each other; everything else unchanged."""
    factor = F.when(unit == target, 1.0).when(F.lit(target) == "rial", 10.0).otherwise(0.1)
    return F.when(currency.isin("IRR", "IRT") & unit.isNotNull(), round_to(amount * factor)).otherwise(amount)


def _convert(value: Column, unit: Column, target: str, table: dict[str, float]) -> Column:
    factors = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return round_to(value * F.try_element_at(factors, unit) / table[target])


def convert_weight(value: Column, unit: Column, target: str = "kg") -> Column:
    """Null for a unit that isn't known."""
    return _convert(value, unit, target, GRAMS)


def convert_dimension(value: Column, unit: Column, target: str = "cm") -> Column:
    return _convert(value, unit, target, MILLIMETRES)


# Codes and words for units.
UNIT_CODES = {"GRM": "g", "KGM": "kg", "LBR": "lbs", "ONZ": "oz", "MMT": "mm", "CMT": "cm", "MTR": "m", "INH": "in", "YRD": "yd"}
UNIT_WORDS = {
    "g": "g", "gr": "g", "gm": "g", "gram": "g", "grams": "g", "gramme": "g", "grammes": "g", "گرم": "g",
    "kg": "kg", "kgs": "kg", "kilo": "kg", "kilos": "kg", "kilogram": "kg", "kilograms": "kg", "کیلو": "kg", "کیلوگرم": "kg",
    "lb": "lbs", "lbs": "lbs", "pound": "lbs", "pounds": "lbs", "oz": "oz", "ounce": "oz", "ounces": "oz",
    "mm": "mm", "millimeter": "mm", "millimetre": "mm", "millimeters": "mm", "millimetres": "mm", "میلیمتر": "mm",
    "cm": "cm", "centimeter": "cm", "centimetre": "cm", "centimeters": "cm", "centimetres": "cm", "سانتیمتر": "cm", "سانت": "cm",
    "m": "m", "meter": "m", "metre": "m", "meters": "m", "metres": "m", "متر": "m",
    "in": "in", "inch": "in", "inches": "in", '"': "in", "yd": "yd", "yard": "yd", "yards": "yd",
}


def _named(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in table.items()))), c)


def read_unit(text: Column, code: Column | None = None, unit_text: Column | None = None) -> Column:
    """A unit by its code, else by the word at the end of unit_text, else of the text itself; null if none is known."""
    word = lambda c: _named(UNIT_WORDS, fold_for_compare(F.regexp_extract(c, r'([\p{L}"]+)\.?\s*$', 1)))
    found = [] if code is None else [_named(UNIT_CODES, F.upper(F.trim(code)))]
    return F.coalesce(*found, *([] if unit_text is None else [word(unit_text)]), word(text))


def read_measure(c: Column, code: Column | None = None, unit_text: Column | None = None) -> Column:
    """struct(value, unit) of a text such as `1.5 kg`, or of a number with a unit code or text beside it; null without a unit
    that is known. A lone separator is decimal."""
    unit, n = read_unit(c, code, unit_text), parse_number(c, "decimal")["value"]
    return F.when(n.isNotNull() & unit.isNotNull(), F.struct(n.alias("value"), unit.alias("unit")))


def minor_unit_money(c: Column, minor_unit: Column, currency: Column, prefix: Column, suffix: Column) -> Column:
    """struct(amount, currency, unit) of an integer string in minor units; the unit from what stands around prices."""
    unit = detect_currency(F.concat_ws(" ", prefix, suffix))["unit"]
    amount = minor_unit_price(c, minor_unit)
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), currency.alias("currency"), F.when(currency.isin("IRR", "IRT"), unit).alias("unit")))


def minor_unit_price(c: Column, minor_unit: Column) -> Column:
    """An integer string in minor units as a price; null for an empty one."""
    return round_to(F.when(F.trim(c).rlike(r"^-?\d+$"), F.trim(c)).try_cast("double") / F.pow(F.lit(10.0), F.coalesce(minor_unit, F.lit(2))))


# Availability words.
IN_STOCK = ("instock", "instoreonly", "onlineonly", "limitedavailability", "presale", "preorder", "backorder", "available", "availablefororder")
OUT_OF_STOCK = ("outofstock", "oos", "soldout", "discontinued")


def availability(c: Column) -> Column:
    from .text import normalize_type

    w = F.regexp_replace(normalize_type(c), r"[\s_-]", "")
    return F.when(w.isin(*IN_STOCK), True).when(w.isin(*OUT_OF_STOCK), False)
