"""Sums, units and money: the driver reads a question, columns are converted by joins with small tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Currencies by their number of decimals where it is not 2, and the countries of the euro.
NO_DECIMALS = ["BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "PYG", "RWF", "UGX", "UYI", "VND", "VUV", "XAF", "XOF", "XPF"]
THREE_DECIMALS = ["BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND"]
EURO = ["AD", "AT", "BE", "BG", "CY", "DE", "EE", "ES", "FI", "FR", "GR", "HR", "IE", "IT", "LT", "LU", "LV", "MC", "ME", "MT", "NL", "PT", "SI", "SK", "SM", "VA", "XK"]
# Units as (dimension, factor to its first unit); prefixes that units of the SI take.
SI = {"m": ("length", 1.0), "g": ("mass", 1e-3), "l": ("volume", 1e-3), "s": ("time", 1.0), "w": ("power", 1.0), "j": ("energy", 1.0), "pa": ("pressure", 1.0), "hz": ("frequency", 1.0), "v": ("voltage", 1.0), "a": ("current", 1.0)}
SI_NAMES = {"meter": "m", "metre": "m", "gram": "g", "liter": "l", "litre": "l", "second": "s", "watt": "w", "joule": "j", "pascal": "pa", "hertz": "hz", "volt": "v", "ampere": "a"}
PREFIXES = {"": ("", 1.0), "k": ("kilo", 1e3), "c": ("centi", 1e-2), "m": ("milli", 1e-3), "u": ("micro", 1e-6), "n": ("nano", 1e-9), "M": ("mega", 1e6), "G": ("giga", 1e9), "T": ("tera", 1e12)}
OTHERS = {
    "inch": ("length", 0.0254), "in": ("length", 0.0254), "foot": ("length", 0.3048), "feet": ("length", 0.3048), "ft": ("length", 0.3048), "yard": ("length", 0.9144), "yd": ("length", 0.9144), "mile": ("length", 1609.344), "mi": ("length", 1609.344), "nautical mile": ("length", 1852.0),
    "pound": ("mass", 0.45359237), "lb": ("mass", 0.45359237), "lbs": ("mass", 0.45359237), "ounce": ("mass", 0.028349523125), "oz": ("mass", 0.028349523125), "stone": ("mass", 6.35029318), "tonne": ("mass", 1e3), "ton": ("mass", 907.18474),
    "gallon": ("volume", 0.003785411784), "quart": ("volume", 0.000946352946), "pint": ("volume", 0.000473176473), "cup": ("volume", 0.0002365882365), "tablespoon": ("volume", 0.00001478676478125), "teaspoon": ("volume", 0.00000492892159375),
    "minute": ("time", 60.0), "min": ("time", 60.0), "hour": ("time", 3600.0), "h": ("time", 3600.0), "day": ("time", 86400.0), "week": ("time", 604800.0), "year": ("time", 31557600.0),
    "kmh": ("speed", 1 / 3.6), "km/h": ("speed", 1 / 3.6), "mph": ("speed", 0.44704), "m/s": ("speed", 1.0), "knot": ("speed", 1852 / 3600),
    "cal": ("energy", 4.184), "kcal": ("energy", 4184.0), "kwh": ("energy", 3.6e6), "bar": ("pressure", 1e5), "psi": ("pressure", 6894.757293168361), "atm": ("pressure", 101325.0),
    "acre": ("area", 4046.8564224), "hectare": ("area", 1e4), "ha": ("area", 1e4), "m2": ("area", 1.0), "km2": ("area", 1e6), "ft2": ("area", 0.09290304), "degree": ("angle", 0.017453292519943295), "radian": ("angle", 1.0),
    "bit": ("data", 0.125), "byte": ("data", 1.0), "b": ("data", 1.0), "kb": ("data", 1e3), "mb": ("data", 1e6), "gb": ("data", 1e9), "tb": ("data", 1e12), "kib": ("data", 1024.0), "mib": ("data", 1024.0**2), "gib": ("data", 1024.0**3), "tib": ("data", 1024.0**4),
}
#: Degrees: (name, factor and offset to kelvin).
DEGREES = {"k": (1.0, 0.0), "kelvin": (1.0, 0.0), "c": (1.0, 273.15), "celsius": (1.0, 273.15), "f": (5 / 9, 459.67 * 5 / 9), "fahrenheit": (5 / 9, 459.67 * 5 / 9)}
UNIT_COLUMNS = "unit string, dimension string, factor double, shift double"


def unit_of(name: str) -> tuple[str, float, float] | None:
    """(dimension, factor, offset) of a unit by its name or sign, singular or plural."""
    bare, low = name.strip().lstrip("°"), name.strip().lstrip("°").lower()
    if low in DEGREES:
        return "temperature", *DEGREES[low]
    for word in (low, low.removesuffix("s"), low.removesuffix("es")):
        if word in OTHERS:
            return *OTHERS[word], 0.0
        for long, sign in SI_NAMES.items():
            if word.endswith(long) and (prefix := next((f for p, f in PREFIXES.values() if p == word[: -len(long)]), None)):
                return SI[sign][0], SI[sign][1] * prefix, 0.0
    for sign, (dimension, factor) in SI.items():
        for p, (_, f) in PREFIXES.items():
            if bare in (p + sign, p + sign.upper()) or (len(bare) > 1 and p and p.islower() and low == p + sign):
                return dimension, factor * f, 0.0
    return None


def units(spark: SparkSession) -> DataFrame:
    """The units by sign and name, some hundred rows."""
    names = [*DEGREES, *OTHERS, *(p + s for s in SI for p in PREFIXES), *(p + n for n in SI_NAMES for p, _ in PREFIXES.values())]
    return spark.createDataFrame([(n, *u) for n in dict.fromkeys(names) if (u := unit_of(n))], UNIT_COLUMNS)


def converted(amounts: DataFrame, table: DataFrame) -> DataFrame:
    """``amounts`` (amount, source, target, ...) with ``result``; null where the units are unknown or measure
    other things. The table of units is small and fixed."""
    side = lambda x: F.broadcast(table.toDF(x, *(f"_{x}_{c}" for c in ("dimension", "factor", "shift"))))
    both = amounts.join(side("source"), "source", "left").join(side("target"), "target", "left")
    value = (F.col("amount") * F.col("_source_factor") + F.col("_source_shift") - F.col("_target_shift")) / F.col("_target_factor")
    result = F.when(F.col("_source_dimension") == F.col("_target_dimension"), value)
    return both.select(*amounts.columns, result.alias("result"))


def decimals(code: Column) -> Column:
    """How many decimals amounts of a currency have."""
    return F.when(code.isin(NO_DECIMALS), 0).when(code.isin(THREE_DECIMALS), 3).otherwise(2)


def decimals_of(code: str) -> int:
    return 0 if code in NO_DECIMALS else 3 if code in THREE_DECIMALS else 2


def exchanged(amounts: DataFrame, rates: DataFrame) -> DataFrame:
    """``amounts`` (amount, source, target, ...) with ``result`` in the target's decimals, through the dollar;
    null without a rate. ``rates`` is (code, rate per dollar): a row a currency, some 200."""
    side = lambda x: F.broadcast(rates.select(F.col("code").alias(x), F.col("rate").alias(f"_{x}")))
    both = amounts.join(side("source"), "source", "left").join(side("target"), "target", "left")
    raw = F.col("amount") / F.col("_source") * F.col("_target")
    n = decimals(F.col("target"))
    return both.select(*amounts.columns.copy(), F.when(n == 0, F.round(raw, 0)).when(n == 3, F.round(raw, 3)).otherwise(F.round(raw, 2)).alias("result"))


def home_currency(locale: str | None, codes: list[str]) -> str:
    """The currency of the country that a locale names, by the rule that codes begin with their country's;
    the dollar if it names none. ``codes`` are those that have a rate."""
    parts = re.split("[-_]", re.split("[.@]", locale or "")[0])[1:]
    country = next((p for p in parts if re.fullmatch("[A-Z]{2}", p)), None)
    if country in EURO:
        return "EUR"
    return next((c for c in sorted(codes) if country and c[:2] == country), "USD")


def names_a_target(query: str) -> bool:
    return "->" in query or any(w in ("to", "in", "as") for w in query.lower().split())


def grouped(value: float, n: int) -> str:
    """With commas and ``n`` decimals; what rounds to nothing has no sign."""
    out = f"{value:,.{n}f}"
    return out.lstrip("-") if not out.strip("-0.,") else out


def squashed(text: str) -> str:
    return "".join(text.split()).lower()


def calculate(query: str, rates: dict[str, float] | None = None, home: str = "USD") -> str | None:
    """The result of arithmetic, of a conversion of units, or of money (by ``rates`` per dollar, into
    ``home`` where no target is named); None if it is none of these."""
    query = query.strip()
    if not re.search("[0-9]", query) or re.fullmatch(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", query):
        return None
    m = re.fullmatch(r"([0-9.,+*/^() -]+?)\s*([^\W\d].*?|°[a-zA-Z])(?:\s*(?:->|\bto\b|\bin\b|\bas\b)\s*(.+))?", query)
    value = arithmetic(m[1]) if m else arithmetic(query)
    if value is None:
        return None
    if not m:
        out = f"{value:.15g}"
        return None if squashed(out) == squashed(query) else out
    source, target = m[2].strip(), (m[3] or "").strip()
    a, b = source.upper(), (target or home).upper()
    if rates and a in rates and b in rates and not (target and unit_of(source) and unit_of(target)):
        return f"{grouped(value / rates[a] * rates[b], decimals_of(b))} {b}"
    one, two = unit_of(source), unit_of(target) if target else None
    if not one or not two or one[0] != two[0]:
        return None
    return f"{(value * one[1] + one[2] - two[2]) / two[1]:.10g} {target}"


def arithmetic(text: str) -> float | None:
    """Plain arithmetic: numbers, + - * / % ^, parentheses; nothing else is evaluated."""
    tokens = re.findall(r"\d+\.?\d*(?:e[+-]?\d+)?|\.\d+|[-+*/%^()]", text.replace(",", "").replace(" ", ""))
    if "".join(tokens) != text.replace(",", "").replace(" ", "") or not tokens or len(tokens) > 500:
        return None
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def value() -> float:
        if peek() in ("-", "+"):
            return -value() if take() == "-" else value()
        if peek() == "(":
            take()
            out = total()
            if not peek() or take() != ")":
                raise ValueError
        else:
            out = float(take()) if peek() not in ("", *")*/%^") else _fail()
        if peek() == "^":
            take()
            power = value()
            if abs(power) > 1000:
                raise ValueError
            out = out**power
        return out

    def product() -> float:
        out = value()
        while peek() and peek() in "*/%":
            op, right = take(), value()
            out = out * right if op == "*" else out / right if op == "/" else out % right
        return out

    def total() -> float:
        out = product()
        while peek() and peek() in "+-":
            out = out + product() if take() == "+" else out - product()
        return out

    try:
        out = total()
        return out if at == len(tokens) and not isinstance(out, complex) else None
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return None


def _fail() -> float:
    raise ValueError
