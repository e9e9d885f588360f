"""Quantities in different units, converted to the base unit of their category.

A cell's unit is looked for in the cell, then in the column label, then (lengths only) in the section path. What is written
leaves one or more units possible: a spelling that is a unit as it stands leaves that one, any other spelling the units it
equals but for capitals ("mw": milliwatt, megawatt), no spelling all units of the column's category. For each column a
mixture over the values, with one component for each unit and the components offset by the known conversion factors
(temperatures, which have offsets, on the scale of degrees; the others on the logarithm), is fitted by EM under these
possibilities, and each cell takes the possible unit of the highest posterior.

``posterior`` is that of the unit taken, where a written unit counts as right with probability 1 - ``MISWRITTEN``;
``uncertain`` flags those below ``certain``: inferred units that the value does not settle, and written ones that it contradicts.

Ranges, lists, tolerances, products and pairs are no quantity: value and base are null. Null and empty cells are kept with
nulls. Repeated rows stay repeated. Texts are parsed in Arrow batches; the fit of the mixtures works on counts by
column, bin and possible units, never on rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import cut_lineage

# Unit, category, factor to the base unit, offset added after scaling.
BASE = {"voltage": "V", "length": "m", "temp": "°C", "power": "W", "freq": "Hz", "memory": "GB"}
UNITS = [
    ("V", "voltage", 1.0, 0.0, "V Volt volt volts V_DC V_AC VDC VAC Vdc Vac V_dc V_ac"),
    ("mV", "voltage", 1e-3, 0.0, "mV millivolt millivolts Millivolt"),
    ("kV", "voltage", 1e3, 0.0, "kV kilovolt kilovolts Kilovolt"),
    ("MV", "voltage", 1e6, 0.0, "MV megavolt megavolts"),
    ("uV", "voltage", 1e-6, 0.0, "µV μV uV microvolt microvolts"),
    ("m", "length", 1.0, 0.0, "m Meter meter meters metre metres"),
    ("mm", "length", 1e-3, 0.0, "mm Millimeter millimeter millimeters millimetre millimetres"),
    ("cm", "length", 1e-2, 0.0, "cm Zentimeter centimeter centimeters centimetre centimetres"),
    ("um", "length", 1e-6, 0.0, "um µm μm micron microns micrometre micrometres micrometer micrometers Mikrometer"),
    ("km", "length", 1e3, 0.0, "km Kilometer kilometer kilometers kilometre kilometres"),
    ("in", "length", 0.0254, 0.0, "in inch inches Zoll \" ″ ” ''"),
    ("ft", "length", 0.3048, 0.0, "ft foot feet Fuß ′"),
    ("C", "temp", 1.0, 0.0, "°C ℃ C deg_C degC degrees_Celsius degree_Celsius Celsius Grad_Celsius °_C"),
    ("F", "temp", 5 / 9, -160 / 9, "°F ℉ F deg_F degF degrees_Fahrenheit degree_Fahrenheit Fahrenheit Grad_Fahrenheit °_F"),
    ("K", "temp", 1.0, -273.15, "K kelvin Kelvin kelvins"),
    ("W", "power", 1.0, 0.0, "W Watt watt watts"),
    ("mW", "power", 1e-3, 0.0, "mW milliwatt milliwatts Milliwatt"),
    ("kW", "power", 1e3, 0.0, "kW kilowatt kilowatts Kilowatt"),
    ("MW", "power", 1e6, 0.0, "MW megawatt megawatts Megawatt"),
    ("Hz", "freq", 1.0, 0.0, "Hz hertz Hertz"),
    ("mHz", "freq", 1e-3, 0.0, "mHz millihertz"),
    ("kHz", "freq", 1e3, 0.0, "kHz kilohertz Kilohertz"),
    ("MHz", "freq", 1e6, 0.0, "MHz megahertz Megahertz"),
    ("GHz", "freq", 1e9, 0.0, "GHz gigahertz Gigahertz"),
    ("GB", "memory", 1.0, 0.0, "GB Gbyte gbyte gigabyte gigabytes Gigabyte"),
    ("MB", "memory", 1 / 1024, 0.0, "MB Mbyte mbyte megabyte megabytes Megabyte"),
    ("TB", "memory", 1024.0, 0.0, "TB Tbyte tbyte terabyte terabytes Terabyte"),
    ("KB", "memory", 1 / 1024 / 1024, 0.0, "KB kB Kbyte kbyte kilobyte kilobytes Kilobyte"),
]
CANON = {name.replace("_", " "): unit for unit, _, _, _, names in UNITS for name in names.split(" ")}
CATEGORY = {u: c for u, c, *_ in UNITS}
FACTOR = {u: f for u, _, f, *_ in UNITS}
OFFSET = {u: o for u, _, _, o, _ in UNITS}
#: Base value times 1,000,000 as multiplier and addend, so that the common factors are exact.
MICRO = {u: (round(f * 1e6, 9) if u != "F" else 5e6 / 9) for u, f in FACTOR.items()}
MICRO_OFFSET = {"F": -160e6 / 9, "K": -273150000.0}

_SIGNED = r"[-+]?\d[\d., ]*"
_POWER = r"(?: ?[eE][-+]?\d+| ?[x×·*] ?10 ?\^? ?[-+]?\d+)"
QUANTITY = rf"^({_SIGNED}?)({_POWER})? ?([^\d\s\-–…/,;±x×(\[.][^\d(\[/]*)?$"
FRACTION = r"^([-+]?)(?:(\d+) )?(\d+)/(\d+) ?([^\d\s][^\d/]*)?$"
LABEL_UNIT = r"^(.*?)(?: ?\[([^\]]+)\]| ?\(([^)]+)\)| ?[,/] ?([^,/]+)| in (\S+))$"
SECTION_UNIT = r"(?:\bL|[Ll]engths?|[Dd]imensions?|Längen?)(?::| in) ?([^\s\])]+)[\])]?$"
LEADING = r"^(?:(?:max|min|approx|ca|nom|circa|about|ungefähr|etwa|up to|bis zu|<=|>=|[~≈≤≥<>])\.? ?)+"
TRAILING = r"(?: ?(?:\[\d{1,2}\]|[†‡*¹²³]+|\(?(?:typ|nom|max|min)\.?\)?|\(nominal\)|\(typical\)))+$"


# Qualifiers around a quantity and separators of two readings of one quantity.
_leading = re.compile(LEADING, re.I)
_trailing = re.compile(TRAILING, re.I)
_quantity = re.compile(QUANTITY)
_fraction = re.compile(FRACTION)
_twice = re.compile(r"^([^(/]*[^(/\d\s][^(/]*?) ?(?:\(([^()]+)\)|/ ([^/]+))$")
_label = re.compile(LABEL_UNIT)
_section = re.compile(SECTION_UNIT)
_blank = re.compile(r"\s+")
_exponent = re.compile(r"[-+]?\d+$")
_in_blanks = re.compile(r"[-+]?\d{1,3}(?: \d{3})+(?:[.,]\d+)?")
_thousands = re.compile(r",(\d{3})(?!\d)")
_plain = re.compile(r"[-+]?\d+(?:\.\d+)?")
FOLDED: dict[str, list[str]] = {}
for _name, _unit in CANON.items():
    if _unit not in FOLDED.setdefault(_name.lower(), []):
        FOLDED[_name.lower()].append(_unit)


def _clean(text: str) -> str:
    return _blank.sub(" ", text).strip().replace("−", "-").replace("‒", "-")


def number(digits: str) -> float | None:
    """The number in a run of digits with sign, blanks, commas and points; none if the blanks do not group thousands."""
    digits = digits.strip()
    if " " in digits:
        if not _in_blanks.fullmatch(digits):
            return None
        digits = digits.replace(" ", "")
    if "," in digits and "." in digits:
        digits = digits.replace(".", "").replace(",", ".") if digits.rindex(",") > digits.rindex(".") else digits.replace(",", "")
    elif "," in digits:
        digits = _thousands.sub(r"\1", digits).replace(",", ".")
    elif digits.count(".") > 1:
        digits = digits.replace(".", "")
    return float(digits) if _plain.fullmatch(digits) else None


def unit_of(written: str | None) -> str | None:
    """The unit as written; else the units that equal the writing but for capitals, joined by a bar."""
    if not written:
        return None
    written = written.strip()
    return CANON.get(written) or "|".join(FOLDED.get(written.lower(), ())) or None


def _one(text: str) -> tuple[float | None, str | None, bool]:
    """(value, unit, fraction) of one number with or without a unit."""
    m = _quantity.match(text)
    if m:
        value, fraction, written = number(m[1]), False, (m[3] or "").strip()
        if value is not None and m[2]:
            value = float(f"{value!r}e{_exponent.search(m[2])[0]}")
    elif m := _fraction.match(text):
        if not float(m[4]):
            return None, None, False
        value, fraction, written = (float(m[2] or 0) + float(m[3]) / float(m[4])) * (-1 if m[1] == "-" else 1), True, (m[5] or "").strip()
    else:
        return None, None, False
    unit = unit_of(written)
    if written and not unit or fraction and unit not in (None, "in"):
        return None, None, False
    return value, unit, fraction


def quantity(raw: str | None) -> tuple[float | None, str | None, bool]:
    """(value, unit, fraction) of a cell; value is None where it does not state one quantity."""
    if raw is None:
        return None, None, False
    text = _trailing.sub("", _leading.sub("", _clean(raw)))
    m = _twice.match(text)
    if m:  # one quantity in two units: both written, of one category, and in agreement
        v, u, f = _one(m[1].strip())
        w, t, _ = _one((m[2] or m[3]).strip())
        if v is not None and w is not None and u and t and u != t and u in CATEGORY and CATEGORY[u] == CATEGORY.get(t):
            a, b = v * FACTOR[u] + OFFSET[u], w * FACTOR[t] + OFFSET[t]
            if abs(a - b) <= 0.02 * abs(a) + 1e-12:
                return v, u, f
    return _one(text)


def label(text: str | None) -> tuple[str | None, str]:
    """The unit that ends a column label, and the label without it."""
    if text is None:
        return None, ""
    text = _clean(text)
    m = _label.match(text)
    unit = unit_of(next((g for g in m.groups()[1:] if g), None)) if m else None
    return unit, m[1].strip() if unit else text


class _Memo(dict):
    """Results of the texts met by a worker; emptied when it has grown."""

    def __init__(self, f):
        self.f = f

    def __missing__(self, key):
        if len(self) > 200_000:
            self.clear()
        value = self[key] = self.f(key)
        return value


_cells, _labels = _Memo(quantity), _Memo(label)


@F.pandas_udf(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("fraction", T.BooleanType())]))
def parse_cell(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_cells[t] for t in raw], columns=["value", "unit", "fraction"]).astype({"value": "float64", "unit": "object", "fraction": "bool"})


@F.pandas_udf(T.StructType([T.StructField("unit", T.StringType()), T.StructField("base", T.StringType())]))
def parse_label(labels: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_labels[t] for t in labels], columns=["unit", "base"], dtype="object")


@F.pandas_udf(T.StringType())
def section_unit(paths: pd.Series) -> pd.Series:
    """A unit of length that ends a section path."""
    out = []
    for path in paths:
        m = _section.search(_clean(path)) if path else None
        unit = unit_of(m[1]) if m else None
        out.append(unit if CATEGORY.get(unit) == "length" else None)
    return pd.Series(out, dtype="object")


def _lookup(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def to_base(value: Column, unit: Column) -> Column:
    return value * _lookup(FACTOR)[unit] + _lookup(OFFSET)[unit]


def to_micro(value: Column, unit: Column) -> Column:
    """Base value times 1,000,000, rounded to the nearest integer, ties to even."""
    return F.rint(value * _lookup(MICRO)[unit] + F.coalesce(_lookup(MICRO_OFFSET)[unit], F.lit(0.0))).cast("long")


BIN = 0.02  # of log10 of the size of the value
LOWEST = -1500  # bin of zero and of what is no larger than 1e-30
MISWRITTEN = 0.01
POSTERIOR = "column_base string, bin int, negative boolean, possible string, unit string, posterior double"


def _axis(category: str, units: list[str], bins: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each bin on the scale of the base unit under each unit, and the log of the density's change of scale."""
    size = 10.0 ** (bins * BIN)
    if category == "temp":
        value = np.where(negative, -size, size)
        factor = np.array([FACTOR[u] for u in units])
        return value[:, None] * factor + np.array([OFFSET[u] for u in units]), np.log(factor)
    return (bins * BIN)[:, None] + np.log10([FACTOR[u] for u in units]), np.zeros(len(units))


def _fit_column(counts: pd.DataFrame) -> pd.DataFrame:
    """EM for one column. Rows: possible (units joined by a bar, empty where none is written), bin, negative, n.

    The components share mean and spread of the base value. For each bin and set of possible units it gives the best unit
    and its posterior; for each bin also those without regard to the writing (possible is empty).
    """
    names = [c.split()[0] for c in POSTERIOR.split(", ")]
    kinds = {"column_base": object, "bin": "int32", "negative": bool, "possible": object, "unit": object, "posterior": float}
    category_of = counts["possible"].str.split("|").str[0].map(CATEGORY)
    if category_of.notna().sum() == 0:
        return pd.DataFrame({c: [] for c in names}).astype(kinds)
    category = counts.assign(category=category_of).groupby("category")["n"].sum().sort_index(ascending=False).idxmax()
    counts = counts[category_of.isna() | (category_of == category)]
    units = [u for u, c in CATEGORY.items() if c == category]
    allowed = np.array([[not p or u in p.split("|") for u in units] for p in counts["possible"]], bool)
    bins, negative, n = counts["bin"].to_numpy(float), counts["negative"].to_numpy(bool), counts["n"].to_numpy(float)
    x, scale = _axis(category, units, bins, negative)
    if category != "temp":
        n = np.where(bins > LOWEST, n, 0.0)  # zeros say nothing of the scale
        n = n if n.sum() else np.ones(len(n))
    least = 5.0 if category == "temp" else 0.1
    share = allowed / allowed.sum(axis=1, keepdims=True) * n[:, None]
    weight, mean, spread = share.sum(axis=0) + 1e-3, 0.0, 0.0
    plain = np.zeros_like(x)
    for _ in range(50):
        weight = (share.sum(axis=0) + 1e-3) / (n.sum() + 1e-3 * len(units))
        fresh = float((share * x).sum() / n.sum()), 0.0
        fresh = fresh[0], max(least, math.sqrt(float((share * (x - fresh[0]) ** 2).sum() / n.sum())))
        done = abs(fresh[0] - mean) + abs(fresh[1] - spread) < 1e-6 * least
        mean, spread = fresh
        log = np.log(weight) + scale - ((x - mean) / spread) ** 2 / 2
        plain = np.exp(log - log.max(axis=1, keepdims=True))
        plain /= plain.sum(axis=1, keepdims=True)
        held = np.where(allowed, np.maximum(plain, 1e-300), 0.0)
        share = held / held.sum(axis=1, keepdims=True) * n[:, None]
        if done:
            break
    best = np.where(allowed, plain, -1.0).argmax(axis=1)
    # a unit as written may still be a slip; the value tells how likely
    written = counts["possible"].ne("").to_numpy()
    trust = np.where(allowed, 1 - MISWRITTEN, MISWRITTEN)
    believed = plain * np.where(written[:, None], trust, 1.0)
    posterior = believed[np.arange(len(best)), best] / np.maximum(believed.sum(axis=1), 1e-300)
    column = counts["column_base"].iloc[0]
    out = pd.DataFrame({"column_base": column, "bin": counts["bin"], "negative": negative, "possible": counts["possible"], "unit": [units[k] for k in best], "posterior": posterior})
    hidden = pd.DataFrame({"column_base": column, "bin": counts["bin"], "negative": negative, "possible": "", "unit": [units[k] for k in plain.argmax(axis=1)], "posterior": plain.max(axis=1)})
    return pd.concat([out, hidden]).drop_duplicates(["bin", "negative", "possible"])[names].astype(kinds)


def _parsed(cells: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """The cells with _cell, _label, _section, _value, _possible (of cell or label), _base, _bin and _negative."""
    if metadata is not None:
        sections = metadata.select(F.col("table_id").alias("_table"), section_unit(F.col("section_path")).alias("_section")).where("_section is not null and _table is not null").dropDuplicates(["_table"])
        # one table may hold a tenth of the cells: the few tables with such a unit are broadcast by size at run time, else AQE splits the hot one
        cells = cells.join(sections, cells["table_id"] == sections["_table"], "left").drop("_table")
    else:
        cells = cells.withColumn("_section", F.lit(None).cast("string"))
    parsed = cells.withColumn("_cell", parse_cell(F.col("raw_value"))).withColumn("_label", parse_label(F.col("column_label")))
    parsed = parsed.withColumn("_value", F.col("_cell.value")).withColumn("_possible", F.coalesce(F.col("_cell.unit"), F.col("_label.unit"), F.lit(""))).withColumn("_base", F.coalesce(F.col("_label.base"), F.lit("")))
    # zero lies in the lowest bin; it is the same in all units but those of temperature
    bin_ = F.greatest(F.lit(LOWEST), F.round(F.log10(F.abs(F.nullif("_value", F.lit(0.0)))) / BIN).cast("int"))
    return parsed.withColumn("_bin", F.when(F.col("_value").isNotNull(), F.coalesce(bin_, F.lit(LOWEST)))).withColumn("_negative", F.col("_value") < 0)


def _mixtures(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posteriors, category of each column); the counts behind them are a few rows for each column."""
    counts = parsed.where("_bin is not null").groupBy(F.col("_base").alias("column_base"), F.col("_bin").alias("bin"), F.col("_negative").alias("negative"), F.col("_possible").alias("possible")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    fitted = counts.groupBy("column_base").applyInPandas(_fit_column, POSTERIOR)
    # category of a column: the one of most units written in it
    tally = counts.where("possible <> ''").groupBy("column_base", _lookup(CATEGORY)[F.split_part("possible", F.lit("|"), F.lit(1))].alias("category")).agg(F.sum("n").alias("n"))
    return fitted, tally.groupBy(F.col("column_base").alias("_base")).agg(F.max_by("category", F.struct("n", "category")).alias("_category"))


def _with_posterior(parsed: DataFrame, fitted: DataFrame, possible: Column) -> DataFrame:
    """``parsed`` with _guess and _posterior of the mixture, given the units that are possible."""
    guess = fitted.select(F.col("column_base").alias("_b"), F.col("bin").alias("_n"), F.col("negative").alias("_s"), F.col("possible").alias("_p"), F.col("unit").alias("_guess"), F.col("posterior").alias("_posterior"))
    same = (F.col("_base") == F.col("_b")) & (F.col("_bin") == F.col("_n")) & (F.col("_negative") == F.col("_s")) & (possible == F.col("_p"))
    return parsed.join(guess, same, "left").drop("_b", "_n", "_s", "_p")


def convert_units(cells: DataFrame, metadata: DataFrame | None = None, certain: float = 0.9) -> DataFrame:
    """The cells with value, unit, unit_source, true_category, base_value, base_micro, posterior and uncertain.

    ``cells`` has cell_id, table_id, column_label and raw_value; ``metadata`` has table_id and section_path.
    """
    own = ["_value", "_possible", "_base", "_label", "_section", "_bin", "_negative", "_category", "_guess", "_posterior", "_cell"]
    parsed = _parsed(cells.drop(*own), metadata)
    fitted, category = _mixtures(parsed)
    out = _with_posterior(parsed.join(category, "_base", "left"), fitted, F.col("_possible"))
    section = F.when(F.col("_category") == "length", F.col("_section"))
    # a single possible unit needs no mixture, as in a column without any other unit
    single = F.when((F.col("_possible") != "") & ~F.contains("_possible", F.lit("|")), F.col("_possible"))
    unit = F.coalesce(single, F.when(F.col("_possible") != "", F.col("_guess")), section, F.col("_guess"))
    source = F.when(F.col("_cell.unit").isNotNull(), "cell").when(F.col("_label.unit").isNotNull(), "column").when(section.isNotNull(), "section").when(F.col("_guess").isNotNull(), "inferred")
    fits = ~F.col("_cell.fraction") | (unit == "in")
    usable = F.col("_value").isNotNull() & unit.isNotNull() & fits
    out = out.withColumn("value", F.when(F.coalesce(fits, ~F.col("_cell.fraction")), F.col("_value"))).withColumn("unit", F.when(usable, unit)).withColumn("unit_source", F.when(usable, source))
    out = out.withColumn("true_category", _lookup(CATEGORY)[F.col("unit")]).withColumn("base_value", to_base(F.col("value"), F.col("unit"))).withColumn("base_micro", to_micro(F.col("value"), F.col("unit")))
    believed = F.when((F.col("unit_source") == "section") & (F.col("_guess") != F.col("unit")), 1 - F.col("_posterior")).otherwise(F.coalesce(F.col("_posterior"), F.lit(1.0)))
    out = out.withColumn("posterior", F.when(F.col("unit").isNotNull(), believed))
    return out.withColumn("uncertain", F.col("posterior") < certain).drop(*own)


def hidden_units(cells: DataFrame, metadata: DataFrame | None = None, certain: float = 0.9) -> DataFrame:
    """Held-out accuracy of the mixtures: each quantity with one possible unit is assigned a unit from its value alone.

    One row for each column and written unit: n, how often the mixture agrees, how often its posterior reaches ``certain``
    and how often it agrees there. The fit itself knows the written units of the column, which is what it is used with.
    """
    parsed = _parsed(cells, metadata)
    fitted, _ = _mixtures(parsed)
    known = parsed.where((F.col("_possible") != "") & ~F.contains("_possible", F.lit("|")) & F.col("_bin").isNotNull()).groupBy("_base", "_bin", "_negative", "_possible").agg(F.count(F.lit(1)).alias("n"))
    judged = _with_posterior(known, fitted, F.lit(""))
    agrees, sure = F.col("_guess") == F.col("_possible"), F.col("_posterior") >= certain
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return judged.groupBy(F.col("_base").alias("column_base"), F.col("_possible").alias("unit")).agg(F.sum("n").alias("n"), total(agrees).alias("n_agree"), total(sure).alias("n_sure"), total(sure & agrees).alias("n_sure_agree"))


def misrecorded(converted: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Cells that state one quantity with a written unit and whose stored number or category is missing or wrong."""
    off = F.col("norm_numeric").isNull() | F.isnan("norm_numeric") | (F.abs(F.col("norm_numeric") - F.col("base_value")) > tolerance * F.abs("base_value") + 1e-12)
    wrong = off | F.col("unit_category").isNull() | (F.col("unit_category") != F.col("true_category"))
    return converted.where(F.col("unit_source").isin("cell", "column", "section") & wrong)
