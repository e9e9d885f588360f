import pytest

from docloom.operators import units as U

CELLS = "cell_id string, row_id string, table_id string, row_label string, column_label string, raw_value string, norm_numeric double, unit_category string"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("5 V", (5.0, "V", False)), ("5000 mV", (5000.0, "mV", False)), ("1,061 W", (1061.0, "W", False)), ("0,25 TB", (0.25, "TB", False)), ("1.234,5 mm", (1234.5, "mm", False)), ("1,234.5 mm", (1234.5, "mm", False)),
        ("2 400 000", (2400000.0, None, False)), ("4.8·10^4 Hz", (48000.0, "Hz", False)), ("3.8e3 W", (3800.0, "W", False)), ("1 5/8 in", (1.625, "in", True)), ("5 V (5000 mV)", (5.0, "V", False)), ("1920 mm / 192 cm", (1920.0, "mm", False)),
        ("≤ 719 Hz", (719.0, "Hz", False)), ("40 °C †", (40.0, "C", False)), ("−4 degF", (-4.0, "F", False)), ("1.2 MW", (1.2, "MW", False)), ("1.2 mW", (1.2, "mW", False)),
        ("4–86 kHz", (None, None, False)), ("2 W / 73 W", (None, None, False)), ("± 0.7 mm", (None, None, False)), ("2 x 4 GB", (None, None, False)), ("230/115 V", (None, None, False)), ("-7…14 °C", (None, None, False)), ("EUR 4,401", (None, None, False)), ("IP54", (None, None, False)), ("", (None, None, False)), (None, (None, None, False)),
    ],
)
def test_quantity(raw, expected):
    value, unit, fraction = U.quantity(raw)
    assert (unit, fraction) == expected[1:]
    assert value == pytest.approx(expected[0]) if expected[0] is not None else value is None


def test_convert_and_misrecorded(spark):
    rows = [
        ("a", "r", "t", "x", "Length", "12 mm", 0.012, "length"), ("b", "r", "t", "x", "Length", "12 mm", 12.0, "length"), ("c", "r", "t", "x", "Length [cm]", "12", None, None), ("d", "r", "s", "x", "Length", "12", None, None),
        ("e", "r", "s", "x", "Pack Size", "12", 12.0, "dimensionless"), ("f", "r", None, None, None, None, None, None), ("b", "r", "t", "x", "Length", "12 mm", 12.0, "length"), ("g", "r", "t", "x", "Temp / °F", "32", None, "temp"),
    ]
    cells = spark.createDataFrame(rows, CELLS)
    meta = spark.createDataFrame([("s", "Data > Mechanical – lengths: cm"), ("t", None), (None, "x [L: mm]")], "table_id string, section_path string")
    got = {(r.cell_id, r.true_category, r.base_micro) for r in U.misrecorded(U.convert_units(cells, meta)).select("cell_id", "true_category", "base_micro").distinct().collect()}
    assert got == {("b", "length", 12000), ("c", "length", 120000), ("d", "length", 120000), ("g", "temp", 0)}


def test_missing_units_follow_the_mixture(spark):
    rows = [(f"k{i}", "r", "t", "x", "Power", f"{100 + i} W", None, None) for i in range(40)] + [(f"m{i}", "r", "t", "x", "Power", f"{100000 + 1000 * i} mW", None, None) for i in range(40)]
    rows += [("w", "r", "t", "x", "Power", "120", None, None), ("v", "r", "t", "x", "Power", "120000", None, None)]
    cells = spark.createDataFrame(rows, CELLS).withColumnRenamed("norm_numeric", "value")  # a clashing name
    got = {r.cell_id: (r.unit, r.unit_source) for r in U.convert_units(cells.drop("value")).where("cell_id in ('w', 'v')").collect()}
    assert got == {"w": ("W", "inferred"), "v": ("mW", "inferred")}


def test_empty_table(spark):
    assert U.convert_units(spark.createDataFrame([], CELLS)).count() == 0


def test_capitals_leave_it_to_the_mixture(spark):
    rows = [(f"k{i}", "r", "t", "x", "Power", f"{10 + i} MW", None, None) for i in range(30)] + [(f"m{i}", "r", "t", "x", "Drain", f"{200 + i} mW", None, None) for i in range(30)]
    rows += [("a", "r", "t", "x", "Power", "12 mw", None, None), ("b", "r", "t", "x", "Drain", "210 Mw", None, None), ("c", "r", "t", "x", "Power", "15 mW", None, None), ("d", "r", "t", "x", "Power", "3 WATT", None, None), ("e", "r", "t", "x", "Alone", "3 mhz", None, None)]
    got = {r.cell_id: r for r in U.convert_units(spark.createDataFrame(rows, CELLS)).where("length(cell_id) = 1").collect()}
    assert (got["a"].unit, got["b"].unit, got["d"].unit) == ("MW", "mW", "W") and U.unit_of("mw") == "mW|MW" and U.unit_of("M") == "m"
    # as written, capitals included; but the value makes the writing doubtful
    assert got["c"].unit == "mW" and got["c"].uncertain and not got["a"].uncertain
    assert got["e"].unit in ("Hz", "mHz", "MHz") and got["e"].true_category == "freq"


def test_temperatures_by_offset(spark):
    rows = [(f"k{i}", "r", "t", "x", "Temp", f"{10 + i} °C", None, None) for i in range(30)] + [(f"f{i}", "r", "t", "x", "Temp", f"{285 + i} K", None, None) for i in range(30)]
    rows += [("a", "r", "t", "x", "Temp", "300", None, None), ("b", "r", "t", "x", "Temp", "20", None, None), ("z", "r", "t", "x", "Temp", "0 K", None, None)]
    cells = spark.createDataFrame(rows, CELLS)
    got = {r.cell_id: r.unit for r in U.convert_units(cells).where("length(cell_id) = 1").collect()}
    assert got == {"a": "K", "b": "C", "z": "K"}
    hidden = {r.unit: r for r in U.hidden_units(cells).collect()}
    assert hidden["C"].n_agree == hidden["C"].n == 30 and hidden["K"].n == 31 and hidden["K"].n_agree >= 30
