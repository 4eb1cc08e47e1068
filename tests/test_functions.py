"""Golden values and traps of the text functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from priceloom.functions import labels as L
from priceloom.functions import text as X
from priceloom.functions import vocabulary as V


def run(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.out for r in df.select("i", function(F.col("c")).alias("out")).orderBy("i").collect()]


SIZES = {
    "6x1 5/8": '6x15/8"', '#8 x 1-1/4"': '8x1-1/4"', "3.5x25mm": '5x25"', '1/4" x 2"': '1/4"', '1-1/4" 30mm': '1-1/4" y 30mm', '5" 120 mm': '5" y 120mm',
    "perno 2 1/2 pulgadas": '2 1/2"', "clavo 50 mm": "50mm", '4"': "", "6x50mm": '6x50"', '8X1/2"': '8x1/2"', "pack 2 x 10 unidades": '2x10"', "": "",
}
QUANTITIES = {
    "100 unidades": 100, "1.000 un": 1000, "caja 100": 100, "pack de 20": 20, "0 un": 1, "3.5 un": 35, "caja con 100": 1, "6x1 5/8 100u": 100, "balde 500 pz": 500,
    "10 undecimo": 10, "6 uds": 6, "12 unid.": 1, "tornillo": 1, "100 unidad(es)": 100, "Caja 50 x 20 un": 20, "1 pulgada": 1,
}
NORMAL = {"Tornillo Yeso-Cartón 6x1": "tornillo drywall 6 x 1", "M8x20mm": "m 8 x 20 mm", "  1a2b ": "1 a 2 b", "Yeso Carton Ñ8": "yeso carton ñ8", "": "", " x ": "x"}


def test_goldens(spark):
    assert run(spark, X.size, SIZES) == list(SIZES.values())
    assert run(spark, lambda c: X.size(c, True), SIZES) == list(SIZES.values())
    assert run(spark, X.quantity, QUANTITIES) == list(QUANTITIES.values())
    assert run(spark, X.normalize, NORMAL) == list(NORMAL.values())
    assert run(spark, X.size, ["1/4''"]) == [""] and run(spark, lambda c: X.size(c, True), ["1/4''"]) == ['1/4"']
    assert set(run(spark, X.numbers, ["6 x 1 5/8 1.5 2,75 1.2.3"])[0]) == {"6", "1", "5", "8", "1.5", "2,75", "1.2", "3"}
    assert run(spark, X.tokens, ["", " a  b a\tc ", None]) == [[], ["a", "b", "c"], []]
    assert run(spark, X.quantity, ["9" * 30 + " un", None]) == [2**63 - 1, None]


@pytest.mark.parametrize("store, text, name, label", [
    ("a", "tornillo hormigón", "uso", "Construcción general"),  # accents are not folded here
    ("a", "cabeza extra plana", "cabeza", "Plana (Avellanada)"),  # the group before wins
    ("a", "tornillo zincado", "uso", "Techumbre (Techo / Zinc / Calamina)"),
    ("b", "tornillo zincado", "uso", "Construcción general"),
    ("b", "perno zcx", "material", "Acero Estándar"), ("b", "perno zc", "material", "Acero Zincado (Galvanizado)"), ("a", "perno zc", "material", "Acero Estándar"),
    ("a", "companero", "cabeza", "Redonda (Pan head)"),  # raw substrings
    ("b", "CRS", "cabeza", "Trompeta (Drywall)"), ("b", "truss", "cabeza", "Lenteja (Fijadora)"), ("a", "", "punta", "Punta Estándar"),
])
def test_labels(spark, store, text, name, label):
    assert run(spark, lambda c: L.attribute(c, name, store), [text]) == [label]


def test_null_text_has_the_default_label(spark):
    assert run(spark, lambda c: L.attribute(c, "uso", "a"), [None]) == [V.DEFAULTS["uso"]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("abxé 1.5/\"-u'nñ", max_size=30), min_size=20, max_size=40))
def test_properties(spark, texts):
    once = run(spark, X.normalize, texts)
    twice = run(spark, X.normalize, once)
    assert run(spark, X.normalize, twice) == twice
    assert all(q >= 1 for q in run(spark, X.quantity, texts))


def test_no_break_spaces(spark):
    """Scraped titles: U+00A0 and U+202F count as white space wherever white space may stand, a mixed number's own blank excepted."""
    nb, thin = " ", " "
    assert run(spark, X.size, [f"6{nb}x{nb}50{nb}mm", f"6 x 1{nb}5/8", f'1-1/4"{thin}30{nb}mm', f"2 1/2{nb}pulgadas"]) == ['6x50"', '6x1"', '1-1/4" y 30mm', '2 1/2"']
    assert run(spark, X.quantity, [f"caja{nb}de{nb}100", f"100{nb}unidades", f"pack{thin}20"]) == [100, 100, 20]
    assert run(spark, X.tokens, [f"a{nb}b　c"]) == [["a", "b", "c"]] and run(spark, X.normalize, [f"{nb}M8{nb}"]) == ["m 8"]
