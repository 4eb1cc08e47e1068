"""Rule-based standardisation of both stores' products (OP-32 to OP-37, OP-65, OP-66)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.functions import text as X
from priceloom.functions import vocabulary as V
from priceloom.functions.labels import attribute, is_product

from .envelope import strip_tags

OUT = ["sku", "titulo", "precio_clp", "url", "medida_extraida", "texto_embedding"]


def spec(specs: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(specs, F.lit(key)), F.lit(""))


def joined(*parts: Column) -> Column:
    """The parts with one space between, empty ones included."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def size_from_specs_a(diameter: Column, length: Column, title: Column) -> Column:
    """``d x l`` without outer spaces and x; else the size in the title; else the default."""
    both = F.btrim(F.concat(X.strip(diameter), F.lit(" x "), X.strip(length)), F.lit(" x"))
    return F.coalesce(F.nullif(both, F.lit("")), F.nullif(X.size(title), F.lit("")), F.lit(V.NO_SIZE))


def size_from_specs_b(diameter: Column, length: Column, title: Column) -> Column:
    """``d x l`` if both are told; else the size in the title; else the default."""
    d, n = F.replace(X.strip(diameter), F.lit(" Milimetros"), F.lit("mm")), X.strip(length)
    return F.when((d == "") | (n == ""), F.coalesce(F.nullif(X.size(title, quotes_are_inches=True), F.lit("")), F.lit(V.NO_SIZE))).otherwise(F.concat(d, F.lit(" x "), n))


def contexts_a(title: Column, specs: Column) -> dict[str, Column]:
    """The text that each attribute is told from."""
    return {
        "uso": joined(title, spec(specs, "Uso"), spec(specs, "Superficie de aplicación"), spec(specs, "Recomendaciones")),
        "material": joined(title, spec(specs, "Material")),
        "cabeza": joined(title, spec(specs, "Tipo de cabeza")),
        "punta": title,
    }


def contexts_b(title: Column, specs: Column, description: Column) -> dict[str, Column]:
    return {
        "uso": joined(title, spec(specs, "Uso"), spec(specs, "Uso Recomendado"), description),
        "material": joined(title, spec(specs, "Material"), spec(specs, "Terminación"), description),
        "cabeza": joined(title, spec(specs, "Tipo de cabeza"), description),
        "punta": joined(title, spec(specs, "Modelo"), description),
    }


def sentence_a(title: Column, tip: Column, size: Column, use: Column, head: Column, material: Column) -> Column:
    return F.concat_ws(" ", title, tip, size, use, head, material)


def sentence_b(title: Column, use: Column, head: Column) -> Column:
    return F.concat(title, F.lit(" - Uso: "), use, F.lit(" - Cabeza: "), head)


def _frame(products: DataFrame) -> DataFrame:
    defaults = {"sku": F.lit("N/A"), "titulo": F.lit(""), "precio_clp": F.lit(0.0), "url": F.lit(""), "especificaciones": F.create_map().cast("map<string,string>"), "descripcion_completa": F.lit("")}
    have = set(products.columns)
    return products.select(*[(F.coalesce(F.col(c), d) if c in have else d).alias(c) for c, d in defaults.items()]).withColumn("titulo", X.strip("titulo"))


def standardize_a(products: DataFrame, only_products: bool = False) -> DataFrame:
    """Store A's standardised rows; ``only_products`` applies the keyword filter, which A's own data has had before."""
    df = _frame(products)
    df = df.where(is_product(F.col("titulo"))) if only_products else df
    title, specs = F.col("titulo"), F.col("especificaciones")
    about = {k: attribute(c, k, "a") for k, c in contexts_a(title, specs).items()}
    df = df.withColumns({"medida_extraida": size_from_specs_a(spec(specs, "Diámetro"), spec(specs, "Largo"), title), **{f"__{k}": c for k, c in about.items()}})
    return df.withColumn("texto_embedding", sentence_a(title, F.col("__punta"), F.col("medida_extraida"), F.col("__uso"), F.col("__cabeza"), F.col("__material"))).select(*OUT)


def standardize_b(products: DataFrame) -> DataFrame:
    """Store B's standardised rows: only titles with a product word."""
    df = _frame(products).where(is_product(F.col("titulo")))
    title, specs = F.col("titulo"), F.col("especificaciones")
    about = contexts_b(title, specs, strip_tags(F.col("descripcion_completa")))
    size = size_from_specs_b(spec(specs, "Diámetro"), spec(specs, "Largo"), title)
    return df.withColumns({"medida_extraida": size, "texto_embedding": sentence_b(title, attribute(about["uso"], "uso", "b"), attribute(about["cabeza"], "cabeza", "b"))}).select(*OUT)


def filter_audit(products: DataFrame, title: str = "titulo") -> DataFrame:
    """One row: products read, kept and removed by the keyword filter."""
    kept = F.count_if(F.coalesce(is_product(F.col(title)), F.lit(False)))
    return products.agg(F.count(F.lit(1)).alias("total"), kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("removed"))
