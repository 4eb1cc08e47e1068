"""Registered queries of the comparison engine and their DuckDB equivalents.

The driver's tables hold no products of these stores, so ``products`` and its SQL twin make one of every
row of ``part``: titles with a kind, a vocabulary word, a size and a package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions import labels as L
from priceloom.functions import text as X
from priceloom.functions import vocabulary as V
from priceloom.operators import catalogue as K
from priceloom.operators import compare as P
from priceloom.operators import enrich as N
from priceloom.operators import envelope as E
from priceloom.operators import index as I
from priceloom.operators import page_tree
from priceloom.operators import search as S
from priceloom.operators import standardize as Z
from priceloom.session import configure

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(configure(spark), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- a product for each part

KINDS = ["tornillo", "tirafondo", "clavo", "soberbio", "roscalata", "perno"]
WORDS = ["yeso-cartón", "metalcon", "pino madera", "techo zinc", "hormigon", "internit", "autoperforante", "punta fina", "phillips ph2", "extra plana", "lenteja", "hexagonal", "crs", "pan head", "inox", "zincado", "negro", "bronceado", "zc brillante", "carbono", "volcanita vulcanita"]
SITE_A, SITE_B = "https://a.example/product", "https://b.example"


def products(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    n = lambda c: c.cast("string")
    pick = lambda items: F.get(F.array(*map(F.lit, items)), (k % len(items)).cast("int"))
    a, b, c = n(k % 3 + 1), n(k % 7 + 1), n(k % 4 + 1)
    z = n(F.col("p_size"))
    size = F.when(k % 5 == 0, F.concat(z, F.lit(" x "), a, F.lit(" "), b, F.lit('/8"'))).when(k % 5 == 1, F.concat(c, F.lit('" '), z, F.lit(" mm"))).when(k % 5 == 2, F.concat(a, F.lit(" "), b, F.lit("/8 pulgadas"))).when(k % 5 == 3, F.concat(z, F.lit(" mm"))).otherwise("")
    title = F.concat_ws(" ", pick(KINDS), pick(WORDS), F.col("p_name"), size, F.lit("caja"), n(k * 7 % 23 * 10 + 1), F.lit("un"))
    specs = F.create_map(F.lit("Uso"), pick(WORDS[::-1]), F.lit("Material"), pick(WORDS[3:]), F.lit("Tipo de cabeza"), pick(WORDS[5:12]), F.lit("Modelo"), pick(KINDS[1:]), F.lit("Diámetro"), F.when(k % 3 == 0, "").otherwise(F.concat(z, F.lit(" Milimetros"))), F.lit("Largo"), F.when(k % 4 == 0, " ").otherwise(F.concat(b, F.lit("mm"))))
    return part.select(k.alias("id"), n(k).alias("sku"), F.col("p_brand").alias("marca"), title.alias("titulo"), F.col("p_retailprice").alias("precio_clp"), F.concat(F.lit("https://x.example/"), n(k)).alias("url"), specs.alias("especificaciones"), F.concat(F.lit("<p>"), pick(WORDS[2:9]), F.lit(" &quot;"), F.col("p_type"), F.lit("&quot;</p>")).alias("descripcion_completa"))


def _pick_sql(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + f"][(p_partkey % {len(items)} + 1)::INT]"


PRODUCTS_SQL = f"""p AS (SELECT p_partkey AS id, p_partkey::VARCHAR AS sku, p_brand AS marca, p_retailprice AS precio_clp, 'https://x.example/' || p_partkey AS url,
  {_pick_sql(KINDS)} || ' ' || {_pick_sql(WORDS)} || ' ' || p_name || ' ' || CASE p_partkey % 5
     WHEN 0 THEN p_size || ' x ' || (p_partkey % 3 + 1) || ' ' || (p_partkey % 7 + 1) || '/8"' WHEN 1 THEN (p_partkey % 4 + 1) || '" ' || p_size || ' mm'
     WHEN 2 THEN (p_partkey % 3 + 1) || ' ' || (p_partkey % 7 + 1) || '/8 pulgadas' WHEN 3 THEN p_size || ' mm' ELSE '' END
  || ' caja ' || (p_partkey * 7 % 23 * 10 + 1) || ' un' AS titulo,
  {_pick_sql(WORDS[::-1])} AS s_uso, {_pick_sql(WORDS[3:])} AS s_material, {_pick_sql(WORDS[5:12])} AS s_cabeza, {_pick_sql(KINDS[1:])} AS s_modelo,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_size || ' Milimetros' END AS s_diametro, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE (p_partkey % 7 + 1) || 'mm' END AS s_largo,
  ' ' || {_pick_sql(WORDS[2:9])} || ' "' || p_type || '" ' AS descr FROM part)"""


# ---------------------------------------------------------------- the functions in DuckDB SQL


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_norm(x: str) -> str:
    out = f"translate(lower({x}), '{X.ACCENTED}', '{X.PLAIN}')"
    for name in X.DRYWALL_NAMES:
        out = f"replace({out}, '{name}', 'drywall')"
    out = f"regexp_replace({out}, '([0-9])([a-z])', '\\1 \\2', 'g')"
    return sql_strip(f"regexp_replace({out}, '([a-z])([0-9])', '\\1 \\2', 'g')")


def sql_numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '{X.NUMBER}', 1))"


def sql_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"


def sql_quantity(x: str) -> str:
    t = f"replace(lower({x}), '.', '')"
    return f"greatest(1, coalesce(try_cast(nullif(regexp_extract({t}, '{X.UNIT_COUNT}', 1), '') AS BIGINT), try_cast(nullif(regexp_extract({t}, '{X.CONTAINER_COUNT}', 1), '') AS BIGINT), 1))::BIGINT"


def sql_size(x: str, b: bool = False) -> str:
    low = f"replace(lower({x}), '''''', '\"')" if b else f"lower({x})"
    t = f"replace({low}, '\"', ' \" ')"
    g = lambda p, n: f"regexp_extract({t}, '{p}', {n})"
    return f"""CASE WHEN {g(X.SIZE_BY, 1)} <> '' THEN replace({g(X.SIZE_BY, 1)} || 'x' || {g(X.SIZE_BY, 2)} || '"', ' ', '')
      WHEN {g(X.SIZE_INCH_AND_MM, 1)} <> '' THEN {g(X.SIZE_INCH_AND_MM, 1)} || '" y ' || {g(X.SIZE_INCH_AND_MM, 2)} || 'mm'
      WHEN {g(X.SIZE_INCH, 1)} <> '' THEN {g(X.SIZE_INCH, 1)} || '"' WHEN {g(X.SIZE_MM, 1)} <> '' THEN {g(X.SIZE_MM, 1)} || 'mm' ELSE '' END"""


def sql_label(x: str, name: str, store: str) -> str:
    whole = V.WHOLE_WORDS[store]
    test = lambda w: f"regexp_matches(lower({x}), '\\b{w}\\b')" if w in whole else f"contains(lower({x}), '{w}')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(map(test, words))} THEN '{label}'" for label, words in V.GROUPS[store][name]) + f" ELSE '{V.DEFAULTS[name]}' END"


USE_A_SQL = "titulo || ' ' || s_uso || '  '"
CONTEXTS_A_SQL = {"uso": USE_A_SQL, "material": "titulo || ' ' || s_material", "cabeza": "titulo || ' ' || s_cabeza", "punta": "titulo"}
CONTEXTS_B_SQL = {"uso": "titulo || ' ' || s_uso || '  ' || descr", "material": "titulo || ' ' || s_material || '  ' || descr", "cabeza": "titulo || ' ' || s_cabeza || ' ' || descr", "punta": "titulo || ' ' || s_modelo || ' ' || descr"}
SIZE_A_SQL = f"coalesce(nullif(trim({sql_strip('s_diametro')} || ' x ' || {sql_strip('s_largo')}, ' x'), ''), nullif({sql_size('titulo')}, ''), '{V.NO_SIZE}')"
_D_SQL = f"replace({sql_strip('s_diametro')}, ' Milimetros', 'mm')"
SIZE_B_SQL = f"CASE WHEN {_D_SQL} = '' OR {sql_strip('s_largo')} = '' THEN coalesce(nullif({sql_size('titulo', True)}, ''), '{V.NO_SIZE}') ELSE {_D_SQL} || ' x ' || {sql_strip('s_largo')} END"
IS_PRODUCT_SQL = f"regexp_matches(lower(titulo), '{'|'.join(V.PRODUCT_WORDS)}')"
joined_list = lambda c: F.array_join(F.array_sort(c), "|")


# ---------------------------------------------------------------- string functions


@query(f"SELECT doc_id, md5({sql_norm('text')}) AS norm_md5 FROM documents")
def q_normalize(spark, t):
    return t("documents").select("doc_id", F.md5(X.normalize(F.col("text"))).alias("norm_md5"))


@query(f"SELECT doc_id, array_to_string(list_sort({sql_numbers('text')}), '|') AS numbers FROM documents")
def q_numbers(spark, t):
    return t("documents").select("doc_id", joined_list(X.numbers(F.col("text"))).alias("numbers"))


@query(f"SELECT doc_id, len({sql_tokens('text')}) AS n_tokens, md5(array_to_string(list_sort({sql_tokens('text')}), '|')) AS tokens_md5 FROM documents")
def q_tokens(spark, t):
    words = X.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(words).cast("bigint").alias("n_tokens"), F.md5(joined_list(words)).alias("tokens_md5"))


@query(f"WITH {PRODUCTS_SQL} SELECT id, upper(titulo) AS upper_text, lower(titulo) AS lower_text FROM p")
def q_case(spark, t):
    return products(t("part")).select("id", F.upper("titulo").alias("upper_text"), F.lower("titulo").alias("lower_text"))


@query(f"WITH {PRODUCTS_SQL} SELECT id, titulo, {sql_quantity('titulo')} AS cantidad FROM p")
def q_quantity(spark, t):
    return products(t("part")).select("id", "titulo", X.quantity(F.col("titulo")).alias("cantidad"))


@query(f"WITH {PRODUCTS_SQL} SELECT id, round(precio_clp / {sql_quantity('titulo')}, 6) AS unit_price FROM p")
def q_unit_price(spark, t):
    return products(t("part")).select("id", F.round(P.unit_price(F.lit(True), F.col("precio_clp"), X.quantity(F.col("titulo"))), 6).alias("unit_price"))


@query(f"WITH {PRODUCTS_SQL} SELECT id, {sql_size('titulo')} AS medida FROM p")
def q_size_a(spark, t):
    return products(t("part")).select("id", X.size(F.col("titulo")).alias("medida"))


@query(f"WITH {PRODUCTS_SQL} SELECT id, {sql_size('replace(titulo, chr(34), chr(39) || chr(39))', True)} AS medida FROM p")
def q_size_b(spark, t):
    return products(t("part")).select("id", X.size(F.replace("titulo", F.lit('"'), F.lit("''")), quotes_are_inches=True).alias("medida"))


@query(f"WITH {PRODUCTS_SQL} SELECT id, {SIZE_A_SQL} AS medida FROM p")
def q_size_specs_a(spark, t):
    s = F.col("especificaciones")
    return products(t("part")).select("id", Z.size_from_specs_a(Z.spec(s, "Diámetro"), Z.spec(s, "Largo"), F.col("titulo")).alias("medida"))


@query(f"WITH {PRODUCTS_SQL} SELECT id, {SIZE_B_SQL} AS medida FROM p")
def q_size_specs_b(spark, t):
    s = F.col("especificaciones")
    return products(t("part")).select("id", Z.size_from_specs_b(Z.spec(s, "Diámetro"), Z.spec(s, "Largo"), F.col("titulo")).alias("medida"))


@query(f"WITH {PRODUCTS_SQL} SELECT id, " + ", ".join(f"{sql_label(c, k, 'a')} AS {k}" for k, c in CONTEXTS_A_SQL.items()) + " FROM p")
def q_labels_a(spark, t):
    return products(t("part")).select("id", *[L.attribute(c, k, "a").alias(k) for k, c in Z.contexts_a(F.col("titulo"), F.col("especificaciones")).items()])


@query(f"WITH {PRODUCTS_SQL} SELECT id, " + ", ".join(f"{sql_label(c, k, 'b')} AS {k}" for k, c in CONTEXTS_B_SQL.items()) + " FROM p")
def q_labels_b(spark, t):
    about = Z.contexts_b(F.col("titulo"), F.col("especificaciones"), E.strip_tags(F.col("descripcion_completa")))
    return products(t("part")).select("id", *[L.attribute(c, k, "b").alias(k) for k, c in about.items()])


@query(f"WITH {PRODUCTS_SQL} SELECT sku, titulo, precio_clp, url, {SIZE_A_SQL} AS medida_extraida, concat_ws(' ', titulo, {sql_label('titulo', 'punta', 'a')}, {SIZE_A_SQL}, " + ", ".join(sql_label(CONTEXTS_A_SQL[k], k, "a") for k in ("uso", "cabeza", "material")) + ") AS texto_embedding FROM p")
def q_super_sentence_a(spark, t):
    return Z.standardize_a(products(t("part")))


@query(f"WITH {PRODUCTS_SQL} SELECT sku, titulo, precio_clp, url, {SIZE_B_SQL} AS medida_extraida, titulo || ' - Uso: ' || {sql_label(CONTEXTS_B_SQL['uso'], 'uso', 'b')} || ' - Cabeza: ' || {sql_label(CONTEXTS_B_SQL['cabeza'], 'cabeza', 'b')} AS texto_embedding FROM p WHERE {IS_PRODUCT_SQL}")
def q_super_sentence_b(spark, t):
    return Z.standardize_b(products(t("part")))


@query(f"WITH {PRODUCTS_SQL} SELECT id, titulo FROM p WHERE {IS_PRODUCT_SQL}")
def q_keyword_filter(spark, t):
    return products(t("part")).where(L.is_product(F.col("titulo"))).select("id", "titulo")


@query(f"WITH {PRODUCTS_SQL} SELECT count(*) AS total, count(*) FILTER ({IS_PRODUCT_SQL}) AS kept, count(*) FILTER (NOT {IS_PRODUCT_SQL}) AS removed FROM p")
def q_filter_audit(spark, t):
    return Z.filter_audit(products(t("part")))


# ---------------------------------------------------------------- pages and JSON


def wrapped(json: Column) -> Column:
    return F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), json, F.lit("</script><script>x</script></html>"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN md5(props) END AS envelope_md5 FROM events")
def q_envelope(spark, t):
    html = F.when(F.col("event_id") % 5 == 0, F.col("props")).otherwise(wrapped(F.col("props")))
    return t("events").select("event_id", F.md5(E.envelope(html)).alias("envelope_md5"))


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS k, coalesce(CASE WHEN event_id % 7 <> 0 THEN json_extract(props, '$.missing')::BIGINT END, -1) AS missing FROM events")
def q_json_path(spark, t):
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    v = F.try_parse_json(text)
    return t("events").select("event_id", E.path(v, "$.k", "bigint").alias("k"), E.path(v, "$.missing", "bigint", -1).cast("bigint").alias("missing"))


@query("SELECT event_id, pos, CASE WHEN pos = 0 THEN json_extract(props, '$.k')::BIGINT ELSE event_id % 3 END AS k FROM events, (VALUES (0), (1)) AS v(pos)")
def q_explode_items(spark, t):
    text = F.concat(F.lit('{"items":['), F.col("props"), F.lit(',{"k":'), (F.col("event_id") % 3).cast("string"), F.lit("}]}"))
    items = E.parse(text, "items array<struct<k: bigint>>")["items"]
    return t("events").select("event_id", F.posexplode(items).alias("pos", "item")).select("event_id", "pos", "item.k")


@query("SELECT page_id, CASE WHEN c > 0 AND coalesce(per, 48) > 0 THEN ceil(c / coalesce(per, 48)) ELSE 1 END::BIGINT AS pages_a, CASE WHEN c > 0 THEN ceil(c / 40) ELSE 1 END::BIGINT AS pages_b FROM (SELECT page_id, page_id * 37 % 501 AS c, nullif(page_id % 5, 4) * 12 AS per FROM pages)")
def q_page_count(spark, t):
    count, per = F.col("page_id") * 37 % 501, F.nullif(F.col("page_id") % 5, F.lit(4)) * 12
    return t("pages").select("page_id", K.page_count_a(count, per).alias("pages_a"), K.page_count_b(count).alias("pages_b"))


@query("""WITH g AS (SELECT page_id, page_id % 7 AS shop, page_id // 7 + 1 AS page_no, page_id * 13 % 29 <> 0 OR page_id < 7 AS good FROM pages),
  s AS (SELECT shop, min(page_no) FILTER (NOT good) AS bad, max(CASE WHEN page_no = 1 THEN shop * 5 + 3 END) AS told FROM g GROUP BY shop)
  SELECT page_id, g.shop, page_no FROM g JOIN s ON g.shop = s.shop WHERE good AND page_no < coalesce(bad, 1e18) AND page_no <= coalesce(told, 1)""")
def q_prefix_until_empty(spark, t):
    k = F.col("page_id")
    g = t("pages").select("page_id", (k % 7).alias("shop"), (F.floor(k / 7) + 1).alias("page_no"), ((k * 13 % 29 != 0) | (k < 7)).alias("good"))
    return K.prefix_until_empty(g, "page_no", F.col("good"), F.col("shop") * 5 + 3, ["shop"]).select("page_id", "shop", "page_no")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' END AS found FROM events")
def q_first_with_key(spark, t):
    k = F.col("event_id") % 3
    text = F.when(k == 0, '[{"specifications":"first"},{"specifications":"later"}]').when(k == 1, '[{"other":1},{"specifications":"second"},{"specifications":"third"}]').otherwise('[{"other":1},{"no":2}]')
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    return t("events").select("event_id", F.try_variant_get(E.first_with_key(items, "specifications"), "$.specifications", "string").alias("found"))


@query("""SELECT event_id, key, value FROM (SELECT event_id, unnest(['color', 'size']) AS key, unnest([event_id % 5 || '', 'last']) AS value FROM events) WHERE NOT (key = 'color' AND event_id % 4 = 0)""")
def q_specs_map(spark, t):
    k = F.col("event_id")
    entry = lambda name, *values: F.struct(F.lit(name).alias("name"), F.array(*values).cast("array<string>").alias("values"))
    color = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array((k % 5).cast("string"), F.lit("z")))
    entries = F.array(entry("size", F.lit("first")), F.struct(F.lit("color").alias("name"), color.alias("values")), entry("", F.lit("x")), entry("size", F.lit("last"), F.lit("y")))
    return t("events").select("event_id", F.explode(E.specifications(entries)).alias("key", "value"))


@query("""SELECT event_id, key, CASE key WHEN 'a' THEN event_id % 9 || '' WHEN 'b' THEN 's' WHEN 'c' THEN '[]' ELSE '{"x":1}' END AS value FROM events, (VALUES ('a'), ('b'), ('c'), ('d')) AS v(key)""")
def q_unwrap(spark, t):
    text = F.concat(F.lit('{"a":["'), (F.col("event_id") % 9).cast("string"), F.lit('","q"],"b":"s","c":[],"d":{"x":1}}'))
    values = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return t("events").select("event_id", F.explode(E.unwrap(values)).alias("key", "value"))


@query("SELECT page_id, md5(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&quot;', '\"')) AS text_md5 FROM pages")
def q_html_strip(spark, t):
    return t("pages").select("page_id", F.md5(E.strip_tags(F.col("html"))).alias("text_md5"))


def detail_page(k: Column) -> Column:
    n = k.cast("string")
    body = F.concat(F.lit('<div class="x fb-product-information-tab__copy">\n Linea '), n, F.lit('\n<b>dos</b> </div><table class="specification-table"><tr><td class="property-name"> Largo </td><td class="property-value">'), n, F.lit('mm</td></tr><tr><td class="property-name">solo</td></tr><tr><td class="property-name">Uso</td><td class="property-value">viejo</td></tr><tr><td class="property-name">Uso</td><td class="property-value"> nuevo </td></tr></table>'))
    return F.when(k % 4 == 0, F.lit("<p>nada</p>")).otherwise(body)


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Sin descripción' ELSE 'Linea ' || page_id || ' dos' END AS descripcion FROM pages")
def q_html_desc(spark, t):
    return page_tree.details(t("pages").select("page_id", detail_page(F.col("page_id")).alias("html"))).select("page_id", "descripcion")


@query("SELECT page_id, key, CASE key WHEN 'Largo' THEN page_id || 'mm' ELSE 'nuevo' END AS value FROM pages, (VALUES ('Largo'), ('Uso')) AS v(key) WHERE page_id % 4 <> 0")
def q_spec_table(spark, t):
    return page_tree.details(t("pages").select("page_id", detail_page(F.col("page_id")).alias("html"))).select("page_id", F.explode("especificaciones").alias("key", "value"))


# ---------------------------------------------------------------- catalogue rows


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 0.0 ELSE (p_partkey * 1000 + p_size)::DOUBLE END AS precio FROM part")
def q_price_a(spark, t):
    text = F.replace(F.format_number(F.col("p_partkey") * 1000 + F.col("p_size"), 0), F.lit(","), F.lit("."))
    prices = F.when(F.col("p_partkey") % 6 != 0, F.array(F.struct(F.array(text, F.lit("1")).alias("price"))))
    return t("part").select(F.col("p_partkey").alias("id"), K.price_a(prices).alias("precio"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_retailprice END AS precio FROM part")
def q_price_b(spark, t):
    k = F.col("p_partkey")
    offer = F.when(k % 3 == 0, F.col("p_size").cast("double")).when(k % 2 == 0, F.lit(0.0))
    return t("part").select(k.alias("id"), K.price_b(offer, F.when(k % 5 != 0, F.col("p_retailprice"))).alias("precio"))


@query(f"SELECT p_partkey AS id, '{SITE_A}/' || p_partkey || '/' || translate(p_name || ' 1/2', ' /', '--') || '/s' || p_partkey AS url_a, '{SITE_B}' || CASE WHEN p_partkey % 2 = 0 THEN '/p/' || p_partkey ELSE '' END AS url_b FROM part")
def q_urls(spark, t):
    k = F.col("p_partkey").cast("string")
    return t("part").select(F.col("p_partkey").alias("id"), K.url_a(SITE_A, k, F.concat(F.col("p_name"), F.lit(" 1/2")), F.concat(F.lit("s"), k)).alias("url_a"), K.url_b(SITE_B, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/p/"), k))).alias("url_b"))


def listing(part: DataFrame, item: Column, per_page: int) -> DataFrame:
    """Parts dealt to pages of ``per_page`` items: (page_no, items)."""
    k = F.col("p_partkey")
    rows = part.groupBy(F.floor(k / per_page).alias("g")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("item")))).alias("rows"))
    return rows.select((F.col("g") + 1).alias("page_no"), F.transform("rows", lambda r: r["item"]).alias("items"))


@query(f"""SELECT 's' || p_partkey AS sku, coalesce(CASE WHEN p_partkey % 9 <> 0 THEN p_brand END, '{K.NO_BRAND}') AS marca, p_name AS titulo, (p_partkey * 1000)::DOUBLE AS precio_clp,
  '{SITE_A}/s' || p_partkey || '/' || translate(p_name, ' /', '--') || '/s' || p_partkey AS url, p_partkey // 48 + 1 AS page_no,
  (row_number() OVER (PARTITION BY p_partkey // 48 ORDER BY p_partkey) - 1)::INT AS pos FROM part WHERE p_partkey // 48 < 30""")
def q_catalogue_a(spark, t):
    k = F.col("p_partkey")
    sku = F.concat(F.lit("s"), k.cast("string"))
    price = F.array(F.struct(F.array(F.replace(F.format_number(k * 1000, 0), F.lit(","), F.lit("."))).alias("price")))
    item = F.struct(F.col("p_name").alias("displayName"), sku.alias("skuId"), F.when(k % 9 != 0, F.col("p_brand")).alias("brand"), price.alias("prices"))
    page = listing(t("part"), item, 48).withColumn("html", wrapped(F.to_json(F.struct(F.struct(F.struct(F.struct(F.lit(30 * 48).alias("count"), F.lit(48).alias("perPage")).alias("pagination"), F.col("items").alias("results")).alias("pageProps")).alias("props")))))
    return K.catalogue_a(page.select("page_no", "html"), SITE_A)


@query(f"""SELECT 's' || p_partkey AS sku, p_brand AS marca, coalesce(CASE WHEN p_partkey % 9 <> 0 THEN p_name END, '{K.NO_TITLE}') AS titulo, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE ELSE p_retailprice END AS precio_clp,
  '{SITE_B}/p/' || p_partkey AS url, p_partkey // 40 + 1 AS page_no, p_type AS tipo FROM part WHERE p_partkey // 40 < 40 AND p_partkey // 40 < 24""")
def q_catalogue_b(spark, t):
    k = F.col("p_partkey")
    specs = F.array(F.struct(F.lit("Tipo").alias("name"), F.array(F.lit("no")).alias("values")), F.struct(F.lit("Tipo").alias("name"), F.array(F.col("p_type")).alias("values")))
    item = F.struct(F.when(k % 9 != 0, F.col("p_name")).alias("productName"), F.concat(F.lit("s"), k.cast("string")).alias("sku"), F.col("p_brand").alias("brand"), F.struct(F.col("p_retailprice").alias("normalPrice"), F.when(k % 2 == 0, F.col("p_size").cast("double")).alias("offerPrice")).alias("prices"), F.concat(F.lit("/p/"), k.cast("string")).alias("linkText"), specs.alias("specifications"))
    items = F.when(F.col("page_no") == 25, F.slice("items", 1, 0)).otherwise(F.col("items"))  # an empty page ends the catalogue
    page = listing(t("part"), item, 40).withColumn("html", wrapped(F.to_json(F.struct(F.struct(F.struct(F.struct(F.lit(40 * 40).alias("recordsFiltered"), items.alias("productList")).alias("serverProductsResponse")).alias("pageProps")).alias("props")))))
    return K.catalogue_b(page.select("page_no", "html"), SITE_B).select("sku", "marca", "titulo", "precio_clp", "url", "page_no", F.col("especificaciones")["Tipo"].alias("tipo"))


# ---------------------------------------------------------------- enrichment


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def q_anti_join(spark, t):
    return N.pending(t("documents").select("doc_id", "source"), t("labels"), "doc_id")


@query("SELECT sku, doc_id FROM (SELECT md5(text) AS sku, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def q_dedup_first(spark, t):
    docs = t("documents").select(F.md5("text").alias("sku"), "doc_id")
    return N.pending(docs, docs.limit(0), "sku", ["doc_id"])


@query("SELECT doc_id, quality, NULL::VARCHAR AS source FROM labels UNION ALL SELECT doc_id, NULL, source FROM documents ANTI JOIN labels USING (doc_id)")
def q_append(spark, t):
    done = t("labels").select("doc_id", "quality")
    return N.append(done, N.pending(t("documents").select("doc_id", "source"), done, "doc_id"))


@query("SELECT (SELECT count(*) FROM documents) - (SELECT count(DISTINCT doc_id) FROM labels) AS remaining")
def q_remaining(spark, t):
    return N.remaining(t("documents"), t("labels"), "doc_id")


@query("SELECT d.doc_id, coalesce('q' || l.quality, d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_merge(spark, t):
    both = t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left")
    return N.merge(both, {"source": F.coalesce(F.concat(F.lit("q"), F.col("quality").cast("string")), F.col("source"))}).select("doc_id", "source")


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '<b>' || p_type || '</b>' ELSE '' END AS descripcion_completa, CASE p_partkey % 3 WHEN 0 THEN 'vieja' WHEN 1 THEN p_size || '' END AS largo FROM part")
def q_overwrite(spark, t):
    k = F.col("p_partkey")
    base = t("part").select(k.alias("id"), k.cast("string").alias("url"), F.create_map(F.lit("Largo"), F.lit("vieja")).alias("especificaciones"))
    state = F.when(k % 3 == 1, F.concat(F.lit('{"specifications":{"Largo":["'), F.col("p_size").cast("string"), F.lit('"]},"description":"<b>'), F.col("p_type"), F.lit('</b>"}'))).otherwise('{"other":1}')
    json = F.concat(F.lit('{"props":{"pageProps":{"dehydratedState":{"queries":[{"state":{"data":{"a":1}}},{"state":{"data":'), state, F.lit("}}]}}}}"))
    pages = t("part").select(k.cast("string").alias("url"), F.when(k % 3 == 0, "<p>no data</p>").otherwise(wrapped(json)).alias("html"))
    return N.enrich_b(base, pages).select("id", "descripcion_completa", F.try_element_at("especificaciones", F.lit("Largo")).alias("largo"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 5 = 0 THEN 'Sin descripción' ELSE 'Linea ' || p_partkey || ' dos' END AS descripcion, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 THEN p_partkey || 'mm' END AS largo FROM part")
def q_enrich_a(spark, t):
    k = F.col("p_partkey")
    base, pages = t("part").select(k.alias("id"), k.cast("string").alias("url")), t("part").where(k % 5 != 0).select(k.cast("string").alias("url"), detail_page(k).alias("html"))
    return N.enrich_a(base, pages).select("id", "descripcion", F.try_element_at("especificaciones", F.lit("Largo")).alias("largo"))


# ---------------------------------------------------------------- search and comparison


def index(t) -> DataFrame:
    """Every part with a vector is a product of store a (even keys) or b (odd keys)."""
    made = products(t("part")).join(t("embeddings"), F.col("id") == F.col("vec_id"))
    made = made.withColumn("medida_extraida", X.size(F.col("titulo")))
    return I.build(made, "?", F.col("embedding"), F.col("id")).withColumn("store", F.when(F.col("idx") % 2 == 0, "a").otherwise("b"))


def pair_queries(t) -> DataFrame:
    """A query for each pair of an even key and the next one: their vectors' sum, the first one's name and sometimes its size."""
    e, f = t("embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").alias("v")), t("embeddings").select((F.col("vec_id") - 1).alias("k"), F.col("embedding").alias("w"))
    rows = e.where("k % 2 = 0").join(f, "k").join(t("part"), F.col("k") == F.col("p_partkey"))
    text = F.concat(F.col("p_name"), F.when(F.col("k") % 4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(""))
    vec = F.zip_with("v", "w", lambda a, b: a.cast("double") + b.cast("double"))
    return S.queries(rows.select(F.col("k").alias("query_id"), text.alias("text"), vec.alias("vec")))


INDEX_SQL = f"""ix AS (SELECT id AS idx, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS store, titulo, precio_clp AS precio, embedding::DOUBLE[] AS vec, {sql_tokens(sql_norm('titulo'))} AS tokens,
  {sql_numbers("titulo || ' ' || " + sql_size('titulo'))} AS numbers, {sql_quantity('titulo')} AS cantidad FROM p JOIN embeddings ON id = vec_id)"""
PAIRS_SQL = f"""qt AS (SELECT e.vec_id AS query_id, p_name || CASE WHEN e.vec_id % 4 = 0 THEN ' ' || p_size ELSE '' END AS text, list_transform(list_zip(e.embedding, f.embedding), lambda x: x[1]::DOUBLE + x[2]::DOUBLE) AS vec
  FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1 JOIN part ON p_partkey = e.vec_id WHERE e.vec_id % 2 = 0),
  q AS (SELECT *, {sql_numbers(sql_norm('text'))} AS asked, {sql_tokens(sql_norm('text'))} AS words FROM qt)"""
SCORED_SQL = "sc AS (SELECT query_id, store, idx, list_cosine_similarity(q.vec, ix.vec) AS cosine, len(list_intersect(words, tokens))::BIGINT AS shared, least(1.0, list_cosine_similarity(q.vec, ix.vec) + 0.05 * len(list_intersect(words, tokens))) AS score FROM q, ix)"
RANKED_SQL = "rk AS (SELECT *, (row_number() OVER (PARTITION BY query_id, store ORDER BY round(score, 9) DESC, idx DESC))::INT AS rank FROM sc QUALIFY rank <= 15)"
PICKED_SQL = """pk AS (SELECT query_id, rk.store, rk.idx, titulo, precio, cantidad, score, CASE WHEN list_has_all(numbers, asked) THEN 1 ELSE 0 END AS flag
  FROM rk JOIN ix ON rk.store = ix.store AND rk.idx = ix.idx JOIN q USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id, rk.store ORDER BY flag DESC, rank) = 1)"""
SEARCH_SQL = f"WITH {PRODUCTS_SQL}, {INDEX_SQL}, {PAIRS_SQL}, {SCORED_SQL}, {RANKED_SQL}, {PICKED_SQL}"
COMPARED_SQL = "bw AS (SELECT query_id, max(precio / cantidad) FILTER (store = 'a' AND score >= 0.7 AND flag = 1) AS a, max(precio / cantidad) FILTER (store = 'b' AND score >= 0.7 AND flag = 1) AS b FROM pk GROUP BY query_id)"


@query("SELECT e.vec_id AS query_id, f.vec_id AS idx, round(list_cosine_similarity(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), 4) AS cosine FROM embeddings e, embeddings f WHERE e.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), 9) DESC, f.vec_id DESC) <= 15")
def q_cosine_topk(spark, t):
    rows = t("embeddings").select(F.lit("all").alias("store"), F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"), F.array().cast("array<string>").alias("tokens"))
    qs = S.queries(rows.where("idx % 100 = 0").select(F.col("idx").alias("query_id"), F.lit("").alias("text"), "vec"))
    return S.top_candidates(qs, rows).select("query_id", "idx", F.round("cosine", 4).alias("cosine"))


@query(f"{SEARCH_SQL} SELECT query_id, store, idx, round(cosine, 4) AS cosine, shared, round(score, 4) AS score, rank FROM rk")
def q_hybrid_topk(spark, t):
    return S.top_candidates(pair_queries(t), index(t)).select("query_id", "store", "idx", F.round("cosine", 4).alias("cosine"), "shared", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {PRODUCTS_SQL} SELECT id, list_has_all({sql_numbers('titulo')}, {sql_numbers('s_diametro')}) AS subset FROM p")
def q_number_subset(spark, t):
    return products(t("part")).select("id", S.number_match(X.numbers(F.col("especificaciones")["Diámetro"]), X.numbers(F.col("titulo"))).alias("subset"))


@query(f"{SEARCH_SQL} SELECT query_id, store, idx, titulo, round(score, 4) AS similarity, flag AS number_match, score >= 0.7 AND flag = 1 AS is_match FROM pk")
def q_pick(spark, t):
    qs, ix = pair_queries(t), index(t)
    found = S.pick(S.top_candidates(qs, ix), qs, ix)
    return found.select("query_id", "store", "idx", "titulo", F.round("similarity", 4).alias("similarity"), "number_match", "is_match")


@query("SELECT event_id, value / 100 >= 0.7 AND event_id % 2 = 1 AS is_match FROM events")
def q_judge(spark, t):
    return t("events").select("event_id", S.judge(F.col("value") / 100, (F.col("event_id") % 2).cast("int")).alias("is_match"))


@query(f"{SEARCH_SQL}, {COMPARED_SQL} SELECT query_id, CASE WHEN a IS NULL OR b IS NULL THEN 'none' WHEN a < b THEN 'a' WHEN b < a THEN 'b' ELSE 'tie' END AS winner, round(abs(a - b), 4) AS saving FROM bw")
def q_compare_stores(spark, t):
    return P.compare(pair_queries(t), index(t)).select("query_id", "winner", F.round("saving", 4).alias("saving"))


@query()
def q_report(spark, t):
    qs, ix = pair_queries(t), index(t)
    return P.report(P.answers(qs, ix), qs)
