"""Registered queries over pages as a source, streams with state, sketches, SQL functions, and joins in time."""

from __future__ import annotations

import datetime
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.functions import catalog
from priceloom.operators import asof
from priceloom.operators import catalogue as K
from priceloom.operators import sketches
from priceloom.session import scratch
from priceloom.sources import files, paged
from priceloom.streaming import incremental, sessions

from . import catalogue as C
from .catalogue import query

# ---------------------------------------------------------------- pages as a source

PER_PAGE = 10


def listing_site(spark, pages: DataFrame) -> paged.Site:
    """The rows of ``pages`` as a catalogue of ten a page, written to the shared folder; pages are fetched from there."""
    folder = scratch(spark, "site")
    n = pages.count()
    item = F.struct(F.col("url").alias("displayName"), F.col("page_id").cast("string").alias("skuId"))
    rows = pages.groupBy((F.floor(F.col("page_id") / PER_PAGE) + 1).cast("int").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("page_id", item.alias("item")))).alias("rows"))
    body = F.struct(F.struct(F.lit(n).alias("count"), F.lit(PER_PAGE).alias("perPage")).alias("pagination"), F.transform("rows", lambda r: r["item"]).alias("results"))
    html = C.wrapped(F.to_json(F.struct(F.struct(body.alias("pageProps")).alias("props"))))
    rows.select("page_no", html.alias("value")).write.partitionBy("page_no").text(folder)

    def get(url: str) -> str | None:
        from pyarrow import fs

        number = int(url.rpartition("=")[2]) if "=" in url else 1
        store, root = fs.FileSystem.from_uri(folder)
        files = store.get_file_info(fs.FileSelector(f"{root}/page_no={number}", allow_not_found=True))
        found = [f.path for f in files if f.base_name.startswith("part-")]
        return store.open_input_file(found[0]).read().decode() if found else None

    told = re.compile(r'"count":(\d+)')
    return paged.Site(get, "https://shop.example/list", "https://shop.example/list?page={n}", lambda html: math.ceil(int(told.search(html)[1]) / PER_PAGE))


_LISTED_SQL = f"SELECT page_id::VARCHAR AS sku, url AS titulo, (page_id // {PER_PAGE} + 1)::INT AS page_no FROM pages"


@query(_LISTED_SQL)
def q_paged_source(spark, t):
    """Every item of a catalogue that is read as a data source."""
    paged.register(spark, "listing", listing_site(spark, t("pages")))
    return K.catalogue_a(spark.read.format("listing").load().select("page_no", "html"), C.SITE_A).select("sku", "titulo", "page_no")


@query(_LISTED_SQL)
def q_paged_stream(spark, t):
    """The same catalogue read as a stream."""
    paged.register(spark, "listing_stream", listing_site(spark, t("pages")))
    out = scratch(spark, "listed")
    stream = spark.readStream.format("listing_stream").load()
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return K.catalogue_a(spark.read.parquet(out).select("page_no", "html"), C.SITE_A).select("sku", "titulo", "page_no")


@query("""WITH g AS (SELECT page_id, page_id % 7 AS shop, page_id // 7 + 1 AS page_no FROM pages), s AS (SELECT shop, max(page_no) AS last FROM g GROUP BY shop)
  SELECT page_id, g.shop, page_no FROM g JOIN s ON g.shop = s.shop WHERE page_no < last OR g.shop % 2 = 1""")
def q_prefix_whole(spark, t):
    """Seven shops' pages, all of them told by page 1: odd shops have no bad page, the last page of even ones is bad."""
    k = F.col("page_id")
    g = t("pages").select("page_id", (k % 7).alias("shop"), (F.floor(k / 7) + 1).alias("page_no"))
    ends = g.groupBy("shop").agg(F.max("page_no").alias("last"))
    g = g.join(ends, "shop").withColumn("good", (F.col("page_no") < F.col("last")) | (F.col("shop") % 2 == 1))
    return K.prefix_until_empty(g, "page_no", F.col("good"), F.col("last"), ["shop"]).select("page_id", "shop", "page_no")


@query("SELECT r_regionkey, r_regionkey % 2 = 1 AS missing, CASE WHEN r_regionkey % 2 = 0 THEN (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) END AS n FROM region")
def q_missing_inputs(spark, t):
    """A file of its nations for every even region: the guard tells which regions have none."""
    root = scratch(spark, "regions")
    t("nation").where("n_regionkey % 2 = 0").select(F.col("n_name").alias("titulo"), "n_regionkey").write.partitionBy("n_regionkey").json(root)
    rows = []
    for (key,) in t("region").select("r_regionkey").collect():  # a few folders
        try:
            rows.append((key, False, files.read_json(spark, f"{root}/n_regionkey={key}", files.CATALOGUE, lines=True).count()))
        except files.MissingInput:
            rows.append((key, True, None))
    return spark.createDataFrame(rows, "r_regionkey int, missing boolean, n bigint")


# ---------------------------------------------------------------- streams with state


@query("SELECT DISTINCT md5(text) AS sku, 'Sin descripción' AS descripcion FROM documents")
def q_stream_resume(spark, t):
    """Documents as products by their text, streamed in two runs over one checkpoint: each text is enriched once."""
    src, out, progress = scratch(spark, "arriving"), scratch(spark, "enriched"), scratch(spark, "progress")
    products = t("documents").select(F.md5("text").alias("sku"), F.lit("u").alias("url"), "doc_id")
    none = spark.createDataFrame([], "url string, html string")
    for half in (0, 1):
        products.where(F.col("doc_id") % 2 == half).drop("doc_id").write.mode("append").parquet(src)
        stream = spark.readStream.schema("sku string, url string").parquet(src)
        incremental.enrich_new(stream, none, out, progress).awaitTermination()
    return spark.read.parquet(out).select("sku", "descripcion")


_SESSIONS_SQL = """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM events),
  s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT user_id, min(ts) AS begun, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session"""


def _user_sessions(rows: DataFrame) -> DataFrame:
    found = sessions.sessions(rows, "user_id", "ts", "6 hours", "1 hour", total=F.sum("value"))
    return found.select("user_id", "begun", "ended", "n", F.round("total", 4).alias("total"))


@query(_SESSIONS_SQL)
def q_sessions(spark, t):
    """Sessions of the events' users."""
    return _user_sessions(t("events").withColumn("ts", F.col("ts").cast("timestamp")))


@query(_SESSIONS_SQL)
def q_stream_sessions(spark, t):
    """The same from a stream that brings the events in four parts, in order of time; a last row, a week later, closes all sessions."""
    src, out = scratch(spark, "arriving"), scratch(spark, "sessions")
    rows = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    for k in range(4):
        start, stop = low + k * (high - low) / 4, low + (k + 1) * (high - low) / 4
        part = rows.where((F.col("ts") >= start) & ((F.col("ts") < stop) | F.lit(k == 3)))
        part.coalesce(1).write.mode("append").parquet(src)  # a file is what a micro-batch takes
    spark.createDataFrame([(None, high + datetime.timedelta(days=7), 0.0)], rows.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sessions.write(_user_sessions(stream), out, scratch(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).where("user_id IS NOT NULL")


# ---------------------------------------------------------------- sketches

_QUANTILES = [0.1, 0.5, 0.9]


@query("SELECT o_orderpriority AS run, count(*) AS n, TRUE AS distinct_close, TRUE AS quantiles_close FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'all', count(*), TRUE, TRUE FROM orders")
def q_sketches(spark, t):
    """Orders sketched by run and merged: whether distinct customers are within 5 % and quantiles within 2 % of the rank."""
    path, orders = scratch(spark, "sketches"), t("orders")
    sketches.append(sketches.sketch(orders, "o_orderpriority", "o_custkey", "o_totalprice"), path)
    stored = spark.read.parquet(path)
    told = sketches.read(stored.unionByName(sketches.merge(stored).withColumn("run", F.lit("all"))), _QUANTILES)
    rows = orders.select(F.explode(F.array("o_orderpriority", F.lit("all"))).alias("run"), "o_custkey", F.col("o_totalprice").alias("price"))
    exact = rows.join(F.broadcast(told.select("run", "quantiles")), "run").groupBy("run").agg(  # a row for each run
        F.countDistinct("o_custkey").alias("exact"), F.count(F.lit(1)).alias("rows"), *(F.sum((F.col("price") <= F.get("quantiles", F.lit(k))).cast("int")).alias(f"below{k}") for k in range(len(_QUANTILES))))
    close = F.abs(F.col("distinct") - F.col("exact")) <= 0.05 * F.col("exact")
    ranks = F.lit(True)
    for k, q in enumerate(_QUANTILES):
        ranks = ranks & (F.abs(F.col(f"below{k}") / F.col("rows") - q) <= 0.02)
    return told.join(exact, "run").select("run", "n", close.alias("distinct_close"), ranks.alias("quantiles_close"))


# ---------------------------------------------------------------- SQL


@query(f"WITH {C.PRODUCTS_SQL} SELECT id, {C.sql_norm('titulo')} AS norm, {C.sql_size('titulo')} AS medida, {C.sql_quantity('titulo')} AS cantidad, array_to_string(list_sort({C.sql_numbers('titulo')}), '|') AS numbers FROM p")
def q_sql_titles(spark, t):
    """The text functions in SQL only."""
    catalog.register(spark)
    return spark.sql("SELECT id, title_normalized(titulo) AS norm, title_size(titulo) AS medida, title_quantity(titulo) AS cantidad, array_join(array_sort(title_numbers(titulo)), '|') AS numbers FROM {products}", products=C.products(t("part")))


@query(C.ORACLE_SQL["q_specs_map"])
def q_sql_specs(spark, t):
    """The rows of q_specs_map by the table function, in SQL only."""
    catalog.register(spark)
    return spark.sql(
        """WITH entries AS (SELECT event_id, array(named_struct('name', 'size', 'values', array('first')),
             named_struct('name', 'color', 'values', CASE WHEN event_id % 4 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array(CAST(event_id % 5 AS STRING), 'z') END),
             named_struct('name', '', 'values', array('x')), named_struct('name', 'size', 'values', array('last', 'y'))) AS e FROM {events})
           SELECT event_id, s.key, s.value FROM entries, LATERAL specification_rows(e) AS s""",
        events=t("events"),
    )


# ---------------------------------------------------------------- joins in time


@query("""SELECT l.event_id, r.ts AS ts_right, r.view_id, r.viewed FROM (SELECT * FROM events WHERE event_type = 'click') l
  ASOF LEFT JOIN (SELECT user_id, ts, event_id AS view_id, value AS viewed FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def q_asof(spark, t):
    """Each click with the last view of its user."""
    e = t("events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("viewed"))
    return asof.asof_join(e.where("event_type = 'click'"), views, "user_id", "ts").select("event_id", "ts_right", "view_id", "viewed")


@query("""SELECT c.event_id, i.start_id FROM events c JOIN (SELECT user_id, event_id AS start_id, ts AS begun, ts + INTERVAL 1 HOUR * (1 + event_id % 48) AS ended FROM events WHERE event_type = 'view') i
  ON c.user_id = i.user_id AND c.ts >= begun AND c.ts < ended WHERE c.event_type = 'click'""")
def q_interval(spark, t):
    """Each click with the views of its user that it falls into the hours after."""
    e = t("events")
    hours = (1 + F.col("event_id") % 48).cast("int")
    spans = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("start_id"), F.col("ts").alias("begun"), (F.col("ts") + F.make_interval(hours=hours)).alias("ended"))
    return asof.interval_join(e.where("event_type = 'click'"), spans, "user_id", "ts", "begun", "ended", 86_400).select("event_id", "start_id")
