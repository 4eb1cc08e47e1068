"""Traps of extraction, standardisation, enrichment, search and comparison."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from priceloom.operators import catalogue as K
from priceloom.operators import compare as P
from priceloom.operators import enrich as N
from priceloom.operators import envelope as E
from priceloom.operators import index as I
from priceloom.operators import search as S
from priceloom.operators import standardize as Z
from priceloom.sources import files, pages


def wrap(data):
    return '<html><script id="__NEXT_DATA__" type="application/json">' + (data if isinstance(data, str) else json.dumps(data)) + "</script></html>"


def page_a(items, count=96, per=48):
    return wrap({"props": {"pageProps": {"pagination": {"count": count, "perPage": per}, "results": items}}})


def test_catalogue_a(spark):
    items = [{"displayName": "A b/c", "skuId": "1", "brand": "x", "prices": [{"price": ["12.990"]}]}, {"skuId": "2", "productId": "p2"}, {}]
    df = spark.createDataFrame([(1, page_a(items)), (2, page_a([])), (3, page_a(items))], "page_no int, html string")
    rows = K.catalogue_a(df, "https://a.example").orderBy("pos").collect()
    assert [(r.sku, r.marca, r.titulo, r.precio_clp, r.url) for r in rows] == [
        ("1", "x", "A b/c", 12990.0, "https://a.example/1/A-b-c/1"), ("2", "Sin marca", "Sin titulo", 0.0, "https://a.example/p2/Sin-titulo/2"), ("Sin SKU", "Sin marca", "Sin titulo", 0.0, "https://a.example/Sin SKU/Sin-titulo/Sin SKU"),
    ]


def test_pages_stop(spark):
    one = [{"skuId": "1"}]
    many = [(1, page_a(one, 100, 48)), (2, page_a(one)), (3, page_a(one)), (4, page_a(one))]
    assert K.catalogue_a(spark.createDataFrame(many, "page_no int, html string"), "u").count() == 3  # ceil(100 / 48)
    broken = [(1, page_a(one)), (2, "<p>no script</p>"), (3, page_a(one))]
    assert K.catalogue_a(spark.createDataFrame(broken, "page_no int, html string"), "u").count() == 1
    assert K.catalogue_a(spark.createDataFrame([(1, wrap("{bad"))], "page_no int, html string"), "u").count() == 0
    with pytest.raises(Exception):
        K.catalogue_a(spark.createDataFrame([(1, wrap("{bad"))], "page_no int, html string"), "u", strict=True).collect()


def test_catalogue_b(spark):
    specs = [{"name": "k", "values": ["old"]}, {"name": "k", "values": ["new", "z"]}, {"name": "", "values": ["q"]}, {"name": "e", "values": []}]
    items = [{"productName": "n", "sku": "1", "prices": {"normalPrice": 5.0, "offerPrice": p}, "linkText": "/l", "specifications": specs} for p in (3.0, 0, None)] + [{}]
    html = wrap({"props": {"pageProps": {"serverProductsResponse": {"recordsFiltered": 4, "productList": items}}}})
    rows = K.catalogue_b(spark.createDataFrame([(1, html)], "page_no int, html string"), "https://b.example").orderBy("pos").collect()
    assert [r.precio_clp for r in rows] == [3.0, 5.0, 5.0, 0.0] and rows[0].especificaciones == {"k": "new"} and rows[3].especificaciones == {} and rows[3].url == "https://b.example"


def test_enrich_b(spark):
    state = lambda d: wrap({"props": {"pageProps": {"dehydratedState": {"queries": [{"state": {"data": {"x": 1}}}, {"state": {"data": d}}]}}}})
    base = spark.createDataFrame([(u, {"old": "1"}) for u in "abcde"], "url string, especificaciones map<string,string>")
    details = spark.createDataFrame([("a", state({"specifications": {"m": ["Acero"], "n": [], "s": "x"}, "description": "<b>d</b>"})), ("b", state({"y": 2})), ("c", wrap("{bad")), ("d", "<p>")], "url string, html string")
    rows = {r.url: (r.descripcion_completa, r.especificaciones) for r in N.enrich_b(base, details).collect()}
    assert rows == {"a": ("<b>d</b>", {"m": "Acero", "n": "[]", "s": "x"}), "b": ("", {}), "c": ("", {"old": "1"}), "d": ("", {"old": "1"}), "e": ("", {"old": "1"})}


def test_enrich_a_and_resume(spark):
    html = '<div class="fb-product-information-tab__copy">one\ntwo</div><table class="specification-table"><tr><td class="property-name"> a </td><td class="property-value">1</td></tr><tr><td class="property-name">b</td></tr></table>'
    base = spark.createDataFrame([("1", "u1", 0), ("2", "u2", 1), ("2", "u3", 2), ("3", "u1", 3)], "sku string, url string, pos int")
    details = spark.createDataFrame([("u1", html), ("u2", html.split("<table")[0])], "url string, html string")
    done = spark.createDataFrame([("3",), ("9",)], "sku string")
    todo = N.pending(base, done, "sku", ["pos"])
    rows = {r.sku: (r.descripcion, r.especificaciones) for r in N.enrich_a(todo, details).collect()}
    assert rows == {"1": ("one two", {"a": "1"}), "2": ("Sin descripción", {})}
    assert N.remaining(base, done).first().remaining == 2
    assert N.append(done, todo).count() == 4


def test_standardize(spark):
    rows = [("1", " tornillo 6x1 5/8 ", 10.0, "u", {"Diámetro": "6mm", "Largo": ""}, None), ("2", "sierra", None, None, None, "x"), ("3", "TIRAFONDO", 1.0, "u", {"Diámetro": "3.5 Milimetros", "Largo": "25mm"}, "<b>zinc</b>&quot;&amp;")]
    df = spark.createDataFrame(rows, "sku string, titulo string, precio_clp double, url string, especificaciones map<string,string>, descripcion_completa string")
    a = {r.sku: r for r in Z.standardize_a(df).collect()}
    assert a["1"].medida_extraida == "6mm" and a["2"].medida_extraida == "Medida no detectada" and a["2"].precio_clp == 0.0 and a["3"].medida_extraida == "3.5 Milimetros x 25mm"
    assert a["1"].texto_embedding == "tornillo 6x1 5/8 Punta Estándar 6mm Construcción general Cabeza Estándar Acero Estándar"
    b = {r.sku: r for r in Z.standardize_b(df).collect()}
    assert set(b) == {"1", "3"} and b["1"].medida_extraida == '6x15/8"' and b["3"].medida_extraida == "3.5mm x 25mm"
    assert b["3"].texto_embedding == "TIRAFONDO - Uso: Construcción general - Cabeza: Cabeza Estándar"
    assert tuple(Z.filter_audit(df).first()) == (3, 2, 1)
    strip = df.select(*[Z.size_from_specs_a(F.lit(d), F.lit(n), F.lit("t")).alias(f"c{i}") for i, (d, n) in enumerate([("6mm", ""), ("", "25mm"), ("", ""), ("x6", "7x")])]).first()
    assert tuple(strip) == ("6mm", "25mm", "Medida no detectada", "6 x 7")


def store(spark, rows):
    df = spark.createDataFrame(rows, "store string, idx int, sku string, titulo string, precio_clp double, url string, medida_extraida string, v array<float>")
    return I.build(df.where("store = 'a'"), "a", F.col("v"), F.col("idx")).union(I.build(df.where("store = 'b'"), "b", F.col("v"), F.col("idx")))


def test_search_and_compare(spark, tmp_path):
    rows = [
        ("a", 0, "s0", "tornillo 6 x 1 caja 100 un", 1000.0, "u", "", [1.0, 0.0]), ("a", 1, "s1", "tornillo 8 x 2 caja 10 un", 500.0, "u", "", [1.0, 0.0]), ("a", 2, "s2", "clavo", 5.0, "u", "", [0.0, 0.0]),
        ("b", 0, "t0", "tornillo 6 x 1 pack 50 un", 400.0, "u", "6mm", [0.9, 0.1]), ("b", 1, "t1", "otro", 400.0, "u", "", None),
    ]
    ix = store(spark, rows)
    I.write(ix, str(tmp_path / "ix"))
    ix = I.read(spark, str(tmp_path / "ix"))
    qs = S.queries(spark.createDataFrame([(1, "Tornillo 6x1", [2.0, 0.0]), (2, "tornillo 77", [1.0, 0.0]), (3, "", [0.0, 0.0])], "query_id long, text string, vec array<double>"))
    top = S.top_candidates(qs, ix)
    got = {(r.query_id, r.store, r.rank): (r.idx, r.score, r.shared) for r in top.collect()}
    assert got[1, "a", 1][:2] == (1, 1.0) and got[1, "a", 2] == (0, 1.0, 4)  # ties of clamped scores: the higher idx first; numbers are shared words too
    assert all(x[1] <= 1 for x in got.values()) and got[3, "a", 1][0] == 2  # zero vectors tie: the higher idx first
    found = {(r.query_id, r.store): r for r in P.answers(qs, ix).collect()}
    assert found[1, "a"].sku == "s0" and found[1, "a"].is_match and found[1, "a"].unit_price == 10.0 and found[1, "b"].unit_price == 8.0
    assert found[2, "a"].number_match == 0 and not found[2, "a"].is_match and found[2, "a"].unit_price is None
    assert {r.query_id: (r.winner, r.saving) for r in P.compare(qs, ix).collect()} == {1: ("b", 2.0), 2: ("none", None), 3: ("none", None)}
    lines = [r.line for r in P.report(P.answers(qs, ix), qs).where("query_id = 1 AND store = 'a'").collect()]
    assert lines == ["TORNILLO 6X1 | a | 100.0% | tornillo 6 x 1 caja 100 un | 100 | $1,000 | $10.0"]
    assert S.top_candidates(qs, ix.limit(0)).count() == 0 and S.top_candidates(qs.limit(0), ix).count() == 0


def test_tie_and_free_products(spark):
    found = spark.createDataFrame([(1, "a", True, 2.0), (1, "b", True, 2.0), (2, "a", True, 0.0), (2, "b", True, 3.0), (3, "a", True, 1.0)], "query_id long, store string, is_match boolean, unit_price double")
    assert {r.query_id: (r.winner, r.saving) for r in P.recommend(found).collect()} == {1: ("tie", 0.0), 2: ("a", 3.0), 3: ("none", None)}


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 2)
    ix = store(spark, [("a", i, str(i), f"t {i}", 1.0, "u", "", [1.0, float(i)]) for i in range(40)])
    qs = S.queries(spark.createDataFrame([(i, "zz", [1.0, float(i)]) for i in range(5)], "query_id long, text string, vec array<double>"))
    top = S.top_candidates(qs, ix, 3).collect()
    assert len(top) == 15 and {r.query_id: r.idx for r in top if r.rank == 1} == {i: i for i in range(5)}


def test_plans(spark):
    ix = store(spark, [("a", 0, "s", "t", 1.0, "u", "", [1.0])])
    qs = S.queries(spark.createDataFrame([(1, "t", [1.0])], "query_id long, text string, vec array<double>"))
    plan = S.top_candidates(qs, ix)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan
    plan = Z.standardize_b(spark.createDataFrame([("tornillo",)], "titulo string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_judge_can_be_learned(spark):
    model = S.learned_judge(S.judge_training(spark))
    test = spark.createDataFrame([(0.95, 1), (0.3, 1), (0.95, 0)], "similitud_texto double, misma_dimension int")
    assert [r.prediction for r in model.transform(test).collect()] == [1.0, 0.0, 0.0]


def test_encoder_runs_in_batches(spark):
    encode = I.encoder(lambda: lambda texts: [[len(t), 1.0] for t in texts])
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r.v for r in df.select(encode(F.col("t")).alias("v")).collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_sources(spark, tmp_path):
    (tmp_path / "in.json").write_text('[{"sku": "1", "titulo": "ñandú"}, {"sku": "2", "precio_clp": 3}]')
    df = files.read_json(spark, str(tmp_path / "in.json"), files.CATALOGUE)
    assert [(r.sku, r.titulo, r.precio_clp) for r in df.collect()] == [("1", "ñandú", None), ("2", None, 3.0)]
    files.write_json(df, str(tmp_path / "out"))
    assert files.read_json(spark, str(tmp_path / "out"), files.CATALOGUE, lines=True).count() == 2
    with pytest.raises(files.MissingInput):
        files.read_json(spark, str(tmp_path / "none.json"), files.CATALOGUE)
    urls = pages.page_urls(spark, "u/first", "u/list?page={n}", 3)
    got = pages.fetch(urls, lambda u: {"u/first": "one"}.get(u) or (_ for _ in ()).throw(ValueError(u)), tasks=2).orderBy("page_no").collect()
    assert [(r.url, r.html) for r in got] == [("u/first", "one"), ("u/list?page=2", None), ("u/list?page=3", None)]
    assert urls.select(pages.page_number(F.col("url"))).collect()[2][0] == 3
    assert pages.details(urls, urls.limit(0).withColumn("html", F.lit("x"))).where("html IS NULL").count() == 3


def test_a_detail_page_met_twice_repeats_no_product(spark):
    base = spark.createDataFrame([(1, "u"), (2, "v"), (3, "w")], "page_id long, url string")
    got = pages.details(base, spark.createDataFrame([("u", "x"), ("u", None), ("u", "y"), ("v", "z")], "url string, html string"))
    assert sorted(map(tuple, got.select("page_id", "html").collect()), key=str) == [(1, "x"), (2, "z"), (3, None)]


def test_details_of_pages_that_share_a_url(spark, tmp_path):
    rows = [(k, "https://s.example/same", f"<p>{k}</p>") for k in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.html_md5 for r in entry.queries()["q_details"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5(html.encode()).hexdigest() if k % 3 != 2 else None for k, _, html in rows}


def test_specifications_ignore_the_session_policy(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    df = spark.sql("SELECT array(named_struct('k', 'a', 'v', '1'), named_struct('k', 'a', 'v', '2')) AS p")
    assert df.select(E.last_wins(F.col("p")).alias("m")).first().m == {"a": "2"}


def test_answers_with_a_learned_judge(spark):
    ix = store(spark, [("a", 0, "s0", "tornillo 6 x 1 caja 100 un", 1000.0, "u", "", [1.0, 0.0]), ("b", 0, "t0", "clavo 9 caja 5 un", 400.0, "u", "", [0.0, 1.0])])
    qs = S.queries(spark.createDataFrame([(1, "tornillo 6x1", [1.0, 0.0])], "query_id long, text string, vec array<double>"))
    model = S.learned_judge(S.judge_training(spark))
    columns = ["store", "sku", "is_match", "unit_price"]
    got = [sorted(map(tuple, P.answers(qs, ix, model=m).select(columns).collect())) for m in (None, model)]
    assert got[0] == got[1] == [("a", "s0", True, 10.0), ("b", "t0", False, None)]


def test_recommendation_lines(spark):
    found = spark.createDataFrame([(1, "a", True, 1002.5), (1, "b", True, 2.25), (2, "a", True, 3.0), (2, "b", True, 3.0), (3, "a", True, 1.0)], "query_id long, store string, is_match boolean, unit_price double")
    qs = spark.createDataFrame([(1, "perno"), (2, "clavo"), (3, "x")], "query_id long, text string")
    assert {r.query_id: r.line for r in P.recommendation(found, qs).collect()} == {1: "PERNO | buy at b | saves $1,000.2 by piece", 2: "CLAVO | same price by piece", 3: None}


def test_a_price_entry_without_price_is_zero(spark):
    df = spark.createDataFrame([([(["12.990"],)],), ([(None,)],), ([],), (None,)], "p array<struct<price: array<string>>>")
    assert [r.x for r in df.select(K.price_a(F.col("p")).alias("x")).collect()] == [12990.0, 0.0, 0.0, 0.0]


def test_a_page_met_twice_repeats_no_product_and_the_first_row_stays(spark):
    base = spark.createDataFrame([("1", "u"), ("1", "v")], "sku string, url string").coalesce(1)
    pages_ = spark.createDataFrame([("u", "<p>"), ("u", "<p>"), ("v", "<p>")], "url string, html string")
    first = N.pending(base, base.limit(0))
    assert [r.url for r in first.collect()] == ["u"] and N.enrich_a(base, pages_).count() == 2 and first.columns == base.columns


def test_pages_are_parsed_before_they_meet_their_products(spark):
    base = spark.createDataFrame([("1", "u"), ("2", "u"), ("3", None), ("4", "w")], "sku string, url string")
    html = '<div class="fb-product-information-tab__copy">d</div><table class="specification-table"><tr><td class="property-name">k</td><td class="property-value">v</td></tr></table>'
    found = N.enrich_a(base, spark.createDataFrame([("u", html), ("x", html)], "url string, html string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("MapInArrow")
    assert {r.sku: (r.descripcion, r.especificaciones) for r in found.collect()} == {"1": ("d", {"k": "v"}), "2": ("d", {"k": "v"}), "3": ("Sin descripción", {}), "4": ("Sin descripción", {})}
