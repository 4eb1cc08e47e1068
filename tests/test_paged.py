"""The paged data source: what it reads, and which pages it asks for."""

import pytest

from priceloom.sources import paged as S


def site(folder, pages, missing=()):
    """Pages as files; every asked page leaves a mark."""
    (folder / "count").write_text(str(pages))

    def get(url):
        n = int(url.rpartition("=")[2]) if "=" in url else 1
        with open(folder / "asked", "a") as f:
            f.write(f"{n}\n")
        if n in missing:
            raise OSError("gone")
        return f"page {n} of " + (folder / "count").read_text()

    return S.Site(get, "http://x/list", "http://x/list?page={n}", lambda html: int(html.rpartition(" ")[2]))


def asked(folder):
    out = sorted(map(int, (folder / "asked").read_text().split())) if (folder / "asked").exists() else []
    (folder / "asked").unlink(missing_ok=True)
    return out


def test_batch(spark, tmp_path):
    S.register(spark, "shop_a", site(tmp_path, 23, missing=(4, 9)))
    df = spark.read.format("shop_a").option("pages_per_task", 5).load()
    rows = {r.page_no: r for r in df.collect()}
    assert sorted(rows) == list(range(1, 24)) and rows[1].url == "http://x/list" and rows[23].url.endswith("=23")
    assert [n for n, r in rows.items() if r.html is None] == [4, 9] and df.rdd.getNumPartitions() == 5


@pytest.mark.parametrize("where, pages", [
    ("page_no BETWEEN 3 AND 6", [3, 4, 5, 6]), ("page_no = 8", [8]), ("page_no IN (2, 9, 90)", [2, 9]), ("page_no > 17 AND url LIKE '%9'", [19]), ("page_no < 1", []), ("page_no = 1", [1]),
    ("page_no > 5 AND page_no < 3", []), ("page_no >= 19", [19, 20]),
])
def test_only_the_pages_that_are_wanted(spark, tmp_path, where, pages):
    S.register(spark, "shop_b", site(tmp_path, 20))
    df = spark.read.format("shop_b").load().where(where)
    assert sorted(r.page_no for r in df.collect()) == pages
    wanted = {n for n in range(1, 21) if n in pages or "LIKE" in where and n > 17}
    assert set(asked(tmp_path)) <= wanted | {1}


def test_pages_cannot_be_counted(spark, tmp_path):
    S.register(spark, "shop_c", site(tmp_path, 5, missing=(1,)))
    assert [tuple(r) for r in spark.read.format("shop_c").load().collect()] == [(1, "http://x/list", None)]


def test_stream_reads_what_has_come_since(spark, tmp_path):
    S.register(spark, "shop_d", site(tmp_path, 3))
    out, kept = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        q = spark.readStream.format("shop_d").load().writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.page_no for r in spark.read.parquet(out).collect())

    assert run() == [1, 2, 3]
    (tmp_path / "count").write_text("7")
    asked(tmp_path)
    assert run() == list(range(1, 8)) and set(asked(tmp_path)) == {1, 4, 5, 6, 7}
    assert run() == list(range(1, 8))
