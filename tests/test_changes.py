"""Table changes, readers and streaming on small fixtures."""

import json

import pytest

from relatrix.operators import tables as T
from relatrix.sources import readers


def test_promote(spark):
    schema = "active_run string, standby_run string, standby_status string"
    ready = spark.createDataFrame([("a", "b", "ready_to_promote")], schema)
    assert tuple(T.promote(ready).first()) == ("b", "a", "cleanup_pending")
    busy = spark.createDataFrame([("a", "b", "ingesting")], schema)
    with pytest.raises(ValueError):
        T.promote(busy)
    assert T.acquire(busy, "c").first().standby_run == "b"
    assert T.acquire(ready, "c").first().standby_run == "c"


def test_upsert_null_key(spark):
    t = spark.createDataFrame([(None, 1, 1), (2, 2, 2)], "k int, a int, b int")
    s = spark.createDataFrame([(None, 9, 9), (3, 3, 3)], "k int, a int, b int")
    got = {tuple(r) for r in T.upsert(t, s, ["k"], ["a"]).collect()}
    assert got == {(None, 9, 1), (2, 2, 2), (3, 3, 3)}


def test_responses(spark, tmp_path):
    d = tmp_path / "00126380"
    d.mkdir()
    (d / "list__1.json").write_text(json.dumps({"endpoint": "list", "status": "ok", "data": {"list": [{"a": "1"}, {"a": "2"}]}}))
    (d / "list__2.json").write_text(json.dumps({"endpoint": "list", "status": "no_data"}))
    (d / "list__3.json").write_text("{broken")
    got = {tuple(r) for r in readers.read_responses(spark, f"{tmp_path}/*/*.json", "a:string").collect()}
    assert got == {("list", "00126380", "1"), ("list", "00126380", "2")}


def test_html_body():
    title, text = readers.html_body("<title> T </title><p>a &amp; b</p><script>x</script><table><tr><td>no</td></tr></table><p>c")
    assert (title, text) == ("T", "a & b\nc")


def test_metadata():
    page = '<html><head><title>T</title><meta property="og:title" content="O &amp; o"><meta property="og:title" content="second"><meta property="og:description" content=""></head><body><p>x'
    linked = '<script type="application/ld+json">{"@type": "Article", "headline": "H", "datePublished": 5}</script><script type="application/ld+json">[1, {"@type": "NewsArticle", "headline": "later", "datePublished": "2024-01-01"}]</script>'
    got = lambda html, url: readers._metadata(readers._read(html), url)
    none = dict.fromkeys(("og_title", "og_desc", "published", "site", "ld_headline", "ld_published"))
    assert got(page + linked, "http://x/20240131") == none | {"og_title": "O & o", "og_desc": "", "ld_headline": "H", "ld_published": "2024-01-01"}  # no digit behind the day
    assert got("", "http://x/202401319")["published"] == "2024-01-31"
    assert got('<meta property="article:published_time" content="2020-02-02">', "http://x/202401319")["published"] == "2020-02-02"
    assert got("<script type='application/ld+json'>{bad</script>", None) == none == got(None, None)
