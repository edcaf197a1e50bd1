"""The url model on hosts that it was not trained on, and rules and urls of odd kinds."""

import re

import pytest

from kgspark.llm import urls


@pytest.fixture(scope="module")
def model(spark):
    return urls.fit(urls.training_urls(spark))


def test_hosts_outside_the_table(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = urls.judge(pages, model).where("rule IS NULL").collect()
    known = {*urls.WANTED, *urls.UNWANTED, *urls.invented_names()}
    assert not known & {re.sub(r"^(www|m|blog)\.", "", r.host).split(".")[0] for r in got}
    bad = re.compile("casino|bets|pills|ads-|spam|adult")
    blocked = [r for r in got if r.verdict == "block"]
    right = sum(bool(bad.search(r.host)) for r in blocked)
    assert right >= 0.8 * len(blocked)
    assert right >= 0.9 * sum(bool(bad.search(r.host)) for r in got)


def test_names_are_the_same_in_every_run():
    assert urls.invented_names(5) == urls.invented_names(60)[:5]
    assert len(set(urls.invented_names())) > 55


def test_long_urls_and_rules_of_equal_length(spark, model):
    rows = [(1, "http://a.net/" + "x" * 50_000), (2, "http://" + "casino-online-" * 2000 + ".com/" + "poker/" * 2000), (3, "http://" + "h" * 3000), (4, "http://x.b/p"), (5, None), (6, "")]
    d = spark.createDataFrame([(*r, "host", "path", "block") for r in rows], "page_id long, url string, host string, path string, verdict string")
    got = {r.page_id: r for r in urls.judge(d, model, rules=(("b/", "allow"), ("b/", "block"), ("net/", "block"))).collect()}
    assert got[1].rule == "net/" and len(got[1].path) == 50_001
    assert got[2].verdict == "block" and got[2].rule is None and len(got[3].host) == 3000
    assert (got[4].rule, got[4].verdict) == ("b/", "block")
    assert got[5].host == got[6].host == "" and got[5].verdict == got[6].verdict
    assert urls.judge(d.limit(0), model).count() == 0
