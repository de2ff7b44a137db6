"""op8_url_filter where rules decide a minority of a host's pages."""

from spanloom.llm import url_filter


def test_minority_of_blocked_pages_seeds_distrust(spark):
    link = lambda h: f'<a href="https://{h}/p">x</a>'
    pages = [("http://bad.com/de/1", ""), ("http://bad.com/en/1", ""), ("http://bad.com/en/2", ""), ("http://bad.com/it/3", ""), ("http://farm.net/1", link("bad.com"))]
    pages += [("http://nice.com/fr/1", ""), ("http://nice.com/en/1", ""), ("http://nice.com/en/2", link("kin.net")), ("http://kin.net/1", ""), ("http://far.net/1", "")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    ranks = {r.host: r for r in url_filter.host_ranks(df).collect()}
    assert ranks["bad.com"].distrust > 0 and ranks["farm.net"].distrust > 0 and ranks["nice.com"].trust > 0 and ranks["kin.net"].trust > 0
    got = [r.verdict for r in url_filter.judged(df).orderBy("page_id").collect()]
    assert got == ["block"] * 5 + ["allow"] * 5


def test_mass_is_in_proportion_to_the_ruled_share(spark):
    hosts = spark.createDataFrame([("a", 4, 1), ("b", 2, 2), ("c", 5, 0)], "host string, pages long, block long")
    got = {r.host: r.mass for r in url_filter._seeds(hosts, "block").collect()}
    assert got == {"a": 0.2, "b": 0.8}
