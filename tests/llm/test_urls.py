"""URL filters: rules against brute force, the model on held-out addresses."""

from pyspark.sql import functions as F

from shelfmark.llm import urls
from shelfmark.llm.queries import QUERIES, URL_RULES

FOLDER = "/root/testdata/sf0.1"


def plain(url):
    """(host, path, rule, ruling) of an address."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[:min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fitting = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fitting, key=lambda r: len(str(r)), default=None)
    return host, path, best and str(best), best and best.verdict


def test_query_follows_the_rules(spark):
    addresses = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = QUERIES["op1_url_filters"](spark, FOLDER).collect()
    assert len(rows) == len(addresses)
    for r in rows:
        host, path, rule, ruling = plain(addresses[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == ruling if rule else r.verdict in ("allow", "block")
    assert {r.rule for r in rows} == {None, *map(str, URL_RULES)}


def test_model_on_held_out_addresses(spark):
    """What the rules say of addresses the model hasn't seen, by their letters alone."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url")
    ruled = urls.with_parts(pages, URL_RULES).where("_ruling is not null")
    model = urls.fit(ruled.where("page_id % 4 <> 0").select("url", F.col("_ruling").alias("label")))
    held = urls.judge(ruled.where("page_id % 4 = 0").select("url", F.col("_ruling").alias("wanted")), [], model)
    assert held.agg(F.avg((F.col("_verdict") == F.col("wanted")).cast("int"))).first()[0] >= 0.95


def test_odd_addresses(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x", "http://example.org", "http://notexample.org/es/",
           "a://b://example.org/es/", "http://x.com/de/?q=/fr/#z", "http://x.com?/de/", "ftp://É.com/fr/é", "http://org/",
           "http://example.org/en/1", "http://example.org/en/12#a", "x\n://y.com/fr/", "http://x.com/fr/" + "a" * 100_000]
    rows = spark.createDataFrame([(i, u, "keep", 1.0) for i, u in enumerate([*odd, odd[4]])], "id int, url string, label string, host double")
    for model in ("block", urls.fit(rows.select("url", F.when(F.col("id") % 2 == 0, "allow").otherwise("block").alias("label")))):
        found = urls.judge(rows, URL_RULES, model)
        assert found.columns == ["id", "url", "label", "host", "_host", "_path", "_rule", "_verdict"]
        for r in found.collect():
            host, path, rule, ruling = plain(r.url)
            assert (r._host, r._path, r._rule) == (host, path, rule)
            assert r._verdict == (ruling or r._verdict) and r._verdict in ("allow", "block")
    assert urls.judge(rows.limit(0), URL_RULES, "allow").count() == 0
    assert urls.fit(rows.limit(0)) == "allow"
    assert urls.fit(rows.select("url", F.lit("block").alias("label"))) == "block"


def test_repeated_addresses_dont_fill_the_sample(spark, monkeypatch):
    """Each address comes 50 times: a sample as large as the different ones still has both labels."""
    monkeypatch.setattr(urls, "SAMPLE", 6)
    rows = [(f"http://{kind}{i}.net/{kind}", kind) for kind in ("allow", "block") for i in range(3)]
    model = urls.fit(spark.createDataFrame(rows * 50, "url string, label string"))
    assert not isinstance(model, str)
