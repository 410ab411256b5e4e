import re

from pyspark.sql import functions as F

from helixbag.llm import url_filter as U
from helixbag.llm.queries import RULES

URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/1", "http://example.org/en/12?x=1#y", "http://org/",
    "http://org", "https://www.b.com/fr/9/?utm_source=feed&b=2&a=1", "http://b.com/fr/9?a=1&b=2", "http://x.com/de/#top",
    "http://notexample.org/es/", "mailto:x://y.com/fr/?q://z", "http://c.net?p", "http://c.net/?ref=a&p", "http://É.Net/Ä\nb",
]


def test_rules_and_parts(spark):
    docs = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([(None,), ("",)], "url string")
    got = {r.page_id: r for r in U.judge(docs, none, RULES).collect()}
    for i, url in enumerate(URLS):
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1] if url and "://" in url else "")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want)


def test_listed_urls_exactly(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.net/p{i}") for i in range(5000)], "page_id long, url string")
    listed = pages.where("page_id % 7 = 0").select(F.concat("url", F.lit("/?utm_medium=x#z")).alias("url"))
    rows = U.judge(pages.union(pages.where("page_id < 20")), listed, []).collect()
    assert len(rows) == 5020 and all((r.verdict == "block") == (r.page_id % 7 == 0) for r in rows)


def test_the_filter_passes_few(spark):
    listed = spark.range(2000).select(F.concat(F.lit("a"), "id").alias("url"))
    asked = spark.range(20000).select(F.concat(F.lit("b"), "id").alias("url")).union(listed)
    blocks = 2000 * U.BITS_PER_URL // 512
    tested = U.pass_bloom(asked, "url", U.bloom(listed, "url", blocks), blocks)
    assert tested.where("_passed and url like 'a%'").count() == 2000
    assert tested.where("_passed and url like 'b%'").count() < 200


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none, none, RULES).count() == 0
