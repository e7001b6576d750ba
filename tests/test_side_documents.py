from pagechron.sources.side_documents import elements, feed_entries, sitemap_entries

ITEM = "<url><loc>https://h.example/p{}</loc><lastmod>2001-02-03</lastmod></url>"


def test_entries_before_a_fault_stay():
    whole = "<urlset>" + "".join(ITEM.format(k) for k in range(3))
    assert len(elements(whole + "</urlset>", ("url",))) == 3
    assert len(elements(whole + "<url><loc>cut", ("url",))) == 3
    assert len(elements(whole + "</wrong>" + ITEM, ("url",))) == 3
    assert elements("no xml", ("url",)) == elements(None, ("url",)) == elements('<!DOCTYPE a [<!ENTITY x "y">]><url>&x;</url>', ("url",)) == []


def test_stray_ampersands_lose_nothing():
    got = elements("<rss><item><title>a & b&nbsp;c &amp; d</title></item><item><title><![CDATA[x?a=1&b=2]]></title></item></rss>", ("item",))
    assert [e[0].text for e in got] == ["a & b&nbsp;c & d", "x?a=1&b=2"]


def test_long_documents_are_read_whole(spark):
    n = 80_000
    body = "<urlset>" + "".join(ITEM.format(k) for k in range(n)) + "</urlset>"
    assert len(body) > 5 * 1024 * 1024
    docs = spark.createDataFrame([("https://h.example/sitemap.xml", body)], "url string, body string")
    assert sitemap_entries(docs).count() == n
    feed = body.replace("url>", "item>").replace("loc>", "link>").replace("lastmod>", "pubDate>")
    assert feed_entries(docs.selectExpr("url").crossJoin(spark.createDataFrame([(feed,)], "body string"))).count() == n
