"""Feeds, sanctions lists, rates and the source registry, from small files."""

from pyspark.sql import functions as F

from tradewind.sources import feeds, registry, sanctions


def now():
    return F.expr("timestamp_ntz'2024-02-01 00:00:00'")

RSS = """<?xml version="1.0" encoding="utf-8"?><rss version="2.0"><channel><title>t</title>
<item><guid>a1</guid><title>Port &amp; rail</title><link>/n/1?utm_source=x&amp;k=2</link><description>&lt;p&gt;Two &lt;b&gt;ships&lt;/b&gt; , late&lt;/p&gt;</description><pubDate>Mon, 15 Jan 2024 10:00:00 +0200</pubDate></item>
<item><title>Ahead of time</title><link>https://o.example.com/2</link><pubDate>Fri, 15 Mar 2030 10:00:00 GMT</pubDate></item>
<item><title>No link</title></item></channel></rss>"""

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e1</id><title>Steel</title><link href="https://s.example.com/a"/><content>Body</content><updated>2024-01-10T08:00:00Z</updated></entry></feed>"""

LIST = """<?xml version="1.0" encoding="UTF-8"?><export xmlns="urn:x">
<sanctionEntity euReferenceNumber="EU.1" designationDate="2020-01-01"><nameAlias wholeName="Weak Name" strong="false"/><nameAlias wholeName="Strong  One" strong="true"/><nameAlias wholeName="Weak Name" strong="false"/><regulation numberTitle="R 1"/><subjectType code="enterprise"/></sanctionEntity>
<sanctionEntity euReferenceNumber="EU.1" designationDate="2022-05-05"><nameAlias wholeName="Strong One" strong="true"/></sanctionEntity>
<sanctionEntity euReferenceNumber="EU.2" designationDate="2021-01-01"><nameAlias wholeName="Some Person"/><subjectType code="person"/></sanctionEntity></export>"""


def saved(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_rss(spark, tmp_path):
    rows = feeds.read_rss(spark, saved(tmp_path, "a.xml", RSS), "https://f.example.com/feeds/all.xml", now()).orderBy("position").collect()
    assert [r.title for r in rows] == ["Port & rail", "Ahead of time"]
    first, second = rows
    assert first.provider_article_id == "a1" and first.article_url == "https://f.example.com/n/1?utm_source=x&k=2" and first.canonical_url == "https://f.example.com/n/1?k=2"
    assert first.description == "Two ships, late" and str(first.published_at) == "2024-01-15 08:00:00"
    assert second.provider_article_id == "https://o.example.com/2" and str(second.published_at) == "2024-02-01 00:00:00" and second.description is None


def test_atom(spark, tmp_path):
    (row,) = feeds.read_atom(spark, saved(tmp_path, "a.xml", ATOM), "https://s.example.com/feed", now()).collect()
    assert (row.provider_article_id, row.article_url, row.description, str(row.published_at)) == ("e1", "https://s.example.com/a", "Body", "2024-01-10 08:00:00")


def test_sanctions(spark, tmp_path):
    path = saved(tmp_path, "l.xml", LIST)
    assert sanctions.unsafe_files(spark, path).count() == 0
    found = sanctions.designations(spark, path)
    rows = {r.designation_id: r for r in found.collect()}
    one = rows["eu-sanctions:EU.1:2020-01-01"]
    assert one.names == ["Strong One", "Weak Name"] and one.is_entity and not one.is_update and "R 1" in one.description
    assert rows["eu-sanctions:EU.1:2022-05-05"].is_update and not rows["eu-sanctions:EU.2:2021-01-01"].is_entity
    articles = sanctions.as_articles(found, 2).orderBy("provider_article_id").collect()
    assert [a.title for a in articles] == ["EU sanctions designation: Strong One", "EU sanctions designation update: Strong One"]


def test_unsafe_files(spark, tmp_path):
    saved(tmp_path, "a.xml", '<?xml version="1.0"?><!DOCTYPE x [<!ENTITY y "z">]><a/>')
    saved(tmp_path, "b.xml", "<a/>")
    assert [r.reason for r in sanctions.unsafe_files(spark, str(tmp_path)).collect()] == ["document type declaration"]


def test_json_feeds(spark, tmp_path):
    news = saved(tmp_path, "n.json", '{"articles": [{"source": {"id": null, "name": "S"}, "title": "T", "description": "D", "content": "C", "url": "https://a.example.com", "publishedAt": "2024-01-10T08:00:00Z"}, {"title": null, "url": "https://b.example.com"}]}')
    (row,) = feeds.read_news_json(spark, news, now()).collect()
    assert (row.title, row.source_name, row.language, str(row.published_at)) == ("T", "S", "en", "2024-01-10 08:00:00")
    gdelt = saved(tmp_path, "g.json", '{"articles": [{"title": "T", "url": "https://a.example.com", "seendate": "20240110T080000Z", "domain": "a.example.com", "language": "English"}]}')
    (row,) = feeds.read_gdelt_json(spark, gdelt, now()).collect()
    assert (row.source_name, row.language, str(row.published_at)) == ("a.example.com", "english", "2024-01-10 08:00:00")


def test_rates(spark, tmp_path):
    want = [("2024-01-02", "USD", 1.1), ("2024-01-03", "USD", 1.2)]
    for text in (
        '{"base": "EUR", "rates": {"2024-01-02": {"USD": 1.1}, "2024-01-03": {"USD": 1.2}}}',
        '[{"date": "2024-01-02", "base": "EUR", "quote": "usd", "rate": 1.1}, {"date": "2024-01-03", "base": "EUR", "quote": "USD", "rate": 1.2}]',
    ):
        rows = feeds.read_rates(spark, saved(tmp_path, "r.json", text)).collect()
        assert sorted((str(r.date), r.currency, r.rate) for r in rows) == want
    (row,) = feeds.read_rates(spark, saved(tmp_path, "r.json", '{"base": "EUR", "date": "2024-01-02", "rates": {"GBP": 0.9}}')).collect()
    assert (str(row.date), row.currency, row.rate) == ("2024-01-02", "GBP", 0.9)


def test_catalog_is_valid(spark):
    catalog = registry.catalog(spark)
    assert registry.violations(catalog).count() == 0 and registry.enabled(catalog).count() == 8
