from sketchgraph.operators import crawl, links, robots
from sketchgraph.sources.pages import ConstantFetcher, TableFetcher

FAR = "so many words lie between one thing and the next " * 2
PAGE = f"""<html><a href="/menu">chess menu</a><P class=big>not a plain one</P><p>
On boards: <a href="/play">chess</a> for all. {FAR} <a href="/far">a long way off</a> {FAR}
see <a href="/near">the rules </a> and their knight moves. {FAR}
<a href="/left">left</a> by the old rook again. {FAR} <a>no href</a> <a href="https://a.org">out</a><a href="#top">up</a>
<a href="/file:b">file</a> <a href="MY/page">me</a> <a href="//host">host</a> <a href='/quoted'>one</a> <a href="/unclosed"> <a href="/chess/2">two</a> <a href="/play">once more</a> <a href="/none"></a>
"""
KEYWORDS = ["Chess", "end game", "rook", "knight"]


def found(spark, page, **options):
    pages = spark.createDataFrame([("my/Page", page)], "url string, html string")
    return [(r["href"], round(r["weight"], 6)) for r in links.extract_links(pages, KEYWORDS, **options).orderBy("weight", "seq", ascending=[False, True]).collect()]


def test_links(spark):
    got = found(spark, PAGE)
    # from "rules" to "knight" it is three words, from "left" to "rook" four; the empty link lies at -1, three before the first keyword
    assert got == [("/play", 1.0), ("/chess/2", 1.0), ("/near", 0.2), ("/none", 0.2), ("/left", round(1 / 6, 6)), ("/far", 0.0)]
    assert ("MY/page", 0.0) in found(spark, PAGE, drop_self=False)
    assert {w for _, w in found(spark, PAGE, topic_sensitive=False)} == {0.0}
    assert found(spark, None) == found(spark, "<a href='/x'>x</a>") == []


def test_robots(spark):
    lines = ["User-agent: x", "Disallow: /no", "USER-AGENT: *", "Disallow: /wiki/Talk:", "Allow: /", "disallow:/w/", "User-agent: *bot", "Disallow: /all", "User-agent: *", "Disallow:"]
    df = spark.createDataFrame([*enumerate(lines)], "line_no int, line string")
    assert [r[0] for r in robots.disallowed_prefixes(df).collect()] == ["/wiki/Talk:", "/w/", ""]
    standard = [r[0] for r in robots.disallowed_prefixes(df, standard=True).collect()]
    urls = spark.createDataFrame([("/wiki/Tennis",), ("/wiki/Talk:x",)], "url string")
    assert [r[0] for r in urls.select(robots.is_disallowed(urls.url, standard)).collect()] == [False, True]
    assert not urls.select(robots.is_disallowed(urls.url, [])).head()[0]


def test_crawl(spark):
    html = {
        "/a": '<p><a href="/b">x</a> <a href="/c">good</a> <a href="/bad">good</a>',
        "/b": '<p><a href="/a">x</a> <a href="/d">good</a>',
        "/c": '<p><a href="/d">x</a> <a href="/c">me</a>',
        "/d": "<p>none",
    }
    pages = spark.createDataFrame([*html.items()], "url string, html string")
    seen, edges = crawl.crawl("/a", pages, ["good"], 3, prefixes=["/bad"])
    assert [r["url"] for r in seen.orderBy("seq").collect()] == ["/a", "/c", "/b"]
    assert [(r["src"], r["dst"]) for r in edges.orderBy("seq").collect()] == [("/a", "/c"), ("/a", "/b"), ("/c", "/c"), ("/b", "/a")]
    seen, _ = crawl.crawl("/a", pages, [], 9, topic_sensitive=False)
    assert [r["url"] for r in seen.orderBy("seq").collect()] == ["/a", "/b", "/c", "/bad", "/d"]
    assert crawl.crawl("/none", pages, [], 9)[1].isEmpty()


def test_crawl_fetches_the_front_of_the_queue(spark):
    asked = []

    class Site:
        def fetch(self, urls):
            asked.append(sorted(r["url"] for r in urls.collect()))
            rows = [(u, f'<p><a href="/{int(u[1:]) * 2}">x</a> <a href="/{int(u[1:]) * 2 + 1}">y</a>') for u in asked[-1]]
            return spark.createDataFrame(rows, "url string, html string")

    seen, edges = crawl.crawl("/1", Site(), [], 7, prefixes=["/3"], spark=spark)
    assert [r["url"] for r in seen.orderBy("seq").collect()] == ["/1", "/2", "/4", "/5", "/8", "/9", "/10"]
    assert asked[0] == ["/1"] and not any(u.startswith("/3") for urls in asked for u in urls) and edges.count() == 6


def test_rules_by_host(spark):
    lines = [("a", 0, "User-agent: *"), ("a", 1, "Disallow: /x"), ("b", 0, "User-agent: z"), ("b", 1, "Disallow: /"), ("c", 0, "User-agent: *"), ("c", 1, "Disallow:")]
    rules = robots.rules_by_host(spark.createDataFrame(lines, "host string, line_no int, line string"), standard=True)
    urls = spark.createDataFrame([("a", "/xy"), ("a", "/y"), ("b", "/xy"), ("c", "/xy"), ("d", "/xy"), (None, "/xy")], "host string, path string")
    assert {(r["host"], r["path"]) for r in robots.flag_disallowed(urls, rules).where("disallowed").collect()} == {("a", "/xy")}


def test_fetchers(spark):
    urls = spark.createDataFrame([("/a",), ("/x",)], "url string")
    pages = TableFetcher(spark.createDataFrame([("/a", "hi")], "url string, html string"))
    assert {tuple(r) for r in pages.fetch(urls).collect()} == {("/a", "hi"), ("/x", None)}
    assert ConstantFetcher("c").fetch(urls).where("html = 'c'").count() == 2
