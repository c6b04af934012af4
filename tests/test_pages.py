from __future__ import annotations

from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from ledgerlens.operators import pages as P

SCHEMA = "page_id bigint, url string, html string"


def stored(spark, rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows, start=1)], SCHEMA)


def test_links_are_resolved_like_a_browser(spark):
    base = "https://Host.example.com/a/b/page.html?x=1#frag"
    hrefs = ["/root", "next", "./same", "../up", "../../top", "?q=2", "", "#here", "//cdn.example.com/x", "http://Other.example.com/Y#z"]
    hrefs += ["c/../d?r=/../s", "/a/./b/../c", "mailto:a@b.c", "javascript:void(0)", "tel:1"]
    page = "".join(f'<p><a class="k" href="{h}">t{i}</a>' for i, h in enumerate(hrefs))
    links = P.page_links(stored(spark, [(base, page)])).orderBy("link_pos").collect()
    assert [r["href"] for r in links] == hrefs and [r["anchor"] for r in links] == [f"t{i}" for i in range(len(hrefs))]

    def resolved(href):
        if href.split(":")[0] in ("mailto", "javascript", "tel"):
            return None
        url = urldefrag(urljoin(base, href)).url
        scheme, rest = url.split("//", 1)
        host, _, path = rest.partition("/")
        return f"{scheme}//{host.lower()}/{path}"

    assert [r["url"] for r in links] == [resolved(h) for h in hrefs]


def test_link_markup_variants(spark):
    html = """<A data-href="no" HREF='/one'>公司 <b>简介</b>
      </A><a href=/two>x&amp;y</a><a name="n">no link</a><area href="/no"><a title="t" href = "/th&amp;ree">
      3</a>"""
    links = P.page_links(stored(spark, [("http://h.x/", html)])).orderBy("link_pos").collect()
    assert [(r["href"], r["anchor"]) for r in links] == [("/one", "公司 简介"), ("/two", "x&y"), ("/th&ree", "3")]


def test_foreign_and_attachment_links_are_dropped(spark):
    hrefs = ["/a", "http://h.x/b.html", "http://other.x/c", "/d.PDF", "/e.zip?v=1", "/f.jpeg", "/pdf", "mailto:x@h.x"]
    html = "".join(f'<a href="{h}">x</a>' for h in hrefs)
    links = P.followable(P.page_links(stored(spark, [("http://h.x/", html)])))
    assert {r["href"] for r in links.collect()} == {"/a", "http://h.x/b.html", "/pdf"}


def test_targets_are_distinct_ranked_and_limited(spark):
    names = ["经典案例", "公司简介", "业务领域", "新闻", "经典案例二", "业务领域"]
    html = "".join(f'<a href="/{i}">{n}</a>' for i, n in enumerate(names)) + '<a href="/0">业务领域</a><a href="/1#x">公司简介</a>'
    targets = P.top_targets(P.page_links(stored(spark, [("http://h.x/", html), ("http://h.x/2", html)])))
    got = [(r["url"], r["module"], r["place"]) for r in targets.orderBy("place").collect()]
    assert got == [
        ("http://h.x/0", "业务领域", 1),
        ("http://h.x/2", "业务领域", 2),
        ("http://h.x/5", "业务领域", 3),
        ("http://h.x/1", "公司简介", 4),
    ]


def test_clean_markup(spark):
    html = "<html><SCRIPT>var a='<p>';</SCRIPT ><style>p{}</style><nav>menu<br></nav><!-- c\n --><p>a&nbsp;b &lt;i&gt;&amp;lt;</p>\n<footer>f</footer> 　c"
    frame = spark.createDataFrame([(html,)], "h string")
    assert frame.select(P.clean_markup(F.col("h"))).first()[0] == "a b <i>&lt; c"


def test_host_evidence_and_company_info(spark):
    rows = [
        ("http://a.x/", "<title>首页</title><a href='/p1'>业务领域</a><p>home</p>"),
        ("http://a.x/p1", "<title>t</title><p>old</p>"),
        ("http://a.x/p1#again", "<title>t</title><p>business</p>"),
        ("http://a.x/about", "<title>公司简介</title>"),
        ("http://a.x/other", "<title>新闻</title><p>news</p>"),
        ("http://b.x/other", "<title>新闻</title><p>news</p>"),
        ("http://c.x", "<p> </p>"),
    ]
    pages = stored(spark, rows)
    evidence = P.host_evidence(pages, P.page_links(pages))
    got = {r["host"]: (r["stored_pages"], r["used_pages"], r["evidence"]) for r in evidence.collect()}
    assert got == {"a.x": (5, 3, "t business 公司简介 首页 业务领域 home"), "b.x": (1, 0, ""), "c.x": (1, 1, "")}
    assert {r["host"]: r["evidence"] for r in P.host_evidence(pages, max_chars=4, max_pages=1).collect()}["a.x"] == "公司简介"

    companies = spark.createDataFrame(
        [("甲", "http://A.x/about"), ("乙", ""), ("丙", "www.gone.x"), ("丁", "http://b.x"), ("戊", "http://c.x/")],
        "query_name string, website_url string",
    )
    info = {r["query_name"]: r for r in P.from_websites(companies, evidence).collect()}
    assert {k: r["error"] for k, r in info.items()} == {
        "甲": "", "乙": "官网链接缺失", "丙": "官网无法访问", "丁": "官网证据不足", "戊": "官网证据不足",
    }
    assert info["甲"]["success"] and info["甲"]["business_scope"].startswith("t business") and info["甲"]["source"] == "website"


def test_first_entered_link_counts(spark):
    rows = [("s", 2, "甲"), ("s", 3, "甲 http://second.x"), ("s", 4, "甲 http://third.x"), ("r", 9, "甲 http://first.x"), ("r", 1, "乙")]
    entries = spark.createDataFrame(rows, "source_id string, row_number bigint, company_raw string")
    got = {r["query_name"]: r["website_url"] for r in P.company_websites(entries).collect()}
    assert got == {"甲": "http://first.x", "乙": ""}


def test_page_memo_keeps_the_newest(spark):
    rows = [(1, "HTTP://A.x/P#1", "<p>old</p>", 1), (2, "http://a.x/P", "<p>new</p>", 2), (3, "http://a.x/p", "<p>else</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, at int")
    memo = {r["url"]: (r["fetched_at"], r["text"], r["error"]) for r in P.page_memo(pages, "at").collect()}
    assert memo == {"http://a.x/P": (2, "new", ""), "http://a.x/p": (1, "else", "")}
