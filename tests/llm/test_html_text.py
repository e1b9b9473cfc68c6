import os
import re
import time
from collections import defaultdict

import pytest

from matrixloom.llm import html_text as H

CASES = [
    (None, ""),
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>a<p>b  \n c<br>d", "a\nb c d"),
    ("<p><b>bold<br><p>next", "bold\nnext"),
    ('<script>var t="</p><p>no";</script><style>p{}</style><p>yes</p><!-- <p>no --><p>too', "yes\ntoo"),
    ("<nav><ul><li>menu</ul></nav><header>top</header><main><header><h1>T</h1></header><p>x</main><aside>s</aside><footer>f</footer>", "T\nx"),
    ("<div class='ad'>buy</div><div id=cookie-notice>ok?</div><form>q<input></form><p>text</p><div role=alert>!</div><div hidden>h</div>", "text"),
    ("<article><p>main</p><section class=comments><article class=comment><p>first!</p></article></section></article>", "main"),
    ("<div class='page has-sidebar'><article><p>kept</p></article></div>", "kept"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>tail", "a\nb\nc\ntail"),
    ("<p>a < b and 3 &lt; 4 &#8364; &nope; x&nbsp;y", "a < b and 3 < 4 € &nope; x y"),
    ("<p title='a>b'>q</p><p title=\"open>r</p>", "q\nr"),
    ("<p>cut <a href='x", "cut"),
    ("<p>un<i>br</i>oken <span>sp</span>an</p>", "unbroken span"),
    ("</p></div><p>x</article></b>y", "xy"),
    ("<title>T</title><body><p>only", "only"),
    ("<p>" + "long " * 50_000, ("long " * 50_000).strip()),
    ("<div>" * 3000 + "deep", "deep"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_extract(page, text):
    assert H.extract(page, lambda keys: [k for k in keys if k % 2]) == text  # as if every name recurred


@pytest.mark.parametrize(
    "page,text",
    [
        ('<article><p class="share-price">Shares rose.</p><p>Body.</p></article>', "Shares rose.\nBody."),
        ('<article><div class="print-edition"><p>From the paper.</p></div><p>Body.</p></article>', "From the paper.\nBody."),
        ("<div><p>" + "A long story goes on. " * 9 + "</p></div><article><p>teaser</p></article>", ("A long story goes on. " * 9).strip() + "\nteaser"),
    ],
)
def test_no_more_than_templates_goes(page, text):
    assert H.extract(page) == text == H.extract(page, lambda keys: [k for k in keys if k % 2])


def test_a_name_alone_deletes_nothing():
    page = "<article><p>Body.</p></article><div class='ad'>buy</div>"
    assert H.extract(page) == "Body.\nbuy" and H.extract(page, lambda keys: keys) == "Body."


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "</b>" * 60_000 + "x", "<article>" * 40_000 + "x", "<li><div>" * 30_000 + "x", "<p>" * 60_000 + "</span>" * 60_000 + "x", "<a href='" * 60_000 + "x"])
def test_hostile_pages_take_no_square_of_time(page):
    began = time.process_time()
    H.extract(page, lambda keys: keys)
    assert time.process_time() - began < 30


def site(spark, pages):
    return spark.createDataFrame([(i, u, h, "z", "t") for i, u, h in pages], "page_id long, url string, html string, host string, text string").repartition(3)


SHELL = "<html><body><div><div>Read our other stories today and tomorrow</div><div><p>{}</p><p>Shared line.</p></div><div><span>All about this house</span></div></div></body></html>"


def test_templates_go(spark):
    pages = [(i, f"https://A.example.org:80/{i}", SHELL.format(f"Story number {i} tells of many things that happened")) for i in range(12)]
    pages += [(100 + i, "http://b.example.org/", SHELL.format("Alone here, with words enough to be a story")) for i in range(2)]
    pages += [(200, None, None), (201, "nonsense", ""), (None, "http://b.example.org/x", "<p>no id"), (5, "https://a.example.org/5", pages[5][2])]
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in H.extract_pages(site(spark, pages)).collect()}
    own = "Story number 3 tells of many things that happened\nShared line."  # a text block where half of the text is stays
    assert got[3, "https://A.example.org:80/3"] == (own, len(own))
    assert got[100, "http://b.example.org/"][0].startswith("Read our other stories")
    assert got[200, None] == ("", 0) and got[201, "nonsense"] == ("", 0) and got[None, "http://b.example.org/x"] == ("no id", 5)


def test_copies_of_an_article_stay(spark):
    page = "<nav>m</nav><article><h1>One</h1><p>The same words.</p><div>Share this with friends</div></article><div>Sign here</div>"
    pages = [(i, f"http://c.example.org/{i}", page) for i in range(10)]
    assert {r["text"] for r in H.extract_pages(site(spark, pages)).collect()} == {"One\nThe same words."}
    same = [(i, "http://c.example.org/", page) for i in range(10)]  # one page, repeated
    assert {r["text"] for r in H.extract_pages(site(spark, same)).collect()} == {"One\nThe same words.\nShare this with friends\nSign here"}


def test_copies_without_an_article_stay(spark):
    page = "<div><a href=/>Home of all things</a></div><div class=wrap><p>The same words, once more.</p><p>And again the same words.</p></div>"
    pages = [(i, f"http://d.example.org/{i}", page) for i in range(10)]
    assert {r["text"] for r in H.extract_pages(site(spark, pages)).collect()} == {"The same words, once more.\nAnd again the same words."}


def test_hosts(spark):
    from pyspark.sql import functions as F

    urls = ["http://U:p@Www.X.org:8/a//b", "//x.org/p", "x.org/p", None, "https://y.org?q=http://z.org"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(H.host(F.col("u"))).collect()] == ["www.x.org", "x.org", "", "", "y.org"]


def test_empty(spark):
    assert H.extract_pages(site(spark, [])).count() == 0


def slow_twin(pages):
    """Texts by a plain dict of pages for each host and key."""
    holds, where = defaultdict(set), defaultdict(set)
    for _, u, h in pages:
        host = (re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", u or "") or [0, ""])[1].lower()
        where[host].add((u, h))
        for k in H.subtrees(h):
            holds[host, k].add((u, h))
    hosts = defaultdict(set)
    for host, k in holds:
        hosts[k].add(host)
    out = []
    for i, u, h in pages:
        host = (re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", u or "") or [0, ""])[1].lower()
        least = max(H.MIN_PAGES, H.MIN_SHARE * len(where[host]))
        out.append((i, H.extract(h, lambda keys, host=host, least=least: [k for k in keys if len(holds[host, k]) >= least or k % 2 and len(hosts[k]) >= H.MIN_HOSTS])))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [H.BROADCAST_KEYS, 0])
def test_against_counting_by_hand(spark, most):
    """With the templates broadcast, and with pages joined to theirs."""
    pages = [(i, f"http://h{i % 7}.org/{i}", f"<nav>n</nav><div class='ad-box'>buy {i}</div><div>Always here {i % 7}</div><article><p>Story {i} of many words and more.</p></article><div id=poll>{i}</div>") for i in range(60)]
    pages += [(90 + i, "http://h1.org/0", pages[1][2]) for i in range(20)] + [(None, None, None)]
    got = sorted(((r["page_id"], r["text"]) for r in H.extract_pages(site(spark, pages), most).collect()), key=str)
    assert got == slow_twin(pages)
    assert dict(got)[8] == "Story 8 of many words and more.\n8"


def test_the_tables_pages(spark):
    d = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(d):
        pytest.skip("no tables here")
    df = spark.read.parquet(d)
    pages = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    got = dict((r["page_id"], r["text"]) for r in H.extract_pages(df).collect())
    assert sorted(got.items(), key=str) == slow_twin(pages)
    changed = sum(H.extract(h) != got[i] for i, _, h in pages)
    article = {i: H.extract("<article" + h.partition("<article")[2].partition("<footer")[0]) for i, _, h in pages}
    assert changed == len(pages) and got == article  # every page has an advert, which only its recurring name gives away
