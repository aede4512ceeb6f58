import html
import re

from convoylake.llm import html_extract as m

SMALL = "/root/testdata/sf0.01"


def plain(page):
    """Text of the article by regular expressions, for pages of the tables' make."""
    part = re.search(r"(?s)<article>(.*?)</article>", page or "")
    blocks = re.split(r"</?(?:p|h1)>", part[1] if part else "")
    return "\n\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split())))


def test_query_equals_plain_reading(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = m.op1_html_extract(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["url"], r["text"]) == (pages[r["page_id"]]["url"], plain(pages[r["page_id"]]["html"])) and r["n_chars"] == len(r["text"])


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>"<p>no</p>"</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a>no</a></nav>
<div class="cookie-notice">no</div><main><article><header class="entry-header"><h1>Title &amp;amp; &#233;</h1></header><p>One <b>two<br>three <a href='x'>link</a>   four<p>Five<ul><li>a<li>b</ul>
<!-- <p>no</p> --><aside>no</aside><form>no<input></form><table><tr><td>x<td>y</table><div class="comments"><article><p>no</p></article></div></article></main><footer>no</footer><script>no"""


def test_markup():
    assert m.kept_text(m.Page(PAGE).blocks, set()) == "Title &amp; é\n\nOne two three link four\n\nFive\n\na\n\nb\n\nx\n\ny"
    assert m.kept_text(m.Page("a < b &lt; c").blocks, set()) == "a < b < c"
    assert m.kept_text(m.Page("<p>x<style>p{}</style>y</p><div hidden>no</div><div style='display: none'>no</div>").blocks, set()) == "x y"


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(k, f"http://a.example/{k}", f"<body><div class=top><p>Welcome to us</p></div><div class=text><p>Story number {k} is told.</p></div><div class=bottom>Call us</div></body>") for k in range(12)]
    rows += [(100 + k, "http://b.example/", f"<article><p>Same words</p></article><div>other {k}</div>") for k in range(8)]
    rows += [(200, "http://c.example/", "<div><p>alone</p></div>"), (201, None, None), (202, "http://[", ""), (None, "x", "<p>q</p>"), (203, "x", "<p>q</p>"), (203, "x", "<p>q</p>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = {}
    for r in m.extract(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert all(got[k] == [f"Story number {k} is told."] for k in range(12))
    assert all(got[100 + k] == ["Same words"] for k in range(8))
    assert got[200] == ["alone"] and got[201] == [""] and got[202] == [""] and got[None] == ["q"] and got[203] == ["q", "q"]
    assert m.extract(df.limit(0)).count() == 0


def test_class_words():
    def kept(html):
        return m.kept_text(m.Page(html).blocks, set())

    assert kept("<body><div class='page with-sidebar'><p>All the text of this page</p><div class='sidebar'>no</div></div></body>") == "All the text of this page"
    assert kept("<div class=banner><p>Much the larger part of the page</p></div><p>and the rest</p>") == "and the rest"
    assert kept("<div class='banner wide'><p>All that the page has</p></div><nav>no</nav>") == "All that the page has"
    assert kept("<p>Short text</p><div class='comments'>Much longer remarks of readers on it</div>") == "Short text"
    # declared main text stands alone, whatever its length
    assert kept("<div><p>The body of the page, told at some length.</p></div><article>Teaser</article>") == "Teaser"
    assert kept("<article>The body of the page, told at some length.</article><div>By line</div>") == "The body of the page, told at some length."


def test_style_tree_reaches_into_main_text(spark):
    rows = [(k, f"http://d.example/{k}", f"<article><p>Story number {k} is told.</p><p>It goes on for {k} lines.</p><div class=extra><p>Become a member</p></div><p>Read our terms.</p></article>") for k in range(12)]
    rows += [(100 + k, "http://e.example/", "<main><p>The same page</p></main>") for k in range(6)]
    rows += [(200 + k, "http://f.example/", f"<main><p>Story {k}.</p><p>Twice told</p></main>" if k < 3 else f"<main><p>Story {k}.</p></main>") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in m.extract(df).collect()}
    assert all(got[k] == f"Story number {k} is told.\n\nIt goes on for {k} lines." for k in range(12))
    assert all(got[100 + k] == "The same page" for k in range(6))
    assert all(got[200 + k] == (f"Story {k}.\n\nTwice told" if k < 3 else f"Story {k}.") for k in range(9))


def test_noise_longer_than_the_article(spark):
    """A sidebar, notice, footer or advert goes however long it is, with and without a declared main text, in the long pages too."""
    rows, body = [], "The story of this page in fifty letters, and no more."
    for k, noise in enumerate(("sidebar", "cookie-notice", "footer", "advert", "widget box")):
        for n in (20, 5_000):
            long = f"<div class='{noise}'>" + "".join(f"<p>Line {j} of {k}, other words each time {j * 7919 % 10007}.</p>" for j in range(n)) + "</div>"
            for j, page in enumerate((f"<article><p>{body}</p></article>{long}", f"{long}<main><p>{body}</p></main>", f"<div><p>{body}</p></div>{long}", f"{long}<p>{body}</p>")):
                rows.append((100 * k + 10 * (n > 20) + j, f"http://g{len(rows)}.example/", page))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = [(r["page_id"], r["text"]) for r in m.extract(df).collect()]
    assert len(got) == 40 and [x for x in got if x[1] != body] == []
