import html
import random
import re
import time
from collections import defaultdict

from tidemark.llm import templates
from tidemark.llm._shared import table

PAGES = "page_id long, url string, html string, host long, key string, text string, salt int, n_chars string"


def frame(spark, rows):
    """Pages with columns whose names clash with those that the operator uses."""
    return spark.createDataFrame([(i, u, h, 7, "k", "t", 3, "n") for i, u, h in rows], PAGES).repartition(3)


def texts(rows):
    return {r.page_id: r.text for r in rows.collect()}


def plain(page):
    """The text of pages whose article is marked and holds only headings, paragraphs and inline markup."""
    article = page.partition("<article>")[2].partition("</article>")[0]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", article))
    return "\n".join(b for b in blocks if b)


def test_query_on_the_table(spark, sf_dir):
    pages = {r.page_id: r for r in table(spark, sf_dir, "pages").collect()}
    rows = templates.op11(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = plain(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def site(seed, pages, article):
    """Pages of one site, with what they share and without names that tell what it is; the texts they should give."""
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice("amber basil cedar delta ember fjord grove heath".split()) + str(r.randint(0, 9999)) for _ in range(n))
    top, sides, end, licence = words(5), [words(9) for _ in range(3)], words(6), words(12)
    out = []
    for i in range(pages):
        own = [words(14) for _ in range(r.randint(1, 4))]
        body = [f"<h1>{own[0]}</h1>", *(f"<p>{x}</p>" for x in own[1:])]
        if article:  # passages that articles share are theirs
            body.append(f"<p>{licence}</p>")
            own.append(licence)
        inner = "".join(body)
        inner = f"<article>{inner}<div>{top} {i}</div></article>" if article else f"<div>{inner}</div>"
        page = f"<title>{own[0]}</title><body><div><ul><li>{top}</li><li><b>{r.choice(sides)}</b></li></ul></div>{inner}<div class=x{i}><p>{end} {i}</p></div>"
        out.append((page, "\n".join(own)))
    return out


def brute(rows, least, share):
    """Templates by counting the digests of all pages in a dictionary."""
    contexts, seen = defaultdict(set), defaultdict(lambda: defaultdict(set))
    trees = [(u, templates.Tree(h)) for _, u, h in rows]
    for u, t in trees:
        contexts[u.split("/")[2]].add((t.title, t.heading))
        for e in t.candidates():
            seen[u.split("/")[2]][e.digest].add((t.title, t.heading))
    known = {h: {d for d, c in ds.items() if len(c) >= least and len(c) >= share * len(contexts[h])} for h, ds in seen.items()}
    return [t.text(known.get(u.split("/")[2], set())) for u, t in trees]


def test_templates_of_sites(spark):
    rows, want = [], []
    for host, article in (("a.example", False), ("b.example", True), ("c.example", False)):
        for page, text in site(host, 24, article):
            rows.append((len(rows), f"http://{host}/{len(rows)}", page))
            want.append(text)
    for share in (0.005, 0.2):
        assert brute(rows, 5, share) == want
    pages = frame(spark, rows)
    for broadcast in (templates.BROADCAST, 0):
        got = texts(templates.main_text(pages, broadcast=broadcast))
        assert [got[i] for i in range(len(rows))] == want
    kept = texts(templates.main_text(pages, least=30))
    assert all(len(kept[i]) > len(want[i]) for i in range(24))  # too few pages for a template


def test_copies_are_no_template(spark):
    page, text = site(1, 1, False)[0]
    rows = [(i, f"http://d.example/{i}", page) for i in range(40)]
    got = texts(templates.main_text(frame(spark, rows)))
    assert len(set(got.values())) == 1 and text in got[1]


def test_markup():
    one = lambda page: templates.Tree(page).text(set())
    around = "<nav>menu</nav><header>site</header>{}<aside>more</aside><footer>end</footer>"
    assert one(around.format("<article><header><h1>T&eacute;</h1></header><p>a <b>b</b>\n c&nbsp;d<p>e<br>f<footer>g</footer></article>")) == "Té\na b c d\ne f"
    assert one(around.format("<main><p>x</p><section id=comments><article><p>a long comment of a reader</p></article></section></main>")) == "x"
    assert one(around.format('<div class="has-sidebar"><article><p class="cookie-notice">ok</p><p>x <span class=advert>buy <span>now</span></span>y</p></article></div>')) == "x y"
    assert one("<article><p>x<form><p>name</p></form><script>'</p>'</script><style>p</style><p hidden>h<p style='display: none'>i<p>z") == "x\nz"
    assert one("<nav><ul><li>a<article><p>unclosed menu</p></article>") == "unclosed menu"
    assert one("<p>no article <p><a href=x>only links</a><div role=navigation>y</div>") == "no article"
    assert one("<article class=comment><p>c</article><p>1 < 2 &lt; 3 <4") == "1 < 2 < 3 <4"
    assert one("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table></article>") == "a\nb\nc\nd\n1 2\n3"
    assert one("<article>a<!-- b --><svg><p>c</svg><select>d<p>e") == "ad\ne"
    assert one("") == one("<article></article>") == one("<title>t</title>") == ""


def test_odd_rows(spark):
    page = "<article><p>x &#128512; \x00</p></article>"
    rows = [(1, None, None), (2, "no url", page), (None, "http://h/1", page), (3, "http://h/1", ""), (3, "http://h/1", ""), (4, None, page), (5, "HTTP://User@H:80?q", "<b>" * 3), (6, "http://h/2", "<article>" + "w " * 100_000)]
    for broadcast in (templates.BROADCAST, 0):
        got = [(r.page_id, r.text) for r in templates.main_text(frame(spark, rows), broadcast=broadcast).collect()]
        want = [(1, ""), (2, "x \U0001f600 \x00"), (None, "x \U0001f600 \x00"), (3, ""), (3, ""), (4, "x \U0001f600 \x00"), (5, ""), (6, ("w " * 100_000).strip())]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert templates.main_text(frame(spark, []), broadcast=broadcast).count() == 0


def test_broken_pages_are_linear():
    for part in ("<div>", "<p>", "<li>", "<ul><li>", "</div>", "<b", "<a href='", "<!--", "<nav><article>", "<select>", "<td>x", "&amp", "<span class=ad>"):
        began = time.perf_counter()
        templates.Tree(part * (1_000_000 // len(part))).text(set())
        assert time.perf_counter() - began < 12, part
