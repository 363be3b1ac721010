import os
import random
import tracemalloc

import pytest

from cardinia.llm import html_wrappers as hw
from cardinia.llm import skew

SCHEMA = "page_id long, url string, html string, host string, wrapper string, id long"


def shop(i, paragraphs, article=True, comments=True, title=True):
    """A page of one template: the main part under article, or only in an anonymous div."""
    body = "".join(f"<p>Text {i} of <b>para</b>graph {k} &amp; more&nbsp;\n words</p>" for k in range(paragraphs))
    inner = (f"<h1>Title {i}</h1>" if title else "") + body
    more = f"<section class='post-comments'><p>Reader {i} says hello</p></section>" if comments else ""
    start, end = ("<article>", "</article>") if article else ('<div id="x1"><div>', "</div></div>")
    return (
        f"<html><head><title>T{i}</title><script>var a='<p>no</p>';</script><style>p{{}}</style></head><body><header><p>Shop of {i}</p></header>"
        f"<nav><ul><li>Home</li><li>About {i}</li></ul></nav><div class='cookie-notice'>We use cookies</div><!-- <p>gone</p> -->"
        f"{start}{inner}<form><label>Name</label><button>Send</button></form><p class=share>Share {i}</p>{more}{end}"
        f"<aside><p>Other news {i}</p></aside><div class='ad'>Buy {i}</div><footer>&copy; {i}</footer></body></html>"
    )


def wanted(i, paragraphs, title=True):
    return "\n".join([f"Title {i}"] * title + [f"Text {i} of paragraph {k} & more words" for k in range(paragraphs)])


def extracted(pages):
    w = hw.page_wrapper(pages[0])
    for p in pages[1:]:
        w = hw.aligned(w, hw.page_wrapper(p))
    rules = hw.decisions(w)
    return w, [hw.main_text(p, rules) for p in pages]


@pytest.mark.parametrize("article", [True, False])
def test_main_text(article):
    counts = [1, 3, 5, 2, 4, 3]
    _, texts = extracted([shop(i, n, article, comments=i % 2 == 0) for i, n in enumerate(counts)])
    assert texts == [wanted(i, n) for i, n in enumerate(counts)]


def test_repeated_and_optional_groups():
    w, _ = extracted([shop(1, 1, title=False), shop(2, 4), shop(3, 2)])
    by = {x[0]: x for x in w[1]}
    paragraphs, title = by[("/html/body/article/p",)], by[("/html/body/article/h1",)]
    assert paragraphs[1] and not paragraphs[2] and paragraphs[3] == 3
    assert title[2] and not title[1]
    cookies = by[("/html/body/div.cookie.notice",)]
    assert cookies[4][0][1] != hw.VARIABLE and paragraphs[4][0][1] == hw.VARIABLE


def test_groups_of_several_blocks_repeat():
    page = "<body><main>" + "".join(f"<h2>h{i}</h2><p>p{i}</p>" for i in range(5)) + "</main></body>"
    _, items = hw.page_wrapper(page)
    assert [x[:2] for x in items] == [[("/body/main/h2", "/body/main/p"), True]]


def test_inference_decides():
    """Without <article>, a page alone cannot tell the template's text from its own; with the host's wrapper it can."""
    note = "<div class=zq><p>This site collects stories of the sea and of those who sail it.</p></div>"
    pages = [f"<body>{note}<div class=zr><h1>T{i}</h1><p>Body text {i}</p></div>{note}</body>" for i in range(5)]
    assert extracted(pages)[1] == [f"T{i}\nBody text {i}" for i in range(5)]
    alone = [hw.main_text(p, hw.decisions(hw.page_wrapper(p))) for p in pages]
    assert all(t.startswith("This site") for t in alone)


def test_teasers_are_not_the_article():
    """<article> cards beside the text: the variable slots tell that these are not what the pages are about."""
    card = "<article class=card><h3>Card {0}</h3></article>"
    pages = ["<body><div class=zr><h1>T{0}</h1><p>{1}</p></div><div class=zs>{2}</div></body>".format(i, f"long text {i} " * 40, "".join(card.format(f"{i}-{k}") for k in range(3))) for i in range(4)]
    assert all(f"long text {i} long text {i}" in t for i, t in enumerate(extracted(pages)[1]))


def brute(pages):
    """Of templates in which every block has a path of its own: what is under the lowest element that holds every path with more than one text."""
    texts: dict[str, set] = {}
    for p in pages:
        for path, text in hw.blocks(p):
            texts.setdefault(path, set()).add(text)
    variable = [p.split("/") for p, t in texts.items() if len(t) > 1]
    region = os.path.commonprefix(variable) if len(variable) > 1 else variable[0][:-1]
    return ["\n".join(t for path, t in hw.blocks(p) if path.split("/")[: len(region)] == region) for p in pages]


@pytest.mark.parametrize("seed", range(40))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    count = rng.randint(2, 9)

    def tree(depth):
        """A template: ("p", name, kind) or ("div", name, children)."""
        name = f"z{rng.getrandbits(40):x}".translate(str.maketrans("0123456789", "ghijklmnop"))
        if depth == 0 or rng.random() < 0.3:
            return "p", name, rng.choice(["fixed", "own", "own", "mostly"])
        return "div", name, [tree(depth - 1) for _ in range(rng.randint(1, 4))]

    def html(node, i):
        kind, name, inner = node
        if kind == "div":
            return f"<div class={name}>{''.join(html(c, i) for c in inner)}</div>"
        if inner == "mostly" and i == 1:
            return ""
        return f"<p class={name}>{'text' if inner == 'fixed' else f'text {i}'} of {name}</p>"

    template = ("div", "root", [tree(3), tree(2), ("p", "last", "own")])
    pages = [f"<body>{html(template, i)}</body>" for i in range(count)]
    if any("mostly" in str(template) for _ in pages) and count < 4:
        pages = [f"<body>{html(template, i)}</body>" for i in (2, 3, 4)]  # what one page alone has is not known to be the template's
    assert extracted(pages)[1] == brute(pages)


@pytest.mark.parametrize("seed", range(30))
def test_alignment(seed):
    """A common subsequence in rising order, and the longest where the paths of a page differ."""
    rng = random.Random(seed)
    wide = seed % 2
    x, y = ([[(str(v),)] for v in (rng.sample(range(60), 40) if wide else rng.choices(range(6), k=40))] for _ in range(2))
    found = hw._matches(x, y)
    assert all(x[i] == y[j] for i, j in found)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:], strict=False))
    if wide:
        length = [[0] * 41 for _ in range(41)]
        for i in range(40):
            for j in range(40):
                length[i + 1][j + 1] = length[i][j] + 1 if x[i] == y[j] else max(length[i][j + 1], length[i + 1][j])
        assert len(found) == length[40][40]


def test_long_pages_of_unlike_blocks():
    """100,000 blocks without a common path: aligned in linear memory, and the wrapper stays bounded."""
    def page(i):
        return "<body><div class=main>" + "".join(f"<p class=q{i}x{''.join(chr(97 + int(d)) for d in str(k))}>block {i} {k}</p>" for k in range(100_000)) + "</div></body>"

    tracemalloc.start()
    pages = [page(c) for c in "rs"]
    w, texts = extracted(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [t.count("\n") for t in texts] == [99_999] * 2
    assert peak < 600 << 20
    assert len(w[1]) <= hw._ITEMS


@pytest.mark.parametrize("body", [
    "<div class=content><h1>{h}</h1><p>{p}</p><ul><li>{l}</li></ul></div>", "<div class=content><p>{p}</p><blockquote><p>{l}</p></blockquote></div>",
    "<div class=intro><p>{p}</p></div><div class=text><p>{l}</p></div>", "<h1>{h}</h1><div class=content><p>{l}</p></div>",
    "<div class=content>{p}<p>{l}</p></div>",
])
@pytest.mark.parametrize("pages", [1, 2, 6])
def test_without_article_no_variable_text_is_lost(body, pages):
    parts = [{"h": f"Title {i}", "p": f"words {i} " * 60, "l": f"more {i} " * 170} for i in range(pages)]
    menu, end = "<nav><p>Home</p></nav>", "<footer>End</footer>"
    _, texts = extracted([f"<html><body>{menu}{body.format(**p)}{end}</body></html>" for p in parts])
    order = sorted((k for k in "hpl" if f"{{{k}}}" in body), key=lambda k: body.index(f"{{{k}}}"))
    assert texts == ["\n".join(p[k].strip() for k in order) for p in parts]


def test_without_article_a_block_of_one_page_stays():
    pages = [f"<body><p>Site</p><div class=x><p>Text {i}</p><h2>Part {i}</h2></div>{'<div class=y><p>Only here</p></div>' * (i == 3)}</body>" for i in range(6)]
    texts = extracted(pages)[1]
    assert texts[3].endswith("Text 3\nPart 3\nOnly here") and texts[2].endswith("Text 2\nPart 2")


def test_alignment_does_not_depend_on_the_split():
    pages = [shop(i, random.Random(i).randint(1, 4), comments=i % 3 == 0) for i in range(9)]
    whole = extracted(pages)[0]
    parts = [extracted(pages[i::3])[0] for i in range(3)]
    merged = hw.aligned(hw.aligned(parts[0], parts[1]), parts[2])
    assert hw.decisions(whole) == hw.decisions(merged) and whole[0] == merged[0] == 9


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a < b &lt; c</p>", "a < b < c"), ("<article><p>one<p>two<br>three</article>", "one\ntwo three"),
    ("<article><p>open <b>bold<p>next", "open bold\nnext"), ("<article><p>cut <a hre", "cut"), ("<nav><p>menu</p></nav>", ""), ("<article><p title='a > b'>x</p><!-- y", "x"),
    ("<ARTICLE><P>upper</P></ARTICLE>", "upper"), ("<article><script>if (a<b) {</article>", ""), ("<article></p></div><p>&eacute;&#233;&nbsp;z</p></article>", "éé z"),
])
def test_odd_markup(page, text):
    assert hw.main_text(page, hw.decisions(hw.page_wrapper(page))) == text


KEPT = [
    "<section id='discussion'>x</section>", "<h2 id='related-work'>x</h2>", "<h2 id='reply-rates'>x</h2>", "<div id='social-policy'>x</div>", "<p class='alert-level'>x</p>",
    "<div id='discussion'>x</div>", "<p id='comments'>x</p>", "<div class='share-price'>x</div>", "<div class='no-sidebar'>x</div>", "<section class='banner-year'>x</section>",
]
GONE = [
    "<ul class='comment-list'><li>x</li></ul>", "<div class='share-buttons'>x</div>", "<div class='related-posts'><p>x</p></div>", "<p class=share>x</p>", "<section class='post-comments'>x</section>",
    "<div class='lead ad-slot'>x</div>", "<div id='disqus_thread'>x</div>", "<div id=comment-list>x</div>", "<section class='comments-section'>x</section>", "<div role=navigation>x</div>", "<form>x</form>",
]


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize(("part", "kept"), [*((p, True) for p in KEPT), *((p, False) for p in GONE)])
def test_names_inside_the_article(part, kept, tag):
    page = f"<body><nav>Home</nav><{tag}><p>start</p>{part}<p>end</p></{tag}></body>"
    assert hw.main_text(page, hw.decisions(hw.page_wrapper(page))) == ("start\nx\nend" if kept else "start\nend")


def test_ids_of_headings_outside_articles():
    page = "<body><div class=content><h2 id='related-work'>x</h2><p>end</p></div><div id=comments>no</div></body>"
    assert hw.main_text(page, hw.decisions(hw.page_wrapper(page))) == "x\nend"


def test_rows(spark, monkeypatch):
    rows = [(i, f"https://{'hot' if i % 2 else 'h' + str(i % 5)}.example.com/a/{i}?q", shop(i, i % 4 + 1), "h", "w", 3) for i in range(40)]
    rows += [(40, None, None, None, None, None), (41, "", "", None, None, None), (42, "nothing", "<p>alone</p>", None, None, None), rows[3], (None, "//x.org/a", shop(9, 30_000), None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = sorted(((r[0], r[1], wanted(r[0], r[0] % 4 + 1) if r[0] is not None and r[0] < 40 else {42: "alone", None: wanted(9, 30_000)}.get(r[0], "")) for r in rows), key=str)
    monkeypatch.setattr(skew, "LEAST", 10)  # so that one host is hot
    for sent in (hw.SENT, 0):  # regions sent to every task, and joined by host
        out = hw.extract(df, sent=sent).collect()
        assert sorted(((r.page_id, r.url, r.text) for r in out), key=str) == want
        assert all(r.n_chars == len(r.text) for r in out)
    assert hw.extract(df.limit(0)).count() == 0


def test_constant_text_of_articles_stays_for_any_number_of_pages(spark):
    page = "<body><nav><p>Home</p></nav><article><h2>Abstract</h2><h1>T{0}</h1><p>Body text number {0}, quite long.</p></article></body>"
    rows = [(100 * n + i, f"https://h{n}.example.com/{i}", page.format(i), None, None, None) for n in (1, 4, 5, 9) for i in range(n)]
    for sent in (hw.SENT, 0):
        out = hw.extract(spark.createDataFrame(rows, SCHEMA), sent=sent).collect()
        assert {r.page_id: r.text for r in out} == {r[0]: f"Abstract\nT{r[0] % 100}\nBody text number {r[0] % 100}, quite long." for r in rows}
