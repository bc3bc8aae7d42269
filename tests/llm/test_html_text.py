"""Main text of pages: tags, references, templates per host."""

import random
import time
from collections import defaultdict

import pytest

from exonloom.llm.html_text import Page, host_of, main_text

PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/'>home</a></nav>%s<footer>&copy; x</footer></body></html>"


def text(page):
    p = Page(page)
    return p.text(p.subtrees("host")[1])[0]


def test_article_only():
    assert text(PAGE % "<article><h1>A &amp; B</h1><p>one\n  two<br>three<p><b>four</article>") == "A & B\none two three\nfour"
    assert text(PAGE % "<div class='cookie-notice'>ok</div><main><p>x</p><aside>s</aside><form>f</form><section id=comments>c</section></main>") == "x"
    assert text("<article><header><h1>T</h1><span>by me</span></header><p>a</p></article>") == "T\na"
    assert text("<div class='with-sidebar'><article><p>kept</p></article></div>") == "kept"
    assert text("<p>plain &lt;b&gt; &#233;&nbsp;x") == "plain <b> é x"
    assert text("<article><p>a<script>var x='</p>';</script>b</p><!-- c --></article>") == "ab"
    assert text("a < b and <p>c &#99999999999;&#00000000065;&#" + "9" * 6000 + ";</p>") == "a < b and\nc \ufffdA\ufffd"
    assert text("<p title='a>b'>x</p><p a\"b >y</p><p a=\"z>w</p>") == "x\ny\nw"
    assert text(None) == text("") == text("<nav>x</nav>") == ""


def test_hosts():
    assert [host_of(u) for u in ("http://A.b/c", "https://u@x.y:8/z", "//q/r", "rel/path", None)] == ["a.b", "x.y", "q", "", ""]


def test_template_is_removed_per_host_only(spark):
    box = "<div><p>Read our guide</p></div>"
    rows = [(k, f"http://one.example/{k}", f"<body><p>story number {k}</p>{box}</body>") for k in range(8)]
    rows += [(100 + k, f"http://two.example/{k}", f"<body><p>other story {k}</p>{box}</body>") for k in range(2)]
    rows += [(200 + k, "http://one.example/copy", "<article><div><p>same article</p></div></article>") for k in range(9)]
    rows += [(300, None, None), (301, "http://one.example/e", ""), rows[0]]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id bigint, url string, html string, row int, host string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in main_text(df).collect())
    want = {r[0]: f"story number {r[0]}" for r in rows[:8]} | {100 + k: f"other story {k}\nRead our guide" for k in range(2)} | {200 + k: "same article" for k in range(9)} | {300: "", 301: ""}
    assert got == sorted((r[0], want[r[0]], len(want[r[0]])) for r in rows)
    assert main_text(df.limit(0)).count() == 0


def test_near_copies_and_shared_boxes_stay(spark):
    body = "<div><p>one long body of an article</p><p>and its second paragraph</p></div>"
    rows = [(k, f"http://near.example/{k}", f"<article><h1>title {k}</h1>{body}<p>by writer {k}</p></article>") for k in range(6)]
    table = "<table><tr><td>a small table</td></tr></table>"
    long = "a long paragraph that all near copies of an article have in common " * 3
    rows += [(100 + k, f"http://table.example/{k}", f"<article><h1>title {k}</h1><p>{long}</p>{table}</article>") for k in range(6)]
    quote = "<div><p>a quoted box</p></div>"
    rows += [(200 + k, f"http://big.example/{k}", f"<article><p>{'text of page %d ' % k * 5}</p>{quote if k < 6 else ''}</article>") for k in range(200)]
    rows += [(500 + k, f"http://site.example/{k}", f"<article><p>{'words of page %d ' % k * 5}</p>{quote}</article>") for k in range(8)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("one long body" in got[k] and "second" in got[k] for k in range(6))
    assert all("a small table" in got[100 + k] for k in range(6))
    assert all("a quoted box" in got[200 + k] for k in range(6))
    assert not any("a quoted box" in got[500 + k] for k in range(8))


@pytest.mark.parametrize("page", ["<div>x" * 150_000, "<a \"b " * 150_000, "<a b=\"" * 150_000 + "x>y", "<div>" * 80_000 + "</span>" * 80_000, "<" * 300_000, "<ul><li>x" * 80_000, "<b>" * 100_000 + "</p>" * 100_000, "<!--" * 200_000, "<div class='" + "x" * 800_000 + "'>t</div>", "&#" + "9" * 800_000])
def test_hostile_pages_take_time_in_proportion(page):
    began = time.time()
    p = Page(page)
    p.text(p.subtrees("host")[1])
    assert time.time() - began < 5


def test_templates_equal_a_brute_force_count(spark):
    """Boxes outside the article: a box goes by counting if 5 pages of its host that differ in the rest hold it."""
    rng = random.Random(5)
    boxes = [f"box {k} of the site" for k in range(12)]
    rows, held = [], []
    for k in range(120):
        host = f"h{rng.randrange(4)}.example"
        own = sorted(rng.sample(range(12), rng.randrange(4)), key=lambda b: (b % 3, b))
        story = f"story {rng.randrange(60)} " * 8
        # list items in two languages' sections, of which neither a tag nor a class tells anything
        rows.append((k, f"http://{host}/{k}", "<body>" + "".join(f"<section><ul><li>{boxes[b]}</li></ul></section>" for b in own) + f"<article><p>{story}</p></article></body>"))
        held.append((host, own, story.strip()))
    different = defaultdict(set)
    for host, own, story in held:
        for b in own:
            different[host, b].add((tuple(x for x in own if x != b), story))
    want = [sum(len(boxes[b]) for b in own if len(different[host, b]) >= 5) for host, own, _ in held]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for most in (1 << 21, 0):  # hashes broadcast, and joined
        got = {r.page_id: r for r in main_text(df, most_templates=most).collect()}
        assert [got[k].template_chars for k in range(120)] == want
        assert [got[k].text for k in range(120)] == [h[2] for h in held]
    assert sum(want) > 0
    assert sum(got[k].rule_chars for k in range(120)) == sum(len(boxes[b]) for _, own, _ in held for b in own) - sum(want)


def test_joined_templates_equal_broadcast_ones(spark):
    # the menu is more than half of the last page: not counted there, yet template
    menu = "<div>one menu of the site with several words</div>"
    rows = [(k, "http://a.b/", f"<body>{menu}<div>{f'page {k} has its own long text here ' * 9}</div></body>") for k in range(6)]
    df = spark.createDataFrame([*rows, (9, "http://a.b/", f"<body>{menu}<div>short</div></body>")], "page_id bigint, url string, html string")
    one, two = (sorted(map(tuple, main_text(df, most_templates=n).collect())) for n in (1000, 0))
    assert one == two and one[-1][2] == "short"
