"""Wrapper induction against a plain tree matcher, and on hosts of known templates."""

import random
from functools import cache

import pytest

from segmenta.llm import wrapper

SCHEMA = "page_id bigint, url string, html string, text string, host string, template string, __host string"


@pytest.fixture
def pages_of(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "h", "t", "o") for r in rows], SCHEMA)


def texts(pages, **options):
    return {r.page_id: r.text for r in wrapper.extract(pages, **options).collect()}


def prose(seed, n=12):
    rng = random.Random(str(seed))
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(n))


def test_pages(pages_of):
    page = "<html><body><nav><a>Home</a></nav><div class='wrap'><p>Printed by the same press</p><article><h1>Title {0}</h1><p>Body &amp; text  of {0}</p></article></div><footer>end</footer><script>x()</script></body></html>"
    rows = [(k, f"https://a.example/{k}", page.format(prose(k))) for k in range(12)]
    rows += [(100, "https://a.example/n", None), (101, None, "<p>alone</p>"), (102, "https://b.example", ""), (103, "https://b.example", "<p>one<p>two<b>x</b></p>"), (None, "no address", "<p>words")]
    pages = pages_of([*rows, rows[0]])
    got = wrapper.extract(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) + 1
    assert all(text[k] == f"Title {prose(k)}\nBody & text of {prose(k)}" for k in range(12))
    assert (text[100], text[101], text[102], text[103], text[None]) == ("", "alone", "", "one\ntwox", "words")
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrapper.extract(pages.limit(0)).collect() == []


#: Nothing here is declared: only induction can tell the parts.
PLAIN = "<body><div><div>{0}</div><div>Read us daily</div></div><section><p>{1}</p><p>{2}</p></section><div>Made for {3}</div>"


def plain_rows(hosts=("one.example", "two.example"), each=20, menus=4):
    menu = [prose(f"menu {k}", 3) for k in range(menus)]
    return [(100 * h + k, f"http://{host}/{k}", PLAIN.format(menu[k % menus], prose((h, k, 1)), prose((h, k, 2)), host)) for h, host in enumerate(hosts) for k in range(each)]


def test_induction_alone(pages_of):
    """Templates whose texts are constant, rotate or name the host are found without any name; without induction the whole
    page comes out."""
    rows = [*plain_rows(), (900, "http://lone.example/", PLAIN.format(prose("menu 1", 3), prose(7), prose(8), "lone.example"))]
    want = {k: "\n".join((prose((k // 100, k % 100, 1)), prose((k // 100, k % 100, 2)))) for k, *_ in rows[:-1]} | {900: f"{prose(7)}\n{prose(8)}"}
    assert texts(pages_of(rows), names=False) == want
    whole = texts(pages_of(rows), induce=False)
    assert all("Read us daily" in t and "Made for" in t for t in whole.values())


def test_templates_by_join(pages_of, monkeypatch):
    """Beyond the size that is broadcast, pivots and templates are joined by host: the same texts."""
    want = texts(pages_of(plain_rows()))
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", 0)
    assert texts(pages_of(plain_rows())) == want


def test_copies_are_no_template(pages_of):
    """A lone page of many runs, copies and near copies beside other pages, and a true template."""
    runs = "<article>" + "<hr>".join(f"run {k} {prose(k, 4)}" for k in range(12)) + "</article>"
    tail = [prose(f"tail {k}") for k in range(4)]
    page = lambda paragraphs: "<article>" + "".join(f"<p>{t}</p>" for t in paragraphs) + "</article>"
    rows = [(1, "https://lone.example/", runs)]
    rows += [(100 + k, "https://tails.example/", page([prose("long"), prose("same"), *tail])) for k in range(9)]
    rows += [(200 + k, "https://tails.example/", page([prose((k, "short"))])) for k in range(40)]
    near = lambda k: [prose("a", 200), f"{prose('b', 100)} edit {k}", prose("c", 100)]
    rows += [(300 + k, "https://near.example/", page(near(k))) for k in range(12)]
    rows += [(500 + k, "https://shared.example/", f"<p>press</p>{page([prose((k, 'own'))])}") for k in range(30)]
    got = texts(pages_of(rows))
    assert got[1] == "\n".join(f"run {k} {prose(k, 4)}" for k in range(12))
    assert all(got[100 + k] == "\n".join([prose("long"), prose("same"), *tail]) for k in range(9))
    assert all(got[300 + k] == "\n".join(near(k)) for k in range(12))
    assert all(got[500 + k] == prose((k, "own")) for k in range(30))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><div><p>one</p></div><section><p>a longer second part</p></section><table><tr><td>three</table>", "one\na longer second part\nthree"),
        ("<body><p>out</p><article><p>one</p></article><p>out</p><article><p>a longer two</p></article>", "one\na longer two"),
        ("<main><h1>Title</h1><p>lead</p><article><p>story</p></article></main>", "Title\nlead\nstory"),
        ("<article><p>story</p><div class=comments><p>first!</p></div></article>", "story"),
        ("<html><head><title>t</title><meta charset=utf-8><body><p>text</p>", "text"),
        ("<html><head><title>t</title><p>text</p>", "text"),
        ("<head><title>t</title>text", "text"),
    ],
)
def test_slots_keep_all_containers(html, text):
    assert "\n".join(t for _, out, t in wrapper.page_nodes(html)[1] if not out) == text


def brute_match(a, b):
    """Simple tree matching as it is defined, by recursion over nodes."""

    @cache
    def score(x, y):
        if a.tag[x] != b.tag[y]:
            return 0
        rows = [[0] * (len(b.kids[y]) + 1)]
        for i in a.kids[x]:
            row = [0]
            for j, k in enumerate(b.kids[y]):
                row.append(max(rows[-1][j + 1], row[j], rows[-1][j] + score(i, k)))
            rows.append(row)
        return 1 + rows[-1][-1]

    return score(0, 0)


def shape_of(html):
    dom = wrapper.Dom(html)
    return wrapper.Shape(dom.tag, dom.parent)


@pytest.mark.parametrize("cells", [1 << 16, 6])
def test_tree_matching_against_brute_force(monkeypatch, cells):
    rng = random.Random(8)
    parts = ["<p>x</p>", "<div><p>x</p></div>", "<div><p>x</p><ul><li>y</ul></div>", "<h2>z</h2>", "<div><div><h2>z</h2></div><p>x</p><h2>q</h2></div>"]
    monkeypatch.setattr(wrapper, "CELLS", cells)
    for _ in range(30):
        a, b = (shape_of("<body>" + "".join(rng.choices(parts, k=rng.randrange(1, 40)))) for _ in "ab")
        want = brute_match(a, b)
        assert wrapper.match_score(a, b, 0, 0, {}) == want
        to = wrapper.matched(a, b)
        assert len(to) == want == len(set(to.values())) and all(a.tag[x] == b.tag[y] for x, y in to.items())


def test_deep_pages(pages_of):
    deep = lambda n, inner: "<div>" * n + f"<p>{inner}</p>" + "</div><i></i>" * n
    a, b = shape_of(deep(5000, "x")), shape_of(deep(4000, "<b>y</b>"))
    to = wrapper.matched(a, b)
    assert len(to) == wrapper.match_score(a, b, 0, 0, {}) > 4000
    got = texts(pages_of([(1, "http://deep.example/1", deep(5000, "first")), (2, "http://deep.example/2", deep(4000, "<b>second</b>"))]))
    assert got == {1: "first", 2: "second"}
