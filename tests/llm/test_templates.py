from tradelens.llm import templates
from tradelens.llm.common import read

PAGES = "page_id long, url string, html string, host string, tokens string"


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{x}}</style></head><body>{body}</body></html>"


def main(spark, pages):
    df = spark.createDataFrame([(i, u, h, "clash", "clash") for i, (u, h) in enumerate(pages)], PAGES)
    return [r.text for r in templates.main_text(df).orderBy("page_id").collect()]


def test_elements(spark):
    cases = [
        (page("<nav><a>menu</a></nav><article><h1>A &amp; B</h1><p>one<br>two  <b>three</b><p>four</article><footer>f</footer>"), "A & B\n\none two three\n\nfour"),
        (page("<header>h</header><main><p>x</p><aside>s</aside><div class='comments'><p>c</p></div><form><p>q</p></form></main>"), "x"),
        (page("<div class='content'><p>no article</p><ul><li>i</li><li>j</li></ul></div><div id='cookie-banner'>eat</div><div class=ad>buy</div>"), "no article\n\ni\n\nj"),
        (page("<article><script>var a='</p><p>no';</script><p>a &lt; b &#x41;&eacute;</p><!-- <p>c</p> --></article>"), "a < b Aé"),
        (page("<p>1 < 2 and <unclosed <b>x</b>"), None),
        ("", ""),
        (None, ""),
        ("plain text", "plain text"),
        (page("<article class='post'><p>kept</p><article class='comment'>no</article></article><div role=navigation>n</div><div hidden>h</div>"), "kept"),
        (page("<article><pre>a\n  b</pre><table><tr><td>c<td>d</table></article>"), "a b\n\nc\n\nd"),
    ]
    got = main(spark, [(None if i % 2 else f"http://h{i}.org/x", h) for i, (h, _) in enumerate(cases)])
    for text, (html, want) in zip(got, cases):
        assert want is None or text == want, html


def test_template_text_goes_and_article_text_stays(spark):
    pages = [("https://Shop.example.com:80/p", page(f"<div><p>Welcome to the shop</p><p>Item {i} is unique {i * 7}</p><p>All rights reserved</p></div>")) for i in range(12)]
    pages += [("https://other.example.com/", page("<div><p>Welcome to the shop</p></div>"))]
    got = main(spark, pages)
    assert got[:12] == [f"Item {i} is unique {i * 7}" for i in range(12)]
    assert got[12] == "Welcome to the shop"


def test_few_pages_share_a_template(spark):
    for n in (2, 7):
        pages = [("http://h.org/", page(f"<div class='x'><p>Welcome</p><p>Story {i} of {n}, told at length</p><p>Imprint</p></div>")) for i in range(n)]
        assert main(spark, pages) == [f"Story {i} of {n}, told at length" for i in range(n)]


def test_same_article_on_many_pages_stays(spark):
    same = page("<article><p>The same story.</p></article>")
    pages = [("http://h.org/", same)] * 9 + [("http://h.org/", page(f"<article><p>Story {i}</p></article>")) for i in range(9)]
    assert main(spark, pages)[:9] == ["The same story."] * 9
    assert main(spark, [("http://h.org/", page("<p>The same story.</p>"))] * 3) == ["The same story."] * 3


def test_two_layouts_and_menus_without_names(spark):
    menu = "<div class='x1'><ul><li><a href='/'>Start</a></li><li><a href='/b'>Part {}</a></li></ul></div>"
    story = [page(menu.format(i) + f"<div class='story'><p>By our staff</p><p>Long story number {i} about thing {i}</p></div>") for i in range(6)]
    other = [page(menu.format(i) + f"<div class='list'><p>All entries</p><p>Entry {i}</p><p>Entry {i + 1} too</p></div>") for i in range(5)]
    got = main(spark, [("http://h.org/", x) for x in story + other])
    assert got[:6] == [f"Long story number {i} about thing {i}" for i in range(6)]
    assert got[6:] == [f"Entry {i}\n\nEntry {i + 1} too" for i in range(5)]


def test_wrappers_and_names_keep_their_text(spark):
    keeps = [
        "<div class='layout has-sidebar'><p>kept</p></div>",
        "<div id='page-with-ads'><p>kept</p></div>",
        "<main><section id='comment-period'><p>kept</p></section></main>",
        "<article><div class='entry-header'><h1>kept</h1></div></article>",
        "<article><p class='related-work'>kept</p></article>",
        "<article><header><h1>kept</h1></header></article>",
        "<div id='page-header-wrap'><article><p>kept</p></article></div>",
        "<div class='comments-off'><div class='ads'><article><p>kept</p></article></div></div>",
        "<div class='social-science ad-free'><p>kept</p></div><div class='siteHeader'>gone</div>",
        "<form id='aspnet'><p>kept</p></form>",
        "<article><p>kept <span class='ad'>buy</span></p></article>",
        "<article><p>kept</p></article><div class='comments'><article><p>reader</p></article></div>",
    ]
    one_each = main(spark, [(f"http://h{i}.org/", page(x)) for i, x in enumerate(keeps)])
    assert one_each == ["kept"] * len(keeps)
    many = main(spark, [(f"http://h{i}.org/", page(x.replace("kept", f"kept {k}"))) for k in range(4) for i, x in enumerate(keeps)])
    assert sorted(many) == sorted(f"kept {k}" for k in range(4) for _ in keeps)
    assert main(spark, [("http://h.org/", page("<article><p>Let <math>x</math> be</p></article>"))]) == ["Let x be"]


def test_article_lines_stay_whatever_other_pages_have(spark):
    recipe = "<article><p>Recipe {}</p><p>Preheat the oven.</p><ul><li>salt</li><li>pepper</li></ul></article><div class='user-reviews'><p>great, {}</p></div>"
    for n in (2, 5):
        got = main(spark, [("http://h.org/", page(recipe.format(i, i))) for i in range(n)])
        assert got == [f"Recipe {i}\n\nPreheat the oven.\n\nsalt\n\npepper" for i in range(n)]


def test_links_of_a_page_are_no_menu(spark):
    menu = "<div class='bar'><ul><li><a href='/'>Start page</a></li><li><a href='/b'>Another part</a></li></ul></div>"
    pages = [page(menu + f"<div class='list'><h2>List {i}</h2><ul><li><a href='/{i}a'>Thing {i} a</a></li><li><a href='/{i}b'>Thing {i} b</a></li></ul></div>") for i in range(6)]
    assert main(spark, [("http://h.org/", x) for x in pages]) == [f"List {i}\n\nThing {i} a\n\nThing {i} b" for i in range(6)]


def test_layout_of_few_pages_is_found_on_a_large_host(spark):
    few = [page(f"<div class='rare'><p>Welcome to this part</p><p>Story {i}, told at length</p></div>") for i in range(4)]
    many = [page(f"<div class='story'><p>Other {i}</p></div>") for i in range(600)]
    for pages in (few, few + many):
        assert main(spark, [("http://h.org/", x) for x in pages])[:4] == [f"Story {i}, told at length" for i in range(4)]


def test_classes_by_brute_force(spark, small):
    from collections import defaultdict

    df = read(spark, small, "pages")
    rows = df.select("url", "html").collect()
    rows += rows[:5]  # repeated rows are one page
    seen = defaultdict(dict)
    hosts = defaultdict(set)
    for r in rows:
        host = r.url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower()
        key, tokens = templates.page_tokens(r.html)
        hosts[host].add(key)
        for t, up, n, *_ in tokens:
            seen[host, t][key] = n
    want = defaultdict(set)
    for (host, t), vector in seen.items():
        want[host, tuple(sorted(vector.items()))].add(t)
    found = templates.equivalence_classes(spark.createDataFrame([(r.url, r.html) for r in rows], "url string, html string")).collect()
    got = defaultdict(set)
    for r in found:
        got[r.host, r.vector].add(r.token)
        assert r.support == len(seen[r.host, r.token])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    for r in found:
        if r.token == templates.PAGE:
            assert r.support == len(hosts[r.host])


def test_template_tokens_are_nested(spark, small):
    df = read(spark, small, "pages")
    known = {r.host: r for r in templates.templates(templates.stored(templates.equivalence_classes(df), "t")).collect()}
    assert known[None].slots and all(r.n_pages >= 2 for r in known.values())
    nav = {templates.token("/html/body/nav/ul"), templates.token("/html/body/nav/ul/li")}  # the items are their own slots where all pages have as many
    assert all(nav & set(r.menus) for r in known.values())
    assert sum(r.n_template_blocks for r in templates.main_text(df).collect()) > 0


def test_whole_table_against_plain_cutting(spark, small):
    import html
    import re

    df = read(spark, small, "pages")
    got = {r.page_id: r for r in templates.main_text(df).collect()}
    for r in df.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1|article)>", body)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert templates.main_text(df.limit(0)).count() == 0


def test_tokens_with_one_occurrence_vector_form_one_class(spark):
    page = lambda body: f"<html><body><div class='top'><p>Site</p></div><div class='text'>{body}</div><p>End</p></body></html>"
    rows = [(1, "http://a.org/1", page("<p>one</p>")), (2, "http://a.org/2", page("<p>two</p><p>three</p>")), (3, "http://a.org/3", page("<ul><li>x</li></ul>")), (4, "http://a.org/4", page("<ul><li>y</li></ul>"))]
    found = templates.classes_of(templates.equivalence_classes(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len({r.vector for r in found}) == len(found)
    of = {m.token: r for r in found for m in r.members}
    every = of[templates.token("/html")]
    same = [templates.token("/html/body"), templates.token("/html/body/div.top/p", "Site"), templates.token("/html/body/p", "End"), templates.PAGE]
    assert every.support == 4 and all(of[t].vector == every.vector for t in same)
    lists = of[templates.token("/html/body/div.text/ul")]
    assert lists.support == 2 and lists.vector == of[templates.token("/html/body/div.text/ul/li")].vector != every.vector
    assert of[templates.token("/html/body/div.text/p")].least == 1 and of[templates.token("/html/body/div.text/p")].most == 2
    assert templates.token("/html/body/div.text/p", "one") not in of
