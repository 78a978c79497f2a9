"""Elements, clean texts, sections, panels and cards of single pages."""

from tallyloom.functions.elements import Tree, elements
from tallyloom.operators import panels


def clean(html):
    t = Tree(html)
    gone = t.noise()
    return t.title(), t.lines([t.main(t.masses(gone))], gone)


LONG = "Kampanya metni burada uzun uzun anlatılır. " * 10


def test_elements_nest_as_their_tags_say():
    t = Tree("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table><p>x<p>y<div>z</div></b>")
    at = {(tag, t.text(k)): (k, t.last[k]) for k, tag in enumerate(t.tag)}
    assert ("li", "a") in at and ("li", "bc") in at and ("td", "1") in at and ("tr", "12") in at and ("tr", "3") in at and ("p", "x") in at and ("p", "y") in at
    assert all(t.parent[k] < k <= t.last[k] and (t.parent[k] < 0 or t.last[k] <= t.last[t.parent[k]]) for k in range(len(t.tag)))


def test_frames_go_unless_they_hold_the_content():
    assert clean(f"<body><nav>Menü</nav><header>Baş</header><p>{LONG}</p><aside>Yan</aside><footer>Alt</footer></body>")[1] == LONG.strip()
    assert clean(f"<body><nav>{LONG}</nav><p>kısa</p></body>")[1].startswith("Kampanya metni")
    assert "kabul" not in clean(f'<body><div class="x Cookie-bar">kabul et</div><div id="popup1">kabul</div><p>{LONG}</p></body>')[1]
    assert clean(f"<body><form><p>{LONG}</p><button>Gönder</button><select><option>x</select></form></body>")[1] == LONG.strip()


def test_main_content_must_be_a_share_of_the_page():
    assert clean(f"<body><p>önce</p><main><p>{LONG}</p></main></body>")[1] == LONG.strip()
    assert clean(f"<body><main>Uygulamayı indir</main><div>{LONG}</div></body>")[1].startswith("Uygulamayı indir\n\nKampanya") or "Kampanya" in clean(f"<body><main>Uygulamayı indir</main><div>{LONG}</div></body>")[1]
    assert clean(f'<body><div class="a kampanya-detay">{LONG}</div><div role="main">az</div>x</body>')[1] == LONG.strip()
    assert clean(None or "") == ("", "")


def test_lines_and_tables():
    assert clean("<body><p>Bir <b>iki</b>, üç</p><ul><li>a<li>b</ul><table><tr><th>Vade</th><th></th><th>Oran</th></tr><tr><td>12 ay</td><td>%1,89</td></tr></table>son</body>")[1].replace("\n\n", "\n") == "Bir iki , üç\na\nb\nVade | Oran\n12 ay | %1,89\nson"


def test_titles():
    assert clean("<title>t</title><h1>{{ ad }}</h1><h1>Kampanya Koşulları</h1><h2>Asıl Ad</h2>")[0] == "Asıl Ad"
    assert Tree("<h1>Örnek Bankası</h1><h1>Kampanya</h1>").title(frozenset({"ornek bankasi"})) == "Kampanya"
    assert clean('<meta property="og:title" content=" Paylaşılan "><title>t</title><h1>x</h1>')[0] == "Paylaşılan"
    assert clean("<title> Sayfa  adı </title>")[0] == "Sayfa adı"


def sections(html, *words):
    return [t for _, t in Tree(html).sections(list(words)) if t]


def test_sections():
    assert sections("<h2>Kampanya Koşulları</h2><ul><li>a<li>b</ul><p>c</p><h2>Son</h2><p>d</p>", "koşul") == ["a\nb\n\nc"]
    assert sections("<div><p><strong>KOŞULLAR:</strong></p><ul><li>a</ul></div>", "koşul") == ["a"]
    assert sections("<div><div><div><div><b>koşul</b></div></div></div></div><p>dışarıda</p>", "koşul") == []  # farther up than it may climb
    assert sections("<h2>koşul</h2><h2>koşul iki</h2><p>x</p>", "koşul") == ["x"]


FEES = """<ul class="nav nav-pills"><li><a href="#t1">Konut Finansmanı</a><li><a href="#t2">Başka</a></ul>
<div id="t1"><button class="custom-accordion__title" data-target="#p1">Konut (0-10.000.000 TL'ye kadar)*</button><div id="p1"><table>
<tr><td>Tahsis Ücreti</td><td></td><td>0,5 %</td><td></td><td>0,5 %</td><td>x</td></tr>
<tr><td>Kâr oranı (1-60 ay vade)</td><td></td><td>3,19 %</td><td></td><td>3,29 %</td><td>Not</td></tr><tr><td>Kâr Oranı</td><td></td><td>-</td><td></td><td>3,5</td><td></td></tr>
<tr><td>Kâr oranı</td><td>az hücre</td></tr><tr><td>Kâr oranı</td><td></td><td>-</td><td></td><td>-</td><td></td></tr></table></div>
<button class="custom-accordion__title" data-target="#p2">Ücretler</button><div id="p2"><table><tr><td>Ekspertiz</td><td></td><td>1</td><td></td><td>1</td><td></td></tr></table></div></div>
<div id="t2"><button class="custom-accordion__title" data-target="#p3">Öbür</button><div id="p3"><table><tr><td>Kâr oranı</td><td></td><td>9</td><td></td><td>9</td><td></td></tr></table></div></div>"""


def test_fee_panels(spark):
    pages = spark.createDataFrame([(1, FEES), (2, None), (3, "<p>x</p>")], "page_id long, html string")
    rows = panels.fee_products(panels.fee_rates(elements(pages, "page_id", "html"), "page_id"), "page_id").collect()
    assert len(rows) == 1  # no product of fees alone, of an unknown tab, of a page without panels
    r = rows[0]
    assert (r.panel, r.product_type, r.name, float(r.amount_min), float(r.amount_max)) == (1, "konut_finansmani", "Konut (0-10.000.000 TL'ye kadar)*", 0, 10_000_000)
    assert [(x.term_months, x.term_label, float(x.rate)) for x in r.rates] == [(60, "1-60 ay vade", 3.19), (None, None, 3.5)]
    assert r.rates[0].evidence == "Kâr oranı (1-60 ay vade) — Asgari 3,19 %, Azami 3,29 %. Not"


def test_cards(spark):
    html = """<div><ul><li class="item-content"><a href="/k/1">Bir</a><span class="item-category">Market</span></li>
    <li class="item-content"><div class="item-content"><a href="/k/2">İki</a></div><span class="item-category"> </span><span class="campaign-date">31.12.2026</span></li><li><a href="/k/1">yine</a><a href="/x">x</a></li></ul></div>"""
    pages = spark.createDataFrame([(1, html), (2, "")], "page_id long, html string")
    rows = panels.cards(elements(pages, "page_id", "html"), "page_id", "/k/", "item-content", {"category": "item-category", "ends": "campaign-date"})
    assert {(r.url, r.text, r.category, r.ends) for r in rows.collect()} == {("/k/1", "Bir", "Market", "31.12.2026"), ("/k/2", "İki", None, "31.12.2026")}
    alone = panels.cards(elements(pages, "page_id", "html"), "page_id", "/k/", "item-content", {"ends": "campaign-date"}, levels=1)
    assert {(r.url, r.ends) for r in alone.collect()} == {("/k/1", None), ("/k/2", None)}  # farther boxes hold other cards, too


def test_cards_and_panels_join_by_number(spark):
    """Elements of many equal values are small files of many rows: none of their joins is a broadcast or meets all pairs of a page."""
    card = '<li><div class="item-content"><a href="/k/{0}-{1}">x</a></div><span class="item-category">c{0}-{1}</span></li>'
    pages = spark.createDataFrame([(i, "<div><div><div><ul>" + "".join(card.format(i, k) for k in range(300)) + "</ul></div></div></div>") for i in range(20)], "page_id long, html string")
    found = panels.cards(elements(pages, "page_id", "html", tags=("a", "span")), "page_id", "/k/", "item-content", {"category": "item-category"}, levels=2)
    rates = panels.fee_rates(elements(spark.createDataFrame([(1, FEES)], "page_id long, html string"), "page_id", "html"), "page_id")
    for df in (found, rates):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r.url, r.category) for r in found.collect()} == {(f"/k/{i}-{k}", f"c{i}-{k}") for i in range(20) for k in range(300)}


def test_elements_come_in_batches(spark):
    pages = spark.createDataFrame([(i, "<p><b><a href='/x'>t</a></b></p>" * 30_000) for i in range(2)], "page_id long, html string").coalesce(1)
    out = elements(pages, "page_id", "html", tags=("a",))
    assert out.count() == 60_000 and out.filter("tag <> 'a'").isEmpty() and out.selectExpr("max(size(above))").first()[0] == 2


def test_plain_markup_is_read_as_by_the_standard_parser():
    from html.parser import HTMLParser

    from tallyloom.functions.markup import Markup

    def told(parser, page):
        class Told(parser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.out = []
                self.feed(page)
                self.close()

            def handle_starttag(self, tag, attrs):
                self.out.append((tag, tuple(attrs)))

            def handle_endtag(self, tag):
                self.out.append(("/", tag))

            def handle_data(self, data):
                self.out.append(data)

        return Told().out

    pages = [
        "", "x &amp; y", FEES, '<!DOCTYPE html><P Class="a&lt;b" id="1" id="2">a<b>c</b>&nbsp;&am</P>', "<script>var a='</p>';</script>x<style>p</style >y", "<script>x", "a < b<p>c", "<a href=x>y</a>z", '<a href="x"b="y">', "<!-- a-b --><p>x<!-- c -->y</p x>z", "<p", "a<p>&quo", "<br/>x</>",
    ]
    for page in pages:
        assert told(Markup, page) == told(HTMLParser, page)


def test_rows_of_a_table_know_their_cells_and_named_elements_around(spark):
    page = '<div id="d"><table><tr><td>a <b>1</b></td><th>h</th><td></td></tr><tr><td><table><tr><td>in</td></tr></table></td></tr></table></div>'
    found = elements(spark.createDataFrame([(1, page)], "page_id long, html string"), "page_id", "html", tags=("tr",), named=True).filter("tag = 'tr'").orderBy("pre")
    assert [(r["cells"], r["above"]) for r in found.collect()] == [(["a 1", ""], [0]), (["in"], [0]), (["in"], [0])]


NESTED = """<ul class="x nav-pills"><li><a href="#a">Konut Finansmanı</a><li><a href="#b">Taşıt  Finansmanı</a><li><a href="#a">Taşıt Finansmanı</a></ul><a href="#c">Konut Finansmanı</a>
<div id="a"><button class="custom-accordion__title" data-target="#r1">Bir (0-5.000 TL)</button><div id="b"><button class="custom-accordion__title" data-target="r1">İki</button><button class="custom-accordion__title"> </button>
<button class="custom-accordion__title" data-target="#none">Yok</button></div></div><div id="c"><button class="custom-accordion__title" data-target="#r1">Üç</button></div>
<div id="r1"><table><tr><td>KÂR ORANI (3-12 ay)<td>x<td>%2<td>x<td>-<td>n</tr><tr id="r1"><th>Kâr oranı</th><td>Kâr oranı</td><td></td><td>4 %</td><td></td><td>5</td><td>m</td></tr></table></div>"""


def test_panels_are_told_where_a_page_is_parsed(spark):
    """Nothing is written, sorted or joined by element, and the rows are those of the joins."""
    pages = spark.createDataFrame([(1, FEES), (2, None), (3, "<p>x</p>"), (4, NESTED)], "page_id long, html string")
    rates = panels.page_fee_rates(pages, "page_id", "html")
    plan = rates._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("MapInArrow") == 1
    assert sorted(map(str, rates.collect())) == sorted(map(str, panels.fee_rates(elements(pages, "page_id", "html"), "page_id").collect()))
    assert {(r.panel, r["name"], float(r.rate)) for r in rates.filter("page_id = 4").collect()} == {(n, name, rate) for n, name in ((1, "Bir (0-5.000 TL)"), (2, "İki"), (4, "İki")) for rate in (2, 4)}  # a button in two panes is a panel of each


def test_fee_panels_joins_no_elements(spark, sf):
    from tallyloom.plans import registry

    plan = registry.QUERIES["fee_panels"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_leaves_in_a_row_are_elements_as_others_are():
    class Plain(Tree):
        def handle_leaf(self, tag, attrs, text):
            self.handle_starttag(tag, attrs)
            if text:
                self.handle_data(text)
            self.handle_endtag(tag)

        def handle_leaves(self, tag, texts):
            for text in texts:
                self.handle_leaf(tag, [], text)

    told = lambda t: (t.tag, t.attrs, t.parent, t.last, t.first_piece, t.end_piece, t.pieces)
    pages = [
        FEES, NESTED, "<table><tr><td>1</td><td>2</td><td></td><td>&lt;4</td>x</table>", "<td>1<td>2</td><td>3</td><td>4</td>", "<Td>1</Td><Td>2</Td>", "<td>1</td><TD>2</TD><td>3</TD>", "<p>a<p>b</p><p>c</p><p>d</p>", "<br>a</br><br>b</br>x", "<svg><i>a</i><i>b</i></svg><i>c</i><i>d</i>",
        "<script>a</script><script>b</script>c", '<li class="x">a</li><li>b</li><li>c</li>', "<b></b><b></b>", "<i>a</i><i>b</i><i>c<u>d</i>",
    ]
    for page in pages:
        assert told(Tree(page)) == told(Plain(page)), page
