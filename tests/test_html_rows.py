"""Rows of pages against the standard library's parser, and the contract of scraped tables."""

import random
from html.parser import HTMLParser

import pytest

from loomcat.sources import html_rows


class Plain(HTMLParser):
    """Cells of well-formed tables without nesting."""

    def __init__(self):
        super().__init__()
        self.out, self.row, self.column, self.cell = [], -1, 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row, self.column = self.row + 1, 0
        elif tag in ("td", "th"):
            self.cell = [self.row, self.column, "", None]
            self.column += 1
            self.out.append(self.cell)
        elif tag == "a" and self.cell and self.cell[3] is None:
            self.cell[3] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell and self.lasttag not in ("script", "style"):
            self.cell[2] += data


def plain(html):
    p = Plain()
    p.feed(html)
    p.close()
    return [(r, c, " ".join(t.split()), link) for r, c, t, link in p.out]


def page(seed):
    rng = random.Random(seed)
    bits = ["x", " y\n", "&amp;", "&lt;b&gt;", "&eacute;", "&#8212;", "é", "<b>b</b>", "<!-- <td> no -->", "<br>", "<br/>", "<a href='/a?x=1&amp;y=2' class=c>l</a>", '<A CLASS="k" HREF="/q">m</A>', "<a href=/u>n</a>", "<a name=x>o</a>", "a > b", "<img alt='</td>' src=z>"]
    rows = []
    for _ in range(rng.randint(0, 5)):
        row = "".join(f"<{t} a='1'>{''.join(rng.choice(bits) for _ in range(rng.randint(0, 5)))}</{t.upper()}>" for t in rng.choices(["td", "th"], k=rng.randint(0, 4)))
        rows.append(f"<tr class=\"r\">\n{row}</tr>")
    return f"<!DOCTYPE html><html><head><title>t</title><style>td{{x:1}}</style><script>var t='<td>';</script></head><body>out<table>{''.join(rows)}</table>after</body></html>"


@pytest.mark.parametrize("seed", range(80))
def test_well_formed_pages(seed):
    assert html_rows.cells(page(seed)) == plain(page(seed))


def test_unclosed_nested_and_odd():
    cells = html_rows.cells
    assert cells("<table><tr><td>a<td>b<tr><th>c</table>d") == [(0, 0, "a", None), (0, 1, "b", None), (1, 0, "c", None)]
    nested = "<table><tr><td>a<table><tr><td><a href=x>in</a></td></tr></table>b</td><td>c</td></tr></table>"
    assert cells(nested) == [(0, 0, "ab", None), (1, 0, "in", "x"), (0, 1, "c", None)]
    assert cells("<tr><td>a < b &nope; &amp;amp;</td><td>") == [(0, 0, "a < b &nope; &amp;", None), (0, 1, "", None)]
    assert cells("<td>no row</td>") == cells(None) == cells("") == cells("<tr></tr>") == []
    assert cells("<tr><td><script>x='</td><td>'</script>y<!-- open") == [(0, 0, "y", None)]
    assert cells("<ul><li><a href='/1'>One</a><li>Two</ul><ul><li>Three</ul>", ("ul",), ("li",), ()) == [(0, 0, "One", "/1"), (0, 1, "Two", None), (1, 0, "Three", None)]
    long = "<table>" + "<tr><td>x</td><td><a href='y'>z</a></td></tr>" * 20_000
    assert len(cells(long)) == 40_000


def row(*texts, link="/d"):
    return "<tr>" + "".join(f"<td>{'<a href=' + link + '>' if i == 1 and link else ''}{t}</a></td>" for i, t in enumerate(texts)) + "</tr>"


def test_contract_of_tables(spark):
    head = "<tr><th>No</th><th>Name</th><th>Room</th></tr>"
    pages = [
        (1, "<table>" + row("intro") + head + row("1", "Law", "A") + row("2", "Sea") + row("3", "Map", "B", link=None) + row("4", "", "") + "</table>"),
        (2, "<table><tr><th>No</th><th>Room</th><th>Name</th></tr>" + row("1", "A", "Law") + "</table>"), (3, "<p>maintenance</p><table>" + row("x") + "</table>"), (4, None),
    ]
    found = html_rows.page_cells(spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, html string, text string, row int"))
    good, bad = html_rows.records(found, ("No", "Name", "Room"), linked="Name")
    assert sorted(map(tuple, good.collect())) == [(1, 2, "1", "Law", "A", "/d"), (1, 5, "4", "", "", "/d")]
    assert sorted(map(tuple, bad.collect()), key=str) == sorted([(1, 3, "number of cells"), (1, 4, "no link"), (2, None, "other header"), (3, None, "no header")], key=str)
