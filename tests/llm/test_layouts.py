"""HTML extraction on pages that the generator of training pages does not make."""

import pytest

from parsewright.llm import html_text

PARAGRAPHS = [
    "The river rose in the night, and by morning the lower fields stood under water. Nobody had expected it so early in the year.",
    "Farmers moved their cattle to the hills while the council argued over the old dam. It had been built in 1911, and no one had looked at it since.",
    "By Thursday the rain had stopped. What remained was mud, a broken bridge and a long list of things to mend before the summer.",
    "An engineer from the city walked along the bank for two days. She wrote down every crack, and her report was forty pages long.",
]
TITLE = "After the flood"
P = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
H = f"<h1>{TITLE}</h1>"
ALL = [TITLE, *PARAGRAPHS]
NAV = '<nav><a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a> <a href="/c">Contact</a></nav>'
FOOT = "<footer>Copyright 2024 The Valley Paper. All rights reserved.</footer>"
LIST = '<ul><li><a href="/a">World</a></li><li><a href="/b">Local</a></li><li><a href="/c">Weather</a></li><li><a href="/d">Jobs</a></li></ul>'

LAYOUTS = {
    "body alone": (P, PARAGRAPHS),
    "body with title, nav and footer": (NAV + H + P + FOOT, ALL),
    "box of unknown class": (f'<div class=k9>{H}{P}</div>', ALL),
    "box of unknown class with nav and footer": (f'{NAV}<div class="k9 zz">{H}{P}</div>{FOOT}', ALL),
    "sections in a box": ('<div class=wrap>' + H + "".join(f"<section><p>{p}</p></section>" for p in PARAGRAPHS) + "</div>", ALL),
    "sections with headings": (NAV + "".join(f"<section><h2>Part {k}</h2><p>{p}</p></section>" for k, p in enumerate(PARAGRAPHS, 1)) + FOOT, [x for k, p in enumerate(PARAGRAPHS, 1) for x in (f"Part {k}", p)]),
    "table as layout": (f"<table><tr><td>{LIST}</td><td>{H}{P}</td></tr></table>", ALL),
    "deep boxes": (f"<div id=q1><div><div class=m3>{LIST}</div><div id=q2><div>{H}{P}</div></div></div></div>", ALL),
    "header and aside": (f'<header><a href="/">The Valley Paper</a></header><div>{H}{P}</div><aside><h4>More</h4>{LIST}</aside>{FOOT}', ALL),
    "boxes instead of paragraphs": (f"{NAV}<div>" + H + "".join(f"<div>{p}</div>" for p in PARAGRAPHS) + f"</div>{FOOT}", ALL),
    "article": (f'{NAV}<article>{H}{P}</article><div class="comments"><p>Great read, thank you.</p></div>{FOOT}', ALL),
    "main with advert and form": (f'<main>{H}{P}<div class="advert"><p>Buy two boots today.</p></div><form>Mail <input><button>Join</button></form></main>', ALL),
    "list in the text": (f"<div class=zq>{H}{P}<ul><li>Sandbags for the lower road</li><li>Two pumps from the harbour</li></ul></div>{FOOT}", [*ALL, "Sandbags for the lower road", "Two pumps from the harbour"]),
}


def extracted(spark, pages):
    rows = [(k, f"http://x.org/{k}", f"<!DOCTYPE html><html><head><title>t</title></head><body>{p}</body></html>") for k, p in enumerate(pages)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    return {r.page_id: r.text.split("\n") if r.text else [] for r in html_text.extract(df).collect()}


def test_layouts_without_helpful_names(spark):
    got = extracted(spark, [p for p, _ in LAYOUTS.values()])
    for k, (name, (_, want)) in enumerate(LAYOUTS.items()):
        both = len([x for x in got[k] if x in want])
        assert both >= 0.95 * len(want) and both >= 0.95 * len(got[k]), (name, got[k])


@pytest.mark.parametrize("page, want", [
    ("AT&</b>lt;b&gt; &am<b>p;lt; &amp;lt;", "AT&lt;b> &amp;lt; &lt;"), ("a&nbsp;&nbsp;b&#10;c &eacute;&#x1F600;", "a b c é😀"), ("x &unknown; &copy y", "x &unknown; © y")])
def test_references_never_go_on_behind_a_tag(spark, page, want):
    assert [t for t in html_text.parse(f"<p>{page}</p>").text if t] == [want]
