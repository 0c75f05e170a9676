import math
import random
import re

import numpy as np

from skylattice.llm import html_extract
from skylattice.llm.html_extract import extract, main_text

LONG = "Words of the article that go on for quite a while, so that the line counts as text. " * 3


def test_structure_without_article_element():
    html = (
        "<html><head><title>t</title><script>var a='</div><p>no</p>';</script></head><body><div class='top-nav'><a href=/>Home</a> <a href=/x>X</a></div>"
        f"<div id=page><div class=content><h1>A &amp; B</h1><p>{LONG}<p>Short.</p><p>{LONG}</p><form>no<input></form><div class='ad'>Buy</div></div>"
        f"<div class='sidebar'>{LONG}</div><section id=comments><article class='comment'>{LONG}</article></section></div>"
        "<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><footer>c</footer></body></html>"
    )
    assert main_text(html) == "\n".join(["A & B", LONG.strip(), "Short.", LONG.strip()])


def test_wrapper_mark_does_not_hide_article():
    assert main_text(f"<body><div class='with-sidebar'><nav>n</nav><article><p>{LONG}</p><p>x<br>y\n z</p></article></div>") == LONG.strip() + "\nx y z"


def test_dominant_block_does_not_hide_its_neighbours():
    assert main_text(f"<body><div><h1>Title</h1><p>{LONG}</p><p>Short.</p></div></body>") == f"Title\n{LONG.strip()}\nShort."
    assert main_text(f"<body><div><p>{LONG * 3}</p></div><div><p>{LONG}</p></div></body>") == f"{(LONG * 3).strip()}\n{LONG.strip()}"
    assert main_text(f"<body><ul><li>{LONG * 9}</li><li>Short.</li></ul></body>") == f"{(LONG * 9).strip()}\nShort."


def test_all_outermost_articles():
    teasers = f"<div class='related'><article>{LONG}</article><article>{LONG}</article></div><article class='comment'>{LONG}</article>"
    page = f"<body><article><h2>A</h2><p>{LONG * 3}</p></article><article><h2>B</h2><p>{LONG}</p></article><article>C</article>{teasers}</body>"
    assert main_text(page) == "\n".join(["A", (LONG * 3).strip(), "B", LONG.strip(), "C"])
    assert main_text(f"<main><h1>T</h1><article>{LONG}</article><p>Short.</p></main>") == f"T\n{LONG.strip()}\nShort."
    assert main_text(f"<body><article>Hi</article><div class='c'><p>{LONG * 9}</p><p>{LONG * 9}</p></div></body>").count(LONG.strip()) == 18


def test_odd_pages(spark):
    made = [
        (1, "u", None, 5), (2, None, "", 5), (None, "u", "<p></p>", 5), (3, "u", "plain &lt;text&gt;", 5), (3, "u", "plain &lt;text&gt;", 5),
        (4, "u", "<article><p>a&nbsp;&#233;<b>b</b>", 5), (5, "u", "<p>" + "long " * 200_000, 5), (6, "u", "<script>x", 5),
    ]
    df = spark.createDataFrame(made, "page_id long, url string, html string, text int")
    got = {(r.page_id, r.text[:20], r.n_chars) for r in extract(df).collect()}
    assert got == {(1, "", 0), (2, "", 0), (None, "", 0), (3, "plain <text>", 12), (4, "a éb", 4), (5, "long " * 4, 999_999), (6, "", 0)}
    assert extract(df).count() == 8 and extract(df.where("false")).count() == 0


def brute(own, tags):
    """Smoothed ratios and the threshold between their two clusters, by plain loops."""
    ratio = [o / max(t, 1) for o, t in zip(own, tags)]
    weigh = lambda d: math.exp(-0.5 * (d / html_extract.SIGMA) ** 2) if abs(d) <= math.ceil(3 * html_extract.SIGMA) else 0.0
    n = range(len(ratio))
    smooth = [sum(weigh(j - i) * ratio[j] for j in n) / sum(weigh(j - i) for j in n) for i in n]
    low, high = min(smooth), max(smooth)
    if high <= 2 * low:
        return smooth, low
    for _ in range(50):
        parts = ([], [])
        for x in smooth:
            parts[x - low > high - x].append(x)
        low, high = (sum(p) / len(p) for p in parts)
    return smooth, (low + high) / 2


def test_ratios_equal_brute_force():
    r = random.Random(2)
    for _ in range(50):
        n = r.randrange(1, 30)
        own, tags = [r.choice([0, 5, 40, 300, 900]) for _ in range(n)], [r.randrange(0, 5) for _ in range(n)]
        smooth, cut = brute(own, tags)
        assert np.allclose(html_extract.smoothed(np.array(own) / np.maximum(tags, 1)), smooth)
        content, votes = html_extract.voting(np.array(own, dtype=float), np.array(tags), np.ones(n, dtype=bool))
        assert content.tolist() == [x >= cut - 1e-9 for x in smooth]
        assert all(content[k] and own[k] / max(tags[k], 1) >= 0.5 * cut - 1e-9 for k in np.flatnonzero(votes))


NAMELESS = (
    "<html><body><div>" + "".join(f"<span><a href=/{k}>Link {k}</a></span><br>" for k in range(9)) + "</div><div>Buy now.</div>"
    f"<div><h1>Title</h1><p>{LONG}</p><p>Short.</p><div><p>{LONG}</p></div><div><p>Caption.</p></div><div><p>{LONG}</p></div></div>"
    "<div>2024</div></body></html>"
)


def test_ratios_decide_where_no_name_does(monkeypatch):
    want = "\n".join(["Title", LONG.strip(), "Short.", LONG.strip(), "Caption.", LONG.strip()])
    assert main_text(NAMELESS) == want
    monkeypatch.setattr(html_extract, "threshold", lambda values: -1.0)
    assert main_text(NAMELESS) != want


def test_pages_without_article_elements(spark, sf_dir):
    """Whole pages of the table whose article elements are renamed, and pages without any telling name."""
    same = near = 0
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect() if r.html]
    for html in pages:
        want = main_text(html)
        same += main_text(re.sub(r"(</?)(article|main)\b", r"\1div", html)) == want
        bare = main_text(re.sub(r' class="[^"]*"', "", re.sub(r"(</?)(article|main|nav|footer)\b", r"\1div", html)))
        near += want in bare and len(bare.split("\n")) <= len(want.split("\n")) + 2
    assert same >= 0.99 * len(pages) and near >= 0.99 * len(pages)
