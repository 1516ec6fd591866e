"""Pages written by hand: layouts with and without headings, each around articles of other sentences and parts."""

import random

import pytest

from tradewind.llm import html_text

SENTENCES = """Steel prices rose again this week as mills in the north cut output for the third time.|Buyers said they expect more of the same before the summer.|A second round of talks is set for Monday, and nobody expects a deal before the month ends.|Analysts at two banks see the metal at a new high by June.|The port reopened on Friday after nine days, but the queue of ships will take weeks to clear.|Her first novel sold badly, yet it is now read in schools all over the country.|Mix the flour with the water and leave it to stand for an hour.|The museum closed its doors in 1994 and was never rebuilt.|Nobody had told him.|We walked up the hill in the rain; at the top there was nothing to see.|Researchers measured the ice every spring for forty years.|Their figures, published on Tuesday, leave little room for doubt.|The council voted by seven to five to keep the library open.|It rained.|In the second half the visitors scored twice, and the home side never recovered.|Ask your supplier for a certificate before you sign.|The valve must be replaced every two thousand hours, or sooner if it leaks.|Costs fell by a tenth, which surprised even the accountants.|He was born in a village by the sea and left it at sixteen.|The new line will carry freight at night and passengers by day.|Three of the four engines failed.|Critics disliked the film, and audiences did not mind.|Wash the rice until the water runs clear.|The judge gave both sides until the end of the year.|Small firms are hit hardest, the report says.|A spokesman declined to comment on the figures.""".split("|")
NAV = '<nav><a href="/">Home</a> <a href="/n">News</a> <a href="/c">Contact</a></nav>'
FOOT = "<footer><p>&copy; 2024 The Paper. All rights reserved.</p></footer>"
SIDE = '<aside><h3>Most read</h3><ul><li><a href="/1">Another story</a></li><li><a href="/2">One more story</a></li></ul></aside>'
LAYOUTS = [
    "{n}<article>{b}</article>{f}", "{n}<main>{b}</main>{f}", "{n}<main><h2>{t}</h2>{b}</main>{f}", "{n}{b}{f}", "<article><p class=lead>{t}</p>{b}</article>", "{n}<h1>{t}</h1><article>{b}</article>{f}", "<header><h1>{t}</h1></header><main>{b}</main>{f}",
    "{n}<article><h1>{t}</h1>{b}</article>{s}{f}", "<div class=wrapper><div class=content><h1>{t}</h1>{b}</div><div class=sidebar><a href=q>Elsewhere</a></div></div>{f}", "{n}<div id=x><div>{b}</div></div>{f}", "{n}<section><h2>{t}</h2>{b}</section>{f}", "{n}<main><article><header><h1>{t}</h1></header>{b}</article></main>{s}{f}",
    '<div class="cookie-banner"><p>We use cookies.</p><button>OK</button></div>{n}<article>{b}</article>{f}', '{n}<article>{b}</article><div class="comments"><h3>Comments</h3><div class="comment"><p>Well said, thanks.</p></div></div>{f}', '<body>{n}<div class="post"><div class="entry">{b}</div></div>{f}</body>', "{n}<table><tr><td>{b}</td></tr></table>{f}",
    '{n}<article>{b}<div class="share"><a href=a>Share</a> <a href=b>Print</a></div></article>{f}', "<main>{b}</main>", '{n}<div class="page"><main role="main"><h1>{t}</h1>{b}</main>{s}</div>{f}', "<html><head><title>x</title></head><body>{n}<article><section>{b}</section></article>{f}</body></html>",
]
DROPPED = ("Home", "News", "Contact", "©", "Most read", "Another story", "One more story", "Elsewhere", "We use cookies", "Comments", "Well said", "Share", "Print")


def body(r):
    said = lambda n: " ".join(r.sample(SENTENCES, n))
    parts = [f"<p>{said(r.randrange(1, 5))}</p>" for _ in range(r.randrange(2, 6))]
    extras = [
        "<table><tr><th>Year</th><th>Price</th></tr><tr><td>2023</td><td>612</td></tr></table>", "<figure><img src=x><figcaption>The mill at night.</figcaption></figure>", "<dl><dt>Mill</dt><dd>A place where steel is made.</dd><dt>Slab</dt><dd>Thick plate.</dd></dl>", "<pre><code>price = 612\nprint(price)</code></pre>",
        "<div class=note>Note that all figures are rounded.</div>", "<ul><li><a href=a>The first report</a></li><li><a href=b>The second report</a></li></ul>", "<ul><li>Two cups of rice</li><li>Water</li></ul>", "<blockquote><p>We will not give in.</p></blockquote>", "<h2>What happens next</h2>", "<div>A line in a plain block.</div>", "<p><a href=z>Read the whole report</a> for more.</p>",
    ]
    for x in r.sample(extras, r.randrange(0, 3)):
        parts.insert(r.randrange(1, len(parts) + 1), x)
    return "".join(parts)


@pytest.fixture(scope="module")
def trees():
    return html_text.trained()


def outcome(trees, html):
    want = [t for _, t in html_text.Page(html).blocks if not t.startswith(DROPPED)]
    got = html_text.main_texts(trees, [html])[0].split("\n")
    return want, got


def test_layouts(trees):
    """200 pages, ten articles a layout: nearly all have their exact text, and hardly a character is lost or added."""
    r = random.Random(31)
    exact, lost, added, whole, gone = 0, 0, 0, 0, []
    for layout in LAYOUTS:
        for _ in range(10):
            html = layout.format(n=NAV, f=FOOT, s=SIDE, t=r.choice(["Steel is up", "A slow spring", "How to cook rice", "The library stays"]), b=body(r))
            want, got = outcome(trees, html)
            exact += got == want
            lost += sum(len(x) for x in want if x not in got)
            added += sum(len(x) for x in got if x not in want)
            whole += sum(map(len, want))
            if sum(len(x) for x in got if x in want) < 0.8 * sum(map(len, want)):
                gone.append(layout)
    print(exact, lost / whole, added / whole, gone)
    assert exact >= 185 and lost < 0.01 * whole and added < 0.01 * whole and not gone


def test_pages_without_an_article(trees):
    for html in (f"<body>{NAV}{FOOT}</body>", f"{NAV}{SIDE}{FOOT}", "", "<p></p>"):
        assert html_text.main_texts(trees, [html]) == [""]
