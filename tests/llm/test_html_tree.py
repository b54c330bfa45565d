"""HTML extraction: the site tree recomputed, names that give way, and markup of any shape."""

import math
import time
from collections import defaultdict

import pytest

from declara.llm import html_extraction as he


def text_of(page):
    return "\n".join(text for _, text, noise, _ in he.blocks(page)[0] if not noise)


ARTICLE = "<article><h1>Title</h1><p>Some words of the story.</p><p>And more of them.</p></article>"
STORY = "Title\nSome words of the story.\nAnd more of them."
LONG = "<p>" + "</p><p>".join(f"Paragraph {i} of a story without any article around it" for i in range(6)) + "</p>"


@pytest.mark.parametrize("page", [
    f"<body><form action=x>{ARTICLE}</form></body>", f"<div class='content-sidebar-wrap'>{ARTICLE}</div>", f"<div class=market-share>{ARTICLE}</div>",
    f"<div class='comments nav'><main>{ARTICLE}</main></div>", f"<div class=sidebar>Links</div>{ARTICLE}<div class=comments>Me too</div>",
    f"{ARTICLE}<section class=comments><article>First!</article><article>A very long reader comment, longer than the article is, about this and that</article></section>",
    f"<header><nav>Menu</nav></header><form>{ARTICLE}</form><footer>End</footer>", f"<noscript>Turn scripts on</noscript>{ARTICLE}<iframe>frame</iframe>",
    f"<div hidden>secret</div><div role=navigation>Go</div>{ARTICLE}",
])
def test_the_article_outweighs_marks_around_it(page):
    assert text_of(page) == STORY


def test_most_of_the_text_outweighs_layout_names_only():
    story = text_of(f"<div>{LONG}</div>")
    assert text_of(f"<div class=related-share><div class=nav>a b c</div>{LONG}</div><p>tail") == story + "\ntail"
    assert text_of(f"<form>{LONG}</form><footer>f</footer>") == story
    assert text_of(f"<p>Short story.</p><div class=comments>{LONG}</div>") == "Short story."
    assert text_of(f"<p>{'A long enough story. ' * 30}</p><aside>{LONG}</aside>").startswith("A long enough story.") and "Paragraph" not in text_of(f"<p>{'A long enough story. ' * 30}</p><aside>{LONG}</aside>")


def test_nothing_else_is_dropped_inside_the_article():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><noscript><p>Kept here.</p></noscript><svg><text>Label</text></svg><p>End<script>x()</script></p></article>"
    assert text_of(page) == "Let x=1 be.\nKept here.\nLabel\nEnd"


def test_classes_tell_nodes_apart():
    found = he.blocks("<body><div class=c1>a</div><div class='c2 wide'>b</div><div class='wide c3'>c</div><div class='x post-17'>d</div><div class='post-4 x'>e</div>")[0]
    last = [chain[-1] for chain, *_ in found]
    assert last[0] != last[1] and last[1] == last[2] and last[3] == last[4] and len(set(last)) == 3


@pytest.mark.parametrize("piece", ["<div>x", "<div><section>x y", "<b>x", "<p><i>x", "<ul><li>x", "<table><tr><td>x", "</div>x", "<title>x", "<noscript>", "<svg><g>x", "<form>x", "<!--", "<dl><dt>x<dd>y"])
def test_any_depth_takes_linear_time(piece):
    start = time.perf_counter()
    found = he.blocks(piece * 40_000)[0]
    assert time.perf_counter() - start < 8 and all(len(chain) <= he.DEEPEST + 1 for chain, *_ in found)


def test_importance_recomputed(spark):
    pages = [
        ("h", f"<body><div class=top><p>Welcome</p></div><div class=mix><p>Only {i}</p>{'<p>Often</p>' if i % 2 else '<ul><li>Often</li></ul>'}</div><article><p>Story {i}</p></article></body>")
        for i in range(8)
    ]
    pages += [pages[0], ("other", pages[0][1])]
    frame = spark.createDataFrame(pages, "host string, html string")
    got = {(r.host, r.node): (r.pages, r.importance, r.content) for r in he.importance(he.tree_rows(frame)).collect()}
    seen, styles, on, inside = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), defaultdict(set), set()
    for host, html in set(pages):
        found, sequences = he.blocks(html)
        for chain, text, noise, content in found:
            assert not noise
            for i, node in enumerate(chain):
                seen[host, node][text].add(html)
                on[host, node].add(html)
                if content is not None and i >= content:
                    inside.add((host, node))
        for node, (children, _) in sequences.items():
            styles[host, node][children].add(html)
            on[host, node].add(html)
    assert set(got) == set(seen)
    for key, texts in seen.items():
        m, df = len(on[key]), [len(p) for p in texts.values()]
        if m == 1:
            want = 1.0
        else:
            content = 1 - sum(map(math.log, df)) / len(df) / math.log(m)
            drawn = [len(p) for p in styles[key].values()]
            entropy = -sum(n / sum(drawn) * math.log(n / sum(drawn)) for n in drawn) / math.log(m) if drawn else 0.0
            share = 0.9 ** len(drawn)
            want = (1 - share) * max(entropy, content) + share * content
        assert got[key][0] == m and got[key][1] == pytest.approx(want, abs=1e-12) and got[key][2] == (key in inside)


def test_repeated_pages_and_clashing_columns(spark):
    page = "<body><div class=top><p>Welcome</p></div><article><p>Story {}</p></article></body>"
    rows = [(i // 2, f"http://h.example/{i // 2}", page.format(i // 2), "n", 1) for i in range(10)] + [(None, None, None, "n", 1)]
    frame = spark.createDataFrame(rows, "id long, url string, html string, node string, content int")
    found = sorted((str(r.id), r.text) for r in he.extract(frame).collect())
    assert found == sorted([(str(i // 2), f"Story {i // 2}") for i in range(10)] + [("None", "")])
