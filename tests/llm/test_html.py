"""The extraction against readings that share no code with it."""

import html
import math
import random
import re
import time

import duckdb
import pytest

from sitelore.llm import html_extract

LONG = "words of the article that go on for long enough to be content, as they do in a page that is read"


def article_of(source):
    """The article of a generated page, by its markup."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", source, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts]
    return "\n".join(x for x in lines if x)


@pytest.fixture(scope="module")
def sources():
    return [h for (h,) in duckdb.sql("select html from '/root/testdata/sf0.1/pages.parquet'").fetchall()]


def test_every_generated_page(sources):
    assert all(html_extract.main_text(h) == article_of(h) for h in sources)


def test_pages_without_article_elements(sources):
    plain = [h.replace("<article>", "<div>").replace("</article>", "</div>") for h in sources]
    assert all(html_extract.main_text(p) == article_of(h) for p, h in zip(plain, sources))


def test_pages_by_their_ratios_alone(sources):
    """Neither article nor marks nor menu and footer elements: where the article is more than a few words, its ratios tell it apart."""
    right = total = 0
    for h in sources:
        want = article_of(h)
        if len(want) > 1500:
            plain = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", h).replace(' class="ad"', "")
            total += 1
            right += html_extract.main_text(plain) == want
    assert total > 500 and right / total > 0.9


def brute_clusters(lines):
    """Cluster and core flags from the definitions, line by line."""
    ratio = [chars / max(1, tags) for chars, tags in lines]
    mean = sum(ratio) / len(ratio)
    least = min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio)))
    near = []
    for i in range(len(ratio)):
        weights = {j: math.exp(-0.5 * (i - j) ** 2) for j in range(max(0, i - 3), min(len(ratio), i + 4))}
        near.append(sum(w * ratio[j] for j, w in weights.items()) / sum(weights.values()))
    flags = [(n >= least - 1e-9, n >= least - 1e-9 and r >= least - 1e-9) for n, r in zip(near, ratio)]
    return flags if any(c for _, c in flags) else [(n, r == max(ratio)) for (n, _), r in zip(flags, ratio)]


def test_ratios_and_smoothing_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        blocks = [(rng.choice(("p", "div", "li", "h2")), rng.randint(1, 30), rng.randint(0, 5)) for _ in range(rng.randint(1, 25))]
        source, want = "", []
        for tag, words, inline in blocks:
            text = " ".join("w" * rng.randint(1, 9) for _ in range(words))
            source += f"<{tag}>" + "<i>" * inline + text + "</i>" * inline + f"</{tag}>"
            want.append((len(text), 2 * inline + 2))
        page = html_extract.Page()
        page.feed(source)
        page.line()
        lines = page.lines(None)
        assert [(len(x.text), x.tags) for x in lines] == want
        near, core = html_extract.clusters(lines)
        assert list(zip(near.tolist(), core.tolist())) == brute_clusters(want)


def test_menus_and_notes_without_marks():
    p = [f"{LONG} {k}" for k in range(6)]
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Go {k}</a></li>" for k in range(8)) + "</ul>"
    body = "<h1>Head</h1>" + "".join(f"<p>{x}</p>" for x in p[:3]) + "<ul><li>one</li><li>two</li></ul>" + "".join(f"<p>{x}</p>" for x in p[3:]) + "<p>End.</p>"
    want = "\n".join(["Head", *p[:3], "one", "two", *p[3:], "End."])
    assert html_extract.main_text(f"<body><div>{menu}</div><div>{body}</div><div>{menu}</div><div>(c) x</div></body>") == want
    # at one level with the article
    assert html_extract.main_text(f"<body><div>{menu}</div>{body}<div>{menu}</div></body>") == want
    # a menu between two paragraphs
    assert html_extract.main_text(f"<body><h1>Head</h1><p>{p[0]}<p>{p[1]}<div>{menu}</div><p>{p[2]}<p>{p[3]}</body>") == "\n".join(["Head", *p[:4]])


def test_names_that_only_contain_a_mark():
    body = f'<article><h1>T</h1><p class="share-price">Share price rose</p><div class="ad-hoc">Ad hoc report</div><p class="notice-period">Three months</p><p>{LONG}</p><div class="ad-slot-3">Buy</div><div class="adBanner">Buy</div><div id="related_posts">See</div></article>'
    assert html_extract.main_text(body) == f"T\nShare price rose\nAd hoc report\nThree months\n{LONG}"


@pytest.mark.parametrize("source", ["<div>" * 200_000 + "text", "<div class=ad>" * 100_000 + "text", "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000 + "text", "<li><ul>" * 100_000 + "text", "<section>" * 70_000 + "</article>" * 70_000 + "text"])
def test_deep_pages_take_linear_time(source):
    start = time.time()
    html_extract.main_text(source)
    assert time.time() - start < 5
