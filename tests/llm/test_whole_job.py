"""Cases in which an operator used to do less than its whole job."""

import random

from sitelore.llm import decontam, html_extract, licences, pii


def test_edited_copies_are_found_however_often_they_occur(spark):
    rng = random.Random(3)
    item = [f"i{k}" for k in range(30)]
    # keeps the item's words but for every fourth, behind a whole run of six: few of its n-grams are left
    copy = [w if k < 6 or k % 4 else f"x{k}" for k, w in enumerate(item)]
    # one document with the whole item, so that most of its n-grams are in one document only
    texts = [" ".join(item)] + [" ".join([f"b{rng.randrange(900)}", *copy, str(k)]) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontam.matches(docs, bench).collect()}
    assert set(got) == set(range(41)) and got[0] == 1.0 and len(set(got.values())) == 2
    assert decontam.matches(docs.where("doc_id = 7"), bench).first().score == got[7]


LONG = "words of the article that go on for long enough to be content, as they do in a page that is read"


def test_html_keeps_all_parts_of_an_article():
    def text(html):
        return html_extract.main_text(html).split("\n")

    p = [f"{LONG} {k}" for k in range(6)]
    assert text("<body><article><p>%s</article><article><p>%s<p>%s</article></body>" % tuple(p[:3])) == p[:3]
    assert text("<main><article>" + "".join(f"<p>{x}" for x in p[:5]) + f"</article><p>{p[5]}</main>") == p
    items = "".join(f"<li>{x}</li>" for x in p[1:5] * 5)
    assert text(f"<div><h1>Head</h1><p>{p[0]}</p><ol>{items}</ol><p>{p[5]}</p></div>") == ["Head", p[0], *p[1:5] * 5, p[5]]
    assert text(f"<div><div><p>{p[0]}</div><div>" + "".join(f"<p>{x}" for x in p[1:]) + "</div></div>") == p
    assert text(f"<nav><p>{p[0]}</nav><div><p>{p[1]}<p>{p[2]}</div><footer>{p[3]}</footer>") == p[1:3]


def test_html_marks_around_a_whole_page():
    p = [f"{LONG} {k}" for k in range(4)]
    body = "<h1>Head</h1>" + "".join(f"<p>{x}</p>" for x in p)
    side = '<div class="sidebar"><article><p>tease</article></div><form><p>Search</p></form><div class="comments"><p>%s</div>' % (LONG * 9)
    want = "\n".join(["Head", *p])
    for mark in ("content ad-free", "page cookie-accepted", "layout comments-open", "related", "modal", "skip"):
        for inner in (body, f"<article>{body}</article>", f"<main>{body}</main>"):
            assert html_extract.main_text(f'<body><div class="{mark}">{inner}{side}</div></body>') == want, (mark, inner)
            assert html_extract.main_text(f'<body><form action=x><div class="{mark}">{inner}</div>{side}</form></body>') == want, (mark, inner)
    # what is no wrapper stays out, however long it is
    notice = f'<div class="cookie"><p>{LONG * 30}</p></div>'
    assert html_extract.main_text(f"<body>{notice}<div>{body}</div></body>") == want
    assert html_extract.main_text(f'<body><div hidden>{body}</div><section id="comments"><article>{body}</article></section></body>') == ""
    assert html_extract.main_text(f'<div class="ad">{LONG}</div><article><h1>Short.</h1><p><b>Short.<br></article>') == "Short.\nShort."


def test_cards_beside_other_numbers():
    made, rng = pii.Pseudonyms(b"k"), random.Random(4)
    for _ in range(300):
        plain = f"4{rng.randrange(10**14):014d}"
        plain += str(-pii.luhn(plain + "0") % 10)
        four = [plain[i : i + 4] for i in range(0, 16, 4)]
        for card in (plain, " ".join(four), "-".join(four)):
            for text in (f"{card} {rng.randrange(1000):03d}", f"{card} 12/27", f"{card} 99 items", f"12 {card}", f"pay 7 {card} 1234 5678", f"{card}-{rng.randrange(1000):03d}", f"415-555-1234 {card} {card}"):
                new, found = made.text(text)
                assert card not in new and "card" in {k for k, _, _ in found}, text
                assert len(new) == len(text) and made.text(new, True)[0] == text
    assert made.text("4111 1111 1111 1112 12")[0] == "4111 1111 1111 1112 12"
    assert [k for k, _, _ in made.text("415-555-1234 415-555-9999")[1]] == ["phone", "phone"]


def test_all_licence_notices_of_a_long_line(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    mit, apache, gpl = (licences.TEMPLATES[f][k] for f, k in (("mit", 3), ("apache-2.0", 1), ("gpl-3.0", 1)))
    texts = [f"{some(60)} {mit} {some(2000)} {apache} {some(700)} {mit} {some(50)}", f"{mit} {apache}", f"{some(100)} {gpl} {some(90)}", some(3000)]
    plain = [some(30) + "\n" + some(12) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id long, text string")
    got = sorted((r.doc_id, r.first_word, r.family) for r in licences.scan(docs, licences.train(docs, sample=64, each=6)).collect())
    assert [(i, f) for i, _, f in got if i == 0] == [(0, "mit"), (0, "apache-2.0"), (0, "mit")]
    assert sorted((i, f) for i, _, f in got if i) == [(1, "apache-2.0"), (1, "mit"), (2, "gpl-3.0")]
