"""HTML extraction: the template decides; occurrence classes against brute force; edges."""

import random
import re
import time
from collections import Counter, defaultdict

import pytest

from dispatchtext.llm import html_extract as hx

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
PAGES = "page_id long, url string, html string"


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(n))


def run(spark, rows, schema=PAGES):
    return {r["page_id"]: r["text"] for r in hx.main_text(spark.createDataFrame(rows, schema)).collect()}


def scrambled(host, n, seed):
    """Pages of one host whose class names say nothing and whose elements are all divs: (rows, expected texts)."""
    rnd = random.Random(seed)
    menu, ad, main, foot, box = (f"{c}{rnd.randrange(1000)}" for c in ("qa", "zb", "yc", "xd", "we"))
    adverts = [prose(rnd, 12) for _ in range(4)]
    rows, want = [], {}
    for i in range(n):
        title, body = prose(rnd, 5), [prose(rnd, 30) for _ in range(rnd.randrange(1, 6))]
        html = f"<html><head><title>{title}</title></head><body><div class={menu}><div>home</div><div>news</div><div>{rnd.choice(WORDS)}</div></div><div class='{ad}'>{rnd.choice(adverts)}</div>"
        html += f'<div class="{main}"><h1>{title}</h1>' + "".join(f"<p>{p}" for p in body) + f'<div class="{box}">Sign up for our letter</div></div><div class="{foot}">All rights &copy; {host}</div></body></html>'
        rows.append((seed * 1000 + i, f"https://{host}/p{i}", html))
        want[seed * 1000 + i] = "\n".join([title, *body])
    return rows, want


def test_template_decides_where_names_say_nothing(spark):
    rows, want = [], {}
    for seed, host in enumerate(("a.example", "b.example", "c.example")):
        r, w = scrambled(host, 30, seed)
        rows, want = rows + r, want | w
    assert run(spark, rows) == want
    without = {i: hx.extract(html) for i, _, html in rows}  # no template: nothing tells menu, advert and footer from the article
    assert all(without[i] != want[i] for i in want)


def test_words_in_class_names_do_not_drop_parts_of_an_article(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for i in range(24):
        t = [prose(rnd, 20) for _ in range(5)]
        html = f'<html><body><nav>menu</nav><article><header><h1>{t[0]}</h1></header><div class="share"><p>{t[1]}</p></div><section class="legal">{t[2]}</section><p id="alert">{t[3]}</p><p class="side">{t[4]}</p></article><footer>f</footer></body></html>'
        rows.append((i, f"http://w.example/{i}" if i < 20 else f"http://one{i}.example/", html))
        want[i] = "\n".join(t)
    assert run(spark, rows) == want
    assert all(hx.extract(html) == want[i] for i, _, html in rows)


def test_comments_adverts_and_forms_inside_the_slot_go(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    for i in range(20):
        t = [prose(rnd, 25) for _ in range(4)]
        html = f'<html><body><main><h1>{t[0]}</h1><p>{t[1]}</p><div class="ad slot">{t[2]}</div><form>mail</form><aside>{t[3]}</aside><section class="comments"><p>{prose(rnd, 90)}</p></section></main></body></html>'
        rows.append((i, f"http://v.example/{i}", html))
        want[i] = f"{t[0]}\n{t[1]}"
    assert run(spark, rows) == want


def test_an_article_in_two_containers_and_a_long_heading_stay_whole(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for i in range(20):
        head, lead, body = prose(rnd, 60), prose(rnd, 30), prose(rnd, 35)
        rows.append((i, f"http://u.example/{i}", f'<html><body><div class="k1"><h1>{head}</h1><div class="k2"><p>{lead}</div><div class="k3"><p>{body}</div></div></body></html>'))
        want[i] = f"{head}\n{lead}\n{body}"
        rows.append((100 + i, f"http://t.example/{i}", f"<html><body><article><h1>{head}</h1><ul><li>{lead}</ul></article></body></html>"))
        want[100 + i] = f"{head}\n{lead}"
    assert run(spark, rows) == want


def test_a_host_of_copies_keeps_its_article(spark):
    rows, want = scrambled("copies.example", 3, 4)
    one = rows[0][2]
    many = [(10 + i, f"https://copies.example/{i}", one) for i in range(60)]
    got = run(spark, many + rows)
    assert all(want[rows[0][0]] in got[i] for i, *_ in many)


def brute_classes(pages):
    """Class -> elements by full occurrence vectors, in plain Python, for one host."""
    paths, count = hx.Paths(), []
    for html in pages:
        count.append(Counter(n.key for kind, n, _ in hx.walk(html, paths) if kind == "open" and not n.apart and n.up))
    vectors = defaultdict(set)
    for key in set().union(*count):
        vector = tuple(c[key] for c in count)
        if max(vector) == 1 and sum(vector) >= hx.MIN_SHARE * len(pages):
            vectors[vector].add(key)
    return sorted(sorted(v) for v in vectors.values() if len(v) > 1)


def test_classes_are_those_of_full_vectors(spark):
    rnd = random.Random(10)
    rows = []
    for i in range(40):
        extra = "<div id=x><span>s</span><p>t</p></div>" if i != 3 else ""  # a class that one page lacks
        rows.append((str(i), "h", f"<html><body>{extra}<div class=a><p>{i}</p>{'<p>' * rnd.randrange(3)}</div><div class=b><section>{i}</section></div></body></html>"))
    outline = hx.outlines(spark.createDataFrame(rows, "row string, host string, html string"))
    got = hx.classes(outline).first()
    assert sorted(sorted(m["key"] for m in c["members"]) for c in got["classes"]) == brute_classes([r[2] for r in rows])


def test_order_and_interleaving_of_classes():
    def found(*keys):
        return {"support": 10, "members": [{"key": k, "ups": [], "holds": True} for k in keys]}

    def seq(*keys):
        return hx.np.array(keys, "<i8").tobytes()

    same = [{"a": 0, "b": 1, "k": 10, "seq": seq(1, 2, 3)}]
    assert set(hx.template(10, [found(1, 2, 3)], same, {})) == {1, 2, 3}
    moved = [{"a": 0, "b": 1, "k": 6, "seq": seq(1, 2, 3)}, {"a": 0, "b": 2, "k": 4, "seq": seq(2, 3, 1)}]
    assert set(hx.template(10, [found(1, 2, 3)], moved, {})) == {2, 3}
    assert hx.template(10, [found(1, 2, 3)], moved[:1], {}) == {}
    assert hx.template(10, [found(1, 2, 3)], same, {0: 5}) == {}


def test_interleaving_is_seen(spark):
    rows = [(str(i), "h", "<html><body><div class=a>1</div><div class=b>2</div><div class=a2>3</div><div class=b2>4</div></body></html>") for i in range(10)]
    rows += [("x", "h", "<html><body><div class=a>1</div><div class=a2>3</div></body></html>")]
    outline = hx.outlines(spark.createDataFrame(rows, "row string, host string, html string"))
    seen = hx.observations(outline, hx.classes(outline)).filter("what = 1").collect()
    assert len(seen) == 10 and {r["a"] for r in seen} == {1}


def test_blocks_references_and_edges(spark):
    page = '<html><head><title>T</title><style>p{{}}</style></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>A &amp; {0}</h1><p>Long {0}  text\nhere <b>bold</b> that goes on and on.<br><p>More &lt;{0}&gt; words that vary a lot.</article><div class="comments"><p>reader</p></div><footer>f</footer></body></html>'
    rows = [(i, f"http://h{i % 2}.example/x", page.format(i), "clash") for i in range(14)] + [(90, None, None, ""), (91, "no url", "", ""), (92, "http://solo.example/", page.format("s"), ""), (None, "http://h0.example/", page.format(0), ""), (93, "http://solo2.example/", "just text &nbsp; only", ""), (94, "http://h1.example/", "<p>other page", "")]
    rows += [(2, "http://h0.example/x", page.format(2), "clash")] * 2
    found = hx.main_text(spark.createDataFrame(rows, PAGES + ", slot string")).collect()
    assert len(found) == len(rows)
    got = {r["page_id"]: r for r in found}
    for i in range(14):
        assert got[i]["text"] == f"A & {i}\nLong {i} text here bold that goes on and on.\nMore <{i}> words that vary a lot."
        assert got[i]["n_chars"] == len(got[i]["text"]) and got[i]["url"] == rows[i][1]
    assert got[90]["text"] == got[91]["text"] == "" and got[92]["text"].startswith("A & s\n")
    assert got[93]["text"] == "just text only" and got[94]["text"] == "other page"
    assert hx.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_query_on_given_pages(spark):
    """The generator's layout: heading and paragraphs of article, in order."""
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"] or "")
        blocks = re.split(r"(?i)</?(?:h1|p|br|li|ul|div)[^>]*>", inner[1]) if inner else []
        plain = (re.sub(r"\s+", " ", hx._html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in blocks)
        want[r["page_id"]] = "\n".join(b for b in plain if b)
    assert {r["page_id"]: r["text"] for r in hx.op3_html(spark, sf).collect()} == want


BROKEN = ['<a href="', "<![CDATA[", "<a <", "<a href='x\" ", "<!", "<a aaaaaaaa", '"<a \'', "<a b=c ", "<script", "</script ", "<!--", '<a href="x>', "<p class=", "&", "<" * 8]


@pytest.mark.parametrize("piece", BROKEN)
def test_broken_markup_takes_linear_time(piece):
    """A megabyte of each; a quadratic scan would take minutes to hours."""
    began = time.process_time()
    for page in (piece * (1_000_000 // len(piece)), "<a " + piece * (1_000_000 // len(piece)) + ">"):
        for _ in hx.events(page):
            pass
    assert time.process_time() - began < 15


def test_scanner_cases():
    def found(page):
        return [(kind, name) for kind, name, _ in hx.events(page)]

    assert found("a<b>c</b>d") == [("text", "a"), ("open", "b"), ("text", "c"), ("close", "b"), ("text", "d")]
    assert found("<a title='x>y' b=\"<p>\">z") == [("open", "a"), ("text", "z")]
    assert found("1 < 2 <3 <a") == [("text", "1 < 2 <3 <a")]
    assert found("<!-- > -->x<!-->y-->z<!DOCTYPE html>w<?php?>v<![CDATA[<b>]]>u") == [("text", "x"), ("text", "z"), ("text", "w"), ("text", "v"), ("text", "u")]
    assert found("<a href='>x <b>y</b>") == [("text", "<a href='>x "), ("open", "b"), ("text", "y"), ("close", "b")]
    long = "<a href='" + "x>" * 500 + "' class=big>t"
    assert list(hx.events(long)) == [("open", "a", "a.big"), ("text", "t", "")]
    assert found("<math><mi>x</mi></math>") == [("open", "math"), ("open", "mi"), ("text", "x"), ("close", "mi"), ("close", "math")]
