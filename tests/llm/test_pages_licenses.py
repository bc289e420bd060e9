"""Page rendering on fixed pages, licence scan against brute force."""

import random

import pytest

from lumenstock.llm.html_text import page_texts, render
from lumenstock.llm.license_scan import PHRASES, _words, license_scan

from .support import no_documents, odd_documents


@pytest.mark.parametrize("page, text", [
    ("<p>a<p>b<b>c", "a\n\nbc"),
    ("<ul><li>one<li>two<ul><li>x<li>y</ul></ul>after", "- one\n- two\n  - x\n  - y\n\nafter"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>fig<td>12</table>", "Name   Qty\napple  3\nfig    12"),
    ("<table><tr><td>a<td rowspan=2>b<tr><td>c<tr><td colspan=2>wide cell</table>", "a  b\nc\nwide cell"),
    ("<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>", "日本   x\nabcde  y"),
    ("<div style='display: none'>no</div><div>yes<br>line  two</div>", "yes\nline two"),
    ("<ol start=3><li>a<li><p>b</p><p>c</p></ol>", "3. a\n4. b\n\n   c"),
    ("<pre>  x\n   y</pre>z", "  x\n   y\n\nz"),
    ("<h1>T</h1><p>x &amp; y &copy; <script>var a=\"</p>\"</script>z", "T\n\nx & y © z"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("a < b &lt; c", "a < b < c"),
    ("<td>stray</td></b></p>", "stray"),
    ("<head><title>t</title><style>p{}</style></head><body hidden>", ""),
    ("<details><summary>S</summary>no</details><details open>yes</details>", "S\nyes"),
    ("<!-- x --><noscript>n</noscript><input type=submit value=Go><input type=hidden value=h>", "Go"),
    ("<blockquote>q<hr></blockquote>", "  q\n\n  ---"),
    ("<p " * 3, ""), ("", ""), (None, ""), ("<!-- open", ""), ("<script>open", ""),
])
def test_render(page, text):
    assert render(page) == text


@pytest.mark.parametrize("page, text", [
    ("<head><title>t</title><body><p>hi", "hi"),
    ("<html><head><meta charset=x><title>t</title><div>a</div>b", "a\nb"),
    ("<head><title>t</title> text <p>b", "text\n\nb"),
    ("<head><script>x</script></body>after", "after"),
    ("<head><template><p>no</template><noscript><p>no</noscript><link><p>yes", "yes"),
    ("<p>a<head>b</head>c", "abc"),
    ("<p style='-webkit-backface-visibility: hidden'>a<p style='--display:none'>b<p style='background:url(x;display:none)'>c", "a\n\nb\n\nc"),
    ("a<p style='color: red; DISPLAY : none !important; display: block'>b<p style='/* x */visibility:collapse'>c<p style='display:none;display:block'>d", "a\n\nd"),
    ("<svg><title/><defs><text>no</text></defs><path d='m'/><text>Jan</text> noise <text>F<tspan>eb</tspan></text></svg>end", "Jan\nFeb\nend"),
    ("<svg><defs><p>out", "out"),
    ("<svg><foreignObject><div>in</div></foreignObject></svg>", "in"),
    ("<math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></semantics></math>", "x=2"),
    ("<textarea>\nl1 &amp;\n  l2</textarea>", "l1 &\n  l2"),
    ("<select><option>a<option selected>b <b>c</b><option>d</select>", "b c"),
    ("<select><option disabled>a<option>b</select><select multiple><option>x<option hidden>y<option>z</select>", "bx\nz"),
])
def test_visible_text_is_kept(page, text):
    assert render(page) == text


@pytest.mark.parametrize("page, text", [
    ("<p title='it's ok'>Hello world, don't stop <b>now</b></p>", "Hello world, don't stop now"),
    ("<a href=\"x\"\">Buy</a>", "Buy"),
    ("<a title=a'b>x</a> <i ' >y</i> it's", "x y it's"),
    ("<a title='a > b' href=\"c>d\">x", "x"),
    ("<p =\"x\">a<p hidden=\">\">b<p/class=x/>c<img alt='", "a\n\nc"),
    ("<p title=\"open>lost", ""),
    ("<input type=submit value=Go type=hidden>", "Go"),
    ("a<!-- x --!>b<!-->c<!--->d<!-- -- > -->e", "abcde"),
    ("<div style='visibility:hidden'>a<p style='visibility:visible'>b<i style='visibility:collapse'>c</i>d</p>e</div>f", "bd\n\nf"),
    ("<div style='display:none'><p style='visibility:visible'>b</p></div>c", "c"),
    ("<table><tr><td style='visibility:hidden'>long<td>b<tr style='visibility:hidden'><td>c<td style='visibility:visible'>d<tr><td>xy<td>z</table>", "    b\n    d\nxy  z"),
    ("<dialog>no</dialog><dialog open>yes</dialog><progress>70%</progress><meter>2</meter>", "yes"),
    ("<table><tr><td colspan=300>w<td>x<tr><td>a<td colspan=299>b<td>c<tr><td rowspan=99999999>r<td>s</table>", "w     x\na  b  c\nr  s"),
])
def test_broken_quotes_and_inherited_visibility(page, text):
    assert render(page) == text


def test_tags_cost_linear_time():
    for page in ("<p " + "a=" * 200_000, "<p " + "\"" * 200_000, "<p a='" + "x" * 200_000, "<" * 200_000, "<a b" * 100_000):
        render(page + ">end")


def test_deep_and_long_pages():
    assert render("<div>" * 5000 + "deep") == "deep"
    assert render("<table><tr><td>" * 400 + "x").strip() == "x"
    assert render("<p>word " * 20_000).count("word") == 20_000
    assert len(render("<" * 50_000)) == 50_000


def test_depth_has_no_limit():
    deep = "<font>" * 3000
    for hidden in ("<div hidden>no</div>", "<template>no</template>", "<noscript>no</noscript>"):
        assert render(deep + hidden + "yes") == "yes"
    assert render(deep + "<table><tr><td>a<td>b<tr><td>c<td>d</table>") == "a  b\nc  d"
    assert render("<div hidden>" + "<div>" * 200 + "</div>" * 200 + "no</div>yes") == "yes"
    assert render("<ul><li>" * 400 + "x").endswith("x")
    assert render("<b>" * 30_000 + "<p>a" * 3000).count("a") == 3000


def test_page_table(spark):
    rows = [(1, "u", "<p>a", "x"), (2, None, None, None), (None, "u", "b", "y"), (1, "u", "<p>a", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, page_texts(pages).collect())) == [(1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert page_texts(pages.where("false")).count() == 0


def test_license_base_places(spark):
    rng = random.Random(8)
    parts = ["mit license", "Apache  License", "GENERAL public-license", "general license", "mit", "license", "x", "é", "public"]
    rows = [(i, ", ".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(60)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w = _words(text)
        hits = [(j, label) for phrase, label in PHRASES.items() for k in [phrase.split()] for j in range(len(w) - len(k) + 1) if w[j:j + len(k)] == k]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_diagonals_merge_over_edits(spark):
    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    edited = notice.replace("binary forms", "binary object forms").replace(", with", " with")
    rows = [(1, "intro words " + edited + " tail"), (2, notice[:60]), (3, (notice + ". ") * 3), (4, " ".join(reversed(notice.split())))]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "bsd" and got[1].spans[0].first_word == 2 and got[1].n_base == 0
    assert got[2].labels == "" and got[4].labels == "" and len(got[3].spans) == 3


def test_licenses_take_odd_tables(spark):
    docs = odd_documents(spark)
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    assert sorted(got) == sorted({r.doc_id for r in docs.collect() if r.doc_id is not None})
    assert got[0].n_words == got[1].n_words == 0 and got[0].first_word is None and got[9].labels == "mit"
    assert license_scan(no_documents(spark)).count() == 0


def test_license_plan_is_native(spark, sf_dir):
    from lumenstock.llm.queries import op4_license_voting

    plan = op4_license_voting(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
