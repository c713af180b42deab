"""Column expressions against hand-computed cases."""

import datetime as dt
import math
import os
from html.parser import HTMLParser

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import cleaning as C
from sparkloom.functions import text as X
from sparkloom.functions.html import visible_text
from sparkloom.functions.lexicon import COFFEE_BODY, COFFEE_TITLE, PROSE


def one(spark, *columns, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1)])
    return tuple(df.select(*columns).first())


def test_prices_need_two_digits_and_the_band(spark):
    text = "Giá 57.600 đồng, 95,000 VND, 1.000 đồng, 300.000 đồng"
    p = X.numbers(F.col("t"), COFFEE_BODY.price, COFFEE_BODY.price_low, COFFEE_BODY.price_high)
    assert one(spark, p, X.array_median(p), t=text) == ([57600.0, 95000.0], 76300.0)


def test_keywords_ignore_case_and_respect_words(spark):
    assert one(spark, X.hits(F.col("t"), COFFEE_BODY.up), t="giá TĂNG mạnh tăng ătăng") == (2,)
    assert one(spark, X.flag(F.col("t"), COFFEE_TITLE.down), t=None) == (False,)


def test_direction_scores(spark):
    score = X.direction_score(F.lit(3) + F.lit(1), F.lit(2) + F.lit(0))
    short = X.body_direction(F.lit("the"), PROSE)
    got = one(spark, score, short)
    assert got[0] == pytest.approx(2 / 7) and got[1] is None


def test_change_keeps_magnitudes_under_the_cap(spark):
    c = X.numbers(F.col("t"), COFFEE_BODY.change, below=COFFEE_BODY.change_cap)
    assert one(spark, c, X.array_mean(c), t="tăng 1.500 đồng, giảm 500.000, giảm 2.500 đ") == ([1500.0, 2500.0], 2000.0)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1), min_size=1, max_size=5))
def test_entropy(spark, shares):
    got = one(spark, X.entropy(*(F.lit(p) for p in shares)))[0]
    assert got == pytest.approx(abs(-sum(p * math.log2(p) for p in shares if p > 0)), abs=1e-9)


def test_ngrams_drop_digits(spark):
    assert one(spark, X.ngrams(F.col("t"), 2), t="Giá cà-phê 2024, hôm nay!") == (["giá cà", "cà phê", "hôm nay"],)
    assert one(spark, X.ngrams(F.col("t"), 3), t=None) == ([],)


def reference_truncation(text, lexicon, budget):
    """Step by step, in plain Python, for the prose lexicon."""
    import re

    if text is None or len(text) < 50:
        return text or ""
    kept = [p for p in (x.strip() for x in text.split("\n")) if len(p) > 20 and not re.search("all rights reserved|copyright", p, re.I)]
    score = lambda p: sum(w * sum(t in p.lower() for t in ts) for w, ts in ((3, lexicon.high_terms), (2, lexicon.medium_terms), (1, lexicon.low_terms)))
    ranked = sorted((p for p in kept if score(p) > 0), key=lambda p: -score(p))
    if not ranked:
        return text[:budget]
    out, used = [], 0
    for p in ranked:
        if used + len(p) <= budget:
            out.append(p)
            used += len(p)
        else:
            if budget - used > 100:
                out.append(p[: budget - used])
            break
    return "\n".join(out)


def test_truncation_matches_plain_python(spark):
    texts = [None, "", "short", "x" * 80, "\n".join(f"the nation number {i} and {'word ' * (i * 7 % 23)}" for i in range(20)), "the copyright " * 5 + "\n" + "que der " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for budget in (120, 300):
        got = {r.i: r.k for r in df.select("i", X.smart_truncate(F.col("t"), PROSE, budget=budget).alias("k")).collect()}
        assert got == {i: reference_truncation(t, PROSE, budget) for i, t in enumerate(texts)}


def test_paragraph_prices_need_no_word_bound(spark):
    line = "so 1234.567 đồng stands in a line"
    text = "\n".join(["x" * 30, line, "y" * 30])
    assert one(spark, X.smart_truncate(F.col("t"), COFFEE_TITLE), X.paragraph_score(F.lit(line), COFFEE_TITLE), t=text) == (line, 3)


def test_split_prices(spark):
    p = X.split_numbers(F.col("t"), COFFEE_TITLE.split_price, 30_000, 250_000)
    assert one(spark, p, t="57.600 đồng, 95,000 đ/kg; 12.345 VND; 7.000 đồng") == ([57600.0, 95000.0],)


def test_fences_domains_keys(spark):
    got = one(spark, X.unfenced(F.lit('```json\n{"a": 1}\n```')), X.unfenced(F.lit(" {b ")), X.url_domain(F.lit("https://a.b/c")), X.url_domain(F.lit("a.b/c")),
              X.masked_key(F.lit("abcdefghwxyz")), X.first_line(F.lit("  one \ntwo")), X.excluding(F.lit("q"), ["a", "b"]))
    assert got == ('{"a": 1}', "{b", "a.b", "", "abcd...wxyz", "one", "q -site:a -site:b")


@pytest.mark.parametrize("raw, day", [
    ("5 thg 3, 2024", "2024-03-05"), ("Mar 05, 2024", "2024-03-05"), ("3 ngày trước", "2024-03-07"), ("2 giờ trước", "2024-03-10"), ("", None),
    (None, None), ("1 day ago", None), ("4 days ago", "2024-03-06"), ("31 thg 2, 2024", None)])
def test_printed_dates(spark, raw, day):
    got = one(spark, C.printed_date(F.lit(raw).cast("string"), F.lit("2024-03-10").cast("date")))[0]
    assert got == (day and dt.date.fromisoformat(day))


def test_coercions(spark):
    got = one(spark, *(C.volume(F.lit(x)) for x in ("12.5K", "1.2M", "-", "1,234")), C.number(F.lit("NaN")), C.number(F.lit("x")), C.day(F.lit("bad")), C.percentage(F.lit("1.2%")), C.grouped_number(F.lit("1,234.5")))
    assert got == (12500.0, 1200000.0, 0.0, 1234.0, None, None, None, 1.2, 1234.5)


def test_consistency(spark):
    cases = [("UP", -5, "MISMATCH"), ("STABLE", 0, "OK"), ("MIXED", 9, "OK"), ("NONE", 0, "MISMATCH"), ("DOWN", -1, "OK"), ("UP", None, "MISMATCH")]
    assert [one(spark, X.consistency(F.lit(d), F.lit(c).cast("int")))[0] for d, c, _ in cases] == [w for *_, w in cases]


class Visible(HTMLParser):
    HIDDEN = {"script", "style", "head", "title", "noscript", "template"}
    BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def read_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Visible()
    parser.feed(html)
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def test_visible_text_equals_a_parser(spark):
    d = "/root/testdata/sf0.01/pages.parquet"
    html = [r.html for r in spark.read.parquet(d).collect()] if os.path.isdir(os.path.dirname(d)) else []
    html += [
        None, "", "plain  text", "<p>open", "<head><title>t</title></head><p>a  b</p><script>x</script>c<br>d &amp; e", "a<!-- <p>hidden</p> -->b", "x<script>if (a<b) '<!--'</script>y<style>p{}",
        "<STYLE>a</STYLE><DIV>Up</DIV>down<li>one<li>two", "&#8364;&#x20AC; &euro; &eacute;t&Eacute; &lt;p&gt; &nosuch; &amp &copy x & y &", "<p>a&nbsp;b\u3000c\x0bd</p>\n\n <p> </p>", "<noscript>n</noscript><template><p>t</p></template>z",
        "<header>keeps</header><bold>this</bold>", "5 < 6 and 7 > 3", "<p " + "x='1' " * 30_000 + ">long", "<div>" * 50_000 + "deep" + "&amp;" * 20_000]
    rows = spark.createDataFrame(list(enumerate(html)), "i int, html string").select("i", visible_text(F.col("html")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: read_text(h) for i, h in enumerate(html)}
    edge = ["&#0;&#xD800;&#1114112;", "<!doctype html>a<?php x ?>b", "a<p", "a<!-- open <b>", "<title>never closed", '<a title="1 > 0">link</a>']
    got = spark.createDataFrame(list(enumerate(edge)), "i int, html string").orderBy("i").select(visible_text(F.col("html")).alias("t")).collect()
    assert [r.t for r in got] == ["\ufffd\ufffd\ufffd", "ab", "a", "a", "", '0">link']
