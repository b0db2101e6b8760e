"""HTML extraction: any markup gives a row in linear time, the clustering decides, and nothing of the article is lost."""

import math
import random
import statistics
import time

import pytest

from sievemark.llm import html_extract as H


def words(word, n):
    return " ".join([word] * n)


LONG, MORE = words("story", 60), words("other", 70)


def test_threshold_alone_tells_content_from_boilerplate():
    menu = "".join(f"<div>{x}</div>" for x in ("Home", "News", "Sports", "Weather", "Contact"))
    page = f"<body><div>{menu}</div><div><p>{LONG}</p><p>Short.</p><p>{MORE}</p></div><div>{'<div>All rights</div>' * 4}</div></body>"
    assert H.extract(page) == "\n".join([LONG, "Short.", MORE])


def test_marks_set_weights_and_the_threshold_removes():
    page = f"<nav>{LONG}</nav><div class='ad'>{LONG}</div><article><p>{MORE}</p></article><aside>{LONG}</aside><footer>{LONG}</footer>"
    parser = H.LineParser()
    parser.read(page)
    assert [x.weight for x in parser.lines] == [0, 0, 1, 0, 0]
    assert H.extract(page) == MORE


@pytest.mark.parametrize("name", ["social-history", "share-of-voice", "notice-of-intent-explained", "banner-years", "related-work"])
def test_sections_of_the_article_stay_whatever_their_names_hint(name):
    page = f"<article><p>{LONG}</p><section class='{name}'><p>{MORE}</p><p>Few words.</p></section></article>"
    assert H.extract(page) == "\n".join([LONG, MORE, "Few words."])


@pytest.mark.parametrize("name", ["share-buttons", "social-links", "comment-list", "cookie-notice", "ad-slot", "related-posts", "newsletter-signup", "sidebar"])
def test_boxes_that_are_no_article_go(name):
    assert H.extract(f"<article><p>{LONG}</p><div class='{name}'><p>{MORE}</p></div></article>") == LONG


def test_links_inside_the_article():
    mixed = "See <a href='/a'>a rather long title of a page</a>."
    inside = "<ul><li><a href='/a'>First source</a><li><a href='/b'>Second source</a></ul>"
    page = f"<article><p>{LONG}</p><p>{mixed}</p>{inside}<p>{MORE}</p><ul><li><a href='/c'>Read this too</a></ul></article>"
    assert H.extract(page) == "\n".join([LONG, "See a rather long title of a page.", "First source", "Second source", MORE])


def test_scores_against_plain_sums():
    draw = random.Random(2)
    for _ in range(30):
        lines = [("x" * draw.randrange(1, 300), draw.randrange(0, 5), draw.randrange(0, 20), 0, 0, draw.choice([0.0, 0.25, 1.0, 1.0]), "p") for _ in range(draw.randrange(1, 30))]
        ratio = [w * max(0, len(t) - link) / max(1, tags) for t, tags, link, _, _, w, _ in lines]
        kernel = [math.exp(-0.5 * (k / H.SIGMA) ** 2) for k in range(-H.REACH, H.REACH + 1)]
        smooth = [sum(g * ratio[min(max(i + k, 0), len(lines) - 1)] for g, k in zip(kernel, range(-H.REACH, H.REACH + 1), strict=True)) / sum(kernel) for i in range(len(lines))]
        own, score, threshold = H.scores(lines)
        assert own.tolist() == pytest.approx(ratio)
        assert score.tolist() == pytest.approx([s * x[5] for s, x in zip(smooth, lines, strict=True)])
        assert threshold == pytest.approx(statistics.pstdev(smooth))
        near = [s * x[5] >= threshold * (1 - 1e-12) and x[5] > 0 and 2 * x[2] <= len(x[0]) for s, x in zip(smooth, lines, strict=True)]
        core = [ok and r >= threshold * (1 - 1e-12) for ok, r in zip(near, ratio, strict=True)]
        kept = {i for i, ok in enumerate(H.content_lines(lines)) if ok}
        if any(core):  # one region: it stays whole where lines near content have their share
            rest = [i for i, x in enumerate(lines) if x[5] and 2 * x[2] <= len(x[0])]
            assert kept >= {i for i in rest if core[i]}
            if sum(len(lines[i][0]) for i in rest if near[i]) >= H.SHARE * sum(len(lines[i][0]) for i in rest):
                assert kept >= set(rest)


BROKEN = ["<p>a<![foo[b]]>c</p>", "<![ foo", "<!", "<!--", "<!DOCTYPE [", "<!doctype html [<!ENTITY x", "<![CDATA[x]]>y", "<![if !IE]>z<![endif]>", "</", "<a", "<a b='", "&#", "&#xFFFFFFFFF;", "<?php", "<script>", "</p></div></td>", "\x00<p>\ud800</p>", "<table><td>x</table>y"]


def test_any_markup_gives_a_row(spark):
    draw = random.Random(3)
    signs = [*BROKEN, "<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<a href=x>", "</a>", "text ", "<nav>", "</nav>", "'", '"', ">", "<", "]]>", "-->", "<title>", "<textarea>", "</textarea>"]
    pages = [*BROKEN, *("".join(draw.choice(signs) for _ in range(draw.randrange(1, 30))) for _ in range(400)), None, ""]
    for p in pages:
        assert isinstance(H.extract(p), str)
    rows = [(i, None, p and p.replace("\ud800", "x"), 1) for i, p in enumerate(pages)] + [(None, "u", "<p>a", 2), (None, "u", "<p>a", 2)]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.extract("<p>a<![foo[b]]>c</p>") == "ac" and H.extract("<p>kept<a href='x>it is</a>") == "keptit is"


@pytest.mark.parametrize("part", ["<a ", "<!--", "<p a=\"", "<![", "<div>", "</td>", "<div></td>", "<article>", "<nav>", "<td>x", "<ul><li>", "&amp", "<b>x</b>", "<script>"])
def test_time_is_in_proportion(part):
    start = time.time()
    H.extract(part * 100_000)
    assert time.time() - start < 20
    deep = time.time()
    H.extract("<div>" * 100_000 + "x" + part * 100_000)
    assert time.time() - deep < 20
