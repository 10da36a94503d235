"""Main text of pages: tags in linear time, names within articles, and the second pass against brute force."""

import random
import time

import pytest

from mailcorpus.llm import html

LONG = "it was the best of times and it was the worst of times for all of us who were there and " * 4
ONE = " ".join(LONG.split())
LINKS = " ".join(f"<a href='/{k}'>some link {k}</a>" for k in range(30))


@pytest.mark.parametrize("piece", ["<button>", "<svg>x", "<p ", "<!x ", "</button ", "<a href='", "<script", "<b class  ", "<div>", "</ul>"])
@pytest.mark.parametrize("tail", ["", ">"])
def test_time_is_linear_in_the_page(piece, tail):
    def took(size):
        began = time.process_time()
        html.extract(piece * (size // len(piece)) + tail)
        return time.process_time() - began

    assert took(1_000_000) < 10  # some two seconds; a look at the rest of the page for each tag takes many minutes


def test_deep_elements_that_others_end():
    assert html.extract("<div>" * 50_000 + "</ul>" * 50_000 + f"<article><p>{LONG}</p></article>") == ONE


@pytest.mark.parametrize("tag", ["button", "svg", "select"])
def test_elements_without_text(tag):
    page = f"<article><p>{LONG}</p><{tag} title='a>b'>gone</{tag.upper()} ><p>{LONG}</p></article>"
    assert html.extract(page) == f"{ONE}\n{ONE}"
    assert html.extract(f"<article><p>{LONG}</p><{tag}><p>{LONG}</p></article>") == f"{ONE}\n{ONE}"


@pytest.mark.parametrize("name", ["discussion", "legal", "side", "legal side"])
def test_weak_names_within_an_article_decide_nothing(name):
    part = f'<section id="{name}"><h2>Findings</h2><p>{LONG}</p></section>'
    assert html.extract(f"<article><p>{LONG}</p>{part}</article>") == f"{ONE}\nFindings\n{ONE}"
    # Outside it they do, and within it a list of links is still none of its text.
    assert html.extract(f"<article><p>{LONG}</p></article>{part}") == ONE
    assert html.extract(f'<article><p>{LONG}</p><div class="{name}"><p>{LINKS}</p></div></article>') == ONE


@pytest.mark.parametrize("name", ["notice", "comments", "cookie-notice", "advert", "discussion comments", "newsletter"])
def test_strong_names_within_an_article_decide(name):
    assert html.extract(f'<article><p>{LONG}</p><div class="{name}"><p>{LONG}</p></div><p>{LONG}</p></article>') == f"{ONE}\n{ONE}"


def brute(first, heading, article):
    out = []
    for k, label in enumerate(first):
        left = next((i for i in range(k - 1, -1, -1) if first[i] in ("good", "bad")), None)
        right = next((i for i in range(k + 1, len(first)) if first[i] in ("good", "bad")), None)
        if label in ("good", "bad"):
            out.append(label == "good")
        elif left is None and right is None:
            out.append(False)
        elif left is None or right is None or first[left] == first[right]:
            out.append(first[right if left is None else left] == "good")
        elif heading[k]:
            out.append(first[right] == "good")
        elif label == "middling" or article[k]:
            out.append(True)
        else:
            out.append(first[left if k - left <= right - k else right] == "good")
    return out


def test_second_pass_against_brute_force():
    draw = random.Random(7)
    for _ in range(5000):
        n = draw.randint(0, 14)
        first = [draw.choice(["good", "bad", "short", "short", "middling"]) for _ in range(n)]
        heading, article = ([draw.random() < 0.3 for _ in range(n)] for _ in range(2))
        assert html._settled(first, heading, article) == brute(first, heading, article)


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>", "other", 7)], "page_id long, url string, html string, text string, n_chars int")
    (row,) = html.main_text(df).collect()
    assert (row.page_id, row.text, row.n_chars) == (1, ONE, len(ONE))
