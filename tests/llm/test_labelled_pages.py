"""Pages made with their article text known: what the extractor returns is that, block for block."""

import html
import random
import time

import pytest

from millrace.llm import html_text

VOCAB = "river stone morning paper window garden bridge letter winter engine copper meadow signal harbour season lantern".split()
ODD = "share related notice search comment legal social alert sponsor login cookie sidebar ad menu".split()


def sentence(r, least=6, most=14):
    return " ".join(r.choice(VOCAB) for _ in range(r.randint(least, most))).capitalize() + r.choice([".", ".", ", and more.", "!", "?"])


def paragraph(r):
    return " ".join(sentence(r) for _ in range(r.randint(2, 5)))


def attributes(r, container=False):
    """Ids and classes that hold odd words without saying that the element is for other things. A container's id names no readers' comments."""
    odd, word = r.choice([w for w in ODD if not container or w != "comment"]), r.choice(VOCAB)
    return r.choice(["", "", f' id="{odd}"', f' id="{odd}-{word}"', f" class='{odd}-{word}'", f" class='{word} {word}-{odd}'", f' class="{word}_{odd}" id={odd}'])


def other(r, inside):
    """Something that is no article text."""
    word = r.choice(["ad", "advert", "sponsored", "newsletter", "cookie-banner", "share-buttons", "related-posts", "comments", "comment-list", "promo box"])
    inner = f"<p>{paragraph(r)}</p>" if r.random() < 0.5 else f"<div><a href='/x'>{sentence(r, 2, 3)}</a></div>"
    kinds = [f"<div class='{word}'>{inner}</div>", f"<aside>{inner}</aside>", f"<form>{sentence(r)}<input name=a><button>Go</button></form>", "<script>var a = '<p>no</p>';</script>", "<style>p > a { color: red }</style>", f"<div hidden>{inner}</div>", f"<div role='navigation'>{inner}</div>", f"<!-- <p>{paragraph(r)}</p> -->"]
    if not inside:
        kinds += [f"<nav><ul><li><a href='/'>{sentence(r, 1, 2)}</a><li><a href='/b'>b</a></ul></nav>", f"<footer><p>{paragraph(r)}</p></footer>", f"<header><p>{sentence(r)}</p></header>"]
    return r.choice(kinds)


def block(r, want):
    """An article's block; its text goes to `want`."""
    kind = r.random()
    if kind < 0.15:
        text = sentence(r, 2, 4)
        want.append(text)
        return f"<h2{attributes(r)}>{text}</h2>"
    if kind < 0.25:
        items = [sentence(r, 3, 6) for _ in range(r.randint(2, 4))]
        want += items
        return "<ul>" + "".join(f"<li{attributes(r)}>{t}" + r.choice(["", "</li>"]) for t in items) + "</ul>"
    if kind < 0.35:
        text = paragraph(r)
        want.append(text)
        return f"<div{attributes(r, True)}><blockquote{attributes(r)}>{text}</blockquote></div>"
    text = paragraph(r)
    want.append(text)
    body = html.escape(text).replace(" ", r.choice([" ", "\n  ", " "]), 3)
    first, _, rest = body.partition(" ")
    return f"<p{attributes(r)}><a href='/w'>{first}</a> {rest}" + r.choice(["", "</p>"])


def made(seed):
    r, want = random.Random(seed), []
    title = sentence(r, 3, 6)
    want.append(title)
    inside = [f"<h1{attributes(r)}>{title}</h1>"]
    depth = r.randint(0, 2)
    inside += ["<div class='entry-content'>"] * depth
    for _ in range(r.randint(6, 14)):
        inside.append(block(r, want))
        if r.random() < 0.3:
            inside.append(other(r, True))
    inside += ["</div>"] * depth
    tag = r.choice(["article", "main"])
    around = "".join(other(r, False) for _ in range(r.randint(0, 3)))
    after = "".join(other(r, False) for _ in range(r.randint(0, 3)))
    return f"<!doctype html><html><head><title>t</title></head><body>{around}<div id=page><{tag}>{''.join(inside)}</{tag}></div>{after}</body></html>", want


@pytest.mark.parametrize("part", range(4))
def test_labelled_pages(part):
    for seed in range(part * 100, part * 100 + 100):
        page, want = made(seed)
        assert html_text.main_text(page) == "\n\n".join(want), seed


def test_words_in_names_do_not_decide():
    for name, other_things in {"comment-on-policy": False, "legal-analysis": False, "comments": True, "comment-list": True, "adBox": True, "x-buy": True, "advice": False, "post-content": False, "nav_2": True, "Share": True, "": False}.items():
        assert html_text._named(name) == other_things, name


def test_time_grows_with_length():
    page, _ = made(1)
    body = page[page.index("<h1") : page.rindex("</")]
    odd = "<div class='a b'><p>one < two &amp; \"three\" <b>x</b>, <a href=\"y\">z</a>. " * 40

    def seconds(n):
        took = []
        for _ in range(3):
            at = time.perf_counter()
            html_text.main_text("<article>" + (body + odd) * n)
            took.append(time.perf_counter() - at)
        return min(took)

    assert seconds(40) < 8 * seconds(10)  # four times the length
