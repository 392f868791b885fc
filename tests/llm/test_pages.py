"""Main text of pages whose templates and names the training pages don't know, rendering, and hostile pages."""

import random
import re
import time
from html import unescape

import pytest

from sedimenta.llm import html_extract

SENTENCES = """The river rose overnight and the lower fields were under water by morning.
Nobody on the committee expected the vote to be so close, least of all its chair.
She kept the old ledger in a drawer, next to the letters her grandfather never sent.
Prices fell again in March, which surprised analysts who had predicted a slow recovery.
A short walk from the station leads to the garden, open to visitors on most weekends.
The recipe calls for two cups of flour, a pinch of salt and rather more butter than seems wise.
Engineers replaced the bearings twice before they found the crack in the housing.
It was, he said later, the only decision of that year he would not change.""".split("\n")


def article(rng):
    """(html, blocks) of an article's inside."""
    blocks = [rng.choice(["How the water came back", "A close vote", "Notes on an old ledger", "What the engineers missed"])]
    html = [f"<h1>{blocks[0]}</h1>"]
    for _ in range(rng.randrange(3, 9)):
        text = " ".join(rng.sample(SENTENCES, rng.randrange(1, 4)))
        blocks.append(text)
        html.append(rng.choice(["<p>{}</p>", "<p>{}", "<p><em>{}</em></p>"]).format(text))
        if rng.random() < 0.2:
            blocks += [text[:20].strip() + " one", text[:20].strip() + " two"]
            html.append(f"<ul><li>{blocks[-2]}</li><li>{blocks[-1]}</li></ul>")
    return "".join(html), blocks


def links(rng, n):
    return "".join(f"<li><a href='/p/{k}'>{rng.choice(['Home', 'World', 'Science', 'Sport', 'Travel', 'Weather'])}</a></li>" for k in range(n))


def page(rng, kind):
    """(html, main text): everything beside the article has names that say nothing."""
    inner, blocks = article(rng)
    above = f"<div class=q-one><ul>{links(rng, 6)}</ul></div>"
    offers = f"<div class=kk-b><p>Save forty percent on garden chairs this week only.</p></div>"
    more = f"<div class=kk-c><h3>You may like these too</h3><ul>{links(rng, 4)}</ul></div>"
    low = "<div class=lower-q>&copy; 2024 The Daily Example. All rights reserved. <a href=/t>Terms</a> <a href=/p>Privacy</a></div>"
    said = "".join(f"<div class=rr><b>reader{k}</b><p>{rng.choice(['I was there and it was worse.', 'Thanks for this!', 'Not sure that I agree, but a good read.'])}</p></div>" for k in range(rng.randrange(1, 5)))
    holder = {"div": f"<div class=mid-k>{inner}</div>", "article": f"<article>{inner}</article>", "nested": f"<div class=hold><div class=k7><div class=k8>{inner}</div></div></div>", "main": f"<main id=z9>{inner}</main>"}[kind]
    below = rng.sample([offers, more, f"<div class=vv><h3>Six replies</h3>{said}</div>"], rng.randrange(1, 4)) + [low]
    body = above + rng.choice(["", offers]) + holder + "".join(below)
    return f"<html><head><title>x</title></head><body>{rng.choice(['{}', '<div class=shell>{}</div>']).format(body)}</body></html>", "\n".join(blocks)


@pytest.mark.parametrize("kind", ["div", "article", "nested", "main"])
def test_pages_of_neutral_names(kind):
    rng, model = random.Random(kind), html_extract.trained()
    cases = [page(rng, kind) for _ in range(60)]
    got = html_extract.extract([h for h, _ in cases], model)
    assert sum(g == w for g, (_, w) in zip(got, cases, strict=True)) / len(cases) > 0.9


def test_rendering_by_brute_force():
    """With everything kept, blocks are what remains between block tags when all other tags go."""
    rng = random.Random(6)
    block = ["p", "div", "h2", "li", "td", "section"]
    for _ in range(200):
        parts = []
        for _ in range(rng.randrange(1, 25)):
            name = rng.choice(block + ["b", "i", "span"])
            parts.append(rng.choice([f"<{name}>", f"</{name}>", "a &lt; b ", " two\n words", "&eacute;", "<br>", "<!-- x -->", "  "]))
        html = "".join(parts)
        cut = re.sub(r"<!--.*?-->", "", html)
        cut = re.sub(r"<br>", " ", cut)
        cut = re.sub(rf"</?({'|'.join(block)})>", "\x00", cut)
        cut = re.sub(r"</?(b|i|span)>", "", cut)
        want = [" ".join(unescape(x).split()) for x in cut.split("\x00")]
        found = html_extract.Page(html)
        assert html_extract.render(found, [True] * len(found.tags)) == "\n".join(x for x in want if x), html


HOSTILE = {
    "cdata": "<![CDATA[" * 110_000,
    "stray ends": "<div>" * 100_000 + "</p>" * 120_000,
    "quotes": "<c \">\" " * 140_000 + "'",
    "open quotes": "<a '" * 250_000,
    "cells": "<td><table>" + "<b>" * 100_000 + "<td></td>" * 70_000,
    "bodies": "<b>" * 150_000 + "<body>" * 80_000,
    "scripts": "<script></script" * 60_000,
    "spaces": "a<b> </b> " * 100_000,
    "less than": "<" * 1_000_000,
    "ends": "</a" * 330_000,
    "declarations": "<!" * 500_000,
    "references": "&amp" * 250_000,
    "deep": "<div>x" * 160_000,
    "lists": "<ul><li>" * 120_000,
    "attributes": "<a " + "b='" * 300_000 + ">",
    "paragraphs": "<p><b>" * 160_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    began = time.process_time()
    html_extract.extract([HOSTILE[name]], html_extract.trained())
    assert time.process_time() - began < 15  # quadratic ones take minutes


def test_deep_pages_keep_their_text():
    found = html_extract.Page("<div>x" * 3000)
    assert html_extract.render(found, [True] * len(found.tags)) == "\n".join("x" * 3000)


def test_the_kept_model_is_quick():
    html_extract.trained.cache_clear()
    began = time.process_time()
    html_extract.trained()
    assert time.process_time() - began < 2
