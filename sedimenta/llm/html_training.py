"""Training of the page model on generated pages: `python -m sedimenta.llm.html_training` writes MODEL anew.

No labelled pages exist, so the pages are generated. Their templates vary in structure, and a page has telling class names
(nav, ad, comments), neutral ones (zone-b, unit-3, made-up words) for everything, or none: so the trees have to know main
text by its place and shape where names don't tell.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np

from sedimenta.llm.html_extract import MODEL, NEVER, Boosted, Page, features

PAGES, SEED, ROUNDS = 3000, 5, 120


def maker(seed: int):
    """A function that gives a new page at each call; <!--m--> marks elements of main text."""
    rng = np.random.default_rng(seed)
    syllables = ["the", "er", "on", "an", "re", "ti", "en", "or", "ha", "st", "la", "ou", "ne", "mi", "so", "ka", "de", "ré", "ñi", "sch", "ü"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p

    def word() -> str:
        return "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))

    def words(a: int, b: int) -> str:
        n = int(rng.integers(a, b))
        return " ".join(word() + (pick([",", ".", ""]) if chance(0.15) else "") for _ in range(n)).capitalize() + "."

    naming = "telling"

    def neutral() -> str:
        base = pick(["zone", "box", "unit", "part", "block", "col", "row", "area", "slot", "cell", "group", "wrap", "layer", "x", word()])
        return pick([f"{base}-{pick('abcdefgh')}", f"{base}{int(rng.integers(99))}", f"{pick(['top', 'mid', 'end', 'left', 'lower', 'my', 'c', word()])}-{base}", base])

    def tag(names: list[str], classes: list[str], inner: str) -> str:
        name = pick(names)
        if naming != "telling":
            if chance(0.6) and name != "form":
                name = pick(["div", "div", "section", "aside"])
            return f'<{name} {pick(["class", "class", "id"])}="{neutral()}">{inner}</{name}>' if naming == "neutral" else f"<{name}>{inner}</{name}>"
        attribute = f' {pick(["class", "id", "class"])}="{pick(classes)}{pick(["", "", "-" + word(), " " + word()])}"' if classes and chance(0.8) else ""
        if name in ("div", "section", "p") and not attribute and classes:  # bare ones are like parts of the main text
            attribute = f' class="{pick(classes)}"'
        return f"<{name}{attribute}>{inner}</{name}>"

    links = lambda a, b: "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(int(rng.integers(a, b)))) + "</ul>"
    flat = lambda a, b: pick([" | ", " ", " &middot; "]).join(f'<a href="/{word()}">{word()}</a>' for _ in range(int(rng.integers(a, b))))

    def rubbish() -> list[tuple[str, str]]:
        """(place, html) of parts that aren't main text."""
        comment = lambda: tag(["div", "li", "article", "p"], ["comment", "comment-body", "reply"], f"<b>{word()}</b> <p>{words(5, 60 if naming == 'telling' else 20)}</p>" + (f"<p>{words(5, 40)}</p>" if naming == "telling" and chance(0.4) else ""))
        return [
            ("top", tag(["nav", "nav", "div"], ["nav", "menu", "navbar", "main-menu"], pick([links, flat])(3, 10))),
            ("top", tag(["header", "div"], ["header", "masthead", "topbar"], f"<h1>{word()}</h1><p>{words(2, 12)}</p>" if chance(0.5) else f'<a href="/">{words(1, 4)}</a> {words(2, 9)}')),
            ("any", tag(["div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "promo", "banner"], pick([words(3, 25), f"<p>{words(4, 30)}</p>", f'<a href="/{word()}">{words(2, 9)}</a>']))),
            ("any", tag(["div", "section", "p"], ["cookie", "cookie-notice", "notice", "consent", "alert", "gdpr"], pick([words(4, 30), f"<p>{words(4, 40)}</p><button>{word()}</button>"]))),
            ("any", tag(["aside", "aside", "div"], ["sidebar", "side", "widget", "related", "recommended"], f"<h3>{words(1, 4)}</h3>" + pick([links(2, 8), f"<p>{words(5, 50)}</p>", flat(2, 6) + f"<p>{words(3, 25)}</p>"]))),
            ("any", tag(["form"], ["search", "signup", "newsletter", "login"], f"<label>{words(1, 6)}</label><input name=q>" + (f"<p>{words(3, 20)}</p>" if chance(0.5) else "") + f"<button>{word()}</button>")),
            ("end", tag(["section", "div"], ["comments", "comment-list", "discussion", "replies"], f"<h2>{words(1, 4)}</h2>" + "".join(comment() for _ in range(int(rng.integers(1, 8 if naming == "telling" else 4)))))),
            ("end", tag(["footer", "footer", "div"], ["footer", "site-footer", "copyright", "bottom"], f"&copy; {word()}.example &middot; {words(2, 40)}" + (flat(2, 6) if chance(0.4) else ""))),
            ("any", tag(["div", "nav", "ul"], ["breadcrumbs", "pagination", "share", "social", "tags"], flat(2, 7))),
        ]

    def main() -> str:
        mark = lambda s: s.replace("<", "<!--m--><", 1)
        title = words(2, 20)
        parts = [f"<h1>{title[:60] if chance(0.6) else title.rstrip('.')}</h1>"] if chance(0.85) else []
        count = int(rng.integers(1, pick([4, 12, 40]))) if chance(0.9) else 0
        if naming != "telling":  # where names don't tell, main text is the largest part
            parts.append(f"<p>{words(30, 120)}</p>")
            count += 2
        for _ in range(count):
            kind = rng.random()
            if kind < 0.75:
                inner = words(1, pick([4, 12, 40, 120]))
                if chance(0.15):
                    inline = pick(["em", "strong", "span", "i"])
                    inner = pick([f"<{inline}>{inner}</{inline}>", f"{words(1, 9)} <{inline}>{words(1, 6)}</{inline}> {inner}"])
                if chance(0.2):
                    inner += f' <a href="/{word()}">{words(1, 6)}</a> {words(2, 30)}'
                parts.append(pick([f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p><b>{inner}<br>", f"<p>{inner}", f"<div>{inner}</div>"]))
            elif kind < 0.82:
                parts.append(f"<h2>{words(1, 8).rstrip('.') if chance(0.6) else words(1, 8)}</h2>")
            elif kind < 0.89:
                parts.append("<ul>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote><p>{words(5, 50)}</p></blockquote>")
            elif kind < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr>" for _ in range(int(rng.integers(1, 5)))) + "</table>")
            else:
                parts.append(f"<pre>{words(3, 40)}</pre>")
        marked = [mark(p) for p in parts]
        if len(marked) > 3 and chance(0.2):  # the rest in sections
            cut = int(rng.integers(1, len(marked) - 1))
            name = pick(["section", "div"])
            marked = [*marked[:1], f"<{name}>{''.join(marked[1 : cut + 1])}</{name}>", f"<{name}>{''.join(marked[cut + 1 :])}</{name}>"]
        return "".join(marked)

    def page() -> str:
        nonlocal naming
        naming = pick(["telling", "telling", "neutral", "neutral", "none"])
        extra = [x for x in rubbish() if chance(0.45)]
        inner = main()
        inside = [h for place, h in extra if place == "any" and naming == "telling" and chance(0.25)]  # without names nobody could tell
        body = pick(["<article>{}</article>", "<article>{}</article>", "{}", "<div>{}</div>", '<div class="text">{}</div>', '<div class="content">{}</div>', "<main>{}</main>", '<main><article class="post">{}</article></main>', '<div id="main"><div class="entry-content">{}</div></div>', "<section>{}</section>", '<div class="story">{}</div>']).format(inner + "".join(inside))
        top = [h for place, h in extra if place == "top"] + [h for place, h in extra if place == "any" and h not in inside and chance(0.5)]
        end = [h for place, h in extra if place == "any" and h not in inside and h not in top] + [h for place, h in extra if place == "end"]
        if naming != "telling":
            if body.startswith("<!--m--><"):
                body = f"<div>{body}</div>"
            body = re.sub(r'class="\w[\w-]*"|id="\w+"', lambda _: f'class="{neutral()}"' if naming == "neutral" else "", body, count=2)
            if chance(0.4):
                top, end = ([f'<div class="{neutral()}">{"".join(x)}</div>'] if x else [] for x in (top, end))
        wrap = pick(["{}", "{}", '<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>'])
        return f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{}}</style><script>var a=1;</script></head><body>" + wrap.format("".join(top) + body + "".join(end)) + "</body></html>"

    return page


_MARKED = re.compile(r"<!--m-->")


def labelled(html: str) -> tuple[Page, np.ndarray]:
    """A generated page and whether each element holds marked text: marks become an attribute before parsing."""
    page = Page(_MARKED.sub("", html))
    marked = Page(re.sub(r"<!--m--><(\w+)", r'<\1 id="trainmark"', html))
    y = np.array(["trainmark" in t for t in marked.tokens])
    for i in range(1, len(y)):  # what is inside a marked element
        y[i] |= y[marked.parents[i]] and "trainmark" in _ancestors(marked, i)
    for i in range(len(y) - 1, 0, -1):
        y[marked.parents[i]] |= y[i]
    return page, y


def _ancestors(page: Page, i: int) -> set[str]:
    out: set[str] = set()
    while i > 0:
        out.update(page.tokens[i])
        i = page.parents[i]
    return out


def train(pages: int = PAGES, seed: int = SEED) -> Boosted:
    make, x, y = maker(seed), [], []
    for _ in range(pages):
        page, labels = labelled(make())
        use = [i for i, t in enumerate(page.tags) if i and t not in NEVER and t not in ("html", "title", "meta")]
        x.append(features(page)[use])
        y.append(labels[use])
    return Boosted(rounds=ROUNDS).fit(np.concatenate(x), np.concatenate(y).astype(float))


def main() -> None:
    model = train()
    kept = {"depth": model.depth, "bins": model.bins, "base": model.base, "cuts": [[float(f"{v:.6g}") for v in c] for c in model.cuts]}
    kept |= {"feature": [x.tolist() for x in model.feature], "cut": [x.tolist() for x in model.cut], "value": [[float(f"{v:.5g}") for v in x] for x in model.value]}
    Path(__file__).with_name(MODEL).write_text(json.dumps(kept, separators=(",", ":")) + "\n")


if __name__ == "__main__":
    main()
