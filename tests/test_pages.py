"""The page reader against a tree model, on broken pages and in time."""

import random
import re
import time

import pytest

from cueforge.functions import pages

CARDS = "episode|card|item|chapter|video|content"


class Node:
    def __init__(self, name, attrs=None, kids=()):
        self.name, self.attrs, self.kids, self.parent = name, attrs or {}, [], None
        for k in kids:
            self.add(k)

    def add(self, kid):
        self.kids.append(kid)
        if isinstance(kid, Node):
            kid.parent = self

    def source(self):
        inside = "".join(k if isinstance(k, str) else k.source() for k in self.kids)
        tag = self.name + "".join(f' {a}="{v}"' for a, v in self.attrs.items())
        return f"<{tag}>" if self.name in pages.VOID else f"<{tag}>{inside}</{self.name}>"

    def text(self):
        gap = "" if self.name in pages.INLINE else " "
        return gap + "".join(k if isinstance(k, str) else k.text() for k in self.kids) + (gap if self.name not in pages.VOID else "")

    def walk(self):
        yield self
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.walk()


def tree(r, depth=0):
    n = Node(r.choice(("div", "section", "article", "span", "ul")), {"class": r.choice(("x", "card wide", "my-item", "row"))} if r.random() < 0.6 else None)
    for _ in range(r.randrange(1, 5)):
        kind = r.random()
        if kind < 0.35 and depth < 5:
            n.add(tree(r, depth + 1))
        elif kind < 0.55:
            n.add(Node("a", {"href": f"/v/{r.randrange(99)}/?s=0s", "title": "t"}, [r.choice(("Ver", "3. Capítulo", "hoje 01/02/2024"))] + ([Node("img", {"alt": "Capítulo de 05/06/2021"})] if r.random() < 0.3 else [])))
        elif kind < 0.65:
            n.add(Node("h3", None, [r.choice(("12. Episódio", "Outra", "7. capítulo"))]))
        elif kind < 0.7:
            n.add(Node("br"))
        else:
            n.add(r.choice((" word ", "Episódio 4 ", " Capítulo de 11/12/2020 ", " 31/12/1999 ", " 8. Episódio ", "Capítulo  5 ", " x")))
    return n


def expected(root):
    every = list(root.walk())
    links = [n for n in every if n.name == "a"]
    out, before = [], -1
    for a in links:
        up, n = [], a.parent
        while n is not None:
            up.append(n)
            n = n.parent
        card = next((n for n in up if re.search(CARDS, n.attrs.get("class", ""))), None) or (up[0] if sum(n.name == "a" for n in up[0].walk()) == 1 else a)
        text = card.text()
        first = lambda *forms, text=text: next((m[1] for f in forms if (m := re.search(f, text, re.I))), "")
        number = first(*pages.number_forms("Cap[íi]tulo|Epis[óo]dio").values())
        date = first(*pages.DATE_FORMS.values())
        at = every.index(a)
        near = [m[1] for n in every[before + 1 : at] if n.name == "h3" and (m := re.match(r"\s*(\d+)\.\s*(?:Cap[íi]tulo|Epis[óo]dio)", n.text(), re.I))]
        before = at
        alt = [n.attrs["alt"] for n in a.walk() if n.name == "img"] or [n.attrs["alt"] for n in card.walk() if n.name == "img"] or [""]
        out.append({"url": a.attrs["href"], "title": "t", "alt": alt[0], "number": number, "heading": near[-1] if near else "", "date": date})
    return out


@pytest.mark.parametrize("seed", range(60))
def test_cards_equal_a_tree_model(seed):
    root = Node("html", None, [tree(random.Random(seed)), tree(random.Random(seed + 1000))])
    assert pages.episode_links("<!DOCTYPE html>" + root.source(), CARDS, "Cap[íi]tulo|Epis[óo]dio") == expected(root)


def links(source):
    return pages.episode_links(source, CARDS, "Capítulo|Episódio")


def test_broken_pages():
    assert links(None) == links("") == links("<") == links("a < b <3 </ <!-- <a href=x>") == []
    item = '<li class="item">%s <a href="/v/1">x</a> %s'
    got = links("<ul>" + item % ("1. Capítulo", "") + item % ("2. Capítulo", "05/05/2025") + "</ul>3. Capítulo")
    assert [(x["number"], x["date"]) for x in got] == [("1", ""), ("2", "05/05/2025")]
    assert links("<script>'<a href=/v/1>'</script><style><a href=/v/1></style><SCRIPT><a href=2>") == []
    assert [x["url"] for x in links("<a href=/v/1?s=0s&amp;t>x<a HREF='/v/\"2'>y</a><a href=\"/v/3>z</a>")] == ["/v/1?s=0s&t", '/v/"2']
    assert links('<div class="card"><p>1<b>2</b>. Capítulo<p><a href="/v/1"/>x</div>')[0]["number"] == "12"
    assert links('<div><p class="content">9. Episódio<div><a href="/v/1">x</a></div></div>')[0]["number"] == ""


@pytest.mark.parametrize("page", ["word <b>x</b> 1 < 2 " * 60_000, "<div class='item'>" * 60_000 + "5. Capítulo", "<div class=item><a href=/v/1>1. Capítulo " * 25_000, "<b><p>" * 150_000, "<!" * 500_000, '<a href="' * 110_000, "</p>" * 250_000, "<a href=/v/1>" * 80_000, "<script>" * 120_000, "<li><ul>" * 120_000, "<h2>1. Episódio" * 70_000])
def test_linear_in_a_long_page(page):
    began = time.process_time()
    links(page)
    assert time.process_time() - began < 5
