"""Links of a web page with what their cards say: one pass over its tags with a stack of open elements."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict

#: A tag, comment or declaration. Quotes count only after ``=``; whatever isn't closed ends where the page does.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</([A-Za-z][^\s/>]*+)[^>]*+>?|<([A-Za-z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+|))*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))""")

#: Fixed values of HTML: elements without an end, with raw text, that don't part words (links do here), and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
INLINE = frozenset("abbr b bdi bdo cite code data em font i kbd mark q s samp small span strong sub sup time tt u var wbr".split())
BLOCK = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An open element of the name ends where the next begins, but not beyond one of these.
ENDS_BEFORE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "a": (), "p": ("table", "button")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Element:
    """An open element: where its text, pictures and headings begin, and its number as a card if it is one."""

    __slots__ = ("card", "heading", "images", "link", "links", "name", "text")

    def __init__(self, name: str, text: int, images: int, links: int):
        self.name, self.text, self.images, self.links = name, text, images, links
        self.card = self.link = self.heading = None


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), entities.unescape("".join(values)))
    return out


def card_links(page: str | None, card_class: str) -> tuple[str, list[dict], list[dict], list[tuple[int, int]], list[str]]:
    """(text, links, cards, headings, picture texts) of a page.

    A link's card is its nearest ancestor with a class that ``card_class`` is found in, else its parent if that holds no other link, else the link. Cards and
    headings are places in the text, so nested ones cost nothing. The work is linear in the page.
    """
    page = page or ""
    piece: list[str] = []
    size = 0
    stack: list[_Element] = []
    open_at: dict[str, list[int]] = defaultdict(list)
    classed: list[int] = []
    links: list[dict] = []
    cards: list[dict] = []
    headings: list[list[int]] = []
    images: list[str] = []
    is_card = re.compile(card_class)

    def say(text: str) -> None:
        nonlocal size
        piece.append(text)
        size += len(text)

    def close(level: int) -> None:
        """End the element at ``level`` of the stack and all in it."""
        while len(stack) > level:
            e = stack.pop()
            open_at[e.name].pop()
            if classed and classed[-1] == len(stack):
                classed.pop()
            if e.card is not None:
                cards[e.card] |= {"end": size, "images": (e.images, len(images)), "links": len(links) - e.links}
            if e.link is not None:
                links[e.link] |= {"images": (e.images, len(images))}
            if e.heading is not None:
                headings[e.heading][1] = size

    def card_of(e: _Element) -> int:
        if e.card is None:
            e.card = len(cards)
            cards.append({"begin": e.text})
        return e.card

    def within(name: str, bounds: tuple[str, ...]) -> int | None:
        """Level of the innermost open ``name``, unless one of ``bounds`` is open in it."""
        level = open_at[name][-1] if open_at[name] else None
        return None if level is None or any(open_at[b] and open_at[b][-1] > level for b in bounds) else level

    at = 0
    while at < len(page):
        tag = _TAG.search(page, at)
        text = page[at : tag.start() if tag else len(page)]
        if text:
            say(entities.unescape(text) if "&" in text else text)
        if tag is None:
            break
        at = tag.end()
        ended, begun = (tag[1] or "").lower(), (tag[2] or "").lower()
        if ended:
            if open_at[ended]:
                close(open_at[ended][-1])
            if ended not in INLINE:
                say(" ")
        elif begun:
            for name in {begun if begun in ENDS_BEFORE else None, "p" if begun in BLOCK else None} - {None}:
                level = within(name, ENDS_BEFORE[name])
                if level is not None:
                    close(level)
            if begun not in INLINE:
                say(" ")
            if begun == "img":
                images.append(_attributes(tag[3]).get("alt", ""))
            if begun in VOID or tag[3].endswith("/") and begun not in ("a", *HEADINGS):
                continue
            if begun in RAW:
                stop = re.compile(rf"</{begun}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else len(page)
                continue
            e = _Element(begun, size, len(images), len(links))
            stack.append(e)
            open_at[begun].append(len(stack) - 1)
            known = _attributes(tag[3]) if "=" in tag[3] else {}
            if begun == "a" and "href" in known:
                e.link = len(links)
                own = card_of(e)
                card = card_of(stack[classed[-1]]) if classed else None
                parent = card_of(stack[-2]) if len(stack) > 1 else own
                links.append({"url": known["href"], "title": known.get("title", ""), "card": card, "parent": parent, "own": own, "headings": len(headings)})
            if begun in HEADINGS:
                e.heading = len(headings)
                headings.append([size, size])
            if is_card.search(known.get("class", "")):
                classed.append(len(stack) - 1)
    close(0)
    for x in links:
        if x["card"] is None:
            x["card"] = x["parent"] if cards[x["parent"]]["links"] == 1 else x["own"]
    return "".join(piece), links, cards, [tuple(h) for h in headings], images


def episode_links(page: str | None, card_class: str, word: str) -> list[dict]:
    """(url, title, alt, number, heading, date) of each link: what its card says first, by fixed forms.

    The forms are looked for once in the page's text; a card takes the first that lies in it.
    """
    text, links, cards, headings, images = card_links(page, card_class)
    forms = {name: [(m.start(), m.end(), m[1]) for m in re.finditer(form, text, re.I)] for name, form in (number_forms(word) | DATE_FORMS).items()} if links else {}

    def first(name: str, begin: int, end: int) -> str:
        k = bisect_left(forms[name], (begin,))
        return forms[name][k][2] if k < len(forms[name]) and forms[name][k][1] <= end else ""

    def picture(span: tuple[int, int]) -> str:
        return images[span[0]] if span[0] < span[1] else ""

    told = []
    for c in cards:
        say = lambda *names, c=c: next((x for n in names if (x := first(n, c["begin"], c["end"]))), "")
        told.append((say("N. word", "Episódio N", "word N"), say("named date", "date")))
    of_heading = [(re.match(rf"\s*(\d+)\.\s*(?:{word})", text[b:e], re.I) or ("", ""))[1] for b, e in headings]
    out, before = [], 0
    for x in links:
        number, date = told[x["card"]]
        near = [n for n in of_heading[before : x["headings"]] if n]
        before = x["headings"]
        alt = picture(x["images"]) or picture(cards[x["card"]]["images"])
        out.append({"url": x["url"], "title": x["title"], "alt": alt, "number": number, "heading": near[-1] if near else "", "date": date})
    return out


#: How a card's text tells its date.
DATE_FORMS = {"named date": r"Capítulo de\s+(\d{2}/\d{2}/\d{4})", "date": r"(\d{2}/\d{2}/\d{4})"}


def number_forms(word: str) -> dict[str, str]:
    """How a card's text tells its number."""
    return {"N. word": rf"(?<!\S)(\d+)\.\s*(?:{word})", "Episódio N": r"Epis[óo]dio\s*(\d+)", "word N": rf"(?:{word})\s+(\d+)"}
