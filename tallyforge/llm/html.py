"""Blocks of a web page: their text, the element they stand in, and what the markup says of them (article, furniture, nothing)."""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from typing import NamedTuple

#: What the markup says of a block: in an article; in the main part of a page; nothing; menus, adverts, comments and the like.
ARTICLE, MAIN, OPEN, MARKED = "article", "main", "open", "marked"
#: Marked, and so is an article in it; and what a class name or an id calls the content.
HARD, CONTENT = "hard", "content"

#: Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
SILENT = frozenset("head script style xmp iframe noembed noframes noscript template svg object video audio canvas select datalist button textarea option title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter nobr output picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SOFT_TAGS, HARD_TAGS = frozenset("nav header footer form menu dialog".split()), frozenset(["aside"])
SOFT_ROLES = frozenset("navigation banner contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
#: An element of the second kind ends open ones of the first, up to the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words in class names and ids: of reader comments and links to elsewhere (never an article, whatever stands in them), of other
#: furniture, and of adverts. A star ends what a word may start with.
HARD_WORDS = "comment* disqus* related* recommend* respond responses replies discussion*"
SOFT_WORDS = "nav navbar navigation* menu menus notice notices consent gdpr toolbar pager pagination* share shares sharing social* modal popup overlay login signin signup cookie* alert* promo* banner* masthead breadcrumb* newsletter* subscri* footer* header* sidebar* widget*"
AD_WORDS = "ad ads adv adbox adslot advert* sponsor*"
#: Words that say nothing by themselves in an id, and words of a class name that say that a header is the article's own.
NEUTRAL = frozenset("area section list box container wrapper wrap block form main top bottom site page left right inner outer panel bar the global primary secondary".split())
OWN = frozenset("article post entry story content title section page main".split())
#: Words of which a class name or an id is made that names the content of a page.
CALLED = frozenset("article post entry story content main body text".split())
#: First words of class names that tell of a layout, not of the element's own part.
LAYOUT = frozenset("has with no without is js".split())


def _matcher(words: str) -> re.Pattern:
    return re.compile("(?:" + "|".join(re.escape(w[:-1]) + "[a-z]*" if w.endswith("*") else re.escape(w) for w in words.split()) + ")$")


_HARD, _SOFT, _AD = _matcher(HARD_WORDS), _matcher(SOFT_WORDS), _matcher(AD_WORDS)
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?+""")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Block(NamedTuple):
    text: str
    zone: str
    tag: str
    #: class and id of the element, "" without
    signature: str
    #: share of characters within links
    linked: float


def _words(value: str) -> list[str]:
    return _WORD.findall(_CAMEL.sub(" ", value).lower())


def _cue(tag: str, given: dict[str, str]) -> str:
    """What an element's own name, role, class and id say: "hard", "soft", or ""."""
    if tag in HARD_TAGS or "hidden" in given or given.get("aria-hidden") == "true" or _HIDDEN.search(given.get("style", "")):
        return "hard"
    role = given.get("role", "").lower()
    if role == "complementary":
        return "hard"
    if tag in ("html", "body"):
        return ""
    names = [_words(t) for t in given.get("class", "").split()]
    names = [n for n in names if n and n[0] not in LAYOUT]
    ident = _words(given.get("id", "")) if tag not in HEADINGS else []
    matched = lambda w: bool(_HARD.match(w) or _SOFT.match(w) or _AD.match(w) or w in NEUTRAL or w.isdigit())
    if ident and all(map(matched, ident)):
        names.append(ident)
    if tag in INLINE:
        return "soft" if any(_AD.match(w) for n in names for w in n) else ""
    if any(_HARD.match(w) for n in names for w in n):
        return "hard"
    if tag in ("article", "main"):
        return "hard" if any(_AD.match(w) for n in names for w in n) else ""
    for n in names:
        own = any(w in OWN for w in n)
        if any((_SOFT.match(w) and not (own and w.startswith("header"))) or _AD.match(w) for w in n):
            return "soft"
    return "soft" if tag in SOFT_TAGS or role in SOFT_ROLES else ""


@lru_cache(maxsize=20_000)
def _element(tag: str, raw: str) -> tuple[str, str | None, str]:
    """(cue, zone that it opens or None, signature) of a start tag. Attributes are those of the first of each name."""
    given = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(raw)))} if raw else {}
    zones = {"article": ARTICLE, "main": MAIN}
    own = zones.get(tag) or zones.get(given.get("role", "").lower()) or (MAIN if "articlebody" in given.get("itemprop", "").lower() else None)
    if own is None and tag in ("div", "section", "td"):
        names = [_words(t) for t in [*given.get("class", "").split(), given.get("id", "")]]
        own = CONTENT if any(n and all(w in CALLED for w in n) and n != ["body"] and n != ["text"] for n in names) else None
    return _cue(tag, given), own, f"{given.get('class', '')}#{given.get('id', '')}" if given.get("class") or given.get("id") else ""


class Open(NamedTuple):
    """An element that is open: what holds for the text in it."""

    tag: str = "body"
    zone: str = OPEN
    signature: str = ""
    silent: bool = False
    inline: bool = False
    linked: bool = False
    code: bool = False
    #: whether an article or a main part is around it
    inside: bool = False
    #: whether a paragraph is open that the next block ends
    paragraph: bool = False


def _nested(outer: Open, tag: str, raw: str) -> Open:
    cue, own, signature = _element(tag, raw) if len(raw) < 1000 else _element.__wrapped__(tag, raw)
    if outer.code:
        cue = ""
    zone = outer.zone
    if zone == HARD or cue == "hard":
        zone = HARD
    elif own and own != CONTENT and zone != ARTICLE and not (outer.inside and zone == MARKED):
        zone = own
    elif own == CONTENT and zone == OPEN and not cue:
        zone = own
    elif cue == "soft" and not (tag == "header" and outer.inside and zone != MARKED):
        zone = MARKED
    return Open(tag, zone, signature, outer.silent or tag in SILENT, tag in INLINE, outer.linked or tag == "a", outer.code or tag in ("pre", "code"), outer.inside or zone in (ARTICLE, MAIN), tag == "p" or outer.paragraph and tag not in ("table", "button"))


def _finish(held: list[tuple[str, Open]], stack: list[Open], out: list[Block]) -> None:
    """Add the block of the pieces that are held, and one of those of its pieces that are marked."""
    at = stack[-1] if not stack[-1].inline else next(e for e in reversed(stack) if not e.inline)
    if len(held) == 1 and not held[0][1].linked:
        [(text, e)] = held
        if text := " ".join(text.split()):
            out.append(Block(text, MARKED if e.zone == HARD else e.zone, at.tag, at.signature, 0.0))
        held.clear()
        return
    for marked in (False, True):
        own = [h for h in held if (h[1].zone in (MARKED, HARD)) == marked]
        text = " ".join("".join([t for t, _ in own]).split()) if own else ""
        if text:
            linked = sum(len(t) for t, e in own if e.linked)
            out.append(Block(text, MARKED if marked else own[0][1].zone, at.tag, at.signature, linked / sum(len(t) for t, _ in own) if linked else 0.0))
    held.clear()


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, markup and character references resolved, white space within a block as one space.

    Elements are nested as a lenient reader would: an end tag ends the nearest element of its name and what is open within it,
    a new block ends an open paragraph, and what is still open at the end is complete. Furniture within an article is marked;
    an article within furniture (a form around a whole page, a menu that nobody ended) is an article, but for one within
    comments, links to elsewhere and asides.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[Open] = [Open()]
    held: list[tuple[str, Open]] = []
    pos, simple, last = 0, False, page.rfind(">")

    opened: dict[str, int] = {}

    def end(tag: str, until: frozenset | set = frozenset()) -> None:
        if not opened.get(tag):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                if held and not all(e.inline for e in stack[k:]):
                    _finish(held, stack, out)
                for e in stack[k:]:
                    opened[e.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    while pos < len(page):
        at = page.find("<", pos)
        if at < 0 or at > last:
            at = len(page) if at < 0 or not (page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] in ("/", "!", "?")) else at
            if not stack[-1].silent:
                held.append((entities.unescape(page[pos:at]), stack[-1]))
            break
        if at > pos and not stack[-1].silent:
            text = page[pos:at]
            held.append((entities.unescape(text) if "&" in text else text, stack[-1]))
        m = None if simple else _TAG.match(page, at)
        if m:
            closing, tag, raw, pos = m[1], m[2].lower(), m[3], m.end()
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 2)
            pos = len(page) if stop < 0 else stop + 3
            continue
        else:
            following = page[at + 1 : at + 2]
            if following in ("!", "?") or (following == "/" and not page[at + 2 : at + 3].isalpha()):
                pos = page.find(">", at) + 1
                continue
            if following != "/" and not (following.isascii() and following.isalpha()):
                if not stack[-1].silent:
                    held.append(("<", stack[-1]))
                pos = at + 1
                continue
            # no end outside of quotes: from here on a tag ends at the next bracket, so that no page is read over and over
            simple = True
            stop = page.find(">", at)
            body = page[at + 1 : stop].lstrip("/").split(None, 1) or [""]
            closing, tag, raw, pos = following == "/", body[0].lower(), body[1] if len(body) > 1 else "", stop + 1
        if closing:
            if tag == "br":
                held.append((" ", stack[-1]))
            elif tag == stack[-1].tag and len(stack) > 1:
                if held and not stack[-1].inline:
                    _finish(held, stack, out)
                stack.pop()
                opened[tag] -= 1
            else:
                end(tag)
            continue
        if tag in VOID:
            if tag == "hr" and held:
                _finish(held, stack, out)
            elif tag == "br":
                held.append((" ", stack[-1]))
            continue
        if tag not in INLINE:
            if held:
                _finish(held, stack, out)
            if stack[-1].paragraph:
                end("p")
            if tag in CLOSES:
                for name in CLOSES[tag][0]:
                    end(name, CLOSES[tag][1])
        stack.append(_nested(stack[-1], tag, raw))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in RAW and not raw.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, pos)
            pos = stop.start() if stop else len(page)
    if held:
        _finish(held, stack, out)
    return out


def region(found: list[Block]) -> str:
    """The zone that holds the page's main text: an article if there is one, else a main part, else what is called the content, if
    it has half of the words that are not marked, else all that is not marked."""
    zones = {b.zone for b in found}
    if CONTENT in zones and not zones & {ARTICLE, MAIN}:
        words = {z: sum(len(b.text.split(" ")) for b in found if b.zone == z) for z in (CONTENT, OPEN)}
        return CONTENT if words[CONTENT] >= words[OPEN] else OPEN
    return ARTICLE if ARTICLE in zones else MAIN if MAIN in zones else OPEN
