"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page's tree.

A leaf block is a run of text that no block-level tag interrupts. Each has features of its ancestors (tags, and what the words
of their class, id and role speak of), of its text (length, share in links, punctuation, cue words) and of its place. The
field has two labels, main text or not, and weights for pairs of neighbours, which depend on whether the two share a parent;
it is fitted by maximum likelihood, forward and backward over whole pages, and the best labelling is found by Viterbi.

Labelled pages: the table brings no labels, so they come from pages whose markup says what is what. Of at most PAGES distinct
pages (of at most WIDEST bytes, smallest hashes first) that have an article or main element, blocks within it count as main
text, those in menus, headers, footers, asides, forms, notices, adverts and comments don't. As such tags would teach the field to look
for nothing else, the texts of these pages are also put into pages of other dress (`dressed`), where class names, bare tags
or only the text tell, and the label of every block is known. PAGES and WIDEST bound the fit alone; every page of any
length is read whole. Where no page is marked so, pages dressed in words of no meaning are learned from.

Parsing: comments, scripts, styles, titles, templates, hidden elements and fields of forms hold no text; a paragraph ends where a
block begins; what is not closed ends with its parent; a tag that the page's end cuts off is dropped. Character references
are decoded as HTML 5 does, once. White space (Unicode's, with the no-break space) within a block becomes one space.

Edge cases: a null or empty page, or one without main text, gives an empty text; null ids and urls stay null; repeated pages
each get their row and equal texts; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import bounded

PAGES, WIDEST, DRESSES = 160, 1 << 16, 3

# Names of HTML elements by how they are read.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
MUTE = frozenset("script style textarea title iframe noembed noframes template noscript select option datalist button svg object canvas audio video".split())
#: A start tag ends the nearest open one of these, unless an element of the second set lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
# What a word in a class or id speaks of.
SPEAKS = {
    "advert": "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promoted promotion teaser",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar topbar",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular share sharing social tags rail",
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback reviews",
    "notice": "cookie cookies consent gdpr notice notices alert warning popup modal overlay paywall disclaimer toast",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header masthead logo brand hero",
    "form": "form search newsletter subscribe subscription signup login register contact",
    "body": "article content post entry story main body text page blog news",
}
WORD_OF = {w: k for k, words in SPEAKS.items() for w in words.split()}
ROLES = {"navigation": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "form": "form", "alert": "notice", "dialog": "notice", "main": "body", "article": "body"}
TAG_SPEAKS = {"nav": "menu", "menu": "menu", "aside": "side", "footer": "foot", "header": "head", "form": "form", "fieldset": "form", "dialog": "notice", "article": "body", "main": "body"}
AWAY = frozenset(["advert", "menu", "side", "comment", "notice", "foot", "head", "form"])
CUES = {
    "cue:foot": ("©", "copyright", "all rights reserved", "privacy policy", "terms of"),
    "cue:notice": ("cookie", "consent", "javascript"),
    "cue:form": ("subscribe", "newsletter", "sign up", "log in", "password", "e-mail"),
    "cue:comment": ("reply", "comments", "posted by"),
    "cue:advert": ("advertisement", "sponsored"),
}

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_BARE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:$|[\s=])|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Node:
    """What an element passes on to the text in it: its tag, and the features of all it stands in."""

    __slots__ = ("tag", "speaks", "features", "mute", "emission")

    def __init__(self, tag: str, inherited: tuple[str, ...], spoken: frozenset[str], mute: bool):
        self.tag, self.mute, self.emission = tag, mute, None
        own = sorted(spoken & AWAY) or sorted(spoken)
        # All that ancestors speak of, the nearest last.
        self.speaks = (*(s for s in inherited if s not in own), *own)
        near, far = (("none", "none") + self.speaks)[-1], (("none", "none") + self.speaks)[-2]
        self.features = ["in:" + s for s in self.speaks] + ["near:" + near, "tag:" + tag, f"near:{near}&tag:{tag}", f"near:{far}>{near}", f"near:{far}>{near}&tag:{tag}"]
        if "body" in self.speaks and any(s in AWAY for s in self.speaks):
            self.features.append("in:body&away")


@lru_cache(maxsize=8192)
def _spoken(tag: str, attributes: str) -> tuple[frozenset[str], bool]:
    """What a tag with its attributes speaks of, and whether its text is not shown."""
    found = {TAG_SPEAKS[tag]} if tag in TAG_SPEAKS else set()
    if not attributes or attributes.isspace():
        return frozenset(found), tag in MUTE
    if tag not in ("html", "body"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values)
            name = name.lower()
            if name in ("class", "id"):
                found.update(WORD_OF[w] for w in map(str.lower, _WORDS.findall(value)) if w in WORD_OF)
            elif name == "role" and value.lower() in ROLES:
                found.add(ROLES[value.lower()])
    quiet = re.sub(r"""=\s*(?:"[^"]*"|'[^']*')""", lambda m: m[0] if "display" in m[0].lower() else "=", attributes)
    return frozenset(found), tag in MUTE or bool(_HIDDEN.search(quiet))


@dataclass
class Block:
    text: str
    node: Node
    linked: int  # code points inside links, before white space is folded
    raw: int
    parent: int  # number of the element that its own stands in, in order of opening


class Reader:
    """Cuts pages into leaf blocks. Elements alike in what they pass on share a Node, so its features are worked out once."""

    def __init__(self) -> None:
        self.root, self.nodes = Node("", (), frozenset(), False), {}

    def _below(self, parent: Node, tag: str, attributes: str) -> Node:
        spoken, mute = _spoken(tag, attributes)
        key = (parent.speaks, tag, spoken, mute or parent.mute)
        node = self.nodes.get(key)
        if node is None:
            node = self.nodes[key] = Node(tag, parent.speaks, spoken, key[3])
        return node

    def blocks(self, page: str) -> list[Block]:
        found: list[Block] = []
        stack: list[tuple[Node, int]] = [(self.root, 0)]
        opened: Counter[str] = Counter()
        pieces: list[str] = []
        count = links = linked = raw = 0

        def end() -> None:
            nonlocal linked, raw
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    # The block belongs to the innermost open block element.
                    at = next(i for i in range(len(stack) - 1, -1, -1) if i == 0 or stack[i][0].tag in BLOCKS)
                    found.append(Block(text, stack[at][0], linked, raw, stack[max(at - 1, 0)][1]))
                pieces.clear()
            linked = raw = 0

        def close(to: int) -> None:
            nonlocal links
            if any(node.tag in BLOCKS for node, _ in stack[to:]):
                end()
            links -= sum(node.tag == "a" for node, _ in stack[to:])
            opened.subtract(node.tag for node, _ in stack[to:])
            del stack[to:]

        def say(text: str) -> None:
            nonlocal linked, raw
            if text and not stack[-1][0].mute:
                pieces.append(entities.unescape(text) if "&" in text else text)
                raw += len(text)
                linked += len(text) if links else 0

        at, size = 0, len(page)
        while at < size:
            open_at = page.find("<", at)
            if open_at < 0:
                say(page[at:])
                break
            following = page[open_at + 1 : open_at + 2]
            if following in ("!", "?") and following:
                say(page[at:open_at])
                if page.startswith("<!--", open_at):
                    to = page.find("-->", open_at + 4 if not page.startswith(("<!-->", "<!--->"), open_at) else open_at + 2)
                    at = size if to < 0 else to + 3
                else:
                    to = page.find(">", open_at)
                    at = size if to < 0 else to + 1
                continue
            name_at = open_at + 2 if following == "/" else open_at + 1
            if not (page[name_at : name_at + 1].isascii() and page[name_at : name_at + 1].isalpha()):
                if following == "" or (following == "/" and name_at >= size):
                    say(page[at:open_at])
                    break
                say(page[at : open_at + 1])
                at = open_at + 1
                continue
            say(page[at:open_at])
            tag_match = _TAG.match(page, open_at) or _BARE.match(page, open_at)
            if tag_match is None:
                break  # cut off by the page's end
            at = tag_match.end()
            tag, attributes = tag_match[2].lower(), tag_match[3]
            if tag_match[1]:
                if tag == "br":
                    say(" ")
                    continue
                for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                    if stack[i][0].tag == tag:
                        close(i)
                        break
                    if tag not in BLOCKS and stack[i][0].tag in BLOCKS:
                        break
                if tag in BLOCKS:
                    end()
                continue
            if tag in VOID:
                if tag == "br":
                    say(" ")
                elif tag == "hr":
                    end()
                continue
            if tag in BLOCKS:
                end()
                self._make_room(stack, opened, tag, close)
            elif tag == "a" and links:
                to = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0].tag == "a"), None)
                if to is not None:
                    close(to)
            if attributes.endswith("/") and tag in ("svg", "path", "circle", "rect"):
                continue
            count += 1
            stack.append((self._below(stack[-1][0], tag, attributes), count))
            opened[tag] += 1
            links += tag == "a"
            if tag in RAW:
                to = _RAW_END[tag].search(page, at)
                at = size if to is None else to.start()
        end()
        return found

    @staticmethod
    def _make_room(stack: list[tuple[Node, int]], opened: Counter[str], tag: str, close: Callable[[int], None]) -> None:
        """End what the start tag of a block element ends: an open paragraph or head, or an item of the same kind."""
        ended, walls = ENDS.get(tag, (frozenset(), frozenset()))
        for i in range(len(stack) - 1, 0, -1) if any(opened[name] > 0 for name in ended) else ():
            name = stack[i][0].tag
            if name in ended:
                close(i)
                break
            if name in walls:
                break
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i][0].tag
            if name == "p" or (name == "head" and tag != "head"):
                close(i)
                break
            if name in BLOCKS or name in ("button", "object"):
                break


def _grade(n: float, steps: tuple) -> int:
    return next((i for i, s in enumerate(steps) if n <= s), len(steps))


def text_features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    length = _grade(words, (2, 5, 10, 20, 40))
    links = _grade(block.linked / max(block.raw, 1), (0.0, 0.3, 0.7))
    out = [f"words:{length}", f"links:{links}", f"words:{length}&links:{links}", "end:" + ("stop" if text[-1] in ".!?…。！？:;\"'”»)" else "other")]
    if "," in text:
        out.append("comma")
    if any(c in text for c in "|·»•"):
        out.append("bars")
    if words <= 20:
        low = text.lower()
        out += [name for name, cues in CUES.items() if any(c in low for c in cues)]
    return out


def place_features(blocks: list[Block]) -> list[list[str]]:
    """Where each block stands on its page."""
    main = any("body" in b.node.speaks for b in blocks)
    title = next((i for i, b in enumerate(blocks) if b.node.tag in ("h1", "h2")), None)
    out = []
    for i, b in enumerate(blocks):
        inside = "in" if "body" in b.node.speaks else "out" if main else "none"
        where = "none" if title is None else "before" if i < title else "title" if i == title else "after"
        out.append([f"main:{inside}", f"title:{where}", f"main:{inside}&title:{where}"] + (["first"] if i == 0 else []) + (["last"] if i == len(blocks) - 1 else []))
    return out


@dataclass
class Field:
    """Weights of main text over the rest: per feature, per pair of neighbouring labels, and for the first and last block."""

    weights: dict[str, float]
    pairs: np.ndarray  # [shares a parent, label before, label]
    ends: np.ndarray  # [first or last, label]

    def emission(self, names: list[str]) -> float:
        get = self.weights.get
        return sum(get(n, 0.0) for n in names)

    def labels(self, blocks: list[Block]) -> list[int]:
        """The most likely labelling, by Viterbi."""
        if not blocks:
            return []
        score = []
        for b, place in zip(blocks, place_features(blocks), strict=True):
            if b.node.emission is None:
                b.node.emission = self.emission(b.node.features)
            score.append(b.node.emission + self.emission(text_features(b)) + self.emission(place))
        pairs, ends = self.pairs.tolist(), self.ends.tolist()
        off, on = ends[0][0], ends[0][1] + score[0]
        came: list[tuple[int, int]] = []
        for i in range(1, len(blocks)):
            p = pairs[blocks[i].parent == blocks[i - 1].parent]
            a, b, c, d = off + p[0][0], on + p[1][0], off + p[0][1], on + p[1][1]
            came.append((int(b > a), int(d > c)))
            off, on = max(a, b), max(c, d) + score[i]
        label = int(on + ends[1][1] > off + ends[1][0])
        out = [label]
        for back in reversed(came):
            label = back[label]
            out.append(label)
        return out[::-1]

    def main_text(self, blocks: list[Block]) -> str:
        return " ".join(b.text for b, y in zip(blocks, self.labels(blocks), strict=True) if y)


Labelled = tuple[list[Block], list[int]]


def marked(blocks: list[Block]) -> list[int] | None:
    """Labels as the page's own markup has them; None if it has no article or main element, or no text in it."""
    labels = [int("body" in b.node.speaks and not any(s in AWAY for s in b.node.speaks)) for b in blocks]
    return labels if any(labels) else None


def dressed(rng: random.Random, title: str, paragraphs: list[str], phrases: list[str], others: list[str]) -> tuple[str, list[tuple[str, int]]]:
    """A page in other dress, and the text and label of each of its blocks, in order.

    phrases: short texts for menus; others: running text that isn't of this page, for adverts, notices and comments.
    """
    said: list[tuple[str, int]] = []
    pick = rng.choice

    def block(tag: str, text: str, label: int, inner: str = "{}") -> str:
        said.append((text, label))
        return f"<{tag}>{inner.format(entities.escape(text))}</{tag.split()[0]}>"

    def cued(name: str) -> str:
        text = pick(others)
        return f"{pick(CUES[name])} {text}" if rng.random() < 0.4 else text

    def items(n: int, linked: bool = True) -> str:
        return "".join(block("li", pick(phrases), 0, '<a href="#">{}</a>' if linked else "{}") for _ in range(n))

    def prose(n: int, tag: str = "p", cue: str = "cue:advert") -> str:
        return "".join(block(tag, cued(cue), 0) for _ in range(n))

    def menu() -> str:
        a, z = pick([("<nav><ul>", "</ul></nav>"), ('<div id="menu"><ul>', "</ul></div>"), ('<ul class="nav">', "</ul>"), ('<div class="breadcrumb"><ul>', "</ul></div>"), ("<ul>", "</ul>"), ('<div role="navigation"><ol>', "</ol></div>")])
        return a + items(rng.randint(2, 7)) + z

    def head() -> str:
        a, z = pick([("<header>", "</header>"), ('<div class="header">', "</div>"), ('<div id="masthead">', "</div>"), ('<div class="logo">', "</div>")])
        return a + block(pick(["h1", "p", "div", "h2"]), pick(phrases), 0) + (prose(1) if rng.random() < 0.4 else "") + (menu() if rng.random() < 0.5 else "") + z

    def foot() -> str:
        a, z = pick([("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="footer">', "</div>"), ('<div class="copyright">', "</div>"), ("<footer><p>", "</p></footer>")])
        text = pick(["© ", "Copyright ", ""]) + pick(others)
        said.append((text, 0))
        return a + entities.escape(text) + z

    def advert() -> str:
        name = pick(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "box ad"])
        a, z = pick([(f'<div class="{name}">', "</div>"), (f'<section class="{name}">', "</section>"), (f'<div id="{name}">', "</div>"), (f'<p class="{name}">', "</p>"), (f'<aside class="{name}">', "</aside>")])
        if a.startswith("<p") or rng.random() < 0.5:
            text = pick(others)
            said.append((text, 0))
            return a + entities.escape(text) + z
        return a + prose(rng.randint(1, 2)) + z

    def side() -> str:
        a, z = pick([("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div id="sidebar">', "</div>"), ('<div class="related">', "</div>"), ('<div class="widget">', "</div>"), ('<div class="share">', "</div>")])
        return a + (block("h3", pick(phrases), 0) if rng.random() < 0.6 else "") + pick([lambda: "<ul>" + items(rng.randint(2, 5)) + "</ul>", lambda: prose(rng.randint(1, 3))])() + z

    def notice() -> str:
        name = pick(["cookie-notice", "cookies", "consent", "notice", "alert", "popup", "disclaimer", "gdpr-banner"])
        a, z = pick([(f'<div class="{name}">', "</div>"), (f'<section id="{name}">', "</section>"), ('<div role="alert">', "</div>"), (f'<p class="{name}">', "</p>")])
        if a.startswith("<p"):
            text = cued("cue:notice")
            said.append((text, 0))
            return a + entities.escape(text) + z
        return a + prose(rng.randint(1, 2), cue="cue:notice") + z

    def form() -> str:
        a, z = pick([("<form>", "</form>"), ('<form class="search">', "</form>"), ('<div class="newsletter"><form>', "</form></div>"), ('<form id="login">', "</form>")])
        return a + pick([lambda: prose(1, cue="cue:form"), lambda: block("div", pick(phrases), 0, "<label>{}</label><input name='a'>")])() + "<input type='text'>" + z

    def comments() -> str:
        a, z, one = pick([('<section class="comments">', "</section>", "p"), ('<div id="comments">', "</div>", "div"), ('<ol class="commentlist">', "</ol>", "li"), ('<div class="comments">', "</div>", 'article class="comment"'), ('<section id="comments">', "</section>", "article"), ('<div class="disqus">', "</div>", 'div class="comment-body"')])
        return a + (block("h3", pick(phrases), 0) if rng.random() < 0.5 else "") + "".join(prose(1, one) if rng.random() < 0.5 else f"<{one}>{prose(rng.randint(1, 2)) if one != 'p' else prose_of(one)}</{one.split()[0]}>" for _ in range(rng.randint(1, 4))) + z

    def prose_of(one: str) -> str:
        text = pick(others)
        said.append((text, 0))
        return entities.escape(text)

    def article() -> str:
        a, z = pick([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="post">', "</div>"), ('<div class="entry-content">', "</div>"), ('<div class="story">', "</div>"), ('<div id="main">', "</div>"), ("<div>", "</div>"), ("<section>", "</section>"), ("<td>", "</td>") if rng.random() < 0.3 else ("<div>", "</div>")])
        out = [a]
        heading = block(pick(["h1", "h1", "h2"]), title, 1)
        out.append(f"<header>{heading}</header>" if "<article>" in a and rng.random() < 0.2 else heading)
        within = [f for f in (advert, side, notice, form, menu) if rng.random() < 0.2]
        for i, text in enumerate(paragraphs):
            if within and rng.random() < 0.5:
                out.append(within.pop()())
            if i and rng.random() < 0.1:
                out.append(block(pick(["h2", "h3"]), pick(phrases), 1))
            kind = rng.random()
            if kind < 0.1:
                out.append("<ul>" + block("li", text, 1) + "</ul>")
            elif kind < 0.15:
                out.append("<blockquote>" + block("p", text, 1) + "</blockquote>")
            else:
                out.append(block("p", text, 1, pick(["{}", "{}", "{}", "<b>{}</b>", '<a href="#">{}</a>' if len(text) > 60 and rng.random() < 0.2 else "{}", "<em>{}"])))
        out += [f() for f in (comments, side, advert, foot) if rng.random() < 0.15]
        return "".join(out) + z

    before = [f for f, p in ((head, 0.7), (menu, 0.8), (notice, 0.35), (advert, 0.5), (form, 0.25), (side, 0.2)) if rng.random() < p]
    after = [f for f, p in ((comments, 0.4), (side, 0.4), (advert, 0.3), (form, 0.2), (notice, 0.2), (foot, 0.8)) if rng.random() < p]
    if rng.random() < 0.3:
        rng.shuffle(before)
    body = "".join(f() for f in [*before, article, *after])
    return f"<!DOCTYPE html><html><head><title>{entities.escape(title)}</title></head><body>{body}</body></html>", said


#: Stand-ins where a table has no marked page to learn from.
FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def labelled_pages(pages: list[str], seed: int = 11, dresses: int = DRESSES) -> list[Labelled]:
    """The marked ones of the pages as they are, and their texts in other dress; as many of filler if there are none."""
    rng, reader = random.Random(seed), Reader()
    out: list[Labelled] = []
    sources: list[tuple[str, list[str]]] = []
    phrases: list[str] = []
    for page in pages:
        blocks = reader.blocks(page)
        labels = marked(blocks)
        if labels is None:
            continue
        out.append((blocks, labels))
        main = [b.text for b, y in zip(blocks, labels, strict=True) if y]
        phrases += [b.text for b, y in zip(blocks, labels, strict=True) if not y and len(b.text) < 40]
        sources.append((main[0], main[1:30] or main))
    if not sources:
        run = lambda a, b: " ".join(rng.choice(FILLER) for _ in range(rng.randint(a, b)))
        sources = [(run(2, 9), [run(3, 70).capitalize() + "." for _ in range(rng.randint(1, 9))]) for _ in range(PAGES)]
    phrases = phrases or FILLER
    others = [p for _, main in sources for p in main[:3]]
    for title, main in sources:
        for _ in range(dresses):
            few = [p if rng.random() < 0.8 else " ".join(p.split()[: rng.randint(1, 6)]) for p in rng.sample(main, min(len(main), rng.randint(1, 10)))]
            page, said = dressed(rng, title, few, phrases, [" ".join(t.split()[: rng.randint(4, 40)]) for t in rng.sample(others, min(len(others), 12))])
            blocks = reader.blocks(page)
            if [b.text for b in blocks] == [" ".join(t.split()) for t, _ in said]:
                out.append((blocks, [y for _, y in said]))
    return out


def fit(labelled: list[Labelled], steps: int = 150, decay: float = 2.0) -> Field:
    """Maximum likelihood with a quadratic penalty, by gradient steps of adaptive size on all pages at once."""
    names: dict[str, int] = {}
    flat, starts, first_of, truth, same = [], [], [], [], []
    for blocks, labels in labelled:
        first_of.append(len(truth))
        for i, (b, place) in enumerate(zip(blocks, place_features(blocks), strict=True)):
            starts.append(len(flat))
            flat += [names.setdefault(n, len(names)) for n in (*b.node.features, *text_features(b), *place)]
            same.append(int(i > 0 and b.parent == blocks[i - 1].parent))
        truth += labels
    flat, starts, truth, same = np.array(flat), np.array(starts), np.array(truth), np.array(same)
    size = np.diff([*first_of, len(truth)])
    longest, pages = int(size.max()), len(size)
    at = np.minimum(np.array(first_of)[:, None] + np.arange(longest), len(truth) - 1)  # page, place -> block
    there = np.arange(longest)[None] < size[:, None]
    of_block = np.repeat(np.arange(len(truth)), np.diff([*starts, len(flat)]))
    last = np.array(first_of) + size - 1

    def slope(w: np.ndarray, pairs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.zeros((len(truth), 2))
        e[:, 1] = np.add.reduceat(w[flat], starts)
        ep, sp = e[at], same[at]
        alpha, beta = np.zeros((longest, pages, 2)), np.zeros((longest, pages, 2))
        alpha[0] = ends[0] + ep[:, 0]
        for t in range(1, longest):
            m = alpha[t - 1][:, :, None] + pairs[sp[:, t]]
            alpha[t] = np.where(there[:, t, None], np.logaddexp(m[:, 0], m[:, 1]) + ep[:, t], alpha[t - 1])
        final = alpha[-1] + ends[1]
        total = np.logaddexp(final[:, 0], final[:, 1])
        beta[-1] = ends[1]
        g_pairs = np.zeros((2, 2, 2))
        for t in range(longest - 1, 0, -1):
            inner = pairs[sp[:, t]] + (ep[:, t] + beta[t])[:, None, :]
            p = np.exp(alpha[t - 1][:, :, None] + inner - total[:, None, None]) * there[:, t, None, None]
            for s in (0, 1):
                g_pairs[s] += p[sp[:, t] == s].sum(0)
            beta[t - 1] = np.where(there[:, t, None], np.logaddexp(inner[:, :, 0], inner[:, :, 1]), ends[1])
        mean = np.exp(alpha + beta - total[None, :, None])
        p1 = np.zeros(len(truth))
        p1[at[there]] = mean[:, :, 1].T[there]
        g = np.bincount(flat, ((truth - p1)[of_block]), minlength=len(w))
        begun = np.stack([1 - p1[first_of], p1[first_of]], 1).sum(0)
        ended = np.stack([1 - p1[last], p1[last]], 1).sum(0)
        seen = np.zeros((2, 2, 2))
        inside = np.ones(len(truth), bool)
        inside[first_of] = False
        np.add.at(seen, (same[inside], truth[np.flatnonzero(inside) - 1], truth[inside]), 1)
        g_ends = np.stack([np.bincount(truth[first_of], minlength=2) - begun, np.bincount(truth[last], minlength=2) - ended])
        return g, seen - g_pairs, g_ends

    parts = [np.zeros(len(names)), np.zeros((2, 2, 2)), np.zeros((2, 2))]
    speed, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        rate = 0.15 * (1 - step / (steps + 1)) + 0.005
        for p, v, s, g in zip(parts, speed, square, slope(*parts), strict=True):
            g = g - decay * p
            v += 0.1 * (g - v)
            s += 0.02 * (g * g - s)
            p += rate * (v / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-6)
    return Field({n: float(parts[0][i]) for n, i in names.items()}, parts[1], parts[2])


def sample(pages: DataFrame, most: int = PAGES, widest: int = WIDEST) -> list[str]:
    """At most so many distinct pages with an article or main element, smallest hashes first, none wider than `widest` bytes."""
    html = F.col("html")
    likely = pages.where(html.isNotNull() & (F.octet_length(html) <= widest) & html.rlike("(?i)<(article|main)[\\s>]")).select("html", F.xxhash64("html").alias("h"))
    # Hashes first: only the pages that are drawn move, and of copies one.
    drawn = [r["h"] for r in likely.select("h").distinct().orderBy("h").limit(most).collect()]
    found = likely.where(F.col("h").isin(drawn)).groupBy("h").agg(F.first("html").alias("html")).collect()
    return [r["html"] for r in sorted(found, key=lambda r: r["h"])]


def extract(pages: DataFrame, model: Field) -> DataFrame:
    """page_id, url, text and n_chars, with the numbers of blocks read and kept, for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for whole in batches:
            for b in bounded(whole, "html"):
                texts, read, kept = [], [], []
                for page in b.column("html").to_pylist():
                    blocks = reader.blocks(page or "")
                    labels = model.labels(blocks)
                    texts.append(" ".join(x.text for x, y in zip(blocks, labels, strict=True) if y))
                    read.append(len(blocks))
                    kept.append(sum(labels))
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), sizes, pa.array(read, pa.int32()), pa.array(kept, pa.int32())], names=["page_id", "url", "text", "n_chars", "blocks", "blocks_kept"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, blocks int, blocks_kept int")


def op11_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(labelled_pages(sample(pages))))
