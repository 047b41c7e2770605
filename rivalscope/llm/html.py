"""Main-text extraction by a linear-chain conditional random field over leaf blocks (operator 4).

A page is cut into leaf blocks: the text between block-level tags, with its ancestors.
Each block has features of its ancestors' tags and class and id words, of its text, and of the element that it shares with
others.  No feature decides alone, and names on what holds most of a page count apart, as they can't tell its parts.
The field is trained on labelled pages (by default those of ``labelled_pages``, a bounded
number of made-up layouts whose labels are known) and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements that start a block, have no end tag, or hold no readable text.
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre search section select summary table caption tbody td tfoot th thead tr ul iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style title textarea iframe noframes xmp".split()  # what follows, up to the end tag, is no markup
SILENT = "noscript template svg canvas audio video".split()
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A p element ends where one of these starts.
ENDS_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "iframe"}

#: Elements that hold blocks: what lies in one of them is judged together.
ROOM = frozenset("html body article aside details dialog div dl fieldset footer form header main menu nav ol section table ul".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")  #: for what follows a tag whose quotes are never closed
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LOWER = {c: c + 32 for c in range(65, 91)}
COMMON = {"html", "body", "div", "p"}


#: Names that made-up pages give to the parts of a page: of main text, and of the rest.
MAIN = [
    "article", "article", "article", "main", "main", "div content", "div post body", "div entry content", "section article", "div main text", "article post", "div story", "div article body", "section content", "div page content", "div copy", "div blog post",
    "div news text", "div prose", "article story", "main content", "div text body", "div post content", "div rich text",
]
REST = [
    "nav", "nav menu", "header", "header site", "div header", "footer", "div footer", "aside", "aside sidebar", "div sidebar", "div ad", "div ads", "div advert", "div banner", "section comments", "div comments", "div comment",
    "ul menu", "div nav", "div cookie notice", "div notice", "div consent", "form", "form search", "form newsletter", "div subscribe", "div promo", "div sponsored", "div related", "div share", "div social", "div breadcrumb", "div popup", "ol comment list", "div login",
    "div replies", "div reader responses", "section discussion", "ol reply thread", "div disclaimer", "div legal", "div copyright", "div privacy", "div terms", "div signup", "div toolbar", "div pagination", "div pager", "div recommended", "div trending", "div popular",
    "div widget", "div modal", "div overlay", "div donate", "div alert", "div masthead", "div topbar", "div navbar", "div crumbs", "ul links", "div archive", "ul categories", "ul tags", "div advertisement", "aside promotion", "div warning", "div feedback", "section reviews", "div rail",
]
#: Words that stand before or after such names where they speak of the whole page or of what an article is about.
AROUND = ["has", "with", "no", "is", "page", "site", "layout", "single", "fixed", "left", "right", "open", "wrapper", "container", "theme", "wide", "about", "the", "new", "film", "law", "guide", "explained", "best", "history"]
WIDE = 0.75  #: an element that holds this part of a page's words can't tell its parts from each other: its names count apart


class Block(NamedTuple):
    text: str
    element: int  #: the innermost open element, -1 if there is none
    linked: int  #: characters inside links


class Page(NamedTuple):
    blocks: list[Block]
    elements: list[tuple[str, list[str], int]]  #: tag, words of its names, and the element around it


class Pieces:
    """The markup of a page from left to right, each character read a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.low = page, page.translate(LOWER)
        self.tag, self.gone = TAG, set[str]()

    def end_of(self, name: str, at: int) -> int:
        """Where the element ends whose content starts at ``at``, or -1; a missing end tag is looked for once."""
        if name in self.gone:
            return -1
        while (at := self.low.find(f"</{name}", at)) >= 0:
            after = at + len(name) + 2
            if after >= len(self.low) or self.low[after] in " \t\n\r\f\v/>":
                close = self.low.find(">", after)
                return close + 1 if close >= 0 else len(self.low)
            at = after
        self.gone.add(name)
        return -1

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(kind, name or text, attributes): kind is "text", "open" or "close"."""
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            if page[at] != "<":
                to = page.find("<", at)
                to = end if to < 0 else to
                yield "text", page[at:to], ""
                at = to
                continue
            if page.startswith("<!--", at):
                to = page.find("-->", at + 4)
                at = end if to < 0 else to + 3
                continue
            if page.startswith(("<!", "<?"), at):
                to = page.find(">", at)
                at = end if to < 0 else to + 1
                continue
            m = self.tag.match(page, at)
            if not m and self.tag is TAG and at + 1 < end and (page[at + 1].isalpha() or page[at + 1] == "/"):
                self.tag = LOOSE  # no quote that is open from here on is ever closed
                m = LOOSE.match(page, at)
            if not m:
                yield "text", "<", ""
                at += 1
                continue
            name, at = m[2].translate(LOWER), m.end()
            if m[1]:
                yield "close", name, ""
            elif name in RAW:
                to = self.end_of(name, at)
                at = end if to < 0 else to
            elif name in SILENT:
                # without an end tag it is no more than its tag, as is a self-closed svg
                to = -1 if name == "svg" and m[3].endswith("/") else self.end_of(name, at)
                at = at if to < 0 else to
            else:
                yield "open", name, m[3]


def parse(page: str) -> Page:
    """The leaf blocks of a page in order (references decoded, white space made one space, empty ones left out) and all its elements."""
    out: list[Block] = []
    elements: list[tuple[str, list[str], int]] = []
    stack: list[int] = []
    block_at: list[int] = []  # places of the block elements in the stack
    open_tags: dict[str, int] = {}
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, stack[-1] if stack else -1, linked))
            text.clear()
            linked = 0

    def pop(to: int) -> None:
        if block_at and block_at[-1] >= to:
            flush()
        while len(stack) > to:
            open_tags[elements[stack.pop()][0]] -= 1
            if block_at and block_at[-1] == len(stack):
                block_at.pop()

    for kind, tag, rest in Pieces(page):
        if kind == "text":
            t = entities.unescape(tag)
            text.append(t)
            if open_tags.get("a"):
                linked += len(t.strip())
        elif kind == "close":
            if open_tags.get(tag):
                pop(next(i for i in range(len(stack) - 1, -1, -1) if elements[stack[i]][0] == tag))
            elif tag in BLOCK:
                flush()
        else:
            if tag == "br":
                text.append(" ")
            if tag in BLOCK:
                flush()
                ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
                for i in reversed(block_at):
                    if elements[stack[i]][0] in ends:
                        pop(i)
                        break
                    if elements[stack[i]][0] != "p":
                        break
            if tag not in VOID and not (rest.endswith("/") and "=" not in rest[rest.rfind(" ") :]):
                words = [] if tag in ("html", "body") else sorted({w.lower() for found in NAMES.findall(rest) for w in WORDS.findall("".join(found))})
                elements.append((tag, words, stack[-1] if stack else -1))
                if tag in BLOCK:
                    block_at.append(len(stack))
                stack.append(len(elements) - 1)
                open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return Page(out, elements)


def named(page: Page) -> list[list[str]]:
    """For each element the features that it gives to all blocks inside: its tag and names, apart where it holds most of the page."""
    inside = [0] * len(page.elements)
    for b in page.blocks:
        if b.element >= 0:
            inside[b.element] += b.text.count(" ") + 1
    for i in range(len(page.elements) - 1, -1, -1):  # an element comes after that around it
        outer = page.elements[i][2]
        if outer >= 0:
            inside[outer] += inside[i]
    least = WIDE * sum(b.text.count(" ") + 1 for b in page.blocks)
    out = []
    for (tag, words, _), n in zip(page.elements, inside, strict=True):
        wide = "wide " if n >= least else ""
        out.append([*([f"{wide}in {tag}"] if tag in BLOCK and tag not in COMMON else []), *(f"{wide}word {w}" for w in words)])
    return out


def paths(page: Page, weights: dict[str, float] | None = None) -> list:
    """For each element what it and those around it give, each feature once: the features, or with ``weights`` their sum, in time that doesn't grow with depth."""
    active: dict[str, int] = {}
    stack: list[tuple[int, list[str]]] = []
    out: list = []
    for i, own in enumerate(named(page)):
        outer = page.elements[i][2]
        while stack and stack[-1][0] != outer:
            for f in stack.pop()[1]:
                active[f] -= 1
                if not active[f]:
                    del active[f]
        new = [f for f in dict.fromkeys(own) if f not in active]
        for f in own:
            active[f] = active.get(f, 0) + 1
        stack.append((i, own))
        if weights is None:
            out.append([*active])
        else:
            out.append((out[outer] if outer >= 0 else 0.0) + sum(weights.get(f, 0.0) for f in new))
    return out


def rooms(page: Page) -> tuple[list[int], list[int]]:
    """The room of each block, and the room around each: the innermost element that holds blocks; 0 is the page, element i is i + 1."""
    room = [0]
    for i, (tag, _, outer) in enumerate(page.elements):
        room.append(i + 1 if tag in ROOM else room[outer + 1])
    around = [0, *(room[outer + 1] for _, _, outer in page.elements)]
    return [room[b.element + 1] for b in page.blocks], around


def text_features(page: Page) -> tuple[list[list[str]], list[int]]:
    """For each block features of its text, of its own element, of all text in its room, and of where the room lies to the one with most text; and whether the block before is in the same room."""
    found, (own_room, around) = page.blocks, rooms(page)
    words = [b.text.count(" ") + 1 for b in found]
    links = [min(1.0, b.linked / len(b.text)) for b in found]
    size, link, many = {}, {}, {}
    for r, w, k in zip(own_room, words, links, strict=True):
        size[r] = size.get(r, 0) + w
        link[r] = link.get(r, 0.0) + k * w
        many[r] = many.get(r, 0) + 1
    most = max(size, key=lambda r: size[r] - link[r], default=0)
    above = {0}
    r = around[most] if most else 0
    while r:
        above.add(r)
        r = around[r]
    below: dict[int, bool] = {}

    def under(r: int) -> bool:
        trail = []
        while r and r != most and r not in below:
            trail.append(r)
            r = around[r]
        inside = r == most or below.get(r, False)
        below.update(dict.fromkeys(trail, inside))
        return inside

    first = next((i for i, r in enumerate(own_room) if r == most), 0)
    band = lambda k: min(7, int(k).bit_length())
    total, out = sum(words), []
    for i, b in enumerate(found):
        t, w, r = b.text, words[i], own_room[i]
        tag, names, outer = page.elements[b.element] if b.element >= 0 else ("none", [], -1)
        at = "most" if r == most else "over" if r in above else "under" if under(r) else "beside" if around[r] == around[most] and r else "far"
        at += "" if at in ("most", "under") else " before" if i < first else " after"
        out.append([
            f"own {tag}", f"parent {page.elements[outer][0] if outer >= 0 else 'none'}", *(f"own word {x}" for x in names),
            f"words {band(w)}", f"linked {int(4 * links[i])}", f"stop {t[-1] in '.!?…。'}", f"mark {t[0] in '©®'}", f"commas {min(3, 20 * t.count(',') // w)}",
            f"sentences {min(4, t.count('. ') + t.count('! ') + t.count('? '))}", f"room words {band(size[r] >> 2)}", f"room blocks {min(4, many[r].bit_length())}",
            f"room linked {int(4 * link[r] / size[r])}", f"room share {int(5 * size[r] / total)}", f"at {at}", f"at {at} {min(3, band(w >> 1))}",
        ])
    same = [int(i > 0 and own_room[i] == own_room[i - 1]) for i in range(len(found))]
    return out, same


class Field:
    """Two labels (0 rest, 1 main): a weight for each feature, and for each change of label, within a room and between rooms."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def scores(self, page: Page) -> tuple[list[float], list[int]]:
        w, outer = self.weights, paths(page, self.weights)
        own, same = text_features(page)
        return [sum(w.get(f, 0.0) for f in fs) + (outer[b.element] if b.element >= 0 else 0.0) for fs, b in zip(own, page.blocks, strict=True)], same

    def decode(self, page: Page) -> list[int]:
        """Viterbi."""
        if not page.blocks:
            return []
        moves = self.moves.tolist()
        scores, same = self.scores(page)
        s0, s1, back = 0.0, scores[0], []
        for score, k in zip(scores[1:], same[1:], strict=True):
            (a00, a01), (a10, a11) = moves[k]
            from0 = (s0 + a00 < s1 + a10, s0 + a01 < s1 + a11)
            s0, s1 = max(s0 + a00, s1 + a10), max(s0 + a01, s1 + a11) + score
            back.append(from0)
        label = int(s1 > s0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[Page, list[int]]], rounds: int = 120, decay: float = 2e-4) -> Field:
    """Maximum conditional likelihood with a quadratic penalty: forward-backward on each page, Adagrad over all."""
    index: dict[str, int] = {}
    rows, sames = [], []
    for page, _ in pages:
        outer, (own, same) = paths(page), text_features(page)
        rows.append([[index.setdefault(f, len(index)) for f in (*fs, *(outer[b.element] if b.element >= 0 else []))] for fs, b in zip(own, page.blocks, strict=True)])
        sames.append(same)
    w, moves = np.zeros(len(index)), np.zeros((2, 2, 2))
    gw, gm = np.full(len(index), 1e-8), np.full((2, 2, 2), 1e-8)
    # pages of a length are run together
    by_length: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_length.setdefault(len(r), []).append(i)
    batches = []
    for n, ids in by_length.items():
        if n:
            flat = np.concatenate([np.array(f, np.int64) for i in ids for f in rows[i]])
            owner = np.repeat(np.arange(len(ids) * n), [len(f) for i in ids for f in rows[i]])
            batches.append((n, len(ids), flat, owner, np.array([pages[i][1] for i in ids]), np.array([sames[i] for i in ids])))
    for _ in range(rounds):
        g, m = decay * w * len(pages), decay * moves * len(pages)
        for n, k, flat, owner, y, same in batches:
            e = np.zeros((k, n, 2))
            e[:, :, 1] = np.bincount(owner, w[flat], k * n).reshape(k, n)
            step = moves[same]  # page, block, label before, label
            fwd, bwd = np.zeros((k, n, 2)), np.zeros((k, n, 2))
            fwd[:, 0] = e[:, 0]
            for t in range(1, n):
                fwd[:, t] = e[:, t] + np.logaddexp(fwd[:, t - 1, :1] + step[:, t, 0], fwd[:, t - 1, 1:] + step[:, t, 1])
            for t in range(n - 2, -1, -1):
                nxt = e[:, t + 1] + bwd[:, t + 1]
                bwd[:, t] = np.logaddexp(step[:, t + 1, :, 0] + nxt[:, :1], step[:, t + 1, :, 1] + nxt[:, 1:])
            z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])[:, None]
            p = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z)
            g += np.bincount(flat, (p - y).ravel()[owner], len(w))
            for a in (0, 1):
                for b in (0, 1):
                    if n > 1:
                        pair = np.exp(fwd[:, :-1, a] + step[:, 1:, a, b] + e[:, 1:, b] + bwd[:, 1:, b] - z) - ((y[:, :-1] == a) & (y[:, 1:] == b))
                        for kind in (0, 1):
                            m[kind, a, b] += pair[same[:, 1:] == kind].sum()
        gw += g * g
        gm += m * m
        w -= 0.3 * g / np.sqrt(gw)
        moves -= 0.1 * m / np.sqrt(gm)
    return Field({f: float(w[i]) for f, i in index.items()}, moves)


def labelled_pages(number: int = 900, seed: int = 7, nameless: float = 0.2) -> list[tuple[Page, list[int]]]:
    """Made-up pages of many layouts, with the label of each block.  Main text is marked by a private character while cutting.

    Names of parts may say nothing (``nameless``) or, of an article, speak of other things; wrappers around the whole page bear
    names of its parts; some pages have one element, or no markup at all.
    """
    r = random.Random(seed)
    mark = "\ue000"
    loose = [w for name in MAIN + REST for w in name.split()[1:]]

    def word() -> str:
        if r.random() < 0.03:
            return str(r.randint(1, 9999))
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(r.randint(2, 9))) + ("," if r.random() < commas else "")

    def words(lo: int, hi: int) -> str:
        out, left = [], r.randint(lo, hi)
        while left > 0:
            n = min(left, r.randint(1, 24))
            out.append(" ".join(word() for _ in range(n)).capitalize() + r.choice([".", ".", ".", ".", "!", "?"]))
            left -= n
        return " ".join(out) if r.random() < 0.8 else " ".join(out)[:-1]

    def nonsense() -> str:
        return "".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 3)))

    def misleading() -> str:
        return r.choice(["-", " ", "_"]).join(r.choice([r.choice(AROUND), r.choice(AROUND), r.choice(loose), nonsense()]) for _ in range(r.randint(1, 4)))

    def tagged(tag: str, names: str, inner: str) -> str:
        quote = chr(34) if r.random() < 0.8 else "'"
        return f"<{tag}{f' {r.choice(["class", "id", "class"])}={quote}{names}{quote}' if names else ''}>{inner}</{tag}>"

    def element(name: str, inner: str) -> str:
        tag, *rest = name.split()
        if rest and r.random() < nameless:
            rest = [nonsense() for _ in rest]
        return tagged(tag, r.choice(["-", " "]).join(rest), inner)

    def rest_part() -> str:
        kind = r.random()
        if kind < 0.35:
            inner = "<ul>" + "".join(f'<li><a href="/">{words(1, 4)}</a></li>' for _ in range(r.randint(1, 7))) + "</ul>"
        elif kind < 0.45:
            inner = " ".join(f'<a href="/">{words(1, 4)}</a>' for _ in range(r.randint(1, 7)))
        elif kind < 0.7:
            inner = r.choice(["", "<p>"]) + r.choice(["", "", "&copy; "]) + words(1, r.choice([5, 10, 30]))
        elif kind < 0.8:
            inner = "".join(f"<h3>{words(1, 3)}</h3>" * (r.random() < 0.3) + tagged(r.choice(["div", "li", "article"]), r.choice(["", "", "comment", "reply"]), f"<p>{words(3, 60)}</p>" * r.randint(1, 2)) for _ in range(r.randint(1, 4)))
            return tagged(*r.choice([("section", "comments"), ("div", "comments"), ("ol", "comment-list"), ("div", "discussion"), ("div", "replies")]), inner)
        else:
            inner = "".join(f"<{t}>{words(1, r.choice([5, 12, 40]))}</{t}>" for t in r.choices(["p", "h2", "h3", "div", "p"], k=r.randint(1, 4)))
        return element(r.choice(REST), inner)

    def paragraphs() -> str:
        parts, tags = [], r.choice([["p"] * 8 + ["h2", "h3", "blockquote", "li", "pre", "td"], ["p"], ["div"], ["p"] * 5 + ["h2", "li", "figcaption"]])
        high = r.choice([[3, 20, 120, 400], [12, 25], [60, 200]])
        for _ in range(r.randint(1, 9)):
            tag = r.choice(tags)
            if tag == "li":
                parts.append("<ul>" + "".join(f"<li>{mark}{words(1, r.choice([4, 12]))}</li>" for _ in range(r.randint(1, 7))) + "</ul>")
                continue
            body = mark + words(1, r.choice(high))
            if r.random() < 0.2:
                body += f' <a href="/">{words(1, 3)}</a>'
            parts.append({"td": f"<table><tr><td>{body}</td></tr></table>", "figcaption": f"<figure><figcaption>{body}</figcaption></figure>"}.get(tag, f"<{tag}>{body}</{tag}>"))
            if r.random() < 0.08:
                parts.append(rest_part())
        return "".join(parts)

    def main_part() -> str:
        kind = r.random()
        if kind < 0.06:
            return "<br><br>".join(mark + words(5, 60) if k == 0 else words(5, 60) for k in range(r.randint(1, 4)))
        inner = "".join(f"<{t}>{mark}{words(1, 9)}</{t}>" for t in r.choices(["h1", "h2"], k=r.random() < 0.8))
        if r.random() < 0.25:
            inner += "".join(tagged(r.choice(["section", "div"]), r.choice(["", "", nonsense()]), paragraphs()) for _ in range(r.randint(1, 3)))
        else:
            inner += paragraphs()
        if r.random() < 0.3:
            inner = f"<div>{inner}</div>"
        if kind < 0.2:
            return tagged(r.choice(["article", "article", "main", "div"]), misleading(), inner)
        if kind < 0.32:
            return tagged("div", r.choice(["", nonsense(), nonsense()]), inner)
        if kind < 0.36:
            return inner
        return element(r.choice(MAIN), inner)

    out, commas = [], 0.0
    for _ in range(number):
        commas = r.choice([0.0, 0.03, 0.1, 0.2])
        if r.random() < 0.03:
            html = mark + words(5, 300)
        else:
            page = "".join(rest_part() for _ in range(r.randint(0, 4))) + main_part() + "".join(rest_part() for _ in range(r.randint(0, 4)))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                page = tagged(*(("form", r.choice(["", "aspnetForm", "form1"])) if r.random() < 0.1 else (r.choice(["div", "div", "section", "main"]), misleading())), page)
            html = f"<html><body{r.choice(['', f' class={chr(34)}{misleading()}{chr(34)}'])}>{page}</body></html>"
        found = parse(html)
        labels = [int(b.text.startswith(mark)) for b in found.blocks]
        out.append((found._replace(blocks=[b._replace(text=b.text.replace(mark, "")) for b in found.blocks]), labels))
    return out


def main_text(html: str, field: Field) -> str:
    page = parse(html)
    return "\n".join([b.text for b, label in zip(page.blocks, field.decode(page), strict=True) if label])


def extract(df: DataFrame, html: str = "html", field: Field | None = None) -> DataFrame:
    """Adds text and n_chars: the main text of each whole page, its blocks joined by \\n, and its code points.

    A null or empty page has an empty text, and so has one without a readable block.  Broken markup is
    read as far as it goes: a quote that is never closed doesn't swallow the page, what follows is still text.
    Time grows with a page's length, whatever its nesting.  Equal pages have equal texts, an empty table gives
    no rows.  Existing columns text and n_chars are replaced; all others pass through.
    """
    shared = df.sparkSession.sparkContext.broadcast(field or train(labelled_pages()))  # some hundred features

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = shared.value
        for batch in batches:
            yield pa.array([main_text(p or "", f) for p in batch.to_pylist()], pa.string())

    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("text", "n_chars")]
    return df.select(*rest, text(F.col(f"`{html}`")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
