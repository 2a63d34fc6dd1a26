"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into leaf blocks: runs of text between block-level tags. A block is read as the hashed tag path above
it (tags, words of class, id and role), its hashed words and a few shares. A bidirectional LSTM, in numpy, runs over
the blocks of the whole page in order and labels each as main text or not, so a block is judged by what stands
before and after it. The network is trained here, once in a driver process, on pages that a seeded grammar makes;
its weights are a fixed number of floats that travel with the tasks.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import _arrow_schema, map_batches, slices

#: Fixed values of HTML: elements without content, elements whose content isn't markup but is no text to show, and elements that end a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NAME = re.compile(r"[^\s/>]+")
_FREE = re.compile(r"[^\s>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]*)\s*(=?)\s*")
_WORDS = re.compile(r"[^\W_]+")
#: Elements that end an open paragraph, or an open one of their own kind.
_CLOSES_P = BLOCK - {"body", "html", "head", "button", "option", "caption", "legend", "summary"}
_CLOSES_OWN = frozenset("li dt dd tr td th option".split())
#: Elements inside which such an end reaches no further out.
_HOLDS_P = frozenset("table td th button div article section".split())
_HOLDS_OWN = frozenset("ul ol dl table select".split())

PATH, LAST, WORD, SHARES = 128, 48, 64, 6
INPUT, HIDDEN = PATH + LAST + WORD + SHARES, 20
#: Blocks that the network reads at once.
STEPS = 4096


class Tags:
    """Cuts a page into text, tags and what is neither, in one pass: what has no end is looked for once."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        """Where `what` stands next; -1 where it doesn't, without a second search."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def after(self, what: str, at: int) -> int:
        """The place behind the next `what`, or the page's end."""
        found = self.find(what, at)
        return len(self.page) if found < 0 else found + len(what)

    def attributes(self, at: int) -> tuple[int, list[tuple[str, str]], bool]:
        """(end, attributes, closed by a slash) of a tag whose name ends at `at`."""
        page, out = self.page, []
        while True:
            m = _ATTRIBUTE.match(page, at)
            at = m.end()
            if at >= len(page):
                return at, out, False
            name, value = m[1].lower(), ""
            if m[2]:
                quote = page[at]
                end = self.find(quote, at + 1) if quote in "\"'" else -1
                # a quote that runs on over other tags to the start of their values was never closed
                if end >= 0 and (page[end + 1 : end + 2].strip("/>").strip() == "" or self.find(">", at) > end):
                    value, at = page[at + 1 : end], end + 1
                else:
                    m = _FREE.match(page, at)
                    value, at = m[0].strip("\"'"), m.end()
            elif page[at] == ">":
                if name:
                    out.append((name, ""))
                return at + 1, out, page[at - 1] == "/"
            out.append((name, value))
            if page[at : at + 1] == ">":
                return at + 1, out, False
            if not m[0] and not value and not name:
                at += 1  # a character that begins no attribute


def blocks(page: str) -> list[tuple[str, tuple[int, int], float]]:
    """(text, path, share in links) of each leaf block with text, in page order; white space is one space.

    path has the hashed words of the open elements, tag names and words of class, id and role after a dot, as bits, and
    those of the innermost one. They are kept as elements open and close, so the time is linear in the page, however
    deep it is.
    """
    tags = Tags(page)
    names: list[str] = []
    slots: list[tuple[list[int], int]] = []
    places: dict[str, list[int]] = {}
    counts, bits = [0] * PATH, 0
    out, held, linked = [], [], 0
    at = 0

    def flush() -> None:
        nonlocal held, linked
        text = " ".join("".join(held).split())
        if text:
            out.append((text, (bits, slots[-1][1] if slots else 0), min(1.0, linked / len(text))))
        held, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if places.get("a"):
                linked += len(text.strip())

    def enter(name: str, attributes: list[tuple[str, str]]) -> None:
        nonlocal bits
        words = [name]
        for key, value in attributes:
            if key in ("class", "id", "role"):
                words += [f".{w}" for w in _WORDS.findall(value.lower().replace("_", " "))]
        own = [_slot(w, PATH) for w in words]
        for x in own:
            counts[x] += 1
            bits |= 1 << x
        places.setdefault(name, []).append(len(names))
        names.append(name)
        slots.append((own, sum({1 << _slot(w, LAST) for w in words})))

    def close(name: str, within: frozenset = frozenset()) -> None:
        """Leave up to the last open element of that name, unless one of `within` stands in the way."""
        nonlocal bits
        if not places.get(name) or any(places[w][-1] > places[name][-1] for w in within if w != name and places.get(w)):
            return
        for _ in range(len(names) - places[name][-1]):
            places[names.pop()].pop()
            for x in slots.pop()[0]:
                counts[x] -= 1
                if not counts[x]:
                    bits &= ~(1 << x)

    while True:
        less = page.find("<", at)
        if less < 0:
            say(page[at:])
            break
        following = page[less + 1 : less + 2]
        ending = following == "/"
        begins = page[less + 2 : less + 3] if ending else following
        if begins.isascii() and begins.isalpha():
            say(page[at:less])
            m = _NAME.match(page, less + 1 + ending)
            name = m[0].lower()
            at, attributes, slash = tags.attributes(m.end())
        elif following in ("!", "?") or (ending and begins):
            say(page[at:less])
            if page.startswith("<!--", less):
                at = tags.after("-->", less + 2)
            elif page.startswith("<![CDATA[", less) and (end := tags.find("]]>", less)) >= 0:
                say(page[less + 9 : end].replace("&", "&amp;"))
                at = end + 3
            else:
                at = tags.after(">", less)
            continue
        else:
            say(page[at : less + 1])
            at = less + 1
            continue
        if ending:
            if name in BLOCK:
                flush()
            close(name)
            continue
        if name in RAW:
            if not (slash and name == "svg"):
                at = _raw_end(tags, name, at)
            if name in ("textarea", "select", "iframe"):
                held.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name in _CLOSES_P:
                close("p", _HOLDS_P)
            if name in _CLOSES_OWN:
                close(name, _HOLDS_OWN)
        if name in ("br", "object", "video", "audio", "canvas"):
            held.append(" ")
        if name not in VOID and not slash:
            enter(name, attributes)
    flush()
    return out


def _raw_end(tags: Tags, name: str, at: int) -> int:
    """The place behind the end tag of an element whose content isn't markup; any case of letters."""
    page, low = tags.page, len(name)
    while (found := tags.find("</", at)) >= 0:
        if page[found + 2 : found + 2 + low].lower() == name and not page[found + 2 + low : found + 3 + low].isalnum():
            return tags.after(">", found)
        at = found + 2
    return len(page)


def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def _bits(masks: list[int], size: int) -> np.ndarray:
    raw = b"".join(m.to_bytes(size // 8, "little") for m in masks)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, size // 8), axis=1, bitorder="little")


def vectors(found: list[tuple[str, tuple[int, int], float]], start: int = 0, stop: int | None = None) -> np.ndarray:
    """(blocks, INPUT) inputs of one page's blocks, or of some of them."""
    stop = len(found) if stop is None else stop
    out = np.zeros((stop - start, INPUT), np.float32)
    if stop > start:
        out[:, :PATH] = _bits([path for _, (path, _), _ in found[start:stop]], PATH)
        out[:, PATH : PATH + LAST] = _bits([last for _, (_, last), _ in found[start:stop]], LAST)
    for i in range(start, stop):
        text, _, linked = found[i]
        row = out[i - start]
        words = _WORDS.findall(text.lower())
        if words:
            row[PATH + LAST : PATH + LAST + WORD] = np.sqrt(np.bincount([_slot(w, WORD) for w in words], minlength=WORD) / len(words))
        n = len(text)
        row[-SHARES:] = np.log1p(n) / 6, linked, sum(map(text.count, ".,;:")) / n * 10, min(1.0, len(words) / 20), i / max(1, len(found) - 1), float(len(found) < 3)
    return out


class Labeller:
    """Two LSTMs, one for each direction, and a logistic output on both states of a block."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(INPUT / 4)
        self.p = {f"{d}{k}": (rng.normal(0, s, shape)).astype(np.float32) for d in "fb" for k, s, shape in (("x", scale, (INPUT, 4 * HIDDEN)), ("h", 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)), ("c", 0.0, (4 * HIDDEN,)))}
        for d in "fb":
            self.p[d + "c"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        self.p["w"], self.p["o"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False, begin: list | None = None):
        """States (pages, steps, HIDDEN) of direction d over padded inputs; padding leaves a state as it is.

        begin: a list with the state to begin with, if any; it is given the last one.
        """
        n, steps, _ = x.shape
        a = x.reshape(-1, INPUT) @ self.p[d + "x"] + self.p[d + "c"]
        a = a.reshape(n, steps, -1)
        h, c = begin[-1] if begin else (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        states, trace = np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = a[:, t] + h @ self.p[d + "h"]
            ifo = _logistic(g[:, : 3 * HIDDEN])
            i, f, o, u = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c2 = f * c + i * u
            th = np.tanh(c2)
            if keep:
                trace.append((t, i, f, o, u, c, th, h, m))
            h, c = m * (o * th) + (1 - m) * h, m * c2 + (1 - m) * c
            states[:, t] = h
        if begin is not None:
            begin.append((h, c))
        return (states, trace) if keep else states

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """Probability of main text for each block of each page; pages of like length are run together, STEPS blocks at most."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            some = order[-max(1, STEPS // len(pages[order[-1]])) :]
            del order[-len(some) :]
            if len(pages[some[0]]) > STEPS:
                out[some[0]] = self.label_long(pages[some[0]])
                continue
            x, mask = _padded([vectors(pages[i]) for i in some])
            both = np.concatenate((self.run(x, mask, "f"), self.run(x, mask, "b")), axis=2)
            y = _logistic(both @ self.p["w"] + self.p["o"])
            for j, i in enumerate(some):
                out[i] = y[j, : len(pages[i])]
        return out

    def label_long(self, page: list) -> np.ndarray:
        """label() of one page, STEPS blocks at a time in each direction: states are carried on, inputs are not kept."""
        out = np.full(len(page), self.p["o"][0])
        cuts = range(0, len(page), STEPS)
        for d, places, w in (("f", cuts, self.p["w"][:HIDDEN]), ("b", reversed(cuts), self.p["w"][HIDDEN:])):
            state: list = []
            for at in places:
                x = vectors(page, at, min(len(page), at + STEPS))[None]
                out[at : at + STEPS] += (self.run(x, np.ones(x.shape[:2], np.float32), d, begin=state) @ w)[0]
        return _logistic(out)

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of one batch, by back-propagation through both directions."""
        sf, tf = self.run(x, mask, "f", True)
        sb, tb = self.run(x, mask, "b", True)
        both = np.concatenate((sf, sb), axis=2)
        z = _logistic(both @ self.p["w"] + self.p["o"])
        total = mask.sum()
        loss = -(mask * (y * np.log(z + 1e-7) + (1 - y) * np.log(1 - z + 1e-7))).sum() / total
        dz = mask * (z - y) / total
        grad = {"w": (both * dz[..., None]).sum((0, 1)), "o": np.array([dz.sum()])}
        back = dz[..., None] * self.p["w"]
        for d, trace, ds in (("f", tf, back[..., :HIDDEN]), ("b", tb, back[..., HIDDEN:])):
            dh, dc = np.zeros(ds[:, 0].shape), np.zeros(ds[:, 0].shape)
            da = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.p[d + "h"])
            for t, i, f, o, u, c, th, h, m in reversed(trace):
                dh = dh + ds[:, t]
                own = dh * m
                dc2 = own * o * (1 - th * th) + dc * m
                g = np.concatenate((dc2 * u * i * (1 - i), dc2 * c * f * (1 - f), own * th * o * (1 - o), dc2 * i * (1 - u * u)), axis=1)
                da[:, t] = g
                gh += h.T @ g
                dh, dc = g @ self.p[d + "h"].T + dh * (1 - m), dc2 * f + dc * (1 - m)
            flat = da.reshape(-1, 4 * HIDDEN)
            grad |= {d + "x": x.reshape(-1, INPUT).T @ flat, d + "c": flat.sum(0), d + "h": gh}
        return float(loss), grad


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, max(len(p) for p in pages))
    x, mask = np.zeros((len(pages), steps, INPUT), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


# --- the grammar of training pages -------------------------------------------------------------------------------

#: Names that pages give to their parts, by kind, and words that stand in them.
_NAMES = {
    "menu": "nav navbar menu breadcrumb breadcrumbs topbar site-nav main-menu pagination navigation",
    "header": "header masthead site-header page-header logo branding top banner",
    "footer": "footer site-footer colophon copyright bottom page-footer legal",
    "aside": "sidebar aside widget related recommended trending popular tags rail secondary complementary",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner-ad adsbox ad-slot",
    "notice": "cookie cookies cookie-notice consent gdpr notice alert popup modal newsletter subscribe paywall",
    "form": "form search search-form login signup contact-form subscribe-form",
    "comments": "comments comment comment-list comment-body reply replies respond discussion thread",
    "share": "share social sharing share-buttons toolbar tools",
}
_MAIN_NAMES = "content main post entry entry-content post-content article-body story text main-content page-content body-copy article".split()
_SAID = {
    "menu": "home about contact news products services blog login register help archive",
    "header": "welcome daily the official site magazine",
    "footer": "copyright all rights reserved privacy policy terms of use contact imprint",
    "aside": "related articles popular posts read more recent latest tags archive categories",
    "advert": "advertisement sponsored buy now offer sale discount shop deal free",
    "notice": "we use cookies accept this site uses by continuing you agree subscribe to our newsletter",
    "form": "name email search submit send password enter your message",
    "comments": "says reply posted by great post thanks i agree comment comments ago",
    "share": "share tweet print email this on follow us",
}
_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


class _Page:
    """One made page: html, and whether each block is main text."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.main = rng, [], []
        self.syllables = ["".join(rng.choice("bcdfghklmnprstvz") * rng.choice((0, 1)) + rng.choice("aeiouéèüäöñ") + rng.choice("nrstl") * rng.choice((0, 1)) for _ in range(1)) for _ in range(40)]

    def words(self, n: int) -> str:
        r = self.rng
        out = ["".join(r.choice(self.syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
        return " ".join(w + r.choice(("", "", "", "", ",", ".")) for w in out).capitalize()

    def leaf(self, tag: str, text: str, main: bool, link: bool = False) -> None:
        if link:
            text = f'<a href="/{self.rng.randint(1, 999)}">{text}</a>'
        elif self.rng.random() < 0.2:
            text = f"<b>{text}" + self.rng.choice(("</b>", "<br>", ""))
        end = "" if tag in ("p", "li") and self.rng.random() < 0.2 else f"</{tag}>"
        self.html.append(f"<{tag}>{text}{end}")
        self.main.append(main)

    def open(self, kind: str) -> str:
        r = self.rng
        names = _NAMES[kind].split()
        tag = _TAGS.get(kind, "div") if r.random() < 0.6 else r.choice(("div", "div", "section", "ul" if kind == "menu" else "div"))
        attr = "" if tag == _TAGS.get(kind) and r.random() < 0.6 else f' {r.choice(("class", "class", "id"))}="{" ".join(r.sample(names, r.choice((1, 1, 2))))}"'
        self.html.append(f"<{tag}{attr}>")
        return f"</{tag}>"

    def other(self, kind: str) -> None:
        """A part that is no main text."""
        r = self.rng
        end = self.open(kind)
        said = _SAID[kind].split()
        text = lambda n: self.words(n) if r.random() < 0.55 else " ".join(r.choice(said) for _ in range(max(1, n)))
        if kind in ("menu", "share") or kind in ("aside", "footer") and r.random() < 0.4:
            self.html.append("<ul>")
            for _ in range(r.randint(2, 8)):
                self.leaf("li", text(r.randint(1, 3)), False, link=r.random() < 0.9)
            self.html.append("</ul>")
        elif kind == "comments":
            if r.random() < 0.6:
                self.leaf("h3", text(2), False)
            for _ in range(r.randint(1, 5)):
                self.html.append(f'<div class="{r.choice(_NAMES["comments"].split())}">')
                if r.random() < 0.6:
                    self.leaf("h4", text(2), False)
                self.leaf("p", self.words(r.randint(4, 60)), False)
                self.html.append("</div>")
        elif r.random() < 0.45:
            self.html.append(f"{text(r.randint(2, 25))}")
            self.main.append(False)
        else:
            for _ in range(r.randint(1, 3)):
                self.leaf(r.choice(("p", "p", "p", "div", "h3")), text(r.randint(1, 25)), False, link=r.random() < 0.2)
        self.html.append(end)

    def article(self) -> None:
        r = self.rng
        kind = r.choice(("article", "article", "article", "main", "div", "div", "both", "bare"))
        names = f' {r.choice(("class", "id"))}="{r.choice(_MAIN_NAMES)}"'
        ends = []
        if kind in ("article", "main"):
            self.html.append(f"<{kind}{names if r.random() < 0.3 else ''}>")
            ends = [f"</{kind}>"]
        elif kind != "bare":
            self.html.append(("<main>" if r.random() < 0.5 else "<div>") + f"<div{names}>")
            ends = ["</div>"]
        if r.random() < 0.85:
            self.leaf("h1", self.words(r.randint(1, 9)), True)
        for _ in range(r.choice((0, 1, 1, 2, 3, 4, 6, 9, 14))):
            what = r.random()
            if what < 0.72:
                self.leaf("p", self.words(r.choice((1, 2, 4, 8, 20, 40, 80))), True)
            elif what < 0.79:
                self.leaf(r.choice(("h2", "h3")), self.words(r.randint(1, 6)), True)
            elif what < 0.86:
                self.html.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.leaf("li", self.words(r.randint(1, 15)), True)
                self.html.append("</ul>")
            elif what < 0.92:
                self.leaf(r.choice(("blockquote", "pre", "div", "figcaption")), self.words(r.randint(2, 30)), True)
            elif what < 0.96:
                self.html.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    self.leaf("td", self.words(r.randint(1, 5)), True)
                self.html.append("</tr></table>")
            else:
                self.other(r.choice(("advert", "share", "aside", "notice", "form")))
        if r.random() < 0.12:
            self.other(r.choice(("comments", "share", "aside")))
        self.html += ends

    def make(self) -> tuple[str, list[bool]]:
        r = self.rng
        self.html.append(f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><script>var a = 1;</script></head><body>")
        wrapped = r.random() < 0.3
        if wrapped:
            self.html.append(f'<{r.choice(("div", "div", "div", "form"))} class="{r.choice(("wrapper", "container", "page", "site", "layout"))}">')
        if r.random() < 0.93:
            for kind in r.sample(("menu", "header", "advert", "notice", "form", "menu", "aside"), r.randint(0, 4)):
                self.other(kind)
        self.article()
        if r.random() < 0.9:
            for kind in r.sample(("comments", "aside", "advert", "footer", "share", "form", "notice"), r.randint(0, 3)):
                self.other(kind)
            if r.random() < 0.7:
                self.other("footer")
        return "".join(self.html) + ("</body></html>" if r.random() < 0.8 else ""), self.main


def made_pages(n: int, seed: int) -> list[tuple[str, list[bool]]]:
    """n pages of the grammar with the label of each block."""
    rng = random.Random(seed)
    return [_Page(rng).make() for _ in range(n)]


@functools.lru_cache(4)
def trained(pages: int = 700, epochs: int = 9, seed: int = 11) -> Labeller:
    """A labeller fitted to made pages by Adam; the same on every machine up to rounding."""
    data = []
    for page, main in made_pages(pages, seed):
        found = blocks(page)
        if len(found) == len(main) and found:
            data.append((vectors(found), np.array(main, np.float32)))
    data.sort(key=lambda d: len(d[0]))
    batches = []
    for k in range(0, len(data), 32):
        x, mask = _padded([v for v, _ in data[k : k + 32]])
        y = np.zeros(mask.shape, np.float32)
        for i, (_, m) in enumerate(data[k : k + 32]):
            y[i, : len(m)] = m
        batches.append((x, mask, y))
    net, rng = Labeller(seed), np.random.default_rng(seed)
    first, second, t = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            t += 1
            _, grad = net.step(*batches[k])
            rate = 0.01 * (0.15 if epoch >= epochs - 2 else 1)
            for name, g in grad.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                net.p[name] -= (rate * first[name] / (1 - 0.9**t) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_blocks, n_main) for each row of pages, from the whole html.

    The main blocks in page order, joined by one space; an empty string where there are none, as for null or empty
    html. Damaged markup is read as far as it goes; long pages are read whole. Repeated rows and null keys stay, an
    empty table gives an empty result; other columns play no part.
    """
    net = trained()
    out = T.StructType([pages.schema[key], pages.schema[url]] + list(T._parse_datatype_string("text string, n_chars long, n_blocks long, n_main long").fields))
    arrow = _arrow_schema(out)

    def run(batches):

        for batch in batches:
            for part in slices(batch, 2):
                found = [blocks(x or "") for x in part.column(2).to_pylist()]
                labels = net.label(found)
                kept = [[b[0] for b, y in zip(own, ys, strict=True) if y >= 0.5] for own, ys in zip(found, labels, strict=True)]
                texts = [" ".join(x) for x in kept]
                cols = [part.column(0), part.column(1), pa.array(texts), pa.array([len(x) for x in texts]), pa.array([len(b) for b in found]), pa.array([len(x) for x in kept])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return map_batches(pages.select(key, url, page), run, out)
