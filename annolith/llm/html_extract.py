"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks in page order.  Each block has a vector of its
tag path (hashed tags, classes and ids), of its hashed words, and of a few
counts.  A bidirectional LSTM in numpy reads the page's sequence and labels
every block as article text or not with the whole document for context.  It is
trained here, on pages that a seeded generator writes in many layouts.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import mapped

#: A quote opens a value after = alone, as in HTML, and the value is as long as it is; a stray one is a character.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
NAMES = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Fixed values of HTML: elements whose content is no markup, that hold no readable text, that have no end, and that stand in a line of text.
RAW = frozenset("script style textarea title xmp noembed noframes plaintext".split())
UNREAD = frozenset("head script style textarea title noscript template svg math select option datalist button iframe object canvas audio video map xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What a start tag ends: elements of these names that are open within the nearest of the bounds.
P_ENDERS = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
BOUNDS = frozenset("ul ol dl table menu nav article section div main aside header footer form body td th blockquote".split())

PATH_DIM, WORD_DIM, COUNT_DIM = 96, 24, 14
WIDTH = PATH_DIM + WORD_DIM + COUNT_DIM
#: Share of the training pages whose words are hidden, so that tag paths and context decide.
WORDS_DROPPED = 0.8


class Block:
    __slots__ = ("label", "linked", "parts", "path")

    def __init__(self, path, label=None):
        self.path, self.parts, self.linked, self.label = path, [], 0, label


def names_of(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = []
    for _, value in ATTRIBUTE.findall(attributes):
        found += NAMES.findall(CAMEL.sub(" ", value).lower())
    return tuple(found)


def read_blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. Unclosed elements end with what encloses them, and the page may break off anywhere."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    unread = links = 0
    now: Block | None = None
    at, n = 0, len(page)

    def pop_to(depth: int) -> None:
        nonlocal unread, links
        for tag, _ in stack[depth:]:
            unread -= tag in UNREAD
            links -= tag == "a"
        del stack[depth:]

    def text(piece: str) -> None:
        nonlocal now
        if unread or not piece:
            return
        piece = entities.unescape(piece)  # a reference ends where markup begins
        if now is None:
            if piece.isspace():
                return
            now = Block(tuple(stack))
            blocks.append(now)
        now.parts.append(piece)
        if links:
            now.linked += len(piece)

    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        closing, tag = m[1], m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "hr":
            text(" ")
        if tag not in INLINE and tag != "br":
            now = None
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        ended = ENDS.get(tag, ("p",) if tag in P_ENDERS else ())
        if ended:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ended:
                    pop_to(depth)
                    if ended[0] == tag or len(ended) == 1:
                        break
                elif stack[depth][0] in BOUNDS:
                    break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        stack.append((tag, names_of(m[3] or "")))
        unread += tag in UNREAD
        links += tag == "a"
    return blocks


def block_text(block: Block) -> str:
    return " ".join("".join(block.parts).split())


def pages_blocks(page: str) -> list[tuple[Block, str]]:
    return [(b, t) for b in read_blocks(page) if (t := block_text(b))]


class Vectors:
    """Block vectors; keeps those of the paths and words met, at most `most` of each."""

    def __init__(self, most: int = 100_000):
        self.paths: dict = {}
        self.words: dict = {}
        self.most = most

    def path(self, path: tuple) -> np.ndarray:
        got = self.paths.get(path)
        if got is None:
            got = np.zeros(PATH_DIM, np.float32)
            for depth, (tag, names) in enumerate(path):
                near = 1.0 if depth >= len(path) - 3 else 0.7
                for name in (tag, *("." + x for x in names), *(("." + "".join(names),) if len(names) > 1 else ())):
                    h = crc32(name.encode())
                    for part in (h, h >> 11):
                        got[part % PATH_DIM] += near if (h >> 30) & 1 else -near
            got = np.clip(got, -3, 3)
            if len(self.paths) >= self.most:
                self.paths.clear()
            self.paths[path] = got
        return got

    def word(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= self.most:
                self.words.clear()
            got = self.words[word] = crc32(word.lower().strip(".,;:!?").encode()) % (2 * WORD_DIM)
        return got

    def page(self, blocks: list[tuple[Block, str]]) -> np.ndarray:
        out = np.zeros((len(blocks), WIDTH), np.float32)
        total = sum(len(t) for _, t in blocks)
        seen = 0
        for i, (b, t) in enumerate(blocks):
            out[i, :PATH_DIM] = self.path(b.path)
            words = t.split(" ")
            h = np.array([self.word(w) for w in words])
            out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(h % WORD_DIM, weights=np.where(h >= WORD_DIM, 1.0, -1.0), minlength=WORD_DIM) / math.sqrt(len(h))
            tags = {x for x, _ in b.path}
            out[i, PATH_DIM + WORD_DIM :] = (
                math.log1p(len(t)) / 5, math.log1p(len(words)) / 4, min(1.0, b.linked / len(t)), len(t) / max(1, total), seen / max(1, total), i / len(blocks),
                min(len(b.path), 20) / 10, t[-1] in ".!?", any(f"h{k}" in tags for k in range(1, 7)), "li" in tags, "p" in tags, sum(c.isdigit() for c in t) / len(t), "a" in tags, math.log1p(len(blocks)) / 5,
            )
            seen += len(t)
        return out


class Lstm:
    """One direction, over a padded batch (time, page, width)."""

    def __init__(self, width: int, hidden: int, r: np.random.Generator):
        self.hidden = hidden
        self.w = {"x": r.normal(0, width**-0.5, (width, 4 * hidden)), "h": r.normal(0, hidden**-0.5, (hidden, 4 * hidden)), "b": np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])}

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        t, n, _ = x.shape
        d = self.hidden
        pre = x @ self.w["x"] + self.w["b"]
        h, c, out, tape = np.zeros((n, d)), np.zeros((n, d)), np.empty((t, n, d)), []
        for k in range(t):
            z = pre[k] + h @ self.w["h"]
            s = 1 / (1 + np.exp(-z[:, : 3 * d]))
            f, i, o, g = s[:, :d], s[:, d : 2 * d], s[:, 2 * d :], np.tanh(z[:, 3 * d :])
            m = mask[k][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                tape.append((h, c, f, i, o, g, tc))
            c = m * new + (1 - m) * c
            h = m * o * tc + (1 - m) * h
            out[k] = h
        return out, tape

    def backward(self, x, mask, tape, dout):
        t, n, _ = x.shape
        d = self.hidden
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        dh, dc = np.zeros((n, d)), np.zeros((n, d))
        for k in range(t - 1, -1, -1):
            h, c, f, i, o, g, tc = tape[k]
            m = mask[k][:, None]
            dh = dh + dout[k]
            live, livec = m * dh, m * dc
            dnew = livec + live * o * (1 - tc**2)
            dz = np.concatenate([dnew * c * f * (1 - f), dnew * g * i * (1 - i), live * tc * o * (1 - o), dnew * i * (1 - g**2)], 1)
            grad["x"] += x[k].T @ dz
            grad["h"] += h.T @ dz
            grad["b"] += dz.sum(0)
            dh = (1 - m) * dh + dz @ self.w["h"].T
            dc = (1 - m) * dc + dnew * f
        return grad


class BlockLabeller:
    """A bidirectional LSTM and a logistic unit over both its states and the block's own vector."""

    def __init__(self, hidden: int = 12, seed: int = 17):
        r = np.random.default_rng(seed)
        self.ahead, self.behind = Lstm(WIDTH, hidden, r), Lstm(WIDTH, hidden, r)
        self.w = {"out": r.normal(0, 0.1, 2 * hidden + WIDTH), "bias": np.zeros(1)}

    @staticmethod
    def batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        most = max(len(p) for p in pages)
        x, mask = np.zeros((most, len(pages), WIDTH)), np.zeros((most, len(pages)))
        for j, p in enumerate(pages):
            x[: len(p), j], mask[: len(p), j] = p, 1
        return x, mask

    def forward(self, x, mask, keep=False):
        a, tape_a = self.ahead.forward(x, mask, keep)
        b, tape_b = self.behind.forward(x[::-1], mask[::-1], keep)
        joint = np.concatenate([a, b[::-1], x], 2)
        p = 1 / (1 + np.exp(-np.clip(joint @ self.w["out"] + self.w["bias"][0], -30, 30)))
        return p, joint, tape_a, tape_b

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 6, size: int = 32, rate: float = 0.01, seed: int = 23) -> None:
        r, step = np.random.default_rng(seed), 0
        groups = {"a": self.ahead.w, "b": self.behind.w, "o": self.w}
        m = {(g, k): np.zeros_like(v) for g, w in groups.items() for k, v in w.items()}
        v = {k: np.zeros_like(x) for k, x in m.items()}
        mean = {k: groups[k[0]][k[1]].copy() for k in m}
        for epoch in range(epochs):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i]) // 8, r.random()))
            cuts = [order[i : i + size] for i in range(0, len(order), size)]
            for c in r.permutation(len(cuts)):
                x, mask = self.batch([pages[i] for i in cuts[c]])
                # words or counts alone shall not decide
                x[:, r.random(x.shape[1]) < WORDS_DROPPED, PATH_DIM : PATH_DIM + WORD_DIM] = 0
                x[:, r.random(x.shape[1]) < 0.3, PATH_DIM + WORD_DIM :] = 0
                y = np.zeros_like(mask)
                for j, i in enumerate(cuts[c]):
                    y[: len(labels[i]), j] = labels[i]
                p, joint, ta, tb = self.forward(x, mask, True)
                d = (p - y) * mask / mask.sum()
                dj = d[:, :, None] * self.w["out"]
                n = self.ahead.hidden
                grads = {("o", "out"): np.einsum("tn,tnk->k", d, joint), ("o", "bias"): np.array([d.sum()])}
                grads |= {("a", k): g for k, g in self.ahead.backward(x, mask, ta, dj[:, :, :n]).items()}
                grads |= {("b", k): g for k, g in self.behind.backward(x[::-1], mask[::-1], tb, dj[::-1, :, n : 2 * n]).items()}
                norm = math.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                step += 1
                for key, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[key] = 0.9 * m[key] + 0.1 * g
                    v[key] = 0.99 * v[key] + 0.01 * g**2
                    w = groups[key[0]]
                    w[key[1]] -= rate * 0.75**epoch * (m[key] / (1 - 0.9**step) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-8) + 0.03 * w[key[1]])
                    mean[key] += 0.01 * (w[key[1]] - mean[key])
        for (g, k), x in mean.items():  # the running mean of the weights labels more steadily than the last of them
            groups[g][k] = x

    def label(self, pages: list[np.ndarray], most: int = 60_000) -> list[np.ndarray]:
        """Whether each block is article text. Pages of like length are labelled together, of at most `most` blocks with padding."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 512 and len(pages[order[hi]]) * (hi + 1 - lo) <= most:
                hi += 1
            part = order[lo:hi]
            x, mask = self.batch([pages[i] for i in part])
            x[:, :, PATH_DIM : PATH_DIM + WORD_DIM] *= 1 - WORDS_DROPPED  # their mean in training
            p = self.forward(x, mask)[0]
            for j, i in enumerate(part):
                out[i] = p[: len(pages[i]), j] >= 0.5
            lo = hi
        return out


class PageWriter:
    """Seeded pages with a label for each block."""

    #: Names that layouts give to their parts.
    CONTENT = ["article", "article", "article", "article.post", "main", "main", "div.content", "div#content", "div.post", "div.post-content", "div.entry-content", "div.article-body", "section.story", "div#main", "div.text", "div.page article", "main article", "section", "div.container main", "div"]
    OUTSIDE = {
        "links": ["nav", "nav.menu", "ul.menu", "div.nav", "div#navigation", "div.navbar", "div.breadcrumb", "ul.pagination", "div.related", "div.tags", "div.social", "div.share-buttons", "header nav", "aside.links", "div.toc", "div.recommended", "div.most-read"],
        "short": ["header", "div.header", "div#header", "div.top-bar", "div.logo", "div.login", "div.search", "div.byline-box widget", "header.site-header"],
        "note": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div.banner", "aside", "aside.sidebar", "div.sidebar", "div#sidebar", "div.widget", "div.cookie", "div.cookie-banner", "div#consent", "div.notice", "div.alert", "div.popup", "div.modal", "div.newsletter", "section.subscribe", "div.disclaimer", "div.gdpr"],
        "form": ["form", "form.search", "form.newsletter", "form#login", "div.signup form", "form.contact", "div.poll form"],
        "foot": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "footer nav", "div.bottom"],
        "talk": ["div.comments", "section.comments", "div#comments", "ol.comment-list", "div.comment", "div.replies", "section#responses", "div.discussion", "ul.comments"],
    }
    PHRASES = {"note": ["We use cookies", "Accept all", "Advertisement", "Sponsored content", "Subscribe to our newsletter", "Buy now", "Sale"], "foot": ["&copy; 2020", "All rights reserved", "Privacy policy", "Terms of use", "Contact"], "links": ["Home", "About", "Next", "Read more", "Share"], "form": ["Email", "Name", "Search", "Send", "Password"], "short": ["Log in", "Menu", "Welcome"], "talk": ["Reply", "says:", "wrote:", "2 hours ago", "Report"]}

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        r = self.r
        self.syllables = ["".join(r.choice("aeiouéüóbcdfghklmnprstvwz") for _ in range(r.randint(1, 4))) for _ in range(40)]

    def words(self, n: int) -> str:
        r = self.r
        said = ["".join(r.choice(self.syllables) for _ in range(r.choice((1, 1, 2, 3)))) for _ in range(n)]
        for i in range(n):
            if r.random() < 0.12:
                said[i] += r.choice(".,")
        said[0] = said[0].capitalize()
        return " ".join(said) + r.choice((".", ".", ".", ""))

    def opened(self, path: str) -> str:
        """Opens the elements of a path and gives back what closes them."""
        close = []
        for part in path.split(" "):
            m = re.fullmatch(r"(\w+)([.#][\w-]+)?", part)
            if m is None:
                continue
            tag, name = m[1], m[2] or ""
            extra = self.r.choice(("", "", "", " x1", " row", " wide", " box")) if name.startswith(".") else ""
            attr = f' class="{name[1:]}{extra}"' if name.startswith(".") else f' id="{name[1:]}"' if name else ""
            self.out.append(f"<{tag}{attr}>")
            close.append(f"</{tag}>")
        return "".join(reversed(close))

    def mark(self, text: str, label: int) -> str:
        """The text with its label in a mark, which labelled_blocks() takes out again."""
        return f"\x01{label}{text}"

    def outside(self, kind: str) -> None:
        r = self.r
        close = self.opened(r.choice(self.OUTSIDE[kind]))
        phrase = (r.choice(self.PHRASES[kind]) + " ") if r.random() < 0.3 else ""
        if kind == "links":
            items = [f'<a href="/{i}">{self.mark(phrase + self.words(r.randint(1, 5)), 0)}</a>' for i in range(r.randint(2, 9))]
            self.out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else "".join(f"<div>{x}</div>" for x in items))
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                self.out.append(f"<p><label>{self.mark(phrase + self.words(r.randint(1, 6)), 0)}</label><input type=text></p>")
        elif kind == "talk":
            for _ in range(r.randint(1, 5)):
                inner = self.opened(r.choice(("div", "div", "li", "li", "article.comment", "div.comment", "div.comment-body", "div.reply")))
                if r.random() < 0.6:
                    self.out.append(f"<span>{self.mark(phrase + self.words(2), 0)}</span>")
                self.out.append("".join(f"<p>{self.mark(self.words(r.randint(3, 70)), 0)}</p>" for _ in range(r.randint(1, 3))) + inner)
        else:
            n = {"short": 1, "note": r.randint(1, 3), "foot": r.randint(1, 3)}[kind]
            for _ in range(n):
                text = self.mark(phrase + self.words(r.randint(1, 40 if kind != "short" else 8)), 0)
                self.out.append(r.choice((f"<p>{text}</p>", text + "<div></div>", f"<div>{text}</div>", f"<h3>{text}</h3>")))
        self.out.append(close if kind != "foot" or r.random() > 0.1 else "")

    def article(self) -> None:
        r = self.r
        close = self.opened(r.choice(self.CONTENT))
        if r.random() < 0.85:
            self.out.append(f"<h1>{self.mark(self.words(r.randint(2, 14)), 1)}</h1>")
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14, 25, 60))):
            x = r.random()
            size = r.choice((1, 2, 4, 10, 30, 60, 120))
            if x < 0.78:
                text = self.mark(self.words(size), 1)
                wrap = r.random()
                self.out.append(f"<p><b>{text}<br>" if wrap < 0.15 else f'<p>{text} <a href="/x">{self.words(3)}</a></p>' if wrap < 0.25 else f"<p>{text}" if wrap < 0.35 else f"<p>{text}</p>")
            elif x < 0.86:
                self.out.append(f"<{(h := r.choice(('h2', 'h3', 'h4')))}>{self.mark(self.words(r.randint(1, 8)), 1)}</{h}>")
            elif x < 0.92:
                self.out.append("<ul>" + "".join(f"<li>{self.mark(self.words(r.randint(2, 20)), 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.95:
                self.out.append(f"<blockquote><p>{self.mark(self.words(size), 1)}</p></blockquote>")
            else:
                self.outside(r.choice(("note", "links", "form")))
        if r.random() < 0.12:  # within the article, but not its text
            self.outside(r.choice(("talk", "foot", "links")))
        self.out.append(close)

    def page(self) -> str:
        r = self.r
        self.out.append("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>")
        outer = self.opened(r.choice(("", "", "div.wrapper", "div#page", "div.container")))
        for kind in ("short", "links", "note", "form"):
            for _ in range(r.choice((0, 1, 1, 2) if kind in ("links", "note") else (0, 0, 1))):
                self.outside(kind)
        self.article()
        for kind in ("links", "note", "form", "talk", "foot"):
            for _ in range(r.choice((0, 1, 1)) if kind == "foot" else r.choice((0, 0, 1))):
                self.outside(kind)
        self.out.append(outer + "</body></html>")
        text = "".join(self.out)
        return text[: r.randint(len(text) // 2, len(text))] if r.random() < 0.1 else text


def labelled_blocks(page: str) -> tuple[list[tuple[Block, str]], np.ndarray]:
    found, labels = [], []
    for b in read_blocks(page):
        raw = block_text(b)
        m = re.search("\x01([01])", raw)
        text = re.sub("\x01[01]?", "", raw).strip()
        if text and m:
            found.append((b, text))
            labels.append(int(m[1]))
    return found, np.array(labels, float)


def fit_labeller(pages: int = 3_000, seed: int = 29) -> BlockLabeller:
    """Train on `pages` generated pages."""
    vectors, xs, ys = Vectors(), [], []
    for i in range(pages):
        blocks, y = labelled_blocks(PageWriter(seed * 100_003 + i).page())
        if blocks:
            xs.append(vectors.page(blocks))
            ys.append(y)
    model = BlockLabeller()
    model.fit(xs, ys)
    return model


def extract_text(pages: DataFrame, model: BlockLabeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) of every whole page.

    text: the blocks labelled as article text in page order, joined by a space; each with its character references
    decoded and its white space runs turned into one space. Null and empty pages, and pages without readable text,
    have an empty text. Repeated rows are repeated; an empty table gives an empty result; other columns are ignored."""

    def make():
        vectors = Vectors()

        def run(batch):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                blocks = [pages_blocks(x.as_py() or "") for x in part.column(2)]
                kept = model.label([vectors.page(b) for b in blocks])
                texts = [" ".join(t for (_, t), k in zip(b, y, strict=True) if k) for b, y in zip(blocks, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in blocks], pa.int64()), pa.array([int(y.sum()) for y in kept], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

        return run

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return mapped(source, make, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
