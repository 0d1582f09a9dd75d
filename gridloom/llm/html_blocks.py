"""HTML extraction by a recurrent block labeller: a bidirectional LSTM in numpy reads a page's text blocks in order and labels each.

A page becomes its sequence of leaves: runs of text between the bounds of block elements, with the path of elements above and the
words in it. A leaf's vector holds the path's elements and their hashed class and id words, hashed words of the text, and a few
figures (length, share of link text, place). The network sees the whole page from both sides before it labels any leaf.

It is trained here, on the driver, from pages that `page_maker` makes up (a few seconds, once a process, seed fixed); its few thousand
weights are sent to the executors. Pages are only mapped, in groups of like length.

Defined cases: a null or empty html gives an empty text; so does a page without any block labelled as main text; markup that is cut
off or not closed is read as far as it goes; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import chunks

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_CUES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# HTML elements whose content is no text, that hold a single value, and that bound blocks.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: A start tag that ends an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PATH = sorted(BLOCK - {"body", "html", "head", "hr"})
CUES, WORDS = 40, 24
WIDTH = 2 * len(PATH) + CUES + WORDS + 9
HIDDEN = 16


class Leaf:
    __slots__ = ("text", "path", "cues", "link")

    def __init__(self, text: str, path: tuple, cues: tuple, link: float):
        self.text, self.path, self.cues, self.link = text, path, cues, link


def leaves(source: str) -> list[Leaf]:
    """The page's text blocks in order. White space in a block is one space; references are decoded."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    link, linked, breaks = 0, 0, 0

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Leaf(text, tuple(t for t, _ in stack), tuple(c for _, own in stack for c in own), min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    i, n = 0, len(source)
    while i < n:
        m = _TAG.search(source, i)
        if (to := m.start() if m else n) > i:
            text = entities.unescape(source[i:to])
            parts.append(text)
            if link:
                linked += len(text)
            if not text.isspace():
                breaks = 0
        if not m:
            break
        if m[1]:
            close = source.find("-->", m.end())
            i = close + 3 if close >= 0 else n
            continue
        rest = _REST.match(source, m.end())
        i = rest.end() if rest else (source.find(">", m.end()) + 1 or n)
        if m[2]:
            continue
        name, closing = m[4].lower(), bool(m[3])
        if name in RAW:
            if not closing and not source[m.end() : i].endswith("/>"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, i)
                i = close.end() if close else n
            continue
        if name == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                end()
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name not in BLOCK:
            if name in VOID:
                parts.append(" ")
            continue
        end()
        breaks = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            link = 0
            continue
        ended = CLOSES.get(name, set())
        if stack and (stack[-1][0] == "p" or stack[-1][0] in ended):
            stack.pop()
            if stack and stack[-1][0] in ended:
                stack.pop()
        if name not in VOID and name not in ("html", "head", "body"):
            cues = tuple(w for c in _CUES.findall(source[m.end() : i]) for w in re.findall(r"[a-z]+", "".join(c).lower()))
            stack.append((name, cues))
    end()
    return out


@functools.lru_cache(100_000)
def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


_PLACE = {t: k for k, t in enumerate(PATH)}


def vectors(page: list[Leaf]) -> np.ndarray:
    x = np.zeros((len(page), WIDTH), np.float32)
    p, n = len(PATH), len(page)
    for k, leaf in enumerate(page):
        row = x[k]
        for t in leaf.path:
            row[_PLACE[t]] = 1
        if leaf.path:
            row[p + _PLACE[leaf.path[-1]]] = 1
        for c in leaf.cues:
            row[2 * p + _hash(c) % CUES] = 1
        words = leaf.text.lower().split()
        for w in words:
            v = _hash(w)
            row[2 * p + CUES + v % WORDS] += 1 if v >> 31 else -1
        part = row[2 * p + CUES : 2 * p + CUES + WORDS]
        part /= max(1.0, float(np.sqrt((part**2).sum())))
        row[-9:] = (np.log1p(len(leaf.text)) / 8, leaf.link, len(words) < 4, leaf.text[-1] in ".!?…:;\"”»)", "©" in leaf.text, len(leaf.path) / 8, k / n, k == 0, 1)
    return x


class Network:
    """Weights [input, gates], [hidden, gates] and biases in both directions, and the output's."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        g = 4 * HIDDEN
        self.p = {f"{k}{d}": v.astype(np.float32) for d in "fb" for k, v in (("x", rng.normal(0, 0.15, (WIDTH, g))), ("h", rng.normal(0, 0.2, (HIDDEN, g))), ("c", np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])))}
        self.p["o"], self.p["e"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        steps, n, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        z = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            f, i, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            before = (h, c)
            c2 = f * c + i * u
            h2 = o * np.tanh(c2)
            h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
            out[t] = h
            if keep is not None:
                keep.append((t, f, i, o, u, c2, *before, m))
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities [step, page] for x [step, page, width]."""
        both = np.concatenate([self._run(x, mask, d, keep.setdefault(d, []) if keep is not None else None) for d in "fb"], 2)
        if keep is not None:
            keep["both"] = both
        return 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["e"], -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        keep: dict = {}
        p = self.forward(x, mask, keep)
        err = (p - y) * mask / mask.sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"], g["e"] = (keep["both"] * err[:, :, None]).sum((0, 1)), np.array([err.sum()], np.float32)
        down = err[:, :, None] * self.p["o"]
        for k, d in enumerate("fb"):
            own, dh, dc = down[:, :, k * HIDDEN : (k + 1) * HIDDEN], 0, 0
            da = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            for t, f, i, o, u, c2, h0, c0, m in reversed(keep[d]):
                dh = dh + own[t]
                th = np.tanh(c2)
                dcell = (dh * o * (1 - th**2) + dc) * m
                da[t] = np.concatenate([dcell * c0 * f * (1 - f), dcell * u * i * (1 - i), dh * m * th * o * (1 - o), dcell * i * (1 - u**2)], 1)
                g[f"h{d}"] += h0.T @ da[t]
                dh, dc = dh * (1 - m) + da[t] @ self.p[f"h{d}"].T, dcell * f + dc * (1 - m)
            g[f"x{d}"], g[f"c{d}"] = np.einsum("tnw,tng->wg", x, da, optimize=True), da.sum((0, 1))
        q = np.clip(p, 1e-7, 1 - 1e-7)
        return g, float(-((y * np.log(q) + (1 - y) * np.log(1 - q)) * mask).sum() / mask.sum())

    def label(self, pages: list[list[Leaf]], batch: int = 64) -> list[np.ndarray]:
        """Of each page, which leaves are main text."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[min(batch, len(order)) - 1]])
            some, order = order[: max(1, min(batch, 20_000 // longest))], order[max(1, min(batch, 20_000 // longest)) :]
            x, mask = padded([vectors(pages[k]) for k in some])
            p = self.forward(x, mask)
            for j, k in enumerate(some):
                out[k] = p[: len(pages[k]), j] >= 0.5
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, v in enumerate(pages):
        x[: len(v), k], mask[: len(v), k] = v, 1
    return x, mask


def page_maker(rng: random.Random) -> tuple[str, list[str]]:
    """A made-up page and its main text's blocks: many layouts, with and without the elements that name a block's part."""
    syllables = rng.choice(["th er on an re he in ed nd ha at en es of or nt ea ti to it", "ie en er ch de in sch ung te st ge be ü ä ö ß zu ver keit", "es en le de ent ion re ai é è eau eux ment tion ou la", "os as ción que ll rr ñ ó í ar do mente ez ga co la ie", "ka mo ri ta ne lu sa vi po de zi qu wo jy xe bu"]).split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 5)))
    few = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=3, b=22: few(a, b).capitalize() + rng.choice([".", ".", ".", "?", "!"])
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(rng.randint(a, b)))
    odd = rng.random()
    noise = (lambda s: " ".join(w + rng.choice(["###", "%%%", "&amp;&amp;", "$$$", "!!", ""]) for w in s.split())) if odd < 0.1 else (lambda s: s)
    main: list[str] = []

    def put(text: str) -> str:
        main.append(" ".join(entities.unescape(re.sub("<[^>]*>", "", text)).split()))
        return text

    cls = lambda *names: rng.choice(["", f' class="{rng.choice(names)}"', f' class="{rng.choice(names)} {word()}"', f' id="{rng.choice(names)}"'])
    sure = lambda *names: rng.choice([f' class="{rng.choice(names)}"', f" class='{rng.choice(names)}-{rng.choice(['box', 'list', 'wrap', word()])}'", f' id="{rng.choice(names)}"'])
    links = lambda a, b: "<ul>" + "".join(f'<li><a href="/{k}">{few(1, 3)}</a>' + rng.choice(["</li>", ""]) for k in range(rng.randint(a, b))) + "</ul>"
    title = noise(few(2, 12).capitalize())
    broken = rng.random() < 0.4

    def paragraph() -> str:
        kind = rng.random()
        if broken and kind < 0.2:
            return "<p><b>" + put(noise(prose())) + "<br>"
        if kind < 0.66:
            text = noise(prose())
            if rng.random() < 0.25:
                text = text.replace(" ", f' <a href="/{word()}">', 1).replace(" ", " ", 1)
                text = text.rstrip(".") + "</a>." if rng.random() < 0.3 else re.sub(r'(<a href="[^"]*">)(\S+)', r"\1\2</a>", text, count=1)
            return "<p>" + put(text) + rng.choice(["</p>", "</p>", "</p>\n", "" if broken else "</p>"])
        if kind < 0.74:
            return f"<h{(k := rng.randint(2, 4))}>{put(few(1, 7).capitalize())}</h{k}>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{put(rng.choice([few(1, 6), prose(1, 2)]))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.87:
            return f"<blockquote><p>{put(prose())}</p></blockquote>"
        if kind < 0.90:
            return f"<pre>{put(few(3, 12))}</pre>"
        if kind < 0.94:
            return "<table><tr>" + "".join(f"<td>{put(few(1, 3))}</td>" for _ in range(rng.randint(2, 4))) + "</tr></table>"
        if kind < 0.97:
            return "<div>" + put(prose()) + "</div>"
        return f"<p>{put(word().capitalize() + '.')}</p>"

    def advert() -> str:
        return f"<{(t := rng.choice(['div', 'div', 'aside', 'section', 'p']))}{sure('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'banner')}>{rng.choice([prose(1, 3), few(2, 9)])}</{t}>"

    def notice() -> str:
        return f"<div{sure('cookie', 'notice', 'cookies', 'consent', 'newsletter', 'subscribe', 'alert', 'gdpr', 'banner', 'popup', 'paywall')}>{rng.choice(['<p>', ''])}{rng.choice(['We use cookies to improve this site.', 'Subscribe to our newsletter today', prose(1, 2)])}{rng.choice(['', '<button>Accept</button>', '<button>' + word() + '</button>'])}</div>"

    def comments() -> str:
        one = lambda: f"<{(t := rng.choice(['div', 'li', 'article', 'p']))}{sure('comment', 'reply', 'comment-body')}>{rng.choice(['', f'<b>{word()}</b> ', f'<h4>{word()}</h4>'])}{rng.choice(['<p>' + prose() + '</p>', prose()])}</{t}>"
        t = rng.choice(["section", "div", "ol"])
        return f"<{t}{sure('comments', 'comment-list', 'responses', 'discussion', 'replies', 'disqus')}>{rng.choice(['', '<h3>Comments</h3>', f'<h2>{few(1, 3)}</h2>'])}{''.join(one() for _ in range(rng.randint(1, 6)))}</{t}>"

    def form() -> str:
        return f"<form{cls('search', 'login', 'contact', 'signup')}>{rng.choice(['', f'<p>{sentence()}</p>', f'<h3>{few(1, 3)}</h3>'])}<label>{few(1, 3)}</label><input type=text><select><option>{word()}</option><option>{word()}</option></select><button>{word()}</button></form>"

    def side() -> str:
        t = rng.choice(["aside", "aside", "div"])
        inner = rng.choice([links(3, 8), f"<p>{prose()}</p>", f"<h3>{few(1, 4)}</h3>{links(2, 6)}", f"<h3>{few(1, 3)}</h3><p>{prose()}</p>", prose(1, 3)])
        return f"<{t}{cls('widget', 'sidebar') if t == 'aside' else sure('sidebar', 'side', 'widget', 'related', 'share', 'social', 'recommended', 'trending', 'tags', 'breadcrumb')}>{inner}</{t}>"

    body = [rng.choice([f"<nav{cls('nav', 'menu')}>{links(3, 9)}</nav>", f"<div{sure('nav', 'menu', 'navbar', 'topbar')}>{links(3, 9)}</div>", f"<header{cls('header', 'top')}>{rng.choice([f'<h1>{few(1, 4)}</h1>', f'<p>{sentence()}</p>', f'<div>{few(1, 3)}</div>', ''])}<nav>{links(2, 7)}</nav></header>", f"<header>{few(1, 4)}</header>" + links(3, 6).replace("<ul>", "<ul class=menu>"), ""])]
    extras = lambda k: "".join(rng.choice([advert, notice, form, side])() for _ in range(k))
    body.append(rng.choice(["", f"<!-- {word()} -->"]) + extras(rng.choice([0, 0, 1, 1, 2])))
    wrap = rng.choice(["article", "article", "article", "main", "main article", "div", "section", "div article"]).split()
    opened = "".join(f"<{t}{sure('content', 'post', 'entry', 'article', 'story', 'main', 'post-body', 'entry-content') if t == wrap[-1] == 'div' or (t == 'section') else cls('content', 'post', 'page')}>" for t in wrap)
    inner = [f"<h1>{put(title)}</h1>"] if rng.random() < 0.85 else []
    if rng.random() < 0.2:
        inner.insert(0, "<header>" + inner.pop() + "</header>") if inner else None
    for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
        inner.append(paragraph())
        if rng.random() < 0.06:
            inner.append(rng.choice([advert, side, form, notice])())
    if rng.random() < 0.15:
        inner.append(comments())
    body += [opened, *inner, "".join(f"</{t}>" for t in reversed(wrap))]
    if rng.random() < 0.3:
        body.append(comments())
    body.append(extras(rng.choice([0, 0, 1, 1, 2])))
    if rng.random() < 0.85:
        t = rng.choice(["footer", "footer", "div"])
        body.append(f"<{t}{cls('footer') if t == 'footer' else sure('footer', 'bottom', 'copyright')}>{rng.choice(['&copy; ' + word() + '.example.com &middot; ' + prose(1, 2), '<p>&copy; ' + few(1, 4) + '</p>', links(2, 5), prose(1, 2), '<p>All rights reserved.</p>' + links(1, 4)])}</{t}>")
    text = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{''.join(body)}" + rng.choice(["</body></html>", ""])
    return text, main


@functools.cache
def trained(pages: int = 1_800, epochs: int = 10, seed: int = 13) -> Network:
    """The network, trained on made-up pages; the same each time."""
    rng = random.Random(seed)
    data = []
    while len(data) < pages:
        source, main = page_maker(rng)
        page = leaves(source)
        y, k = np.zeros(len(page), np.float32), 0
        for j, leaf in enumerate(page):  # main blocks stand in the page's order
            if k < len(main) and leaf.text == main[k]:
                y[j], k = 1, k + 1
        if k == len(main) and page:
            data.append((vectors(page), y))
    net, step = Network(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for epoch in range(epochs):
        data.sort(key=lambda d: len(d[0]) + rng.random() * 6)
        batches = [data[i : i + 24] for i in range(0, len(data), 24)]
        rng.shuffle(batches)
        for some in batches:
            x, mask = padded([v for v, _ in some])
            y = np.zeros_like(mask)
            for k, (_, own) in enumerate(some):
                y[: len(own), k] = own
            g, _ = net.gradients(x, mask, y)
            step += 1
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v**2
                net.p[k] -= 0.012 * (0.9**epoch) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return net


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """A row for each page: its main text, blocks joined by a line break."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "html", 2 << 20):
                found = [leaves(h) if h else [] for h in part["html"].to_pylist()]
                text = ["\n".join(leaf.text for leaf, main in zip(page, own) if main) for page, own in zip(found, shared.value.label(found))]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, RESULT)
