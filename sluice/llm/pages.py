"""HTML extraction: a bidirectional LSTM labels the leaf blocks of a page as main text or not."""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sluice.llm.text import first_by_hash, short_batches

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe".split())
DROPPED = frozenset("svg template noscript".split())
BREAKS_SVG = frozenset(("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
                        "strong strike sub sup table tt u ul var").split())
SVG_HTML = frozenset("foreignobject desc title".split())
BLOCK = frozenset(("address article aside blockquote body button center caption dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
                   "tfoot th thead title tr ul br").split())
ENDS_P = BLOCK - {"br", "button", "label", "option", "optgroup", "title", "head", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "optgroup"}}

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_named = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_part = re.compile(r"[a-z]+")


@dataclass
class Leaf:
    """Text between two block boundaries: names of its path from the page down, text with plain spaces, share of it in links."""

    path: tuple[str, ...]
    text: str
    linked: float


def leaves(page: str) -> list[Leaf]:
    """The blocks of text of a page in order. Comments, scripts, styles, drawings and templates give none."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    in_link = dropped = 0
    links, at, end = 0, 0, len(page)

    def here() -> tuple[str, ...]:
        """Path of the text that is held: of the outermost dropped element if there is one."""
        top = next(i for i, x in enumerate(stack) if x[0] in DROPPED) if dropped else -1
        return stack[top][1] if stack else ()

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Leaf(here(), text, min(1.0, links / len(text))))
            held.clear()
        links = 0

    def take(piece: str) -> None:
        nonlocal links
        if piece and not dropped:
            if "&" in piece:
                piece = html.unescape(piece)
            held.append(piece)
            if in_link:
                links += len(piece)

    def cut(k: int) -> None:
        nonlocal in_link, dropped
        in_link -= sum(name == "a" for name, _ in stack[k:])
        if dropped:
            dropped -= sum(name in DROPPED for name, _ in stack[k:])
        del stack[k:]

    def pop_to(k: int) -> None:
        if not dropped or not any(name in DROPPED for name, _ in stack[:k + 1]):
            flush()
        cut(k)

    while at < end:
        found = _token.search(page, at)
        if found is None:
            take(page[at:])
            break
        take(page[at:found.start()])
        at = found.end()
        closing, name, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            if name in ("br", "p") and not any(n == name for n, _ in stack):
                if not dropped:
                    flush()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in BLOCK or any(n in BLOCK for n, _ in stack[k:]):
                        pop_to(k)
                    else:
                        cut(k)
                    break
                if name not in BLOCK and name not in DROPPED and stack[k][0] in BLOCK:
                    break  # an inline end does not close blocks
            continue
        if dropped and rest.rstrip().endswith("/"):
            continue
        if dropped and name in BREAKS_SVG:  # HTML inside an svg ends it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "svg":
                    cut(k)
                elif stack[k][0] in SVG_HTML or stack[k][0] in BLOCK or stack[k][0] in DROPPED:
                    break
        if name in RAW:
            close = re.compile(f"</{name}[\\s>/]", re.I).search(page, at)
            stop = page.find(">", close.start()) if close else -1
            at = end if stop < 0 else stop + 1
            continue
        if name in BLOCK and not dropped:
            flush()
        if name in VOID:
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in BLOCK or stack[k][0] in DROPPED:
                    break
        if name in SAME_ENDS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SAME_ENDS[name]:
                    pop_to(k)
                    break
                if stack[k][0] in HOLDS[name] or stack[k][0] in DROPPED:
                    break
        if rest.rstrip().endswith("/") and name not in BLOCK:
            continue
        path = stack[-1][1] if stack else ()
        if name in BLOCK:
            names = [name]
            if "=" in rest:
                for kind, a, b, c in _named.findall(rest):
                    names += [f".{w}" for w in _part.findall((a or b or c).lower())]
            path = path + tuple(names)
        if name == "a":
            in_link += 1
        dropped += name in DROPPED
        stack.append((name, path))
    flush()
    return out


PATH_BAG, NEAR_BAG, WORD_BAG = 64, 48, 24
NUMBERS = 12
WIDTH = PATH_BAG + NEAR_BAG + WORD_BAG + NUMBERS


class Buckets(dict):
    """Bucket of each token by its CRC, remembered up to a bound."""

    def __init__(self, n: int, salt: str, limit: int = 200_000):
        super().__init__()
        self.n, self.salt, self.limit = n, salt, limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[token] = bucket = zlib.crc32((self.salt + token).encode("utf-8", "replace")) % self.n
        return bucket


_path_bucket, _near_bucket, _word_bucket = Buckets(PATH_BAG, "path "), Buckets(NEAR_BAG, "near "), Buckets(WORD_BAG, "word ")
_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _paths:
        if len(_paths) > 20_000:
            _paths.clear()
        out = np.zeros(PATH_BAG + NEAR_BAG, np.float32)
        for name in path:
            if name not in ("html", "body"):
                out[_path_bucket[name]] = 1
        for name in path[-4:]:
            out[PATH_BAG + _near_bucket[name]] = 1
        _paths[path] = out
    return _paths[path]


def features(blocks: list[Leaf]) -> np.ndarray:
    """One row for each block: hashed names of its path and of the path's end, hashed words, and numbers."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    n = len(blocks)
    for k, leaf in enumerate(blocks):
        row, text = out[k], leaf.text
        row[:PATH_BAG + NEAR_BAG] = _path_vector(leaf.path)
        words = text.split(" ")
        bag = np.bincount([_word_bucket[w] for w in words], minlength=WORD_BAG)
        row[PATH_BAG + NEAR_BAG:-NUMBERS] = bag / math.sqrt(float(bag @ bag))
        chars = len(text)
        row[-NUMBERS:] = (math.log1p(chars) / 8, math.log1p(len(words)) / 6, leaf.linked, chars / len(words) / 10, text[-1] in ".!?:\"'”»",
                          "©" in text, (text.count(".") + text.count(",")) / len(words), text[0].isupper(), k / n, (n - k) / n, min(1.0, 5 / n),
                          len(leaf.path) / 10)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights of the two directions (input, recurrent, bias: gates in order input, forget, output, new) and of the output."""

    w: list[np.ndarray]

    @classmethod
    def new(cls, hidden: int, rng: np.random.Generator) -> Labeller:
        w = []
        for _ in range(2):
            bias = np.zeros(4 * hidden)
            bias[hidden:2 * hidden] = 1
            w += [rng.normal(0, 1 / math.sqrt(WIDTH), (WIDTH, 4 * hidden)), rng.normal(0, 1 / math.sqrt(hidden), (hidden, 4 * hidden)), bias]
        return cls([*w, rng.normal(0, 1 / math.sqrt(2 * hidden), 2 * hidden + WIDTH), np.zeros(1)])

    def _run(self, x: np.ndarray, live: np.ndarray, k: int, keep: list | None) -> np.ndarray:
        """Hidden states [time, page, hidden] of one direction; states stand still where a page has no block."""
        wx, wh, b = self.w[3 * k:3 * k + 3]
        size = wh.shape[0]
        into = x @ wx + b
        h = np.zeros((x.shape[1], size), x.dtype)
        c = h.copy()
        out = np.empty((x.shape[0], x.shape[1], size), x.dtype)
        for t in range(x.shape[0]) if k == 0 else range(x.shape[0] - 1, -1, -1):
            z = into[t] + h @ wh
            gates, new = _sigmoid(z[:, :3 * size]), np.tanh(z[:, 3 * size:])
            i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
            c2 = f * c + i * new
            shown = np.tanh(c2)
            on = live[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, new, shown, on))
            c = np.where(on, c2, c)
            h = np.where(on, o * shown, h)
            out[t] = h
        return out

    def chances(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probability that each block is main text, [time, page]."""
        both = np.concatenate([self._run(x, live, 0, None), self._run(x, live, 1, None), x], axis=2)
        return _sigmoid(both @ self.w[6] + self.w[7][0])

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean log loss over live blocks and its gradients, by backpropagation through time."""
        kept: list[list] = [[], []]
        both = np.concatenate([self._run(x, live, k, kept[k]) for k in (0, 1)] + [x], axis=2)
        p = _sigmoid(both @ self.w[6] + self.w[7][0])
        n = max(1, live.sum())
        loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * live).sum() / n
        d = (p - y) * live / n
        grads = [np.zeros_like(w) for w in self.w]
        grads[6], grads[7] = np.tensordot(d, both, axes=([0, 1], [0, 1])), np.array([d.sum()])
        size = self.w[1].shape[0]
        for k in (0, 1):
            wx, wh, _ = self.w[3 * k:3 * k + 3]
            back = d[:, :, None] * self.w[6][k * size:(k + 1) * size]
            dz_all = np.zeros((x.shape[0], x.shape[1], 4 * size))
            dh = np.zeros((x.shape[1], size))
            dc = dh.copy()
            for t, h, c, i, f, o, new, shown, on in reversed(kept[k]):
                dh = dh + back[t]
                here, dcc = np.where(on, dh, 0), np.where(on, dc, 0)
                dcc = dcc + here * o * (1 - shown ** 2)
                dz = np.concatenate([dcc * new * i * (1 - i), dcc * c * f * (1 - f), here * shown * o * (1 - o), dcc * i * (1 - new ** 2)], axis=1)
                dz_all[t] = dz
                grads[3 * k + 1] += h.T @ dz
                dh = np.where(on, dz @ wh.T, dh)
                dc = np.where(on, dcc * f, dc)
            grads[3 * k] = np.tensordot(x, dz_all, axes=([0, 1], [0, 1]))
            grads[3 * k + 2] = dz_all.sum(axis=(0, 1))
        return float(loss), grads


def padded(rows: list[np.ndarray], dtype=np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of pages side by side, [time, page, feature], and where there is a block."""
    longest = max(map(len, rows))
    x = np.zeros((longest, len(rows), WIDTH), dtype)
    live = np.zeros((longest, len(rows)), bool)
    for k, page in enumerate(rows):
        x[:len(page), k], live[:len(page), k] = page, True
    return x, live


def train(pages: list[tuple[np.ndarray, np.ndarray]], hidden: int = 16, rounds: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Labeller:
    """Fit by Adam on (features, labels) of pages; pages of like length share a batch. The same pages give the same weights."""
    rng = np.random.default_rng(seed)
    model = Labeller.new(hidden, rng)
    first, second = [np.zeros_like(w) for w in model.w], [np.zeros_like(w) for w in model.w]
    pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
    batches = [pages[k:k + batch] for k in range(0, len(pages), batch)]
    step, total = 0, rounds * len(batches)
    for _ in range(rounds):
        for b in rng.permutation(len(batches)):
            x, live = padded([f for f, _ in batches[b]], np.float64)
            y = np.zeros(live.shape)
            for k, (_, labels) in enumerate(batches[b]):
                y[:len(labels), k] = labels
            _, grads = model.gradients(x, live, y)
            norm = math.sqrt(sum(float((g ** 2).sum()) for g in grads))
            step += 1
            pace = rate * (1 - step / (total + 1)) * math.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for w, g, m, v in zip(model.w, grads, first, second):
                g = g * min(1.0, 5 / (norm + 1e-12))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= pace * m / (np.sqrt(v) + 1e-8)
    return Labeller([w.astype(np.float32) for w in model.w])


# Names that page makers give to parts of pages, for the layouts that training pages get.
MAIN_NAMES = "content main-content post post-content entry entry-content article article-body story story-body text body-text page-content blog-post news-text".split()
SIDE_NAMES = {
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs topnav toc pagination pager links".split(),
    "header": "header site-header masthead top-bar banner branding logo".split(),
    "footer": "footer site-footer copyright legal bottom colophon credits".split(),
    "aside": "sidebar side aside widget related related-posts recommended trending popular tags archive".split(),
    "notice": "cookie cookie-notice cookie-banner consent notice gdpr alert popup modal overlay newsletter subscribe".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense banner-ad".split(),
    "form": "form search search-form login signup contact-form newsletter-form".split(),
    "comments": "comments comment comment-list comment-body discussion replies respond user-comments".split(),
    "share": "share social social-share follow meta byline post-meta author-info".split(),
}
SHORT_WORDS = ("Home About Contact News Blog Login Register Search Menu Products Services Privacy Terms Help Archive Tags Share Facebook Twitter Subscribe Next Previous "
               "Read more All rights reserved Cookies Accept Advertisement Sponsored Comments Reply Related Popular Follow us Newsletter Sign up").split()


class Layouts:
    """Training pages: the main text of given pages in other layouts, among parts that are not main text."""

    def __init__(self, texts: list[str], seed: int = 5):
        self.texts, self.rng = texts, random.Random(seed)

    def _some(self, low: int, high: int) -> str:
        words = self.rng.choice(self.texts).split(" ")
        at = self.rng.randrange(len(words))
        return " ".join(words[at:at + self.rng.randint(low, high)]) or "x"

    def _short(self) -> str:
        return " ".join(self.rng.choice(SHORT_WORDS) for _ in range(self.rng.randint(1, 3))) if self.rng.random() < 0.5 else self._some(1, 3)

    def _names(self, kind: str) -> str:
        name = self.rng.choice(SIDE_NAMES[kind])
        other = f" {self.rng.choice(['box', 'wrap', 'inner', 'left', 'right', 'col', 'clearfix', 'block'])}" if self.rng.random() < 0.3 else ""
        return f' {self.rng.choice(["class", "class", "id"])}="{name}{other}"'

    def side(self, kind: str) -> str:
        """One part that is not main text."""
        r, rng = self.rng, html.escape
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section", "aside"],
               "ad": ["div", "aside", "section"], "form": ["form"], "comments": ["section", "div", "ol"], "share": ["div", "ul", "p"]}[kind]
        tag = r.choice(tag)
        names = self._names(kind) if tag in ("div", "ul", "ol", "section", "p") or r.random() < 0.5 else ""
        if kind in ("nav", "share") or (kind in ("aside", "footer") and r.random() < 0.5):
            links = "".join(f'<li><a href="/{k}">{rng(self._short())}</a></li>' if r.random() < 0.8 else f'<a href="/{k}">{rng(self._short())}</a> ' for k in range(r.randint(2, 8)))
            inner = links if tag in ("ul", "ol") else f"<ul>{links}</ul>"
            inner = (f"<h3>{rng(self._short())}</h3>" if r.random() < 0.3 else "") + inner
        elif kind == "footer":
            inner = rng(f"© {self._some(1, 3)} · {self._some(4, 14)}")
        elif kind == "form":
            inner = f'<label>{rng(self._short())}</label><input type="text"><select><option>{rng(self._short())}</option><option>{rng(self._short())}</option></select><button>{rng(self._short())}</button>'
            inner += f"<p>{rng(self._some(4, 20))}</p>" if r.random() < 0.5 else ""
        elif kind == "comments":
            item = lambda: f'<{"li" if tag == "ol" else "div"} class="comment"><p class="author">{rng(self._some(1, 2))}</p><p>{rng(self._some(3, 60))}</p></{"li" if tag == "ol" else "div"}>'
            inner = f"<h3>{rng(self._short())}</h3>" * (r.random() < 0.5) + "".join(item() for _ in range(r.randint(1, 5)))
        elif kind == "header":
            inner = f'<div class="logo"><a href="/">{rng(self._short())}</a></div><p>{rng(self._some(2, 8))}</p>' if r.random() < 0.7 else rng(self._some(1, 6))
        else:
            body = rng(self._some(3, 40))
            inner = f"<p>{body}</p>" if r.random() < 0.5 else body
            inner += f"<button>{rng(self._short())}</button>" if r.random() < 0.4 else ""
        return f"<{tag}{names}>{inner}</{tag}>"

    def page(self, paragraphs: list[str]) -> str:
        """A page around ``paragraphs``; in it, main text stands between marks that ``labelled`` removes."""
        r = self.rng
        tag = r.choice(["article", "article", "main", "div", "div", "section", "td"])
        names = f' {r.choice(["class", "id"])}="{r.choice(MAIN_NAMES)}"' if tag not in ("article", "main") or r.random() < 0.3 else ""
        body = []
        if r.random() < 0.7:
            body.append(f"<h1>\x02{html.escape(paragraphs[0][:60])}</h1>")
        leaf = r.choice(["p", "p", "p", "p", "div", "span-br"])
        for k, text in enumerate(paragraphs):
            shown = html.escape(text)
            if r.random() < 0.15:
                shown = f"<b>{shown}" + ("</b>" if r.random() < 0.6 else "<br>")
            elif r.random() < 0.15 and " " in text:
                a, _, b = text.partition(" ")
                shown = f'<a href="/x">{html.escape(a)}</a> {html.escape(b)}'
            own = r.choice(["h2", "blockquote", "li", "pre", "td"]) if r.random() < 0.12 else leaf
            if own == "li":
                body.append(f"<ul><li>\x02{shown}</li></ul>")
            elif own == "td":
                body.append(f"<table><tr><td>\x02{shown}</td></tr></table>")
            elif own == "span-br":
                body.append(f"<span>\x02{shown}</span><br>")
            else:
                body.append(f"<{own}>\x02{shown}" + (f"</{own}>" if own != "p" or r.random() < 0.8 else ""))
            if r.random() < 0.08:
                body.append(self.side(r.choice(["ad", "share", "aside", "form", "notice"])))
        if r.random() < 0.25:
            body.append(self.side(r.choice(["comments", "share", "aside"])))
        main = f"<{tag}{names}>{''.join(body)}</{tag}>"
        main = f"<table><tr>{main}</tr></table>" if tag == "td" else main
        if r.random() < 0.4:
            main = f'<div class="{r.choice(["wrapper", "container", "page", "row", "col", "layout"])}">{main}</div>'
        before = [self.side(r.choice(["nav", "nav", "header", "notice", "ad", "aside", "form"])) for _ in range(r.randint(0, 4))]
        after = [self.side(r.choice(["footer", "footer", "comments", "aside", "ad", "notice", "nav", "share", "form"])) for _ in range(r.randint(0, 5))]
        return f"<html><head><title>{html.escape(paragraphs[0][:60])}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


def labelled(page: str) -> tuple[list[Leaf], np.ndarray]:
    """The blocks of a training page and which of them are marked as main text."""
    blocks = leaves(page)
    labels = np.array(["\x02" in b.text for b in blocks], float)
    for b in blocks:
        b.text = b.text.replace("\x02", "") or "x"
    return blocks, labels


def teaching_pages(pages: list[str], layouts: int = 3, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of given pages and of ``layouts`` new layouts of each.

    Pages that name their main part (article or main, outside navigation and the like) teach as they are; the text
    of their blocks fills the new layouts, whose labels are known since we made them.
    """
    sides = {"nav", "header", "footer", "aside", "form", "head", "title", "button", "select"}
    known = [(b, np.array([bool({"article", "main"} & set(leaf.path)) and not sides & set(leaf.path) for leaf in b], float)) for b in map(leaves, pages)]
    known = [(b, y) for b, y in known if y.any()]
    bodies = [[leaf.text for leaf, main in zip(b, y) if main and not {"h1"} & set(leaf.path)] for b, y in known]
    bodies = [p for p in bodies if p]
    made = Layouts([" ".join(p) for p in bodies] or ["Some text of a page, to begin with. It has two sentences."], seed)
    fresh = [labelled(made.page(body[:40])) for _ in range(layouts) for body in bodies or [["Some text of a page, to begin with.", "It has two sentences."]]]
    return [(features(b), y) for b, y in known + fresh]


def fit_labeller(pages: DataFrame, sample: int = 240, layouts: int = 3, column: str = "html") -> Labeller:
    """Train on ``sample`` pages, the first in the order of a hash of their html; only these reach the driver.

    Pages longer than 200 000 characters teach nothing (they are still extracted whole). The same pages give the
    same weights.
    """
    given = pages.select(pages[column].cast("string").alias("html")).where("html is not null and length(html) between 1 and 200000")
    rows = first_by_hash(given, given.count(), sample, "html").toPandas()
    return train(teaching_pages(rows.html.tolist(), layouts))


def extract(page_batch: list[str], model: Labeller, cells: int = 1 << 15) -> list[str]:
    """Main text of each whole page; pages of like length are labelled together."""
    parsed = [leaves(p) for p in page_batch]
    out = [""] * len(parsed)
    order = sorted((k for k in range(len(parsed)) if parsed[k]), key=lambda k: len(parsed[k]))
    while order:
        some, longest = [], len(parsed[order[-1]])
        while order and (not some or (len(some) + 1) * longest <= cells):
            some.append(order.pop())
        x, live = padded([features(parsed[k]) for k in some])
        main = model.chances(x, live) >= 0.5
        for j, k in enumerate(some):
            out[k] = " ".join(leaf.text for leaf, keep in zip(parsed[k], main[:, j]) if keep)
    return out


def with_main_text(pages: DataFrame, model: Labeller, column: str = "html") -> DataFrame:
    """``pages`` with text (main text, empty if none) and n_chars (its code points).

    Character references are decoded, white space in a block becomes one space, blocks are joined in page order by
    one space, and nothing else is dropped or capped. Null html counts as empty. Columns named like the new ones are
    replaced. One pass without shuffle; the weights travel with the task.
    """
    short_batches(pages.sparkSession, 256)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series(extract(list(some), model), dtype=object)

    return (pages.withColumn("text", main_text(F.coalesce(pages[column].cast("string"), F.lit(""))))
                 .withColumn("n_chars", F.length("text").cast("long")))
