"""Operator 5: main text of web pages by a bidirectional LSTM over the blocks of a page."""

from __future__ import annotations

import html as _html
import re
import uuid
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy, word_hashes

#: Hashed features of tag paths and of words, and the length of one direction's state.
PATH = 2048
WORDS = 32
EXTRA = 6
HIDDEN = 16
#: Most pages that training reads, those of the smallest hashes.
TRAIN_PAGES = 240
EPOCHS = 14
#: Made-up pages that training reads in each epoch.
MADE_UP = 700
#: Pages that are parsed together, and steps x pages that are labelled together; a longer page is labelled piece by piece.
TOGETHER = 128
STEPS = 16_384
#: Steps x pages of one step of training; longer training pages are cut into pieces of so many blocks, all of them used.
TRAIN_STEPS = 2048
_workers: dict[str, "Labeller"] = {}

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. Without an end tag, the first two reach to the page's end and the others are ignored.
ENDLESS = frozenset(["script", "style"])
RAW_TAGS = ENDLESS | frozenset("noscript template title textarea iframe svg noembed noframes xmp".split())
#: A start or end tag whose attributes are written plainly; what doesn't match is read by _attributes.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>\s++[^\s"'<>/=]++(?:=(?:"[^"]*"|'[^']*'|[^\s"'<>=`/]++))?)*+)\s*+(/?)>""")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE_NAME = re.compile(r"[^\s/>][^\s/>=]*")
_ATTRIBUTE_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_BETWEEN = re.compile(r"[\s/]*")
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I | re.A) for t in RAW_TAGS}
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)=(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Za-z]+")
#: Of deeper nesting, end tags look at so many innermost elements, and paths name so many.
DEEP, NAMED = 256, 100


class Scanner:
    """The texts and tags of a page, in time that grows with its length.

    Tags, comments and attributes end where HTML says. What HTML would lose
    stays: a < that begins no tag, or that no > follows, is text; a quote that is
    never closed ends at the next space or >; if a tag would reach beyond the end
    of the page, it and all later ones end at their first >.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.endless: set[str] = set()
        self.plain = False

    def __iter__(self):
        """(text, tag, closing, attributes, empty): a text comes with tag None."""
        html, at = self.html, 0
        while at < len(html):
            begin = at
            at = html.find("<", at)
            while 0 <= at < self.last and not self._markup(at):
                at = html.find("<", at + 1)
            if at < 0 or at >= self.last:
                yield html[begin:], None, False, "", False
                return
            if at > begin:
                yield html[begin:at], None, False, "", False
            if html.startswith("<!--", at):
                if html.startswith((">", "->"), at + 4):
                    at = html.index(">", at) + 1
                else:
                    end = None if "comment" in self.endless else _COMMENT_END.search(html, at + 4)
                    if end is None:  # as much as one tag
                        self.endless.add("comment")
                    at = end.end() if end else html.index(">", at) + 1
                continue
            m = None if self.plain else _PLAIN.match(html, at)
            if m:
                closing, tag, attributes, empty = bool(m[1]), m[2].lower(), m[3], bool(m[4])
                at = m.end()
            elif m := _TAG_NAME.match(html, at + 1 + (html[at + 1] == "/")):
                closing, tag = html[at + 1] == "/", m[0].lower()
                attributes, at = self._attributes(m.end())
                empty = html[at - 2] == "/"
            else:  # a declaration, an instruction or an end tag without a name
                at = html.index(">", at) + 1
                continue
            yield "", tag, closing, attributes, empty
            if tag in RAW_TAGS and not closing and not (tag == "svg" and empty):
                at = self._end_of(tag, at)

    def _markup(self, at: int) -> bool:
        c = self.html[at + 1 : at + 2]
        if c == "/":
            c = self.html[at + 2 : at + 3]
            return c != "" and (c in "!?>" or c.isascii() and c.isalpha())
        return c != "" and (c in "!?" or c.isascii() and c.isalpha())

    def _attributes(self, at: int) -> tuple[str, int]:
        """The attributes from here on, written plainly, and where the tag ends."""
        html, begin, found = self.html, at, []
        while not self.plain:
            at = _BETWEEN.match(html, at).end()
            if at >= len(html):
                self.plain = True
                break
            if html[at] == ">":
                return " ".join(found), at + 1
            name = _ATTRIBUTE_NAME.match(html, at)
            at = name.end()
            equals = _ATTRIBUTE_EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at : at + 1]
                if quote in ('"', "'") and self.last_quote[quote] > at:
                    end = html.index(quote, at + 1)
                    value, at = html[at + 1 : end], end + 1
                else:
                    value = _UNQUOTED.match(html, at)[0]
                    at += len(value)
                found.append(f'{name[0]}="{value.replace(chr(34), " ")}"')
        end = html.find(">", begin)
        return " ".join(found), end + 1 if end >= 0 else len(html)

    def _end_of(self, tag: str, at: int) -> int:
        """Where the content of a raw element ends: after its end tag."""
        if tag in self.endless:
            return at
        found = _RAW_END[tag].search(self.html, at)
        if found:
            close = self.html.find(">", found.end() - 1)
            return close + 1 if close >= 0 else len(self.html)
        if tag in ENDLESS:
            return len(self.html)
        self.endless.add(tag)
        return at


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """The leaf blocks of a page in order: path tokens, text, share of the text inside links.

    A block ends where any block-level element begins or ends. References are
    decoded after the markup is taken out; white space becomes one space. Path
    tokens are the names of open elements and the words of their class, id and
    role, marked by the kind. Unclosed elements stay open until one around them
    closes; a paragraph or list item also ends at the next of its kind. Paths name
    the NAMED innermost elements, and an end tag closes one of the DEEP innermost.
    """
    if not html:
        return []
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((path, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def tokens() -> tuple[str, ...]:
        return tuple(t for _, own in stack[-NAMED:] for t in own)

    for piece, tag, closing, attributes, empty in Scanner(html):
        if tag is None:
            if not parts:
                path = tokens()
            parts.append(piece)
            if in_link:
                linked += len(piece)
            continue
        if tag == "br":
            if not parts:
                path = tokens()
            parts.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if closing:
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEP), -1):
                if stack[k][0] == tag:
                    if block or not any(t in BLOCK_TAGS for t, _ in stack[k:]):
                        in_link -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                    break
        elif tag not in VOID_TAGS and tag not in RAW_TAGS and not empty:
            if block:  # a paragraph ends where a block begins, an item where the next one does
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEP), -1):
                    if stack[k][0] == "p" or (tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[k][0] == tag):
                        in_link -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK_TAGS:
                        break
            own = [tag]
            if attributes:
                for kind, a, b, c in _ATTRIBUTE.findall(attributes):
                    own += [f"{kind.lower()[0]}:{w.lower()}" for w in _NAME.findall(a or b or c)]
            stack.append((tag, tuple(own)))
            in_link += tag == "a"
    flush()
    return out


def _slots(token: str, size: int) -> list[tuple[int, float]]:
    """Three signed places of a token, so that one which shares a place with another still differs from it."""
    data = token.encode()
    return [((h >> 1) % size, 1.0 if h & 1 else -1.0) for h in (zlib.crc32(data, salt) for salt in (0, 1, 2))]


class Features:
    """Vectors of blocks: hashed path tokens, hashed words of the whole text, and a few figures. Paths are remembered."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        if (v := self.paths.get(path)) is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            v = np.zeros(PATH, dtype=np.float32)
            for token in path:
                for i, sign in _slots(token, PATH):
                    v[i] += sign
            self.paths[path] = v = np.clip(v, -2, 2)
        return v

    def paths_of(self, every: list[tuple[tuple[str, ...], str, float]]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each different path, and which row is each block's."""
        rows: dict[tuple[str, ...], int] = {}
        index = np.array([rows.setdefault(path, len(rows)) for path, _, _ in every], dtype=np.int64)
        return np.stack([self._path(path) for path in rows]), index

    def said(self, every: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
        """What isn't the path: words and figures."""
        out = np.zeros((len(every), WORDS + EXTRA), dtype=np.float32)
        hashes, counts = word_hashes([text.encode() for _, text, _ in every])
        block = np.repeat(np.arange(len(every)), counts)
        sign = np.where((hashes >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
        words = np.bincount(block * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), sign, minlength=len(every) * WORDS).reshape(-1, WORDS)
        out[:, :WORDS] = np.clip(words / np.sqrt(counts + 1.0)[:, None], -1.5, 1.5)
        out[:, WORDS:] = [(0, min(2.0, len(text) ** 0.25 / 4), linked, text[-1:] in ".!?", text[:1].isupper(), 1.0) for _, text, linked in every]
        out[:, WORDS] = np.log1p(counts) / 4
        return out

    def __call__(self, pages: list[list[tuple[tuple[str, ...], str, float]]]) -> list[np.ndarray]:
        """Whole vectors, for training."""
        every = [b for page in pages for b in page]
        if not every:
            return [np.zeros((0, PATH + WORDS + EXTRA), dtype=np.float32) for _ in pages]
        rows, index = self.paths_of(every)
        out = np.concatenate((rows[index], self.said(every)), axis=1)
        return np.split(out, np.cumsum([len(p) for p in pages])[:-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block, in numpy."""

    SHAPES = {"wx": (2, PATH + WORDS + EXTRA, 4 * HIDDEN), "wh": (2, HIDDEN, 4 * HIDDEN), "b": (2, 4 * HIDDEN), "wo": (2 * HIDDEN,), "bo": (1,)}

    def __init__(self, parameters: dict[str, np.ndarray] | None = None, seed: int = 5):
        if parameters is None:
            rng = np.random.default_rng(seed)
            parameters = {k: rng.normal(0, 0.15, s).astype(np.float32) for k, s in self.SHAPES.items()}
            parameters["b"][:] = 0
            parameters["b"][:, HIDDEN : 2 * HIDDEN] = 1
            parameters["bo"][:] = 0
        self.p = parameters
        self.features = Features()

    def _direction(self, d: int, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction over (time, pages, features); padded steps carry the state on."""
        steps, pages, _ = x.shape
        pre = (x.reshape(steps * pages, -1) @ self.p["wx"][d]).reshape(steps, pages, -1) + self.p["b"][d]
        h = np.zeros((pages, HIDDEN), dtype=np.float32)
        c = np.zeros_like(h)
        out = np.empty((steps, pages, HIDDEN), dtype=np.float32)
        saved = []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = pre[t] + h @ self.p["wh"][d]
            gates = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            new_c = f * c + i * g
            th = np.tanh(new_c)
            m = mask[t][:, None]
            if keep:
                saved.append((t, h, c, i, f, o, g, th, m))
            h, c = np.where(m, o * th, h), np.where(m, new_c, c)
            out[t] = h
        return out, saved

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        ahead, saved0 = self._direction(0, x, mask, keep)
        back, saved1 = self._direction(1, x, mask, keep)
        both = np.concatenate((ahead, back), axis=2)
        return _sigmoid(both @ self.p["wo"] + self.p["bo"][0]), both, (saved0, saved1)

    def gradients(self, x, mask, y):
        p, both, saved = self.forward(x, mask, keep=True)
        dz = np.where(mask, p - y, 0).astype(np.float32) / max(1, mask.sum())
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["wo"] = np.einsum("tn,tnh->h", dz, both)
        grad["bo"] = np.array([dz.sum()], dtype=np.float32)
        d_both = dz[:, :, None] * self.p["wo"]
        for d in (0, 1):
            dh = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            dc = np.zeros_like(dh)
            into, before = np.empty((*mask.shape, 4 * HIDDEN), dtype=np.float32), np.empty((*mask.shape, HIDDEN), dtype=np.float32)
            for t, h, c, i, f, o, g, th, m in reversed(saved[d]):
                dh = dh + d_both[t, :, d * HIDDEN : (d + 1) * HIDDEN]
                live_h, live_c = np.where(m, dh, 0), np.where(m, dc, 0)
                d_c = live_c + live_h * o * (1 - th * th)
                da = np.concatenate((d_c * g * i * (1 - i), d_c * c * f * (1 - f), live_h * th * o * (1 - o), d_c * i * (1 - g * g)), axis=1)
                into[t], before[t] = da, h
                dh = np.where(m, da @ self.p["wh"][d].T, dh)
                dc = np.where(m, d_c * f, dc)
            into = into.reshape(-1, 4 * HIDDEN)
            grad["wx"][d] = x.reshape(len(into), -1).T @ into
            grad["wh"][d] = before.reshape(len(into), -1).T @ into
            grad["b"][d] = into.sum(axis=0)
        return grad, p

    def fit(self, pages: list[list], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 24, rate: float = 0.01, seed: int = 3, more: Callable[[int], tuple[list, list]] | None = None) -> "Labeller":
        """Adam over the pages, and in each epoch over those that more gives for its number."""
        known, known_labels = pages, labels
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for epoch in range(epochs):
            pace = rate * (1 - 0.9 * epoch / epochs)
            if more is not None:
                fresh = more(epoch)
                pages, labels = known + fresh[0], known_labels + fresh[1]
            order = sorted(rng.permutation(len(pages)).tolist(), key=lambda k: len(pages[k]))  # pages of like length together
            groups: list[list[int]] = []
            for k in reversed(order):  # vectors are made for one group at a time, of TRAIN_STEPS steps x pages at most
                if groups and len(groups[-1]) < min(batch, TRAIN_STEPS // len(pages[groups[-1][0]])):
                    groups[-1].append(k)
                else:
                    groups.append([k])
            for at in rng.permutation(len(groups)).tolist():
                x, mask = padded(self.features([pages[k] for k in groups[at]]))
                y = np.zeros(mask.shape, dtype=np.float32)
                for c, k in enumerate(groups[at]):
                    y[: len(labels[k]), c] = labels[k]
                grad, _ = self.gradients(x, mask, y)
                step += 1
                for k in self.p:
                    g = np.clip(grad[k], -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def predict(self, pages: list[list]) -> list[np.ndarray]:
        """The probability of each block of each page; pages of like length are run together, STEPS steps x pages at most."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: -len(pages[k]))
        while order:
            width = max(1, STEPS // len(pages[order[0]]))
            part, order = order[:width], order[width:]
            logits = self._run([pages[k] for k in part])
            for c, k in enumerate(part):
                out[k] = _sigmoid(logits[: len(pages[k]), c])
        return out

    def _run(self, pages: list[list]) -> np.ndarray:
        """Logits over (time, pages). Only the state goes from one piece of STEPS steps x pages to the next, so a long page takes no more memory."""
        steps, width = len(pages[0]), len(pages)
        size = max(1, STEPS // width)
        logits = np.full((steps, width), self.p["bo"][0], dtype=np.float32)
        for d in (0, 1):
            h = np.zeros((width, HIDDEN), dtype=np.float32)
            c = np.zeros_like(h)
            out = self.p["wo"][d * HIDDEN : (d + 1) * HIDDEN]
            pieces = range(0, steps, size)
            for at in pieces if d == 0 else reversed(pieces):
                here = [page[at : at + size] for page in pages]
                long = max(map(len, here))
                pre = np.zeros((long, width, 4 * HIDDEN), dtype=np.float32)
                mask = np.arange(long)[:, None] < np.array([len(x) for x in here])[None, :]
                every = [b for page in here for b in page]
                rows, index = self.features.paths_of(every)
                pre.transpose(1, 0, 2)[mask.T] = (rows @ self.p["wx"][d][:PATH])[index] + self.features.said(every) @ self.p["wx"][d][PATH:] + self.p["b"][d]
                for t in range(long) if d == 0 else range(long - 1, -1, -1):
                    a = pre[t] + h @ self.p["wh"][d]
                    gates = _sigmoid(a[:, : 3 * HIDDEN])
                    new_c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(a[:, 3 * HIDDEN :])
                    m = mask[t][:, None]
                    h, c = np.where(m, gates[:, 2 * HIDDEN :] * np.tanh(new_c), h), np.where(m, new_c, c)
                    logits[at + t] += h @ out
        return logits


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), PATH + WORDS + EXTRA), dtype=np.float32)
    mask = np.zeros((steps, len(pages)), dtype=bool)
    for c, p in enumerate(pages):
        x[: len(p), c] = p
        mask[: len(p), c] = True
    return x, mask


#: What a block's path says where it says it plainly; these label the training pages.
MAIN = frozenset(["article", "main", "r:main", "r:article", "i:articleBody".lower()])
ASIDE_TAGS = frozenset("nav footer aside form menu header dialog select button fieldset".split())
ASIDE_WORDS = frozenset("nav menu navbar breadcrumb breadcrumbs footer header banner sidebar side widget ad ads advert advertisement adverts sponsor sponsored promo promotion cookie cookies consent notice gdpr popup modal newsletter subscribe signup login search form comment comments reply replies disqus discussion respond related recommended share social toolbar copyright legal masthead".split())


def path_label(path: tuple[str, ...]) -> float:
    """1 inside an article without any element that is set apart, 0 otherwise."""
    inside = False
    for token in path:
        if token in MAIN:
            inside = True
        elif token in ASIDE_TAGS and not (inside and token == "header"):
            return 0.0
        elif token[1:2] == ":" and token[2:] in ASIDE_WORDS:
            return 0.0
    return float(inside)


#: Made-up training pages: what an article and what is around it may be called, and elements inside either.
MAIN_WORDS = "content post entry article story body text main page single blog news".split()
MAIN_PATHS = ["article", "article", "main", "main article", "main section", "div article", "section article", "r:main", "div c:", "div c:", "div c:"]
SIDE_TAGS = ["nav", "nav", "header", "header", "footer", "footer", "aside", "aside", "form", "menu", "dialog"]
BOXES = ["div", "div", "div", "section", "aside", "ul", "ol"]
INSIDE = ["p", "p", "p", "p", "ul li", "ol li", "h1", "h2", "h3", "ul li", "ul li", "ol li", "blockquote", "blockquote p", "pre", "table tr td", "div", "div p", "figure figcaption", "header h1", "section p", "section h2"]
IN_SIDE = ["", "", "p", "p", "ul li", "ul li", "h1", "h2", "h3", "h4", "li", "div", "div p", "label", "ol li", "span", "div div p", "a", "table tr td"]


def made_up(texts: list[str], pages: int, seed: int = 11) -> list[tuple[list, np.ndarray]]:
    """Training pages of other layouts: an article's blocks between menus, notices, adverts, forms, comments and footers.

    Each thing beside the article is one short block, some, or prose, in a landmark or
    in a box whose class or id tells what it is, before, after or in the article. Any
    element may have further names that mean nothing. On one page in six no box has a
    name that tells anything: there, prose is the article. Beside an article or main
    element, a box may have a meaningless name too.
    """
    rng = np.random.default_rng(seed)
    pick = lambda values: values[rng.integers(len(values))]
    told = sorted(ASIDE_WORDS)
    noise = lambda: pick("cir") + ":" + "".join(chr(97 + k) for k in rng.integers(0, 26, 1 + rng.integers(8)))

    def dressed(path: list[str]) -> list[str]:
        """The path with names without a meaning after some of its elements."""
        return [x for token in path for x in ([token, noise()] if rng.random() < 0.15 else [token])]

    def said(words: int) -> str:
        source = pick(texts).split()
        a = rng.integers(len(source))
        text = " ".join((source[a:] + source * (1 + words // len(source)))[:words])
        return text + "." if rng.random() < 0.4 and text[-1] not in ".!?" else text

    out = []
    for _ in range(pages if texts else 0):
        page, label = [], []
        plain = rng.random() < 1 / 6
        body = ["html", "body"] + (dressed(["div"]) + (["c:page"] if rng.random() < 0.3 else []) if rng.random() < 0.5 else [])

        def side(around: list[str]) -> None:
            if plain or (landmark and not around and rng.random() < 0.15):
                box = [pick(BOXES), noise()]
            elif rng.random() < 0.45:
                box = dressed([pick(SIDE_TAGS if not around else [t for t in SIDE_TAGS if t != "header"])])  # an article's own header is part of it
            else:
                box = [pick(BOXES)] + ([noise()] if rng.random() < 0.3 else []) + [pick("ciic") + ":" + pick(told)] + ([pick("ci") + ":" + pick(told)] if rng.random() < 0.3 else [])
            prose, linked = not plain and rng.random() < 0.35, rng.random() < 0.4
            inner = dressed(pick(IN_SIDE).split())
            for n in range(1 + rng.integers(5)):
                inside = dressed(pick(IN_SIDE).split()) if rng.random() < 0.2 else inner
                words = 8 + rng.integers(60) if prose and n != 1 else 1 + rng.integers(6)
                page.append((tuple(body + around + box + inside), said(words), float(linked)))
                label.append(0.0)

        if plain:
            main = ["div", noise()]
        else:
            main = pick(MAIN_PATHS).split()
            main = ["div", pick("ci") + ":" + pick(MAIN_WORDS)] if main[-1] == "c:" else ["div", *main] if main[0][1:2] == ":" else dressed(main)
            if rng.random() < 0.25:
                main = main + ["div", pick("ci") + ":" + pick(MAIN_WORDS)]
        landmark = "article" in main or "main" in main
        for _ in range(rng.integers(4)):
            side([])
        for n in range(1 + rng.integers(12)):
            words = 12 + rng.integers(70)
            if n and not plain and rng.random() < 0.45:  # headings and list items are short in articles too
                words = 1 + rng.integers(5)
            page.append((tuple(body + main + (["p"] if plain else dressed(pick(INSIDE).split()))), said(words), float(rng.random() < 0.05)))
            label.append(1.0)
            if not plain and rng.random() < 0.2:
                side(main)
        for _ in range(rng.integers(5)):
            side([])
        out.append((page, np.array(label, dtype=np.float32)))
    return out


def train(pages: list[str | None]) -> Labeller:
    """Fits the labeller on pages whose paths tell their labels, and on pages made up from their blocks, others in each epoch: it can't learn these by heart."""
    parsed = [b for b in map(blocks, pages) if b]
    known = [(b, np.array([path_label(p) for p, _, _ in b], dtype=np.float32)) for b in parsed]
    known = [(b, y) for b, y in known if y.any()]
    texts = [t for b, y in known for (_, t, _), v in zip(b, y) if v and t]
    texts = texts or ["Lorem ipsum dolor sit amet."]
    labeller = Labeller()

    def more(epoch: int) -> tuple[list, list]:
        made = made_up(texts, MADE_UP, epoch)
        return [b for b, _ in made], [y for _, y in made]

    pieces = [(b[at : at + TRAIN_STEPS], y[at : at + TRAIN_STEPS]) for b, y in known for at in range(0, len(b), TRAIN_STEPS)]
    return labeller.fit([b for b, _ in pieces], [y for _, y in pieces], more=more)


def extract(pages: DataFrame, training: DataFrame | None = None, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """One row per page: page_id, url, text (blocks of the article joined by an empty line), n_chars.

    The labeller is trained on at most train_pages whole pages (of an id's and
    url's several rows, the greatest html) and reads every block of every page. A null or empty html, and a page without main blocks, give an
    empty text. Repeated rows are extracted alike; a null id or url stays null;
    other columns are dropped.
    """
    import pyarrow as pa

    source = (pages if training is None else training).filter("html IS NOT NULL").select(F.col("html").cast("string").alias("html"), F.xxhash64("page_id", "url").alias("h"))
    # hashes are ranked alone, so that no task sends whole pages that aren't chosen
    chosen = source.select(F.col("h").alias("_h")).distinct().orderBy("_h").limit(train_pages)
    sample = source.join(F.broadcast(chosen), F.col("h") == F.col("_h")).groupBy("h").agg(F.max("html").alias("html"))
    labeller = train([r["html"] for r in sample.orderBy("h").collect()])  # at most train_pages pages
    shared = pages.sparkSession.sparkContext.broadcast(labeller.p)
    token = uuid.uuid4().hex

    def texts(batches):
        if token not in _workers:
            _workers.clear()
            _workers[token] = Labeller(shared.value)
        model = _workers[token]
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * TOGETHER):
                part = batch.slice(at, 4 * TOGETHER)
                parsed = [blocks(h) for h in part.column(2).to_pylist()]
                found = ["\n\n".join(t for (_, t, _), v in zip(b, p) if v > 0.5) for b, p in zip(parsed, model.predict(parsed))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(tidy(texts), "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract() of all pages."""
    return extract(table(spark, sf_dir, "pages"))
