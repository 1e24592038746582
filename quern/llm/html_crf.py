"""Main text of web pages: a linear-chain conditional random field over the page's leaf blocks.

A page is read once into leaf blocks (runs of text with no block-level tag inside) in page order.
Each has features of its ancestors' tags and class or id words and of its text; the field scores
labels by them and by neighbouring labels, and Viterbi decoding picks the article's blocks. The
field is trained on labelled pages; ``labelled_pages`` writes such pages in many layouts.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"(?:\b(?:class|id|role))\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg textarea".split())
#: Tags that end an open tag of the same group by starting.
IMPLIED = {"li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def _words(attributes: str) -> set[str]:
    if "=" not in attributes:
        return set()
    return {"c:" + w for m in ATTRIBUTE.finditer(attributes) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower())}


def blocks(page: str) -> list[tuple[str, list[str]]]:
    """(text, features) of the page's leaf blocks that have text, in order. Scripts, styles, comments
    and markup give none; character references are decoded; white space becomes one space."""
    out: list[tuple[str, list[str]]] = []
    stack: list[tuple[str, set[str]]] = []
    above: dict[str, int] = {}  # features of the open elements, with the number that have them
    places: list[int] = []  # where in the stack block-level elements are
    tags: dict[str, int] = {}  # open elements by tag
    text: list[str] = []
    linked = link = 0

    def push(tag: str, attributes: str) -> None:
        own = _words(attributes) | {"a:" + tag}
        if tag in BLOCKS:
            places.append(len(stack))
        stack.append((tag, own))
        tags[tag] = tags.get(tag, 0) + 1
        for f in own:
            above[f] = above.get(f, 0) + 1

    def pop() -> str:
        tag, own = stack.pop()
        tags[tag] -= 1
        if places and places[-1] == len(stack):
            places.pop()
        for f in own:
            above[f] -= 1
            if not above[f]:
                del above[f]
        return tag

    def close() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                tag = next((t for t, _ in reversed(stack) if t in BLOCKS), "")
                out.append((whole, [*above, "t:" + tag, *_of_text(whole, linked)]))
            text.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if not (len(piece) > 1 and piece[0] == "<"):
                text.append(piece)
                if link:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                close()
            if tags.get(tag):  # all that is open inside ends too, however deep
                while (ended := pop()) != tag:
                    link -= ended == "a"
                link -= tag == "a"
            continue
        if tag in RAW:
            shut = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        if tag in BLOCKS:
            close()
            ended = IMPLIED.get(tag) or ({"p"} if tag != "p" else {"p"})
            # All such tags are block-level, so the innermost blocks tell it.
            while places and stack[places[-1]][0] in ended:
                for _ in range(len(stack) - places[-1]):
                    link -= pop() == "a"
        if tag == "br":
            text.append(" ")
        if tag not in VOID and not m[3].endswith("/"):
            push(tag, m[3])
            link += tag == "a"
    close()
    return out


def _of_text(text: str, linked: int) -> list[str]:
    n = len(text)
    words = text.count(" ") + 1
    out = ["1", f"n{min(7, n.bit_length() // 1 - 2 if n > 3 else 0)}", f"w{min(6, words.bit_length())}", f"l{min(4, 4 * linked // n)}"]
    if text[-1] in ".!?…\"”":
        out.append("end")
    if text.count(",") + text.count(".") > 1:
        out.append("stops")
    if "©" in text:
        out.append("copyright")
    if "|" in text or "»" in text:
        out.append("bar")
    return out


class Field:
    """Weights of features and of neighbouring labels (0: other, 1: article)."""

    def __init__(self, features: list[str]):
        self.at = {f: i for i, f in enumerate(features)}
        self.w = np.zeros((len(features) + 1, 2))  # the last row is for places after a page's end
        self.next = np.zeros((2, 2))
        self.first = np.zeros(2)

    def train(self, pages: list[list[tuple[list[str], int]]], rounds: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> None:
        """Adam on the mean log-likelihood; forward and backward sums over all pages at once."""
        n, steps = len(pages), max(len(p) for p in pages)
        x = np.zeros((n * steps, len(self.at)), np.float32)
        y = np.full((n, steps), -1)
        for i, page in enumerate(pages):
            for t, (features, label) in enumerate(page):
                x[i * steps + t, [self.at[f] for f in features if f in self.at]] = 1
                y[i, t] = label
        real = y >= 0
        total = real.sum()
        parameters = [self.w[:-1], self.next, self.first]
        m, v = ([np.zeros_like(p) for p in parameters] for _ in (0, 1))
        for s in range(1, rounds + 1):
            u = (x @ self.w[:-1]).reshape(n, steps, 2)
            a, b = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
            a[:, 0] = self.first + u[:, 0]
            for t in range(1, steps):
                step = np.logaddexp.reduce(a[:, t - 1, :, None] + self.next, axis=1) + u[:, t]
                a[:, t] = np.where(real[:, t, None], step, a[:, t - 1])
            for t in reversed(range(steps - 1)):
                step = np.logaddexp.reduce(self.next + (u[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
                b[:, t] = np.where(real[:, t + 1, None], step, 0)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + b - z[:, None, None]) * real[..., None]
            gold = (y[..., None] == np.arange(2)) & real[..., None]
            both = real[:, 1:]
            pair = np.exp(a[:, :-1, :, None] + self.next + (u[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
            seen = (gold[:, :-1, :, None] & gold[:, 1:, None, :]).sum((0, 1))
            g = [x.T @ (gold - p).reshape(-1, 2) / total - ridge * self.w[:-1], (seen - pair.sum((0, 1))) / total, (gold[:, 0] - p[:, 0]).sum(0) / total]
            for k, own in enumerate(parameters):
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                own += rate * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)

    def decode(self, features: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi; equal scores go to label 0."""
        w = self.gains
        (n00, n01), (n10, n11) = self.next.tolist()
        back, s0, s1 = [], 0.0, 0.0
        for t, own in enumerate(features):
            u0 = u1 = 0.0
            for f in own:
                g = w.get(f)
                if g:
                    u0 += g[0]
                    u1 += g[1]
            if t:
                from0, from1 = s1 + n10 > s0 + n00, s1 + n11 > s0 + n01
                back.append((from0, from1))
                s0, s1 = (s1 + n10 if from0 else s0 + n00) + u0, (s1 + n11 if from1 else s0 + n01) + u1
            else:
                s0, s1 = self.first[0] + u0, self.first[1] + u1
        out = [int(s1 > s0)] if features else []
        for pointers in reversed(back):
            out.append(int(pointers[out[-1]]))
        return out[::-1]

    @property
    def gains(self) -> dict[str, tuple[float, float]]:
        if not hasattr(self, "_gains"):
            self._gains = {f: tuple(self.w[i].tolist()) for f, i in self.at.items()}
        return self._gains

    def extract(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n".join(text for (text, _), keep in zip(found, self.decode([f for _, f in found])) if keep)


def labelled_pages(n: int = 400, seed: int = 11) -> Iterator[list[tuple[list[str], int]]]:
    """Pages in many layouts, as blocks with labels: 1 for the article's heading and paragraphs.

    A marker in front of the text carries the label through the reader and is taken off again.
    """
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g l m n p r s t v".split() for b in "a e i o u an er on".split()]

    def sentence(low: int, high: int) -> str:
        s = " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(r.randint(low, high)))
        return s.capitalize() + r.choice(["."] * 8 + ["!", "?", "", ","])

    def prose(k: int) -> str:
        return " ".join(sentence(1, 14) for _ in range(k))

    def items(k: int, wrap: str = "li") -> str:
        return "".join(f"<{wrap}><a href='/{i}'>\x00{''.join(r.choices(syllables, k=r.randint(1, 4)))}</a></{wrap}>" for i in range(k))

    def other(low: int = 1, high: int = 3) -> str:
        return "\x00" + prose(r.randint(low, high))

    def box(names: str, tags: str = "div section aside") -> str:
        name, tag = r.choice(names.split()), r.choice(tags.split())
        how = r.choice(("class", "id"))
        inside = r.choice((other(), f"<p>{other()}</p>", f"<p>{other()}</p><p>{other()}</p>", f"<ul>{items(4)}</ul>", f"<h3>{other(1, 1)}</h3><p>{other()}</p>"))
        return f'<{tag} {how}="{name}">{inside}</{tag}>'

    adverts, notices = "ad ads advert advertisement sponsored promo banner ad-box", "cookie-notice cookie-banner notice alert gdpr consent"
    sides, replies = "sidebar side related widget recommended rail", "comments comment-list comment replies discussion responses"

    def paragraph() -> str:
        body = "\x01" + prose(r.choice((1, 1, 1, 2, 3, 5, 8)))
        if r.random() < 0.15:
            words = body.split(" ")
            i = r.randrange(len(words))
            words[i] = r.choice(("<a href='/x'>{}</a>", "<b>{}</b>", "<em>{}</em>")).format(words[i]) if i else words[i]
            body = " ".join(words)
        tag = r.choice(["p"] * 9 + ["h2", "blockquote", "li", "div"])
        return f"<{tag}>{body}" + ("" if tag == "p" and r.random() < 0.4 else f"</{tag}>")

    for _ in range(n):
        top = [r.choice(("", f"<header><h2>{other(1, 1)}</h2></header>", f"<header class='site-header'><a href='/'>{other(1, 1)}</a><p>{other(1, 1)}</p></header>", f"<div id='header'>{other(1, 1)}</div>"))]
        top.append(r.choice((f"<nav><ul>{items(r.randint(2, 9))}</ul></nav>", f"<div class='{r.choice(('menu', 'nav', 'navbar', 'topnav'))}'>{items(r.randint(2, 9), 'div')}</div>", f"<ul class='menu'>{items(5)}</ul>", "")))
        extra = [box(adverts), box(notices), box(sides), f"<form action='/s'><label>{other(1, 1)}</label><button>\x00Go</button></form>", f"<aside>{other()}</aside>"]
        top += r.sample(extra, r.randint(0, 3))
        r.shuffle(top)
        body = [f"<h1>\x01{sentence(3, 12)}</h1>"] * (r.random() < 0.85) + [paragraph() for _ in range(r.choice((0, 1, 2, 3, 5, 8, 13, 20)))]
        if r.random() < 0.25 and len(body) > 2:
            body.insert(r.randint(1, len(body)), r.choice((box(adverts), box("related newsletter share social", "div aside"))))
        if r.random() < 0.15:
            body.append(f"<section class='{r.choice(replies.split())}'><p>{other()}</p><p>{other()}</p></section>")
        open_, shut = r.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article class='post'>", "</article></main>"), ("<div class='post-content'>", "</div>"), ("<div id='content'>", "</div>"), ("<div class='article-body entry'>", "</div>"), ("<section class='story'>", "</section>")])
        low = [box(replies, "div section"), box(sides), box(adverts), f"<form>{other(1, 1)}<button>\x00Send</button></form>", f"<aside>{other()}</aside>"]
        low = r.sample(low, r.randint(0, 3))
        foot = r.choice((f"<footer>\x00&copy; {prose(1)}</footer>", f"<footer><p>{other()}</p><ul>{items(3)}</ul></footer>", f"<div class='footer'>\x00&copy; {prose(2)}</div>", ""))
        page = f"<html><head><title>\x00{prose(1)}</title><style>p{{}}</style></head><body>{''.join(top)}{open_}{''.join(body)}{shut}{''.join(low)}{foot}</body></html>"
        rows = []
        for text, features in blocks(page):
            label = int("\x01" in text)
            bare = text.replace("\x00", "").replace("\x01", "")
            if bare:
                rows.append(([f for f in features if f[:2] in ("a:", "c:", "t:")] + _of_text(bare, len(bare) if any(f in ("l3", "l4") for f in features) else 0), label))
        if rows:
            yield rows


def train(pages: list[list[tuple[list[str], int]]]) -> Field:
    field = Field(sorted({f for page in pages for own, _ in page for f in own}))
    field.train(pages)
    return field


def main_text(df: DataFrame, page: str, column: str = "text", field: Field | None = None) -> DataFrame:
    """``df`` with the main text of each whole page: the article's blocks, one a line.

    A null page is an empty one; a page without an article has an empty text. Rows stay as they are,
    repeated ones included; a column of that name is replaced. Without ``field``, one is trained on
    ``labelled_pages()``; its size does not depend on the input.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(field or train(list(labelled_pages())))

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sent.value.extract(batch[i].as_py()) for i in range(len(batch))], pa.string())

    return df.withColumn(column, extract(F.col(page).cast("string")))
