"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

Blocks (``html_blocks``) have features of their ancestors' tags and attribute words and of their text. A chain of two
labels, main and other, is trained on labelled pages by gradient steps on the exact likelihood (forward-backward),
and each page is decoded by Viterbi. The labelled pages are made here from fixed seeds: articles among menus, headers,
sidebars, notices, adverts, forms, comments and footers, in many layouts.

Defined results: a null or empty page, and one without main blocks, has the empty text; rows that repeat are extracted alike;
an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, Element, attribute_words, leaf_blocks

PAGES, EPOCHS, BATCH, DECAY = 900, 12, 48, 1e-4

# Words of class, id and role attributes by what they hint at.
HINTS = {
    "main": "article post entry story content main text body prose hentry page blog single read",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs topnav toc pagination pager links",
    "head": "header head masthead topbar logo brand branding toolbar",
    "foot": "footer foot copyright legal colophon bottom imprint credits",
    "side": "sidebar side aside rail widget widgets related recommended popular trending more tags archive",
    "notice": "notice cookie cookies consent gdpr banner alert popup modal overlay newsletter subscribe signup paywall disclaimer message warning privacy",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promoted promotion dfp adsense banner outbrain taboola commercial",
    "form": "form search login signin register contact input field poll survey",
    "comment": "comment comments reply replies respond discussion discuss disqus thread reader readers responses feedback",
    "share": "share sharing social follow twitter facebook like print",
    "hidden": "hidden",
}
HINT_OF = {w: g for g in reversed(HINTS) for w in HINTS[g].split()}
# Words of texts that are seldom part of an article.
PHRASES = ("cookie", "subscribe", "newsletter", "advert", "sponsored", "comment", "reply", "log in", "sign in", "sign up", "all rights reserved", "privacy", "share this", "read more", "©", "copyright", "menu", "search", "posted by")


class _Seen:
    """What the open elements say from an element outwards; an element that adds nothing shares its parent's set."""

    __slots__ = ("inside", "near", "names")

    def __init__(self, element: Element, above: "_Seen | None") -> None:
        tag, attributes = element.tag, element.attributes
        inside, near = (above.inside, above.near) if above else (frozenset(), ("near=-",))
        groups = {HINT_OF[w] for w in attribute_words(attributes) if w in HINT_OF} if attributes else set()
        own = {f"hint={g}" for g in groups}
        if tag not in ("html", "body", "div", "section"):
            own.add(f"in={tag}")
        if not own <= inside:
            inside = inside | own
        if groups or tag in ("article", "main", "nav", "aside", "footer", "header", "form"):
            near = (*sorted(f"near={g}" for g in groups), f"near={tag}")
        self.inside, self.near = inside, near
        self.names = _names(tag, inside, near)


@lru_cache(maxsize=10_000)
def _names(tag: str, inside: frozenset, near: tuple) -> tuple[str, ...]:
    return tuple(sorted({f"tag={tag}", *inside, *near}))


_NOWHERE = ("near=-", "tag=-")


def path_features(element: Element | tuple) -> tuple[str, ...]:
    """Features of all elements around a block; each element's are worked out once."""
    if not element:
        return _NOWHERE
    todo = []
    while element is not None and element.features is None:
        todo.append(element)
        element = element.parent
    found = element.features if element is not None else None
    for e in reversed(todo):
        found = e.features = _Seen(e, found)
    return found.names


def text_features(block: Block) -> list[str]:
    t = block.text
    n = t.count(" ") + 1
    out = ["bias", f"words={0 if n < 3 else 1 if n < 8 else 2 if n < 20 else 3 if n < 50 else 4}", f"linked={min(3, int(block.linked * 3.01))}"]
    if t[-1] in ".!?…:;\"":
        out.append("stop")
    if "," in t:
        out.append("comma")
    low = t.lower()
    out += [f"says={p}" for p in PHRASES if p in low]
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Features of each block; neighbours count through the chain."""
    out, titled = [], False
    for b in blocks:
        titled = titled or bool(b.path) and b.path.tag == "h1"
        out.append([*path_features(b.path), *text_features(b), "titled" if titled else "untitled"])
    return out


class Chain:
    """A linear-chain conditional random field with labels 0 (other) and 1 (main)."""

    def __init__(self, names: list[str]) -> None:
        self.index = {f: i for i, f in enumerate(names)}
        self.w = np.zeros((len(names), 2))
        self.step = np.zeros((2, 2))
        self.start = np.zeros(2)

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        get, w = self.index.get, self.w.tolist()
        out = np.zeros((len(rows), 2))
        for i, row in enumerate(rows):
            known = [w[k] for f in row if (k := get(f)) is not None]
            out[i] = sum(a for a, _ in known), sum(b for _, b in known)
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not rows:
            return []
        (a00, a01), (a10, a11) = self.step.tolist()
        e = self.emissions(rows).tolist()
        v0, v1, back = self.start[0] + e[0][0], self.start[1] + e[0][1], []
        for e0, e1 in e[1:]:
            x0, x1, y0, y1 = v0 + a00, v1 + a10, v0 + a01, v1 + a11
            back.append((x1 > x0, y1 > y0))
            v0, v1 = max(x0, x1) + e0, max(y0, y1) + e1
        label = int(v1 > v0)
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]]) -> None:
        """Adam steps on the mean negative log-likelihood of padded batches of pages."""
        longest = max(len(y) for _, y in pages)
        x = np.zeros((len(pages), longest, len(self.index)), np.float32)
        y = np.zeros((len(pages), longest), np.int64)
        size = np.array([len(labels) for _, labels in pages])
        for i, (rows, labels) in enumerate(pages):
            y[i, : len(labels)] = labels
            for k, row in enumerate(rows):
                x[i, k, [self.index[f] for f in row]] = 1
        mask = np.arange(longest)[None] < size[:, None]
        params, rng, t = [self.w, self.step, self.start], np.random.default_rng(5), 0
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(EPOCHS):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                grads = self._gradient(x[part], y[part], mask[part])
                t += 1
                for k, (p, g) in enumerate(zip(params, grads)):
                    g = g + DECAY * p
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    p -= 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def _gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected minus observed counts of features, steps and starts, by forward-backward."""
        n, longest = y.shape
        e = x @ self.w
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = self.start + e[:, 0]
        for k in range(1, longest):
            a = np.logaddexp(alpha[:, k - 1, 0, None] + self.step[0], alpha[:, k - 1, 1, None] + self.step[1]) + e[:, k]
            alpha[:, k] = np.where(mask[:, k, None], a, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            z = e[:, k + 1] + beta[:, k + 1]
            b = np.logaddexp(z[:, 0, None] + self.step[:, 0], z[:, 1, None] + self.step[:, 1])
            beta[:, k] = np.where(mask[:, k + 1, None], b, 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        delta = p - np.eye(2)[y] * mask[:, :, None]
        both = mask[:, 1:]
        pair = np.exp(alpha[:, :-1, :, None] + self.step + (e + beta)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        return np.einsum("nkf,nkl->fl", x, delta) / n, (pair.sum((0, 1)) - seen) / n, delta[:, 0].sum(0) / n


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A made page and the texts of its main blocks."""
    stems = [s.split() for s in ("an er in the ou re tion ing sh th ly ble of and to", "que la de eau ou ai é è ment eux le et les", "sch ung keit der und die ein ich zu be ß", "ción do rr ga ue el los que de la ñ")]
    own, other = rng.choice(stems), rng.choice(stems)
    odd = rng.choice(["", "", "", "", "###", "&&&", "!!"])
    main: list[str] = []

    def words(n: int, stem=None) -> str:
        out = ["".join(rng.choice(stem or own) for _ in range(rng.randint(1, 4))) for _ in range(n)]
        out = [w + rng.choice(["", "", "", "", ",", "."]) for w in out]
        text = " ".join(out).capitalize()
        return " ".join(w + odd for w in text.split()) if odd and stem is None else text + rng.choice([".", ".", ""])

    def shown(text: str) -> str:
        text = html.escape(text, quote=False)
        if rng.random() < 0.3 and " " in text:
            head, tail = text.split(" ", 1)
            tag = rng.choice(["b", "i", "em", "strong", "span", "a"])
            text = f"<{tag}>{head}</{tag}> {tail}"
        return text

    def para() -> str:
        text = words(rng.choice([1, 2, 3, 6, 12, 25, 40, 70]))
        main.append(text)
        return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br>", "<blockquote>{}</blockquote>"]).format(shown(text))

    def listing() -> str:
        items = [words(rng.randint(2, 14)) for _ in range(rng.randint(2, 4))]
        main.extend(items)
        return "<ul>" + "".join(f"<li>{shown(i)}</li>" for i in items) + "</ul>"

    def title(tag: str) -> str:
        text = words(rng.randint(1, 14))
        main.append(text)
        return f"<{tag}>{html.escape(text, quote=False)}</{tag}>"

    def cls(group: str) -> str:
        word = rng.choice(HINTS[group].split())
        return rng.choice([f'class="{word}"', f'id="{word}"', f'class="{word}-{rng.choice(["box", "wrap", "area", "x1"])}"', f"class='block {word}'"])

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(rng.randint(1, 2), other)}</a></li>' for i in range(rng.randint(2, 7))) + "</ul>"

    def prose(low: int = 3, high: int = 20) -> str:
        stem = rng.choice([own, other])
        return html.escape(words(rng.randint(low, high), stem), quote=False)

    def noise(kind: str) -> str:
        wrap = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "notice": "div", "advert": "div", "comment": "section", "share": "div"}[kind]
        tag, attributes = wrap, ""
        if rng.random() < 0.5 or wrap in ("div", "section"):
            tag, attributes = rng.choice([wrap, "div", "div", "section"]), " " + cls(kind)
        if kind in ("notice", "advert") and rng.random() < 0.1:
            tag = "aside"
        body = {
            "menu": links,
            "head": lambda: rng.choice([f"<div>{words(2, other)}</div>", f"<p>{prose(2, 9)}</p>", links()]) + rng.choice(["", links()]),
            "foot": lambda: rng.choice(["&copy; ", "", "&#169; 20{} ".format(rng.randint(10, 30))]) + rng.choice(["example.com &middot; ", ""]) + prose(),
            "side": lambda: f"<h3>{words(2, other)}</h3>" + rng.choice([links(), f"<p>{prose()}</p>"]),
            "form": lambda: f"<label>{words(2, other)}</label><input name='q'><button>{words(1, other)}</button>" + rng.choice(["", f"<p>{prose(3, 9)}</p>"]),
            "notice": lambda: rng.choice(["", "We use cookies. ", "Subscribe to our newsletter. "]) + prose() + rng.choice(["", " <button>OK</button>"]),
            "advert": lambda: rng.choice(["", "Advertisement ", "Sponsored "]) + rng.choice([prose(), f"<p>{prose()}</p>", f'<a href="#">{prose()}</a>']),
            "comment": lambda: f"<h3>{rng.choice(['Comments', words(1, other)])}</h3>" + "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>"]).format(prose(2, 40)) for _ in range(rng.randint(1, 4))),
            "share": lambda: rng.choice(["Share this ", ""]) + links(),
        }[kind]()
        return f"<{tag}{attributes}>{body}</{tag}>"

    inside = []
    for k in range(rng.randint(1, 9)):
        inside.append(rng.choices([para, listing, lambda: title("h2")], [10, 1, 1])[0]())
        if rng.random() < 0.12:
            inside.append(noise(rng.choice(["advert", "side", "notice", "share", "form"])))
    heading = ""
    if rng.random() < 0.85:
        rest, main[:] = list(main), []
        heading = title("h1")
        main += rest
    if rng.random() < 0.15:
        inside.append(noise("comment"))
    around = rng.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), (f"<div {cls('main')}>", "</div>"), (f"<div {cls('main')}>", "</div>"), ("<div>", "</div>"), ("<section>", "</section>"), (f"<main><article {cls('main')}>", "</article></main>")])
    before = [noise(k) for k in rng.sample(["menu", "head", "advert", "notice", "form", "side", "share"], rng.randint(0, 4))]
    after = [noise(k) for k in rng.sample(["side", "comment", "advert", "form", "menu", "share"], rng.randint(0, 3))]
    if rng.random() < 0.8:
        after.append(noise("foot"))
    body = "".join(before) + around[0] + heading + "".join(inside) + around[1] + "".join(after)
    if rng.random() < 0.3:
        body = f"<div {rng.choice(['id=page', 'class=wrapper', 'class=container'])}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{body}</body></html>", main


def labelled_pages(n: int, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of made pages: a block is main if it is the next text of the article."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        page, main = labelled_page(rng)
        blocks, labels, at = leaf_blocks(page), [], 0
        for b in blocks:
            hit = at < len(main) and b.text == " ".join(main[at].split())
            labels.append(int(hit))
            at += hit
        if at == len(main):
            out.append((features(blocks), labels))
    return out


@lru_cache(maxsize=1)
def train(pages: int = PAGES) -> Chain:
    rows = labelled_pages(pages, 1)
    chain = Chain(sorted({f for page, _ in rows for row in page for f in row}))
    chain.fit(rows)
    return chain


def main_blocks(page: str | None, chain: Chain) -> list[str]:
    blocks = leaf_blocks(page or "")
    return [b.text for b, label in zip(blocks, chain.decode(features(blocks))) if label]


def extract(pages: DataFrame, chain: Chain, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row."""
    shared = pages.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in batches:
            texts = ["\n".join(main_blocks(t.as_py(), shared.value)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [source.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return source.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
