"""Main text of web pages by a recurrent block labeller.

A page is cut to leaf blocks: the text between two borders of block-level elements, with the path of open elements and
their classes. Each block is a vector of hashed path names, hashed words and a few sizes; a bidirectional LSTM in numpy
reads all blocks of the page in order and labels each as text or not, so a label depends on the whole page. The weights
are fitted here on generated pages (``fit``), in seconds, always the same. Markup, comments, scripts and styles are no
blocks at all; the text of formulas, drawings and fallback elements is text like any other.

Null and empty pages give empty text. Long pages are read whole. Unclosed and stray tags are tolerated: a block-level tag
closes an open paragraph, an end tag closes what is open inside it, and one that fits nothing is dropped. The input's
columns are kept, those named like an added one are replaced; repeated rows are labelled each.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Sizes of the vectors and of the hidden state in each direction.
PATHS, WORDS, SIZES, HIDDEN = 160, 32, 8, 16
INPUTS = PATHS + WORDS + SIZES

#: A tag's name, and one attribute: its name and its value in either quotes or bare, where a quote is a character like any other.
TAG = re.compile(r"</?[A-Za-z][^\s/>]*+")
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
REST = re.compile(r"[\s/]*+")
#: Elements whose content is no markup, and how they end.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}
NAME = re.compile(r"[A-Za-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math svg object canvas iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of other kinds of markup, within which every tag is inline, and those that are empty if they end in a slash.
FOREIGN, EMPTY = ("math", "svg"), frozenset("math svg object canvas iframe noscript template".split())
#: Block-level elements that end foreign markup, and all that can stand in a head: another one ends the head.
BREAKS = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr img li menu ol p pre table ul article aside footer header main nav section".split())
HEAD = frozenset("html head title base link meta template noscript bgsound basefont noframes".split())
#: An element closes these when it opens, up to the nearest of its containers.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("td", ("tr",)), "option": ("option", ("select",)), "body": ("head", ())}


def markup(html: str) -> Iterator[tuple[int, int, str, bool, str, bool]]:
    """(start, end, name, whether an end tag, names in its class, id and role, whether it ends in a slash) of every tag in
    order; name is empty for comments, declarations, and the content of RAW elements.

    One pass: a comment, a RAW element or a tag that is never closed goes to the end of the page, as in browsers.
    """
    n, at = len(html), html.find("<")
    while at >= 0:
        m = TAG.match(html, at)
        if m is None:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 2)
                end = n if end < 0 else end + 3
            elif html.startswith(("<!", "<?", "</"), at):
                end = html.find(">", at)
                end = n if end < 0 else end + 1
            else:  # a character of the text
                at = html.find("<", at + 1)
                continue
            yield at, end, "", False, "", False
        else:
            closing = html[at + 1] == "/"
            name = m[0][1 + closing :].lower()
            end, classes = m.end(), []
            while a := ATTRIBUTE.match(html, end):
                end = a.end()
                if a[1].lower() in ("class", "id", "role"):
                    classes.append(a[2] or a[3] or a[4] or "")
            end = REST.match(html, end).end()
            slash = html[end - 1] == "/"
            end = min(n, end + 1)
            yield at, end, name, closing, " ".join(classes), slash
            if name in RAW and not closing:
                m = RAW[name].search(html, end)
                stop = m.start() if m else n
                yield end, stop, "", False, "", False
                end = stop
        at = html.find("<", end)


def blocks(html: str) -> list[tuple[str, int, int]]:
    """(text, path, characters inside links) of the page's blocks in order; ``path`` has a bit for each slot of a name of the open elements.

    The open elements are kept in a stack, with the places of each kind in it, so a tag costs no more than what it closes.
    """
    found: list[tuple[str, int, int]] = []
    stack: list[tuple[str, list[int]]] = []
    where: dict[str, list[int]] = {}  # places of the open elements of a kind; "" those that are not inline
    often = [0] * PATHS
    parts: list[str] = []
    linked = done = bits = path = 0

    def inside(tag: str) -> int:
        """The place of the last open element of this kind, or -1."""
        places = where.get(tag)
        return places[-1] if places else -1

    def add(raw: str) -> None:
        nonlocal path, linked
        if stack and stack[-1][0] == "head" and raw.strip():
            close(len(stack) - 1)
        if inside("head") < 0 and inside("title") < 0:
            if not parts and raw.strip():
                path = bits
            parts.append(raw)
            if inside("a") >= 0:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append((text, path, linked))
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal bits
        while len(stack) > at:
            tag, slots = stack.pop()
            where[tag].pop()
            if not is_inline(tag):
                where[""].pop()
            for k in slots:
                often[k] -= 1
                if not often[k]:
                    bits ^= 1 << k

    for start, end, tag, closing, classes, slash in markup(html):
        if start > done:
            add(html[done:start])
        done = end
        if not tag:
            continue
        head = inside("head")
        if head >= 0 and tag not in HEAD and not closing and stack[-1][0] in ("head", "noscript"):
            close(head)
        foreign = min((where[t][0] for t in FOREIGN if where.get(t)), default=-1)
        if foreign >= 0 and tag not in FOREIGN:
            if closing:
                if inside("*" + tag) >= foreign:
                    tag = "*" + tag
            elif tag in BREAKS:
                close(foreign)
            else:
                tag = "*" + tag
        if tag == "br":
            parts.append(" ")
            continue
        inline = is_inline(tag)
        if not inline:
            flush()
        if closing:
            at = inside(tag)
            if at >= 0 and (not inline or at > inside("")):
                close(at)
            continue
        if tag in VOID or slash and (tag in EMPTY or tag[0] == "*"):
            continue
        if not inline:
            if inside("p") >= 0 and inside("p") == inside(""):
                close(inside("p"))
            if tag in CLOSES:
                other, until = CLOSES[tag]
                at = max(inside(tag), inside(other))
                if at > max((inside(t) for t in until), default=-1):
                    close(at)
        slots = []
        for name in [] if tag in ("html", "body") else [tag.lstrip("*"), *("." + w.lower() for w in NAME.findall(classes))]:
            k = slot(name) % PATHS
            slots.append(k)
            often[k] += 1
            bits |= 1 << k
        where.setdefault(tag, []).append(len(stack))
        if not inline:
            where.setdefault("", []).append(len(stack))
        stack.append((tag, slots))
    if done < len(html):
        add(html[done:])
    flush()
    return found


def is_inline(tag: str) -> bool:
    return tag in INLINE or tag[0] == "*"


_slot: dict[str, int] = {}


def slot(name: str) -> int:
    found = _slot.get(name)
    if found is None:
        if len(_slot) > 100_000:
            _slot.clear()
        found = _slot[name] = crc32(name.encode("utf-8", "replace"))
    return found


def vectors(page: list[tuple[str, int, int]], begin: int = 0, end: int | None = None) -> np.ndarray:
    """A row for each block, or for those from ``begin`` to ``end``."""
    last, some = len(page) - 1, page[begin:end]
    out = np.zeros((len(some), INPUTS), np.float32)
    for k, (text, path, linked) in enumerate(some):
        out[k, :PATHS] = np.unpackbits(np.frombuffer(path.to_bytes(PATHS // 8, "little"), np.uint8), bitorder="little")
        words = text.split(" ")
        counts = np.bincount([slot(w) % WORDS for w in words], minlength=WORDS)
        out[k, PATHS : PATHS + WORDS] = counts / len(words)
        n = len(text)
        out[k, PATHS + WORDS :] = (min(1.0, np.log1p(n) / 8), min(1.0, np.log1p(len(words)) / 6), min(1.0, linked / n), text[-1] in ".!?\"'", k + begin == 0, k + begin == last, (k + begin + 1) / len(page), n > 200)
    return out


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one from each end, and a logistic layer over both states and the block's own vector."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["x" + d] = r.normal(0, 0.1, (INPUTS, 4 * HIDDEN))
            self.p["h" + d] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        self.p["o"] = r.normal(0, 0.1, (2 * HIDDEN + INPUTS + 1,))

    def run(self, x: np.ndarray, there: np.ndarray, d: str, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """States (page, block, unit) of one direction; ``there``: 1 where a page has the block; ``state``: where it goes on, replaced."""
        n, steps, _ = x.shape
        given = x @ self.p["x" + d] + self.p["c" + d]
        h, c = state or (np.zeros((n, HIDDEN)),) * 2
        out = np.zeros((n, steps, HIDDEN))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + h @ self.p["h" + d]
            i, f, o = (_squash(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = there[:, t : t + 1]
            new = on * (f * c + i * g)
            s = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, s, on))
            h, c = on * o * s, new
            out[:, t] = h
        if state is not None:
            state[:] = h, c
        return out

    def logits(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(x, there, "f"), self.run(x, there, "b"), x, np.ones((*x.shape[:2], 1))], 2)
        return both @ self.p["o"]

    def slopes(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-loss over the blocks, by back-propagation through the page."""
        kept = {"f": [], "b": []}
        both = np.concatenate([self.run(x, there, "f", kept["f"]), self.run(x, there, "b", kept["b"]), x, np.ones((*x.shape[:2], 1))], 2)
        wrong = (_squash(both @ self.p["o"]) - y) * there / there.sum()
        slopes = {"o": np.einsum("nt,ntk->k", wrong, both)}
        for k, d in enumerate("fb"):
            w = self.p["h" + d]
            sx, sh, sc = np.zeros_like(self.p["x" + d]), np.zeros_like(w), np.zeros(4 * HIDDEN)
            back_h = back_c = np.zeros((len(x), HIDDEN))
            weight = self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            for t, h, c, i, f, o, g, s, on in reversed(kept[d]):
                dh = (wrong[:, t : t + 1] * weight + back_h) * on
                dc = (dh * o * (1 - s * s) + back_c) * on
                z = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], 1)
                sx += x[:, t].T @ z
                sh += h.T @ z
                sc += z.sum(0)
                back_h, back_c = z @ w.T, dc * f
            slopes |= {"x" + d: sx, "h" + d: sh, "c" + d: sc}
        return slopes

    def label(self, pages: list[list[tuple[str, int, int]]], together: int = 64, most: int = 8192) -> list[np.ndarray]:
        """Whether each block of each page is text; pages of like length go together, at most ``most`` blocks with what pads them."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            if len(pages[order[at]]) > most:
                out[order[at]] = self.label_long(pages[order[at]], most)
                at += 1
                continue
            size = 1
            while size < together and at + size < len(order) and (size + 1) * len(pages[order[at + size]]) <= most:
                size += 1
            some = order[at : at + size]
            z = self.logits(*padded([vectors(pages[k]) for k in some]))
            for k, row in zip(some, z, strict=True):
                out[k] = row[: len(pages[k])] > 0
            at += size
        return out

    def label_long(self, page: list[tuple[str, int, int]], most: int) -> np.ndarray:
        """The same for one page, ``most`` blocks at a time; the states go on from one part to the next."""
        z = np.empty(len(page))
        weight = {"f": self.p["o"][:HIDDEN], "b": self.p["o"][HIDDEN : 2 * HIDDEN]}
        for d in "fb":
            state = [np.zeros((1, HIDDEN))] * 2
            for begin in range(0, len(page), most) if d == "f" else range((len(page) - 1) // most * most, -1, -most):
                x = vectors(page, begin, begin + most)
                part = self.run(x[None], np.ones((1, len(x))), d, state=state)[0] @ weight[d]
                z[begin : begin + most] = part + x @ self.p["o"][2 * HIDDEN : -1] + self.p["o"][-1] if d == "f" else z[begin : begin + most] + part
        return z > 0


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, there = np.zeros((len(pages), max(map(len, pages)), INPUTS)), np.zeros((len(pages), max(map(len, pages))))
    for k, page in enumerate(pages):
        x[k, : len(page)], there[k, : len(page)] = page, 1
    return x, there


def generated(n: int, seed: int = 11) -> Iterator[tuple[str, list[bool]]]:
    """Pages of many layouts and, for each of their blocks, whether it is text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices(["an", "er", "th", "on", "re", "de", "ch", "ou", "st", "la", "mi", "so"], k=r.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    labels: list[bool] = []

    def block(tag: str, text: str, good: bool, attributes: str = "") -> str:
        labels.append(good)
        return f"<{tag}{attributes}>{text}</{tag}>"

    def links(good: bool = False) -> str:
        return "<ul>" + "".join(block("li", f'<a href="/{word()}">{phrase(1, 3)}</a>', good) for _ in range(r.randint(2, 8))) + "</ul>"

    def junk() -> str:
        kind = r.randrange(9)
        if kind == 0:
            return f"<nav{r.choice(['', ' class=menu', ' id="main-nav"'])}>{links()}</nav>"
        if kind == 1:
            return f'<div class="{r.choice(["menu", "navbar", "breadcrumb", "navigation", "pagination"])}">{links()}</div>'
        if kind == 2:
            return f'<{(t := r.choice(["aside", "div"]))} class="{r.choice(["sidebar", "related", "widget", "side", "recommended"])}">{block("h3", phrase(1, 3), False)}{links()}{block("p", phrase(5, 40) + ".", False)}</{t}>'
        if kind == 3:
            return block("div", phrase(4, 30) + ".", False, f' class="{r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner ad"])}"')
        if kind == 4:
            return f'<div class="{r.choice(["cookie", "cookie-notice", "notice", "consent", "alert", "popup", "modal", "gdpr"])}">{block("p", phrase(6, 30) + ".", False)}{block("button", phrase(1, 2), False)}</div>'
        if kind == 5:
            return f"<form{r.choice(['', ' class=search', ' id=newsletter', ' class=login'])}>{block('p', phrase(2, 12), False)}{block('button', phrase(1, 2), False)}</form>"
        if kind == 6:
            return f'<{(t := r.choice(["section", "div"]))} {r.choice(["id", "class"])}="{r.choice(["comments", "comment-list", "responses", "discussion", "reader-comments"])}">{block("h3", phrase(1, 2), False)}' + "".join(f'<div class="{r.choice(["comment", "reply"])}">{block("p", phrase(5, 60) + ".", False)}</div>' for _ in range(r.randint(1, 4))) + f"</{t}>"
        if kind == 7:
            return block("div", phrase(2, 10), False, f' class="{r.choice(["share", "social", "tags", "byline-share", "subscribe", "newsletter", "login", "legal", "copyright"])}"')
        return block("p", phrase(3, 20), False, f' class="{r.choice(["ad", "notice", "promo", "copyright", "cookie"])}"')

    def head() -> str:
        return f"<header{r.choice(['', ' class=top', ' id=masthead'])}>{block('h1' if r.random() < 0.2 else 'div', phrase(1, 4), False)}" + (f"<nav>{links()}</nav>" if r.random() < 0.5 else "") + "</header>"

    def foot() -> str:
        body = block("p", "&copy; " + phrase(2, 15), False) if r.random() < 0.5 else "&copy; " + phrase(2, 15)
        if not body.startswith("<p"):
            labels.append(False)
        kind = r.random()
        return f"<footer>{body}</footer>" if kind < 0.7 else f'<div class="footer">{body}</div>'

    def prose() -> str:
        out = [block("h1", phrase(2, 12), True)] if r.random() < 0.85 else []
        if r.random() < 0.15:
            out = ["<header>", *out, block("p", phrase(3, 8), True), "</header>"]
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.7:
                text = phrase(1, 90) + r.choice([".", ".", ".", ""])
                if r.random() < 0.1:
                    labels.append(True)
                    out.append(f"<p><b>{text}<br>")
                else:
                    out.append(block("p", text if r.random() < 0.8 else f'{text} <a href="/{word()}">{word()}</a> {word()}', True))
            elif x < 0.8:
                out.append(block(r.choice(["h2", "h3"]), phrase(1, 6), True))
            elif x < 0.88:
                out.append("<ul>" + "".join(block("li", phrase(1, 20), True) for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.93:
                out.append(block("blockquote", phrase(5, 40), True))
            elif x < 0.96:
                out.append("<table><tr>" + "".join(block("td", phrase(1, 4), True) for _ in range(3)) + "</tr></table>")
            else:
                out.append(junk())
        return "".join(out)

    def sentence() -> str:
        labels.append(True)
        return phrase(3, 80) + r.choice([".", ".", ""])

    name = lambda: "".join(r.choices("bcdfgklmnprstvz", k=r.randint(3, 7)))
    for _ in range(n):
        labels.clear()
        x = r.random()
        if x < 0.03:  # nothing but text
            yield sentence(), list(labels)
            continue
        if x < 0.08:  # an article and nothing else
            yield prose() if x < 0.055 else "".join(block("p", phrase(3, 80) + ".", True) for _ in range(r.randint(1, 4))), list(labels)
            continue
        out = [r.choice(["<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"] * 4 + ["<html><body>", "<title>x</title>"])]
        opened, closed = r.choice([("", "")] * 4 + [(f"<div class={name()}>", "</div>"), (f'<div id="{name()}"><div class="{name()} {name()}">', "</div></div>"), ('<div id="wrapper">', "</div>"), ("<table><tr><td>", "</td></tr></table>")])
        out.append(opened)
        if r.random() < 0.4:
            out.append(head())
        out += [junk() for _ in range(r.randint(0, 3))]
        inner, outer = r.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body entry">', "</div>"), ('<section class="story text">', "</section>"), ('<article class="post">', "</article>"), ("<div>", "</div>"), ("", ""), ("", ""), (f'<div class="{name()}">', "</div>"), (f'<div id="{name()}"><div>', "</div></div>"), (f"<section class={name()}>", "</section>")])
        out += [inner, prose(), outer]
        out += [junk() for _ in range(r.randint(0, 3))]
        if r.random() < 0.7:
            out.append(foot())
        yield "".join(out) + closed + r.choice(["</body></html>", ""]), list(labels)


@cache
def fit(n: int = 1500, rounds: int = 10, rate: float = 0.01, batch: int = 25) -> Labeller:
    """A labeller fitted to generated pages with Adam, once in a process."""
    pages = [(vectors(found), np.array(labels, float)) for text, labels in generated(n) if len(found := blocks(text)) == len(labels)]
    model, r = Labeller(), random.Random(5)
    first, second, step = {k: 0 for k in model.p}, {k: 0 for k in model.p}, 0
    for _ in range(rounds):
        r.shuffle(pages)
        for at in range(0, len(pages), batch):
            some = pages[at : at + batch]
            x, there = padded([p[0] for p in some])
            y = np.zeros(there.shape)
            for k, (_, labels) in enumerate(some):
                y[k, : len(labels)] = labels
            step += 1
            for k, slope in model.slopes(x, there, y).items():
                slope = slope + 1e-5 * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                model.p[k] = model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def extract(pages: DataFrame, html: str = "html", model: Labeller | None = None) -> DataFrame:
    """``pages`` and ``text``, the blocks labelled as text joined by empty lines; and ``n_blocks``, ``n_text_blocks``."""
    held = pages.sparkSession.sparkContext.broadcast(model or fit())  # some thousand weights, whatever the data
    names = ["text", "n_blocks", "n_text_blocks"]
    keep = [f for f in pages.schema.fields if f.name.lower() not in names]
    source = pages.select(*[F.col(f"`{f.name}`") for f in keep], F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cut = [blocks(v.as_py()) for v in batch.column(batch.num_columns - 1)]
            good = held.value.label(cut)
            texts = ["\n\n".join(b[0] for b, on in zip(c, g, strict=True) if on) for c, g in zip(cut, good, strict=True)]
            added = [pa.array(texts, pa.string()), pa.array([len(c) for c in cut], pa.int64()), pa.array([int(g.sum()) for g in good], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*(f.name for f in keep), *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string, n_blocks bigint, n_text_blocks bigint"])
    return source.mapInArrow(run, schema)
