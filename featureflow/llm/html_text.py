"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks of text at block-level tags. Features of a block are its ancestors' tags, words
of their class and id attributes, the tags it stands between, and the shape of its text. The model has two
labels, weights per feature and label transitions; it is trained by gradient ascent on the likelihood of labelled
pages, and a page is decoded by the Viterbi algorithm.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format: tags whose content is not text, tags without content, and tags inside a line.
HIDDEN = frozenset("script style noscript template head title textarea select svg iframe annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr "
    "math mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover "
    "semantics annotation annotation-xml".split()
)
# Tags that leave an open head open; any other tag, and text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
# A new tag of the first kind ends an open one of the second, up to a tag of the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
NOT_IN_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
# Words of class and id attributes and of short texts that tell what a block is.
CUES = frozenset(
    "ad ads advert advertisement banner promo sponsor sponsored related share social sidebar side widget nav menu navbar "
    "breadcrumb breadcrumbs header footer foot masthead cookie cookies consent notice alert popup modal newsletter subscribe signup login "
    "form search comment comments reply respond discussion tag tags meta author byline caption copyright legal article content entry post "
    "story body text main page title headline rail toolbar pagination pager skip".split()
)
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@lru_cache(maxsize=1 << 16)
def _cues_of(word: str) -> frozenset[str]:
    """The cues a word is, or begins or ends with (of five letters or more): commentlist, usercomments."""
    if word in CUES:
        return frozenset([word])
    return frozenset(c for c in CUES if len(c) >= 5 and (word.startswith(c) or word.endswith(c)))


class Path(NamedTuple):
    """The ancestors of a block; equal paths of a page are one object, so depth costs nothing."""

    tag: str
    above: str  # the tag above it
    tags: frozenset[str]
    number: int


class Block(NamedTuple):
    text: str
    path: Path
    cues: frozenset[str]  # words of the ancestors' class, id and role
    linked: int  # characters inside links


NOWHERE = Path("-", "", frozenset(), 0)


def blocks(page: str | None) -> list[Block]:
    """Texts between block-level tags in page order: references decoded, white space folded, empty ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], Path]] = []  # with all cues and the path down to each tag
    places: dict[str, list[int]] = defaultdict(list)  # where each open tag stands in the stack
    walls: list[int] = []  # where tags stand that no tag inside a line closes
    known: dict[tuple[int, str], Path] = {}
    parts: list[str] = []
    linked, links, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, stack[-1][2] if stack else NOWHERE, stack[-1][1] if stack else frozenset(), linked))
        parts.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal hidden, links
        for tag, _, _ in reversed(stack[at:]):
            hidden -= tag in HIDDEN
            links -= tag == "a"
            places[tag].pop()
            if tag not in INLINE:
                walls.pop()
        del stack[at:]

    def put(tag: str, told: frozenset[str]) -> None:
        nonlocal hidden, links
        _, cues, path = stack[-1] if stack else ("", frozenset(), NOWHERE)
        if tag not in INLINE:
            key = path.number, tag
            if key not in known:
                known[key] = Path(tag, path.tag if path.number else "", path.tags if tag in path.tags else path.tags | {tag}, len(known) + 1)
            path = known[key]
            walls.append(len(stack))
        places[tag].append(len(stack))
        stack.append((tag, cues if told <= cues else cues | told, path))
        hidden += tag in HIDDEN
        links += tag == "a"

    def end_head() -> None:
        if places["head"] and (not places["template"] or places["template"][-1] < places["head"][-1]):
            close(places["head"][-1])

    page, at = page or "", 0
    while match := _TOKEN.match(page, at):
        at = match.end()
        tag = match[2]
        if tag is None:
            token = match[0]
            if not token.startswith("<") or token == "<":
                if hidden and stack[-1][0] == "head" and not token.isspace():
                    end_head()
                if not hidden:
                    text = html.unescape(token) if "&" in token else token
                    parts.append(text)
                    linked += len(text) if links else 0
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if match[1]:
            if places[tag] and (tag not in INLINE or not walls or places[tag][-1] > walls[-1]):
                close(places[tag][-1])
            continue
        if tag in VOID or tag == "svg" and match[3].endswith("/"):
            if hidden and tag not in IN_HEAD:
                end_head()
            continue
        if hidden and tag not in IN_HEAD:
            end_head()
        names, ends = CLOSES.get(tag, ((), ()))
        if tag in NOT_IN_P:
            names, ends = (*names, "p"), (*ends, "div", "article", "section", "td", "li", "body", "main", "aside", "form", "blockquote")
        if any(places[n] for n in names):
            wall = max((places[e][-1] for e in ends if places[e]), default=-1)
            inside = [places[n][k] for n in names if (k := bisect_right(places[n], wall)) < len(places[n])]
            if inside:
                close(min(inside))
        told = frozenset(
            c for m in _NAMED.finditer(match[3]) for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower()) for c in _cues_of(w)
        ) if match[3] else frozenset()
        put(tag, told)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block."""
    rows = []
    for place, block in enumerate(found):
        text = block.text
        words = text.split()
        path = block.path
        row = ["bias", f"tag:{path.tag}", f"up:{path.above}>{path.tag}" if path.above else f"up:{path.tag}"]
        row += [f"in:{t}" for t in path.tags]
        row += [f"cue:{c}" for c in block.cues]
        row.append(f"words:{min(6, len(words).bit_length())}")
        share = block.linked / len(text)
        row.append(f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}")
        stops = sum(text.count(c) for c in ".!?")
        row.append(f"stops:{min(stops, 3)}")
        row.append(f"end:{'.' if text[-1] in '.!?:…»”' else 'a' if text[-1].isalpha() else '0'}")
        row += [f"says:{w}" for w in {w.strip(".,:;!?()").lower() for w in words[:12]} & CUES] if len(words) < 30 else []
        if "©" in text:
            row.append("says:©")
        row.append(f"place:{min(4, 5 * place // len(found))}")
        if place:
            before = found[place - 1]
            row.append(f"same:{before.path is path}:{before.cues == block.cues}")
        rows.append(row)
    return rows


class Model(NamedTuple):
    weights: dict[str, float]  # for the label "main" against "other"
    start: tuple[float, float]
    moves: tuple[tuple[float, float], tuple[float, float]]  # from, to

    def decode(self, found: list[Block]) -> list[int]:
        """The most probable labels; of equal ones the path that keeps 0."""
        if not found:
            return []
        get, back = self.weights.get, []
        score = [0.0, 0.0]
        for place, row in enumerate(features(found)):
            own = sum(get(f, 0.0) for f in row)
            if place == 0:
                score = [self.start[0], self.start[1] + own]
                continue
            step = [[score[a] + self.moves[a][b] for a in (0, 1)] for b in (0, 1)]
            best = [int(s[1] > s[0]) for s in step]
            back.append(best)
            score = [step[0][best[0]], step[1][best[1]] + own]
        label = int(score[1] > score[0])
        path = [label]
        for best in reversed(back):
            label = best[label]
            path.append(label)
        return path[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page)
        return "\n\n".join(b.text for b, y in zip(found, self.decode(found)) if y)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 300, rate: float = 0.1, decay: float = 2e-3, seed: int = 7) -> Model:
    """Maximise the regularised likelihood of the labels by Adam steps over all pages at once.

    Sums over label paths run forwards and backwards over all pages together, padded to the longest.
    """
    pages = [p for p in pages if p[0]]
    rows = [features(found) for found, _ in pages]
    names = sorted({f for page in rows for row in page for f in row})
    index = {f: i for i, f in enumerate(names)}
    most = max(map(len, rows))
    mask = np.zeros((len(pages), most), bool)
    gold = np.zeros((len(pages), most), np.int64)
    at, of = [], []
    for p, (page, (_, labels)) in enumerate(zip(rows, pages)):
        mask[p, : len(page)] = True
        gold[p, : len(page)] = labels
        for t, row in enumerate(page):
            at += [p * most + t] * len(row)
            of += [index[f] for f in row]
    at, of = np.array(at), np.array(of)
    lengths = mask.sum(axis=1)
    last = (np.arange(len(pages)), lengths - 1)
    theta = np.zeros(len(names) + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weights, start, moves = theta[: len(names)], theta[len(names) : len(names) + 2], theta[len(names) + 2 :].reshape(2, 2)
        own = np.zeros(mask.size)
        np.add.at(own, at, weights[of])
        unary = np.stack([np.zeros(mask.shape), own.reshape(mask.shape)], axis=2)
        ahead = np.zeros_like(unary)
        ahead[:, 0] = unary[:, 0] + start
        for t in range(1, most):
            ahead[:, t] = unary[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1)
        total = np.logaddexp.reduce(ahead[last], axis=1)
        behind = np.zeros_like(unary)
        for t in range(most - 2, -1, -1):
            inner = np.logaddexp.reduce(moves + (unary[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where((t < lengths - 1)[:, None], inner, 0)
        here = np.exp(np.where(mask[:, :, None], ahead + behind - total[:, None, None], -np.inf))
        pair = ahead[:, :-1, :, None] + moves + (unary + behind)[:, 1:, None, :] - total[:, None, None, None]
        pair = np.exp(np.where(mask[:, 1:, None, None], pair, -np.inf)).sum(axis=(0, 1))
        grad = np.zeros_like(theta)
        error = np.where(mask, gold - here[:, :, 1], 0).reshape(-1)
        np.add.at(grad, of, error[at])
        grad[len(names) : len(names) + 2] = np.bincount(gold[:, 0], minlength=2) - here[:, 0].sum(axis=0)
        told = np.zeros((2, 2))
        np.add.at(told, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
        grad[len(names) + 2 :] = (told - pair).reshape(-1)
        grad = grad / len(pages) - decay * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    tail = theta[len(names) :]
    return Model(
        {f: float(w) for f, w in zip(names, theta)}, (float(tail[0]), float(tail[1])),
        ((float(tail[2]), float(tail[3])), (float(tail[4]), float(tail[5]))),
    )


def labelled(page: str, main: list[str]) -> tuple[list[Block], list[int]]:
    """Blocks of a page with label 1 where they are the main texts, which come in page order."""
    found, labels, at = blocks(page), [], 0
    for block in found:
        hit = at < len(main) and block.text == main[at]
        labels.append(int(hit))
        at += hit
    return found, labels


def _sentence(r: random.Random, least: int, most: int) -> str:
    words = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
    return " ".join(words).capitalize()


def _paragraph(r: random.Random) -> str:
    return " ".join(_sentence(r, 2, 18) + r.choice("...?!") for _ in range(r.randint(1, 6)))


def labelled_page(r: random.Random) -> tuple[str, list[str]]:
    """One invented page in a common layout, with its main texts."""
    link = lambda n=2: f'<a href="/{r.randint(1, 999)}">{_sentence(r, 1, n)}</a>'
    items = lambda: "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8)))
    pick = r.choice
    kind = {
        "nav": lambda: pick([f"<nav><ul>{items()}</ul></nav>", f'<div class="menu"><ul>{items()}</ul></div>', f'<ul id="nav">{items()}</ul>']),
        "header": lambda: pick([f"<header><h1>{_sentence(r, 1, 3)}</h1><p>{_sentence(r, 2, 6)}</p></header>", f'<div id="header">{link()} {link()}</div>']),
        "footer": lambda: pick([f"<footer>&copy; {_sentence(r, 1, 3)} &middot; {_sentence(r, 3, 14)}.</footer>", f'<div class="footer"><p>Copyright {_sentence(r, 2, 5)}</p>{link()}</div>',
                                f"<footer><p>{_paragraph(r)}</p><ul>{items()}</ul></footer>"]),
        "aside": lambda: pick([f"<aside><h3>{_sentence(r, 1, 3)}</h3><ul>{items()}</ul></aside>", f'<div class="sidebar"><p>{_paragraph(r)}</p>{link()}</div>', f"<aside><p>{_paragraph(r)}</p></aside>"]),
        "ad": lambda: f'<div class="{pick(["ad", "advert", "ads banner", "sponsored", "promo"])}">{pick([_paragraph(r), _sentence(r, 2, 8), f"<p>{_paragraph(r)}</p>"])}</div>',
        "notice": lambda: f'<div class="{pick(["cookie-notice", "consent", "alert notice", "cookie banner"])}"><p>{_paragraph(r)}</p><button>{_sentence(r, 1, 2)}</button></div>',
        "form": lambda: f'<form action="/s"><label>{_sentence(r, 1, 4)}</label><input name="q"><p>{_sentence(r, 2, 9)}.</p><button>{_sentence(r, 1, 2)}</button></form>',
        "commentlist": lambda: f'<{(t := pick(["ol", "ul"]))} class="{pick(["commentlist", "comment-list", "usercomments"])}">'
        + "".join(f"<li><p>{_paragraph(r)}</p></li>" for _ in range(r.randint(1, 4))) + f"</{t}>",
        "respond": lambda: f'<div class="{pick(["comment-respond", "respond", "reply-form"])}"><h3>{_sentence(r, 1, 4)}</h3><p>{_sentence(r, 2, 9)}.</p></div>',
        "remarks": lambda: f'<div class="{pick(["comments", "comment-section", "reader-comments"])}">' + "".join(f"<p>{_paragraph(r)}</p>" for _ in range(r.randint(1, 4))) + "</div>",
        "comments": lambda: f'<{(t := pick(["section", "div"]))} class="comments"><h3>{_sentence(r, 1, 3)}</h3>'
        + "".join(f'<div class="comment"><p>{_paragraph(r)}</p></div>' for _ in range(r.randint(1, 4))) + f"</{t}>",
        "related": lambda: f'<div class="related"><h4>{_sentence(r, 1, 3)}</h4>{link(6)}{link(6)}</div>',
        "script": lambda: '<script>var t="</p>";</script>',
    }
    main, body = [], []

    def block(tag: str, text: str) -> None:
        main.append(text)
        body.append(f"<{tag}>{text}" + pick(["", f"</{tag}>"]) if tag in ("p", "li") else f"<{tag}>{text}</{tag}>")

    if r.random() < 0.3:  # the article's own header, with its headline and byline
        body.append("<header>" if r.random() < 0.6 else f'<{pick(["header", "div"])} class="{pick(["entry-header", "post-header", "article-header"])}">')
        opened = "div" if body[-1].startswith("<div") else "header"
        block(pick(["h1", "h1", "h2"]), _sentence(r, 2, 9) + pick(["", "."]))
        if r.random() < 0.6:
            block("p", _sentence(r, 2, 6) + pick(["", "."]))
        body.append(f"</{opened}>")
    elif r.random() < 0.85:
        block(pick(["h1", "h1", "h2"]), _sentence(r, 2, 9) + pick(["", "."]))
    for _ in range(r.randint(1, 12)):
        choice = r.random()
        if choice < 0.72:
            block("p", _paragraph(r))
        elif choice < 0.8:
            block(pick(["h2", "h3"]), _sentence(r, 1, 7))
        elif choice < 0.85:
            body.append("<ul>")
            for _ in range(r.randint(1, 4)):
                block("li", _sentence(r, 2, 12) + pick(["", "."]))
            body.append("</ul>")
        elif choice < 0.9:
            block(pick(["blockquote", "pre", "figcaption"]), _paragraph(r))
        elif choice < 0.94:
            main.append((a := _paragraph(r)) + " " + (b := _sentence(r, 2, 9)))
            body.append(f"<p><b>{a}<br>{b}")
        else:
            body.append(kind[pick(["ad", "aside", "related", "script", "form", "notice", "remarks", "commentlist"])]())
    if r.random() < 0.25:  # comments that stand inside the article
        body += [kind[k]() for k in ("remarks", "commentlist", "comments", "respond") if r.random() < 0.4]
    wrap = pick(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>',
                 '<div id="main"><div class="article post">{}</div></div>', '<div class="story-body">{}</div>', "<div>{}</div>", '<section class="entry">{}</section>'])
    before = [kind[k]() for k in ("notice", "header", "nav", "script", "ad", "form", "aside") if r.random() < 0.4]
    after = [kind[k]() for k in ("related", "comments", "commentlist", "respond", "aside", "ad", "form", "footer", "script") if r.random() < 0.4]
    page = f"<html><head><title>{_sentence(r, 2, 8)}</title></head><body>{''.join(before)}{wrap.format(''.join(body))}{''.join(after)}</body></html>"
    return page, main


@lru_cache(maxsize=2)
def default_model(pages: int = 400, seed: int = 5) -> Model:
    """Trained on so many invented labelled pages; the bound does not depend on the data to be read."""
    r = random.Random(seed)
    return train([labelled(*labelled_page(r)) for _ in range(pages)])


def extract(pages: DataFrame, model: Model | None = None, page: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Append the main text of a page and its length in code points to every row.

    Main blocks are joined in page order by two line feeds; white space inside a block is one space;
    nothing else is dropped or cut. Null and empty pages give an empty text. Each row stands alone: no
    shuffle, repeated rows alike, an empty table stays empty. Input columns named like an output are replaced.
    """
    model = model or default_model()
    rows = pages.drop(*[c for c in (text, n_chars) if c != page])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(page))
            texts = [model.extract(x.as_py()) for x in column]
            added = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, text, n_chars])

    fields = [*rows.schema.fields, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())]
    return rows.mapInArrow(run, T.StructType(fields))
