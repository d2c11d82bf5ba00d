"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text without a block-level tag between them. Each
block has features of its ancestors (tags, and cues in their class and id) and of its text
(length, share of linked text, how it ends, where it stands). The field labels the chain of
blocks as article or not; it is trained in numpy on labelled pages that a generator lays
out in many ways, and decoded by Viterbi.

Pages are handled row by row inside Arrow batches; nothing is shuffled.

Formulas and the content of objects are read as markup, ``noscript`` as a notice. An element
that is skipped whole (scripts, styles, drawings, choices of forms) ends at its closing tag;
drawings and choices without one are read as markup, scripts and styles run to the end.

Defined results: null, empty and text-free html gives ''; repeated rows are extracted
alike; an empty table gives no rows; columns beside page_id, url and html are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
# Elements by how they are read.
RAW = frozenset("script style title textarea iframe noframes".split())
#: Skipped with all they hold where they are closed; left open they are read as markup.
SKIPPED = frozenset("svg select template".split())
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that a new one of the given kind ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
# Words in class, id and role that say what a part of a page is for.
CUES = {
    "ad": "ad ads adv advert advertisement adbox adslot banner sponsor sponsored promo promotion promoted dfp",
    "notice": "cookie cookies consent notice gdpr privacy alert popup modal overlay newsletter subscribe signup paywall disclaimer",
    "side": "sidebar side aside widget related recommended trending popular rail teaser more tags tagcloud",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc topbar skip links",
    "head": "header masthead site logo branding top hero toolbar",
    "foot": "footer foot copyright legal colophon bottom contentinfo credits",
    "comment": "comment comments reply replies disqus respond discussion thread review reviews reader feedback",
    "form": "form login search searchbox contact register poll vote",
    "share": "share sharing social follow facebook twitter buttons",
    "main": "article content post entry story main body text page prose hentry news blog maincontent articlebody",
}
_CUE = {word: name for name, words in CUES.items() for word in words.split()}
_PARTS = frozenset({f"cue:{c}" for c in CUES} | {f"in:{t}" for t in "article main nav header footer aside form".split()})
_TAGS = frozenset("article main nav header footer aside form section ul ol li table figure h1 h2 h3 h4 p div blockquote pre dl button label body td".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # features of the ancestors, outermost first
    tag: str
    linked: float


@lru_cache(100_000)
def _element_features(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"in:{tag}"] if tag in _TAGS else []
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").replace("_", "-")
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()
        out += sorted({f"cue:{_CUE[w]}" for w in _SPLIT.split(value) if w in _CUE})
    if tag == "noscript":
        out.append("cue:notice")
    if _HIDDEN.search(attributes):
        out.append("hidden")
    return tuple(out)


@lru_cache(64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def leaf_blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order, with character references decoded and white space folded."""
    blocks: list[Block] = []
    # Open elements: tag, features of the ancestors and itself, nearest block-level tag.
    stack: list[tuple[str, tuple[str, ...], str]] = [("", (), "")]
    is_open: Counter = Counter()
    unclosed: set[str] = set()
    parts: list[str] = []
    linked, at, size = 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append(Block(text, stack[-1][1], stack[-1][2], min(1.0, linked / max(1, len(raw)))))
        linked = 0

    def close(tag: str) -> None:
        while is_open[tag]:
            name = stack.pop()[0]
            is_open[name] -= 1
            if name == tag:
                return

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if is_open["a"]:
                linked += len(text)

    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            close(tag)
            continue
        attributes = m[3] or m[6] or ""
        if tag in FOREIGN and attributes.endswith("/"):
            continue
        if tag in RAW or tag in SKIPPED and tag not in unclosed:
            end = _closing(tag).search(html, at)
            if end:
                at = end.end()
                continue
            if tag in RAW:
                break
            unclosed.add(tag)
        if tag in BLOCK:
            flush()
            close("p")
            if tag in ENDS and any(is_open[t] for t in ENDS[tag]):
                for t, _, _ in reversed(stack):
                    if t in ENDS[tag]:
                        close(t)
                        break
                    if t in SCOPES.get(tag, ()):
                        break
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        own = _element_features(tag, attributes)
        _, above, block = stack[-1]
        if own:
            inner = next((f"inner:{f}" for f in reversed(own) if f in _PARTS), None)
            kept = tuple(f for f in above if not (inner and f.startswith("inner:")))
            above = kept + tuple(f for f in own if f not in kept) + ((inner,) if inner else ())
        stack.append((tag, above, tag if tag in BLOCK else block))
        is_open[tag] += 1
    flush()
    return blocks


def _size(n: int) -> int:
    return min(7, n.bit_length())


def text_features(b: Block, place: float) -> tuple[str, ...]:
    n = b.text.count(" ") + 1
    end = b.text[-1]
    return (
        f"tag:{b.tag}", f"words:{_size(n)}", f"linked:{int(b.linked * 4)}", f"tag:{b.tag}/words:{_size(n)}",
        "ends" if end in ".!?…»\"”" else "open", "sign" if "©" in b.text or "(c)" in b.text.lower() else "plain",
        f"place:{int(place * 3.999)}",
    )


@dataclass
class Field:
    """Weights of a two-label chain: score of 'article' over 'other' by feature, and by change of label."""

    weights: dict[str, float]
    moves: list[list[float]]
    start: list[float]

    def __post_init__(self):
        self.by_path: dict[tuple, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"by_path": {}}

    def scores(self, blocks: list[Block]) -> list[float]:
        w, memo, out, n = self.weights, self.by_path, [], max(1, len(blocks) - 1)
        for i, b in enumerate(blocks):
            s = memo.get(b.path)
            if s is None:
                if len(memo) > 50_000:
                    memo.clear()
                s = memo[b.path] = sum(w.get(f, 0.0) for f in b.path) + w.get("any", 0.0)
            for f in text_features(b, i / n):
                s += w.get(f, 0.0)
            out.append(s)
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best labels by Viterbi."""
        back, best = [], None
        for s in self.scores(blocks):
            if best is None:
                best = [self.start[0], self.start[1] + s]
                continue
            step, new = [], []
            for y in (0, 1):
                a, b = best[0] + self.moves[0][y], best[1] + self.moves[1][y]
                step.append(int(b > a))
                new.append(max(a, b) + (s if y else 0.0))
            back.append(step)
            best = new
        if best is None:
            return []
        y = int(best[1] > best[0])
        labels = [y]
        for step in reversed(back):
            y = step[y]
            labels.append(y)
        return labels[::-1]

    def learn(self, blocks: list[Block], labels: list[int], rate: float, decay: float) -> None:
        """One gradient step on the log-likelihood of a page's labels, by forward and backward sums."""
        scores, n = self.scores(blocks), len(blocks)
        lse = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        ahead = [[self.start[0], self.start[1] + scores[0]]]
        for s in scores[1:]:
            a = ahead[-1]
            ahead.append([lse(a[0] + self.moves[0][y], a[1] + self.moves[1][y]) + (s if y else 0.0) for y in (0, 1)])
        behind = [[0.0, 0.0]]
        for s in reversed(scores[1:]):
            b = behind[-1]
            behind.append([lse(self.moves[y][0] + b[0], self.moves[y][1] + b[1] + s) for y in (0, 1)])
        behind.reverse()
        z = lse(*ahead[-1])
        self.by_path.clear()
        for i, b in enumerate(blocks):
            gap = labels[i] - math.exp(ahead[i][1] + behind[i][1] - z)
            for f in (*b.path, *text_features(b, i / max(1, n - 1)), "any"):
                old = self.weights.get(f, 0.0)
                self.weights[f] = old + rate * (gap - decay * old)
            if i:
                for y in (0, 1):
                    for t in (0, 1):
                        p = math.exp(ahead[i - 1][y] + self.moves[y][t] + (scores[i] if t else 0.0) + behind[i][t] - z)
                        self.moves[y][t] += rate * ((labels[i - 1] == y and labels[i] == t) - p)
        p = math.exp(ahead[0][1] + behind[0][1] - z)
        self.start[1] += rate * (labels[0] - p)


def labelled_page(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """A laid-out page and its block texts with labels (1: article)."""
    truth: list[tuple[str, int]] = []
    count = iter(range(10**9))

    def words(lo: int, hi: int, stop: str = ".") -> str:
        n = rng.randint(lo, hi)
        text = " ".join("".join(rng.choice(["ka", "to", "mi", "ren", "sol", "ua", "est", "pi"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
        return f"{text.capitalize()} x{next(count)}{stop}"

    def block(tag: str, text: str, label: int, inner: str | None = None, attributes: str = "") -> str:
        truth.append((text, label))
        return f"<{tag}{attributes}>{inner or text}</{tag}>"

    def linked(text: str) -> str:
        return f'<a href="/{rng.randint(1, 99)}">{text}</a>'

    def plain(lo: int, hi: int, tags: str, link: float = 0.2) -> str:
        text = words(lo, hi, rng.choice(["", "."]))
        return block(rng.choice(tags.split()), text, 0, linked(text) if rng.random() < link else None)

    def links(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(plain(1, 4, "li", 0.8) for _ in range(rng.randint(1, 7))) + f"</{tag}>"

    def wrapped(names: str) -> tuple[str, str]:
        name = rng.choice(names.split())
        kind = rng.choice(["div", "div", "section", "aside"])
        return f'<{kind} {rng.choice(["class", "class", "id"])}="{rng.choice(["", "", "c-", "site-"])}{name}{rng.choice(["", "", " wide", "-box"])}">', f"</{kind}>"

    def other(kind: str) -> str:
        if kind == "menu":
            outer = rng.choice(["<nav>{}</nav>", "<nav>{}</nav>", '<div class="menu">{}</div>', '<ul class="nav">{}</ul>'])
            return outer.format(links() if rng.random() < 0.6 else plain(1, 12, "p h2 span div a"))
        if kind == "header":
            return f"<header>{plain(1, 12, 'div h1 h1 h2 p')}{links() if rng.random() < 0.3 else ''}</header>"
        if kind == "footer":
            sign = plain(1, 40, "p div h3 li span") if rng.random() < 0.6 else block("p", "© " + words(2, 25), 0)
            return f"<footer>{sign}{links() if rng.random() < 0.3 else ''}</footer>"
        if kind == "form":
            return f"<form>{plain(1, 30, 'p h2 h3 legend div')}{plain(1, 4, 'label button')}</form>"
        if kind == "comment":
            a, b = wrapped(CUES["comment"])
            return a + plain(1, 4, "h2 h3 h4") + "".join(plain(3, 110, "p p li div", 0.05) for _ in range(rng.randint(1, 6))) + b
        a, b = wrapped(CUES[kind]) if rng.random() < 0.8 or kind != "side" else ("<aside>", "</aside>")
        return a + (links() if rng.random() < 0.3 else "") + "".join(plain(1, 60, "p p div h2 h3") for _ in range(rng.randint(1, 3))) + b

    def article() -> str:
        body = []
        for _ in range(rng.randint(0 if rng.random() < 0.1 else 1, 9)):
            roll = rng.random()
            text = words(1, 5) if rng.random() < 0.2 else words(5, 110)
            if roll < 0.72:
                body.append(block("p", text, 1, rng.choice([text] * 6 + [f"<b>{text}</b>", linked(text)])))
            elif roll < 0.8:
                body.append(block("h2", words(1, 8, ""), 1))
            elif roll < 0.88:
                body.append("<ul>" + "".join(block("li", words(2, 20), 1) for _ in range(rng.randint(2, 4))) + "</ul>")
            elif roll < 0.93:
                body.append(block("blockquote", words(8, 40), 1))
            elif roll < 0.96:
                body.append("<table>" + "".join("<tr>" + block("td", words(1, 4, ""), 1) + block("td", words(1, 4, ""), 1) + "</tr>" for _ in range(2)) + "</table>")
            else:
                body.append(other(rng.choice(["ad", "share", "side", "form", "menu", "footer", "notice"])))
        return "".join(body)

    def opened() -> str:
        return rng.choice(["<article>", "<article>", "<main>", '<div class="content">', '<div id="main">', '<div class="post-body">', "<div>", '<section class="story">', '<div class="entry">'])

    page = [other(k) for k in ("header", "menu") if rng.random() < 0.7] + [other(k) for k in ("notice", "ad") if rng.random() < 0.4]
    start = opened()
    tag = re.match(r"<(\w+)", start)[1]
    head = block("h1", words(2, 12, rng.choice(["", "."])), 1) if rng.random() < 0.85 else ""
    if head and rng.random() < 0.2:
        head = f"<header>{head}</header>"
    page.append(start + head + article() + f"</{tag}>")
    page += [other(k) for k in ("share", "comment", "side", "form", "ad", "notice", "menu") if rng.random() < 0.35]
    if rng.random() < 0.85:
        page.append(other("footer"))
    return "<html><head><title>x</title></head><body>" + "".join(page) + "</body></html>", truth


def train(pages: int = 800, epochs: int = 4, seed: int = 11) -> Field:
    """The field fitted to generated labelled pages."""
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        html, truth = labelled_page(rng)
        blocks, labels = leaf_blocks(html), dict(truth)
        data.append((blocks, [labels[b.text] for b in blocks]))
    field = Field({}, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0])
    for epoch in range(epochs):
        rng.shuffle(data)
        for blocks, labels in data:
            if blocks:
                field.learn(blocks, labels, 0.1 / (1 + epoch), 1e-3)
    return field


def main_text(html: str | None, field: Field) -> str:
    blocks = leaf_blocks(html or "")
    return "\n".join(b.text for b, y in zip(blocks, field.decode(blocks)) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    field = field or train()

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), field) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
