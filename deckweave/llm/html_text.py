"""Main text of web pages by gradient-boosted trees over DOM nodes and a consistent decoding.

Names of elements and words of their attributes count by rates learned from the training pages, and so
do not decide alone: names there are also missing, meaningless or misleading.
"""

import math
import pickle
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckweave.llm import arrow
from deckweave.llm.boosting import Boosted, fit
from deckweave.llm.dom import Node, parse
from deckweave.llm.sampling import sample_by_hash

#: Pages that give the texts of training pages, chosen by hash, and runs of text taken from each, by hash.
SAMPLE_PAGES = 200
SAMPLE_RUNS = 100
#: Pages composed for training, each node of which is labelled by construction.
TRAINING_PAGES = 1500
#: Boosting rounds and depth of the trees.
ROUNDS, DEPTH = 100, 6
#: Nodes without a token that its rate is smoothed by.
PRIOR_NODES = 8.0

_MARKS = re.compile(r"[.,;:!?]")

FEATURES = (
    "own_low", "own_high", "above_low", "above_sum", "below_low", "depth", "chars", "words", "links",
    "inline", "inputs", "runs", "paragraphs", "per_run", "marks", "position", "is_run_or_p", "heading", "item", "table",
    "siblings", "same_tag", "sibling_chars", "sibling_links", "of_parent", "of_page", "children", "heading_level",
    "twins", "above_twins", "most_of_page_above", "short_first",
)


class Page:
    """The nodes of a page that hold text, in page order, with their features."""

    def __init__(self, html: str):
        self.nodes: list[Node] = []
        self.parents: list[int] = []
        self._walk(parse(html))

    def _walk(self, root: Node) -> None:
        # Nodes without any text, and hidden ones, are left out; what is below one node is consecutive.
        seen, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.hidden:
                continue
            seen.append(node)
            stack.extend(reversed(node.children))
        holds: set[int] = set()
        for node in reversed(seen):
            if node.tag == "#" or id(node) in holds:
                holds.add(id(node))
                if node.parent is not None:
                    holds.add(id(node.parent))
        place: dict[int, int] = {}
        for node in seen:
            if id(node) in holds:
                place[id(node)] = len(self.nodes)
                self.parents.append(-1 if node.parent is None else place[id(node.parent)])
                self.nodes.append(node)

    def tokens(self) -> list[list[str]]:
        """For each node its element name, marked, and the words of its attributes; none for runs."""
        return [[] if node.tag == "#" else [f"<{node.tag}>", *dict.fromkeys(node.tokens)] for node in self.nodes]

    def features(self, rates: dict[str, float]) -> np.ndarray:
        """``FEATURES`` of each node; ``rates`` are log odds of tokens, 0 for unknown ones."""
        nodes, n = self.nodes, len(self.nodes)
        made = np.zeros((n, len(FEATURES)), np.float32)
        if not n:
            return made
        parents = np.array(self.parents)
        chars, words, links, inline, inputs, runs, marks, pars, below = (np.zeros(n) for _ in range(9))
        low, high, depth, level = (np.zeros(n) for _ in range(4))
        kinds = np.zeros((n, 4))
        tags = []
        for i, node in enumerate(nodes):
            tag = node.tag
            tags.append(tag)
            depth[i] = node.depth
            if tag == "#":
                text = "".join(node.text)
                chars[i], words[i], links[i] = len(text), text.count(" ") + 1, node.links
                inline[i], runs[i], marks[i] = node.inline, 1, len(_MARKS.findall(text))
                kinds[i, 0] = 1
                continue
            inputs[i] = node.inputs
            odds = [rates.get(f"<{tag}>", 0.0), *[rates.get(word, 0.0) for word in node.tokens]]
            low[i], high[i] = min(odds), max(odds)
            if tag == "p":
                pars[i] = kinds[i, 0] = 1
            elif len(tag) == 2 and tag[0] == "h":
                kinds[i, 1], level[i] = 1, int(tag[1]) if tag[1].isdigit() else 0
            elif tag in ("li", "dd", "dt"):
                kinds[i, 2] = 1
            elif tag in ("table", "tr", "td", "th", "tbody"):
                kinds[i, 3] = 1
        above_low, above_sum, above_twins, above_most = (np.zeros(n) for _ in range(4))
        start = np.concatenate([[0], np.cumsum(chars)])[:-1]
        children = np.zeros(n)
        for i in range(n - 1, 0, -1):
            p = parents[i]
            children[p] += 1
            chars[p] += chars[i]
            words[p] += words[i]
            links[p] += links[i]
            inline[p] += inline[i]
            inputs[p] += inputs[i]
            runs[p] += runs[i]
            marks[p] += marks[i]
            pars[p] += pars[i]
            below[p] = min(below[p], below[i], low[i])
        # How many siblings have the same element and the same children, for those with several children.
        shapes: dict[tuple, int] = {}
        shape = [
            (self.parents[i], tags[i], *[child.tag for child in nodes[i].children[:4]]) if children[i] > 1 else None for i in range(n)
        ]
        for key in shape:
            if key is not None:
                shapes[key] = shapes.get(key, 0) + 1
        twins = np.array([0 if key is None else shapes[key] - 1 for key in shape], float)
        share = chars / max(chars[0], 1)
        for i in range(1, n):
            p = parents[i]
            above_low[i] = min(above_low[p], low[p])
            above_sum[i] = above_sum[p] + low[p] + high[p]
            above_twins[i] = max(above_twins[p], twins[p])
            above_most[i] = above_most[p] + (share[p] > 0.5)
        first = np.zeros(n)
        for i in range(n - 1, 0, -1):
            if i == parents[i] + 1:  # the first child
                first[parents[i]] = chars[i]
        up = np.maximum(parents, 0)
        size = np.maximum(chars, 1)
        siblings = np.maximum(children[up], 1)
        same: dict[tuple[int, str], int] = {}
        for p, tag in zip(self.parents, tags):
            same[p, tag] = same.get((p, tag), 0) + 1
        columns = (
            low, high, above_low, np.clip(above_sum, -12, 12), below, depth,
            np.log1p(chars), np.log1p(words), links / size, inline / size, np.minimum(inputs, 5), np.log1p(runs), np.log1p(pars),
            np.log1p(chars / np.maximum(runs, 1)), marks / size, start / max(chars[0], 1), *kinds.T,
            np.log1p(siblings), np.array([same[p, tag] for p, tag in zip(self.parents, tags)]) / siblings,
            np.log1p((chars[up] - chars) / siblings), (links[up] - links) / np.maximum(chars[up] - chars, 1),
            chars / np.maximum(chars[up], 1), share, np.log1p(children), level,
            np.log1p(twins), np.log1p(above_twins), np.minimum(above_most, 5), np.log1p(first),
        )
        for k, column in enumerate(columns):
            made[:, k] = column
        return made

    def labels(self) -> np.ndarray:
        """For composed pages: whether a node holds any marked text."""
        wanted = np.array([node.wanted for node in self.nodes], bool)
        for i in range(1, len(wanted)):
            node = self.nodes[i]
            if node.tag == "#" and wanted[self.parents[i]]:
                wanted[i] = True
        for i in range(len(wanted) - 1, 0, -1):
            if wanted[i]:
                wanted[self.parents[i]] = True
        return wanted

    def text(self, margins: np.ndarray) -> str:
        """The kept runs, joined as blocks.

        ``margins`` are log odds of each node to be kept. A dropped node drops all below it, a kept
        one keeps all above it; among such choices the one with the largest likelihood is taken,
        bottom up. The root is kept.
        """
        n = len(self.nodes)
        if not n:
            return ""
        best = np.logaddexp(0, margins) * -1.0  # log of the odds to be dropped
        keep, drop = (margins + best).tolist(), best.tolist()
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            keep[p] += max(keep[i], drop[i])
            drop[p] += drop[i]
        kept = [True] * n
        blocks = []
        for i in range(n):
            if i:
                kept[i] = kept[self.parents[i]] and keep[i] > drop[i]
            if kept[i] and self.nodes[i].tag == "#":
                block = " ".join("".join(self.nodes[i].text).split())
                if block:
                    blocks.append(block)
        return "\n\n".join(blocks)


@dataclass(frozen=True)
class Model:
    """Log odds of tokens, and trees over the features that they give."""

    rates: dict[str, float]
    trees: Boosted

    def margins(self, pages: list[Page]) -> np.ndarray:
        """Log odds to be kept of the nodes of all pages, one page after the other."""
        return self.trees.margin(np.concatenate([page.features(self.rates) for page in pages]))


def token_rates(pages: list[Page]) -> dict[str, float]:
    """How much more likely than others a node with a token is to be kept, as smoothed log odds."""
    kept: Counter = Counter()
    seen: Counter = Counter()
    whole = good = 0
    for page in pages:
        for words, wanted in zip(page.tokens(), page.labels()):
            if words:
                seen.update(words)
                whole += 1
                if wanted:
                    kept.update(words)
                    good += 1
    rate = (good + 1) / (whole + 2)
    base = math.log(rate / (1 - rate))
    return {
        word: math.log((kept[word] + PRIOR_NODES * rate) / (n - kept[word] + PRIOR_NODES * (1 - rate))) - base
        for word, n in seen.items()
    }


def fit_pages(pages: list[Page]) -> Model:
    """Rates and trees from labelled pages. Trees see a page with the rates that the other half gives,
    as new pages come with names that no rate rests on."""
    halves = [pages[::2], pages[1::2]]
    others = [token_rates(halves[1]), token_rates(halves[0])]
    features = [page.features(rates) for half, rates in zip(halves, others) for page in half]
    labels = [page.labels() for half in halves for page in half]
    return Model(token_rates(pages), fit(np.concatenate(features), np.concatenate(labels), ROUNDS, DEPTH))


#: Sentences for training pages where a table holds none.
_FILLER = (
    "The river had risen during the night, and the lower fields were under water.",
    "Nobody in the village could remember a summer that had been as dry as this one.",
    "She opened the letter, read it twice, and put it back into the drawer.",
    "Prices rose by three percent in the second quarter; wages did not follow.",
)
_RUNS = re.compile(r">([^<>]{20,})<")


#: Names of other parts, which also stand in names around articles.
_OTHER_NAMES = ("header", "sidebar", "footer", "nav", "menu", "legal", "comments", "news", "promo", "related", "more", "widget")


class Composer:
    """Labelled pages from the texts of others: articles in many layouts among other parts."""

    def __init__(self, texts: list[str], seed: int = 3):
        self._random = random.Random(seed)
        self._texts = texts + list(_FILLER) * (1 if texts else 5)

    def _some(self, *choices):
        return self._random.choice(choices)

    def _sentence(self, most: int = 400) -> str:
        return self._some(*self._texts[:: max(1, len(self._texts) // 500)])[: self._random.randint(15, most)]

    def _words(self, n: int) -> str:
        return " ".join(self._sentence().split()[:n]) or "more"

    def _paragraph(self) -> str:
        text = " ".join(self._sentence(600) for _ in range(self._random.choice([1, 1, 2, 3])))
        if self._random.random() < 0.3:
            cut = len(text) // 2
            text = f"{text[:cut]}<{(t := self._some('b', 'i', 'em', 'a href=x', 'strong'))}>{text[cut : cut + 20]}</{t.split()[0]}>{text[cut + 20 :]}"
        return text

    def _any_name(self) -> str:
        """A name that tells nothing."""
        letters = "".join(self._random.choices("abcdefghiklmnoprstuvwz", k=self._random.randint(2, 9)))
        return self._some("box", "col", "panel", "block", "row", "unit", "wrap", letters, letters, letters) + self._some("", "", "-3", "-x", "7")

    def _named(self, *words: str, misleading: tuple[str, ...] = ("content", "article", "post", "main", "text", "page", "body", "story")) -> str:
        """Attributes with a name: none, one that tells nothing, one of the words, or one with a misleading word beside it."""
        pick, kind = self._random.random(), self._some("class", "class", "id")
        if pick < 0.12:
            return ""
        if pick < 0.3:
            return f' {kind}="{self._any_name()}"'
        word = self._some(*words)
        if pick < 0.45:
            word = self._some("{1}-{0}", "{0}-{1}", "{0}_{1}", "{1} {0}").format(word, self._some(*misleading))
        extra = self._some("", "", "-box", " c12", "-wrap", "-area", " block")
        return f' {kind}="{word}{extra}"'

    def _around(self) -> str:
        """Attributes of an element around an article and other parts, with a word of those."""
        name = self._some("{0}-{1}", "{0}-with-{1}", "has-{1}", "{1}-{0}", "{1}", "{0}")
        return f' {self._some("class", "class", "id")}="{name.format(self._some("page", "content", "layout", "main", "site", "body"), self._some(*_OTHER_NAMES))}"'

    def _list(self, links: bool, n: int) -> str:
        items = (f"<a href='/{i}'>{self._words(self._some(1, 2, 3, 6))}</a>" if links else self._sentence(120) for i in range(n))
        return "<ul>" + "".join(f"<li>{item}</li>" for item in items) + "</ul>"

    def other(self) -> str:
        """A part that is no article."""
        n = self._random.randint(2, 9)
        pick = self._random.randrange(13)
        if pick == 0:
            return self._some("<nav>{}</nav>", f"<div{self._named('menu', 'nav', 'navbar')}>{{}}</div>").format(self._list(True, n))
        if pick == 1:
            tag = self._some("header", "header", "div")
            return f"<{tag}{self._named('header', 'masthead', 'topbar')}>{self._some('<h1>{}</h1>', '<p>{}</p>', '<div>{}</div>').format(self._words(3))}{self._list(True, n) if self._random.random() < 0.5 else ''}</{tag}>"
        if pick == 2:
            tag = self._some("footer", "footer", "div")
            body = self._some("&copy; {} {}", "<p>&copy; {} {}</p>", "<p>{}</p><p>{}</p>").format(self._words(3), self._sentence(150))
            return f"<{tag}{self._named('footer', 'copyright', 'legal')}>{body}</{tag}>"
        if pick in (3, 4):
            tag = self._some("aside", "div", "section")
            name = self._named("sidebar", "sidebar", "widget", "related", "side-bar")
            body = self._some(self._list(True, n), self._list(False, 3), f"<p>{self._paragraph()}</p>", f"<p>{self._paragraph()}</p><p>{self._paragraph()}</p>")
            return f"<{tag}{name}>{self._some('', f'<h3>{self._words(2)}</h3>')}{body}</{tag}>"
        if pick in (5, 6):
            name = self._named("ad", "ads", "advert", "promo", "sponsored", "banner")
            return self._some(f"<div{name}>{self._paragraph()}</div>", f"<div{name}><p>{self._sentence(200)}</p></div>")
        if pick == 7:
            name = self._named("cookie", "cookie-notice", "notice", "consent", "gdpr", "popup", "alert")
            return f"<div{name}><p>{self._sentence(200)}</p><button>OK</button></div>"
        if pick == 8:
            field = f"<label>{self._words(3)}</label><input type=text><button>{self._words(1)}</button>"
            return f"<form{self._named('newsletter', 'signup', 'search', 'login')}>{self._some('', f'<p>{self._sentence(150)}</p>')}{field}</form>"
        if pick in (9, 10):
            name, own = self._named("comments", "comment-list", "discussion", "replies", "disqus"), self._named("comment", "reply")
            one = self._some("<div{2}><b>{0}</b><p>{1}</p></div>", "<li{2}><p>{0}</p><p>{1}</p></li>", "<article{2}><h4>{0}</h4><p>{1}</p></article>",
                             "<div{2}><p><b>{0}</b> 12:30</p><p>{1}</p></div>", "<div{2}><h4>{0}</h4>{1}</div>")
            many = "".join(one.format(self._words(2), self._sentence(250), own) for _ in range(self._random.randint(2, 7)))
            tag = self._some("section", "div", "ol") if "<li" in one else self._some("section", "div")
            return f"<{tag}{name}>{self._some('', f'<h3>{self._words(1)}</h3>', '<h3>Comments</h3>')}{many}</{tag}>"
        if pick == 11:
            return f"<div{self._named('share', 'social', 'tags', 'breadcrumb', 'pagination')}>" + " ".join(f"<a href=x>{self._words(1)}</a>" for _ in range(n)) + "</div>"
        teaser = "".join(f"<div><h3><a href=x>{self._words(6)}</a></h3><p>{self._sentence(160)}</p></div>" for _ in range(self._some(2, 3, 4)))
        name = self._named("related", "recommended", "more", "trending", "popular")
        return f"<{(t := self._some('div', 'section'))}{name}><h2>{self._words(2)}</h2>{teaser}</{t}>"

    def _block(self) -> str:
        pick = self._random.random()
        if pick < 0.08:
            return f"<p data-y=1>{self._words(self._some(1, 1, 2, 3))}</p>"
        if pick < 0.72:
            return f"<p data-y=1>{self._paragraph()}" + self._some("</p>", "</p>", "</p>", "\n", "<br></p>")
        if pick < 0.82:
            return f"<{(t := self._some('h2', 'h3', 'h2'))} data-y=1>{self._words(6)}</{t}>"
        if pick < 0.88:
            return f"<{(t := self._some('ul', 'ol'))} data-y=1>" + "".join(f"<li data-y=1>{self._sentence(150)}</li>" for _ in range(4)) + f"</{t}>"
        if pick < 0.92:
            return f"<blockquote data-y=1><p data-y=1>{self._sentence()}</p></blockquote>"
        if pick < 0.95:
            return "<table>" + "".join(f"<tr><td data-y=1>{self._words(2)}</td><td data-y=1>{self._words(4)}</td></tr>" for _ in range(3)) + "</table>"
        if pick < 0.97:
            return f"<figure><figcaption data-y=1>{self._sentence(80)}</figcaption></figure>"
        return f"<div data-y=1>{self._paragraph()}</div>"

    def article(self) -> str:
        tag, name = self._some(
            ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' id="content"'), ("div", ' class="entry-content"'),
            ("div", ' class="post-body"'), ("div", ""), ("section", ' class="story"'), ("div", ' class="x7"'), ("div", ' role="main"'),
        )
        pick = self._random.random()
        if pick < 0.2:
            name = f' {self._some("class", "id")}="{self._any_name()}"'
        elif pick < 0.45:
            name = self._named("content", "post", "article", "main", "text", misleading=_OTHER_NAMES)
        title = self._some("<h1 data-y=1>{}</h1>", "<h1 data-y=1>{}</h1>", "<header><h1 data-y=1>{}</h1></header>", "").format(self._words(self._some(1, 2, 4, 8, 12)))
        blocks = [self._block() for _ in range(self._some(1, 2, 4, 7, 12, 20))]
        if self._random.random() < 0.25:
            blocks.insert(self._random.randint(0, len(blocks)), self.other())
        return f"<{tag}{name}>{title}{''.join(blocks)}</{tag}>"

    def page(self) -> str:
        top = [self.other() for _ in range(self._some(0, 1, 2, 3))]
        bottom = [self.other() for _ in range(self._some(0, 1, 2, 3))]
        middle = self.article()
        if self._random.random() < 0.2:
            middle = f"<div{self._around()}>{middle}</div>"
        for _ in range(self._some(0, 0, 1, 2)):
            beside = self.other()
            name = self._some("", ' class="row"', ' class="container"', ' id="wrapper"', self._around(), self._around())
            middle = f"<div{name}>{middle}{beside}</div>" if self._random.random() < 0.6 else f"<div{name}>{beside}{middle}</div>"
        return "<html><body>" + "".join([*top, middle, *bottom]) + "</body></html>"


def _runs(html: str) -> list[tuple[str]]:
    """Some runs of text of a page, chosen by hash from all of it."""
    found = sorted({text.strip() for text in _RUNS.findall(html)} - {""}, key=lambda text: (crc32(text.encode()), text))
    return [(text,) for text in found[:SAMPLE_RUNS]]


def learn(pages: DataFrame, html: str = "html", training_pages: int = TRAINING_PAGES) -> Model:
    """A model fitted to composed pages, whose texts come from at most ``SAMPLE_PAGES`` pages and
    ``SAMPLE_RUNS`` runs of each."""
    value = F.col(f"`{html}`").cast("string")
    sample = sample_by_hash(pages.select(value.alias("html")).where("html is not null"), SAMPLE_PAGES, "html")
    found = arrow.map_rows(sample, lambda part: [run for (page,) in part for run in _runs(page)], [pa.field("run", pa.string())], "run string")
    composer = Composer(sorted(row.run for row in found.collect()))
    return fit_pages([Page(composer.page()) for _ in range(training_pages)])


@lru_cache(maxsize=1)
def _model(key: str, broadcast) -> Model:
    return broadcast.value


def extract(pages: DataFrame, model: Model, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Rows ``page_id, url, text, n_chars``, one for each row of ``pages`` in any order.

    Character references are decoded, white space in a block becomes one blank, and blocks are
    joined by an empty line. A null or empty page, and one without any text, has an empty text.
    Broken markup is read as well as it can be, hidden elements are left out, very long pages are read
    within their row. Null or repeated ids keep their rows; other columns are not read or carried. An
    empty table gives an empty table.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    key = sha256(pickle.dumps(model)).hexdigest()

    def rows(part):
        use = _model(key, shared)
        read = [Page(value or "") for _, _, value in part]
        margins = use.margins(read)
        made, at = [], 0
        for (number, address, _), page in zip(part, read):
            text = page.text(margins[at : at + len(page.nodes)])
            at += len(page.nodes)
            made.append((number, address, text, len(text)))
        return made

    fields = [pa.field(page_id, pa.int64()), pa.field(url, pa.string()), pa.field("text", pa.string()), pa.field("n_chars", pa.int64())]
    return arrow.map_rows(
        pages.select(arrow.typed(pages, page_id, "bigint"), arrow.typed(pages, url, "string"), arrow.typed(pages, html, "string")),
        rows, fields, f"`{page_id}` bigint, `{url}` string, text string, n_chars bigint",
    )
