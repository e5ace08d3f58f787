"""A small tolerant reader of HTML: block elements, their inline text, and numbers about them."""

import re
from html import unescape

#: Element names by kind.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of a page.
UNSEEN = frozenset(
    "script style template noscript svg math iframe object canvas audio video select textarea button title head datalist".split()
)
#: Of those, the ones that hold no elements and run to the end of a page where they
#: never end; elements that can stand in a head.
RAW = frozenset("script style textarea title".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript template html head".split())
#: Which open elements a start tag ends, up to the nearest of the second group.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?|[^<]+|<""",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role|itemprop|aria-label|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=]|$)(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    """A block element, or a run of inline text between block elements (``tag`` is ``#``)."""

    __slots__ = ("tag", "parent", "depth", "tokens", "text", "links", "inline", "inputs", "children", "wanted", "hidden")

    def __init__(self, tag: str, parent: "Node | None", tokens: list[str], wanted: bool = False, hidden: bool = False):
        self.tag, self.parent, self.tokens, self.wanted, self.hidden = tag, parent, tokens, wanted, hidden
        self.depth = 0 if parent is None else parent.depth + 1
        self.text: list[str] = []  # of runs alone
        self.links = self.inline = self.inputs = 0
        self.children: list[Node] = []
        if parent is not None:
            parent.children.append(self)


def attribute_tokens(attributes: str) -> tuple[list[str], bool]:
    """Lower-cased words of the class, id, role and like attributes, and the training mark."""
    words, wanted = [], False
    for name, value in _NAMED.findall(attributes):
        if name.lower() == "data-y":
            wanted = True
        else:
            words += [word.lower() for word in _SPLIT.findall(value)]
    return words, wanted


def parse(page: str) -> Node:
    """The tree of block elements below a root; it never fails, whatever the markup."""
    root = Node("html", None, [])
    blocks, open_tags, run, anchors = [root], ["html"], None, 0
    runs: list[Node | None] = []  # what each open unseen element interrupts
    at, size = 0, len(page)

    def end(tag: str) -> None:
        while open_tags[-1] != tag:
            leave()
        leave(True)

    def leave(closed: bool = False) -> None:
        nonlocal run, anchors
        gone = open_tags.pop()
        if gone in UNSEEN:
            # The node is no child of any. Without an end tag of its own, it holds no more than
            # what stands before its first block.
            node, run = blocks.pop(), runs.pop()
            first = next((i for i, child in enumerate(node.children) if child.tag != "#"), None)
            if not closed and first is not None:
                for child in node.children[first:]:
                    child.parent = blocks[-1]
                blocks[-1].children += node.children[first:]
                run = None
        elif gone in BLOCKS:
            blocks.pop()
            run = None
        elif gone == "a":
            anchors -= 1

    while at < size:
        found = _TOKEN.match(page, at)
        at = found.end()
        slash, tag, attributes = found.group(1), found.group(2), found.group(3)
        if tag is None:
            slash, tag, attributes = found.group(4), found.group(5), found.group(6)
        if tag is None:
            piece = found.group()
            if piece[0] == "<" and len(piece) > 1:
                continue
            if open_tags[-1] == "head" and piece.strip():
                leave()
            if run is None:
                if not piece.strip():
                    continue
                run = Node("#", blocks[-1], [])
            piece = unescape(piece) if "&" in piece else piece
            run.text.append(piece)
            if anchors:
                run.links += len(piece)
            continue
        tag = tag.lower()
        if slash:
            if tag in open_tags[1:] and tag not in ("html", "body"):
                end(tag)
            elif tag == "br" and run is not None:
                run.text.append(" ")
            continue
        if open_tags[-1] == "head" and tag not in HEAD:
            leave()
        if tag in UNSEEN:
            if tag in ("select", "button") and tag in open_tags:
                while tag in open_tags:
                    leave()
            if tag in ("select", "textarea", "button"):
                blocks[-1].inputs += 1
            if tag in RAW:
                if not attributes.endswith("/"):
                    at = _skip(page, at, tag)
            elif not attributes.endswith("/") and not (tag == "head" and tag in open_tags):
                node = Node(tag, None, [])
                node.depth = blocks[-1].depth  # that of its children where they go to its parent
                blocks.append(node)
                open_tags.append(tag)
                runs.append(run)
                run = None
            continue
        if tag in ("html", "body"):
            root.tokens += attribute_tokens(attributes)[0]
            continue
        if tag in BLOCKS:
            if "p" in open_tags and not (runs and _unseen_above("p", open_tags)):
                end("p")
            if tag in CLOSES:
                closed, limits = CLOSES[tag]
                for name in reversed(open_tags):
                    if name in limits or name in UNSEEN:
                        break
                    if name in closed:
                        end(name)
                        if tag not in ("tr", "tbody"):
                            break
            tokens, wanted = attribute_tokens(attributes) if attributes else ([], False)
            run = None
            if tag not in VOID:
                hidden = bool(attributes) and _HIDDEN.search(attributes) is not None
                blocks.append(Node(tag, blocks[-1], tokens, wanted, hidden))
                open_tags.append(tag)
            continue
        if tag in VOID:
            if tag == "br":
                if run is not None:
                    run.text.append(" ")
            elif tag == "input":
                blocks[-1].inputs += 1
            continue
        if run is not None:
            run.inline += 1
        if not attributes.endswith("/"):
            open_tags.append(tag)
            anchors += tag == "a"
    while len(open_tags) > 1:
        leave()
    return root


def _unseen_above(tag: str, open_tags: list[str]) -> bool:
    """Whether an unseen element was opened after the last ``tag``."""
    return next(name for name in reversed(open_tags) if name == tag or name in UNSEEN) != tag


_ENDS: dict[str, re.Pattern] = {}


def _skip(page: str, at: int, tag: str) -> int:
    """Where the content of an element without elements ends; one that never ends holds the rest of the page."""
    pattern = _ENDS.get(tag)
    if pattern is None:
        pattern = _ENDS[tag] = re.compile(rf"</{tag}\b[^>]*>", re.I)
    found = pattern.search(page, at)
    return found.end() if found else len(page)
