"""Block trees of web pages: which element holds which text, and what it looks like."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
MARKS = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")
# Elements without text for readers.
SILENT = {"noscript", "template", "head", "svg", "select", "button", "object", "canvas", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "iframe"}  # nor these, whose content is not markup
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
EMPTY = re.compile(r"""(?:^|[\s"'])/$""")  # end of the attributes of <path ... />
PAIRS = re.compile(
    rf"<!--.*?(?:-->|$)|<({'|'.join(sorted(RAW))})\b[^>]*>.*?(?:</\1\b|$)|<(/?)({'|'.join(sorted(SILENT))})(?![^\s/>])([^>]*)>", re.S | re.I
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "p": {"div", "article", "section", "li", "td", "body", "main", "aside"}}
# Words in class, id or role that speak against or for the main text.
AGAINST = {
    "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie", "cookies", "consent", "notice", "alert",
    "popup", "modal", "overlay", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "comment", "comments",
    "reply", "replies", "discussion", "disqus", "share", "sharing", "social", "related", "recommended", "footer", "header", "masthead",
    "login", "signup", "subscribe", "newsletter", "form", "search", "widget", "toolbar", "pagination", "tags", "complementary", "contentinfo",
}
FOR = {"article", "content", "main", "post", "entry", "story", "body", "text", "prose", "hentry"}
AGAINST_TAGS = {"nav", "footer", "aside", "form", "header", "dialog", "menu"}


def _left_open(page: str) -> set[int]:
    """Where silent elements start that have no end tag of their own."""
    opened: dict[str, list[int]] = {}
    for found in PAIRS.finditer(page, 0, page.rfind(">") + 1):
        tag = (found.group(3) or "").lower()
        if found.group(2):
            if opened.get(tag):
                opened[tag].pop()
        elif tag and not (tag == "svg" and EMPTY.search(found.group(4))):
            opened.setdefault(tag, []).append(found.start())
    return {start for starts in opened.values() for start in starts}


class Node:
    __slots__ = ("tag", "parent", "words", "chars", "linked", "sentence", "copyright", "mark", "against", "within")

    def __init__(self, tag, parent, words, mark, against, within):
        self.tag, self.parent, self.words, self.mark = tag, parent, words, mark
        self.against, self.within = against, within
        self.chars = self.linked = 0
        self.sentence = self.copyright = False


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes in page order, parents first; text blocks as (node, text)).

    Inline elements belong to the node around them. Tags left open or closed out
    of order are taken as browsers mostly do; a page cut short is read to its end.
    Silent elements are on the stack without a node and end with what holds them;
    one without an end tag ends at the next block as well. Time grows with the page,
    however deep its elements lie: the depths of open tags are kept by name.
    """
    nodes = [Node("#root", -1, (), None, False, False)]
    stack: list[tuple[str, int]] = [("#root", 0)]
    blocks: list[tuple[int, str]] = []
    parts: list[str] = []
    links = 0
    silent: list[tuple[int, bool]] = []  # depth in the stack, and whether the next block ends it
    endings: list[int] = []  # depths of those that it ends
    left_open = None
    depths: dict[str, list[int]] = {}  # of each open tag, and "" of all that are not inline
    at = 0

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append((stack_node(), text))

    def stack_node():
        return stack[-1][1]

    def push(tag, node):
        nonlocal links
        for name in (tag,) if tag in INLINE else (tag, ""):
            depths.setdefault(name, []).append(len(stack))
        stack.append((tag, node))
        links += tag == "a"

    def nearest(tags):
        return max([depths[t][-1] for t in tags if depths.get(t)], default=0)

    def close(depth):
        nonlocal links
        if not (silent and depth >= silent[0][0]) and any(tag not in INLINE or stack[depth - 1][1] != own for tag, own in stack[depth:]):
            flush()
        while silent and silent[-1][0] >= depth:
            if silent.pop()[1]:
                endings.pop()
        for tag, _ in stack[depth:]:
            for name in (tag,) if tag in INLINE else (tag, ""):
                depths[name].pop()
            links -= tag == "a"
        del stack[depth:]

    def say(raw):
        if silent and stack[-1][0] == "head" and raw.strip():
            close(silent[-1][0])
        if raw and not silent:
            text = html.unescape(raw) if "&" in raw else raw
            node = nodes[stack[-1][1]]
            n = len(text)
            node.chars += n
            if links > 0:
                node.linked += n
            parts.append(text)

    end, last = len(page), page.rfind(">") + 1  # no tag ends behind
    while at < end:
        found = TOKEN.search(page, at, last) if at < last else None
        if not found:
            comment = page.find("<!--", at)
            say(page[at : comment if comment >= 0 else end])
            break
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        tag = found.group(2)
        if tag is None:
            if found.group().startswith("<!--") and not found.group().endswith("-->"):
                break  # a comment to the end of the page
            continue
        tag = tag.lower()
        if found.group(1):
            depth = nearest((tag,))
            if depth and not (tag in INLINE and nearest(("",)) > depth):
                close(depth)
            continue
        if silent and stack[-1][0] == "head" and tag not in IN_HEAD:
            close(silent[-1][0])
        if tag in CLOSES_P or tag in BOUNDS or tag == "body":
            if endings:
                close(endings[0])
        if tag in RAW:
            if not silent:
                flush()
            closing = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, last)
            at = closing.end() if closing else end
            continue
        if tag in SILENT or silent:
            if tag in VOID or ((tag == "svg" or depths.get("svg")) and EMPTY.search(found.group(3))):
                continue
            if not silent and tag != "noscript":
                flush()
            if tag in SILENT:
                if left_open is None:
                    left_open = _left_open(page)
                silent.append((len(stack), tag != "head" and found.start() in left_open))
                if silent[-1][1]:
                    endings.append(len(stack))
            push(tag, stack[-1][1])
            continue
        if tag == "br" or tag == "hr":
            parts.append(" ")
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            depth = nearest(("p",))
            if depth > nearest(BOUNDS["p"]):
                close(depth)
        if tag in SIBLINGS:
            depth = nearest(SIBLINGS[tag])
            if depth > nearest(BOUNDS.get(tag, ())):
                close(depth)
        words, mark, around = (), None, nodes[stack[-1][1]]
        if found.group(3) and "=" in found.group(3):
            for kind, *values in MARKS.findall(found.group(3)):
                value = "".join(values).lower()
                if kind.lower() == "data-y":
                    mark = value == "1"
                else:
                    words += tuple(NAME.findall(value))
        against = tag in AGAINST_TAGS or not AGAINST.isdisjoint(words)
        if tag in INLINE and not against:
            push(tag, stack[-1][1])
            continue
        flush()
        within = tag in ("article", "main") or not FOR.isdisjoint(words)
        nodes.append(Node(tag, stack[-1][1], words, mark, against or around.against, within or around.within))
        push(tag, len(nodes) - 1)
    flush()
    for own, text in blocks:
        nodes[own].sentence |= text[-1:] in ".!?…。" or ". " in text
        nodes[own].copyright |= "©" in text
    return nodes, blocks


def features(nodes: list[Node]) -> list[list[str]]:
    """What each node shows: its tag, its parent's, its names, its text."""
    found = []
    for node in nodes:
        parent = nodes[node.parent] if node.parent >= 0 else node
        own = ["bias", "tag=" + node.tag, "parent=" + parent.tag]
        own.append(f"against={node.against} within={node.within}")
        if node.chars:
            share = node.linked / node.chars
            own.append("linked=" + ("none" if share == 0 else "some" if share < 0.5 else "most"))
            own.append("length=" + str(min(len(str(node.chars)), 4)))
            own.append(f"sentence={node.sentence}")
            if node.copyright:
                own.append("copyright")
        else:
            own.append("length=0")
        own += ["name=" + w for w in set(node.words) if w in AGAINST or w in FOR]
        found.append(own)
    return found
