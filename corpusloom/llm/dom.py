"""HTML to trees: a tokenizer after the HTML standard, linear in the text, and folded trees for wrapper induction.

No step recurses, so depth is bounded by memory only. Where the standard drops text at the end of a broken page, it is kept:
a tag whose quote never closes ends at its first ">", and a "<" that no tag follows ("<b and c" before the next "<") is text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from functools import lru_cache

#: Fixed values of the HTML standard: elements without content, with raw content, that break lines, and that close a <p>.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "caption", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
STOP = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "nav", "aside", "body", "select", "blockquote", "form"}
_NAME = re.compile(r"</?([a-zA-Z][^\t\n\f\r />\0<]*+)")
#: One attribute after white space and slashes: group 1 ends the tag; 2 is a name; 3, 4, 5 a value; 6 a quote that never closes.
_PART = re.compile(
    r"[\t\n\f\r /]*+(?:(>)|([^\t\n\f\r />][^\t\n\f\r />=]*+)"
    r"(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\t\n\f\r >\"'][^\t\n\f\r >]*+)|(?=>)|([\"'])))?+)?+"
)
#: Tags, comments and declarations that the end of the text cuts off.
_CUT_OFF = re.compile(r"</[a-zA-Z][^<]*+|<[a-zA-Z][^\s<=]*+(?:(?=<)|\Z|\s[^<=]*+=[^<]*+)|<[!?].*+", re.S)
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\t\n\f\r />])", re.I) for t in RAW}


class Node:
    """An element; children are Nodes and, for text, strings (character references decoded)."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    @property
    def signature(self) -> str:
        return _signature(self.tag, self.attrs.get("class", ""), self.attrs.get("id", "")) if self.attrs else self.tag


@lru_cache(maxsize=65536)
def _signature(tag: str, kind: str, name: str) -> str:
    kinds = re.sub(r"\d+", "", kind).split()
    name = "".join(re.sub(r"\d+", "", name).split())
    return ".".join([tag, *sorted(kinds)]) + (f"#{name}" if name else "")


def tokens(text: str):
    """(kind, value, attributes): "text", "start", "end" or "raw" (the content of a RAW element), in order."""
    at, size, last_end, broken = 0, len(text), text.rfind(">"), False
    while at < size:
        lt = text.find("<", at)
        if lt < 0 or lt > last_end:
            yield "text", _CUT_OFF.sub("", text[at:]), None
            return
        if lt > at:
            yield "text", text[at:lt], None
        after = text[lt + 1 : lt + 2]
        if after in ("!", "?") or (after == "/" and not (text[lt + 2 : lt + 3].isascii() and text[lt + 2 : lt + 3].isalpha())):
            if text.startswith("<!--", lt):
                if text.startswith((">", "->"), lt + 4):
                    at = text.index(">", lt) + 1
                else:
                    found = _COMMENT_END.search(text, lt + 4)
                    at = found.end() if found else size
            else:
                at = text.index(">", lt) + 1
            continue
        name = _NAME.match(text, lt)
        if not name:
            yield "text", "<", None
            at = lt + 1
            continue
        tag, end, attrs, valued, at = name[1].lower(), after == "/", {}, False, name.end()
        if broken:
            found = text.index(">", at)
            attrs, at = _attributes(text[at:found]), found + 1
        else:
            start = at
            while True:
                part = _PART.match(text, at)
                at = part.end()
                if part[1]:
                    break
                if part[2] is None or part[6]:  # the text ends within the tag, or a quote never closes
                    broken = part[2] is None
                    found = text.index(">", start)
                    attrs, at = _attributes(text[start:found]), found + 1
                    break
                if "<" in part[2] and not valued:
                    at, tag = part.start(2) + part[2].index("<"), ""
                    yield "text", text[lt:at], None
                    break
                value = part[3] if part[3] is not None else part[4] if part[4] is not None else part[5]
                valued = valued or value is not None
                attrs.setdefault(part[2].lower(), html.unescape(value) if value else "")
        if not tag:
            continue
        yield ("end" if end else "start"), tag, attrs
        if not end and tag in RAW:
            found = _RAW_END[tag].search(text, at)
            to = found.start() if found else size
            yield "raw", text[at:to], None
            at = to


def _attributes(text: str) -> dict[str, str]:
    """Names and values of a tag that ends at its first ">"; an open quote is dropped."""
    out, at = {}, 0
    while at < len(text):
        part = _PART.match(text, at)
        if part[2] is None:
            break
        value = part[3] if part[3] is not None else part[4] if part[4] is not None else part[5]
        if part[6]:
            value, at = text[part.end() :], len(text)
        else:
            at = part.end()
        out.setdefault(part[2].lower(), html.unescape(value) if value else "")
    return out


def parse(text: str) -> Node:
    root = Node("#root")
    stack, held = [root], Counter()

    def close(to: int) -> None:
        for n in stack[to:]:
            held[n.tag] -= 1
        del stack[to:]

    for kind, value, attrs in tokens(text):
        if kind == "text":
            stack[-1].children.append(html.unescape(value))
            continue
        if kind == "raw":
            stack[-1].children.append(value)
            close(len(stack) - 1)
            continue
        tag = value
        if kind == "end":
            if held[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if tag not in BLOCK and stack[i].tag in STOP:
                        break
            continue
        if held["p"] and tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in SAME and any(held[t] for t in SAME[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SAME[tag]:
                    close(i)
                    if tag not in ("tr", "tbody"):
                        break
                elif stack[i].tag in STOP:
                    break
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            held[tag] += 1
    return root


@lru_cache(maxsize=65536)
def _below(path: int, signature: str) -> int:
    digest = hashlib.blake2b(signature.encode("utf-8", "replace"), digest_size=8, key=path.to_bytes(8, "little")).digest()
    return int.from_bytes(digest, "little") >> 1


class Folded:
    """A tree in which siblings of one signature are one iterator node, in preorder: path (a hash of the signatures from the root
    down), own (a hash of the text below, 0 without any), chars and linked (characters below, and those in links), anchors, members.

    Siblings of a folded tree differ in their signatures, so simple tree matching of two such trees pairs the nodes of equal path."""

    def __init__(self, root: Node):
        self.path, self.members, parent, depth_first = [], [], [], [(_below(0, "#root"), [root], -1)]
        texts: list[list[str]] = []
        self.chars, self.linked, self.anchors = [], [], []
        while depth_first:
            path, nodes, above = depth_first.pop()
            at = len(self.path)
            groups: dict[str, list[Node]] = {}
            own = []
            for n in nodes:
                for c in n.children:
                    if isinstance(c, str):
                        if s := " ".join(c.split()):
                            own.append(s)
                    else:
                        groups.setdefault(c.signature, []).append(c)
            self.path.append(path)
            self.members.append(nodes)
            parent.append(above)
            texts.append(own)
            self.chars.append(sum(map(len, own)))
            self.linked.append(0)
            self.anchors.append(len(nodes) if nodes[0].tag == "a" else 0)
            depth_first.extend((_below(path, s), g, at) for s, g in reversed(groups.items()))
        self.own = [0] * len(self.path)
        digests: list[list[bytes]] = [[] for _ in self.path]
        for i in range(len(self.path) - 1, -1, -1):
            if self.members[i][0].tag == "a":
                self.linked[i] = self.chars[i]
            if texts[i] or digests[i]:
                hashed = hashlib.blake2b("\n".join(texts[i]).encode("utf-8", "replace"), digest_size=8)
                for d in reversed(digests[i]):
                    hashed.update(d)
                digest = hashed.digest()
                self.own[i] = (int.from_bytes(digest, "little") >> 1) or 1
                if parent[i] >= 0:
                    digests[parent[i]].append(digest)
            if parent[i] >= 0:
                self.chars[parent[i]] += self.chars[i]
                self.linked[parent[i]] += self.linked[i]
                self.anchors[parent[i]] += self.anchors[i]


def text_blocks(node: Node, skip, out: list[str]) -> list[str]:
    """Texts of the blocks below node in page order, white space as one space; skip(node) leaves a subtree out."""
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo = [(iter(node.children), False)]
    while todo:
        children, block = todo[-1]
        for c in children:
            if isinstance(c, str):
                line.append(c)
            elif skip(c):
                if c.tag in BLOCK:
                    flush()
            elif c.tag == "br":
                line.append(" ")
            else:
                inner = c.tag in BLOCK
                if inner:
                    flush()
                todo.append((iter(c.children), inner))
                break
        else:
            todo.pop()
            if block:
                flush()
    flush()
    return out
