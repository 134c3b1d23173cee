"""A small document tree for pages, on the standard library's HTML parser.

Selectors: tag, .class, #id, [attr], [attr=v], [attr*=v], :not(simple), descendants and commas.
"""

from __future__ import annotations

import re
from functools import cache
from html import escape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style"}
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

Gone = frozenset[int]


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self, gone: Gone = frozenset()):
        """Elements below this one in document order, without those ``gone`` and what they hold."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            if id(node) not in gone:
                yield node
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, gone: Gone = frozenset()) -> str:
        parts, stack = [], list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag != "!" and id(x) not in gone:
                stack += reversed(x.children)
        return "".join(parts)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if self.at.tag in CLOSES.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_PART = re.compile(r"""([.#]?)([\w-]+)|\[\s*([\w-]+)\s*(?:(\*?=)\s*["']?([^"'\]]*)["']?)?\s*\]|:not\(([^)]*)\)|(\*)""")


@cache
def _compiled(selector: str) -> tuple:
    """Alternatives; each a chain of simple selectors, the last first."""
    groups = []
    for alternative in re.split(r",(?![^\[(]*[\])])", selector):
        chain = []
        for simple in re.findall(r"""(?:\[[^\]]*\]|\([^)]*\)|[^\s\[(])+""", alternative.strip()):
            tests = []
            for kind, name, attr, op, value, inner, star in _PART.findall(simple):
                if inner:
                    tests.append(("not", _compiled(inner), ""))
                elif attr:
                    tests.append(("attr", attr, (op, value)))
                elif not star:
                    tests.append(({"": "tag", ".": "class", "#": "id"}[kind], name, ""))
            chain.append(tests)
        groups.append(chain[::-1])
    return tuple(groups)


def _fits(node: Node, tests: list) -> bool:
    for kind, a, b in tests:
        if kind == "tag" and node.tag != a.lower() or kind == "class" and a not in node.attrs.get("class", "").split() or kind == "id" and node.attrs.get("id") != a:
            return False
        if kind == "not" and _matches(node, a):
            return False
        if kind == "attr":
            value = node.attrs.get(a)
            if value is None or b[0] == "=" and value != b[1] or b[0] == "*=" and b[1] not in value:
                return False
    return True


def _matches(node: Node, groups: tuple) -> bool:
    for last, *above in groups:
        if not _fits(node, last):
            continue
        up = node.parent
        for tests in above:
            while up is not None and not _fits(up, tests):
                up = up.parent
            if up is None:
                break
            up = up.parent
        else:
            return True
    return False


@cache
def _keyed(selectors: tuple[str, ...]) -> tuple[dict, dict, list]:
    """Alternatives by the tag, else by an attribute that a node must have to fit them; the others."""
    tags, names, rest = {}, {}, []
    for selector in selectors:
        for group in _compiled(selector):
            kind, name = next(((k, a) for k, a, _ in group[0] if k != "not"), ("", ""))
            if kind == "tag":
                tags.setdefault(name.lower(), []).append(group)
            elif kind:
                names.setdefault(name if kind == "attr" else kind, []).append(group)
            else:
                rest.append(group)
    return tags, names, rest


def _found(root: Node, selectors: tuple[str, ...], gone: Gone = frozenset()):
    """What any of the selectors finds, in one walk; most nodes have neither tag nor attribute of any of them."""
    tags, names, rest = _keyed(selectors)
    for node in root.walk(gone):
        if (
            (node.tag in tags and _matches(node, tags[node.tag]))
            or (node.attrs and any(name in names and _matches(node, names[name]) for name in node.attrs))
            or (rest and _matches(node, rest))
        ):
            yield node


def select(root: Node, selector: str, gone: Gone = frozenset()) -> list[Node]:
    return list(_found(root, (selector,), gone))


def marked(root: Node, *selectors: str) -> Gone:
    """What the selectors find, to be left out by readers of the tree; the tree itself stays as it is."""
    return frozenset(map(id, _found(root, selectors)))


def to_html(node: Node, gone: Gone = frozenset(), kept: tuple[str, ...] | None = None) -> str:
    """Markup of what lies below a node, without elements ``gone`` and with the ``kept`` attributes (all, if null)."""
    parts: list[str] = []
    stack: list = list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            parts.append(x[0])
        elif isinstance(x, str):
            parts.append(escape(x, quote=False))
        elif id(x) not in gone:
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items() if kept is None or k in kept)
            parts.append(f"<{x.tag}{attrs}>")
            if x.tag not in VOID:
                stack.append((f"</{x.tag}>",))
                stack += [(c,) if x.tag in RAW and isinstance(c, str) else c for c in reversed(x.children)]
    return "".join(parts)
