"""Markup in a row: a small tree of a page, read leniently, and what is asked of it. Used inside Arrow functions only."""

from __future__ import annotations

import dataclasses
import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from html.parser import HTMLParser

#: Elements that begin a block (fixed values).
BLOCKS = frozenset(
    "address blockquote dialog div figure figcaption footer header legend main p pre search article aside h1 h2 h3 h4 h5 h6 hgroup nav section "
    "dd dl dt menu ol ul table caption colgroup col thead tbody tfoot tr td th".split()
)
#: Elements that are one segment whatever is in them, that are never translated, and that a translation keeps.
PRIORITY = ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote")
IGNORED = ("pre", "code")
RESERVED = ("img", "code", "br", "hr", "sub", "sup", "kbd", "abbr", "wbr", "var", "canvas", "svg", "script", "style", "math")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WIDE = re.compile("[\xa0\u3000]")
_SPACES = re.compile("[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROLS = re.compile("[\x00-\x1f\x7f-\xa0\xad]")


def trim(text: str) -> str:
    """trim_text() for a Python string."""
    text = _WIDE.sub(" ", text).replace("\u200b", "").replace("\ufeff", "")
    return _CONTROLS.sub("", _SPACES.sub(" ", text)).strip(" ")


def _quoted(value: str) -> str:
    return html.escape(value, quote=False).replace('"', "&quot;")


@dataclasses.dataclass(eq=False)
class Node:
    """An element, its attributes, and its children: elements and texts in order. Trees may be of any depth, so nothing
    here calls itself."""

    name: str
    attributes: dict[str, str] = dataclasses.field(default_factory=dict)
    children: list[Node | str] = dataclasses.field(default_factory=list)
    parent: Node | None = dataclasses.field(default=None, repr=False)

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        left = self.elements[::-1]
        while left:
            node = left.pop()
            yield node
            left += node.elements[::-1]

    def text(self) -> str:
        out, left = [], self.children[::-1]
        while left:
            c = left.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                left += c.children[::-1]
        return "".join(out)

    def markup(self, strict: bool = False) -> str:
        """As markup of a page: elements that are void by name close themselves. strict: as XML has it: elements without
        children do, but this one itself never."""
        out: list[str] = []
        left: list[tuple[str, Node | str]] = [("node", self)]
        while left:
            kind, c = left.pop()
            if isinstance(c, str):
                out.append(c if kind == "raw" else html.escape(c, quote=False))
                continue
            head = "".join(f' {k}="{_quoted(v)}"' for k, v in c.attributes.items() if k != "xmlns")
            if not c.children and (c is not self if strict else c.name in _VOID):
                out.append(f"<{c.name}{head}/>")
                continue
            out.append(f"<{c.name}{head}>")
            left.append(("raw", f"</{c.name}>"))
            inner = "raw" if c.name in ("script", "style") and not strict else "text"
            left += [(inner, x) for x in reversed(c.children)]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.names: Counter[str] = Counter()  # of the open elements

    def _close(self) -> str:
        name = self.open.pop().name
        self.names[name] -= 1
        return name

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and self.names["p"]:
            while self._close() != "p":
                pass
        elif self.open[-1].name in _CLOSES.get(tag, ()):
            self._close()
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.open[-1])
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open[-1].name == tag and tag not in _VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag]:
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        last = self.open[-1].children
        if last and isinstance(last[-1], str):
            last[-1] += data
        else:
            last.append(data)


def parse(text: str) -> Node:
    """The tree of a page. A block ends an open paragraph; what is never closed ends with what holds it."""
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def release(nodes: Iterable[Node]) -> None:
    """Take the links upward out of a tree that is used no more: without those circles its memory is free at once."""
    for n in nodes:
        n.parent = None


def body(root: Node) -> Node:
    return next((n for n in root.walk() if n.name == "body"), root)


_NAME = r"[\w-]|[^\x00-\x7f]|\\."
_ATTRIBUTE = r"\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]"
_PSEUDO = r":(first-child|last-child|only-child|first-of-type|last-of-type|only-of-type|empty|root)(?![\w(-])|:nth-child\(\s*(\d+|odd|even)\s*\)|:not\(([^()]*)\)"
_COMPOUND = re.compile(rf"(\*|(?:{_NAME})+)?((?:#(?:{_NAME})+|\.(?:{_NAME})+|{_ATTRIBUTE}|{_PSEUDO})*)")
_PART = re.compile(rf"#((?:{_NAME})+)|\.((?:{_NAME})+)|{_ATTRIBUTE}|{_PSEUDO}")
Test = Callable[[Node], bool]


def _siblings(n: Node) -> list[Node]:
    return n.parent.elements if n.parent else [n]


def _attribute(name: str, how: str | None, value: str) -> Test:
    tests: dict[str, Callable[[str], bool]] = {
        "": lambda x: True, "=": lambda x: x == value, "~=": lambda x: value in x.split(), "|=": lambda x: x == value or x.startswith(value + "-"),
        "^=": lambda x: bool(value) and x.startswith(value), "$=": lambda x: bool(value) and x.endswith(value), "*=": lambda x: bool(value) and value in x,
    }
    test = tests[how or ""]
    return lambda n: name in n.attributes and test(n.attributes[name])


def _pseudo(name: str | None, nth: str | None, inner: str | None) -> Test:
    if inner is not None:
        test = _complex(inner.strip())
        return lambda n: not test(n)
    if nth is not None:
        fits = {"odd": lambda k: k % 2 == 1, "even": lambda k: k % 2 == 0}.get(nth, lambda k: k == int(nth))
        return lambda n: fits(next(k for k, x in enumerate(_siblings(n), 1) if x is n))
    if name == "empty":
        return lambda n: not n.children
    if name == "root":
        return lambda n: n.parent is None or n.parent.parent is None
    alike = lambda n: [x for x in _siblings(n) if x.name == n.name or not name.endswith("type")]
    return {"first": lambda n: alike(n)[0] is n, "last": lambda n: alike(n)[-1] is n, "only": lambda n: len(alike(n)) == 1}[name.split("-")[0]]


def _compound(text: str) -> Test:
    m = _COMPOUND.fullmatch(text)
    if not m or not text:
        raise ValueError(f"no selector: {text}")
    tests: list[Test] = [] if m[1] in (None, "*") else [lambda n, name=m[1].lower(): n.name == name]
    for p in _PART.finditer(m[2]):
        id_, class_, attribute, how, *values = p.groups()[:7]
        pseudo = p.groups()[7:]
        if id_:
            tests.append(lambda n, x=id_: n.attributes.get("id") == x)
        elif class_:
            tests.append(lambda n, x=class_: x in n.attributes.get("class", "").split())
        elif attribute:
            tests.append(_attribute(attribute.lower(), how, next((v for v in values if v is not None), "")))
        else:
            tests.append(_pseudo(*pseudo))
    return lambda n: all(t(n) for t in tests)


def _complex(text: str) -> Test:
    """A chain of compounds with the combinators space, >, + and ~."""
    pieces = re.findall(r"\s*[>+~]\s*(?![^\[]*\])|\s+(?![^\[(]*[\])])|(?:\[[^\]]*\]|\([^()]*\)|[^\s>+~\[(]|[+~](?==))+", text)
    if not pieces or len(pieces) % 2 == 0:
        raise ValueError(f"no selector: {text}")
    test = _compound(pieces[0])
    for mark, piece in zip(pieces[1::2], pieces[2::2], strict=True):
        test = _after(test, mark.strip(), _compound(piece))
    return test


def _after(left: Test, mark: str, right: Test) -> Test:
    def above(n: Node) -> bool:
        p = n.parent
        while p is not None and p.name:
            if left(p):
                return True
            p = p.parent
        return False

    def before(n: Node) -> list[Node]:
        all_ = _siblings(n)
        return all_[: next(k for k, x in enumerate(all_) if x is n)]

    ways: dict[str, Test] = {
        "": above, ">": lambda n: n.parent is not None and bool(n.parent.name) and left(n.parent), "+": lambda n: bool(before(n)) and left(before(n)[-1]), "~": lambda n: any(map(left, before(n))),
    }
    return lambda n: right(n) and ways[mark](n)


def _alternatives(rules: Sequence[str]) -> Iterator[str]:
    for x in rules:
        yield from (r.strip() for r in re.findall(r"(?:\[[^\]]*\]|\([^()]*\)|[^,\[(])+", x))


def invalid_selectors(rules: Sequence[str]) -> list[str]:
    """Rules that selector() leaves out."""
    bad = []
    for rule in rules:
        try:
            whole = rule.count("[") == rule.count("]") and rule.count("(") == rule.count(")")
            for r in _alternatives([rule]) if whole and rule.strip() else [""]:
                _complex(r)
        except ValueError:
            bad.append(rule)
    return bad


def selector(rules: Sequence[str]) -> Test:
    """Whether an element matches one of the rules, which are selectors: names, #id, .class, [attribute] with or without a
    value, :not(), places among siblings, the combinators space, >, + and ~, and commas between alternatives. Other rules
    are left out; invalid_selectors() names them."""
    bad = set(invalid_selectors(rules))
    good = list(_alternatives([r for r in rules if r not in bad]))
    names = frozenset(r for r in good if re.fullmatch(r"[a-z][a-z0-9]*", r))  # most rules are a name
    tests = [_complex(r) for r in good if r not in names]
    return lambda n: n.name in names or any(t(n) for t in tests)


def segments(top: Node, priority: Callable[[Node], bool], ignore: Callable[[Node], bool]) -> list[tuple[Node, bool]]:
    """(element, ignored) of a body in document order. An element is a segment if it has priority, no block as a child,
    text of its own, or text behind a child; else its children are looked at. With nothing found the body is one."""

    if ignore(top):
        return []
    found: list[tuple[Node, bool]] = []
    left = top.elements[::-1]
    while left:
        c = left.pop()
        if ignore(c):
            found.append((c, True))
        elif priority(c) or not any(e.name in BLOCKS for e in c.elements) or any(isinstance(x, str) and x.strip() for x in c.children):
            found.append((c, False))
        else:
            left += c.elements[::-1]
    return found or [(top, False)]


def mask(node: Node, reserved: Callable[[Node], bool], noise: Callable[[Node], bool]) -> tuple[str, list[str]]:
    """The text of an element with placeholders for reserved elements, and their markup. Noise is left out. A sub or sup
    alone in a link stands for the link."""
    found: list[str] = []

    def lone(n: Node) -> bool:
        return n.name == "a" and len(n.children) == 1 and isinstance(n.children[0], Node) and n.children[0].name in ("sub", "sup") and reserved(n.children[0])

    out: list[str] = []
    left = node.children[::-1]
    while left:
        c = left.pop()
        if isinstance(c, str):
            out.append(c)
        elif noise(c):
            continue
        elif lone(c) or reserved(c):
            out.append("{{id_" + str(len(found)).zfill(5) + "}}")
            found.append(trim(c.markup(strict=True)))
        else:
            left += c.children[::-1]
    return trim("".join(out)), found


def attributes(node: Node) -> str | None:
    own = {k: v for k, v in node.attributes.items() if k != "xmlns"}
    return json.dumps(own) if own else None


def colour(node: Node, value: str) -> None:
    """Give a colour to an element and to all below that hold anything."""
    for n in [node, *node.walk()]:
        if n.children:
            n.attributes["style"] = f"color:{value}"


_CELLS = ("li", "th", "td", "caption")
_INLINE = ("a", "em", "strong", "small", "s", "cite", "q", "time", "samp", "i", "b", "u", "mark", "span", "data", "del", "ins")


def restored(translation: str, reserved: list[str]) -> list[Node | str]:
    """The children of a new element: the translation with reserved markup put back, and its line breaks."""
    out = html.escape(translation, quote=False)
    for k, m in enumerate(reserved):
        number = r"\s*".join(str(k).zfill(5))
        out = re.sub(r"(?:\{\s*)+id\s*_\s*" + number + r"\s*(?:\s*\})+", lambda _, m=m: m, out)
    out = re.sub(r"((\w)\2{3})\2*", r"\1", out.replace("\n", "<br/>"))
    return parse(out).children


def new_element(node: Node, name: str, children: list[Node | str], position: str, direction: str, lang: str | None, color: str | None, without: tuple[str, ...] = ()) -> Node:
    kept = {k: v for k, v in node.attributes.items() if not (k == "id" and position != "only") and k not in without}
    kept["dir"] = direction
    if lang is not None:
        kept["lang"] = lang
    if color is not None:
        kept["style"] = f"color:{color}"
    return Node(name, kept, children)


def _lines(children: list[Node | str]) -> list[list[Node | str]]:
    out: list[list[Node | str]] = [[]]
    for c in children:
        if isinstance(c, Node) and c.name == "br":
            out.append([])
        else:
            out[-1].append(c)
    return out


def _solid(line: list[Node | str]) -> bool:
    return any(isinstance(c, Node) or c.strip() for c in line)


def table(left: Node | None, right: Node | None, gap: tuple[str, int] | None) -> Node:
    """Original and translation side by side. gap: ('percentage', share) or ('space_count', spaces), 10 % if None."""
    unit, value = gap or ("percentage", 10)
    side = "50%" if unit != "percentage" else f"{round((100 - value) / 2)}%"
    middle = Node("td", {} if unit != "percentage" else {"width": f"{value}%"}, ["\xa0" * value] if unit != "percentage" else [])
    cell = lambda n: Node("td", {"valign": "top", "width": side}, [n] if n else [])
    return Node("table", {"width": "100%"}, [Node("tr", {}, [cell(left), middle, cell(right)])])


def place(parent: Node, node: Node, translation: str | None, reserved: list[str], position: str = "below", direction: str = "auto", lang: str | None = None, color: str | None = None, gap: tuple[str, int] | None = None) -> None:
    """Put a translation beside an element of parent: below, above, left, right, or only (in its place).

    Cells and list items hold it inside, as a span. Left and right make a table of two columns, but for inline elements,
    which get it before or behind them. Above and below interleave the lines of an element whose line breaks are as many
    as the translation's."""
    at = next(k for k, c in enumerate(parent.children) if c is node)
    before = position in ("left", "above")
    inline = node.name in _INLINE
    if translation is None:
        if position in ("left", "right"):
            parent.children[at] = table(node if position == "right" else None, node if position == "left" else None, gap)
        return
    children = restored(translation, reserved)
    make = lambda name, kids, without=(): new_element(node, name, kids, position, direction, lang, color, without)
    if position == "only":
        parent.children[at] = make(node.name, children)
    elif node.name in _CELLS:
        span, joint = make("span", children, ("class",)), Node("br") if position in ("above", "below") else " "
        if before:
            node.children = [span, *([joint] if node.children and isinstance(node.children[0], str) else []), *node.children]
        else:
            node.children += [joint, span]
    elif position in ("left", "right") and not inline:
        new = make(node.name, children)
        parent.children[at] = table(*((new, node) if position == "left" else (node, new)), gap)
    elif position in ("above", "below") and (n := sum(c.name == "br" for c in node.walk())) and n == sum(isinstance(c, Node) and c.name == "br" for c in children) and n == sum(c.name == "br" for c in node.elements):
        out: list[Node | str] = []
        for k, (old, new) in enumerate(zip(_lines(node.children), _lines(children), strict=True)):
            span = Node("span", {"dir": direction, **({"lang": lang} if lang else {}), **({"style": f"color:{color}"} if color else {})}, new)
            pair = [old, [span]] if _solid(new) else [old]
            for j, part in enumerate(pair if position == "below" else pair[::-1]):
                out += [Node("br")] * (bool(k) or bool(j)) + part
        node.children = out
    else:
        new = make(node.name, children)
        joint = [Node("br")] if inline and parent.name in _CELLS else [" "] if inline else []
        parent.children[at : at + 1] = [new, *joint, node] if before else [node, *joint, new]
