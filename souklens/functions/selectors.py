"""CSS selectors over a parsed page: tags, ids, classes, attributes, places among siblings; descendants, children, siblings, lists.

A selector is matched once for a whole page, compound by compound from the left. Elements count in page order and an
element's descendants are the numbers up to its end, so "within one of these" is a look into a running maximum of ends.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_PART = re.compile(
    rf"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})
    |\[\s*(?P<attr>[\w:.-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s"']+))\s*(?P<ci>[iI])?\s*)?\]
    |:(?P<place>first|last|only)-(?P<kind>child|of-type)|:nth-(?P<nth>child|of-type|last-child|last-of-type)\(\s*(?P<arg>[^()]*?)\s*\)|:not\((?P<no>[^()]*)\)""",
    re.X,
)
_BETWEEN = re.compile(r"\s*([>+~])\s*|\s+")


@dataclass
class Compound:
    """What one element must be. relation: to the element matched by the compound before it."""

    relation: str = ""
    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str | None, str, bool]] = field(default_factory=list)
    places: list[tuple[bool, bool, int, int]] = field(default_factory=list)  # of its tag, from the end, and a, b of an + b
    never: list[Compound] = field(default_factory=list)


def _formula(arg: str) -> tuple[int, int]:
    arg = re.sub(r"\s+", "", arg.lower())
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not arg or m is None:
        raise ValueError(f"no place: {arg}")
    a = {None: 0, "": 1, "+": 1, "-": -1}.get(m[1], None)
    return int(m[1]) if a is None else a, int(m[2] or 0)


def _compound(text: str, at: int, relation: str) -> tuple[Compound, int]:
    c, plain = Compound(relation), lambda s: re.sub(r"\\(.)", r"\1", s)
    begin = at
    while at < len(text) and (m := _PART.match(text, at)):
        if m["tag"]:
            if at > begin:
                break
            c.tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["id"]:
            c.ids.append(plain(m["id"]))
        elif m["cls"]:
            c.classes.append(plain(m["cls"]))
        elif m["attr"]:
            c.attrs.append((m["attr"].lower(), m["op"], m["dq"] if m["dq"] is not None else m["sq"] if m["sq"] is not None else m["bare"] or "", bool(m["ci"])))
        elif m["place"]:
            of_type = m["kind"] == "of-type"
            c.places += [(of_type, end, 0, 1) for end in (False, True) if m["place"] in ("only", "last" if end else "first")]
        elif m["nth"]:
            c.places.append((m["nth"].endswith("of-type"), m["nth"].startswith("last"), *_formula(m["arg"])))
        else:
            for part in m["no"].split(","):
                inner, end = _compound(part.strip(), 0, "")
                if end != len(part.strip()):
                    raise ValueError(f"no selector: {part}")
                c.never.append(inner)
        at = m.end()
    if at == begin:
        raise ValueError(f"no selector: {text[at:at + 40]!r}")
    return c, at


@lru_cache(4096)
def parse_selector(text: str) -> tuple[tuple[Compound, ...], ...]:
    """The alternatives of a selector, each a chain of compounds; ValueError for what isn't one of the forms above."""
    out, at, chain, relation = [], 0, [], ""
    text = text.strip()
    while True:
        c, at = _compound(text, at, relation)
        chain.append(c)
        comma = re.compile(r"\s*,\s*").match(text, at)
        if at == len(text) or comma:
            out.append(tuple(chain))
            if at == len(text):
                return tuple(out)
            at, chain, relation = comma.end(), [], ""
        elif m := _BETWEEN.match(text, at):
            at, relation = m.end(), m[1] or " "
        else:
            raise ValueError(f"no selector: {text[at:at + 40]!r}")


def _attribute(value: str | None, op: str | None, want: str, blind: bool) -> bool:
    if value is None or op is None:
        return value is not None
    if blind:
        value, want = value.lower(), want.lower()
    if op == "=":
        return value == want
    if op == "|=":
        return value == want or value.startswith(want + "-")
    if op == "~=":
        return bool(want) and want in value.split()
    return bool(want) and {"^=": value.startswith, "$=": value.endswith, "*=": value.__contains__}[op](want)


class Matcher:
    """Selectors over one page (its elements in page order, their children and ends)."""

    def __init__(self, tree) -> None:
        self.tree, self.known = tree, {}
        self.by: dict[tuple[str, str], list[int]] = {}
        for n, _, _, tag, attrs, _ in tree.nodes:
            for key in [("tag", tag), *(("cls", c) for c in set(attrs.get("class", "").split()))]:
                self.by.setdefault(key, []).append(n)
        self.places: dict[tuple[bool, bool], list[int]] = {}

    def _siblings(self, n: int) -> list[int]:
        parent = self.tree.nodes[n][1]
        return self.tree.children[parent] if parent is not None else self.roots

    @property
    def roots(self) -> list[int]:
        return [n for n, x in enumerate(self.tree.nodes) if x[1] is None]

    def _place(self, of_type: bool, end: bool) -> list[int]:
        """Of each element its place among its siblings, from 1."""
        if (of_type, end) not in self.places:
            out = [0] * len(self.tree.nodes)
            for family in [self.roots, *self.tree.children]:
                seen: dict[str, int] = {}
                for n in reversed(family) if end else family:
                    tag = self.tree.nodes[n][3] if of_type else ""
                    out[n] = seen[tag] = seen.get(tag, 0) + 1
            self.places[of_type, end] = out
        return self.places[of_type, end]

    def _is(self, n: int, c: Compound) -> bool:
        tag, attrs = self.tree.nodes[n][3], self.tree.nodes[n][4]
        if c.tag not in (None, tag) or any(attrs.get("id") != i for i in c.ids):
            return False
        if c.classes and not set(c.classes) <= set(attrs.get("class", "").split()):
            return False
        if not all(_attribute(attrs.get(name), *rest) for name, *rest in c.attrs):
            return False
        for of_type, end, a, b in c.places:
            k = self._place(of_type, end)[n] - b
            if k != 0 if a == 0 else k % a != 0 or k // a < 0:
                return False
        return not any(self._is(n, x) for x in c.never)

    def _related(self, found: list[int], before: list[int], relation: str) -> list[int]:
        if relation == " ":
            far = list(accumulate((self.tree.end[b] for b in before), max))
            return [n for n in found if (k := bisect_left(before, n)) and far[k - 1] > n]
        held = set(before)
        if relation == ">":
            return [n for n in found if self.tree.nodes[n][1] in held]
        out = []
        for n in found:
            family = self._siblings(n)
            k = bisect_left(family, n)
            if family[k - 1] in held if relation == "+" and k else relation == "~" and any(s in held for s in family[:k]):
                out.append(n)
        return out

    def find(self, selector: str) -> list[int]:
        """All elements that match, in page order."""
        if selector not in self.known:
            hits: set[int] = set()
            for chain in parse_selector(selector):
                before: list[int] = []
                for c in chain:
                    some = self.by.get(("cls", c.classes[0]), []) if c.classes else self.by.get(("tag", c.tag), []) if c.tag else range(len(self.tree.nodes))
                    found = [n for n in some if self._is(n, c)]
                    before = self._related(found, before, c.relation) if c.relation else found
                hits.update(before)
            self.known[selector] = sorted(hits)
        return self.known[selector]

    def first_within(self, selector: str, root: int) -> int | None:
        """The first match below an element; the selector may speak of what is above it."""
        found = self.find(selector)
        k = bisect_left(found, root + 1)
        return found[k] if k < len(found) and found[k] < self.tree.end[root] else None
