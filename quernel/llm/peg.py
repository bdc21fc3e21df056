"""Packrat parsing expression grammars over token strings.

A source becomes a string with one character a token (``Tokens``); a grammar (``Grammar``) is written in
the usual notation::

    rule <- 'if' expr block ('else' block)? / other+      # ordered choice, greedy repetition
    look <- &'(' !KEYWORD .                                # predicates, any token

where 'x' is the token spelled x, an upper-case name a class of tokens and a lower-case name a rule. A
rule may end in ``@ 'x'``: a match that ends at the first token x after its start is remembered across
sources under the tokens it spans, so a statement of a shape seen before costs one look-up. The
rule must not look beyond that token on the way to such a match.

Rules that don't recurse are turned into atomic, possessive regular expressions, which follow the same
choice and repetition rules; the others are memoised per source (packrat). Where a source does not match
to its end, it is parsed again without regular expressions to find the furthest failure.
"""

from __future__ import annotations

import re
from collections.abc import Callable

IDENT, NUMBER, STRING = "i", "0", "s"
_META = re.compile(r"\s*(?:#[^\n]*|(<-)|'((?:[^'\\]|\\.)+)'|([a-z_]\w*)|([A-Z]\w*)|([/*+?&!().@]))")
#: Look-ups kept across sources, for each grammar.
SHAPES = 400_000


class Tokens:
    """The token alphabet of a language: words and operators of several characters get a character each."""

    def __init__(self, words: str, operators: str, soft: str = ""):
        self.code: dict[str, str] = {}
        for k, w in enumerate((words + " " + operators + " " + soft).split()):
            self.code[w] = chr(0xE000 + k)
        self.words = {w: self.code[w] for w in (words + " " + soft).split()}
        self.soft = "".join(self.code[w] for w in soft.split())
        self.operators = sorted(operators.split(), key=len, reverse=True)

    def of(self, spelled: str) -> str:
        return self.code.get(spelled, spelled)


class Grammar:
    def __init__(self, text: str, tokens: Tokens, classes: dict[str, str] | None = None):
        self.tokens = tokens
        self.classes = {"IDENT": IDENT + tokens.soft, "NUMBER": NUMBER, "STRING": STRING} | {k: "".join(tokens.of(x) for x in v.split()) for k, v in (classes or {}).items()}
        self.rules: dict[str, tuple] = {}
        self.until: dict[str, str] = {}
        self._read(text)
        self.names = list(self.rules)
        self.regular = self._regular()
        self._regex: dict[str, str] = {}
        self.shapes: dict[str, set[str]] = {name: set() for name in self.until}
        self.fast, self.slow = self._build(True), self._build(False)

    # -- reading the notation
    def _read(self, text: str) -> None:
        items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _META.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at:at + 40]!r}")
            at = m.end()
            arrow, literal, rule, kind, sign = m.groups()
            if arrow:
                items.append(("arrow", None))
            elif literal:
                items.append(("lit", self.tokens.of(literal.replace("\\n", "\n"))))
            elif rule:
                items.append(("rule", rule))
            elif kind:
                items.append(("set", self.classes[kind]))
            elif sign:
                items.append(("sign", sign))
        starts = [k - 1 for k, x in enumerate(items) if x[0] == "arrow"]
        for a, b in zip(starts, [*starts[1:], len(items)], strict=True):
            name, body = items[a][1], items[a + 2 : b]
            if len(body) > 2 and body[-2] == ("sign", "@"):
                self.until[name], body = body[-1][1], body[:-2]
            node, rest = self._choice(body)
            if rest:
                raise ValueError(f"grammar: rule {name} has {rest[:3]} left")
            self.rules[name] = node
        used = {x[1] for x in items if x[0] == "rule"}
        if used - set(self.rules):
            raise ValueError(f"grammar: no rules {used - set(self.rules)}")

    def _choice(self, items: list) -> tuple[tuple, list]:
        node, items = self._sequence(items)
        options = [node]
        while items and items[0] == ("sign", "/"):
            node, items = self._sequence(items[1:])
            options.append(node)
        return (options[0] if len(options) == 1 else ("choice", options)), items

    def _sequence(self, items: list) -> tuple[tuple, list]:
        parts = []
        while items and items[0] not in (("sign", "/"), ("sign", ")")):
            sign = items[0][1] if items[0] in (("sign", "&"), ("sign", "!")) else None
            items = items[1:] if sign else items
            if items[0] == ("sign", "("):
                node, items = self._choice(items[1:])
            elif items[0] == ("sign", "."):
                node = ("any",)
            else:
                node = items[0]
            items = items[1:]
            if items and items[0] in (("sign", "*"), ("sign", "+"), ("sign", "?")):
                node, items = ({"*": "star", "+": "plus", "?": "maybe"}[items[0][1]], node), items[1:]
            parts.append({"&": ("and", node), "!": ("not", node)}[sign] if sign else node)
        return (parts[0] if len(parts) == 1 else ("seq", parts)), items

    # -- compiling
    def _refs(self, node: tuple) -> set[str]:
        if node[0] == "rule":
            return {node[1]}
        if node[0] in ("choice", "seq"):
            return set().union(*map(self._refs, node[1])) if node[1] else set()
        return self._refs(node[1]) if node[0] in ("star", "plus", "maybe", "and", "not") else set()

    def _regular(self) -> set[str]:
        refs, done = {n: self._refs(x) for n, x in self.rules.items()}, set()
        while True:
            more = {n for n, r in refs.items() if n not in done and r <= done and n not in self.until}
            if not more:
                return done
            done |= more

    def _pattern(self, node: tuple) -> str:
        kind = node[0]
        if kind == "lit":
            return re.escape(node[1])
        if kind == "set":
            return "[" + re.escape(node[1]) + "]"
        if kind == "any":
            return r"[^\x00]"
        if kind == "rule":
            if node[1] not in self._regex:
                self._regex[node[1]] = f"(?>{self._pattern(self.rules[node[1]])})"
            return self._regex[node[1]]
        if kind == "seq":
            return "".join(map(self._pattern, node[1]))
        if kind == "choice":
            return "(?>" + "|".join(map(self._pattern, node[1])) + ")"
        inner = self._pattern(node[1])
        return {"star": f"(?:{inner})*+", "plus": f"(?:{inner})++", "maybe": f"(?:{inner})?+", "and": f"(?={inner})", "not": f"(?!{inner})"}[kind]

    def _is_regular(self, node: tuple) -> bool:
        return self._refs(node) <= self.regular

    def _build(self, fast: bool) -> dict[str, Callable]:
        table: dict[str, Callable] = {}

        def matcher(node: tuple) -> Callable:
            match = re.compile(self._pattern(node)).match

            def run(s, p, m):
                x = match(s, p)
                return x.end() if x else -1

            return run

        def compiled(node: tuple) -> Callable:
            kind = node[0]
            if fast and kind not in ("lit", "set", "any") and self._is_regular(node):
                return matcher(node)
            if kind in ("lit", "set"):
                chars = node[1]

                def one(s, p, m):
                    if s[p] in chars:
                        return p + 1
                    if p > m[-1]:
                        m[-1] = p
                    return -1

                return one
            if kind == "any":
                return lambda s, p, m: p + 1 if p < len(s) - 1 else -1
            if kind == "rule":
                name = node[1]
                return lambda s, p, m: table[name](s, p, m)
            if kind == "seq":
                nodes = node[1]
                if fast:  # join neighbours that are regular
                    joined: list[tuple] = []
                    for x in nodes:
                        if joined and self._is_regular(x) and self._is_regular(joined[-1]):
                            joined[-1] = ("seq", [*(joined[-1][1] if joined[-1][0] == "seq" else [joined[-1]]), x])
                        else:
                            joined.append(x)
                    nodes = joined
                parts = tuple(map(compiled, nodes))

                def all_of(s, p, m):
                    for f in parts:
                        p = f(s, p, m)
                        if p < 0:
                            return -1
                    return p

                return all_of
            if kind == "choice":
                options = tuple(map(compiled, node[1]))

                def any_of(s, p, m):
                    for f in options:
                        e = f(s, p, m)
                        if e >= 0:
                            return e
                    return -1

                return any_of
            f = compiled(node[1])
            if kind == "maybe":

                def maybe(s, p, m):
                    e = f(s, p, m)
                    return e if e >= 0 else p

                return maybe
            if kind in ("and", "not"):
                wanted = kind == "and"

                def look(s, p, m):
                    far = m[-1]
                    e = f(s, p, m)
                    m[-1] = far
                    return p if (e >= 0) == wanted else -1

                return look
            least = kind == "plus"

            def many(s, p, m):
                start = p
                while True:
                    e = f(s, p, m)
                    if e < 0 or e == p:
                        return -1 if least and p == start and e < 0 else p
                    p = e

            return many

        for k, name in enumerate(self.names):
            f = compiled(self.rules[name])
            if fast and name in self.regular:
                table[name] = f
                continue

            def memoised(s, p, m, f=f, k=k):
                key = p << 8 | k
                e = m.get(key)
                if e is None:
                    e = m[key] = f(s, p, m)
                return e

            if name not in self.until:
                table[name] = memoised
                continue

            def shaped(s, p, m, f=memoised, end=self.until[name], known=self.shapes[name]):
                e = s.find(end, p) + 1
                if s[p:e] in known:
                    return e
                got = f(s, p, m)
                if got == e > 0 and len(known) < SHAPES:
                    known.add(s[p:e])
                return got

            table[name] = shaped
        return table

    def parse(self, tokens: str) -> tuple[bool, int]:
        """Whether the first rule matches all tokens, and if not, the furthest token that no rule could take."""
        s = tokens + "\0"
        memo: dict[int, int] = {-1: 0}
        if self.fast[self.names[0]](s, 0, memo) == len(tokens):
            return True, len(tokens)
        memo = {-1: 0}
        end = self.slow[self.names[0]](s, 0, memo)
        return end == len(tokens), max(memo[-1], end)
