"""A packrat parser for parsing-expression grammars over tokens.

A grammar is text: ``rule <- expression`` with ordered choice ``/``, sequences, ``* + ?``, lookahead ``& !``, literals
``'x'`` (a token's text; a string token has none) and token kinds in capitals. ``^NL`` stands for "a line break
before the next token". Results of rules are remembered by position, so parsing takes linear time. Choices look at the
next token first and try only alternatives that can start with it. The furthest token that was expected and not found
is where a text fails.

A grammar is compiled to Python source, one function a rule, once a process: tests of tokens are comparisons of small
numbers in straight code, and only rules are calls. Calls nest as deep as the text does; ``parse`` gives them room in
proportion to the tokens, up to ``DEEPEST`` calls.
"""

from __future__ import annotations

import re
import sys

_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)\s*(<-)?|'([^']+)'|(\^NL)|([()/*+?!&])|(#[^\n]*))")


#: Calls that may nest; at some hundred bytes a call. No text that people write comes near it.
DEEPEST = 3_000_000


class TooDeep(Exception):
    """A text nests deeper than ``DEEPEST`` calls; ``at`` is the furthest token read."""

    def __init__(self, at: int):
        super().__init__(at)
        self.at = at


class Grammar:
    """A compiled grammar; the rule ``start`` has to match all tokens."""

    def __init__(self, text: str, start: str = "start"):
        self.rules: dict[str, tuple] = {}
        self._read(text)
        self._first: dict[str, tuple[frozenset, bool]] = {n: (frozenset(), False) for n in self.rules}
        changed = True
        while changed:
            changed = False
            for name, node in self.rules.items():
                got = self._starts(node)
                if got != self._first[name]:
                    self._first[name], changed = got, True
        self._literals: dict[str, int] = {}
        self._kinds: dict[str, int] = {}
        self._sets: dict[frozenset, str] = {}
        self._scope: dict[str, object] = {}
        self._run = self._compile(start)

    def _read(self, text: str) -> None:
        toks = [m for m in _TOKEN.finditer(text) if m.group().strip() and not m.group(6)]
        i = 0

        def choice():
            nonlocal i
            alts = [sequence()]
            while i < len(toks) and toks[i].group(5) == "/":
                i += 1
                alts.append(sequence())
            return alts[0] if len(alts) == 1 else ("choice", alts)

        def sequence():
            nonlocal i
            parts = []
            while i < len(toks) and not toks[i].group(2) and toks[i].group(5) not in ("/", ")"):
                parts.append(prefix())
            return parts[0] if len(parts) == 1 else ("seq", parts)

        def prefix():
            nonlocal i
            op = toks[i].group(5)
            if op in ("!", "&"):
                i += 1
                return ("not" if op == "!" else "and", prefix())
            node = atom()
            while i < len(toks) and toks[i].group(5) in ("*", "+", "?"):
                node = ({"*": "many", "+": "some", "?": "opt"}[toks[i].group(5)], node)
                i += 1
            return node

        def atom():
            nonlocal i
            m = toks[i]
            i += 1
            if m.group(5) == "(":
                node = choice()
                i += 1
                return node
            if m.group(3):
                return ("lit", m.group(3))
            if m.group(4):
                return ("line",)
            name = m.group(1)
            return ("kind", name) if name.isupper() else ("rule", name)

        while i < len(toks):
            name = toks[i].group(1)
            i += 1
            self.rules[name] = choice()

    def _starts(self, node) -> tuple[frozenset, bool]:
        """The literals (as text) and kinds (as ``<kind>``) a node can start with, and whether it can match nothing."""
        op = node[0]
        if op == "lit":
            return frozenset([node[1]]), False
        if op == "kind":
            return frozenset([f"<{node[1]}>"]), False
        if op == "rule":
            return self._first[node[1]]
        if op == "choice":
            got = [self._starts(n) for n in node[1]]
            return frozenset().union(*[g[0] for g in got]), any(g[1] for g in got)
        if op == "seq":
            found: frozenset = frozenset()
            for n in node[1]:
                first, empty = self._starts(n)
                found |= first
                if not empty:
                    return found, False
            return found, True
        if op in ("many", "opt"):
            return self._starts(node[1])[0], True
        if op == "some":
            return self._starts(node[1])
        return frozenset(), True  # lookahead, line

    def _number(self, table: dict[str, int], key: str) -> int:
        return table.setdefault(key, len(table) + 1)

    def _guard(self, first: frozenset, at: str) -> str:
        """A test of whether the token at ``at`` is in a first set."""
        if first not in self._sets:
            name = f"S{len(self._sets)}"
            self._sets[first] = name
            self._scope[name] = frozenset(self._number(self._kinds, f[1:-1]) if f[1:-1].isupper() and f[0] == "<" else -self._number(self._literals, f) for f in first)
        name = self._sets[first]
        return f"(L[{at}] in {name} or K[{at}] in {name})"

    def _compile(self, start: str):
        """Source of one function that holds all rules; L and K are the tokens' literals (negative) and kinds (positive)."""
        out = ["def run(L, K, NL, M, deep):", "    far = -1"]
        self._vars = 0
        for name, node in self.rules.items():
            out += [f"    def r_{name}(p0):", "        nonlocal far", f"        m = M_{name}", "        if p0 in m:", "            return m[p0]", "        m[p0] = -1"]
            got = self._emit(node, "p0", out, "        ")
            out += [f"        m[p0] = {got}", f"        return {got}"]
        out.insert(2, "    " + "; ".join(f"M_{name} = {{}}" for name in self.rules))
        out += ["    try:", f"        return r_{start}(0), far", "    except RecursionError:", f"        raise deep(max([far, *(max(m, default=0) for m in ({', '.join(f'M_{name}' for name in self.rules)},))])) from None"]
        exec(compile("\n".join(out), "<grammar>", "exec"), self._scope)
        return self._scope["run"]

    def _new(self) -> str:
        self._vars += 1
        return f"v{self._vars}"

    def _emit(self, node, at: str, out: list[str], pad: str) -> str:
        """Code that matches a node at position ``at``; gives the variable of the position behind it, -1 if it fails."""
        op, v = node[0], self._new()
        if op in ("lit", "kind"):
            test = f"L[{at}] == {-self._number(self._literals, node[1])}" if op == "lit" else f"K[{at}] == {self._number(self._kinds, node[1])}"
            out += [f"{pad}if {test}:", f"{pad}    {v} = {at} + 1", f"{pad}else:", f"{pad}    {v} = -1", f"{pad}    if {at} > far: far = {at}"]
        elif op == "line":
            out.append(f"{pad}{v} = {at} if NL[{at}] else -1")
        elif op == "rule":
            first, empty = self._first[node[1]]
            if empty:
                out.append(f"{pad}{v} = r_{node[1]}({at})")
            else:
                out += [f"{pad}if {self._guard(first, at)}:", f"{pad}    {v} = r_{node[1]}({at})", f"{pad}else:", f"{pad}    {v} = -1", f"{pad}    if {at} > far: far = {at}"]
        elif op == "seq":
            out.append(f"{pad}{v} = {at}")
            inner = pad
            for k, part in enumerate(node[1]):
                got = self._emit(part, v, out, inner)
                out.append(f"{inner}{v} = {got}")
                if k < len(node[1]) - 1:
                    out.append(f"{inner}if {v} >= 0:")
                    inner += " "
        elif op == "choice":
            out.append(f"{pad}{v} = -1")
            inner = pad
            for alt in node[1]:
                first, empty = self._starts(alt)
                if not empty:
                    out.append(f"{inner}if {self._guard(first, at)}:")
                got = self._emit(alt, at, out, inner if empty else inner + " ")
                out.append(f"{inner if empty else inner + ' '}{v} = {got}")
                out.append(f"{inner}if {v} < 0:")
                inner += " "
            out.append(f"{inner}if {at} > far: far = {at}")
        elif op in ("many", "some"):
            first, empty = self._starts(node[1])
            if op == "some":
                got = self._emit(node[1], at, out, pad)
                out += [f"{pad}{v} = {got}", f"{pad}while {v} >= 0:"]
            else:
                out += [f"{pad}{v} = {at}", f"{pad}while True:"]
            if not empty:
                out += [f"{pad}    if not {self._guard(first, v)}:", f"{pad}        if {v} > far: far = {v}", f"{pad}        break"]
            got = self._emit(node[1], v, out, pad + "    ")
            out += [f"{pad}    if {got} < 0 or {got} == {v}: break", f"{pad}    {v} = {got}"]
        elif op == "opt":
            first, empty = self._starts(node[1])
            out.append(f"{pad}{v} = {at}")
            inner = pad
            if not empty:
                out.append(f"{pad}if {self._guard(first, at)}:")
                inner += " "
            got = self._emit(node[1], at, out, inner)
            out.append(f"{inner}if {got} >= 0: {v} = {got}")
        else:  # lookahead
            kept = self._new()
            out.append(f"{pad}{kept} = far")
            got = self._emit(node[1], at, out, pad)
            out += [f"{pad}far = {kept}", f"{pad}{v} = {at} if {got} {'<' if op == 'not' else '>='} 0 else -1"]
        return v

    def parse(self, tokens) -> int:
        """-1 if all tokens match, else the index of the furthest token that could not be taken.

        Raises ``TooDeep`` for a text that nests deeper than can be read.
        """
        literals, kinds = self._literals, self._kinds
        n = len(tokens.kinds)
        texts = [-literals.get(t, 0) for t in tokens.texts]
        types = [kinds.get(k, 0) for k in tokens.kinds]
        texts.append(0)
        types.append(0)
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, min(DEEPEST, 1000 + 40 * n)))
        try:
            end, far = self._run(texts, types, [*tokens.lines, False], None, TooDeep)
        finally:
            sys.setrecursionlimit(limit)
        return -1 if end == n else max(far, 0)
