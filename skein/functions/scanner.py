"""A structural scanner for JavaScript and TypeScript: tokens, brackets and the facts a code graph needs.

It isn't a parser. Brackets are matched over a token list, and each kind of fact is recognised by the tokens around it, so
unfinished or odd code yields what can be seen and never an error. Lines and offsets are those of the text given.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from typing import NamedTuple

#: Words that are followed by a bracket without being called (fixed values of the language).
KEYWORDS = frozenset(
    "if for while switch catch with return typeof instanceof in of new delete void throw await yield case do else function class extends import export default const let var async static get set super this".split()
)
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
NAME = re.compile(r"[A-Za-z_$\u0080-￿#][\w$\u0080-￿]*")
NUMBER = re.compile(r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)n?")
PUNCTUATION = re.compile(r"=>|\.\.\.|\?\.(?!\d)|===|!==|==|!=|<=|>=|&&=?|\|\|=?|\?\?=?|\*\*|\+\+|--|[-+*/%&|^]=|[^\s\w]")
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: What no comment, string, template or regular expression begins; the groups are those of ``KINDS``.
PLAIN = re.compile(rf"\s+|({NAME.pattern})|({NUMBER.pattern})|({PUNCTUATION.pattern})")
KINDS = (None, "name", "number", "punctuation")


class Token(NamedTuple):
    kind: str  # name, number, string, template, regex, punctuation
    text: str
    start: int
    end: int


class Call(NamedTuple):
    callee: str
    full: str
    args: list[str]
    start: int
    end: int
    line: int


class Function(NamedTuple):
    name: str
    form: str  # declaration, variable, method, computed
    start: int
    end: int
    line: int
    end_line: int
    text: str


class Import(NamedTuple):
    source: str
    names: list[str]
    is_default: bool
    line: int


class Entry(NamedTuple):
    """A part of an object literal: pair, method, shorthand or spread; the value as a range of tokens."""

    key: str
    form: str
    first: int
    last: int


@dataclass
class Facts:
    imports: list[Import] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
    news: list[Call] = field(default_factory=list)
    members: list[tuple[str, str, str, int]] = field(default_factory=list)  # object, property, full, line
    functions: list[Function] = field(default_factory=list)
    dynamic: list[tuple[str, bool, int]] = field(default_factory=list)  # path, is a template, line
    variables: list[tuple[str, int, int]] = field(default_factory=list)  # name, tokens of the value


def tokenise(text: str) -> list[Token]:
    out: list[Token] = []
    at, n, plain, token = 0, len(text), PLAIN.match, tuple.__new__  # the constructor of a named tuple costs as much as the match
    while at < n:
        c = text[at]
        if c not in "/'\"`":
            if m := plain(text, at):
                if k := m.lastindex:
                    out.append(token(Token, (KINDS[k], m[0], at, m.end())))
                at = m.end()
            else:
                out.append(Token("punctuation", c, at, at + 1))
                at += 1
        elif text.startswith("//", at):
            end = text.find("\n", at)
            at = n if end < 0 else end
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            at = n if end < 0 else end + 2
        elif c in "'\"":
            end = at + 1
            while end < n and text[end] not in (c, "\n"):
                end += 2 if text[end] == "\\" else 1
            out.append(Token("string", text[at : min(end + 1, n)], at, min(end + 1, n)))
            at = end + 1
        elif c == "`":
            end = _template_end(text, at)
            out.append(Token("template", text[at:end], at, end))
            at = end
        elif _regex_may_begin(out):
            m = REGEX.match(text, at)
            end = m.end() if m else at + 1
            out.append(Token("regex" if m else "punctuation", text[at:end], at, end))
            at = end
        else:
            end = PUNCTUATION.match(text, at).end()
            out.append(Token("punctuation", text[at:end], at, end))
            at = end
    return out


def _template_end(text: str, at: int) -> int:
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = _template_end(text, at)
                    continue
                depth += {"{": 1, "}": -1}.get(text[at], 0)
                at += 1
        else:
            at += 1
    return len(text)


def _regex_may_begin(out: list[Token]) -> bool:
    if not out:
        return True
    last = out[-1]
    if last.kind == "name":
        return last.text in BEFORE_REGEX
    return last.kind == "punctuation" and last.text not in (")", "]", "}", "++", "--")


def unquote(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] in "'\"`" and text[-1] == text[0] else text


class Source:
    """A text with its tokens and bracket pairs; the methods recognise structures at a token."""

    def __init__(self, text: str):
        self.text, self.tokens = text, tokenise(text)
        self.words = [None if t.kind in ("string", "template", "regex") else t.text for t in self.tokens]
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.pair, self.inside = self._brackets()

    def _brackets(self) -> tuple[dict[int, int], list[int]]:
        pair, inside, stack = {}, [], []
        for k, t in enumerate(self.tokens):
            inside.append(stack[-1] if stack else -1)
            if t.kind == "punctuation":
                if t.text in OPEN:
                    stack.append(k)
                elif t.text in CLOSE:
                    for depth in range(len(stack) - 1, -1, -1):  # a closing bracket ends the nearest of its kind
                        if self.tokens[stack[depth]].text == CLOSE[t.text]:
                            pair[stack[depth]], pair[k] = k, stack[depth]
                            inside[k] = inside[stack[depth]]
                            del stack[depth:]
                            break
        return pair, inside

    def is_(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.words) and self.words[k] in texts

    def kind(self, k: int) -> str:
        return self.tokens[k].kind if 0 <= k < len(self.tokens) else ""

    def line(self, offset: int) -> int:
        return bisect_right(self.lines, offset - 1) + 1

    def between(self, first: int, last: int) -> str:
        """The text of the tokens ``first`` to ``last``."""
        return self.text[self.tokens[first].start : self.tokens[last].end] if first <= last else ""

    def close(self, k: int) -> int:
        return self.pair.get(k, len(self.tokens) - 1)

    def after_generics(self, k: int) -> int:
        """The token after ``<...>`` at ``k`` if a call's bracket follows, else ``k``."""
        if not self.is_(k, "<"):
            return k
        depth, at = 0, k
        while at < min(len(self.tokens), k + 200):
            text = self.tokens[at].text
            if text in OPEN:
                at = self.close(at)
            elif text == "<":
                depth += 1
            elif text == ">":
                depth -= 1
                if not depth:
                    return at + 1 if self.is_(at + 1, "(") else k
            elif text in (";", ")", "]", "}", "=", "&&", "||", "==="):
                return k
            at += 1
        return k

    def parts(self, opening: int) -> list[tuple[int, int]]:
        """The ranges of tokens between the commas of a bracket."""
        end, out, first, at = self.close(opening), [], opening + 1, opening + 1
        while at < end:
            if self.is_(at, *OPEN) and at in self.pair:
                at = self.pair[at]
            elif self.is_(at, ","):
                out.append((first, at - 1))
                first = at + 1
            at += 1
        return [*out, (first, end - 1)] if first < end else out

    def entries(self, opening: int) -> list[Entry]:
        """The parts of the object literal at a brace."""
        out = []
        for first, last in self.parts(opening):
            at = first
            while at < last and self.is_(at, "async", "get", "set", "static", "*") and not self.is_(at + 1, ":", "(", ","):
                at += 1
            if self.is_(at, "..."):
                out.append(Entry(self.between(at + 1, last), "spread", at + 1, last))
                continue
            key = unquote(self.tokens[at].text)
            if self.is_(at, "[") and at in self.pair:
                key, at = self.between(at, self.pair[at]), self.pair[at]
            if at == last:
                out.append(Entry(key, "shorthand", at, at))
            elif self.is_(at + 1, ":"):
                out.append(Entry(key, "pair", at + 2, last))
            elif self.is_(at + 1, "(", "<"):
                out.append(Entry(key, "method", at + 1, last))
        return out

    def function_at(self, k: int) -> int:
        """The last token of the function expression or arrow function at ``k``, or -1."""
        if self.is_(k, "async"):
            k += 1
        if self.is_(k, "function"):
            at = k
            while at < len(self.tokens) and not self.is_(at, "("):
                at += 1
            return self.body_end(self.close(at) + 1)
        if self.kind(k) == "name" and self.is_(k + 1, "=>"):
            return self.arrow_end(k + 2)
        if self.is_(k, "<"):
            k = self.after_generics(k)
        if self.is_(k, "("):
            at = self.close(k) + 1
            if self.is_(at, ":"):  # a return type
                stop = at + 60
                while at < min(len(self.tokens), stop) and not self.is_(at, "=>", ";", ","):
                    at = self.close(at) + 1 if self.is_(at, *OPEN) else at + 1
            if self.is_(at, "=>"):
                return self.arrow_end(at + 1)
        return -1

    def body_end(self, k: int) -> int:
        """The closing brace of the body that begins at or, behind a return type, after ``k``."""
        stop = k + 60
        while k < min(len(self.tokens), stop):
            if self.is_(k, "{") and not self.is_(k - 1, ":", "|", "&"):
                return self.close(k)
            if self.is_(k, ";"):
                return -1
            k = self.close(k) + 1 if self.is_(k, *OPEN) else k + 1
        return -1

    def arrow_end(self, k: int) -> int:
        return self.close(k) if self.is_(k, "{") else self.expression_end(k)

    def expression_end(self, k: int) -> int:
        """The last token of an expression: up to a comma, semicolon or closing bracket, or a line that begins anew."""
        first = k
        while k < len(self.tokens):
            if self.is_(k, ",", ";", *CLOSE):
                return k - 1
            if k > first and self.tokens[k].kind in ("name", "string") and not self.is_(k, "as", "in", "instanceof", "of", "satisfies"):
                gap = self.text[self.tokens[k - 1].end : self.tokens[k].start]
                if "\n" in gap and (self.tokens[k - 1].kind != "punctuation" or self.tokens[k - 1].text in CLOSE):
                    return k - 1
            if self.is_(k, *OPEN):
                k = self.close(k)
            k += 1
        return len(self.tokens) - 1

    def value_start(self, k: int) -> int:
        """The first token of a variable's value, behind its name at ``k`` and a type; -1 if it has none."""
        k += 1
        if self.is_(k, "!"):
            k += 1
        if self.is_(k, ":"):
            stop = k + 80
            while k < min(len(self.tokens), stop) and not self.is_(k, "=", ";"):
                k = self.close(k) + 1 if self.is_(k, *OPEN) else k + 1
        return k + 1 if self.is_(k, "=") else -1

    def is_method(self, name: int, closing: int) -> bool:
        """Whether a name and its bracket begin a method of an object or class."""
        if self.inside[name] < 0 or not self.is_(self.inside[name], "{"):
            return False
        if not (self.is_(name - 1, "{", ",", "}", ";", "async", "get", "set", "static", "public", "private", "protected", "*")):
            return False
        return self.is_(closing + 1, "{") or (self.is_(closing + 1, ":") and self.body_end(closing + 1) > 0 and not self.is_(name - 1, ";", "}"))

    # facts

    def facts(self) -> Facts:
        out = Facts()
        for k, t in enumerate(self.tokens):
            if t.kind != "name":
                continue
            if t.text == "import" and not self.is_(k - 1, "."):
                self._import(k, out)
            elif t.text in ("const", "let", "var"):
                self._variable(k, out)
            elif t.text == "function" and self.kind(k + 1) == "name" and not self.is_(k - 1, "=", "(", ",", ":", "=>", "return"):
                end = self.function_at(k)
                first = k - 1 if self.is_(k - 1, "async") else k
                if end > 0:
                    out.functions.append(self._function(self.tokens[k + 1].text, "declaration", first, end))
            elif t.text == "new" and self.kind(k + 1) == "name":
                end = self._chain_end(k + 1)
                opening = self.after_generics(end + 1)
                args = self._arguments(opening) if self.is_(opening, "(") else []
                last = self.close(opening) if self.is_(opening, "(") else end
                out.news.append(Call(self.between(k + 1, end), self.between(k, end), args, t.start, self.tokens[last].end, self.line(t.start)))
            if not self.is_(k - 1, ".", "?.", "new") and (t.text not in KEYWORDS or t.text in ("this", "super")):
                self._chain(k, out)
        for form, owner in (("method", "methods"), ("computed", "computed")):
            out.functions += self._component_methods(owner, form)
        return out

    def _function(self, name: str, form: str, first: int, last: int) -> Function:
        start, end = self.tokens[first].start, self.tokens[last].end
        return Function(name, form, start, end, self.line(start), self.line(end - 1), self.text[start:end])

    def _arguments(self, opening: int) -> list[str]:
        return [self.between(a, b) for a, b in self.parts(opening)]

    def _import(self, k: int, out: Facts) -> None:
        if self.is_(k + 1, "("):
            for text, template in [(self.tokens[a].text, self.tokens[a].kind == "template") for a, _ in self.parts(k + 1)[:1] if self.kind(a) in ("string", "template")]:
                out.dynamic.append((unquote(text), template, self.line(self.tokens[k].start)))
            end = self.close(k + 1)
            out.calls.append(Call("import", "import", self._arguments(k + 1), self.tokens[k].start, self.tokens[end].end, self.line(self.tokens[k].start)))
            return
        at, names, is_default = k + 1, [], False
        while at < len(self.tokens) and self.kind(at) != "string":
            if self.is_(at, ";", "(", "=") or self.is_(at, "import", "const", "function"):
                return
            if self.kind(at) == "name" and not self.is_(at, "from", "as") and not (self.is_(at, "type") and at == k + 1 and not self.is_(at + 1, "from", ",")):
                names.append(self.tokens[at].text)
                is_default |= at == k + 1 and not self.is_(at, "type") or (at == k + 2 and self.is_(k + 1, "type") and not self.is_(at - 1, "{"))
            at += 1
        if at < len(self.tokens):
            out.imports.append(Import(unquote(self.tokens[at].text), names, is_default, self.line(self.tokens[k].start)))

    def _variable(self, k: int, out: Facts) -> None:
        at = k + 1
        while self.kind(at) == "name":
            first = self.value_start(at)
            if first < 0 or first >= len(self.tokens):
                return
            last = self.function_at(first)
            if last > 0:
                out.functions.append(self._function(self.tokens[at].text, "variable", k, last))
            else:
                last = self.expression_end(first)
            out.variables.append((self.tokens[at].text, first, last))
            if not self.is_(last + 1, ","):
                return
            at = last + 2

    def _chain_end(self, k: int) -> int:
        while self.is_(k + 1, ".", "?.") and self.kind(k + 2) == "name":
            k += 2
        return k

    def _chain(self, k: int, out: Facts) -> None:
        """Members and calls of ``a.b(c).d(e)`` that begins at ``k``."""
        first, at, start = self.tokens[k], k, self.tokens[k].start
        line = self.line(start)
        while True:
            opening = self.after_generics(at + 1)
            if self.is_(opening, "?."):
                opening = opening + 1 if self.is_(opening + 1, "(") else opening
            if self.is_(opening, "(") and opening in self.pair:
                closing = self.pair[opening]
                name = self.tokens[at].text
                if at == k and (self.is_method(k, closing) or self.is_(k - 1, "function") or (self.is_(k - 1, "*") and self.is_(k - 2, "function"))):
                    return
                if self.kind(at) == "name" and (at > k or name not in KEYWORDS):
                    out.calls.append(Call(name, self.text[start : self.tokens[at].end], self._arguments(opening), start, self.tokens[closing].end, line))
                at = closing
            elif self.is_(at + 1, "[") and self.is_(k - 1, "new") is False and at + 1 in self.pair and at >= k and self.tokens[at + 1].start == self.tokens[at].end:
                at = self.pair[at + 1]
            elif self.is_(at + 1, ".", "?.") and self.kind(at + 2) == "name":
                full = self.text[start : self.tokens[at + 2].end]
                out.members.append((self.text[start : self.tokens[at].end], self.tokens[at + 2].text, full, line))
                at += 2
            else:
                return

    def objects_named(self, name: str) -> list[int]:
        """The braces of ``name: {``."""
        return [k + 2 for k, t in enumerate(self.tokens) if t.text == name and t.kind == "name" and self.is_(k + 1, ":") and self.is_(k + 2, "{")]

    def _component_methods(self, owner: str, form: str) -> list[Function]:
        found = []
        for opening in self.objects_named(owner):
            for e in self.entries(opening):
                end = -1
                if e.form == "pair":
                    end = self.function_at(e.first)
                    first = e.first - 2
                elif e.form == "method" and form == "method":
                    end, first = e.last, e.first - 1
                    while self.is_(first - 1, "async", "get", "set", "*"):
                        first -= 1
                if end > 0:
                    found.append(self._function(e.key, form, first, end))
        return found

    def default_export(self) -> int:
        """The brace of the object that is exported by default, itself or as the first argument of a call; -1 if there is none."""
        for k, t in enumerate(self.tokens):
            if t.text == "export" and t.kind == "name" and self.is_(k + 1, "default"):
                at = k + 2
                if self.is_(at, "{"):
                    return at
                if self.kind(at) == "name":
                    at = self.after_generics(self._chain_end(at) + 1)
                    if self.is_(at, "(") and self.is_(at + 1, "{"):
                        return at + 1
                return -1
        return -1

    def objects(self) -> list[int]:
        """The braces that begin an object literal."""
        out = []
        for k, t in enumerate(self.tokens):
            if t.kind == "punctuation" and t.text == "{" and k in self.pair and (self.is_(k - 1, "(", ",", "=", ":", "[", "return", "default", "?", "||", "&&", "??") or k == 0):
                out.append(k)
        return out
