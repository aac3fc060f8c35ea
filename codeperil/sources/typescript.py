"""Cyclomatic complexity of TypeScript and JavaScript functions: a parser of what control flow and names need, and the count.

Types are passed over. Where the grammar is ambiguous (arrow functions, type arguments, JSX) one reading is tried and, if
it fails, given up for the other.
"""

from __future__ import annotations

import re
from bisect import bisect_right


class ScriptSyntaxError(ValueError):
    """Source that the parser can't follow."""


_SKIP = re.compile(r"(?:\s|﻿|//[^\n]*|/\*.*?\*/)+", re.S)
_NAME = re.compile(r"#?(?:[^\W\d]|\$|\\u\{?[0-9a-fA-F]+\}?)(?:[\w$]|‌|‍|\\u\{?[0-9a-fA-F]+\}?)*")
_NUMBER = re.compile(r"0[xXoObB][0-9a-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*")
_OPS = sorted(
    ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #".split(), key=len, reverse=True
)
_OP = re.compile("|".join(map(re.escape, _OPS)))
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
BINDING = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9,
    "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
WORDS = {"break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "export", "extends", "finally", "for", "function", "if", "import", "in", "instanceof", "new", "return", "super", "switch", "this", "throw", "try", "typeof", "var", "void", "while", "with", "enum", "null", "true", "false"}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "accessor", "async", "get", "set"}


class N:
    """A node: its type, its first character, the one behind its last, and its parts."""

    __slots__ = ("type", "start", "end", "kw")

    def __init__(self, type_: str, start: int, end: int, **kw):
        self.type, self.start, self.end, self.kw = type_, start, end, kw

    def __getattr__(self, name: str):
        try:
            return self.kw[name]
        except KeyError:
            raise AttributeError(name) from None


class Parser:
    def __init__(self, text: str, jsx: bool, types: bool):
        self.text, self.jsx, self.types = text, jsx, types
        self.last = 0  # behind the last token
        self.at = 0
        self.no_in = False
        self.cache: dict[tuple[int, bool], tuple[str, str, int, int, bool]] = {}
        self.depth = 0
        if text.startswith("#!"):
            self.at = text.find("\n") if "\n" in text else len(text)

    # tokens: kind, text, start, end, whether a line ends before it

    def peek(self, regex: bool = False) -> tuple[str, str, int, int, bool]:
        key = (self.at, regex)
        if (hit := self.cache.get(key)) is not None:
            return hit
        m = _SKIP.match(self.text, self.at)
        start = m.end() if m else self.at
        broken = bool(m) and "\n" in m[0]
        c = self.text[start : start + 1]
        if not c:
            token = ("end", "", start, start, broken)
        elif c in "'\"" and (m := _STRING.match(self.text, start)):
            token = ("str", m[0], start, m.end(), broken)
        elif c == "`":
            token = ("tick", "`", start, start + 1, broken)
        elif (c.isdigit() or c == "." and self.text[start + 1 : start + 2].isdigit()) and (m := _NUMBER.match(self.text, start)):
            token = ("num", m[0], start, m.end(), broken)
        elif regex and c == "/" and (m := _REGEX.match(self.text, start)):
            token = ("regex", m[0], start, m.end(), broken)
        elif m := _NAME.match(self.text, start):
            token = ("name", m[0], start, m.end(), broken)
        elif m := _OP.match(self.text, start):
            token = ("op", m[0], start, m.end(), broken)
        else:
            raise self.error(f"unexpected {c!r}", start)
        self.cache[key] = token
        return token

    def error(self, what: str, at: int | None = None) -> ScriptSyntaxError:
        return ScriptSyntaxError(f"line {self.text.count(chr(10), 0, self.peek_start() if at is None else at) + 1}: {what}")

    def peek_start(self) -> int:
        return self.at

    def take(self, regex: bool = False) -> tuple[str, str, int, int, bool]:
        t = self.peek(regex)
        if t[0] == "end":
            raise self.error("source ends too early")
        self.at = self.last = t[3]
        return t

    def is_(self, *texts: str) -> bool:
        t = self.peek()
        return t[0] in ("op", "name", "tick") and t[1] in texts

    def eat(self, *texts: str) -> bool:
        if self.is_(*texts):
            self.take()
            return True
        return False

    def want(self, text: str) -> int:
        if text == ">" and self.peek()[0] == "op" and self.peek()[1].startswith(">"):
            start = self.peek()[2]
            self.at = self.last = start + 1
            return start
        if not self.is_(text):
            raise self.error(f"expected {text!r}, found {self.peek()[1]!r}")
        return self.take()[2]

    def follows(self, n: int = 1) -> tuple[str, str, int, int, bool]:
        kept = self.at, self.last
        try:
            for _ in range(n):
                if self.peek()[0] == "end":
                    break
                if self.peek()[0] == "tick":
                    return self.peek()
                self.take()
            return self.peek()
        finally:
            self.at, self.last = kept

    def attempt(self, f):
        """f(), or None with everything as before if it can't be read so."""
        kept = self.at, self.last, self.no_in
        try:
            return f()
        except ScriptSyntaxError:
            self.at, self.last, self.no_in = kept
            return None

    def semicolon(self) -> None:
        if self.eat(";") or self.is_("}") or self.peek()[0] == "end" or self.peek()[4]:
            return
        raise self.error(f"unexpected {self.peek()[1]!r}")

    # types

    def type_(self) -> None:
        self.eat("|", "&")
        self.type_one()
        while True:
            if self.is_("|", "&"):
                self.take()
                self.type_one()
            elif self.is_("extends") and not self.peek()[4]:
                self.take()
                self.type_()
                if self.eat("?"):
                    self.type_()
                    self.want(":")
                    self.type_()
                return
            else:
                return

    def type_one(self) -> None:
        t = self.peek()
        if t[0] in ("str", "num"):
            self.take()
        elif t[0] == "tick":
            self.template(types=True)
        elif self.is_("-"):
            self.take()
            self.take()
        elif self.is_("("):
            self.brackets()
            if self.eat("=>"):
                self.type_()
        elif self.is_("["):
            self.brackets()
        elif self.is_("{"):
            self.brackets()
        elif self.is_("<"):
            self.type_parameters()
            self.brackets()
            self.want("=>")
            self.type_()
        elif self.is_("new", "abstract") and self.follows()[1] in ("(", "<", "new"):
            self.take()
            self.type_one()
        elif self.is_("keyof", "readonly", "unique", "infer", "asserts") and self.follows()[0] in ("name", "op", "str", "num") and self.follows()[1] not in ("=", ",", ")", ";", ">", "|", "&", "}", "]", ".", "[", "=>", "<", "?", ":") and not self.follows()[4]:
            self.take()
            self.type_one()
        elif self.is_("typeof"):
            self.take()
            self.type_name()
        elif self.is_("import"):
            self.take()
            self.brackets()
            while self.eat("."):
                self.take()
            if self.is_("<"):
                self.type_arguments()
        elif t[0] == "name":
            self.type_name()
            if self.is_("is") and not self.peek()[4]:
                self.take()
                self.type_()
        else:
            raise self.error(f"no type begins with {t[1]!r}")
        while self.is_("[") and not self.peek()[4]:
            self.brackets()

    def type_name(self) -> None:
        self.take()
        while self.eat("."):
            self.take()
        if self.is_("<") and not self.peek()[4]:
            self.type_arguments()

    def type_arguments(self) -> None:
        self.want("<")
        while not self.is_(">", ">>", ">>>", ">=", ">>=", ">>>="):
            self.type_()
            if not self.eat(","):
                break
        self.want(">")

    def type_parameters(self) -> None:
        self.want("<")
        while not self.is_(">"):
            while self.is_("const", "in", "out") and self.follows()[0] == "name":
                self.take()
            self.take()
            if self.eat("extends"):
                self.type_()
            if self.eat("="):
                self.type_()
            if not self.eat(","):
                break
        self.want(">")

    def brackets(self) -> None:
        """Pass over a bracketed stretch of a type."""
        close = {"(": ")", "[": "]", "{": "}"}
        stack = [close[self.take()[1]]]
        while stack:
            t = self.peek()
            if t[0] == "tick":
                self.template(types=True)
                continue
            self.take()
            if t[0] == "op" and t[1] in close:
                stack.append(close[t[1]])
            elif t[0] == "op" and t[1] in (")", "]", "}") and t[1] != stack.pop():
                raise self.error(f"unmatched {t[1]!r}")

    def annotation(self) -> None:
        if self.types and self.eat(":"):
            self.type_()

    # statements

    def program(self) -> list[N]:
        out = []
        while self.peek(True)[0] != "end":
            out.append(self.statement())
        return out

    def block(self) -> N:
        start = self.want("{")
        body = []
        while not self.is_("}"):
            body.append(self.statement())
        self.take()
        return N("Block", start, self.last, body=body)

    def statement(self) -> N:
        self.depth += 1
        if self.depth > 800:
            raise self.error("nested too deeply")
        try:
            return self._statement()
        finally:
            self.depth -= 1

    def _statement(self) -> N:
        t = self.peek(True)
        start = t[2]
        word = t[1] if t[0] in ("name", "op") else ""
        after = self.follows() if t[0] == "name" else ("", "", 0, 0, False)
        if word == "{":
            return self.block()
        if word == ";":
            self.take()
            return N("Empty", start, self.last)
        if word == "@":
            self.decorators()
            return self.statement()
        if word in ("var", "const") or word == "let" and (after[0] == "name" or after[1] in ("{", "[")) or word == "using" and after[0] == "name" and not after[4] and after[1] not in ("in", "of", "instanceof"):
            if word == "const" and after[1] == "enum":
                self.take()
                return self.enum(start)
            node = self.variables()
            self.semicolon()
            node.end = self.last
            return node
        if word == "function" or word == "async" and after[1] == "function" and not after[4]:
            return self.function(start, declaration=True)
        if word == "class" or word == "abstract" and after[1] == "class":
            self.eat("abstract")
            return self.class_(start)
        if word == "if":
            self.take()
            test = self.parenthesised()
            then = self.statement()
            other = self.statement() if self.eat("else") else None
            return N("If", start, self.last, test=test, then=then, other=other)
        if word == "for":
            return self.for_(start)
        if word == "while":
            self.take()
            test = self.parenthesised()
            body = self.statement()
            return N("While", start, self.last, test=test, body=body)
        if word == "do":
            self.take()
            body = self.statement()
            self.want("while")
            test = self.parenthesised()
            self.eat(";")
            return N("DoWhile", start, self.last, test=test, body=body)
        if word == "switch":
            self.take()
            subject = self.parenthesised()
            self.want("{")
            cases = []
            while not self.is_("}"):
                at = self.peek()[2]
                test = None
                if not self.eat("default"):
                    self.want("case")
                    test = self.expression()
                self.want(":")
                body = []
                while not self.is_("case", "default", "}"):
                    body.append(self.statement())
                cases.append(N("Case", at, self.last, test=test, body=body))
            self.take()
            return N("Switch", start, self.last, subject=subject, cases=cases)
        if word == "try":
            self.take()
            body, handler, final = self.block(), None, None
            if self.eat("catch"):
                if self.eat("("):
                    self.pattern()
                    self.annotation()
                    self.want(")")
                handler = self.block()
            if self.eat("finally"):
                final = self.block()
            return N("Try", start, self.last, body=body, handler=handler, final=final)
        if word in ("return", "throw"):
            self.take()
            value = None
            n = self.peek(True)
            if not (n[4] or n[0] == "end" or n[0] == "op" and n[1] in (";", "}")):
                value = self.expression()
            self.semicolon()
            return N("Return", start, self.last, value=value)
        if word in ("break", "continue", "debugger"):
            self.take()
            if self.peek()[0] == "name" and not self.peek()[4]:
                self.take()
            self.semicolon()
            return N("Empty", start, self.last)
        if word == "import" and after[1] not in ("(", "."):
            while True:
                n = self.take()
                if n[0] == "str":
                    break
                if n[1] == "require":
                    self.brackets()
                    break
                if n[1] == ";" or self.peek()[0] == "end":
                    break
            if self.is_("with", "assert") and not self.peek()[4]:
                self.take()
                self.brackets()
            self.eat(";")
            return N("Empty", start, self.last)
        if word == "export":
            return self.export(start)
        if word == "with":
            self.take()
            self.parenthesised()
            self.statement()
            return N("Empty", start, self.last)
        if self.types and t[0] == "name":
            if word == "enum" and after[0] == "name":
                return self.enum(start)
            if word == "interface" and after[0] == "name" and not after[4]:
                self.take()
                self.take()
                if self.is_("<"):
                    self.type_parameters()
                if self.eat("extends"):
                    self.type_()
                    while self.eat(","):
                        self.type_()
                self.brackets()
                return N("Empty", start, self.last)
            if word == "type" and after[0] == "name" and not after[4] and after[1] not in ("in", "of", "instanceof"):
                self.take()
                self.take()
                if self.is_("<"):
                    self.type_parameters()
                self.want("=")
                self.type_()
                self.semicolon()
                return N("Empty", start, self.last)
            if word == "declare" and after[0] == "name" and not after[4]:
                self.take()
                inner = self.statement()
                return N("Declare", start, self.last, inner=inner)
            if word in ("namespace", "module") and (after[0] in ("name", "str")) and not after[4] or word == "global" and after[1] == "{":
                return self.namespace(start)
        if t[0] == "name" and after[1] == ":" and word not in WORDS:
            self.take()
            self.take()
            body = self.statement()
            return N("Labeled", start, self.last, body=body)
        value = self.expression()
        self.semicolon()
        return N("Expr", start, self.last, value=value)

    def decorators(self) -> None:
        while self.is_("@"):
            self.take()
            self.postfix(self.primary(), calls=True)

    def enum(self, start: int) -> N:
        self.want("enum")
        self.take()
        self.brackets()
        return N("Empty", start, self.last)

    def namespace(self, start: int) -> N:
        if not self.is_("global"):
            self.take()
        names = [self.take()]
        while self.eat("."):
            names.append(self.take())
        segments = [n[1][1:-1] if n[0] == "str" else n[1] for n in names]
        if not self.is_("{"):
            self.semicolon()
            return N("Empty", start, self.last)
        body = self.block()
        return N("Namespace", start, self.last, names=segments, body=body.body)

    def export(self, start: int) -> N:
        self.take()
        if self.eat("default"):
            n = self.peek(True)
            if n[1] == "function" or n[1] == "async" and self.follows()[1] == "function":
                inner = self.function(n[2], declaration=True)
            elif n[1] in ("class", "@") or n[1] == "abstract" and self.follows()[1] == "class":
                if n[1] == "@":
                    self.decorators()
                self.eat("abstract")
                inner = self.class_(self.peek()[2])
            elif n[1] == "interface" and self.follows()[0] == "name":
                self.statement()
                inner = None
            else:
                inner = N("Expr", n[2], n[2], value=self.assignment())
                self.semicolon()
            return N("ExportDefault", start, self.last, inner=inner)
        if self.is_("*", "{") or self.is_("type") and self.follows()[1] in ("{", "*"):
            self.eat("type")
            if self.is_("{"):
                self.brackets()
            else:
                self.take()
                if self.eat("as"):
                    self.take()
            if self.eat("from"):
                self.take()
                if self.is_("with", "assert") and not self.peek()[4]:
                    self.take()
                    self.brackets()
            self.semicolon()
            return N("Empty", start, self.last)
        if self.is_("=") or self.is_("as"):
            if self.take()[1] == "as":
                self.take()
                self.take()
            else:
                self.assignment()
            self.semicolon()
            return N("Empty", start, self.last)
        if self.is_("import"):
            self.statement()
            return N("Empty", start, self.last)
        return N("Export", start, self.last, inner=self.statement())

    def variables(self) -> N:
        start = self.take()[2]
        out = []
        while True:
            name = self.pattern()
            self.eat("!")
            self.annotation()
            init = self.assignment() if self.eat("=") else None
            out.append((name, init))
            if not self.eat(","):
                return N("Variables", start, self.last, items=out)

    def pattern(self) -> str | None:
        """Pass over a binding; the name of a plain one. Defaults inside are parsed, and dropped."""
        if self.is_("{"):
            self.take()
            while not self.is_("}"):
                if not self.eat("..."):
                    if self.is_("["):
                        self.take()
                        self.assignment()
                        self.want("]")
                    else:
                        self.take()
                    if not self.eat(":"):
                        if self.eat("="):
                            self.assignment()
                        self.eat(",")
                        continue
                self.pattern()
                if self.eat("="):
                    self.assignment()
                self.eat(",")
            self.take()
            return None
        if self.is_("["):
            self.take()
            while not self.is_("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.pattern()
                if self.eat("="):
                    self.assignment()
            self.take()
            return None
        t = self.take()
        if t[0] != "name" or t[1] in WORDS - {"this"}:
            raise self.error(f"no binding begins with {t[1]!r}")
        return t[1]

    def parenthesised(self) -> N:
        self.want("(")
        e = self.expression()
        self.want(")")
        return e

    def for_(self, start: int) -> N:
        self.take()
        self.eat("await")
        self.want("(")
        init = None
        kept, self.no_in = self.no_in, True
        if self.is_("var", "const") or self.is_("let", "using") and (self.follows()[0] == "name" and self.follows()[1] not in ("of", "in") or self.follows()[1] in ("{", "[")):
            init = self.variables()
        elif not self.is_(";"):
            init = self.expression()
        self.no_in = kept
        if self.is_("of", "in"):
            self.take()
            right = self.expression()
            self.want(")")
            body = self.statement()
            return N("ForIn", start, self.last, right=right, body=body)
        self.want(";")
        test = None if self.is_(";") else self.expression()
        self.want(";")
        update = None if self.is_(")") else self.expression()
        self.want(")")
        body = self.statement()
        return N("For", start, self.last, init=init, test=test, update=update, body=body)

    # functions and classes

    def parameters(self) -> None:
        self.want("(")
        while not self.is_(")"):
            self.decorators()
            while self.is_("public", "private", "protected", "readonly", "override") and (self.follows()[0] == "name" or self.follows()[1] in ("{", "[")):
                self.take()
            self.eat("...")
            self.pattern()
            self.eat("?")
            self.annotation()
            if self.eat("="):
                self.assignment()
            if not self.eat(","):
                break
        self.want(")")

    def function(self, start: int, declaration: bool = False) -> N:
        self.eat("async")
        self.want("function")
        self.eat("*")
        name = self.take()[1] if self.peek()[0] == "name" and not self.is_("(") else None
        return self.rest_of_function(start, name)

    def rest_of_function(self, start: int, name: str | None) -> N:
        if self.is_("<"):
            self.type_parameters()
        self.parameters()
        self.annotation()
        kept, self.no_in = self.no_in, False
        body = None
        if self.is_("{"):
            body = self.block().body
        else:
            self.semicolon()
        self.no_in = kept
        return N("Function", start, self.last, name=name, body=body)

    def class_(self, start: int) -> N:
        self.want("class")
        name = self.take()[1] if self.peek()[0] == "name" and not self.is_("extends", "implements") else None
        if self.is_("<"):
            self.type_parameters()
        if self.eat("extends"):
            self.postfix(self.primary(), calls=True)
            if self.is_("<"):
                self.type_arguments()
        if self.types and self.eat("implements"):
            self.type_()
            while self.eat(","):
                self.type_()
        self.want("{")
        members = []
        while not self.is_("}"):
            if self.eat(";"):
                continue
            members.append(self.member())
        self.take()
        return N("Class", start, self.last, name=name, members=members)

    def member(self) -> N:
        self.decorators()
        start = self.peek()[2]
        if self.is_("static") and self.follows()[1] == "{":
            self.take()
            body = self.block()
            return N("StaticBlock", start, self.last, body=body.body)
        accessor = False
        while self.peek()[0] == "name" and self.peek()[1] in MODIFIERS and not (self.follows()[0] == "op" and self.follows()[1] in ("(", "=", ";", ":", "?", "!", "}", "<", ",")) and not (self.follows()[4] and self.peek()[1] not in ("static", "public", "private", "protected", "readonly", "abstract", "override", "declare")):
            accessor |= self.take()[1] == "accessor"
        self.eat("*")
        if self.types and self.is_("[") and (index := self.attempt(self.index_signature)):
            return index
        key, computed, key_node = self.key()
        self.eat("?", "!")
        if self.is_("(", "<"):
            f = self.rest_of_function(self.peek()[2], None)
            return N("Method", start, self.last, key=key, value=f)
        self.annotation()
        value = None
        if self.eat("="):
            kept, self.no_in = self.no_in, False
            value = self.assignment()
            self.no_in = kept
        self.semicolon()
        return N("Empty" if accessor else "Property", start, self.last, key=key, computed=computed, key_node=key_node, value=value)

    def index_signature(self) -> N:
        start = self.want("[")
        if self.take()[0] != "name":
            raise self.error("no index signature")
        self.want(":")
        self.type_()
        self.want("]")
        self.want(":")
        self.type_()
        self.semicolon()
        return N("Empty", start, self.last)

    def key(self) -> tuple[str | None, bool, N | None]:
        """The name of a member (None: computed), whether it is in brackets, and its expression."""
        if self.eat("["):
            kept, self.no_in = self.no_in, False
            e = self.assignment()
            self.no_in = kept
            self.want("]")
            return (e.text[1:-1] if e.type == "Literal" and e.text[:1] in "'\"" else None), True, e
        t = self.take()
        if t[0] == "str":
            return t[1][1:-1], False, None
        if t[0] in ("name", "num"):
            return t[1], False, None
        raise self.error(f"no member begins with {t[1]!r}")

    # expressions

    def expression(self) -> N:
        e = self.assignment()
        if self.is_(","):
            parts = [e]
            while self.eat(","):
                parts.append(self.assignment())
            return N("Parts", e.start, self.last, parts=parts)
        return e

    def assignment(self, in_ternary: bool = False) -> N:
        self.depth += 1
        if self.depth > 800:
            raise self.error("nested too deeply")
        try:
            return self._assignment(in_ternary)
        finally:
            self.depth -= 1

    def _assignment(self, in_ternary: bool) -> N:
        t = self.peek(True)
        start = t[2]
        if t[0] == "name":
            after = self.follows()
            if t[1] == "yield" and not (after[0] == "op" and after[1] in ("=", ".", "=>")):
                self.take()
                n = self.peek(True)
                self.eat("*")
                value = None if n[4] or n[0] == "end" or n[1] in (")", "]", "}", ",", ";", ":") else self.assignment()
                return N("Parts", start, self.last, parts=[value] if value else [])
            if after[1] == "=>" and not after[4] and t[1] not in WORDS:
                self.take()
                return self.arrow(start)
            if t[1] == "async" and not after[4] and (after[0] == "name" and after[1] != "function" or after[1] in ("(", "<")):
                if found := self.attempt(lambda: self.async_arrow(start, in_ternary)):
                    return found
        if t[1] == "(" and t[0] == "op" and (found := self.attempt(lambda: self.full_arrow(start, in_ternary))):
            return found
        if t[1] == "<" and t[0] == "op":
            if self.types and (found := self.attempt(lambda: self.full_arrow(start, in_ternary))):
                return found
            if self.types and not self.jsx:
                self.type_arguments()
                e = self.unary()
                return self.rest_of_assignment(N("Parts", start, self.last, parts=[e]), in_ternary)
        return self.rest_of_assignment(self.binary(0), in_ternary)

    def rest_of_assignment(self, left: N, in_ternary: bool) -> N:
        start = left.start
        if self.is_("?"):
            self.take()
            kept, self.no_in = self.no_in, False
            then = self.assignment(in_ternary=True)
            self.no_in = kept
            self.want(":")
            other = self.assignment(in_ternary)
            return N("Conditional", start, self.last, test=left, then=then, other=other)
        t = self.peek()
        if t[0] == "op" and t[1] in ASSIGN:
            self.take()
            right = self.assignment()
            return N("Assign", start, self.last, left=left, right=right)
        return left

    def async_arrow(self, start: int, in_ternary: bool) -> N:
        self.take()
        if self.peek()[0] == "name":
            self.take()
            if not self.is_("=>"):
                raise self.error("no arrow function")
            return self.arrow(start)
        return self.full_arrow(start, in_ternary)

    def full_arrow(self, start: int, in_ternary: bool) -> N:
        if self.is_("<"):
            self.type_parameters()
        self.parameters()
        typed = self.types and self.is_(":")
        self.annotation()
        if not self.is_("=>") or self.peek()[4]:
            raise self.error("no arrow function")
        node = self.arrow(start)
        if typed and in_ternary and not self.is_(":"):
            raise self.error("no arrow function")
        return node

    def arrow(self, start: int) -> N:
        self.want("=>")
        if self.is_("{"):
            kept, self.no_in = self.no_in, False
            body = self.block().body
            self.no_in = kept
        else:
            e = self.assignment()
            body = [N("Expr", e.start, e.end, value=e)]
        return N("Arrow", start, self.last, body=body)

    def binary(self, least: int) -> N:
        left = self.unary()
        while True:
            t = self.peek()
            op = t[1]
            if self.types and t[0] == "name" and op in ("as", "satisfies") and not t[4] and least <= 8:
                self.take()
                if not self.eat("const"):
                    self.type_()
                left = N("Parts", left.start, self.last, parts=[left])
                continue
            if t[0] not in ("op", "name") or op not in BINDING or BINDING[op] < least or op == "in" and self.no_in:
                return left
            self.take()
            right = self.binary(BINDING[op] + (op != "**"))
            left = N("Logical" if op in ("&&", "||", "??") else "Parts", left.start, self.last, parts=[left, right])

    def unary(self) -> N:
        t = self.peek(True)
        if t[0] == "op" and t[1] in ("!", "~", "+", "-", "++", "--") or t[0] == "name" and t[1] in ("typeof", "void", "delete") or t[0] == "name" and t[1] == "await" and (n := self.follows())[0] != "end" and not (n[0] == "op" and n[1] in (")", "]", "}", ",", ";", "=", ".", "=>", ":", "?")):
            self.take()
            e = self.unary()
            kind = "Update" if t[1] in ("++", "--") else "Parts"
            return N(kind, t[2], self.last, parts=[e])
        e = self.postfix(self.primary())
        if self.is_("++", "--") and not self.peek()[4]:
            self.take()
            return N("Update", e.start, self.last, parts=[e])
        return e

    def arguments(self) -> list[N]:
        self.want("(")
        kept, self.no_in = self.no_in, False
        out = []
        while not self.is_(")"):
            if self.eat("..."):
                self.assignment()  # spread arguments are not looked into
            else:
                out.append(self.assignment())
            if not self.eat(","):
                break
        self.want(")")
        self.no_in = kept
        return out

    def postfix(self, e: N, calls: bool = True) -> N:
        chained = False
        while True:
            t = self.peek()
            if t[0] == "tick":
                parts = self.template()
                e = N("Parts", e.start, self.last, parts=[e, *parts])
            elif t[0] != "op":
                break
            elif t[1] == ".":
                self.take()
                self.take()
                e = N("Member", e.start, self.last, object=e, property=None)
            elif t[1] == "?.":
                chained = True
                self.take()
                if self.is_("("):
                    e = N("Call", e.start, self.last, callee=e, args=self.arguments())
                elif self.is_("["):
                    e = self.index(e)
                elif self.is_("<"):
                    self.type_arguments()
                    e = N("Call", e.start, self.last, callee=e, args=self.arguments())
                else:
                    self.take()
                    e = N("Member", e.start, self.last, object=e, property=None)
                e.end = self.last
            elif t[1] == "[":
                e = self.index(e)
            elif t[1] == "(" and calls:
                e = N("Call", e.start, e.end, callee=e, args=self.arguments())
                e.end = self.last
            elif t[1] == "!" and self.types and not t[4]:
                self.take()
                e = N("Parts", e.start, self.last, parts=[e])
            elif t[1] in ("<", "<<") and self.types and self.attempt(self.instantiation):
                pass
            else:
                break
        return N("Chain", e.start, e.end, element=e) if chained else e

    def instantiation(self) -> bool:
        self.type_arguments()
        n = self.peek()
        if n[0] == "tick" or n[1] in ("(", ")", "]", ":", ";", ",", ".", "?.", "==", "!=", "===", "!==", "&&", "||", "??", "}", "") or n[4]:
            return True
        raise self.error("no type arguments")

    def index(self, e: N) -> N:
        self.want("[")
        kept, self.no_in = self.no_in, False
        inner = self.expression()
        self.no_in = kept
        self.want("]")
        return N("Member", e.start, self.last, object=e, property=inner)

    def template(self, types: bool = False) -> list[N]:
        """The expressions of a template literal."""
        self.want("`")
        out = []
        while True:
            m = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S).match(self.text, self.at)
            self.at = m.end()
            if self.text.startswith("`", self.at):
                self.at = self.last = self.at + 1
                return out
            if not self.text.startswith("${", self.at):
                raise self.error("template without end")
            self.at = self.last = self.at + 2
            if types:
                self.type_()
            else:
                out.append(self.expression())
            if not self.is_("}"):
                raise self.error("template without end")
            self.at = self.peek()[3]

    def primary(self) -> N:
        t = self.peek(True)
        kind, word, start = t[0], t[1], t[2]
        if kind in ("str", "num", "regex"):
            self.take(True)
            return N("Literal", start, self.last, text=word)
        if kind == "tick":
            parts = self.template()
            return N("Parts", start, self.last, parts=parts)
        if kind == "name":
            if word == "function" or word == "async" and self.follows()[1] == "function" and not self.follows()[4]:
                return self.function(start)
            if word == "class":
                return self.class_(start)
            if word == "new":
                self.take()
                if self.eat("."):
                    self.take()
                    return N("Name", start, self.last)
                callee = self.postfix(self.primary(), calls=False)
                args = self.arguments() if self.is_("(") else []
                return N("Call", start, self.last, callee=callee, args=args)
            if word == "import":
                self.take()
                if self.eat("."):
                    self.take()
                    return N("Name", start, self.last)
                args = self.arguments()
                return N("Parts", start, self.last, parts=args[:1])
            if word in WORDS - {"this", "super", "null", "true", "false"}:
                raise self.error(f"unexpected {word!r}")
            self.take()
            return N("Name", start, self.last)
        if word == "(":
            self.take()
            kept, self.no_in = self.no_in, False
            e = self.expression()
            self.no_in = kept
            self.want(")")
            return N("Parts", start, self.last, parts=[e])
        if word == "[":
            self.take()
            kept, self.no_in = self.no_in, False
            parts = []
            while not self.is_("]"):
                if self.eat(","):
                    continue
                if self.eat("..."):
                    self.assignment()
                else:
                    parts.append(self.assignment())
                if not self.eat(","):
                    break
            self.want("]")
            self.no_in = kept
            return N("Parts", start, self.last, parts=parts)
        if word == "{":
            return self.object_(start)
        if word == "<" and self.jsx:
            return self.element()
        if word == "@":
            self.decorators()
            return self.primary()
        raise self.error(f"unexpected {word!r}" if word else "source ends too early")

    def object_(self, start: int) -> N:
        self.take()
        kept, self.no_in = self.no_in, False
        members = []
        while not self.is_("}"):
            at = self.peek()[2]
            if self.eat("..."):
                members.append(N("Spread", at, self.last, value=self.assignment()))
            else:
                while self.is_("get", "set", "async") and not (self.follows()[0] == "op" and self.follows()[1] in (",", ":", "(", "}", "=", "<")):
                    self.take()
                self.eat("*")
                key, computed, key_node = self.key()
                if self.is_("(", "<"):
                    value = self.rest_of_function(self.peek()[2], None)
                elif self.eat(":"):
                    value = self.assignment()
                elif self.eat("="):
                    self.assignment()
                    value = None
                else:
                    value = None
                members.append(N("Entry", at, self.last, key=key, computed=computed, key_node=key_node, value=value))
            if not self.eat(","):
                break
        self.want("}")
        self.no_in = kept
        return N("Object", start, self.last, members=members)

    def element(self) -> N:
        start = self.want("<")
        parts: list[N] = []
        if self.is_(">"):
            self.at = self.last = self.peek()[2] + 1
            self.children(parts)
            return N("Parts", start, self.last, parts=parts)
        self.tag()
        if self.is_("<"):
            self.type_arguments()
        while not (self.peek()[0] == "op" and (self.peek()[1].startswith(">") or self.peek()[1] == "/")):
            if self.eat("{"):
                self.want("...")
                parts.append(self.assignment())
                self.want("}")
                continue
            self.tag()
            if self.eat("="):
                if self.is_("{"):
                    self.take()
                    parts.append(self.expression())
                    self.want("}")
                elif self.is_("<"):
                    parts.append(self.element())
                else:
                    m = re.compile(r"\s*(\"[^\"]*\"|'[^']*')", re.S).match(self.text, self.at)
                    if not m:
                        raise self.error("no attribute value")
                    self.at = self.last = m.end()
        if self.eat("/"):
            self.at = self.last = self.peek()[2] + 1
            return N("Parts", start, self.last, parts=parts)
        self.at = self.last = self.peek()[2] + 1
        self.children(parts)
        return N("Parts", start, self.last, parts=parts)

    def tag(self) -> None:
        m = re.compile(r"\s*[\w$][\w$.:-]*").match(self.text, self.at)
        if not m:
            raise self.error("no name")
        self.at = self.last = m.end()

    def children(self, parts: list[N]) -> None:
        while True:
            m = re.compile(r"[^<{]*").match(self.text, self.at)
            self.at = m.end()
            if self.at >= len(self.text):
                raise self.error("element without end")
            if self.text[self.at] == "{":
                self.take()
                if self.eat("..."):
                    parts.append(self.expression())
                elif not self.is_("}"):
                    parts.append(self.expression())
                self.want("}")
            elif re.compile(r"<\s*/").match(self.text, self.at):
                end = self.text.find(">", self.at)
                if end < 0:
                    raise self.error("element without end")
                self.at = self.last = end + 1
                return
            else:
                parts.append(self.element())


class Finder:
    """Counts functions. depth None: outside of functions, nothing is charged."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.functions: list[dict] = []

    def place(self, at: int) -> tuple[int, int]:
        """Line and column (in bytes), from 1."""
        n = bisect_right(self.lines, at) - 1
        return n + 1, len(self.text[self.lines[n] : at].encode()) + 1

    def charge(self, out: list[dict], kind: str, node: N, depth: int | None) -> None:
        if depth is not None:
            line, column = self.place(node.start)
            out.append({"kind": kind, "line": line, "column": column, "increment": 1, "end_line": self.place(max(node.end - 1, 0))[0], "nesting_depth": depth})

    def record(self, name: str, node: N) -> None:
        found: list[dict] = []
        for s in node.body or ():
            self.statement(s, found, 0)
        start, end = self.place(node.start), self.place(max(node.end - 1, 0))
        found.sort(key=lambda c: (c["line"], c["column"]))
        self.functions.append({"qualified_name": name, "start_line": start[0], "end_line": end[0], "start_column": start[1], "end_column": end[1], "complexity": 1 + len(found), "metric": "cyclomatic", "contributors": found})

    def named(self, value: N, name: str | None, out: list[dict], depth: int | None) -> None:
        """A value that may take its name from where it stands."""
        if value.type == "Arrow":
            self.record(name or "<arrow>", value)
        elif value.type == "Function":
            self.record(name or value.name or "<anonymous>", value)
        elif value.type == "Class":
            self.class_(value, value.name or name or "<anonymous class>")
        else:
            self.expression(value, out, depth)

    def class_(self, node: N, name: str) -> None:
        for m in node.members:
            if m.type == "Method":
                self.record(f"{name}.{m.key or '<computed>'}", m.value)
            elif m.type == "StaticBlock":
                self.record(f"{name}.<static-init>", m)
            elif m.type == "Property":
                if m.computed and m.key_node is not None:
                    self.expression(m.key_node, [], None)
                if m.value is not None:
                    self.named(m.value, f"{name}.{m.key or '<computed>'}", [], None)

    def statement(self, s: N | None, out: list[dict], depth: int | None, prefix: str | None = None) -> None:
        if s is None:
            return
        deeper = None if depth is None else depth + 1
        kind = s.type
        qualified = lambda n: f"{prefix}.{n}" if prefix else n
        if kind == "Function":
            self.record(qualified(s.name) if s.name else "<anonymous>", s)
        elif kind == "Class":
            self.class_(s, qualified(s.name or "<anonymous class>"))
        elif kind == "Variables":
            for name, init in s.items:
                if init is not None:
                    self.named(init, qualified(name) if name else None, out, depth)
        elif kind == "If":
            self.charge(out, "if-branch", s, depth)
            self.expression(s.test, out, depth)
            self.statement(s.then, out, deeper)
            self.statement(s.other, out, depth if s.other is not None and s.other.type == "If" else deeper)
        elif kind == "For":
            self.charge(out, "for-loop", s, depth)
            if s.init is not None and s.init.type == "Variables":
                for _, init in s.init.items:
                    self.expression(init, out, depth)
            else:
                self.expression(s.init, out, depth)
            self.expression(s.test, out, depth)
            self.expression(s.update, out, depth)
            self.statement(s.body, out, deeper)
        elif kind == "ForIn":
            self.charge(out, "for-loop", s, depth)
            self.expression(s.right, out, depth)
            self.statement(s.body, out, deeper)
        elif kind in ("While", "DoWhile"):
            self.charge(out, "while-loop" if kind == "While" else "do-while-loop", s, depth)
            self.expression(s.test, out, depth)
            self.statement(s.body, out, deeper)
        elif kind == "Switch":
            self.expression(s.subject, out, depth)
            for c in s.cases:
                if c.test is not None:
                    self.charge(out, "case-branch", c, depth)
                    self.expression(c.test, out, depth)
                for x in c.body:
                    self.statement(x, out, deeper)
        elif kind == "Block":
            for x in s.body:
                self.statement(x, out, depth)
        elif kind in ("Expr", "Return"):
            self.expression(s.value, out, depth)
        elif kind == "Try":
            if s.handler is not None:
                self.charge(out, "catch", s, depth)
            for b in (s.body, s.handler, s.final):
                self.statement(b, out, depth)
        elif kind == "Labeled":
            self.statement(s.body, out, depth)
        elif kind == "Namespace":
            inner = ".".join([*([prefix] if prefix else []), *s.names])
            for x in s.body:
                self.statement(x, out, depth, inner)
        elif kind == "Export":
            if s.inner.type in ("Function", "Class", "Variables"):
                self.statement(s.inner, out, depth, prefix)
        elif kind == "ExportDefault" and s.inner is not None:
            self.statement(s.inner, [], None, prefix)

    def expression(self, e: N | None, out: list[dict], depth: int | None) -> None:
        if e is None:
            return
        kind = e.type
        if kind in ("Arrow", "Function", "Class"):
            self.named(e, None, out, depth)
        elif kind in ("Parts", "Logical"):
            if kind == "Logical":
                self.charge(out, "logical-operator", e, depth)
            for x in e.parts:
                self.expression(x, out, depth)
        elif kind == "Conditional":
            self.charge(out, "ternary", e, depth)
            for x in (e.test, e.then, e.other):
                self.expression(x, out, depth)
        elif kind == "Chain":
            self.charge(out, "optional-chain", e, depth)
            self.expression(e.element, out, depth)
        elif kind == "Call":
            self.expression(e.callee, out, depth)
            for x in e.args:
                self.expression(x, out, depth)
        elif kind == "Member":
            self.expression(e.object, out, depth)
            self.expression(e.property, out, depth)
        elif kind == "Assign":
            if e.left.type == "Member":
                self.expression(e.left, out, depth)
            self.expression(e.right, out, depth)
        elif kind == "Update":
            if e.parts[0].type == "Member":
                self.expression(e.parts[0], out, depth)
        elif kind == "Object":
            for m in e.members:
                if m.type == "Entry" and m.computed:
                    self.expression(m.key_node, out, depth)
                self.expression(m.value, out, depth)


def script_functions(text: str, path: str) -> list[dict]:
    """The functions of a source file, without file_path: name, span, complexity, contributors. The path's extension tells the dialect."""
    extension = path.rpartition(".")[2]
    typed = extension in ("ts", "tsx", "mts", "cts")
    parser = Parser(text, extension not in ("ts", "mts", "cts"), typed)
    finder = Finder(text)
    for s in parser.program():
        finder.statement(s, [], None)
    return finder.functions
