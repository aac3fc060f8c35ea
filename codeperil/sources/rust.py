"""Complexity of Rust functions: a lexer, a parser of what control flow needs, and the two counts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KEYWORDS_OF_ITEMS = {"fn", "struct", "enum", "union", "impl", "trait", "mod", "use", "static", "type", "extern", "pub", "macro_rules"}
OPERATORS = ("<<=", ">>=", "...", "..=", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<", ">>", "->", "=>", "::", "..")
COMPOUND = {"+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="}
#: Binary operators and how tightly they bind.
BINDING = {"||": 3, "&&": 4, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}

#: The operator that up to three joint characters begin with.
_operator_of: dict[str, str] = {}


class RustSyntaxError(ValueError):
    """Source that the parser can't follow."""


@dataclass(slots=True)
class Token:
    kind: str  # id, life, lit, op, doc, end
    text: str
    line: int
    column: int  # from 0
    end_line: int
    end_column: int
    joint: bool = False  # an operator's character directly before another


@dataclass(slots=True)
class Node:
    kind: str
    first: Token
    last: Token
    parts: list = field(default_factory=list)
    mark: Token | None = None  # keyword or operator
    extra: object = None


_SPACE = re.compile(r"\s+")
_IDENT = re.compile(r"(?:r#)?[^\W\d]\w*")
_NUMBER = re.compile(r"0[xob][0-9a-fA-F_]+\w*|\d[\d_]*(?:\.(?!\.|[^\W\d])[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*")
_RAW = re.compile(r'(?:b|c)?r(#*)"')
_STRING = re.compile(r'(?:b|c)?"(?:[^"\\]|\\.)*"', re.S)
_CHAR = re.compile(r"b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.))'", re.S)
_LIFETIME = re.compile(r"'(?:r#)?[^\W\d]\w*")


def tokens_of(text: str) -> list[Token]:
    out: list[Token] = []
    at, line, start = 0, 1, 0

    def add(kind: str, end: int) -> None:
        nonlocal at, line, start
        piece = text[at:end]
        before, column = line, at - start
        breaks = piece.count("\n")
        if breaks:
            line += breaks
            start = at + piece.rindex("\n") + 1
        if kind:
            out.append(Token(kind, piece, before, column, line, end - start))
        at = end

    if text.startswith("#!") and not text.startswith("#!["):
        add("", text.find("\n") if "\n" in text else len(text))
    while at < len(text):
        c = text[at]
        if c.isspace() or c == "﻿":
            add("", m.end() if (m := _SPACE.match(text, at)) else at + 1)
        elif text.startswith("//", at):
            end = text.find("\n", at)
            outer = text.startswith("///", at) and not text.startswith("////", at)
            add("doc" if outer else "", len(text) if end < 0 else end)
        elif text.startswith("/*", at):
            depth, end = 1, at + 2
            while depth:
                m = re.compile(r"/\*|\*/").search(text, end)
                if not m:
                    raise RustSyntaxError(f"line {line}: comment without end")
                depth += 1 if m[0] == "/*" else -1
                end = m.end()
            outer = text.startswith("/**", at) and not text.startswith(("/***", "/**/"), at)
            add("doc" if outer else "", end)
        elif m := _RAW.match(text, at):
            end = text.find('"' + m[1], m.end())
            if end < 0:
                raise RustSyntaxError(f"line {line}: string without end")
            add("lit", end + 1 + len(m[1]))
        elif m := _STRING.match(text, at):
            add("lit", m.end())
        elif m := _CHAR.match(text, at):
            add("lit", m.end())
        elif m := _LIFETIME.match(text, at):
            add("life", m.end())
        elif c.isdigit():
            add("lit", _NUMBER.match(text, at).end())
        elif m := _IDENT.match(text, at):
            add("id", m.end())
        elif c in "'\"":
            raise RustSyntaxError(f"line {line}: literal without end")
        else:
            joint = at + 1 < len(text) and text[at + 1] in "!#$%&*+,-./:;<=>?@^|~()[]{}"
            add("op", at + 1)
            out[-1].joint = joint
    out.append(Token("end", "", line, at - start, line, at - start))
    return out


class Parser:
    """Finds functions and parses their bodies."""

    def __init__(self, text: str):
        self.tokens = tokens_of(text)
        self.at = 0
        self.functions: list[tuple[str, Token, Token, Node]] = []  # qualified name, first and last token, body
        self.path: list[str] = []
        self.owner: str | None = None

    # tokens

    @property
    def now(self) -> Token:
        k = self.at
        while self.tokens[k].kind == "doc":
            k += 1
        return self.tokens[k]

    @property
    def before(self) -> Token:
        k = self.at - 1
        while k > 0 and self.tokens[k].kind == "doc":
            k -= 1
        return self.tokens[k]

    def ahead(self, n: int) -> Token:
        k = self.at
        while True:
            if self.tokens[k].kind != "doc":
                if n == 0:
                    return self.tokens[k]
                n -= 1
            if self.tokens[k].kind == "end":
                return self.tokens[k]
            k += 1

    def operator(self) -> str:
        """The operator here, of as many characters as it has, or nothing."""
        if self.now.kind != "op":
            return ""
        text = self.now.text
        for n in (1, 2):
            previous = self.ahead(n - 1)
            if not previous.joint or self.ahead(n).kind != "op":
                break
            text += self.ahead(n).text
        if (known := _operator_of.get(text)) is None:
            known = _operator_of[text] = next((op for op in OPERATORS if text.startswith(op)), text[:1])
        return known

    def take(self) -> Token:
        t = self.now
        if t.kind == "end":
            raise RustSyntaxError(f"line {t.line}: source ends too early")
        while self.tokens[self.at].kind == "doc":
            self.at += 1
        self.at += 1
        return t

    def skip(self, op: str) -> Token:
        if self.operator() != op and self.now.text != op:
            raise RustSyntaxError(f"line {self.now.line}: expected {op!r}, found {self.now.text!r}")
        first = self.now
        for _ in op if self.now.kind == "op" else "x":
            self.take()
        return first

    def word(self, *texts: str) -> bool:
        return self.now.kind == "id" and self.now.text in texts

    def group(self) -> None:
        """Pass over a bracketed group."""
        close = [OPEN[self.take().text]]
        while close:
            t = self.take()
            if t.kind == "op" and t.text in OPEN:
                close.append(OPEN[t.text])
            elif t.kind == "op" and t.text in CLOSE and t.text != close.pop():
                raise RustSyntaxError(f"line {t.line}: unmatched {t.text!r}")

    def until(self, *stops: str) -> str:
        """Pass over tokens and groups up to one of the operators or words."""
        while True:
            t = self.now
            here = self.operator() if t.kind == "op" else t.text if t.kind == "id" else ""
            if here in stops:
                return here
            if t.kind == "op" and t.text in OPEN:
                self.group()
            elif t.kind == "op" and t.text in CLOSE:
                raise RustSyntaxError(f"line {t.line}: unmatched {t.text!r}")
            elif t.kind == "op" and len(here) > 1:
                self.skip(here)
            else:
                self.take()

    def attributes(self) -> None:
        while self.now.text == "#" and self.now.kind == "op" and (self.ahead(1).text == "[" or self.ahead(1).text == "!" and self.ahead(2).text == "["):
            self.take()
            if self.now.text == "!":
                self.take()
            self.group()

    def first_token(self) -> Token:
        """What an item begins with: its first documentation comment, attribute or token."""
        return self.tokens[self.at]

    # items

    def file(self) -> None:
        while self.now.kind != "end":
            self.item()

    def items(self) -> Token:
        self.skip("{")
        while self.now.text != "}" or self.now.kind != "op":
            self.item()
        return self.skip("}")

    def item(self) -> None:
        while self.tokens[self.at].kind != "doc" and self.now.text == "#" and self.ahead(1).text == "!":
            self.attributes()
        first = self.first_token()
        self.attributes()
        if self.word("pub"):
            self.take()
            if self.now.text == "(":
                self.group()
        while self.word("default", "async", "unsafe", "safe") or (self.word("const") and self.ahead(1).kind == "id" and self.ahead(1).text in ("fn", "async", "unsafe", "extern")) or (self.word("extern") and self.ahead(1).kind == "lit" and self.ahead(2).text not in ("{",)):
            if self.take().text == "extern":
                self.take()
        if self.word("mod") and self.ahead(1).kind == "id":
            self.take()
            name = self.take().text
            if self.now.text == ";":
                self.take()
            else:
                self.path.append(name)
                self.items()
                self.path.pop()
        elif self.word("fn"):
            self.function(first)
        elif self.word("impl"):
            self.implementation()
        elif self.word("trait"):
            self.take()
            name = self.take().text
            if self.until("{", ";") == "{":
                self.owned(name)
            else:
                self.take()
        elif self.word("extern") and (self.ahead(1).text == "{" or self.ahead(2).text == "{"):
            self.until("{")
            self.group()
        elif self.word("struct", "enum", "union"):
            if self.until("{", ";") == "{":
                self.group()
            else:
                self.take()
        elif self.now.kind == "id" and (self.ahead(1).text == "!" or self.ahead(1).text == ":" and self.macro_path()):
            self.until("(", "[", "{")
            brace = self.now.text == "{"
            self.group()
            if not brace and self.now.text == ";":
                self.take()
        elif self.now.text == ";":
            self.take()
        elif self.now.kind == "id":
            self.until(";")
            self.take()
        else:
            raise RustSyntaxError(f"line {self.now.line}: no item begins with {self.now.text!r}")

    def macro_path(self) -> bool:
        n = 0
        while self.ahead(n).kind == "id" and self.ahead(n + 1).text == ":" and self.ahead(n + 2).text == ":":
            n += 3
        return self.ahead(n).kind == "id" and self.ahead(n + 1).text == "!"

    def owned(self, name: str) -> None:
        kept, self.owner = self.owner, name
        self.items()
        self.owner = kept

    def implementation(self) -> None:
        self.take()
        if self.now.text == "<":
            self.angles()
        parts: list[Token] = []
        while self.now.text != "{" or self.now.kind != "op":
            t = self.now
            if t.text == "for" and self.ahead(1).text != "<":
                self.take()
                parts = []
            elif t.text == "where":
                self.until("{")
            elif t.text == "<":
                self.angles()
            elif t.kind == "op" and t.text in OPEN:
                parts.append(t)
                self.group()
            else:
                parts.append(self.take())
        plain = parts and all(t.kind == "id" or t.text == ":" for t in parts) and not {t.text for t in parts} & {"dyn", "impl"}
        self.owned(parts[-1].text if plain else "<unknown>")

    def angles(self) -> None:
        depth = 0
        while True:
            op = self.operator()
            if op == "->":
                self.skip("->")
                continue
            t = self.now
            if t.kind == "op" and t.text in OPEN:
                self.group()
                continue
            self.take()
            if t.kind == "op":
                depth += (t.text == "<") - (t.text == ">")
            if depth == 0:
                return

    def function(self, first: Token) -> None:
        self.take()
        name = self.take().text.removeprefix("r#")
        if self.until("{", ";") == ";":
            self.take()
            return
        place = len(self.functions)
        qualified = "::".join([*self.path, *([self.owner] if self.owner else []), name])
        body = self.block()
        self.functions.insert(place, (qualified, first, body.last, body))

    # statements

    def block(self) -> Node:
        first = self.skip("{")
        statements: list[Node] = []
        while not (self.now.kind == "op" and self.now.text == "}"):
            if self.now.kind == "op" and self.now.text == ";":
                self.take()
                continue
            if (s := self.statement()) is not None:
                statements.append(s)
        return Node("block", first, self.skip("}"), statements)

    def starts_item(self) -> bool:
        t, n = self.now, self.ahead(1)
        if t.kind != "id":
            return False
        if t.text == "macro_rules":
            return n.text == "!"
        if t.text == "union":
            return n.kind == "id"
        if t.text in KEYWORDS_OF_ITEMS:
            return True
        if t.text == "const":
            return not (n.text == "{" or n.text == "|" or n.text == "move" or n.text == "async")
        if t.text == "unsafe":
            return n.text in ("fn", "impl", "trait", "extern")
        if t.text == "async":
            return n.text in ("fn", "unsafe") and n.text == "fn" or n.text == "unsafe" and self.ahead(2).text == "fn"
        return False

    def statement(self) -> Node | None:
        kept = self.at
        self.attributes()
        if self.starts_item():
            self.at = kept
            owner, self.owner = self.owner, self.owner
            self.item()
            self.owner = owner
            return None
        if self.word("let"):
            return self.let()
        if self.now.kind == "id" and (self.ahead(1).text == "!" and self.ahead(2).text in OPEN or self.macro_path()) and not (self.ahead(1).text == "!" and self.ahead(2).text == "="):
            mark = self.at
            self.until("(", "[", "{")
            brace = self.now.text == "{"
            self.group()
            if self.now.text == ";" or (brace and self.operator() not in (".", "?")) or self.now.text == "}":
                if self.now.text == ";":
                    self.take()
                return None
            self.at = mark
        e = self.expression(statement=True)
        if self.now.text == ";":
            self.take()
        return e

    def let(self) -> Node:
        first = self.take()
        depth = 0
        while True:
            op = self.operator()
            if depth == 0 and op in ("=", ";"):
                break
            if self.now.kind == "op" and self.now.text in OPEN:
                self.group()
                continue
            if op in ("..=", "...", "..", "->", "::", "=>", "=="):
                self.skip(op)
                continue
            if self.now.kind == "op":
                depth += (self.now.text == "<") - (self.now.text == ">")
            self.take()
        node = Node("local", first, first)
        if self.now.text == "=":
            self.take()
            node.parts.append(self.expression())
            if self.word("else"):
                node.mark = self.take()
                node.extra = self.block()
        node.last = self.before
        if self.now.text == ";":
            self.take()
        return node

    # expressions

    def expression(self, binding: int = 0, structs: bool = True, statement: bool = False) -> Node:
        left = self.prefix(structs, statement)
        if statement and left.kind in ("if", "match", "while", "for", "loop", "block", "unsafe") and self.operator() not in (".", "?"):
            return left
        while True:
            if self.word("as") and binding <= 12:
                self.take()
                self.type_()
                left = Node("other", left.first, self.before, [left])
                continue
            op = self.operator()
            if op in ("..", "..=") and binding <= 2:
                self.skip(op)
                right = [self.expression(3, structs)] if self.begins_expression(structs) else []
                left = Node("other", left.first, self.before, [left, *right])
            elif op == "=" and binding <= 1:
                self.skip(op)
                right = self.expression(1, structs)
                left = Node("other", left.first, right.last, [left, right])
            elif op in COMPOUND and binding <= 1:
                mark = self.skip(op)
                right = self.expression(1, structs)
                left = Node("binary", left.first, right.last, [left, right], mark, op)
            elif op in BINDING and binding <= BINDING[op]:
                mark = self.skip(op)
                right = self.expression(BINDING[op] + 1, structs)
                left = Node("binary", left.first, right.last, [left, right], mark, op)
            else:
                return left

    def begins_expression(self, structs: bool) -> bool:
        t = self.now
        if t.kind in ("lit", "life"):
            return True
        if t.kind == "id":
            return t.text not in ("else", "as", "in")
        return t.kind == "op" and (t.text in "([-!*&|" or (t.text == "{" and structs) or self.operator() in ("::", "<"))

    def prefix(self, structs: bool, statement: bool = False) -> Node:
        t = self.now
        op = self.operator()
        if op in ("&&", "&"):
            if op == "&&":
                self.skip("&&")
            else:
                self.take()
            if self.word("raw") and self.ahead(1).text in ("const", "mut"):
                self.take()
            if self.word("mut", "const"):
                self.take()
            e = self.expression(13, structs)
            return Node("pass", t, e.last, [e])
        if op in ("-", "!", "*"):
            self.take()
            e = self.expression(13, structs)
            return Node("pass", t, e.last, [e])
        if op in ("..", "..="):
            self.skip(op)
            e = [self.expression(3, structs)] if self.begins_expression(structs) else []
            return Node("other", t, self.before, e)
        if op in ("|", "||"):
            return self.closure(t)
        return self.postfix(self.primary(structs), statement)

    def closure(self, first: Token) -> Node:
        if self.operator() == "||":
            self.skip("||")
        else:
            self.take()
            self.until("|")
            self.take()
        if self.operator() == "->":
            self.skip("->")
            self.type_(braces=False)
            body = self.block()
        else:
            body = self.expression(1)
        return Node("closure", first, body.last, [body])

    def postfix(self, e: Node, statement: bool = False) -> Node:
        if statement and e.kind in ("if", "match", "while", "for", "loop", "block", "unsafe") and self.operator() not in (".", "?"):
            return e
        while True:
            op = self.operator()
            if op == "?":
                mark = self.take()
                e = Node("try", e.first, mark, [e], mark)
            elif op == ".":
                self.take()
                if self.word("await"):
                    e = Node("other", e.first, self.take(), [e])
                    continue
                name = self.take()
                if name.kind == "lit" and "." in name.text:
                    e = Node("other", e.first, name, [e])
                    continue
                if self.operator() == "::":
                    self.skip("::")
                    self.angles()
                if self.now.text == "(" and name.kind == "id":
                    args = self.list("(", ")")
                    e = Node("method", e.first, self.before, [e, *args])
                else:
                    e = Node("other", e.first, name, [e])
            elif op == "(":
                e = Node("call", e.first, e.first, [e, *self.list("(", ")")])
                e.last = self.before
            elif op == "[":
                e = Node("other", e.first, e.first, [e, *self.list("[", "]")])
                e.last = self.before
            else:
                return e

    def list(self, open_: str, close: str) -> list[Node]:
        self.skip(open_)
        out = []
        while self.now.text != close or self.now.kind != "op":
            self.attributes()
            out.append(self.expression())
            if self.now.text in (",", ";"):
                self.take()
        self.skip(close)
        return out

    def primary(self, structs: bool) -> Node:
        t = self.now
        if t.kind == "life":
            self.take()
            self.skip(":")
            e = self.primary(structs)
            e.first = t
            return e
        if t.kind == "lit":
            return Node("leaf", t, self.take())
        if t.kind == "op":
            if t.text == "(":
                self.take()
                parts, comma = [], False
                while self.now.text != ")":
                    self.attributes()
                    parts.append(self.expression())
                    if self.now.text == ",":
                        self.take()
                        comma = True
                return Node("pass" if len(parts) == 1 and not comma else "tuple", t, self.skip(")"), parts)
            if t.text == "[":
                parts = self.list("[", "]")
                return Node("other", t, self.before, parts)
            if t.text == "{":
                return self.block()
            if t.text == "<":
                self.angles()
                return self.path_expression(t, structs)
            if self.operator() == "::":
                return self.path_expression(t, structs)
            if t.text == "#":
                self.attributes()
                return self.primary(structs)
            raise RustSyntaxError(f"line {t.line}: no expression begins with {t.text!r}")
        if t.kind == "end":
            raise RustSyntaxError(f"line {t.line}: source ends too early")
        word = t.text
        if word == "if":
            self.take()
            cond = self.expression(0, structs=False)
            then = self.block()
            node = Node("if", t, then.last, [cond, then], t)
            if self.word("else"):
                self.take()
                other = self.primary(True) if self.word("if") else self.block()
                node.extra, node.last = other, other.last
            return node
        if word == "let":
            self.take()
            self.until("=")
            self.take()
            e = self.expression(5, structs=False)
            return Node("other", t, e.last, [e])
        if word == "match":
            self.take()
            subject = self.expression(0, structs=False)
            self.skip("{")
            arms = []
            while self.now.text != "}" or self.now.kind != "op":
                first = self.first_token()
                self.attributes()
                pattern = self.now
                if self.now.text == "|":
                    self.take()
                    pattern = self.now
                guard = None
                if self.until("=>", "if") == "if":
                    self.take()
                    guard = self.expression()
                self.skip("=>")
                body = self.expression(statement=True)
                if self.now.text == ",":
                    self.take()
                arms.append(Node("arm", first, self.before, [guard, body], pattern))
            return Node("match", t, self.skip("}"), [subject, *arms], t)
        if word == "while":
            self.take()
            cond = self.expression(0, structs=False)
            body = self.block()
            return Node("while", t, body.last, [cond, body], t)
        if word == "for" and self.ahead(1).text != "<":
            self.take()
            self.until("in")
            self.take()
            over = self.expression(0, structs=False)
            body = self.block()
            return Node("for", t, body.last, [over, body], t)
        if word == "loop":
            self.take()
            body = self.block()
            return Node("loop", t, body.last, [body], t)
        if word == "unsafe" or word == "const" and self.ahead(1).text == "{" or word == "try" and self.ahead(1).text == "{":
            self.take()
            body = self.block()
            return Node("unsafe", t, body.last, [body])
        if word == "async" and (self.ahead(1).text == "{" or self.ahead(1).text == "move" and self.ahead(2).text == "{"):
            self.take()
            if self.word("move"):
                self.take()
            body = self.block()
            return Node("other", t, body.last, [body])
        if word in ("move", "static", "async") and self.ahead(1).text in ("|", "move", "async"):
            while self.word("move", "static", "async"):
                self.take()
            return self.closure(t)
        if word == "for":
            self.take()
            self.angles()
            while self.word("move", "static", "async"):
                self.take()
            return self.closure(t)
        if word in ("return", "yield"):
            self.take()
            parts = [self.expression(1, structs)] if self.begins_expression(structs) else []
            return Node("return", t, self.before, parts)
        if word == "break":
            self.take()
            if self.now.kind == "life":
                self.take()
            parts = [self.expression(1, structs)] if self.begins_expression(structs) else []
            return Node("break", t, self.before, parts, t)
        if word == "continue":
            self.take()
            if self.now.kind == "life":
                self.take()
            return Node("continue", t, self.before, [], t)
        return self.path_expression(t, structs)

    def path_expression(self, first: Token, structs: bool) -> Node:
        while True:
            if self.operator() == "::":
                self.skip("::")
                if self.now.text == "<":
                    self.angles()
                    continue
            if self.now.kind == "id":
                self.take()
            if self.operator() != "::":
                break
        if self.now.text == "!" and self.now.kind == "op" and self.operator() == "!" and self.ahead(1).text in OPEN:
            self.take()
            self.group()
            return Node("leaf", first, self.before)
        if self.now.text == "{" and structs and self.struct_follows():
            self.skip("{")
            parts = []
            while self.now.text != "}" or self.now.kind != "op":
                self.attributes()
                if self.operator() == "..":
                    self.skip("..")
                    if self.now.text != "}":
                        parts.append(self.expression())
                else:
                    self.take()
                    if self.now.text == ":":
                        self.take()
                        parts.append(self.expression())
                if self.now.text == ",":
                    self.take()
            return Node("other", first, self.skip("}"), parts)
        return Node("leaf", first, self.before)

    def struct_follows(self) -> bool:
        a, b = self.ahead(1), self.ahead(2)
        if a.text == "}":
            return True
        if a.text == "#":
            return True
        if a.text == "." and b.text == ".":
            return True
        return a.kind in ("id", "lit") and b.text in (":", ",", "}") and not (b.text == ":" and self.ahead(3).text == ":")

    def type_(self, braces: bool = True) -> None:
        """Pass over a type in an expression."""
        while True:
            t, op = self.now, self.operator()
            if op in ("&", "&&", "*"):
                self.skip(op)
            elif t.kind == "life" or self.word("mut", "const", "dyn", "impl", "unsafe", "extern"):
                self.take()
            elif t.kind == "op" and t.text in ("(", "["):
                self.group()
                if self.operator() == "->":
                    self.skip("->")
                    continue
                return
            elif t.text == "<" or t.kind == "id" or op == "::":
                while True:
                    if self.operator() == "::":
                        self.skip("::")
                    if self.now.text == "<" and self.now.kind == "op" and self.operator() == "<":
                        self.angles()
                    elif self.now.kind == "id" and not self.word("as"):
                        self.take()
                    if self.now.text == "(" and self.before.text in ("Fn", "FnMut", "FnOnce", "fn"):
                        self.group()
                        if self.operator() == "->":
                            self.skip("->")
                            self.type_()
                    if self.operator() == "<" and self.before.kind == "id":
                        self.angles()
                    if self.operator() != "::":
                        return
            elif op == "!":
                self.take()
                return
            else:
                return


class Counter:
    """Counts a body and lists what contributes."""

    def __init__(self, metric: str):
        self.cognitive = metric == "cognitive"
        self.found: list[dict] = []

    def add(self, kind: str, mark: Token, end_line: int, depth: int, increment: int) -> None:
        self.found.append({"kind": kind, "line": mark.line, "column": mark.column + 1, "increment": increment, "end_line": end_line, "nesting_depth": depth})

    def structural(self, kind: str, node: Node, depth: int) -> None:
        self.add(kind, node.mark, node.last.end_line, depth, 1 + depth if self.cognitive else 1)

    def visit(self, e: Node | None, depth: int) -> None:
        if e is None:
            return
        kind = e.kind
        if kind == "block":
            for s in e.parts:
                self.visit(s, depth)
        elif kind == "local":
            for x in e.parts:
                self.visit(x, depth)
            if e.extra is not None:
                self.add("let-else", e.mark, e.extra.last.end_line, depth, 1 + depth if self.cognitive else 1)
                self.visit(e.extra, depth + 1)
        elif kind == "if":
            self.structural("if-branch", e, depth)
            while True:
                self.visit(e.parts[0], depth)
                self.visit(e.parts[1], depth + 1)
                other = e.extra
                if other is None or other.kind != "if":
                    self.visit(other, depth + 1)
                    return
                self.add("if-branch", other.mark, other.last.end_line, depth, 1)
                e = other
        elif kind == "match":
            arms = e.parts[1:]
            if self.cognitive:
                self.structural("match", e, depth)
            else:
                for arm in arms[1:]:
                    self.add("match-arm", arm.mark, arm.last.end_line, depth, 1)
            self.visit(e.parts[0], depth)
            for arm in arms:
                for x in arm.parts:
                    self.visit(x, depth + 1)
        elif kind in ("while", "for"):
            self.structural(f"{kind}-loop", e, depth)
            self.visit(e.parts[0], depth)
            self.visit(e.parts[1], depth + 1)
        elif kind == "loop":
            self.structural("loop", e, depth)
            self.visit(e.parts[0], depth + 1)
        elif kind == "binary":
            self.binary(e, depth)
        elif kind == "try":
            self.add("try", e.mark, e.mark.end_line, depth, 1)
            self.visit(e.parts[0], depth)
        elif kind in ("break", "continue"):
            self.add(kind, e.mark, e.mark.end_line, depth, 1)
            if not self.cognitive:
                for x in e.parts:
                    self.visit(x, depth)
        elif kind == "closure":
            self.visit(e.parts[0], depth + 1)
        elif kind in ("call", "method", "tuple", "pass", "return") or not self.cognitive:
            for x in e.parts:
                self.visit(x, depth)

    def binary(self, e: Node, depth: int) -> None:
        if not self.cognitive:
            if e.extra in ("&&", "||"):
                self.add("logical-operator", e.mark, e.mark.end_line, depth, 1)
            for x in e.parts:
                self.visit(x, depth)
            return
        last = None
        leaves: list[Node] = []

        def walk(x: Node) -> None:
            nonlocal last
            if x.kind != "binary":
                leaves.append(x)
                return
            walk(x.parts[0])
            if x.extra in ("&&", "||"):
                if last != x.extra:
                    self.add("logical-operator", x.mark, x.mark.end_line, depth, 1)
                last = x.extra
            else:
                last = None
            walk(x.parts[1])

        walk(e)
        for x in leaves:
            self.visit(x, depth)


def rust_functions(text: str, metric: str = "cognitive") -> list[dict]:
    """The functions of a source file in order, without file_path: name, span, complexity, contributors."""
    parser = Parser(text)
    parser.file()
    out = []
    for name, first, last, body in parser.functions:
        counter = Counter(metric)
        counter.visit(body, 0)
        found = sorted(counter.found, key=lambda c: (c["line"], c["column"]))
        out.append(
            {
                "qualified_name": name, "start_line": first.line, "end_line": last.end_line, "start_column": first.column + 1, "end_column": last.end_column,
                "complexity": 1 + sum(c["increment"] for c in found), "metric": metric, "contributors": found,
            }
        )
    return out
