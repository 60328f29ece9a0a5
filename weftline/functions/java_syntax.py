"""A recogniser for the syntax of Java 17 compilation units: tokens by one pattern, then recursive descent."""

from __future__ import annotations

import re
import sys

KEYWORDS = frozenset(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends final
    finally float for goto if implements import instanceof int interface long native new package private protected public
    return short static strictfp super switch synchronized this throw throws transient try void volatile while _""".split()
)
PRIMITIVES = frozenset("boolean byte char short int long float double".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())
BINARY = frozenset("|| && | ^ & == != < <= << + - * / %".split())

_ESCAPE = r"\\(?:[btnfrs\"'\\]|[0-3]?[0-7]{1,2})"
_DIGITS = r"[0-9](?:[0-9_]*[0-9])?"
_HEX = r"[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?"
_TOKEN = re.compile(
    rf"""
    (?:(?P<space>[ \t\f\r\n]+|//[^\r\n]*|/\*.*?\*/)
  | (?P<word>[^\W\d]\w*(?:\$[\w$]*)?|\$[\w$]*|[€£¥¢][\w$]*)
  | (?P<text>\"\"\"[ \t\f]*(?:\r\n|\n|\r)(?:[^\\"]|\\(?:\r\n|\n|\r)|{_ESCAPE}|"(?!""))*\"\"\")
  | (?P<string>"(?!"")(?:[^"\\\r\n]|{_ESCAPE})*"|""(?!"))
  | (?P<char>'(?:[^'\\\r\n\U00010000-\U0010ffff]|{_ESCAPE})')
  | (?P<number>(?:
        0[xX](?:(?:{_HEX})?\.(?:{_HEX})|(?:{_HEX})\.?)[pP][+-]?{_DIGITS}[fFdD]?
      | 0[xX]{_HEX}[lL]? | 0[bB][01](?:[01_]*[01])?[lL]?
      | (?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?[fFdD]?
      | {_DIGITS}(?:[eE][+-]?{_DIGITS}[fFdD]?|[fFdD])
      | 0(?:[0-7_]*[0-7])?[lL]? | [1-9](?:[0-9_]*[0-9])?[lL]?)(?![\w$]))
  | (?P<op>->|::|\.\.\.|\+\+|--|&&|\|\||<<=|<<|[=!<+\-*/%&|^]=|[-+*/%&|^!~?:;,.@(){{}}\[\]=<>]))[ \t\f\r\n]*
  | (?P<none>.)
    """,
    re.X | re.S,
)
_UNICODE = re.compile(r"(\\+)u+([0-9a-fA-F]{4})")
_WORDS = {w: w for w in KEYWORDS} | dict.fromkeys(("true", "false", "null"), "LIT")
_CLOSE = {")": "(", "]": "[", "}": "{"}


class JavaSyntaxError(Exception):
    """The text is no Java 17 compilation unit."""


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        slashes = m.group(1)
        return slashes[:-1] + chr(int(m.group(2), 16)) if len(slashes) % 2 else m.group()

    return _UNICODE.sub(one, text)


def tokens(text: str) -> tuple[list[str], list[str], list[int]]:
    """Kinds, words and ends of the tokens: 'ID' for identifiers, 'LIT' for literals, else the token itself."""
    if "\\u" in text:
        text = _unescaped(text)
    if text.endswith("\x1a"):
        text = text[:-1]
    kinds, words, starts = [], [], []
    add_kind, add_word, add_start, of_word = kinds.append, words.append, starts.append, _WORDS.get
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            s = m["word"]
            add_kind(of_word(s, "ID"))
        elif kind == "op":
            s = m["op"]
            add_kind(s)
        elif kind == "space":
            continue
        elif kind == "none":
            raise JavaSyntaxError(f"no token at {m.start()}")
        else:
            s = m[kind]
            add_kind("LIT")
        add_word(s)
        add_start(m.start())
    return kinds, words, starts


class Parser:
    """Recursive descent over the tokens of one compilation unit. Methods raise JavaSyntaxError."""

    def __init__(self, text: str):
        self.k, self.w, self.at = tokens(text)
        self.match = self._brackets()
        self.k += ["EOF"] * 4
        self.w += [""] * 4
        self.at += [-1] * 4
        self.i = 0

    def _brackets(self) -> dict[int, int]:
        stack, match = [], {}
        for i, t in enumerate(self.k):
            if t in ("(", "[", "{"):
                stack.append(i)
            elif t in (")", "]", "}"):
                if not stack or self.k[stack[-1]] != _CLOSE[t]:
                    raise JavaSyntaxError("unbalanced brackets")
                match[stack.pop()] = i
        if stack:
            raise JavaSyntaxError("unclosed bracket")
        return match

    def fail(self) -> None:
        raise JavaSyntaxError(f"unexpected {self.w[self.i]!r} at token {self.i}")

    def need(self, kind: str) -> None:
        if self.k[self.i] != kind:
            self.fail()
        self.i += 1

    def take(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def is_word(self, word: str, ahead: int = 0) -> bool:
        return self.k[self.i + ahead] == "ID" and self.w[self.i + ahead] == word

    # types, as positions: -1 where no type is

    def skip_annotations(self, i: int) -> int:
        k = self.k
        while k[i] == "@" and k[i + 1] == "ID":
            i += 2
            while k[i] == "." and k[i + 1] == "ID":
                i += 2
            if k[i] == "(":
                i = self.match[i] + 1
        return i

    def skip_dims(self, i: int) -> int:
        while True:
            j = self.skip_annotations(i)
            if self.k[j] == "[" and self.k[j + 1] == "]":
                i = j + 2
            else:
                return i

    def skip_type(self, i: int, dims: bool = True) -> int:
        k = self.k
        i = self.skip_annotations(i)
        if k[i] in PRIMITIVES:
            i += 1
            return self.skip_dims(i) if dims else i
        if k[i] != "ID":
            return -1
        while True:
            i += 1
            if k[i] == "<":
                i = self.skip_args(i)
                if i < 0:
                    return -1
            if k[i] != ".":
                break
            j = self.skip_annotations(i + 1)
            if k[j] != "ID":
                break
            i = j
        return self.skip_dims(i) if dims else i

    def skip_args(self, i: int) -> int:
        """After the type arguments that open at i; a diamond counts."""
        k = self.k
        i += 1
        if k[i] == ">":
            return i + 1
        while True:
            i = self.skip_annotations(i)
            if k[i] == "?":
                i += 1
                if k[i] in ("extends", "super"):
                    i = self.skip_type(i + 1)
            else:
                i = self.skip_type(i)
            if i < 0:
                return -1
            if k[i] == ",":
                i += 1
            elif k[i] == ">":
                return i + 1
            else:
                return -1

    def type(self, dims: bool = True) -> None:
        self.annotations()
        j = self.skip_type(self.i, dims)
        if j < 0:
            self.fail()
        self.i = j

    def class_types(self) -> None:
        self.type(False)
        while self.take(","):
            self.type(False)

    def type_params(self) -> None:
        self.need("<")
        while True:
            self.annotations()
            self.need("ID")
            if self.take("extends"):
                self.type()
                while self.take("&"):
                    self.type()
            if not self.take(","):
                break
        self.need(">")

    # annotations and modifiers

    def annotations(self) -> None:
        while self.k[self.i] == "@" and self.k[self.i + 1] != "interface":
            self.i += 1
            self.name()
            if self.take("("):
                if not self.take(")"):
                    if self.k[self.i] == "ID" and self.k[self.i + 1] == "=":
                        while True:
                            self.need("ID")
                            self.need("=")
                            self.element()
                            if not self.take(","):
                                break
                    else:
                        self.element()
                    self.need(")")

    def element(self) -> None:
        if self.take("{"):
            while not self.take("}"):
                if self.take(","):
                    self.need("}")
                    return
                self.element()
                if not self.take(","):
                    self.need("}")
                    return
        elif self.k[self.i] == "@":
            self.annotations()
        else:
            self.ternary()

    def name(self) -> None:
        self.need("ID")
        while self.k[self.i] == "." and self.k[self.i + 1] == "ID":
            self.i += 2

    def modifiers(self) -> None:
        while True:
            t = self.k[self.i]
            if t == "@" and self.k[self.i + 1] != "interface":
                self.annotations()
            elif t in MODIFIERS:
                if t == "default" and self.k[self.i + 1] in (":", "->"):
                    return
                self.i += 1
            elif t == "ID" and self.w[self.i] == "sealed" and self._modifier_follows(1):
                self.i += 1
            elif t == "ID" and self.w[self.i] == "non" and self.k[self.i + 1] == "-" and self.is_word("sealed", 2):
                self.i += 3
            else:
                return

    def _modifier_follows(self, ahead: int) -> bool:
        t = self.k[self.i + ahead]
        return t in MODIFIERS or t in ("class", "interface", "@")

    # compilation units

    def unit(self) -> None:
        start = self.i
        self.annotations()
        if self.take("package"):
            self.name()
            self.need(";")
        else:
            self.i = start
        while self.k[self.i] in ("import", ";"):
            if self.take(";"):
                continue
            self.i += 1
            self.take("static")
            self.need("ID")
            star = False
            while not star and self.take("."):
                star = self.take("*")
                if not star:
                    self.need("ID")
            self.need(";")
        start = self.i
        self.annotations()
        if (self.is_word("module") and self.k[self.i + 1] == "ID") or (self.is_word("open") and self.is_word("module", 1)):
            self.module()
        else:
            self.i = start
            while self.k[self.i] != "EOF":
                if not self.take(";"):
                    self.modifiers()
                    if not self.type_declaration():
                        self.fail()
        self.need("EOF")

    def module(self) -> None:
        if self.is_word("open"):
            self.i += 1
        self.i += 1
        self.name()
        self.need("{")
        while not self.take("}"):
            word = self.w[self.i]
            self.need("ID")
            if word == "requires":
                while self.k[self.i] == "static" or (self.is_word("transitive") and self.k[self.i + 1] == "ID"):
                    self.i += 1
                self.name()
            elif word in ("exports", "opens", "provides"):
                self.name()
                if self.is_word("to" if word != "provides" else "with"):
                    self.i += 1
                    self.name()
                    while self.take(","):
                        self.name()
                elif word == "provides":
                    self.fail()
            elif word == "uses":
                self.name()
            else:
                self.fail()
            self.need(";")

    def type_declaration(self) -> bool:
        """A class, interface, enum, record or annotation type after its modifiers; False if none begins here."""
        t = self.k[self.i]
        if t == "class":
            self.i += 1
            self.need("ID")
            if self.k[self.i] == "<":
                self.type_params()
            if self.take("extends"):
                self.type(False)
            if self.take("implements"):
                self.class_types()
            self.permits()
            self.class_body()
        elif t == "interface":
            self.i += 1
            self.need("ID")
            if self.k[self.i] == "<":
                self.type_params()
            if self.take("extends"):
                self.class_types()
            self.permits()
            self.class_body()
        elif t == "enum":
            self.i += 1
            self.need("ID")
            if self.take("implements"):
                self.class_types()
            self.enum_body()
        elif t == "@" and self.k[self.i + 1] == "interface":
            self.i += 2
            self.need("ID")
            self.class_body(annotation=True)
        elif self.is_word("record") and self.k[self.i + 1] == "ID" and self.k[self.i + 2] in ("(", "<"):
            self.i += 2
            if self.k[self.i] == "<":
                self.type_params()
            self.need("(")
            if not self.take(")"):
                while True:
                    self.annotations()
                    self.type()
                    self.annotations()
                    self.take("...")
                    self.need("ID")
                    if not self.take(","):
                        break
                self.need(")")
            if self.take("implements"):
                self.class_types()
            self.class_body(record=True)
        else:
            return False
        return True

    def permits(self) -> None:
        if self.is_word("permits"):
            self.i += 1
            self.class_types()

    def enum_body(self) -> None:
        self.need("{")
        while self.k[self.i] not in (";", "}", ","):
            self.annotations()
            self.need("ID")
            if self.k[self.i] == "(":
                self.arguments()
            if self.k[self.i] == "{":
                self.class_body()
            if not self.take(","):
                break
        else:
            if self.k[self.i] == "," and self.k[self.i - 1] == "{":
                self.i += 1
        if self.take(";"):
            while not self.take("}"):
                self.member()
        else:
            self.need("}")

    def class_body(self, annotation: bool = False, record: bool = False) -> None:
        self.need("{")
        while not self.take("}"):
            self.member(annotation, record)

    def member(self, annotation: bool = False, record: bool = False) -> None:
        k = self.k
        if self.take(";"):
            return
        if k[self.i] == "{" or (k[self.i] == "static" and k[self.i + 1] == "{"):
            self.take("static")
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        if k[self.i] == "<":
            self.type_params()
            self.annotations()
        if k[self.i] == "ID" and k[self.i + 1] == "(":
            self.i += 1
            self.parameters()
            self.throws()
            self.block()
            return
        if record and k[self.i] == "ID" and k[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        if not self.take("void"):
            self.type()
        elif k[self.i + 1] != "(":
            self.fail()
        self.need("ID")
        if k[self.i] == "(":
            self.parameters()
            self.i = self.skip_dims(self.i)
            self.throws()
            if annotation and self.take("default"):
                self.element()
            if not self.take(";"):
                self.block()
            return
        self.i -= 1
        self.declarators()
        self.need(";")

    def throws(self) -> None:
        if self.take("throws"):
            self.class_types()

    def parameters(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            self.modifiers()
            self.type()
            self.annotations()
            many = self.take("...")
            if self.k[self.i] == "this" or (self.k[self.i] == "ID" and self.k[self.i + 1] == "."):
                while self.k[self.i] == "ID" and self.k[self.i + 1] == ".":
                    self.i += 2
                self.need("this")
            else:
                self.need("ID")
                self.i = self.skip_dims(self.i)
            if not self.take(","):
                break
            if many:
                self.fail()
        self.need(")")

    def declarators(self) -> None:
        while True:
            self.need("ID")
            self.i = self.skip_dims(self.i)
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return

    def initializer(self) -> None:
        if self.take("{"):
            if self.take(","):
                self.need("}")
                return
            while not self.take("}"):
                self.initializer()
                if not self.take(","):
                    self.need("}")
                    return
        else:
            self.expression()

    # statements

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.block_statement()

    def block_statement(self) -> None:
        k, i = self.k, self.i
        t = k[i]
        if t in ("final", "abstract", "static", "strictfp", "@", "class", "interface", "enum") or (t == "ID" and self.w[i] in ("sealed", "non", "record")):
            # "static" is allowed for local interfaces, enums and records only by their absence of state; modifiers are not checked here
            if t == "@" and k[i + 1] == "interface":
                self.fail()
            self.modifiers()
            if self.type_declaration():
                return
            if self.i > i:
                self.type()
                self.declarators()
                self.need(";")
                return
        if t in PRIMITIVES or t == "ID":
            j = self.skip_type(i)
            if j > 0 and k[j] == "ID" and not (t == "ID" and self.w[i] == "yield" and j == i + 1):
                self.i = j
                self.declarators()
                self.need(";")
                return
        self.statement()

    def statement(self) -> None:
        t = self.k[self.i]
        if t == "{":
            self.block()
        elif t == "ID":
            if self.k[self.i + 1] == ":":
                self.i += 2
                self.statement()
            elif self.w[self.i] == "yield" and self.k[self.i + 1] not in ("=", ".", "[", "++", "--", "::", "(", "+=", "-="):
                self.i += 1
                self.expression()
                self.need(";")
            else:
                self.expression_statement()
                self.need(";")
        else:
            handler = _STATEMENTS.get(t)
            if handler:
                self.i += 1
                handler(self)
            elif not self.take(";"):
                self.expression_statement()
                self.need(";")

    def expression_statement(self) -> None:
        if self.expression() not in ("call", "new", "assign", "step"):
            # the statement form "yield (x);" reads as a call and needs nothing here
            self.fail()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def st_if(self) -> None:
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def st_while(self) -> None:
        self.condition()
        self.statement()

    def st_do(self) -> None:
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def st_for(self) -> None:
        self.need("(")
        start = self.i
        self.modifiers()
        j = self.skip_type(self.i)
        declares = j > 0 and self.k[j] == "ID" and (self.i > start or self.k[self.i] != "ID" or j > self.i)
        if declares:
            self.i = j
            if self.k[self.skip_dims(j + 1)] == ":":
                self.i = self.skip_dims(j + 1) + 1
                self.expression()
                self.need(")")
                self.statement()
                return
            self.declarators()
        else:
            if self.i > start:
                self.fail()
            if self.k[self.i] != ";":
                self.expression_statement()
                while self.take(","):
                    self.expression_statement()
        self.need(";")
        if self.k[self.i] != ";":
            self.expression()
        self.need(";")
        if self.k[self.i] != ")":
            self.expression_statement()
            while self.take(","):
                self.expression_statement()
        self.need(")")
        self.statement()

    def st_return(self) -> None:
        if not self.take(";"):
            self.expression()
            self.need(";")

    def st_throw(self) -> None:
        self.expression()
        self.need(";")

    def st_jump(self) -> None:
        self.take("ID")
        self.need(";")

    def st_assert(self) -> None:
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    def st_synchronized(self) -> None:
        self.condition()
        self.block()

    def st_try(self) -> None:
        resources = self.take("(")
        if resources:
            while True:
                start = self.i
                self.modifiers()
                j = self.skip_type(self.i)
                if j > 0 and self.k[j] == "ID" and self.k[j + 1] == "=":
                    self.i = j + 2
                    self.expression()
                elif self.i > start:
                    self.fail()
                elif self.expression() not in ("name", "field"):
                    self.fail()
                if not self.take(";") or self.k[self.i] == ")":
                    break
            self.need(")")
        self.block()
        handled = False
        while self.take("catch"):
            handled = True
            self.need("(")
            self.modifiers()
            self.type(False)
            while self.take("|"):
                self.type(False)
            self.need("ID")
            self.i = self.skip_dims(self.i)
            self.need(")")
            self.block()
        if self.take("finally"):
            handled = True
            self.block()
        if not handled and not resources:
            self.fail()

    def st_switch(self) -> None:
        self.switch_body()
        # a switch at a statement's start that goes on is an expression
        if self.k[self.i] in (".", "[", "::"):
            self.fail()

    def switch_body(self) -> None:
        self.condition()
        self.need("{")
        style = ""
        while not self.take("}"):
            if self.take("case"):
                self.ternary(False)
                while self.take(","):
                    self.ternary(False)
            else:
                self.need("default")
            mark = self.k[self.i]
            if mark not in (":", "->") or style not in ("", mark):
                self.fail()
            style = mark
            self.i += 1
            if mark == "->":
                if self.k[self.i] == "{":
                    self.block()
                elif self.take("throw"):
                    self.st_throw()
                else:
                    self.expression()
                    self.need(";")
            else:
                while self.k[self.i] not in ("case", "default", "}"):
                    self.block_statement()

    # expressions; each method gives the kind of what it read

    def expression(self) -> str:
        if self._lambda_here():
            return self.lambda_()
        kind = self.ternary()
        t = self.k[self.i]
        size = 0
        if t in ASSIGN:
            size = 1
        elif t == ">":
            size = self._shift_assign()
        if size:
            if kind not in ("name", "field", "element"):
                self.fail()
            self.i += size
            self.expression()
            return "assign"
        return kind

    def _joined(self, i: int) -> bool:
        return self.at[i + 1] == self.at[i] + 1

    def _shift_assign(self) -> int:
        """Tokens of >>= or >>>= here, else 0."""
        i = self.i
        n = 1
        while self.k[i + n] == ">" and self._joined(i + n - 1):
            n += 1
        return n + 1 if 2 <= n <= 3 and self.k[i + n] == "=" and self._joined(i + n - 1) else 0

    def _lambda_here(self) -> bool:
        t = self.k[self.i]
        if t == "ID":
            return self.k[self.i + 1] == "->"
        return t == "(" and self.k[self.match[self.i] + 1] == "->"

    def lambda_(self) -> str:
        if not self.take("ID"):
            end = self.match[self.i]
            k = self.k
            if self.i + 1 == end:
                self.i = end + 1
            elif k[self.i + 1] == "ID" and k[self.i + 2] in (",", ")"):
                self.i += 1
                self.need("ID")
                while self.take(","):
                    self.need("ID")
                self.need(")")
            else:
                self.parameters()
        self.need("->")
        if self.k[self.i] == "{":
            self.block()
        else:
            self.expression()
        return "lambda"

    def ternary(self, arrows: bool = True) -> str:
        kind = self.binary(arrows)
        if self.take("?"):
            if self._lambda_here():
                self.lambda_()
            else:
                self.expression()
            self.need(":")
            if arrows and self._lambda_here():
                self.lambda_()
            else:
                self.ternary(arrows)
            return "other"
        return kind

    def binary(self, arrows: bool = True) -> str:
        kind = self.unary(arrows)
        k = self.k
        while True:
            t = k[self.i]
            if t in BINARY:
                self.i += 1
            elif t == ">":
                if self._shift_assign():
                    return kind
                self.i += 1
                n = 1
                while n < 3 and k[self.i] == ">" and self._joined(self.i - 1):
                    self.i += 1
                    n += 1
                if n == 1 and k[self.i] == "=" and self._joined(self.i - 1):
                    self.i += 1
            elif t == "instanceof":
                self.i += 1
                self.modifiers()
                self.type()
                self.take("ID")
                kind = "other"
                continue
            else:
                return kind
            self.unary(arrows)
            kind = "other"

    def unary(self, arrows: bool = True) -> str:
        t = self.k[self.i]
        if t in ("++", "--"):
            self.i += 1
            self.unary(arrows)
            return "step"
        if t in ("+", "-", "!", "~"):
            self.i += 1
            self.unary(arrows)
            return "other"
        if t == "(":
            after = self._cast_end()
            if after:
                self.i = after
                if arrows and self._lambda_here():
                    self.lambda_()
                else:
                    self.unary(arrows)
                return "other"
        return self.postfix(self.primary(arrows))

    def _cast_end(self) -> int:
        """The position after a cast that opens here, else 0."""
        i, k = self.i, self.k
        j = self.skip_type(i + 1)
        if j < 0:
            return 0
        simple = k[self.skip_annotations(i + 1)] in PRIMITIVES and k[j - 1] != "]"
        while k[j] == "&":
            j = self.skip_type(j + 1)
            if j < 0:
                return 0
        if k[j] != ")":
            return 0
        j += 1
        if simple:
            return j
        t = k[j]
        return j if t in ("ID", "LIT", "(", "!", "~", "this", "super", "new", "switch", "void") or t in PRIMITIVES else 0

    def arguments(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        self.expression()
        while self.take(","):
            self.expression()
        self.need(")")

    def primary(self, arrows: bool = True) -> str:
        k, i = self.k, self.i
        t = k[i]
        if t == "ID":
            self.i += 1
            if k[i + 1] == "(":
                self.arguments()
                return "call"
            if k[i + 1] == "<" or (k[i + 1] == "[" and k[i + 2] == "]") or k[i + 1] in (".", "@"):
                self._type_primary(i)
            return "name" if self.i == i + 1 else "other"
        if t == "LIT":
            self.i += 1
            return "other"
        if t == "(":
            self.i += 1
            kind = self.expression()
            self.need(")")
            return kind if kind in ("name", "field", "element") else "other"
        if t == "this":
            self.i += 1
            if k[self.i] == "(":
                self.arguments()
                return "call"
            return "other"
        if t == "super":
            self.i += 1
            if k[self.i] == "(":
                self.arguments()
                return "call"
            if k[self.i] not in (".", "::"):
                self.fail()
            return "other"
        if t == "new":
            self.i += 1
            return self.creator()
        if t == "switch":
            self.i += 1
            self.switch_body()
            return "other"
        if t in PRIMITIVES:
            self.i = self.skip_type(i)
            return self._class_or_reference()
        if t == "void":
            self.i += 1
            self.need(".")
            self.need("class")
            return "other"
        if t == "@":
            self.type()
            if k[self.i] != "::":
                self.fail()
            return "other"
        if t == "<":
            # explicit type arguments of a constructor call
            j = self.skip_args(i)
            if j > 0 and k[j] in ("this", "super") and k[j + 1] == "(":
                self.i = j + 1
                self.arguments()
                return "call"
        self.fail()
        return ""

    def _class_or_reference(self) -> str:
        if self.k[self.i] == "." and self.k[self.i + 1] == "class":
            self.i += 2
            return "other"
        if self.k[self.i] != "::":
            self.fail()
        return "other"

    def _type_primary(self, i: int) -> None:
        """Moves over a type that stands before :: or, as an array, before .class; else stays after the first word."""
        j = self.skip_type(i)
        if j > 0 and self.k[j] == "::" and self.k[j - 1] in (">", "]"):
            self.i = j
        elif j > 0 and self.k[j - 1] == "]" and self.k[j] == "." and self.k[j + 1] == "class":
            self.i = j + 2

    def creator(self) -> str:
        k = self.k
        self.annotations()
        if k[self.i] == "<":
            j = self.skip_args(self.i)
            if j < 0:
                self.fail()
            self.i = j
        primitive = k[self.skip_annotations(self.i)] in PRIMITIVES
        self.type(False)
        self.annotations()
        if k[self.i] == "[":
            if k[self.i + 1] == "]":
                self.i = self.skip_dims(self.i)
                if k[self.i] != "{":
                    self.fail()
                self.initializer()
                return "array"
            while k[self.i] == "[" and k[self.i + 1] != "]":
                self.i += 1
                self.expression()
                self.need("]")
                self.annotations()
            self.i = self.skip_dims(self.i)
            if k[self.i] in ("{", "["):
                self.fail()
            return "array"
        if primitive:
            self.fail()
        self.arguments()
        if k[self.i] == "{":
            self.class_body()
        return "new"

    def postfix(self, kind: str) -> str:
        k = self.k
        while True:
            t = k[self.i]
            if t == ".":
                self.i += 1
                t = k[self.i]
                if t == "ID":
                    self.i += 1
                    if k[self.i] == "(":
                        self.arguments()
                        kind = "call"
                    else:
                        kind = "field"
                        if k[self.i] == "[" and k[self.i + 1] == "]":
                            # an array type with a qualified name
                            self.i = self.skip_dims(self.i)
                            self._class_or_reference()
                            kind = "other"
                elif t == "<":
                    j = self.skip_args(self.i)
                    if j < 0:
                        self.fail()
                    self.i = j
                    if self.take("super"):
                        if self.k[self.i] == ".":
                            self.i += 1
                            self.need("ID")
                    else:
                        self.need("ID")
                    self.arguments()
                    kind = "call"
                elif t == "new":
                    self.i += 1
                    if self.creator() != "new":
                        self.fail()
                    kind = "new"
                elif t in ("this", "class"):
                    self.i += 1
                    kind = "other"
                elif t == "super":
                    self.i += 1
                    if k[self.i] == "(":
                        self.arguments()
                        kind = "call"
                    elif k[self.i] not in (".", "::"):
                        self.fail()
                else:
                    self.fail()
            elif t == "[":
                if k[self.i + 1] == "]":
                    self.fail()
                self.i += 1
                self.expression()
                self.need("]")
                kind = "element"
            elif t == "::":
                self.i += 1
                if k[self.i] == "<":
                    j = self.skip_args(self.i)
                    if j < 0:
                        self.fail()
                    self.i = j
                if not self.take("new"):
                    self.need("ID")
                kind = "other"
            elif t in ("++", "--"):
                if kind not in ("name", "field", "element", "other"):
                    self.fail()
                self.i += 1
                kind = "step"
            else:
                return kind


_STATEMENTS = {
    "if": Parser.st_if,
    "while": Parser.st_while,
    "do": Parser.st_do,
    "for": Parser.st_for,
    "return": Parser.st_return,
    "throw": Parser.st_throw,
    "break": Parser.st_jump,
    "continue": Parser.st_jump,
    "assert": Parser.st_assert,
    "synchronized": Parser.st_synchronized,
    "try": Parser.st_try,
    "switch": Parser.st_switch,
}


def parses(text: str) -> bool:
    """Whether ``text`` is a compilation unit by the syntax of Java 17. The empty text is one."""
    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)
    try:
        Parser(text).unit()
    except JavaSyntaxError:
        return False
    return True
