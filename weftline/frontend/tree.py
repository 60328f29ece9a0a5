"""A parse tree of Java over the recogniser: which rule read which tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from weftline.functions.java_syntax import Parser

_RULES = (
    "type_declaration class_body enum_body member block block_statement statement st_if st_while st_do st_for st_return st_throw st_jump st_assert "
    "st_synchronized st_try st_switch switch_body expression expression_statement lambda_ ternary binary unary primary postfix creator arguments declarators initializer parameters type"
).split()


@dataclass
class Node:
    """A rule's part of the tokens: from ``start`` up to ``end``; ``kind`` is what an expression turned out to be."""

    rule: str
    start: int
    end: int = -1
    kids: list[Node] = field(default_factory=list)
    kind: str | None = None

    def only(self, *rules: str) -> list[Node]:
        return [k for k in self.kids if k.rule in rules]


class TreeParser(Parser):
    """The recogniser that also keeps, for every rule it applies, a node below the rule that asked for it."""

    def __init__(self, text: str):
        super().__init__(text)
        self.root = Node("unit", 0)
        self._open = [self.root]

    def tree(self) -> Node:
        self.unit()
        self.root.end = self.i
        return self.root


def _kept(rule: str):
    plain = getattr(Parser, rule)

    def apply(self, *args, **named):
        node = Node(rule, self.i)
        self._open[-1].kids.append(node)
        self._open.append(node)
        result = plain(self, *args, **named)
        self._open.pop()
        node.end, node.kind = self.i, result if isinstance(result, str) else None
        if node.end == node.start:  # nothing was read
            self._open[-1].kids.remove(node)
        return result

    return apply


for _rule in _RULES:
    setattr(TreeParser, _rule, _kept(_rule))

# Statements are dispatched through a table of plain functions; the tree's own versions take their place.
_BY_KEYWORD = {"if": "st_if", "while": "st_while", "do": "st_do", "for": "st_for", "return": "st_return", "throw": "st_throw", "break": "st_jump", "continue": "st_jump", "assert": "st_assert", "synchronized": "st_synchronized", "try": "st_try", "switch": "st_switch"}


def _statement(self) -> None:
    handler = _BY_KEYWORD.get(self.k[self.i])
    if handler is None:
        return Parser.statement(self)
    self.i += 1
    getattr(self, handler)()
    return None


def _statement_kept(self):
    node = Node("statement", self.i)
    self._open[-1].kids.append(node)
    self._open.append(node)
    _statement(self)
    self._open.pop()
    node.end = self.i


TreeParser.statement = _statement_kept
