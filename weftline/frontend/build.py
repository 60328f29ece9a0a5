"""Dataflow graphs of the methods of a Java file.

Names are resolved over all files of a project: a first pass lists the classes that every file declares and the names that it
uses, a join brings each file the classes that it may mean, with all they inherit from, and a second pass builds the graphs.
Locals, fields and methods are found in a class, its supers, the classes around it and static imports; types by imports, package,
imports on demand and java.lang. What remains unknown is left open: an unknown method is called '!name', an unknown type is '?'.
Every method, also of local and anonymous classes, and every lambda becomes a graph of its own. A context keeps the latest node of each reference; branches and loops work on
copies and meet in join, begin, end and repeat nodes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.common import cut
from weftline.frontend.tree import Node, TreeParser
from weftline.functions.java_syntax import ASSIGN, JavaSyntaxError
from weftline.sources.graph_xml import _COLUMNS, _FIELDS

# Descriptors, and classes of java.lang that need no import.
_CODES = {"byte": "B", "char": "C", "short": "S", "int": "I", "long": "J", "float": "F", "double": "D", "boolean": "Z", "void": "V"}
_LANG = frozenset("Object String Integer Long Double Float Short Byte Character Boolean Number Math System Thread Runnable Comparable Iterable Class Exception RuntimeException Error Throwable StringBuilder StringBuffer Enum Void Override".split())
_LEVELS = ({"||"}, {"&&"}, {"|"}, {"^"}, {"&"}, {"==", "!="}, {"<", ">", "<=", ">=", "instanceof"}, {"<<", ">>", ">>>"}, {"+", "-"}, {"*", "/", "%"})
_RANK = {op: r for r, ops in enumerate(_LEVELS) for op in ops}


#: Widening of primitive types, in steps (fixed value), and what boxes them.
_WIDENING = "BSIJFD"
_BOXES = {"Ljava/lang/Byte;": "B", "Ljava/lang/Character;": "C", "Ljava/lang/Short;": "S", "Ljava/lang/Integer;": "I", "Ljava/lang/Long;": "J", "Ljava/lang/Float;": "F", "Ljava/lang/Double;": "D", "Ljava/lang/Boolean;": "Z"}
_OBJECT = "Ljava/lang/Object;"


class File:
    """The classes of a file: their fields, methods and places; ``known`` are classes of other files by name."""

    def __init__(self, text: str, known: dict[str, dict] | None = None):
        self.known = dict(known or {})
        self.on_demand: list[str] = []
        self.statics: dict[str, str] = {}
        self.static_classes: list[str] = []
        self.p = TreeParser(text)
        self.k, self.w = self.p.k, self.p.w
        self.root = self.p.tree()
        self.package, self.imports = "", {}
        self._header()
        self.classes: list[dict] = []
        self.anonymous: dict[int, str] = {}
        self.names: dict[str, str] = {}
        for t in self.root.only("type_declaration"):
            self._names(t, "")
        for t in self.root.only("type_declaration"):
            self._class(t, "")

    def at(self, token: int) -> int:
        return self.p.at[token] if token < len(self.p.at) and self.p.at[token] >= 0 else 0

    def span(self, n: Node) -> tuple[int, int]:
        last = max(n.start, n.end - 1)
        return self.at(n.start), self.at(last) + len(self.w[last])

    def _header(self) -> None:
        i, k, w = 0, self.k, self.w
        while k[i] not in ("EOF", "class", "interface", "enum", "{"):
            if k[i] in ("package", "import"):
                j = i + 1
                while k[j] != ";":
                    j += 1
                name = "".join(w[i + 1 : j])
                if k[i] == "package":
                    self.package = name.replace(".", "/")
                elif k[i + 1] == "static":
                    owner, _, member = name.removeprefix("static").rpartition(".")
                    owner = "L" + owner.replace(".", "/") + ";"
                    if member == "*":
                        self.static_classes.append(owner)
                    else:
                        self.statics[member] = owner
                elif name.endswith(".*"):
                    self.on_demand.append(name[:-2].replace(".", "/"))
                else:
                    self.imports[name.rpartition(".")[2]] = "L" + name.replace(".", "/") + ";"
                i = j
            i += 1

    def _head(self, t: Node) -> int:
        """Token of the class name: after class, interface, enum or record."""
        i = t.start
        while self.k[i] not in ("class", "interface", "enum") and self.w[i] != "record":
            i += 1
        return i + 1

    def _names(self, t: Node, outer: str) -> None:
        name = self.w[self._head(t)]
        path = f"{outer}${name}" if outer else (f"{self.package}/{name}" if self.package else name)
        self.names[name] = f"L{path};"
        for body in t.only("class_body", "enum_body"):
            for member in body.only("member"):
                for inner in member.only("type_declaration"):
                    self._names(inner, path)

    def descriptor(self, words: list[str], variables: frozenset[str] = frozenset()) -> str:
        """The descriptor of a type's tokens."""
        dims = sum(1 for a, b in zip(words, words[1:]) if (a, b) == ("[", "]")) + (words[-1:] == ["..."])
        bare, depth = [], 0
        for x in words:
            depth += (x == "<") - (x == ">")
            if depth == 0 and x not in (">", "[", "]", "...", "final") and not x.startswith("@"):
                bare.append(x)
        name = "".join(bare)
        if name in _CODES:
            base = _CODES[name]
        elif name in variables:
            base = f"T{name};"
        elif name in self.names:
            base = self.names[name]
        elif name in self.imports:
            base = self.imports[name]
        elif not name or name == "var":
            base = "?"
        elif any((found := c) in self.known for c in self.candidates(name)):
            base = found
        elif name in _LANG:
            base = f"Ljava/lang/{name};"
        elif "." in name:
            base = "L" + name.replace(".", "/") + ";"
        else:
            base = f"L{self.package}/{name};" if self.package else f"L{name};"
        return "[" * dims + base

    def candidates(self, name: str) -> list[str]:
        """The classes that a simple name may mean, in the order of the language: import, package, imports on demand, java.lang."""
        if name in self.imports:
            return [self.imports[name]]
        return [f"L{p}/{name};" if p else f"L{name};" for p in (self.package, *self.on_demand, "java/lang")]

    def used(self) -> set[str]:
        """All classes that the names of the file may mean."""
        names = {self.w[i] for i, t in enumerate(self.k) if t == "ID" and self.w[i][:1].isupper()}
        return {c for n in names if n not in self.names for c in self.candidates(n)} | {*self.statics.values(), *self.static_classes}

    def lineage(self, name: str) -> Iterator[dict]:
        """A class and all it inherits from that is known, nearest first."""
        todo, seen = [name], set()
        while todo:
            at = todo.pop(0)
            cls = self.known.get(at)
            if at not in seen and cls:
                seen.add(at)
                yield cls
                todo += [b for b in (cls["base"], *cls["implements"]) if b]

    def distance(self, given: str, wanted: str) -> int:
        """Steps of conversion from one type to another: 0 for equal ones, many for types that do not go together."""
        if given == wanted:
            return 0
        if given == "?" or wanted == "?" or wanted.lstrip("[")[:1] == "T":
            return 10
        if given in _WIDENING and wanted in _WIDENING and _WIDENING.index(given) < _WIDENING.index(wanted):
            return _WIDENING.index(wanted) - _WIDENING.index(given)
        if given == "C" and wanted in "IJFD":
            return 1 + "IJFD".index(wanted)
        if _BOXES.get(wanted) == given or _BOXES.get(given) == wanted:
            return 8
        if given[0] in "L[" and wanted == _OBJECT:
            return 9
        for k, cls in enumerate(self.lineage(given)):
            if cls["name"] == wanted:
                return k
        return 100

    def methods_named(self, owners: list[str], name: str) -> list[dict]:
        """The methods of a name in classes and their lineages: those of the first class that has any."""
        for owner in owners:
            for cls in self.lineage(owner):
                found = [m for m in cls["methods"] if m["name"] == name]
                if found:
                    return found
        return []

    def field_of(self, owner: str, name: str) -> tuple[str, str] | None:
        """(class, type) of a field in a class's lineage."""
        return next(((c["name"], c["fields"][name]) for c in self.lineage(owner) if name in c["fields"]), None)

    def _variables(self, start: int, end: int) -> frozenset[str]:
        """Names of type parameters between two tokens."""
        if self.k[start] != "<":
            return frozenset()
        found, i, depth = set(), start, 0
        while i < end:
            depth += (self.k[i] == "<") - (self.k[i] == ">")
            if self.k[i] == "ID" and depth == 1 and self.k[i - 1] in ("<", ","):
                found.add(self.w[i])
            if depth == 0:
                break
            i += 1
        return frozenset(found)

    def _class(self, t: Node, outer: str) -> None:
        at = self._head(t)
        name = self.w[at]
        path = f"{outer}${name}" if outer else (f"{self.package}/{name}" if self.package else name)
        variables = self._variables(at + 1, t.end)
        own = {"name": f"L{path};", "base": None, "implements": [], "fields": {}, "methods": [], "node": t}
        body = t.only("class_body", "enum_body")[0]
        words, section = t.only("type"), None
        for x in words:
            section = next((self.k[i] for i in range(x.start - 1, at, -1) if self.k[i] in ("extends", "implements")), None)
            d = self.descriptor(self.w[x.start : x.end], variables)
            if section == "extends" and own["base"] is None:
                own["base"] = d
            elif section:
                own["implements"].append(d)
        own["enum"] = body.rule == "enum_body"
        own["outer"] = outer
        self._fill(own, body, variables, path)

    def _fill(self, own: dict, body: Node, variables: frozenset[str], path: str) -> None:
        self.classes.append(own)
        self.known[own["name"]] = own
        if own.get("enum"):
            i = body.start + 1
            while self.k[i] == "ID":
                own["fields"][self.w[i]] = own["name"]
                i += 1
                while self.k[i] in ("(", "{"):
                    i = self.p.match[i] + 1
                i += self.k[i] == ","
            # every enum has these; they have no graph
            own["given"] = [{"name": "values", "id": f"{own['name']}.values()[{own['name']}", "args": [], "result": f"[{own['name']}"}, {"name": "valueOf", "id": f"{own['name']}.valueOf(Ljava/lang/String;){own['name']}", "args": [("name", "Ljava/lang/String;")], "result": own["name"]}]
        own["vars"] = variables
        for member in body.only("member"):
            self._member(member, own, variables, path)
        own["methods"] += own.pop("given", [])
        self._inner(body, own, variables, path)

    def _inner(self, n: Node, own: dict, variables: frozenset[str], path: str) -> None:
        """Local and anonymous classes in the bodies of a class."""
        for kid in n.kids:
            if kid.rule == "type_declaration":
                if n.rule != "member":
                    self._names(kid, path)
                    self._class(kid, path)
                continue
            if kid.rule == "class_body" and n.rule == "creator":
                name = f"{path}${len(self.classes)}"
                types = n.only("type")
                base = self.descriptor(self.w[types[0].start : types[0].end], variables) if types else None
                self.anonymous[kid.start] = f"L{name};"
                self._fill({"name": f"L{name};", "base": base, "implements": [], "fields": {}, "methods": [], "node": kid, "outer": path}, kid, variables, name)
                continue
            self._inner(kid, own, variables, path)

    def _member(self, n: Node, own: dict, variables: frozenset[str], path: str) -> None:
        inner = n.only("type_declaration")
        if inner:
            self._class(inner[0], path)
            return
        params, blocks, types = n.only("parameters"), n.only("block"), n.only("type")
        decl = n.only("declarators")
        static = any(self.k[i] == "static" for i in range(n.start, min(x.start for x in (*types, *params, *blocks, *decl)) if (types or params or blocks or decl) else n.start))
        if params:
            name_at = params[0].start - 1
            name = self.w[name_at]
            start = next((i for i in range(n.start, name_at) if self.k[i] == "<" and (not types or i < types[0].start)), -1)
            tv = variables | (self._variables(start, name_at) if start >= 0 else frozenset())
            constructor = not types and self.k[name_at - 1] != "void"
            result = "V" if not types else self.descriptor(self.w[types[0].start : types[0].end], tv)
            args = self._parameters(params[0], tv)
            shown = ":init:" if constructor else name
            own["methods"].append({"name": shown, "id": f"{own['name']}.{shown}({''.join(d for _, d in args)}){result}", "style": "constructor" if constructor else "static" if static else "instance", "args": args, "result": result, "body": blocks[0] if blocks else None, "node": n, "vars": tv})
        elif decl and types:
            kind = self.descriptor(self.w[types[0].start : types[0].end], variables)
            for name_at in self._declared(decl[0]):
                own["fields"][self.w[name_at]] = kind
            own["methods"] += [{"name": ":clinit:", "id": f"{own['name']}.:clinit:()V", "style": "initializer", "args": [], "result": "V", "body": None, "field": decl[0], "node": n, "vars": variables}] if decl[0].only("initializer") else []
        elif blocks:
            own["methods"].append({"name": ":clinit:", "id": f"{own['name']}.:clinit:()V", "style": "initializer", "args": [], "result": "V", "body": blocks[0], "node": n, "vars": variables})

    def _declared(self, n: Node) -> list[int]:
        """Tokens of the names that a declarator list declares."""
        out, i, inits = [], n.start, {x.start: x.end for x in n.only("initializer")}
        while i < n.end:
            if i in inits:
                i = inits[i]
                continue
            if self.k[i] == "ID" and (not out or self.k[i - 1] == ","):
                out.append(i)
            i += 1
        return out

    def _parameters(self, n: Node, variables: frozenset[str]) -> list[tuple[str, str]]:
        out = []
        for t in n.only("type"):
            i, words = t.end, self.w[t.start : t.end]
            if self.k[i] == "...":
                words, i = [*words, "..."], i + 1
            if self.k[i] == "ID" and self.k[i + 1] != ".":
                out.append((self.w[i], self.descriptor(words, variables)))
        return out


class Dead(Exception):
    """Control does not come this way any more."""


class MethodGraph:
    """Builds the scopes, nodes and links of one method."""

    def __init__(self, file: File, cls: dict, method: dict, number: int):
        self.f, self.cls, self.method = file, cls, method
        self.prefix = f"M{number}_{method['name'].strip(':')}_N"
        self.rows: list[dict] = []
        self.scope_rows: list[tuple[str, str]] = []
        self.scopes: list[tuple[str, dict[str, tuple[str, str]]]] = []
        self.types: dict[str, str] = {}
        self.env: dict[str, int] = {}
        self.frames: list[dict] = []
        self.returns: list[int] = []
        self.thrown: list[int] = []
        self.loops = 0
        self.number = number
        self.lambdas: list[tuple[dict, list[dict]]] = []

    def node(self, kind: str | None, ref: str | None = None, data: str | None = None, type_: str = "?", at: Node | None = None, **links: int | None) -> int:
        span = self.f.span(at) if at is not None else (None, None)
        self.rows.append({"kind": kind, "ref": ref, "data": data, "type": type_, "span": span, "scope": self.scopes[-1][0], "links": [(k.rstrip("_"), v) for k, v in links.items() if v is not None]})
        return len(self.rows) - 1

    def link(self, dst: int, label: str, src: int | None) -> None:
        if src is not None:
            self.rows[dst]["links"].append((label, src))

    def type_of(self, n: int) -> str:
        return self.rows[n]["type"]

    # scopes and references

    def push(self, letter: str, at: Node) -> None:
        parent = self.scopes[-1][0]
        s, e = self.f.span(at)
        name = f"{parent}.:{letter}:{s}:{e}"
        self.scope_rows.append((parent, name))
        self.scopes.append((name, {}))

    def declare(self, name: str, type_: str) -> str:
        ref = f"${self.scopes[-1][0]}/${name}"
        self.scopes[-1][1][name] = (ref, type_)
        return ref

    def lookup(self, name: str) -> tuple[str, str] | None:
        for _, names in reversed(self.scopes):
            if name in names:
                return names[name]
        for owner in self.owners():
            found = self.f.field_of(owner, name)
            if found:
                return f".{found[0]}/.{name}", found[1]
        owner = self.f.statics.get(name)
        for owner in [owner] if owner else self.f.static_classes:
            found = self.f.field_of(owner, name)
            if found:
                return f".{found[0]}/.{name}", found[1]
        return None

    def owners(self) -> list[str]:
        """The class and the classes around it."""
        out, cls = [self.cls["name"]], self.cls
        while cls.get("outer"):
            out.append(f"L{cls['outer']};")
            cls = self.f.known.get(out[-1], {})
        return out

    def read(self, ref: str, type_: str) -> int:
        """The latest value of a reference; one from outside comes in through an input node."""
        if ref not in self.env:
            keep = self.scopes
            self.scopes = keep[:1]
            self.env[ref] = self.node("input", ref, None, type_)
            self.scopes = keep
        return self.env[ref]

    # the method

    def build(self, around: list[dict] | None = None) -> None:
        """``around`` are the scopes outside of a lambda."""
        m = self.method
        s, e = self.f.span(m["node"])
        top = f"{self.cls['name']}.:{m['name'].strip(':')}:{s}:{e}"
        self.scope_rows.append((m["id"], top))
        outside: dict = {}
        for names in around or []:
            outside |= names
        self.scopes.append((top, outside))
        for k, (name, type_) in enumerate(m["args"]):
            ref = self.declare(name, type_)
            into = self.node("input", f"#arg{k}", None, type_)
            self.env[ref] = self.node("assign_var", ref, None, type_, __=into)
        try:
            if m.get("field") is not None:
                self.declarators(m["field"], None)
            elif m.get("value") is not None:
                self.returns.append(self.node("return", "#return", None, m["result"], m["value"], __=self.value(m["value"])))
            elif m["body"] is not None:
                self.statements(m["body"].kids)
        except Dead:
            pass
        if self.returns:
            value = self.returns[0] if len(self.returns) == 1 else self.node("join", "#return", None, m["result"])
            if len(self.returns) > 1:
                for k, r in enumerate(self.returns):
                    self.link(value, f"{k}" if k else "", r)
            self.node("output", "#return", None, m["result"], __=value)
        for ref in [r for r in self.env if r[0] in ".%" and self.rows[self.env[r]]["kind"] != "input"]:
            self.node("output", ref, None, self.type_of(self.env[ref]), __=self.env[ref])
        self.purge()

    def statements(self, kids: list[Node]) -> None:
        for kid in kids:
            self.statement(kid)

    def scoped(self, letter: str, n: Node) -> None:
        self.push(letter, n)
        inner = n.kids[0] if n.rule == "statement" and len(n.kids) == 1 and n.kids[0].rule == "block" else n
        try:
            self.statements(inner.kids if inner.rule == "block" else [inner])
        finally:
            self.scopes.pop()

    def branch(self, env: dict[str, int], run) -> dict[str, int] | None:
        """The context after ``run`` from ``env``; None if control does not come out."""
        keep, self.env = self.env, dict(env)
        try:
            run()
            return self.env
        except Dead:
            return None
        finally:
            self.env = keep

    def meet(self, cond: int | None, yes: dict[str, int] | None, no: dict[str, int] | None, at: Node, kind: str = "join") -> None:
        """Go on with both contexts joined; dead ones do not count."""
        if yes is None and no is None:
            raise Dead
        if yes is None or no is None:
            self.env = dict(yes if no is None else no)
            return
        out = {}
        for ref in {**no, **yes}:
            a, b = yes.get(ref), no.get(ref)
            if a == b or a is None or b is None:
                out[ref] = a if a is not None else b
            else:
                out[ref] = self.node(kind, ref, None, self.type_of(a), at, cond=cond, true=a, false=b)
        self.env = out

    def statement(self, n: Node) -> None:
        rule = n.rule
        if rule in ("block_statement", "statement"):
            if len(n.kids) == 0 and self.f.k[n.start] in ("break", "continue"):
                self.jump(n)
            types, decl = n.only("type"), n.only("declarators")
            if decl:
                first = types[0] if types else None
                words = self.f.w[first.start : first.end] if first else [x for x in self.f.w[n.start : decl[0].start] if x != "final"]
                self.declarators(decl[0], self.f.descriptor(words, self.method["vars"]))
                return
            self.statements(n.kids)
        elif rule == "block":
            self.scoped("B", n)
        elif rule == "expression_statement":
            self.value(n.kids[0])
        elif rule == "expression":  # yield
            self.value(n)
        elif rule == "st_jump":
            self.jump(n)
        elif rule == "st_return":
            v = self.value(n.kids[0]) if n.kids else None
            self.returns.append(self.node("return", "#return", None, self.method["result"], n, __=v))
            raise Dead
        elif rule == "st_throw":
            v = self.value(n.kids[0])
            self.thrown.append(self.node("throw", None, None, self.type_of(v), n, __=v))
            raise Dead
        elif rule == "st_if":
            cond = self.value(n.kids[0])
            yes = self.branch(self.env, lambda: self.scoped("T", n.kids[1]))
            no = self.branch(self.env, (lambda: self.scoped("F", n.kids[2])) if len(n.kids) > 2 else lambda: None)
            self.meet(cond, yes, no, n)
        elif rule in ("st_while", "st_for", "st_do"):
            self.loop(n)
        elif rule == "st_switch":
            self.switch(n.only("switch_body")[0])
        elif rule == "st_try":
            self.try_(n)
        elif rule == "st_synchronized":
            self.value(n.kids[0])
            self.scoped("B", n.kids[-1])
        elif rule == "type_declaration":
            return  # its methods have graphs of their own
        elif rule == "st_assert":
            for kid in n.kids:
                self.value(kid)
        else:
            self.statements(n.kids)

    def jump(self, n: Node) -> None:
        word = self.f.k[n.start] if self.f.k[n.start] in ("break", "continue") else self.f.k[n.start - 1]
        for frame in reversed(self.frames):
            if word == "break" or frame["loop"]:
                frame[word].append(dict(self.env))
                break
        raise Dead

    def declarators(self, n: Node, type_: str | None) -> None:
        names = self.f._declared(n)
        for k, at in enumerate(names):
            end = names[k + 1] if k + 1 < len(names) else n.end
            init = [x for x in n.only("initializer") if at < x.start < end]
            name = self.f.w[at]
            if type_ is None:
                ref, kind = self.lookup(name) or (f".{self.cls['name']}/.{name}", "?")
                if init:
                    self.env[ref] = self.node("assign_field", ref, None, kind, init[0], __=self.value(init[0]))
                continue
            v = self.value(init[0]) if init else None
            ref = self.declare(name, self.type_of(v) if type_ == "?" and v is not None else type_)
            if v is not None:
                self.env[ref] = self.node("assign_var", ref, None, self.scopes[-1][1][name][1], init[0], __=v)

    def assigned(self, n: Node) -> list[str]:
        """References from outside that the tokens of a node assign."""
        found, k, w = {}, self.f.k, self.f.w
        for i in range(n.start, n.end):
            if k[i] == "ID" and k[i - 1] != "." and (k[i + 1] in ASSIGN or k[i + 1] in ("++", "--") or k[i - 1] in ("++", "--")):
                known = self.lookup(w[i])
                if known:
                    found.setdefault(known[0], known[1])
        return list(found.items())

    def loop(self, n: Node) -> None:
        self.loops += 1
        number = str(self.loops)
        self.push({"st_while": "W", "st_for": "F", "st_do": "D"}[n.rule], n)
        try:
            body, cond, step, each = n.only("statement")[-1], None, [], None
            parts = [x for x in n.kids if x is not body]
            if n.rule == "st_for":
                cond, step, each = self._for_head(n, parts)
            else:
                cond = parts[0]
            begins = {}
            for ref, type_ in self.assigned(n):
                if ref in self.env or ref[0] == ".":
                    begins[ref] = self.node("begin", ref, number, type_, n, init=self.read(ref, type_))
                    self.env[ref] = begins[ref]
            frame = {"loop": True, "break": [], "continue": []}
            self.frames.append(frame)
            c = self.value(cond) if cond is not None and n.rule != "st_do" else each
            checked = dict(self.env)
            after = self.branch(self.env, lambda: self.scoped("B", body))
            self.frames.pop()
            for other in frame["continue"]:
                after = self._both(c, after, other, n)
            if after is not None:
                self.env = after
                for x in step:
                    self.value(x)
                if n.rule == "st_do":
                    c = self.value(cond)
                    checked = dict(self.env)
                after = dict(self.env)
            self.env = dict(checked)
            for ref, begin in begins.items():
                end = self.node("end", ref, number, self.type_of(begin), n, __=checked.get(ref, begin), cond=c)
                if after is not None:
                    repeat = self.node("repeat", ref, number, self.type_of(begin), n, __=after.get(ref, begin))
                    self.link(begin, "cont", repeat)
                    self.link(repeat, "_end", end)
                    self.link(end, "_repeat", repeat)
                self.env[ref] = end
            for other in frame["break"]:
                self.meet(c, other, self.env, n)
        finally:
            self.scopes.pop()

    def _both(self, cond: int | None, a: dict[str, int] | None, b: dict[str, int], at: Node) -> dict[str, int]:
        return self.branch(self.env, lambda: self.meet(cond, a, b, at)) or b

    def _for_head(self, n: Node, parts: list[Node]) -> tuple[Node | None, list[Node], int | None]:
        k, w = self.f.k, self.f.w
        close = self.f.p.match[n.start]
        colons = [i for i in range(n.start, close) if k[i] == ":"]
        semis = [i for i in range(n.start + 1, close) if k[i] == ";" and not any(x.start <= i < x.end for x in parts)]
        if len(semis) < 2 and colons:
            colon = max(i for i in colons if not any(x.start <= i < x.end for x in parts)) if any(not any(x.start <= i < x.end for x in parts) for i in colons) else colons[0]
            over = self.value(next(x for x in parts if x.start > colon))
            name = next(i for i in range(colon - 1, n.start, -1) if k[i] == "ID")
            type_ = self.f.descriptor([x for x in w[n.start + 1 : name] if x != "final"], self.method["vars"])
            ref = self.declare(w[name], type_)
            item = self.node("op_iter", None, None, type_, n, __=over)
            self.env[ref] = self.node("assign_var", ref, None, type_, n, __=item)
            return None, [], item
        head = [x for x in parts if x.start < semis[0]]
        for x in head:
            if x.rule == "declarators":
                self.declarators(x, self.f.descriptor([y for y in w[n.start + 1 : x.start] if y != "final"], self.method["vars"]))
            elif x.rule == "expression_statement":
                self.value(x.kids[0])
        cond = next((x for x in parts if semis[0] < x.start < semis[1]), None)
        return cond, [x.kids[0] for x in parts if x.start > semis[1] and x.rule == "expression_statement"], None

    def switch(self, n: Node) -> int:
        """Cases one after the other, each joined with what came before; the value of a switch expression is its last join."""
        value = self.value(n.kids[0])
        frame = {"loop": False, "break": [], "continue": []}
        self.frames.append(frame)
        k, start = self.f.k, dict(self.env)
        parts = n.kids[1:]
        i, result, before = self.f.p.match[n.start] + 2, value, None
        groups: list[tuple[bool, list[Node], list[Node]]] = []
        while i < n.end - 1:
            default = k[i] == "default"
            stop = i + 1
            while k[stop] not in (":", "->") or any(x.start <= stop < x.end for x in parts):
                stop += 1
            labels = [x for x in parts if i < x.start < stop]
            nxt = stop + 1
            while nxt < n.end - 1 and not (k[nxt] in ("case", "default") and not any(x.start <= nxt < x.end for x in parts)):
                nxt += 1
            groups.append((default, labels, [x for x in parts if stop < x.start < nxt]))
            i = nxt
        self.push("S", n)
        try:
            through: dict[str, int] | None = None
            for default, labels, body in groups:
                case = self.node("case", None, "default" if default else f"case({len(labels)})", self.type_of(value), n, __=value)
                for j, x in enumerate(labels):
                    self.link(case, f"match{j}", self.value(x))
                entry = start if through is None else self._both(case, through, start, n)

                def run(body=body):
                    nonlocal result
                    for x in body:
                        if x.rule == "expression":
                            result = self.value(x)
                        else:
                            self.statement(x)

                through = self.branch(entry, run)
                if through is not None and body and body[0].rule in ("expression", "block") and k[body[0].start - 1] == "->":
                    frame["break"].append(through)
                    through = None
            before = through if groups and groups[-1][0] else (start if through is None else self._both(value, through, start, n))
            if groups and not any(g[0] for g in groups) and before is None:
                before = start
        finally:
            self.scopes.pop()
            self.frames.pop()
        for other in frame["break"]:
            before = other if before is None else self._both(value, other, before, n)
        if before is None:
            raise Dead
        self.env = before
        return result

    def try_(self, n: Node) -> None:
        k, w = self.f.k, self.f.w
        start, thrown = dict(self.env), len(self.thrown)
        blocks = n.only("block")
        resources = [x for x in n.kids if x.rule == "expression" and x.start < blocks[0].start]

        def body():
            self.push("T", n)
            try:
                for x in resources:
                    v = self.value(x)
                    if k[x.start - 1] == "=":
                        ref = self.declare(w[x.start - 2], self.type_of(v))
                        self.env[ref] = self.node("assign_var", ref, None, self.type_of(v), x, __=v)
                self.statements(blocks[0].kids)
            finally:
                self.scopes.pop()

        done = self.branch(self.env, body)
        sources = self.thrown[thrown:]
        for b in blocks[1:]:
            if k[b.start - 1] == "finally":
                continue
            types = [t for t in n.only("type") if t.end <= b.start]
            close = b.start - 1
            name = next(i for i in range(close, n.start, -1) if k[i] == "ID")
            type_ = self.f.descriptor(w[types[-1].start : types[-1].end], self.method["vars"])

            def handler(b=b, name=name, type_=type_):
                self.push("C", b)
                try:
                    ref = self.declare(w[name], type_)
                    caught = self.node("catch", None, None, type_, b)
                    for j, s in enumerate(sources):
                        self.link(caught, f"exc{j}", s)
                    self.env[ref] = self.node("assign_var", ref, None, type_, b, __=caught)
                    self.statements(b.kids)
                finally:
                    self.scopes.pop()

            other = self.branch(start, handler)
            if done is None or other is None:
                done = done if other is None else other
            else:
                merged = {}
                for ref in {**other, **done}:
                    a, c = done.get(ref), other.get(ref)
                    merged[ref] = (a if a is not None else c) if a == c or a is None or c is None else self.node("catchjoin", ref, None, self.type_of(a), n, __=a, **{f"!{type_}": c})
                done = merged
        last = next((b for b in blocks[1:] if k[b.start - 1] == "finally"), None)
        if last is not None:
            self.env = dict(start if done is None else done)
            self.scoped("B", last)
            done = None if done is None else self.env
        if done is None:
            raise Dead
        self.env = done

    # expressions

    def value(self, n: Node) -> int:
        if n.rule in ("expression", "expression_statement", "initializer") and len(n.kids) == 1 and self.f.k[n.start] != "{":
            return self.value(n.kids[0])
        return getattr(self, f"x_{n.rule}", self.x_other)(n)

    def x_other(self, n: Node) -> int:
        vs = [self.value(k) for k in n.kids if k.rule in ("expression", "ternary", "binary", "unary", "primary", "initializer")]
        return vs[-1] if vs else self.node("value", None, " ".join(self.f.w[n.start : n.end]), "?", n)

    def x_initializer(self, n: Node) -> int:
        made = self.node("valueset", None, None, "?", n)
        for j, x in enumerate(n.only("initializer")):
            self.link(made, f"value{j}", self.value(x))
        return made

    def x_expression(self, n: Node) -> int:
        target, right = n.kids
        op = self.f.w[target.end] if self.f.k[target.end] in ASSIGN else "".join(self.f.w[target.end : right.start])
        store = self.target(target)
        v = self.value(right)
        if op != "=":
            v = self.node("op_assign", None, op, self.type_of(v), n, L=store(None, n), R=v)
        return store(v, n)

    def target(self, n: Node):
        """A function that stores a value in an expression's place, or reads it where the value is None."""
        while n.rule in ("expression", "ternary", "binary") and len(n.kids) == 1:
            n = n.kids[0]
        if n.rule == "unary" and n.only("primary"):
            base, tails = n.only("primary")[0], n.only("postfix")
            if not tails and base.kids and self.f.k[base.start] == "(":
                return self.target(base.kids[0])
            steps = self._steps(tails[0]) if tails else []
            if not steps and self.f.k[base.start] == "ID" and base.end == base.start + 1:
                ref, type_ = self.lookup(self.f.w[base.start]) or (f".{self.cls['name']}/.{self.f.w[base.start]}", "?")
                return self._store(ref, type_, "field" if ref[0] == "." else "var", {})
            if steps:
                obj = self._chain(base, steps[:-1], n)
                kind, at, kid = steps[-1]
                if kind == "element":
                    inner = self.type_of(obj)
                    type_ = inner[1:] if inner.startswith("[") else "?"
                    return self._store(f"%{type_}", type_, "array", {"array": obj, "index": self.value(kid)})
                if kind == "field":
                    ref, type_ = self._field(obj, self.f.w[at])
                    return self._store(ref, type_, "field", {"obj": obj})
        v = self.value(n)
        return lambda value, at: v if value is None else self.node("op_assign", None, "=", self.type_of(v), at, L=v, R=value)

    def _store(self, ref: str, type_: str, kind: str, links: dict[str, int]):
        def go(v: int | None, at: Node) -> int:
            if v is None:
                return self.node(f"ref_{kind}", ref, None, type_, at, __=self.read(ref, type_), **links)
            self.env[ref] = self.node(f"assign_{kind}", ref, None, type_, at, __=v, **links)
            return self.env[ref]

        return go

    def x_ternary(self, n: Node) -> int:
        if len(n.kids) == 1:
            return self.value(n.kids[0])
        c = self.value(n.kids[0])
        a, b = self.value(n.kids[1]), self.value(n.kids[2])
        return self.node("join", None, None, self.type_of(a), n, cond=c, true=a, false=b)

    def x_binary(self, n: Node) -> int:
        units = n.only("unary")
        if len(units) == 1 and len(n.kids) == 1:
            return self.value(units[0])
        operands: list = [("v", units[0])]
        ops: list[str] = []
        for a, b in zip(n.kids, n.kids[1:]):
            gap = self.f.w[a.end : b.start]
            ops.append("instanceof" if "instanceof" in gap else "".join(gap))
            operands.append(("t" if ops[-1] == "instanceof" else "v", b))

        def fold(lo: int, hi: int) -> int:
            if lo == hi:
                return self.value(operands[lo][1])
            split = max(range(lo, hi), key=lambda i: (-_RANK.get(ops[i], 9), i))
            left = fold(lo, split)
            if ops[split] == "instanceof":
                t = operands[split + 1][1]
                type_ = self.f.descriptor(self.f.w[t.start : t.end], self.method["vars"])
                made = self.node("op_typecheck", None, type_, "Z", n, __=left)
                if self.f.k[t.end] == "ID":
                    ref = self.declare(self.f.w[t.end], type_)
                    self.env[ref] = self.node("assign_var", ref, None, type_, t, __=left)
                return made
            right = fold(split + 1, hi)
            logical = _RANK.get(ops[split], 9) in (0, 1, 5, 6)
            type_ = "Z" if logical else "Ljava/lang/String;" if ops[split] == "+" and "Ljava/lang/String;" in (self.type_of(left), self.type_of(right)) else self.type_of(left)
            return self.node("op_infix", None, ops[split], type_, n, L=left, R=right)

        return fold(0, len(operands) - 1)

    def x_unary(self, n: Node) -> int:
        t, w = self.f.k[n.start], self.f.w
        if t in ("++", "--"):
            store = self.target(n.kids[0])
            old = store(None, n)
            return store(self.node("op_prefix", None, t, self.type_of(old), n, __=old), n)
        if t in ("+", "-", "!", "~"):
            v = self.value(n.kids[0])
            return self.node("op_prefix", None, t, "Z" if t == "!" else self.type_of(v), n, __=v)
        if t == "(" and n.kids[0].rule in ("unary", "lambda_"):
            type_ = self.f.descriptor(w[n.start + 1 : n.kids[0].start - 1], self.method["vars"])
            return self.node("op_typecast", None, type_, type_, n, __=self.value(n.kids[0]))
        tails = n.only("postfix")
        steps = self._steps(tails[0]) if tails else []
        if steps and steps[-1][0] == "step":
            inner = Node("unary", n.start, tails[0].end - 1, [n.only("primary")[0], *([Node("postfix", tails[0].start, tails[0].end - 1, tails[0].kids)] if len(steps) > 1 else [])])
            store = self.target(inner)
            old = store(None, n)
            store(self.node("op_postfix", None, w[tails[0].end - 1], self.type_of(old), n, __=old), n)
            return old
        return self._chain(n.only("primary")[0], steps, n)

    def _steps(self, n: Node) -> list[tuple[str, int, Node | None]]:
        """The selectors of a postfix: (kind, token, node)."""
        out, i, k = [], n.start, self.f.k
        kids = {x.start: x for x in n.kids}
        while i < n.end:
            t = k[i]
            if t == "." and k[i + 1] == "ID" and i + 2 in kids and kids[i + 2].rule == "arguments":
                out.append(("call", i + 1, kids[i + 2]))
                i = kids[i + 2].end
            elif t == "." and k[i + 1] == "ID":
                out.append(("field", i + 1, None))
                i += 2
            elif t == "." and i + 2 in kids and kids[i + 2].rule == "creator":
                out.append(("new", i + 1, kids[i + 2]))
                i = kids[i + 2].end
            elif t == "." and k[i + 1] == "<":
                args = next((x for s, x in sorted(kids.items()) if s > i and x.rule == "arguments"), None)
                out.append(("call", args.start - 1, args) if args else ("other", i, None))
                i = args.end if args else n.end
            elif t == "[" and i + 1 in kids:
                out.append(("element", i, kids[i + 1]))
                i = kids[i + 1].end + 1
            elif t in ("++", "--"):
                out.append(("step", i, None))
                i += 1
            else:
                out.append(("other", i, None))
                i += 2 if t in (".", "::") else 1
        return out

    def _field(self, obj: int | None, name: str, cls: str | None = None) -> tuple[str, str]:
        owner = cls or (self.type_of(obj) if obj is not None else "?")
        found = self.f.field_of(owner, name)
        if found:
            return f".{found[0]}/.{name}", found[1]
        return f".{owner}/.{name}", "I" if name == "length" and owner.startswith("[") else "?"

    def _chain(self, base: Node, steps: list[tuple[str, int, Node | None]], at: Node) -> int:
        w, k = self.f.w, self.f.k
        cls = None
        name = w[base.start]
        if k[base.start] == "ID" and base.end == base.start + 1 and not self.lookup(name):
            cls = self.f.descriptor([name], self.method["vars"])
            v = None
            if not steps:
                v, cls = self.node("ref_field", f".{self.cls['name']}/.{name}", None, "?", base, __=self.read(f".{self.cls['name']}/.{name}", "?")), None
        else:
            v = self.value(base)
        for kind, i, kid in steps:
            if kind == "call":
                v, cls = self._call(v, cls, w[i], kid, at), None
            elif kind == "field":
                ref, type_ = self._field(v, w[i], cls)
                v, cls = self.node("ref_field", ref, None, type_, at, __=self.read(ref, type_), obj=v), None
            elif kind == "element":
                type_ = self.type_of(v)[1:] if v is not None and self.type_of(v).startswith("[") else "?"
                v = self.node("ref_array", f"%{type_}", None, type_, at, __=self.read(f"%{type_}", type_), array=v, index=self.value(kid))
            elif kind == "new":
                v = self.value(kid)
            elif k[i] == "::":
                v, cls = self._reference(v, cls, w[i + 1], at), None
            else:
                v = self.node("value", None, "".join(w[at.start : at.end]), "?", at) if v is None else v
        return v if v is not None else self.node("value", None, name, cls or "?", at)

    def _call(self, obj: int | None, cls: str | None, name: str, args: Node, at: Node) -> int:
        values = [self.value(x) for x in args.only("expression")]
        given = [self.type_of(v) for v in values]
        owner = cls or (self.type_of(obj) if obj is not None else self.cls["name"])
        places = [owner] if cls or obj is not None else [*self.owners(), *([self.f.statics[name]] if name in self.f.statics else self.f.static_classes)]
        if name == ":init:":
            places = [owner]
        known = [m for m in self.f.methods_named(places, name) if len(m["args"]) == len(values)]
        # the nearest by conversion of all arguments, the first among equals
        best = min(known, key=lambda m: sum(self.f.distance(v, d) for v, (_, d) in zip(given, m["args"])), default=None)
        call = self.node("new" if name == ":init:" else "call", None, best["id"] if best else f"{owner}.:init:" if name == ":init:" else f"!{name}", owner if name == ":init:" else best["result"] if best else "?", at)
        if obj is not None:
            self.link(call, f"@{owner}", obj)
        for j, v in enumerate(values):
            self.link(call, f"#arg{j}", v)
        return self.node("receive", None, None, self.type_of(call), at, __=call)

    def x_primary(self, n: Node) -> int:
        k, w, t = self.f.k, self.f.w, self.f.k[n.start]
        if t == "ID" and n.only("arguments"):
            return self._call(None, None, w[n.start], n.only("arguments")[0], n)
        if t == "ID" and n.end == n.start + 1:
            ref, type_ = self.lookup(w[n.start]) or (f".{self.cls['name']}/.{w[n.start]}", "?")
            return self.node("ref_field" if ref[0] == "." else "ref_var", ref, None, type_, n, __=self.read(ref, type_))
        if t == "LIT":
            text = w[n.start]
            type_ = "Ljava/lang/String;" if text[0] == '"' else "C" if text[0] == "'" else "Z" if text in ("true", "false") else "?" if text == "null" else "D" if "." in text else "I"
            return self.node("value", None, text, type_, n)
        if t == "(":
            return self.value(n.kids[0])
        if t == "this":
            if n.only("arguments"):
                return self._call(None, self.cls["name"], ":init:", n.only("arguments")[0], n)
            return self.read(f"@{self.cls['name']}", self.cls["name"])
        if t == "super" and n.only("arguments"):
            return self._call(None, self.cls["base"] or "Ljava/lang/Object;", ":init:", n.only("arguments")[0], n)
        if t == "super":
            return self.read(f"@{self.cls['name']}", self.cls["base"] or "Ljava/lang/Object;")
        if t == "new":
            return self.value(n.only("creator")[0])
        if t == "switch":
            return self.switch(n.only("switch_body")[0])
        return self.node("value", None, "".join(w[n.start : n.end]), "?", n)

    def x_creator(self, n: Node) -> int:
        w, args = self.f.w, n.only("arguments")
        types = n.only("type")
        type_ = self.f.descriptor(w[types[0].start : types[0].end], self.method["vars"]) if types else "?"
        if args:
            return self._call(None, type_, ":init:", args[0], n)
        dims = len(n.only("expression")) or 1
        made = self.node("valueset", None, None, "[" * dims + type_, n)
        for j, x in enumerate([*n.only("expression"), *(y for i in n.only("initializer") for y in i.only("initializer"))]):
            self.link(made, f"value{j}", self.value(x))
        return made

    def _reference(self, obj: int | None, cls: str | None, name: str, at: Node) -> int:
        """A method reference: which method it means is resolved, it has no graph."""
        owner = cls or (self.type_of(obj) if obj is not None else self.cls["name"])
        found = self.f.methods_named([owner], ":init:" if name == "new" else name)
        made = self.node("capture", None, found[0]["id"] if found else f"{owner}.:init:" if name == "new" else f"!{name}", "?", at)
        if obj is not None:
            self.link(made, f"@{owner}", obj)
        return made

    def x_lambda_(self, n: Node) -> int:
        """A lambda is a method of its own; what it uses from outside is captured."""
        number = len(self.lambdas)
        name = f":lambda{self.number}_{number}:"
        body = n.only("block", "expression")
        arrow = next(i for i in range(n.start, n.end) if self.f.k[i] == "->")
        params = n.only("parameters")
        args = self.f._parameters(params[0], self.method["vars"]) if params else [(self.f.w[i], "?") for i in range(n.start, arrow) if self.f.k[i] == "ID"]
        method = {"name": name, "id": f"{self.cls['name']}.{name}({''.join(d for _, d in args)})?", "style": "lambda", "args": args, "result": "?", "body": body[-1] if body and body[-1].rule == "block" else None, "value": body[-1] if body and body[-1].rule != "block" else None, "node": n, "vars": self.method["vars"]}
        self.lambdas.append((method, [dict(names) for _, names in self.scopes]))
        made = self.node("capture", None, method["id"], "?", n)
        own = {a for a, _ in args}
        for i in range(arrow, n.end):
            if self.f.k[i] == "ID" and self.f.k[i - 1] != "." and self.f.w[i] not in own:
                known = self.lookup(self.f.w[i])
                if known and not any(label == known[0] for label, _ in self.rows[made]["links"]) and (known[0] in self.env or known[0][0] == "."):
                    self.link(made, known[0], self.read(*known))
        return made

    def purge(self) -> None:
        """Take out joins whose ways are all the same, and joins that repeat another, until nothing changes."""
        alias: dict[int, int] = {}

        def real(v: int) -> int:
            while v in alias:
                v = alias[v]
            return v

        changed = True
        while changed:
            changed, known = False, {}
            for j, r in enumerate(self.rows):
                if j in alias or r["kind"] not in ("join", "catchjoin", None):
                    continue
                links = [(label, real(v)) for label, v in r["links"]]
                ways = {v for label, v in links if label != "cond"}
                same = ways - {j}
                target = next(iter(same)) if len(same) == 1 and len(r["links"]) > 1 or (r["kind"] is None and len(same) == 1) else known.setdefault((r["kind"], r["ref"], r["scope"], tuple(sorted(links))), j)
                if target != j:
                    alias[j] = target
                    changed = True
        if alias:
            kept = [j for j in range(len(self.rows)) if j not in alias]
            place = {j: k for k, j in enumerate(kept)}
            self.rows = [{**self.rows[j], "links": [(label, place[real(v)]) for label, v in self.rows[j]["links"]]} for j in kept]


def signatures(f: File) -> list[dict]:
    """What other files may know of the classes of a file."""
    fields = ("name", "id", "args", "result")
    return [{"name": c["name"], "base": c["base"], "implements": c["implements"], "fields": c["fields"], "outer": c.get("outer", ""), "methods": [{k: x[k] for k in fields} for x in c["methods"]]} for c in f.classes]


def graph_rows(text: str, known: dict[str, dict] | None = None) -> list[tuple]:
    """Flat rows of a file's classes, methods, scopes, nodes and links; a single 'error' row if it does not parse."""
    try:
        f = File(text, known)
    except (JavaSyntaxError, RecursionError) as e:
        return [(0, "error", None, None, str(e)[:200], None, None, None, None, None, None, {})]
    out: list[tuple] = []

    def add(entity, parent, item, label="", kind=None, ref=None, data=None, type_=None, span=(None, None), attributes=None):
        out.append((len(out), entity, parent, item, label, kind, ref, data, type_, *span, attributes or {}))

    number = 0
    for c in f.classes:
        add("class", None, c["name"], attributes={"name": c["name"], **({"extends": c["base"]} if c["base"] else {}), **({"implements": " ".join(c["implements"])} if c["implements"] else {}), "fields": " ".join(f"{n}:{t}" for n, t in c["fields"].items())}, span=f.span(c["node"]))
        waiting: list[tuple[dict, list[dict] | None]] = [(m, None) for m in c["methods"] if "node" in m]
        while waiting:
            m, around = waiting.pop(0)
            number += 1
            g = MethodGraph(f, c, m, number)
            g.build(around)
            waiting = [*g.lambdas, *waiting]
            add("method", c["name"], m["id"], span=f.span(m["node"]), attributes={"name": m["name"], "style": m["style"]})
            for parent, name in g.scope_rows:
                add("scope", parent, name)
                for j, r in enumerate(g.rows):
                    if r["scope"] == name:
                        add("node", name, f"{g.prefix}{j}", "", r["kind"], r["ref"], r["data"], r["type"], r["span"])
                        for label, src in r["links"]:
                            add("link", f"{g.prefix}{j}", f"{g.prefix}{src}", label)
    return out


def declared(files: DataFrame, key: str, text: str, project: str) -> DataFrame:
    """(key, project, name, body, wanted): a row per class that a file declares, with its signature, and one per class that it may use."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for uid, body, where in zip(pdf[key], pdf[text], pdf[project]):
                try:
                    f = File(body)
                except (JavaSyntaxError, RecursionError):
                    continue
                own = signatures(f)
                rows += [(uid, where, c["name"], json.dumps(c), False) for c in own]
                names = {c["name"] for c in own}
                rows += [(uid, where, n, None, True) for n in sorted(f.used() - names)]
                rows += [(uid, where, b, None, True) for c in own for b in (c["base"], *c["implements"]) if b and b not in names]
            yield pd.DataFrame(rows, columns=[key, project, "name", "body", "wanted"])

    kinds = dict(files.dtypes)
    return files.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text, project).mapInPandas(run, f"`{key}` {kinds[key]}, `{project}` {kinds[project]}, name string, body string, wanted boolean")


def contexts(rows: DataFrame, key: str, project: str) -> DataFrame:
    """(key, known): for each file the signatures of the classes it may use and of all they inherit from, in its project.

    Where a project declares a class twice, one of them counts, always the same. A file's context is bounded by the names it uses.
    """
    where = F.coalesce(F.col(project).cast("string"), F.lit("\x00"))
    table = rows.where("not wanted").groupBy(where.alias("p"), "name").agg(F.min("body").alias("body"))
    bases = F.array_union(F.array(F.get_json_object("body", "$.base")), F.coalesce(F.from_json(F.get_json_object("body", "$.implements"), "array<string>"), F.array().cast("array<string>")))
    table = cut(table.select("p", "name", "body", bases.alias("bases")))
    front = cut(rows.where("wanted").select(key, where.alias("p"), "name").distinct().join(table.select("p", "name"), ["p", "name"], "left_semi"))
    seen = front
    while not front.isEmpty():
        up = front.join(table.select("p", "name", F.explode("bases").alias("base")), ["p", "name"]).where("base is not null").select(key, "p", F.col("base").alias("name")).distinct()
        front = cut(up.join(table.select("p", "name"), ["p", "name"], "left_semi").join(seen, [key, "p", "name"], "left_anti"))
        seen = seen.unionByName(front)
    return seen.join(table, ["p", "name"]).groupBy(key).agg(F.array_sort(F.collect_list("body")).alias("known"))


def java_graphs(files: DataFrame, key: str, text: str, project: str | None = None) -> DataFrame:
    """Rows of ``graph_rows`` for all files, in the columns of an XML graph document.

    With ``project``, a column, files with the same value (null is one too) know each other's classes; without it every
    file stands for itself.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uid, body, known in zip(pdf[key], pdf[text], pdf["known"]):
                made = graph_rows(body, {c["name"]: c for c in map(json.loads, known)} if known is not None else None)
                if made:
                    frame = pd.DataFrame(made, columns=_COLUMNS)
                    frame[["ast_start", "ast_end"]] = frame[["ast_start", "ast_end"]].astype("Int64")
                    frame.insert(0, key, uid)
                    yield frame

    kind = dict(files.dtypes)[key]
    own = files.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    if project is None:
        own = own.select(key, text, F.lit(None).cast("array<string>").alias("known"))
    else:
        known = contexts(cut(declared(own, key, text, project)), key, project)
        own = own.select(key, text).join(known, key, "left")
    return own.mapInPandas(run, f"`{key}` {kind}, {_FIELDS}")


def java_trees(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, depth, rule, s, e): the parse tree of every file that parses, depth first, with the tokens' places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uid, body in zip(pdf[key], pdf[text]):
                try:
                    f = File(body)
                except (JavaSyntaxError, RecursionError):
                    continue
                rows, stack = [], [(f.root, 0)]
                while stack:
                    n, depth = stack.pop()
                    rows.append((uid, len(rows), depth, n.rule, *(f.span(n) if n.end > n.start else (f.at(n.start), f.at(n.start)))))
                    stack += [(kid, depth + 1) for kid in reversed(n.kids)]
                yield pd.DataFrame(rows, columns=[key, "nth", "depth", "rule", "s", "e"])

    kind = dict(files.dtypes)[key]
    return files.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, nth bigint, depth bigint, rule string, s bigint, e bigint")
