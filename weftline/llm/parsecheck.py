"""Source files that are not valid in the language of their extension.

Every file is cut at line starts into chunks. A chunk is summarised by a lexer-state map: for each state in which a line
may begin, the state after the chunk, whether a token broke, and which closing and opening brackets (in XML: tags) remain
unmatched. Summaries compose associatively; a grouped aggregation reduces those of a file. What is balanced is cut into
groups of balanced statements of bounded length, each parsed by a local grammar: members of a Java class by a recogniser
of Java 17, top-level statements of Python by its own parser, elements of an XML root by expat, elements of a JSON value
by a strict parser. A text of valid groups is valid. The lexers of Python and XML are approximations (nested quotes of
f-strings, document types), so a refusal there is checked once more on the whole text.

Texts of up to ``SPREAD_CHARS`` stay in the task that reads them, only their summaries travel. The chunks of longer ones
are spread over all tasks, and so are their groups of statements.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.common import cut, fits_broadcast
from weftline.functions import java_syntax

#: The languages by extension.
LANGUAGES = {"java": "java", "py": "python", "xml": "xml", "graph": "xml", "json": "json"}
#: Characters of a chunk and of a group of statements, and of a text that one task reads whole.
CHUNK_CHARS, SPREAD_CHARS = 1 << 12, 1 << 20

_CODE, _COMMENT, _BLOCK, _BROKEN = "c", "k", "t", "x"
_SINGLE, _DOUBLE = "'", '"'
_CDATA, _PI, _TAG, _DOCTYPE = "d", "p", "g", "y"
#: Where a line may begin in each language: in code, in a comment, in a text block, in a tag or one of its values.
STATES = {"java": (_CODE, _COMMENT, _BLOCK), "json": (_CODE,), "python": (_CODE, _SINGLE, _DOUBLE), "xml": (_CODE, _COMMENT, _CDATA, _PI, _TAG, _SINGLE, _DOUBLE, _DOCTYPE)}
_END = {
    "java": {_COMMENT: re.compile(r"(?s:.*?)\*/"), _BLOCK: re.compile(r'(?:[^\\"]|\\.|"(?!""))*"""', re.S)},
    "json": {},
    "python": {_SINGLE: re.compile(r"(?:[^\\']|\\.|'(?!''))*'''", re.S), _DOUBLE: re.compile(r'(?:[^\\"]|\\.|"(?!""))*"""', re.S)},
    "xml": {_COMMENT: re.compile(r"(?s:.*?)-->"), _CDATA: re.compile(r"(?s:.*?)\]\]>"), _PI: re.compile(r"(?s:.*?)\?>"), _SINGLE: re.compile("[^']*'"), _DOUBLE: re.compile('[^"]*"')},
}
_AFTER = {"xml": {_SINGLE: _TAG, _DOUBLE: _TAG}}
_NEXT = {
    "java": re.compile(r"""[()\[\]{}]|//[^\r\n]*|/\*|\"\"\"|"(?:[^"\\\r\n]|\\.)*(?:"|$|(?=[\r\n]))|'(?:[^'\\\r\n]|\\.)*(?:'|$|(?=[\r\n]))""", re.M),
    "json": re.compile(r"""[\[\]{}]|"(?:[^"\\\r\n]|\\.)*(?:"|$|(?=[\r\n]))""", re.M),
    "python": re.compile(r"""[()\[\]{}]|\#[^\r\n]*|\"\"\"|'''|"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*(?:"|$|(?=[\r\n]))|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*(?:'|$|(?=[\r\n]))""", re.M),
    "xml": re.compile(r"<!--|<!\[CDATA\[|<\?|<!DOCTYPE|</([^\s>/]*)\s*>|<([^\s>/<!?]+)"),
}
_IN_TAG = re.compile(r"""["']|/?>""")
_PAIR = {")": "(", "]": "[", "}": "{"}
_LINE = re.compile(r"\r\n|\n|\r(?!\n)")


def chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """Pieces of about ``size`` characters that end after a line feed which no backslash precedes."""
    out, at = [], 0
    while at < len(text):
        cut_at = text.find("\n", at + size - 1) + 1
        while cut_at and text[:cut_at].endswith(("\\\n", "\\\r\n"), max(0, cut_at - 3)):
            cut_at = text.find("\n", cut_at) + 1
        out.append(text[at : cut_at or len(text)])
        at = cut_at or len(text)
    return out or [""]


class _Run:
    """One pass over a text from a state: the state after it, and the brackets that stay unmatched; ``seen`` notes the way."""

    def __init__(self, language: str, state: str, text: str, seen=None):
        self.language, self.close, self.open = language, [], []
        self.seen = seen
        self.state = self._xml(state, text) if language == "xml" else self._code(state, text)

    def _pop(self, closing: str) -> bool:
        if not self.open:
            self.close.append(closing)
            return True
        return _fits(self.language, closing, self.open.pop())

    def _code(self, state: str, text: str) -> str:
        at, language = 0, self.language
        ends, following, seen = _END[language], _NEXT[language], self.seen
        quotes = ('"""', "'''") if language == "python" else ('"""',)
        while True:
            if state in ends:
                m = ends[state].match(text, at)
                if not m:
                    return state
                state, at = _CODE, m.end()
            m = following.search(text, at)
            if not m:
                return state
            t, at = m.group(), m.end()
            if t in "([{":
                self.open.append(t)
            elif t in _PAIR:
                if not self._pop(t):
                    return _BROKEN
            elif t == "/*":
                state = _COMMENT
            elif t in quotes and language != "json":
                state = _BLOCK if language == "java" else t[0]
            elif t[0] in "\"'" and (len(t) < 2 or t[-1] != t[0]):
                return _BROKEN
            if seen is not None:
                seen(m.start(), t, len(self.open))

    def _xml(self, state: str, text: str) -> str:
        at, ends, seen = 0, _END["xml"], self.seen
        while True:
            if state in ends:
                m = ends[state].match(text, at)
                if not m:
                    return state
                state, at = _AFTER["xml"].get(state, _CODE), m.end()
            elif state == _TAG:
                m = _IN_TAG.search(text, at)
                if not m:
                    return state
                t, at = m.group(), m.end()
                if t in "\"'":
                    state = t
                    continue
                state = _CODE
                if t == "/>" and not self._pop("/"):
                    return _BROKEN
                if seen is not None:
                    seen(at, t, len(self.open))
            elif state == _DOCTYPE:
                return state  # a document type is left to the grammar
            else:
                m = _NEXT["xml"].search(text, at)
                if not m:
                    return state
                t, at = m.group(), m.end()
                if t.startswith("</"):
                    if not self._pop(m[1]):
                        return _BROKEN
                    if seen is not None:
                        seen(at, t, len(self.open))
                elif m[2]:
                    self.open.append(m[2])
                    state = _TAG
                else:
                    state = {"<!--": _COMMENT, "<![CDATA[": _CDATA, "<?": _PI}.get(t, _DOCTYPE)


def _fits(language: str, closing: str, opening: str) -> bool:
    return closing in ("/", opening) if language == "xml" else _PAIR[closing] == opening


def summary(language: str, text: str, first: bool = False) -> dict[str, list]:
    """The lexer-state map of a chunk: state before to [state after, closing, opening]. A ``first`` chunk begins in code."""
    out = {}
    for s in (_CODE,) if first else STATES[language]:
        run = _Run(language, s, text)
        out[s] = [_BROKEN, [], []] if run.state == _BROKEN else [run.state, run.close, run.open]
    return out


def compose(language: str, a: dict[str, list], b: dict[str, list]) -> dict[str, list]:
    """The map of two neighbouring chunks; states that only the second one has (or lacks) do not occur."""
    out = {}
    for start, (middle, close, open_) in a.items():
        if middle == _BROKEN or middle not in b:
            out[start] = [_BROKEN, [], []]
            continue
        end, close2, open2 = b[middle]
        n = min(len(open_), len(close2))
        if end == _BROKEN or not all(_fits(language, c, o) for c, o in zip(close2[:n], reversed(open_))):
            out[start] = [_BROKEN, [], []]
        else:
            out[start] = [end, close + close2[n:], open_[: len(open_) - n] + open2]
    return out


def folded(language: str, maps: list[dict[str, list]]) -> dict[str, list]:
    """All maps of a file as one, by halves."""
    while len(maps) > 1:
        maps = [compose(language, *maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    return maps[0]


def balanced(whole: dict[str, list]) -> bool:
    """Whether a file with this map ends in code with all brackets matched; a document type leaves it open."""
    state, close, open_ = whole[_CODE]
    return state == _DOCTYPE or (state == _CODE and not close and not open_)


def _python(text: str) -> bool:
    text = text.removeprefix("\ufeff")  # a file may begin with a byte order mark, a text may not
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError):
        return True  # nested beyond what the parser can refute
    return True


def _xml(text: str) -> bool:
    parser = expat.ParserCreate("utf-8")
    try:
        parser.Parse(text.encode("utf-8"), True)
    except (expat.ExpatError, UnicodeEncodeError):
        return False
    return True


def _refuse(name: str):
    raise ValueError(name)


def _json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_refuse, parse_int=len, parse_float=len)
    except RecursionError:
        return True
    except ValueError:
        return False
    return True


def _java(text: str) -> bool:
    try:
        return java_syntax.parses(text)
    except RecursionError:
        return True


GRAMMARS = {"java": _java, "python": _python, "xml": _xml, "json": _json}


# groups of balanced statements: (text, how it is parsed), whose validity makes up that of the whole text


def _grouped(ends: list[int], start: int, stop: int, size: int) -> list[tuple[int, int]]:
    """Ranges of at least ``size`` characters between ``start`` and ``stop`` that end at one of ``ends``."""
    out = []
    for e in ends:
        if e - start >= size and stop > e:
            out.append((start, e))
            start = e
    return [*out, (start, stop)]


def _java_groups(text: str, size: int) -> list[str] | None:
    """The members of the only class or interface of a file, and the file without them."""
    brackets: list[tuple[int, str, int]] = []
    _Run("java", _CODE, text, lambda at, t, depth: brackets.append((at, t, depth)))
    tops = [at for at, t, depth in brackets if t == "{" and depth == 1]
    closing = [at for at, t, depth in brackets if t == "}" and depth == 0]
    if len(tops) != 1 or len(closing) != 1:
        return None
    first, last = tops[0], closing[0]
    header = re.sub(r"//[^\r\n]*|/\*.*?\*/", " ", text[:first], flags=re.S)
    if not re.search(r"\b(?:class|interface)\b", header) or re.search(r"\b(?:enum|record)\b|@\s*interface\b", header):
        return None
    ends = [at + 1 for at, t, depth in brackets if t == "}" and depth == 1 and first < at < last]
    # a member ends at its brace unless it is a variable with a value in braces: what follows tells
    ends = [e for e in ends if _MEMBER.match(text, e)]
    return [text[: first + 1] + text[last:], *(f"class X {{{text[a:b]}\n}}" for a, b in _grouped(ends, first + 1, last, size))]


_MEMBER = re.compile(r"\s*(?:(?://[^\r\n]*|/\*(?s:.*?)\*/)\s*)*(?:@|public\b|protected\b|private\b|static\b|final\b|abstract\b|void\b|default\b)")


def _python_groups(text: str, size: int) -> list[str]:
    """Runs of top-level statements: they begin at the margin, outside of strings and brackets."""
    inside: list[tuple[int, int]] = []
    level = 0
    begun = 0

    def note(at: int, t: str, depth: int) -> None:
        nonlocal level, begun
        if depth and not level:
            begun = at
        if level and not depth:
            inside.append((begun, at))
        level = depth
        if t in ('"""', "'''"):
            end = _END["python"][t[0]].match(text, at + 3)
            inside.append((at, end.end() if end else len(text)))
        elif len(t) > 1 and t[0] in "\"'":
            inside.append((at, at + len(t)))

    _Run("python", _CODE, text, note)
    inside.sort()
    ends, k, decorated = [], 0, False
    for m in _LINE.finditer(text):
        at = m.end()
        while k < len(inside) and inside[k][1] <= m.start():
            k += 1
        # a line inside of a bracket or string, and one after a backslash, goes on
        if (k < len(inside) and inside[k][0] < m.start()) or text[max(0, m.start() - 1) : m.start()] == "\\" or at >= len(text):
            continue
        if text[at] in " \t\f\r\n#":
            continue
        goes_on = decorated or _CLAUSE.match(text, at)
        decorated = text[at] == "@"
        if not goes_on:
            ends.append(at)
    return [text[a:b] for a, b in _grouped(ends, 0, len(text), size)]


_CLAUSE = re.compile(r"(?:else|elif|except|finally)\b")


def _xml_groups(text: str, size: int) -> list[str] | None:
    """The elements of the root, and the document without them."""
    tags: list[tuple[int, str, int]] = []
    run = _Run("xml", _CODE, text, lambda at, t, depth: tags.append((at, t, depth)))
    if run.state != _CODE or not tags or tags[0][1] != ">" or tags[0][2] != 1 or tags[-1][2] != 0:
        return None
    first, last = tags[0][0], text.rfind("</", 0, tags[-1][0])
    if sum(depth == 0 for _, _, depth in tags) != 1:
        return None
    ends = [at for at, t, depth in tags if depth == 1 and t != ">" and first < at <= last]
    return [text[:first] + text[last:], *(f"<r>{text[a:b]}</r>" for a, b in _grouped(ends, first, last, size))]


def _json_groups(text: str, size: int) -> list[str] | None:
    """The elements of the outermost list or object."""
    body = text.strip(" \t\r\n")
    if not body or body[0] not in "[{":
        return None
    ends, depth, at = [], 0, 0
    for m in _JSON.finditer(body):
        t = m.group()
        if t in "[{":
            depth += 1
        elif t in "]}":
            depth -= 1
            if not depth:
                at = m.end()
                break
        elif t == "," and depth == 1:
            ends.append(m.end())
    if at != len(body) or not ends:
        return None
    parts = [body[a:b] for a, b in _grouped(ends, 1, len(body) - 1, size)]
    # every group but the last ends with the comma that parts it from the next
    inner = [*(p[:-1] for p in parts[:-1]), parts[-1]]
    return [body[0] + (p if p.strip() else ",") + body[-1] for p in inner]


_JSON = re.compile(r'[\[\]{},]|"(?:[^"\\]|\\.)*"')
_GROUPS = {"java": _java_groups, "python": _python_groups, "xml": _xml_groups, "json": _json_groups}
#: Languages whose lexer here is an approximation: what it refuses is read once more as a whole.
_ROUGH = ("python", "xml")


def prepared(language: str, text: str) -> str:
    """The text that the lexer reads: escapes of Java stand for their characters before anything else."""
    return java_syntax._unescaped(text) if language == "java" and "\\u" in text else text


def groups(language: str, text: str, size: int = CHUNK_CHARS) -> list[str]:
    """Groups of balanced statements of a balanced text; the whole text where it is short or has another shape."""
    if len(text) <= size or (language == "java" and "\\u" in text):
        return [text]
    return _GROUPS[language](text, size) or [text]


def maps(language: str, text: str, size: int = CHUNK_CHARS) -> list[dict[str, list]]:
    """The lexer-state maps of the chunks of a text."""
    return [summary(language, c, not k) for k, c in enumerate(chunks(prepared(language, text), size))]


def parsed(language: str, text: str, ok: bool, size: int = CHUNK_CHARS) -> bool:
    """Whether the local grammars accept a text whose maps say ``ok``."""
    if "\x00" in text:
        return False
    grammar = GRAMMARS[language]
    parts = groups(language, text, size) if ok else []
    if parts and all(grammar(g) for g in parts):
        return True
    return (language in _ROUGH and parts != [text]) and grammar(text)


def valid(language: str, text: str, size: int = CHUNK_CHARS) -> bool:
    """Whether a whole text is valid: its chunks are balanced, and the grammar accepts its groups of statements."""
    return parsed(language, text, balanced(folded(language, maps(language, text, size))), size)


def language_of(path) -> F.Column:
    """The language of a path's extension in any case, null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    made = F.lit(None).cast("string")
    for known, language in LANGUAGES.items():
        made = F.when(extension == known, language).otherwise(made)
    return made


_PIECE = "uid bigint, h bigint, reponame string, language string, nth bigint, made string, bad boolean"


def _ready() -> None:
    sys.setrecursionlimit(max(20_000, sys.getrecursionlimit()))
    sys.set_int_max_str_digits(0)  # a long number is no syntax error


def checked(files: DataFrame, chunk_chars: int = CHUNK_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """(uid, reponame, language, valid) of every distinct non-null ``uid`` with a text and a known extension.

    Repeated rows of a uid count once; if their texts differ, one of them counts, always the same. An empty text is
    valid Java and Python, and invalid JSON and XML. A text nested beyond a parser's depth counts as valid, as nothing
    refutes it. Columns other than uid, reponame, srcpath and src_text are not read.
    """
    rows = files.where(F.col("uid").isNotNull() & F.col("src_text").isNotNull()).select("uid", F.xxhash64("src_text").alias("h"), "reponame", language_of(F.col("srcpath")).alias("language"), "src_text")
    rows = rows.where(F.col("language").isNotNull())

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _ready()
        for pdf in batches:
            known: dict[int, tuple[list[str], bool]] = {}
            out = []
            for uid, h, repo, language, body in zip(pdf["uid"], pdf["h"], pdf["reponame"], pdf["language"], pdf["src_text"]):
                if body is None:  # too long for this task
                    out.append((uid, h, repo, language, -1, None, False))
                    continue
                key = hash((language, body))
                if key not in known:
                    own = maps(language, body, chunk_chars)
                    ok = balanced(folded(language, own))
                    good = parsed(language, body, ok, chunk_chars)
                    # where only the whole text told, its summaries have no say
                    known[key] = ([json.dumps(x) for x in own] if ok or not good else [""], not good)
                made, bad = known[key]
                out += [(uid, h, repo, language, k, x, bad) for k, x in enumerate(made)]
            yield pd.DataFrame(out, columns=["uid", "h", "reponame", "language", "nth", "made", "bad"])

    held = F.when(F.length("src_text") <= spread_chars, F.col("src_text")).alias("src_text")
    pieces = cut(rows.select("uid", "h", "reponame", "language", held).mapInPandas(local, _PIECE))
    if not pieces.where("nth = -1").isEmpty():
        pieces = pieces.where("nth <> -1").unionByName(_spread(rows.where(F.length("src_text") > spread_chars), chunk_chars))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [not bad and (parts[0]["made"] == "" or balanced(folded(language, [json.loads(p["made"]) for p in parts]))) for language, parts, bad in zip(pdf["language"], pdf["parts"], pdf["bad"])]
            yield pdf[["uid", "h", "reponame"]].assign(language=pdf["language"], valid=ok)

    # rows repeated with the same text give the same pieces again
    in_order = F.array_sort(F.collect_set(F.when(F.col("made").isNotNull(), F.struct("nth", "made"))))
    per = pieces.repartition("uid").groupBy("uid", "h", "language").agg(F.min("reponame").alias("reponame"), in_order.alias("parts"), F.max("bad").alias("bad"))
    judged = per.mapInPandas(reduce, "uid bigint, h bigint, reponame string, language string, valid boolean")
    one = judged.groupBy("uid").agg(F.min(F.struct("h", "language", "reponame", "valid")).alias("x"))
    return one.select("uid", "x.reponame", "x.language", "x.valid")


def _spread(files: DataFrame, chunk_chars: int) -> DataFrame:
    """The pieces of long files: chunks summarised by all tasks, then the groups of statements of what is balanced."""
    fields = "uid bigint, h bigint, reponame string, language string, nth bigint, body string"

    def cut_up(how):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for uid, h, repo, language, body in zip(pdf["uid"], pdf["h"], pdf["reponame"], pdf["language"], pdf["src_text"]):
                    parts = how(language, body)
                    yield pd.DataFrame({"uid": uid, "h": h, "reponame": repo, "language": language, "nth": range(len(parts)), "body": parts})

        return run

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [json.dumps(summary(g, c, not k)) for g, c, k in zip(pdf["language"], pdf["body"], pdf["nth"])]
            yield pdf.drop(columns="body").assign(made=made, bad=False)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _ready()
        for pdf in batches:
            bad = ["\x00" in body or not GRAMMARS[g](body) for g, body in zip(pdf["language"], pdf["body"])]
            yield pdf.drop(columns="body").assign(made=None, bad=bad)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [balanced(folded(g, [json.loads(p["made"]) for p in parts])) for g, parts in zip(pdf["language"], pdf["parts"])]
            yield pdf[["uid", "h"]].assign(ok=ok)

    def recheck(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _ready()
        for pdf in batches:
            out = [(u, h, r, g, 0, "", False) for u, h, r, g, body in zip(pdf["uid"], pdf["h"], pdf["reponame"], pdf["language"], pdf["src_text"]) if GRAMMARS[g](body)]
            yield pd.DataFrame(out, columns=["uid", "h", "reponame", "language", "nth", "made", "bad"])

    once = files.dropDuplicates(["uid", "h"])
    spread = once.mapInPandas(cut_up(lambda g, t: chunks(prepared(g, t), chunk_chars)), fields).repartition("uid", "h", "nth")
    made = cut(spread.mapInPandas(summarise, _PIECE))
    parts = F.array_sort(F.collect_list(F.struct("nth", "made"))).alias("parts")
    whole = cut(made.groupBy("uid", "h", "language").agg(parts).mapInPandas(fold, "uid bigint, h bigint, ok boolean").where("ok"))
    side = F.broadcast(whole) if fits_broadcast(whole) else whole
    statements = once.join(side.select("uid", "h"), ["uid", "h"], "left_semi").mapInPandas(cut_up(lambda g, t: groups(g, t, chunk_chars)), fields)
    grown = cut(made.unionByName(statements.repartition("uid", "h", "nth").mapInPandas(parse, _PIECE)))
    # the approximate lexers' refusals: the whole text decides instead of the pieces
    doubted = grown.groupBy("uid", "h", "language").agg(F.max("bad").alias("bad")).where(F.col("language").isin(*_ROUGH)).join(whole, ["uid", "h"], "left").where("bad or ok is null").select("uid", "h")
    cleared = cut(once.join(doubted, ["uid", "h"], "left_semi").mapInPandas(recheck, _PIECE))
    return grown.join(cleared.select("uid", "h"), ["uid", "h"], "left_anti").unionByName(cleared)


def rates(done: DataFrame) -> DataFrame:
    """(reponame, language, n_files, n_invalid, rate) of checked files; a null reponame is a group of its own."""
    per = done.groupBy("reponame", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum((~F.col("valid")).cast("long")).alias("n_invalid"))
    return per.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
