"""Text that was decoded with another encoding than it was written in, and its repair.

Every run of characters between ASCII white space that holds a non-ASCII character is a state of a graph. An edge encodes
the text with one encoding and decodes it with another, removes character references, or gives up characters that only a
failed decoding leaves behind. A best-first search enters the states in the order of what their operations have cost so
far and looks for the least sum of that price and the implausibility of the text. The implausibility is never negative,
so once the price alone reaches the best sum nothing better can follow, and the text found is the cheapest one. States
already seen are not entered again. Decoding and unescaping shorten a text and a chain goes between two encodings of
single bytes once at most, so the graph is finite and the search needs no bound on its states. What the runs of a
document gain by one chain of operations adds up: the document is garbled if that is enough.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings in which text was read wrongly, and in which it may have been written.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_2", "cp932", "gbk", "euc_jp")
WRITTEN_IN = ("utf_8", "cp1252", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_2", "mac_roman", "cp437", "cp850", "cp932", "euc_jp")
_WIDE = frozenset(("utf_8", "cp932", "euc_jp", "gbk"))
# Letters beyond ASCII in everyday use in the languages of the corpus, and Russian letters by frequency.
_COMMON = frozenset("äöüßéèêëàâçùûîïôœæñáíóúãõąćęłńśźż")
_RUSSIAN = {c: w for letters, w in (("оеаинтсрвл", 0.5), ("кмдпуяызь", 0.7), ("бгчйхжш", 0.9), ("юцщэфё", 1.3), ("ъ", 1.9)) for c in letters}
_TYPOGRAPHY = frozenset("“”‘·–—…»€™©®°§µ±×ºª½→≈≤≥≠←↔•−¼¾²³№")
_INNER = frozenset("’‑")
_OPENING = frozenset("¿¡«„")

#: Prices of operations: into UTF-8, which wrong guesses rarely pass, into other encodings, removing references, and
#: giving up what a failed decoding left. A chain that has gone between two encodings of single bytes may become almost
#: anything, so UTF-8 after that is dearer.
TO_UTF8, TO_OTHER, UNESCAPE, GIVE_UP, CROSSED_UTF8 = 0.6, 1.0, 0.2, 1.0, 2.5
#: Least gain of a document.
ENOUGH = 1.4
#: The chain of a text whose original cannot be had again.
LOST = "lost"

_RUN = re.compile(r"[^\t\n\x0b\x0c\r ]*[^\x00-\x7f][^\t\n\x0b\x0c\r ]*")
_APOSTROPHE = re.compile(r"(?<=[A-Za-z])’(?=(?:s|t|re|ve|ll|d|m)(?![^\W_]))|(?<![^\W_])(?:[dlncsjmtDLNCSJMT]|[Qq]u)’(?=[^\W_])")
_IDENTIFIER = re.compile("[a-z][A-Z]+[a-z]")
_REFERENCE = re.compile(r"&#?\w{2,8};")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def _table(codec: str) -> tuple[dict[int, int], dict[int, int]]:
    """Character to byte and back; bytes without a character stand for themselves, as lenient decoders have it."""
    to_byte, to_char = {}, {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        to_char[b] = ord(ch)
    for b, c in to_char.items():
        to_byte[c] = b
    # an encoding of single bytes has no other characters above ASCII
    for b in range(128, 160):
        to_byte.setdefault(b, b)
    return to_byte, to_char


_SINGLE = {c: _table(c) for c in {*READ_AS, *WRITTEN_IN} - _WIDE}
# characters of Latin-1 which the encoding lacks must not pass as bytes
_TO_BYTE = {c: {b: 0x10FFFF for b in range(160, 256)} | to for c, (to, _) in _SINGLE.items()}


def encode(text: str, codec: str) -> bytes | None:
    if codec in _WIDE:
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    try:
        return text.translate(_TO_BYTE[codec]).encode("latin-1")
    except UnicodeEncodeError:
        return None


def decode(data: bytes, codec: str) -> str | None:
    if codec in _WIDE:
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            return None
    return data.decode("latin-1").translate(_SINGLE[codec][1])


# the kind of a character: latin, Latin lower / upper ASCII, etc.; the cost is its own implausibility
_KINDS: dict[str, tuple[str, float]] = {}


def _kind(ch: str) -> tuple[str, float]:
    code = ord(ch)
    if code < 128:
        return ("a" if "a" <= ch <= "z" else "A" if "A" <= ch <= "Z" else "0" if ch.isdigit() else " "), 0.0
    if ch == "�" or 0x80 <= code < 0xA0 or 0xE000 <= code <= 0xF8FF:
        return "x", 5.0
    if ch in _INNER:
        return "q", 1.0
    if ch in _OPENING:
        return "o", 1.0
    if ch in _TYPOGRAPHY:
        return "s", 1.2
    low = ch.lower()
    if low in _COMMON:
        return ("l", 1.0) if ch == low else ("u", 1.1)
    if low in _RUSSIAN:
        return ("c", _RUSSIAN[low]) if ch == low else ("C", _RUSSIAN[low] + 0.1)
    if 0x3040 <= code <= 0x30FF:
        return "k", 0.5
    if 0x4E00 <= code <= 0x9FFF:
        return "h", 0.7
    if 0x3000 <= code <= 0x303F or 0xFF01 <= code <= 0xFF5E:
        return "j", 0.6
    if 0x2500 <= code <= 0x257F:
        return "b", 1.0 if ch in "─│├└┌┐┘┤┬┴┼" else 2.0
    if ch == "\xa0":
        return "n", 0.8
    group = unicodedata.category(ch)
    if group[0] == "L":
        name = unicodedata.name(ch, "")
        if name.startswith("LATIN"):
            return ("l", 2.2) if group == "Ll" else ("u", 2.3)
        if name.startswith("CYRILLIC"):
            return ("c", 2.4) if group == "Ll" else ("C", 2.5)
        if name.startswith("GREEK"):
            return "g", 1.6
        return "h", 2.5
    return ("x", 5.0) if group[0] == "C" else ("s", 2.5)


# The letters' kinds by script.
_SCRIPT = {"a": "L", "A": "L", "l": "L", "u": "L", "c": "C", "C": "C", "g": "G"}
_EAST = frozenset("kh")


def cost(text: str) -> float:
    """Implausibility of the characters and of their neighbours; 0 for ASCII."""
    total, before, run = 0.0, " ", 0
    kinds = []
    for ch in text:
        k = _KINDS.get(ch)
        if k is None:
            k = _KINDS[ch] = _kind(ch)
        kinds.append(k[0])
        total += k[1]
    n = len(kinds)
    if _IDENTIFIER.search(text):  # identifiers with inner capitals are ASCII
        total += sum(k in "lu" for k in kinds)
    if "’" in text:  # apostrophes at their usual places
        total -= 0.7 * len(_APOSTROPHE.findall(text))
    for i, k in enumerate(kinds):
        if k in "lu":
            run += 1
            if run > 1:
                total += 0.3 if run == 2 else 1.5
        else:
            run = 0
        if k in "aA0 " and before in "aA0 ":
            before = k
            continue
        mine, other = _SCRIPT.get(k), _SCRIPT.get(before)
        if mine and other:
            if mine != other:
                total += 3.5
            elif k in "uC" and before in "alc":
                total += 2.5
        if k == "s" and before in "lu":
            total += 2.0
        if k == "s" and other and i + 1 < n and kinds[i + 1] in _SCRIPT:
            total += 3.0 if before in "aA" else 1.5
        if k == "o" and other:
            total += 3.0
        if k == "b" and (other or before == "s") or before == "b" and (mine or k in "sq"):
            total += 2.5
        if (k in _EAST and before in "lugxcC") or (before in _EAST and k in "lugxcC"):
            total += 3.0
        before = k
    return total


_FAILED = re.compile("[\ufffd\x80-\x9f]+")


def _steps(text: str) -> Iterator[tuple[str, str]]:
    """The states next to ``text``: (operation, new text)."""
    if "&" in text and _REFERENCE.search(text):
        yield "unescape", html.unescape(text)
    seen: dict[bytes, str] = {}
    for wrong in READ_AS:
        data = encode(text, wrong)
        if data is None:
            if wrong in _SINGLE:
                part = _partial(text, wrong)
                if part:
                    yield f"{wrong}>utf_8", part
            continue
        if data in seen:
            continue
        seen[data] = wrong
        for right in WRITTEN_IN:
            if right != wrong and (right == "utf_8" or (right in _WIDE or wrong not in _WIDE)):
                new = decode(data, right)
                if new is not None and new != text and (right == "utf_8" or right not in _WIDE or _japanese(new)):
                    yield f"{wrong}>{right}", new
                elif new is None and right == "utf_8" and wrong in _SINGLE:
                    part = _partial(text, wrong)
                    if part:
                        yield f"{wrong}>utf_8", part


def _japanese(text: str) -> bool:
    """Whether double-byte decoding gave what Japanese looks like: kana, and nothing but Japanese beyond ASCII."""
    kinds = [(_KINDS.get(c) or _KINDS.setdefault(c, _kind(c)))[0] for c in text if ord(c) > 127]
    return kinds.count("k") >= 2 and len(kinds) >= 4 and all(k in "khj" for k in kinds)


def _plain_japanese(beyond: list[str]) -> bool:
    """Whether the characters beyond ASCII are those of everyday Japanese, a fifth of them kana: nothing to repair."""
    kinds = [_KINDS.get(c) or _KINDS.setdefault(c, _kind(c)) for c in beyond]
    return 5 * sum(k == "k" for k, _ in kinds) >= len(kinds) and all(k in "khj" and c < 1 for k, c in kinds)


def _partial(text: str, wrong: str) -> str | None:
    """The text with every valid UTF-8 sequence in it decoded, the rest as it is."""
    to_byte = _SINGLE[wrong][0]
    data = bytes(to_byte.get(ord(c), 0) if ord(c) > 127 else ord(c) for c in text)
    out, at = [], 0
    for m in _UTF8.finditer(data):
        out += [text[at : m.start()], m.group().decode("utf-8")]
        at = m.end()
    return "".join(out) + text[at:] if out else None


_SEARCHED: dict[str, list[tuple[str, str, float]]] = {}


def _price(operation: str, crossed: bool) -> float:
    if operation.endswith("utf_8"):
        return CROSSED_UTF8 if crossed else TO_UTF8
    return {"unescape": UNESCAPE, LOST: GIVE_UP}.get(operation, TO_OTHER)


def search(text: str) -> list[tuple[str, str, float]]:
    """(chain, text, gain) of the states that are cheaper than ``text``, best first; the gain is net of the operations."""
    known = _SEARCHED.get(text)
    if known is not None:
        return known
    start = cost(text)
    beyond = [c for c in text if ord(c) > 127]
    # one letter or symbol for itself tells nothing
    if (len(beyond) == 1 and _kind(beyond[0])[0] != "x" and not any(c.isalpha() for c in text if c < "\x80")) or _plain_japanese(beyond):
        _SEARCHED[text] = []
        return []
    found: dict[str, tuple[str, float]] = {}
    visited = {(hash(text), False): 0.0}
    queue: list[tuple[float, float, str, str]] = [(0.0, start, text, "")]
    least = start
    while queue:
        paid, _, now, chain = heapq.heappop(queue)
        if chain and paid + UNESCAPE >= least:
            break  # whatever follows costs more than the best text known
        operations = chain.split()
        crossed = any(not o.endswith("utf_8") and o != "unescape" for o in operations)
        if chain and paid + (CROSSED_UTF8 if crossed else TO_UTF8) >= least and not _REFERENCE.search(now):
            continue
        given_up = [(LOST, _FAILED.sub("", text))] if not chain and _FAILED.search(text) else []
        for operation, new in (*_steps(now), *given_up):
            other = operation not in ("unescape", LOST) and not operation.endswith("utf_8")
            # two encodings of single bytes in a row would turn anything into anything
            if other and crossed:
                continue
            key, price = (hash(new), crossed or other), paid + _price(operation, crossed)
            if visited.get(key, price + 1.0) <= price:
                continue
            c, path = cost(new), f"{chain} {operation}".strip()
            least = min(least, c + price)
            gain = start - c - price
            # between encodings of single letters small gains count too: many runs together may tell
            if (gain > 0 or (other and not operations and c < start - 0.3)) and (path not in found or found[path][1] < gain):
                found[path] = (new, gain)
            if operation != LOST:
                visited[key] = price
                heapq.heappush(queue, (price, c, new, path))
    result = sorted(((chain, new, gain) for chain, (new, gain) in found.items()), key=lambda x: (-x[2], x[0]))
    if len(_SEARCHED) > 200_000:
        _SEARCHED.clear()  # a memory of what was searched, nothing else
    _SEARCHED[text] = result
    return result


def _apply(text: str, chain: str) -> str | None:
    for operation in chain.split():
        if operation == "unescape":
            text = html.unescape(text)
            continue
        wrong, right = operation.split(">")
        data = encode(text, wrong)
        new = decode(data, right) if data is not None else None
        if new is None and right == "utf_8" and wrong in _SINGLE:
            new = _partial(text, wrong)
        if new is None:
            return None
        text = new
    return text


def examine(text: str) -> tuple[bool, str | None, str | None]:
    """(garbled, restored text, chain). The restored text is null where something is lost for good or nothing helps."""
    if text.isascii():
        return False, None, None
    runs = list(_RUN.finditer(text))
    gains: dict[str, float] = {}
    small: dict[str, list[float]] = {}
    for run in {m.group() for m in runs}:
        for chain, _, gain in search(run):
            if gain > 0:
                gains[chain] = gains.get(chain, 0.0) + gain
            if " " not in chain and chain != LOST and not chain.endswith("utf_8"):
                small.setdefault(chain, []).append(gain + TO_OTHER)
    # a chain that helps three different runs or more pays its price once
    for chain, each in small.items():
        if len(each) >= 3:
            gains[chain] = max(gains.get(chain, 0.0), sum(each) - TO_OTHER)
    if max(gains.values(), default=0.0) < ENOUGH:
        return False, None, None
    # what can be had again comes before what is given up
    best = max((c for c in gains if LOST not in c.split()), key=lambda c: (gains[c], c), default=None)
    out, at = [], 0
    for m in runs:
        run = m.group()
        own = [x for x in search(run) if LOST not in x[0].split()]
        # the document's chain comes first, then what suits the run alone
        new = _apply(run, best) if best else None
        if new is not None and cost(new) > cost(run) + (0.5 if "utf_8" in best else 0.0):
            new = None
        if own and own[0][2] >= 1.0 and (new is None or cost(own[0][1]) < cost(new) - 1.0):
            new = own[0][1]
        out += [text[at : m.start()], run if new is None else new]
        at = m.end()
    restored = "".join(out) + text[at:]
    whole = restored != text and "�" not in text + restored
    return True, restored if whole else None, best if best is not None else LOST


def repaired(documents: DataFrame) -> DataFrame:
    """(doc_id, restored, chain) of the garbled documents.

    Null, empty and ASCII texts are never garbled. ``restored`` is null where the original cannot be had again. Texts are
    read whole; each row stands for itself, so repeated rows give repeated rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(doc, *found[1:]) for doc, text in zip(pdf["doc_id"], pdf["text"]) if (found := examine(text))[0]]
            yield pd.DataFrame(out, columns=["doc_id", "restored", "chain"])

    # most texts are ASCII: they never reach Python
    texts = documents.where(F.col("text").rlike("[^\\x00-\\x7f]")).select("doc_id", "text")
    return texts.mapInPandas(run, "doc_id bigint, restored string, chain string")
