"""Type descriptors of any nesting: parsed to a small tree, and back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One-letter descriptors and their numeric ranks; 0 is no number.
BASIC = {"B": 1, "C": 1, "S": 2, "I": 3, "J": 4, "F": 5, "D": 6, "Z": 0, "V": 0}


class DescriptorError(ValueError):
    """The text is no type descriptor."""


def parse(text: str, at: int = 0) -> tuple[tuple, int]:
    """(type, position after it). Types are (form, ...): basic code; array elem; class name, params; variable name;
    wildcard sign, bound; function args, result; unknown."""
    if at >= len(text):
        raise DescriptorError(f"nothing at {at} of {text!r}")
    ch = text[at]
    if ch in BASIC:
        return ("basic", ch), at + 1
    if ch == "?":
        return ("unknown",), at + 1
    if ch == "[":
        elem, at = parse(text, at + 1)
        return ("array", elem), at
    if ch == "*":
        return ("wildcard", "*", None), at + 1
    if ch in "+-":
        bound, at = parse(text, at + 1)
        return ("wildcard", ch, bound), at
    if ch == "T":
        end = text.find(";", at)
        if end < 0:
            raise DescriptorError(f"no end of a variable in {text!r}")
        return ("variable", text[at + 1 : end]), end + 1
    if ch == "L":
        params, k = [], at + 1
        while k < len(text) and text[k] not in ";<":
            k += 1
        name = text[at + 1 : k]
        if k < len(text) and text[k] == "<":
            k += 1
            while k < len(text) and text[k] != ">":
                param, k = parse(text, k)
                params.append(param)
            k += 1
            # a nested class of a generic one goes on after a dot or directly
            while k < len(text) and text[k] != ";":
                name += text[k]
                k += 1
        if k >= len(text) or text[k] != ";":
            raise DescriptorError(f"no end of a class in {text!r}")
        return ("class", name, tuple(params)), k + 1
    if ch == "(":
        args, k = [], at + 1
        while k < len(text) and text[k] != ")":
            arg, k = parse(text, k)
            args.append(arg)
        result, k = parse(text, k + 1)
        return ("function", tuple(args), result), k
    raise DescriptorError(f"{ch!r} begins no type in {text!r}")


def render(t: tuple) -> str:
    """The descriptor of a parsed type."""
    form = t[0]
    if form == "basic":
        return t[1]
    if form == "array":
        return "[" + render(t[1])
    if form == "class":
        return f"L{t[1]}" + (f"<{''.join(map(render, t[2]))}>" if t[2] else "") + ";"
    if form == "variable":
        return f"T{t[1]};"
    if form == "wildcard":
        return t[1] + (render(t[2]) if t[2] else "")
    if form == "function":
        return f"({''.join(map(render, t[1]))})" + render(t[2])
    return "?"


def shown(t: tuple) -> str:
    """A readable form: int[], Name<Other>."""
    names = {"B": "byte", "C": "char", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double", "Z": "boolean", "V": "void"}
    form = t[0]
    if form == "basic":
        return names[t[1]]
    if form == "array":
        return shown(t[1]) + "[]"
    if form == "class":
        return t[1].rpartition("/")[2] + (f"<{', '.join(map(shown, t[2]))}>" if t[2] else "")
    if form == "variable":
        return t[1]
    if form == "wildcard":
        return "?" if t[2] is None else f"? {'extends' if t[1] == '+' else 'super'} {shown(t[2])}"
    if form == "function":
        return f"({', '.join(map(shown, t[1]))}) -> {shown(t[2])}"
    return "?"


_STRUCT = T.StructType([T.StructField("form", T.StringType()), T.StructField("shown", T.StringType()), T.StructField("args", T.ArrayType(T.StringType())), T.StructField("result", T.StringType())])


@F.pandas_udf(_STRUCT)
def decode(c: pd.Series) -> pd.DataFrame:
    """(form, shown, args, result) of a descriptor: args are a function's arguments or a class's parameters; all null where it is none."""
    rows = []
    for text in c:
        row: tuple = (None, None, None, None)
        if text is not None:
            try:
                t, end = parse(text)
                if end == len(text):
                    inner = t[1] if t[0] == "function" else t[2] if t[0] == "class" else ()
                    row = (t[0], shown(t), [render(x) for x in inner], render(t[2]) if t[0] == "function" else None)
            except (DescriptorError, RecursionError):
                pass
        rows.append(row)
    return pd.DataFrame(rows, columns=["form", "shown", "args", "result"])


def conversion_distance(given: str, wanted: str) -> int | None:
    """Steps of widening from one basic or class type to another, None where there is none; unknown fits anything."""
    if given == wanted:
        return 0
    if "?" in (given, wanted):
        return 1
    a, b = BASIC.get(given, -1), BASIC.get(wanted, -1)
    if a > 0 and b > 0:
        return b - a if b > a or (b == a and given != wanted) else None
    if a < 0 and wanted == "Ljava/lang/Object;":
        return 9
    return None
