"""Scalar functions over identifiers, type descriptors and references, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.model import PRIMITIVES


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing or only '' matches."""
    return nonempty(F.regexp_extract(c, pattern, group))


def split_words(c: Column) -> Column:
    """Words of an identifier, last first, in lower case; an empty array for null."""
    found = F.regexp_extract_all(F.reverse(c), F.lit("[0-9]*[a-z]+[A-Z]?|[0-9]*[A-Z]+"), F.lit(0))
    return F.coalesce(F.transform(found, lambda w: F.lower(F.reverse(w))), F.array().cast("array<string>"))


def split_camel(c: Column) -> Column:
    """Camel-case parts in their order; digits and other characters separate."""
    return F.coalesce(F.regexp_extract_all(c, F.lit("[A-Z]+[a-z]*|[a-z]+"), F.lit(0)), F.array().cast("array<string>"))


def strip_id(c: Column) -> Column:
    """The trailing word of a reference name."""
    return extract(F.regexp_replace(c, "^%(?:\\[*)", ""), "([A-Za-z0-9_]+);?$")


def strip_generic(c: Column) -> Column:
    return F.substring_index(c, "<", 1)


def method_class(c: Column) -> Column:
    """The class descriptor of a method signature: what stands before the first ';.' with its semicolon."""
    return extract(c, "^(.*?;)\\.")


def method_simple_name(c: Column) -> Column:
    """The plain name between ';.' and '(': constructors and initialisers without their colons."""
    return extract(c, ";\\.:?([^(:]*):?\\(")


def method_args(c: Column) -> Column:
    return F.regexp_extract(c, "\\(([^)]*)\\)", 1)


def method_result(c: Column) -> Column:
    return extract(c, "\\)(.*)$")


def class_simple_name(c: Column) -> Column:
    """The last part of a class descriptor 'L<path>/Name;'."""
    return extract(strip_generic(F.regexp_replace(c, "^\\[*L?", "")), "([^/;]+);?$")


def reference_name(c: Column) -> Column:
    """The readable name of a reference, by its sigil."""
    sigil = F.left(c, F.lit(1))
    return (
        F.when(sigil == "$", F.substring_index(c, "/$", -1))
        .when(sigil == ".", F.substring_index(c, "/", -1))
        .when(sigil == "@", class_simple_name(F.substring(c, 2, 1 << 20)))
        .when(sigil == "%", F.concat(F.lit("["), F.coalesce(class_simple_name(F.substring(c, 2, 1 << 20)), F.substring(c, 2, 1 << 20)), F.lit("]")))
        .when(sigil == "#", F.substring(c, 2, 1 << 20))
        .when(sigil == "!", F.concat(F.lit("!"), class_simple_name(F.substring(c, 2, 1 << 20))))
        .otherwise(c)
    )


def type_dims(c: Column) -> Column:
    """Array dimensions of a type descriptor."""
    return F.length(F.regexp_extract(c, "^(\\[*)", 1)).cast("long")


def type_kind(c: Column) -> Column:
    """primitive, void, class, variable, wildcard, function or unknown: the form of the element type."""
    head = F.left(F.regexp_replace(c, "^\\[+", ""), F.lit(1))
    return (
        F.when(head.isin(*PRIMITIVES), "primitive").when(head == "V", "void").when(head == "L", "class").when(head == "T", "variable")
        .when(head.isin("+", "-", "*"), "wildcard").when(head == "(", "function").otherwise("unknown")
    )


def type_words(c: Column) -> Column:
    """Words of a type: of a class those of its path and name behind its dimensions and an L, of others the type itself."""
    header = F.regexp_extract(c, "^(\\[*)", 1)
    element = F.regexp_replace(c, "^\\[+", "")
    words = split_words(strip_generic(F.regexp_replace(element, "^L|;$", "")))
    return F.when(element.startswith("L"), F.transform(words, lambda w: F.concat(header, F.lit("L"), w))).otherwise(F.array(F.concat(header, element)))


def head_noun(c: Column) -> Column:
    """The trailing noun in lower case: [A-Z]?[a-z]+ or [A-Z]+ at the end."""
    return F.lower(extract(c, "([A-Z]?[a-z]+|[A-Z]+)$"))


def camel_join(words: Column) -> Column:
    """One camel-case identifier of lower-case words in their order."""
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")


def node_key(kind: Column, data: Column) -> Column:
    """Key for structural matching: null for relays and plain variables, else 'kind:data'."""
    return F.when(kind.isNull() | kind.isin("assign_var", "ref_var"), None).otherwise(F.concat(kind, F.lit(":"), F.coalesce(data, F.lit(""))))


def display_text(kind: Column, ref: Column, data: Column) -> Column:
    """What a viewer shows of a node."""
    return (
        F.when(kind.isNull(), "relay")
        .when(kind.isin("call", "new"), F.concat(kind, F.lit("("), F.coalesce(method_simple_name(F.substring_index(data, " ", 1)), F.lit("?")), F.lit(")")))
        .when(ref.isNotNull() & kind.startswith("assign"), F.concat(reference_name(ref), F.lit(" =")))
        .when(ref.isNotNull(), reference_name(ref))
        .when(data.isNotNull(), F.concat(kind, F.lit(" "), data))
        .otherwise(kind)
    )


def html_escape(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def dot_escape(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit('\\"'))


def span_id(label: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", F.lit(""), label, start.cast("string"), end.cast("string"))
