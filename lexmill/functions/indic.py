"""Text that goes to and comes from models of Indic languages: punctuation, and placeholders for what isn't translated."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.small import let
from lexmill.functions.text import BLANK, PLACEHOLDERS

S = f"[{BLANK}]"
#: Punctuation rules in their order, as (pattern, replacement).
PUNCTUATION = [
    ("\\r", ""), (f"\\({S}*", "("), (f"{S}*\\)", ")"), (f"{S}:{S}?", ":"), (f"{S};{S}?", ";"), ("[`´‘‚’]", "'"), ("[„“”«»]", '"'), ("[–—]", "-"), ("\\.\\.\\.", "..."),
    (" %", "%"), ("nº ", "nº "), (" ºC", " ºC"), (" ([?!;])", "$1"), (", ", ", "), (" {2,}", " "), ("\\) ([.!:?;,])", ")$1"), ("(\\p{Nd}) %", "$1%"), ('"([,.]+)', '$1"'), ("(\\p{Nd}) (\\p{Nd})", "$1.$2"),
]


#: What a text holds if a rule is to change it, by pattern: one of these strings. A rule without an entry always runs.
SIGNS = {
    "\\r": "\r", f"\\({S}*": "(", f"{S}*\\)": ")", f"{S}:{S}?": ":", f"{S};{S}?": ";", "[`´‘‚’]": "`´‘‚’", "[„“”«»]": "„“”«»", "[–—]": "–—",
    " ([?!;])": (" ?", " !", " ;"), " {2,}": ("  ",), "\\) ([.!:?;,])": (") ",), "(\\p{Nd}) %": (" %",), '"([,.]+)': ('",', '".'),
}


def normalize_punctuation(text: Column) -> Column:
    """The rules that change something, one after the other, each on texts that hold its sign, then the ends trimmed."""

    def ruled(pattern: str, replacement: str) -> Callable[[Column], Column]:
        def rule(t: Column) -> Column:
            holds = reduce(Column.__or__, [t.contains(sign) for sign in SIGNS[pattern]])
            return F.when(holds, F.regexp_replace(t, pattern, replacement)).otherwise(t)

        return rule

    for pattern, replacement in PUNCTUATION:
        if pattern.replace("\\", "") == replacement:
            continue
        text = let(text, ruled(pattern, replacement)) if pattern in SIGNS else F.regexp_replace(text, pattern, replacement)
    return F.regexp_replace(text, f"^{S}+|{S}+$", "")


#: What is wrapped, in this order (a URL between addresses and numerals).
URL = r"(?U)\b(?<![\w/.])(?:(?:https?|ftp)://)?(?:(?:[\w-]+\.)+(?!\.))(?:[\w/\-?#&=%.]+)(?!\.\w+)\b"
ORDER = (("email", PLACEHOLDERS["email"]), ("url", URL), ("numeral", PLACEHOLDERS["numeral"]), ("other", PLACEHOLDERS["other"]))
#: How a placeholder comes back, @ being its number.
SPELLINGS = ("<ID@>", "< ID@ >", "[ID@]", "[ ID@ ]", "[ID @]", "<ID@]", "< ID@]", "<ID@ ]", "<id@>", "< id@ >", "[id@]", "[ id@ ]", "[id @]", "<id@]", "< id@]", "<id@ ]")
#: Signs that don't count towards the four that make a URL or a numeral worth keeping.
UNCOUNTED = {"url": "[.]", "numeral": "[ .:]"}


def wrap_placeholders(text: Column) -> Column:
    """(text, entities): addresses, URLs, numerals and handles replaced by <ID1>, <ID2>, ..., and what each stood for, in order.

    Distinct matches are numbered by first appearance, kind by kind, each kind in the text
    that the kinds before it have left. White space runs become one space. Null stays null.
    """

    def put(s: Column, match: Column) -> Column:
        sign = F.concat(F.lit("<ID"), (F.size(s["entities"]) + 1).cast("string"), F.lit(">"))
        return F.struct(F.replace(s["text"], match, sign).alias("text"), F.concat(s["entities"], F.array(match)).alias("entities"))

    def wrapped(state: Column, kinds: tuple) -> Column:
        """Each kind's state is bound once: named as it is, it would be worked out twice a kind."""
        if not kinds:
            clean = F.replace(F.replace(F.regexp_replace(state["text"], f"{S}+", " "), F.lit(">/"), F.lit(">")), F.lit("]/"), F.lit("]"))
            return F.struct(clean.alias("text"), state["entities"].alias("entities"))
        kind, pattern = kinds[0]
        found = F.array_distinct(F.regexp_extract_all(state["text"], F.lit(pattern), F.lit(0)))
        if kind in UNCOUNTED:
            found = F.filter(found, lambda m: F.length(F.regexp_replace(m, UNCOUNTED[kind], "")) >= 4)
        return let(F.aggregate(found, state, put), lambda s: wrapped(s, kinds[1:]))

    return F.when(text.isNotNull(), let(F.struct(text.alias("text"), F.array().cast("array<string>").alias("entities")), lambda s: wrapped(s, ORDER)))


def restore_placeholders(text: Column, entities: Column) -> Column:
    """text with every spelling of every placeholder replaced by what it stood for, in order of number."""
    numbered = F.transform(entities, lambda e, i: F.struct((i + 1).cast("string").alias("n"), e.alias("e")))

    def put(t: Column, x: Column) -> Column:
        for spelling in SPELLINGS:
            before, after = spelling.split("@")
            t = F.replace(t, F.concat(F.lit(before), x["n"], F.lit(after)), x["e"])
        return t

    return F.aggregate(numbered, text, put)
