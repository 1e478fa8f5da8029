"""Text columns: guards, tokens, n-gram feature ids, punctuation, placeholders, lines and sentences.

All of it is built-in functions, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format characters without width, and what counts as white space at the ends of a text.
INVISIBLE = "\\u200B-\\u200F\\u2028-\\u202E\\u2060-\\u2064\\uFEFF"
BLANK = "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Characters that end a token.
TOKEN_BREAKS = " \\t\\n\\x0B\\f\\r"
END_TOKEN = "</s>"
MAX_CHARS, MAX_TOKENS = 10_000, 1024


def has_visible_content(text: Column) -> Column:
    """Whether a reader would see anything; null is not visible."""
    return F.coalesce(text.rlike(f"[^{INVISIBLE}{BLANK}]"), F.lit(False))  # ends at the first that is seen


def tokens(text: Column) -> Column:
    """White-space tokens, then the end token; a no-break space is part of a token."""
    return F.concat(F.filter(F.split(text, f"[{TOKEN_BREAKS}]+"), lambda t: t != ""), F.array(F.lit(END_TOKEN)))


def guard_status(text: Column, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS) -> Column:
    """EMPTY_INPUT, TOO_MANY_CHARS, TOO_MANY_TOKENS or OK, the first that holds; a limit itself is allowed."""
    return (
        F.when(~has_visible_content(text), "EMPTY_INPUT")
        .when(F.length(text) > max_chars, "TOO_MANY_CHARS")
        .when(F.size(tokens(text)) - 1 > max_tokens, "TOO_MANY_TOKENS")
        .otherwise("OK")
    )


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-8 bytes, where bytes from 0x80 on are extended by their sign."""
    code = F.hex(text.cast("binary"))
    byte = lambda i: F.conv(F.substring(code, 2 * i - 1, 2), 16, 10).cast("long")
    values = F.transform(F.sequence(F.lit(1), F.shiftright(F.length(code), 1)), lambda i: byte(i))
    values = F.when(F.length(code) > 0, values).otherwise(F.array().cast("array<bigint>"))
    signed = lambda b: F.when(b >= 128, b + 0xFFFFFF00).otherwise(b)
    return F.aggregate(values, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(signed(b)) * 16777619).bitwiseAND(0xFFFFFFFF))


def subwords(token: Column, minn: int = 2, maxn: int = 5) -> Column:
    """All n-grams, minn to maxn code points, of <token>, by start, then length."""
    word = F.concat(F.lit("<"), token, F.lit(">"))
    at = lambda i: F.transform(F.filter(F.sequence(F.lit(minn), F.lit(maxn)), lambda n: i + n - 1 <= F.length(word)), lambda n: F.substr(word, i, n))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), at))


def subword_ids(token: Column, nwords: int, bucket: int, minn: int = 2, maxn: int = 5) -> Column:
    return F.transform(subwords(token, minn, maxn), lambda g: F.lit(nwords) + fnv1a(g) % bucket)


#: Signs that become a plain one, each by itself.
QUOTES, APOSTROPHES, DASH, LONG_DASH = "„“”″«»‟‶〃˝", "´‘‹›’ʼ‚′", "–", "—"
NBSP = "\u00A0"


def normalize_punctuation(text: Column) -> Column:
    """Plain quotes, dashes and brackets, with spaces where English has them.

    Signs that stand for themselves are mapped in one pass (none of the other rules sees
    them), fixed sequences are replaced literally; only what depends on a class of
    characters is a regular expression.
    """
    put = lambda c, *pairs: put(F.replace(c, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:]) if pairs else c
    one_space = lambda c: F.regexp_replace(c, " {2,}", " ")
    t = F.translate(text, QUOTES + APOSTROPHES + DASH + "\r", '"' * len(QUOTES) + "'" * len(APOSTROPHES) + "-")
    t = one_space(put(t, ("(", " ("), (")", ") ")))
    t = put(F.regexp_replace(t, "\\) ([.!:?;,])", ")$1"), ("( ", "("), (" )", ")"))
    t = put(F.regexp_replace(t, "(\\p{Nd}) %", "$1%"), (" :", ":"), (" ;", ";"))
    t = one_space(put(t, (LONG_DASH, " - ")))
    t = put(t, (NBSP + "%", "%"), ("nbsp;", " "), (NBSP + ":", ":"), (f"{NBSP}º{NBSP}C", " ºC"), (NBSP + "cm", " cm"), (NBSP + "?", "?"), (NBSP + "!", "!"), (NBSP + ";", ";"), ("," + NBSP, ", "))
    t = F.regexp_replace(one_space(t), '"([,.]+)', '$1"')
    return F.regexp_replace(t, f"^[{BLANK}]+|[{BLANK}]+$", "")


#: Spaces that go before punctuation and contractions, in order.
CLEAN_UP = [(" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re")]


def clean_up_spaces(text: Column) -> Column:
    for old, new in CLEAN_UP:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


#: Digits of other scripts and the ASCII digit of each.
NATIVE_DIGITS = {
    "\u09E6": "0", "\u0AE6": "0", "\u0CE6": "0", "\u0966": "0", "\u0660": "0", "\uABF0": "0", "\u0B66": "0", "\u0A66": "0", "\u1C50": "0", "\u06F0": "0",
    "\u09E7": "1", "\u0AE7": "1", "\u0967": "1", "\u0CE7": "1", "\u06F1": "1", "\uABF1": "1", "\u0B67": "1", "\u0A67": "1", "\u1C51": "1", "\u0C67": "1",
    "\u09E8": "2", "\u0AE8": "2", "\u0968": "2", "\u0CE8": "2", "\u06F2": "2", "\uABF2": "2", "\u0B68": "2", "\u0A68": "2", "\u1C52": "2", "\u0C68": "2",
    "\u09E9": "3", "\u0AE9": "3", "\u0969": "3", "\u0CE9": "3", "\u06F3": "3", "\uABF3": "3", "\u0B69": "3", "\u0A69": "3", "\u1C53": "3", "\u0C69": "3",
    "\u09EA": "4", "\u0AEA": "4", "\u096A": "4", "\u0CEA": "4", "\u06F4": "4", "\uABF4": "4", "\u0B6A": "4", "\u0A6A": "4", "\u1C54": "4", "\u0C6A": "4",
    "\u09EB": "5", "\u0AEB": "5", "\u096B": "5", "\u0CEB": "5", "\u06F5": "5", "\uABF5": "5", "\u0B6B": "5", "\u0A6B": "5", "\u1C55": "5", "\u0C6B": "5",
    "\u09EC": "6", "\u0AEC": "6", "\u096C": "6", "\u0CEC": "6", "\u06F6": "6", "\uABF6": "6", "\u0B6C": "6", "\u0A6C": "6", "\u1C56": "6", "\u0C6C": "6",
    "\u09ED": "7", "\u0AED": "7", "\u096D": "7", "\u0CED": "7", "\u06F7": "7", "\uABF7": "7", "\u0B6D": "7", "\u0A6D": "7", "\u1C57": "7", "\u0C6D": "7",
    "\u09EE": "8", "\u0AEE": "8", "\u096E": "8", "\u0CEE": "8", "\u06F8": "8", "\uABF8": "8", "\u0B6E": "8", "\u0A6E": "8", "\u1C58": "8", "\u0C6E": "8",
    "\u09EF": "9", "\u0AEF": "9", "\u096F": "9", "\u0CEF": "9", "\u06F9": "9", "\uABF9": "9", "\u0B6F": "9", "\u0A6F": "9", "\u1C59": "9", "\u0C6F": "9",
}


def fold_digits(text: Column) -> Column:
    return F.translate(text, "".join(NATIVE_DIGITS), "".join(NATIVE_DIGITS.values()))


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def drop_bpe_markers(text: Column) -> Column:
    """Without any @ and the white space after it: a subword vocabulary's sign that the word goes on."""
    return F.regexp_replace(text, f"@[{BLANK}]*", "")


def bare_code(token: Column) -> Column:
    """fr for __fr__; null for anything else."""
    return F.nullif(F.regexp_extract(token, "^__([a-z_A-Z-]+)__$", 1), F.lit(""))


#: What is kept from translation, in the order in which it is looked for.
PLACEHOLDERS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}",
    "numeral": r"(~?\d+\.?\d*\s?%?\s?-?\s?~?\d+\.?\d*\s?%|~?\d+%|\d+[-\/.,:']\d+[-\/.,:'+]\d+(?:\.\d+)?|\d+[-\/.:'+]\d+(?:\.\d+)?)",
    "other": r"[A-Za-z0-9]*[#|@]\w+",
}


def placeholder_matches(text: Column, kind: str) -> Column:
    """Distinct matches in order of first appearance; numerals shorter than four characters without spaces and signs don't count."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDERS[kind]), F.lit(0)))
    if kind == "numeral":
        found = F.filter(found, lambda m: F.length(F.regexp_replace(m, r"[ %.,:]", "")) >= 4)
    return found


def repeated_ngram_bans(ids: Column, n: int) -> Column:
    """Next tokens that would repeat an n-gram of the sequence so far; n >= 2."""

    def bans(ids: Column) -> Column:
        tail = F.slice(ids, F.greatest(F.size(ids) - n + 2, F.lit(1)), n - 1)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ids) - n + 1, F.lit(1))), lambda i: (i + n - 1 <= F.size(ids)) & (F.slice(ids, i, n - 1) == tail))
        return F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.element_at(ids, (i + n - 1).cast("int")))))

    # bound as a variable: an expression within a lambda is worked out again for every element
    return F.element_at(F.transform(F.array(ids), bans), 1)


#: Signs that may close a sentence after its stop, and stops with and without white space after them.
CLOSERS = "\"'”’»)\\]」』）》】"
_ENDS = rf"[.!?…؟۔।॥]+(?<!\w\.\w.)(?<![A-Z][a-z]\.)[{CLOSERS}]*\s+|[。！？｡]+[{CLOSERS}]*\s*"


def split_sentences(line: Column) -> Column:
    """(sentence, white space after it) pairs of a line; they join back to the line.

    The line is taken apart after each stop; then chunks are folded: a sentence closes with a
    chunk once it has a letter, what has none waits for the next one, and the last chunk
    closes whatever is open, with its white space. Null stays null, an empty line is one empty sentence.
    """
    pair = lambda sentence, gap: F.struct(sentence.alias("sentence"), gap.alias("gap"))
    chunks = F.regexp_extract_all(line, F.lit(f"(?Us).*?(?:{_ENDS})|.+\\z"), F.lit(0))
    start = F.struct(F.array().cast("array<struct<sentence:string,gap:string>>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, chunk: Column) -> Column:
        whole = F.concat(state["open"], chunk)
        body = F.regexp_replace(whole, f"[{BLANK}]+$", "")
        closed = F.concat(state["done"], F.array(pair(body, F.substr(whole, F.length(body) + 1))))
        return F.when(body.rlike("\\p{L}"), F.struct(closed.alias("done"), F.lit("").alias("open"))).otherwise(F.struct(state["done"].alias("done"), whole.alias("open")))

    ended = F.aggregate(F.slice(chunks, 1, F.greatest(F.size(chunks) - 1, F.lit(0))), start, step)
    rest = F.concat(ended["open"], F.coalesce(F.try_element_at(chunks, F.lit(-1)), F.lit("")))
    return F.when(line.isNotNull(), F.concat(ended["done"], F.array(pair(rest, F.lit("")))))


#: Scripts without spaces between sentences.
UNSPACED = ("Jpan", "Hans", "Hant", "Thai")


def rejoin(parts: Column, script: Column) -> Column:
    """The line of translated (sentence, gap) parts: an empty gap inside becomes a space unless the script has none; ends are trimmed if there are several."""
    n = F.size(parts)
    joined = F.array_join(
        F.transform(parts, lambda p, i: F.concat(p["sentence"], F.when(i == n - 1, "").when(p["gap"] != "", p["gap"]).when(script.isin(*UNSPACED), "").otherwise(" "))), ""
    )
    return F.when(n > 1, F.regexp_replace(joined, f"[{BLANK}]+$", "")).otherwise(joined)
