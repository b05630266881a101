"""Text functions as Column expressions: cleaning, tokens, ratios, hashes and query variants. All run inside the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, written out: regex classes of engines disagree about it.
SPACE = "\\x{9}-\\x{d}\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_SPACES = "".join(map(chr, (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _class(ranges: str) -> str:
    """Characters and ranges, in hex, as they stand in a class of a pattern."""
    return "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in ranges.split())


#: Letters and digits of Unicode 14 and 15, which the patterns of the JVM (17: Unicode 13) do not know as such.
LATER = _class(
    "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a "
    "1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba "
    "10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f "
    "13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1df00-1df1e 1df25-1df2a "
    "1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 "
    "31350-323af"
)
#: Likewise marks, other numbers, punctuation and symbols.
LATER_SIGNS = _class(
    "61d 888 898-89f 8ca-8d2 c3c cf3 ece 1715 180f 1ac1-1ace 1b7d-1b7e 1dfa 20c0 2e53-2e5d fbc2 fd40-fd4f fdcf fdfe-fdff 10efd-10eff "
    "10f82-10f89 11070 11073-11074 110c2 11241 116b9 11b00-11b09 11f00-11f01 11f03 11f34-11f3a 11f3e-11f4f 12ff1-12ff2 13440 "
    "13447-13455 1cf00-1cf2d 1cf30-1cf46 1cf50-1cfc3 1d1e9-1d1ea 1d2c0-1d2d3 1e08f 1e2ae 1e4ec-1e4ef 1f6dc-1f6df 1f774-1f776 "
    "1f77b-1f77f 1f7d9 1f7f0 1f979 1f9cc 1fa75-1fa77 1fa7b-1fa7c 1fa87-1fa88 1faa9-1faaf 1fab7-1fabd 1fabf 1fac3-1fac5 1face-1facf "
    "1fad7-1fadb 1fae0-1fae8 1faf0-1faf8"
)
#: ASCII white space as text cleaning collapses it; no vertical tab.
PLAIN = "\\t\\n\\f\\r "
#: Invisible characters that cleaning drops.
INVISIBLE = "[\\x{200b}\\x{200c}\\x{200d}\\x{feff}\\x{ad}]"
#: References to figures and tables. White space is PLAIN, for that of the JVM's patterns has the vertical tab; nor do these fold É.
VISUAL = tuple(
    p.replace(r"\s", f"[{PLAIN}]")
    for p in (
        r"(?i)(voir|cf\.?|see|refer\s+to)\s+(la\s+)?(figure|fig\.?|tableau|table|sch[eéÉ]ma|schema|image|illustration|graphique|graph|diagramme|diagram)\s*\d",
        r"(?i)(figure|fig\.?|tableau|table)\s+\d+",
    )
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"[{PLAIN}]+", " ")


def clean(c: Column | str) -> Column:
    """Without invisible characters, runs of plain white space as one space, trimmed."""
    return trim(collapse(F.regexp_replace(_col(c), INVISIBLE, "")))


def normalise_for_hash(c: Column | str) -> Column:
    """Cleaned, lower case, letters, digits and white space only (those of Unicode 15), collapsed and trimmed."""
    # each character has one lower case: lower() makes a sigma at the end of a word another letter, and knows two later capitals
    x = clean(c)
    for capital, small in (("\u03a3", "\u03c3"), ("\ua7cb", ""), ("\ua7dc", "")):
        x = F.replace(x, F.lit(capital), F.lit(small))
    kept = F.regexp_replace(F.lower(x), f"[\\P{{L}}&&\\P{{Nd}}&&[^{SPACE}]&&[^{LATER}]]", "")  # in steps: of one class, all ranges are asked about each character
    return trim(collapse(kept))


def normalise_space(c: Column | str) -> Column:
    """Runs of Unicode white space as one space, trimmed."""
    return trim(F.regexp_replace(_col(c), f"[{SPACE}]+", " "))


def _spaced(c: Column | str) -> Column:
    """Every kind of white space as a plain space, which is far quicker to look for."""
    return F.translate(_col(c), _SPACES, " " * len(_SPACES))


def tokens(c: Column | str) -> Column:
    """Array of the runs of other than Unicode white space."""
    return F.filter(F.split(_spaced(c), " "), lambda x: x != "")


def token_count(c: Column | str) -> Column:
    return F.regexp_count(_spaced(c), F.lit("[^ ]+")).cast("long")


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), trim), lambda x: x != "")


def paragraphs(c: Column | str) -> Column:
    """Parts between lines that are empty but for white space."""
    return _parts(_col(c), f"\\n[{PLAIN}]*\\n")


def blocks(c: Column | str) -> Column:
    """Parts between double line feeds."""
    return _parts(_col(c), "\\n\\n")


def estimate_tokens(c: Column | str) -> Column:
    """Mean of a quarter of the characters and four thirds of the words, each step rounded down."""
    by_words = F.floor(token_count(c) * 4 / 3)
    return F.floor((F.floor(F.char_length(_col(c)) / 4) + by_words) / 2).cast("long")


def first_line(c: Column | str, most_bytes: int = 200) -> Column:
    """Up to the first line feed, trimmed, cut to that many bytes; what is left of a character that is cut through goes."""
    line = trim(F.substring_index(_col(c), "\n", 1))
    cut = F.regexp_replace(F.decode(F.substring(F.encode(line, "UTF-8"), 1, most_bytes), "ISO-8859-1"), "[\\x{c0}-\\x{ff}][\\x{80}-\\x{bf}]{0,2}$", "")
    whole = F.length(F.decode(F.substring(F.encode(line, "UTF-8"), most_bytes + 1, 1), "ISO-8859-1").cast("string")) > 0
    broken = whole & F.decode(F.substring(F.encode(line, "UTF-8"), most_bytes + 1, 1), "ISO-8859-1").rlike("[\\x{80}-\\x{bf}]")
    exact = F.decode(F.substring(F.encode(line, "UTF-8"), 1, most_bytes), "ISO-8859-1")
    return F.when(F.octet_length(line) <= most_bytes, line).otherwise(F.decode(F.encode(F.when(broken, cut).otherwise(exact), "ISO-8859-1"), "UTF-8"))


def printable_ratio(c: Column | str) -> Column:
    """Printable characters (and line feed, return, tab) among all; 1 for an empty text. Private-use and replacement characters are not printable, those of Unicode 14 and 15 are."""
    total = F.char_length(_col(c))
    known = "[\\p{L}\\p{M}\\p{N}\\p{P}\\p{S} \\n\\r\\t&&[^\\x{fffd}\\x{e000}-\\x{f8ff}]]"
    good = F.regexp_count(_col(c), F.lit(f"{known}|[{LATER}{LATER_SIGNS}]"))
    return F.when(total == 0, F.lit(1.0)).otherwise(good / F.greatest(total, F.lit(1)))


def wordlike_ratio(c: Column | str) -> Column:
    """Tokens of 2 to 15 characters among all; 0 without tokens."""

    def of(words: Column) -> Column:
        good = F.size(F.filter(words, lambda w: F.char_length(w).between(2, 15)))
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(good / F.greatest(F.size(words), F.lit(1)))

    # the words are an element of an array, so that they are split once
    return F.get(F.transform(F.array(tokens(c)), of), F.lit(0))


def visual_references(c: Column | str) -> Column:
    """Matches of both patterns; a reference that both match counts twice."""
    a, b = (F.regexp_count(_col(c), F.lit(p)) for p in VISUAL)
    return (a + b).cast("long")


def needs_ocr(chars_per_page: Column, has_images: Column, printable: Column) -> Column:
    return ((chars_per_page < 50) & has_images) | (printable < 0.85)


def has_visual_gap(references: Column, has_images: Column) -> Column:
    return (references > 0) & has_images


def sha256(c: Column | str) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(_col(c).cast("string"), 256)


def feed_key(guid: Column | str, link: Column | str) -> Column:
    return sha256(F.when(F.coalesce(_col(guid), F.lit("")) != "", _col(guid)).otherwise(F.coalesce(_col(link), F.lit(""))))


def item_key(url: Column | str, title: Column | str, given: Column | str | None = None) -> Column:
    """A given hash, else the hash of url|title."""
    own = sha256(F.concat(F.coalesce(_col(url), F.lit("")), F.lit("|"), F.coalesce(_col(title), F.lit(""))))
    return own if given is None else F.when(F.coalesce(_col(given), F.lit("")) != "", _col(given)).otherwise(own)


def query_variants(c: Column | str) -> Column:
    """The query as a phrase and, of more than two words, its first and second half."""
    words = F.filter(F.split(_col(c), "[ \\t\\n]+"), lambda w: w != "")
    n, half = F.size(words), F.floor(F.size(words) / 2).cast("int")
    phrase = F.array(F.concat(F.lit('"'), _col(c), F.lit('"')))
    halves = F.array(F.array_join(F.slice(words, 1, F.greatest(half, F.lit(1))), " "), F.array_join(F.slice(words, half + 1, F.greatest(n - half, F.lit(1))), " "))
    return F.when(F.octet_length(_col(c)) == 0, F.array().cast("array<string>")).when(n > 2, F.concat(phrase, halves)).otherwise(phrase)


def log_scale(n: Column | str) -> Column:
    """1 and one more for each halving (rounded down) until 100 or less is left; 0 for nothing."""
    left = _col(n).cast("long")
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0), lambda a, k: a + F.when(F.floor(left / F.pow(F.lit(2.0), k)) > 100, 1).otherwise(0))
    return F.when(left <= 0, F.lit(0.0)).otherwise(1.0 + steps)


def yaml_value(c: Column | str) -> Column:
    """Quoted, with quotes and backslashes escaped, when a character is special in YAML."""
    x = _col(c)
    quoted = F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.when(x.rlike("[:#'\"{}\\[\\],&*?|\\-<>=!%@`\\n]"), quoted).otherwise(x)


def glob_regex(pattern: str) -> str:
    """The regular expression of a GLOB pattern: * any run, ? one character, [..] a class, [^..] its complement."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = i + 1
            if j < len(pattern) and pattern[j] == "^":
                j += 1
            j = pattern.find("]", j + 1)
            if j < 0:
                return "(?!)"  # an open class matches nothing
            body = pattern[i + 1 : j]
            negated = body.startswith("^")
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&&", "&\\&").replace("^", "\\^")
            out += f"[{'^' * negated}{body}]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def glob_to_regex(pattern: Column | str) -> Column:
    """glob_regex of a column of patterns (of rules, which are few), for a join to match by; an open class matches nothing."""

    @F.pandas_udf("string")
    def run(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: None if p is None else glob_regex(p))

    return run(_col(pattern))


def percent(c: Column | str) -> Column:
    """A share as a whole percentage, halves rounded to even."""
    return F.concat(F.bround(_col(c) * 100, 0).cast("long").cast("string"), F.lit("%"))


def day(ms: Column | str) -> Column:
    """UTC date of epoch milliseconds."""
    return F.date_format(F.timestamp_millis(_col(ms)), "yyyy-MM-dd")
