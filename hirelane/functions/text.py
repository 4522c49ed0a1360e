"""Text normalisation as Column functions.

Patterns that meet non-English text say (?U) or (?iu): Java's \\s, \\w and case folding are ASCII otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a candidate.
GENERIC_TOKENS = (
    "a about across all an and application applications are as at backed based build built business code "
    "collaborate communication company create created data database deliver design designed developer development "
    "dynamic experience features flow for from full good implement implemented improve in integration is it maintain "
    "modern new of or platform processes product project projects quality real role service services software stable "
    "store strong system systems team teams the to using with work workflow workflows"
).split()

TOKEN = r"([a-z0-9+#.]+)"
_LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


@cache
def _folding(gap: str = "") -> tuple[str, str, list[tuple[str, str]]]:
    """Single letters and their ASCII forms, and letters that fold to several, from the Unicode data.

    gap stands for what is neither ASCII nor a combining mark in a decomposed letter with an ASCII part.
    """
    one, to, many = [], [], []
    for c in range(0x80, 0x30000):
        if 0xD800 <= c < 0xE000 or 0xAC00 <= c <= 0xD7A3:
            continue
        ch = chr(c)
        parts = {"Đ": "D", "đ": "d"}.get(ch) or unicodedata.normalize("NFKD", ch)
        folded = "".join(x if x < "\x80" else "" if unicodedata.category(x)[0] == "M" else gap for x in parts) if any(x < "\x80" for x in parts) else ""
        if len(folded) == 1:
            one.append(ch)
            to.append(folded)
        elif folded:
            many.append((ch, folded))
    return "".join(one), "".join(to), many


def let(c: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold_ascii(c: Column) -> Column:
    """Compatibility-decomposed, accents and every other non-ASCII character dropped; null is empty."""
    return F.regexp_replace(_decomposed(c), r"[^\x00-\x7F]", "")


def _decomposed(c: Column, gap: str = "") -> Column:
    """Letters with an ASCII form in that form, ligatures and others of several letters too."""
    one, to, many = _folding(gap)
    # Letters that fold to several are rare, so texts without any skip the replacements.
    several = lambda t: F.when(t.rlike(_any_of(x for x, _ in many if ord(x) < 0x10000)), _replace_all(t, many)).otherwise(t)
    return let(F.coalesce(c, F.lit("")), lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), let(F.translate(t, one, to), several)).otherwise(t))


def _any_of(letters) -> str:
    """Java pattern of one of many letters beyond ASCII: ranges, since a class of single ones is gone through letter by letter."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, letters)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return r"(?=[^\x00-\x7F])[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def _replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Each letter of a text looked up in a map, for texts that hold such letters."""
    kept = [p for p in pairs if ord(p[0]) < 0x10000]
    table = F.map_from_arrays(F.split(F.lit("".join(a for a, _ in kept)), ""), F.split(F.lit("\t".join(b for _, b in kept)), "\t"))
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")


def fold_match(c: Column) -> Column:
    """Lower case, accents dropped, anything but a-z 0-9 # + . / - one space."""
    return match_words(match_letters(c))


def match_letters(c: Column) -> Column:
    """First half of fold_match: lower case, ASCII only; line ends stay, so the lines of the result are those of the text."""
    return F.lower(ascii_or_space(fold_marks(c)))


def ascii_or_space(c: Column) -> Column:
    """What is not ASCII as spaces; Spark lower-cases ASCII texts many times faster than others."""
    return F.regexp_replace(c, r"[^\x00-\x7F]+", " ")


def match_words(letters: Column) -> Column:
    """Second half of fold_match, also for a line of match_letters."""
    return F.trim(F.regexp_replace(letters, r"[^a-z0-9#+./-]+", " "))


def fold_marks(c: Column) -> Column:
    """Compatibility-decomposed without combining marks; letters without an ASCII form become a space later, not nothing."""
    return let(_decomposed(c, " "), lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.regexp_replace(t, r"\p{M}", "")).otherwise(t))


def norm_key(c: Column, kept: str = "a-z0-9+#./ ") -> Column:
    """Folded, lower, anything outside `kept` a space, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold_ascii(c)), f"[^{kept}]", " "), " +", " "))


def heading_key(c: Column) -> Column:
    return norm_key(F.regexp_replace(c, "&", " and "), "a-z0-9 ")


def normalize_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\f\x0b]+", " "))


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def unify_line_ends(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")


def normalize_text(c: Column, lowercase: bool = True, remove_accents: bool = True, preserve_lines: bool = False) -> Column:
    out = unify_line_ends(c)
    out = fold_ascii(out) if remove_accents else out
    out = F.lower(out) if lowercase else out
    if not preserve_lines:
        return normalize_whitespace(out)
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), normalize_spaces), lambda x: x != ""), "\n")


def split_lines(c: Column) -> Column:
    """Lines with text, stripped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), _LINE_ENDS), strip), lambda x: x != "")


def strip_list_marker(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s*(?:[-*•]|\d+[.)])\s*", ""))


def sanitize(c: Column) -> Column:
    """Raw document text: no NUL, unified line ends, plain spaces and bullets, at most one empty line in a row."""
    out = F.regexp_replace(unify_line_ends(F.regexp_replace(F.coalesce(c, F.lit("")), "\x00", "")), " ", " ")
    out = F.regexp_replace(out, r"(?m)^[ \t]*[\"“”][ \t]+", "- ")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?", "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def job_text_lines(c: Column) -> Column:
    """Text of a job description: unified line ends, no NUL, each line collapsed, empty lines dropped."""
    out = F.regexp_replace(unify_line_ends(c), "\x00", "")
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), normalize_whitespace), lambda x: x != ""), "\n")


def tokens(c: Column) -> Column:
    """Runs of a-z 0-9 + # . of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(1))


def norm(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def is_meaningful(token: Column) -> Column:
    """Longer than two letters and not made of generic words only."""
    n = norm(token)
    generic = F.array(*[F.lit(x) for x in GENERIC_TOKENS])
    return (F.length(n) > 2) & ~F.forall(F.split(n, " "), lambda x: F.array_contains(generic, x))


def is_meaningful_token(token: Column) -> Column:
    """is_meaningful for what is a single token already."""
    return (F.length(token) > 2) & ~token.isin(GENERIC_TOKENS)


def meaningful_tokens(c: Column) -> Column:
    return F.filter(F.array_distinct(tokens(c)), is_meaningful_token)


def compact(c: Column) -> Column:
    """Without spaces and dots, + as #."""
    return F.regexp_replace(F.regexp_replace(c, "[ .]", ""), r"\+", "#")


def first_by_key(items: Column, key) -> Column:
    """Items in order, only the first of each key; empty keys are dropped."""
    keyed = F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("v")))
    keys = F.transform(keyed, lambda p: p["k"])
    kept = F.filter(keyed, lambda p, i: (p["k"] != "") & (F.array_position(keys, p["k"]) == i + 1))
    return F.transform(kept, lambda p: p["v"])
