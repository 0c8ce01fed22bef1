"""Transliterations of an older style, rewritten line by line: marks, letters, numbers and brackets into the present grammar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import atf
from .text import replaced

# Spellings and what they become, in the order in which they are looked for.
SPELLINGS = (
    ("\r", ""), ("\t", " "), ("--", "-"), ("–", "-"), ("{f}", "{munus}"), ("{I}", "{m}"), ("1/2", "½"), ("1/3", "⅓"), ("1/4", "¼"), ("1/5", "⅕"), ("1/6", "⅙"), ("2/3", "⅔"), ("5/6", "⅚"),
)
LETTERS = (
    ("sz", "š"), ("c", "š"), ("s,", "ṣ"), ("ş", "ṣ"), ("t,", "ṭ"), ("ḫ", "h"), ("j", "g"), ("ŋ", "g"), ("g̃", "g"),
    ("C", "Š"), ("SZ", "Š"), ("S,", "Ṣ"), ("Ş", "Ṣ"), ("T,", "Ṭ"), ("Ḫ", "H"), ("J", "G"), ("Ŋ", "G"), ("G̃", "G"), ("'", "ʾ"),
)
#: Accents that stand for an index, as (accented, plain, index); the mark of a logogram that a divider stood for.
ACCENTS = (("áéíúÁÉÍÚ", "aeiuAEIU", "₂"), ("àèìùÀÈÌÙ", "aeiuAEIU", "₃"))
STROKE_SIGN = "DIŠ"
_SUBSCRIPTS, _DIGITS = "₀₁₂₃₄₅₆₇₈₉", "0123456789"
_NAME = rf"[{atf.READING_LETTERS}{atf.LOGOGRAM_LETTERS}xX]"

#: Rules over a text line's content, in order: strings of which all that fits has one, pattern and replacement.
SPACING = (
    (("]",), r"\](?=[⸢⌈]?x)", "] "),
    (("[",), r"(x[⸣⌉]?)\[", "$1 ["),
    (("...]",), r"(\.\.\.\])(?=[⸢⌈])", "$1 "),
    (("[...",), r"([⸣⌉])(?=\[\.\.\.)", "$1 "),
    (("traces",), r"\(\$[^$]*traces[^$]*\$\)", "..."),
)
_SUBSCRIPT = tuple(_SUBSCRIPTS)
BRACKETS = (
    (("($",), r"\(\$[^)]*\)", r"(\$___\$)"),
    # an index behind a bracket goes back to its sign, which is damaged unless the bracket holds that sign alone
    (_SUBSCRIPT, r"\[([A-Za-z]{1,2})([A-Za-z])\]([₀-₉])", "[$1]$2$3"),
    (_SUBSCRIPT, r"\[([^\]]*[^\]\s])\s+([^\]\s])\]([₀-₉])", "[$1] $2$3#"),
    (_SUBSCRIPT, r"\[([^\]]*[^\]\s])([^\]\s])\]([₀-₉])", "[$1]$2$3#"),
    (_SUBSCRIPT, r"\[\s*([^\]\s])\]([₀-₉])", "$1$2# []"),
    (_SUBSCRIPT, r"([A-Za-z]+)([A-Za-z])\[\s*([₀-₉])\s*([^\]]*?)\s*\]", "$1[$2$3 $4]"),
    (_SUBSCRIPT, r"(?<![A-Za-z])([A-Za-z])\[\s*([₀-₉])\s*([^\]]*?)\s*\]", "$1$2# [$3]"),
    # marks of doubt go within, joiners without
    (("?", "!"), r"([\]⸣⌉])([?!]+)", "$2$1"),
    ((")?", ")!"), r"\(([^)]*)\)([?!]+)", "$2($1)"),
    ((".", "-"), r"(?<![.\-])\s?([.\-])([\]⸣⌉])", "$2$1"),
    ((".",), r"([\[⸢⌈]) ?\.(?![.\-])", ".$1"),
    (("$",), rf"\$(?=[{atf.LOGOGRAM_LETTERS}])", ""),
    (("*",), r"(?<![^\s\[\]().⸢⌈<\-])\*", STROKE_SIGN),
    ((":", ";", "/"), r"([\[(<⸢⌈])([:;/])([\])>⸣⌉])", "$1 $2 $3"),
    (("~",), r"~(?=[a-zš0-9])", "@"),
)


def _rules(text: Column, rules: tuple[tuple[Sequence[str], str, str], ...]) -> Column:
    for held, pattern, by in rules:
        text = replaced(text, held, pattern, by)
    return text


def underscored(text: Column) -> Column:
    """What stands between two underscores in capitals, its hyphens as dots; a lone underscore stays."""
    parts = F.split(text, "_")
    closed = F.size(parts) - 1
    shown = F.transform(parts, lambda p, i: F.when((i % 2 == 1) & (i < closed), F.replace(F.upper(p), F.lit("-"), F.lit("."))).when((i % 2 == 1) & (i == closed), F.concat(F.lit("_"), p)).otherwise(p))
    return F.array_join(shown, "")


def lower_in_braces(text: Column) -> Column:
    """What stands in braces in small letters, but for what stands there in parentheses."""
    within = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(r"(\([^)]*\)|[^(]+|\()"), F.lit(1)), lambda x: F.when(F.startswith(x, F.lit("(")), x).otherwise(F.lower(x))), "")
    parts = F.regexp_extract_all(text, F.lit(r"(\{[^}]*\}|[^{]+|\{)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\{.*\}$"), within(p)).otherwise(p)), "")


def indexed(text: Column) -> Column:
    """Accents and digits behind a sign's letters as its index."""
    name, marked = _NAME[1:-1], "".join(a for a, _, _ in ACCENTS)
    bare_letter = f"[{''.join(c for c in name if c not in marked)}]"
    # what stays as it is makes one piece up to the next shift or sign with an accent or digits; ASCII first, since a class tries its other letters one by one
    near = "".join(c for c in name if c < "\x7f")
    between = "".join(rf"\x{i:02x}" for i in range(128) if chr(i) not in near + "%")
    kept = rf"[{between}]++|[{near}]++(?=[\x00-\x2f\x3a-\x7f]|\z)|[^%{name}]++|{bare_letter}++(?![{marked}0-9])"
    pieces = F.regexp_extract_all(text, F.lit(rf"(%\w+|(?:{kept})++|{_NAME}+[0-9]*|.)"), F.lit(1))
    changes = f"^(?:{bare_letter}*+[{marked}]{_NAME}*+[0-9]*+|{bare_letter}++[0-9]++)$"

    def plain(p: Column) -> Column:
        bare = p
        for accented, letters, _ in ACCENTS:
            bare = F.translate(bare, accented, letters)
        index = [F.when(p.rlike(f"[{accented}]"), F.lit(i)) for accented, _, i in ACCENTS]
        digits = F.translate(F.regexp_extract(p, "([0-9]*)$", 1), _DIGITS, _SUBSCRIPTS)
        return F.concat(F.regexp_extract(bare, "^([^0-9]*)", 1), F.coalesce(*index, F.lit("")), digits)

    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(changes), plain(p)).otherwise(p)), "")


def damaged(text: Column) -> Column:
    """Signs in half brackets with the mark of damage, the half brackets off."""
    sign = rf"{_NAME}+{atf._INDEX}{atf._MODIFIERS}{atf._FLAGS}|\d+{atf._MODIFIERS}{atf._FLAGS}|[{atf.FRACTIONS}]{atf._FLAGS}"
    # a half bracket ends what the one before it began, so each stretch is told by the one in front of it
    stretches = F.regexp_extract_all(text, F.lit("([⸢⌈⸣⌉][^⸢⌈⸣⌉]*|[^⸢⌈⸣⌉]+)"), F.lit(1))
    inner = lambda p: F.substring(p, F.lit(2), F.length(p))
    shown = F.transform(stretches, lambda p: F.when(p.rlike("^[⸢⌈]"), F.regexp_replace(inner(p), sign, "$0#")).when(p.rlike("^[⸣⌉]"), inner(p)).otherwise(p))
    return F.when(text.rlike("[⸢⌈⸣⌉]"), F.array_join(shown, "")).otherwise(text)


def spelt(text: Column) -> Column:
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = _rules(text, SPACING)
    for old, new in LETTERS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def bracketed(text: Column) -> Column:
    return _rules(text, BRACKETS)


def closed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


#: What is done to the content of a text line, one after the other.
STEPS = (spelt, underscored, lower_in_braces, bracketed, indexed, damaged, closed)
#: What a line of the older style is: a number and a content with a point and a space between them, or else its first character says.
TEXT_LINE = r"^([A-Za-z]?\d+\S*?)\. (.*)$"


def number(text: Column) -> Column:
    """A line number with one prime at most: of several, all but one become a letter in front (A for two, B for three)."""
    primes = F.regexp_extract(text, r"^[A-Za-z]?\d+(['′’ʾ]*)", 1)
    plain = F.regexp_replace(text, "['′’ʾ]+", "'")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(primes) > 1, F.concat(F.substring(F.lit(letters), F.length(primes) - 1, F.lit(1)), F.lit("+"), plain)).otherwise(plain)


def dollar_line(line: Column) -> Column:
    """A state, ruling or seal without parentheses, anything else in one pair of them."""
    inner = F.trim(F.substring(line, F.lit(2), F.length(line)))
    for _ in range(4):
        inner = F.trim(F.regexp_replace(inner, r"^\(((?:[^()]++|\([^()]*\))*+|\(.*\))\)$", "$1"))
    inner = F.regexp_replace(F.regexp_replace(inner, r"^ruling", "single ruling"), "^rest broken", "rest of side broken")
    plain = F.concat(F.lit("$ "), inner)
    return F.when(atf.line_type(plain).isin("StateDollarLine", "RulingDollarLine", "SealDollarLine"), plain).otherwise(F.concat(F.lit("$ ("), inner, F.lit(")")))


def note_line(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("# note:")), F.replace(line, F.lit("# note:"), F.lit("#note:"))).when(F.startswith(line, F.lit("# ")), F.concat(F.lit("#note:"), F.substring(line, F.lit(2), F.length(line)))).otherwise(line)


def other_line(text: Column) -> Column:
    """A line without transliterated text, rewritten."""
    return F.when(F.startswith(text, F.lit("$")), dollar_line(text)).when(F.startswith(text, F.lit("#")), note_line(text)).otherwise(text)
