"""Sort keys: museum numbers, Akkadian words, natural order, Roman numerals, ignoring case and accents."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

#: Order of museum prefixes, the class of digits and that of all others.
PREFIX_ORDER = {"K": 1, "Sm": 2, "DT": 3, "Rm": 4, "Rm-II": 5, "BM": 7, "IM": 8, "ISACM-A": 9, "HS": 10, "CBS": 11, "UM": 12, "N": 13, "NBC": 14, "YBC": 15}
NUMERIC_CLASS, OTHER_CLASS = 6, 16
#: The alphabet in its order.
AKKADIAN = "-'abdeghḫiklmnpqrsṣštṭuwyz"
_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def museum_key(prefix: Column, number: Column, suffix: Column) -> Column:
    """Struct of seven parts that sorts as museum numbers do: class of the prefix, then each part as a number, or behind all numbers as text."""
    rank = F.when(prefix.rlike(r"^\d+$"), NUMERIC_CLASS)
    for name, place in PREFIX_ORDER.items():
        rank = rank.when(prefix == name, place)
    whole = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(2**63 - 1))
    return F.struct(rank.otherwise(OTHER_CLASS).alias("c"), whole(prefix).alias("p"), prefix.alias("ps"), whole(number).alias("n"), number.alias("ns"), whole(suffix).alias("s"), suffix.alias("ss"))


def natural_key(text: Column) -> Column:
    """The text with each run of digits padded to twelve, so that strings compare as people count."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def alphabet_key(text: Column, alphabet: str = AKKADIAN) -> Column:
    """array<int>: places of the letters in an alphabet (unknown ones last), for arrays compare element by element."""
    return F.transform(F.split(F.lower(text), ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(alphabet), c), F.lit(0)), F.lit(1000)))


#: Vowels that sort as their plain letter, by the sign on them; places of a space and of letters of no place.
MACRONS, CIRCUMFLEXES = ("āēīūĀĒĪŪ", "aeiuAEIU"), ("âêîûÂÊÎÛ", "aeiuAEIU")
SPACE_PLACE, NO_PLACE = -1, 10000


def akkadian_key(text: Column) -> Column:
    """array<int> that sorts words of a dictionary: first by letters, capitals before small ones and a space before all, then by the signs on vowels (none, macron,
    circumflex), then by the Roman number that closes the word, as a number (none: 0)."""
    parts = F.regexp_extract(text, r"^(.*) ([^ ]*)$", 2)
    number = F.when(F.contains(text, F.lit(" ")), roman(F.nullif(parts, F.lit(""))))
    word = F.when(number.isNotNull(), F.regexp_extract(text, r"^(.*) ([^ ]*)$", 1)).otherwise(text)
    # capital and small letter of each place in turn; a mark without case has the second place only
    both = "".join((c.upper() if c.upper() != c else "\u0001") + c for c in AKKADIAN)
    plain_vowels = F.translate(word, MACRONS[0] + CIRCUMFLEXES[0], MACRONS[1] + CIRCUMFLEXES[1])
    letters = F.transform(F.split(plain_vowels, ""), lambda c: F.when(c == " ", SPACE_PLACE).when(F.instr(F.lit(both), c) > 0, F.instr(F.lit(both), c) - 1).otherwise(NO_PLACE))
    signs = F.transform(F.split(word, ""), lambda c: F.when(F.instr(F.lit(MACRONS[0]), c) > 0, 1).when(F.instr(F.lit(CIRCUMFLEXES[0]), c) > 0, 2).otherwise(0))
    last = F.array(F.coalesce(number, F.lit(0)))
    return F.when(word == "", last).otherwise(F.concat(letters, signs, last))


def roman(text: Column) -> Column:
    """The value of a well-formed Roman numeral, in either case; null if it is none (IIII, VX and IC are none)."""
    return F.when(F.upper(text).rlike(r"^(?=.)M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), roman_loose(text))


def roman_loose(text: Column) -> Column:
    """The value of any run of Roman letters: a letter with a greater one anywhere behind it is taken off. Null if other letters are there, or if nothing above 0 is left."""
    values = F.transform(F.split(F.upper(text), ""), lambda c: F.create_map(*[F.lit(x) for kv in _ROMAN.items() for x in kv])[c])
    behind = lambda i: F.coalesce(F.array_max(F.slice(values, i + 2, F.size(values))), F.lit(0))
    total = F.aggregate(F.transform(values, lambda v, i: F.when(behind(i) > v, -v).otherwise(v)), F.lit(0), lambda a, x: a + x)
    return F.when(F.upper(text).rlike("^[IVXLCDM]+$") & (total > 0), total)


def plain(text: Column) -> Column:
    """Without case and the accents of Latin letters; native, for equality and order."""
    accented, bare = [], []
    for code in [*range(0xC0, 0x180), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and re.match("[A-Za-z]", base[0]):
            accented.append(chr(code))
            bare.append(base[0])
    return F.lower(F.translate(text, "".join(accented), "".join(bare)))
