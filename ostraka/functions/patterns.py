"""Query strings compiled to regular expressions: sign sequences with wildcards, and text with letter classes."""

from __future__ import annotations

import re

#: Letters that a query may spell in several ways.
LETTER_CLASSES = (
    "sšṣśσSŠṢŚΣ", "sßS", "tṭτTṬΤ", "dᵈD", "hḫḥHḪḤʕʾʿ", "cčçćCČÇĆ", "gĝğGĜĞ", "kκKΚ", "lłLŁ", "nńňνNŃŇΝ", "rřρRŘΡ", "yýÿYÝŸ", "xₓX",
    "aāâáàäαAĀÂÁÀÄΑ", "eēêéèEĒÊÉÈ", "iīîíìïıιIĪÎÍÌÏΙ", "uūûúùüůUŪÛÚÙÜŮ", "oòóôöøōőοOÒÓÔÖØŌŐΟ",
    "0₀⁰øØ", "1₁¹", "2₂²", "3₃³", "4₄⁴", "5₅⁵", "6₆⁶", "7₇⁷", "8₈⁸", "9₉⁹", "+₊",
)


def _sign(name: str, java: bool) -> str:
    body = "(?:" + "|".join(map(re.escape, name[1:-1].split("|"))) + ")" if name.startswith("[") and name.endswith("]") else re.escape(name)
    return rf"(?:[^\s/]+/)*{body}(?![^\s/])" if java else rf"(?:[^\s/]+/)*{body}(?:/[^\s/]+)*"


def sign_line(query: str) -> str:
    """A pattern (java.util.regex) for one line of signs: `?` is any one sign, `*` any run of signs, `[a|b]` alternatives; a sign may be one of the variants of a place (`a/b`)."""
    out, gap = "", ""
    for name in query.split():
        if name == "*":
            gap = r"(?:\S+ )*"
        elif name == "?":
            out += (" " if out else "") + gap + r"\S+"
            gap = ""
        else:
            out += (" " if out else "") + gap + _sign(name, True)
            gap = ""
    return r"(?<![^|\s])" + out


def sign_query(query: str) -> list[str]:
    """The patterns of consecutive lines."""
    return [sign_line(line) for line in query.split("\n")]


def collated(query: str) -> str:
    """A case-blind pattern for text: `?` one character, `*` a run without spaces, letters of a class for one another (of two classes the first); a quoted query is exact."""
    if len(query) > 1 and query[0] == query[-1] == '"':
        return "^" + re.escape(query[1:-1]) + "$"
    out = ""
    for c in query:
        group = next((g for g in LETTER_CLASSES if c in g), "")
        out += r"\S" if c == "?" else r"\S*" if c == "*" else f"[{group}]" if group else re.escape(c)
    return "(?i)" + out


def page_number(page: str) -> str:
    """A page number that no digit adjoins; the page is used as it is, not escaped."""
    return rf"(^|[^\d]){page}([^\d]|$)"
