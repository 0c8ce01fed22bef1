"""Transliterations: the grammar of lines, words and signs as patterns, and what they capture as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters of readings, of logograms, of normalized Akkadian and of Greek; numbers, marks behind a sign, operators.
READING_LETTERS = "aāâbdeēêfgĝhiīîyklmnpqrsṣštṭuūûwzḫʾ" + "'áàéèíìúù"
LOGOGRAM_LETTERS = "AĀÂBDEĒÊGĜHIĪÎYKLMNPQRSṢŠTṬUŪÛWZḪʾ" + "ÁÀÉÈÍÌÚÙ"
AKKADIAN_LETTERS = "ʾABDEGHIKLMNPSTUYZabcdefghiklmnpqrstuwyzÉâêîûāĒēīŠšŚśūṣṭ₄"
GREEK_LETTERS = "ΑαΒβΓγΔδΕεΖζΗηΘθΙιΚκΛλΜμΝνΞξΟοΠπΡρΣσςΤτΥυΦφΧχΨψΩω"
FRACTIONS = "½⅓¼⅕⅙⅔⅚"
FLAGS = "#?!*°"
MODIFIERS = ("aš", "c", "f", "g", "s", "t", "n", "z", "k", "r", "h", "v")
# Languages by shift (all others: unknown), those whose words have lemmas, shifts to normalized and to Greek text.
LANGUAGES = {"AKKADIAN": ("ma", "mb", "na", "nb", "lb", "sb", "a", "akk", "eakk", "oakk", "ur3akk", "oa", "ob", "n", "akkgrc"), "SUMERIAN": ("sux", "suxgrc"), "EMESAL": ("es", "e"), "GREEK": ("grc",), "HITTITE": ("hit",)}
LEMMATIZABLE = ("UNKNOWN", "AKKADIAN", "SUMERIAN", "EMESAL")
NORMALIZED, GREEK_SHIFTS = "%n", ("%grc", "%akkgrc", "%suxgrc")
# Enclosures as (name, opening, closing), and what each may not stand in (itself never).
ENCLOSURES = (("ACCIDENTAL_OMISSION", "<", ">"), ("INTENTIONAL_OMISSION", "<(", ")>"), ("REMOVAL", "<<", ">>"), ("BROKEN_AWAY", "[", "]"), ("PERHAPS_BROKEN_AWAY", "(", ")"), ("DOCUMENT_ORIENTED_GLOSS", "{(", ")}"), ("PERHAPS", "", ""), ("EMENDATION", "", ""))
NOT_WITHIN = {"ACCIDENTAL_OMISSION": ("INTENTIONAL_OMISSION",), "INTENTIONAL_OMISSION": ("ACCIDENTAL_OMISSION",), "BROKEN_AWAY": ("PERHAPS_BROKEN_AWAY", "PERHAPS"), "PERHAPS_BROKEN_AWAY": ("PERHAPS", "ACCIDENTAL_OMISSION", "INTENTIONAL_OMISSION"), "PERHAPS": ("PERHAPS_BROKEN_AWAY", "BROKEN_AWAY", "ACCIDENTAL_OMISSION", "INTENTIONAL_OMISSION")}

#: A word of more characters is told as a problem: patterns over alternatives need stack for each sign.
LONGEST_WORD = 1000


def one_of(*patterns: str) -> str:
    return f"(?:{'|'.join(patterns)})"


# Signs

_V, _L, _NUMBER = f"[{READING_LETTERS}]", f"[{LOGOGRAM_LETTERS}]", one_of(r"\d+", f"[{FRACTIONS}]")
#: Runs of letters are possessive: no letter follows one, and what is no word would be tried again for each letter that a run gives back.
_VS, _LS = f"{_V}++", f"{_L}++"
_FLAGS, _MODIFIERS = f"[{FLAGS}]*", rf"(?:[@~]{one_of(*MODIFIERS, '[0-9]+')})*"
_INDEX = "(?:₀|[₁-₉][₀-₉]*|[1-9][0-9]*|ₓ)?"
_GRAPHEME = one_of(_VS, _LS, rf"{_NUMBER}\d*") + _INDEX + _MODIFIERS + _FLAGS
_CHOICE = f"{_GRAPHEME}(?:/{_GRAPHEME})*"
_GROUP = one_of(rf"\({_CHOICE}(?:[×%&+.]{_CHOICE})*\)", _CHOICE)
COMPOUND = rf"\|{_GROUP}(?:[×%&+.]{_GROUP})*\|"
_SIGN = rf"(?:\({one_of(COMPOUND, _GRAPHEME)}\))?"
READING = rf"{_VS}(?:[\[\]]{_VS})*{_INDEX}{_MODIFIERS}{_FLAGS}{_SIGN}"
JOINER = "[-+.:;,]"
_SURROGATE = rf"<\({READING}(?:{JOINER}{READING})*\)>"
LOGOGRAM = rf"{_LS}(?:[\[\]]{_LS})*{_INDEX}{_MODIFIERS}{_FLAGS}{one_of(_SURROGATE, _SIGN)}"
NUMBER = rf"{_NUMBER}(?:[\[\]]\d+)*{_MODIFIERS}{_FLAGS}{_SIGN}"
UNKNOWN = f"[Xx]{_FLAGS}"
DOTS, FEET = r"\.\.\.", f"•{_FLAGS}"
_VARIANT_PART = one_of(UNKNOWN, COMPOUND, READING, LOGOGRAM, NUMBER)
VARIANT = f"{_VARIANT_PART}(?:/{_VARIANT_PART})+"
VALUE = one_of(f"{_VARIANT_PART}(?:/{_VARIANT_PART})*", DOTS, FEET)

# Words

OPENING, CLOSING = one_of(r"<\(", "<<", "<", r"\[", r"\("), one_of(r"\)>", ">>", ">", r"\]", r"\)")
ENCLOSURE = one_of(r"<\(", r"\)>", "<<", ">>", r"\{\(", r"\)\}", "[<>()]", r"[\[\]]")
_STRICT = f";?{CLOSING}*{JOINER}{OPENING}*"
_LOOSE = one_of(_STRICT, f";?{CLOSING}+{JOINER}?{OPENING}*", f";?{OPENING}+")
_BODY = rf"{one_of(r'<[(]', '<<', '<')}*{VALUE}(?:{_STRICT}{VALUE})*{one_of(r'[)]>', '>>', '>')}*"
GLOSS = one_of(r"\{\{" + _BODY + r"\}\}", r"\{\+?" + _BODY + r"\}")
_PARTS = f"{one_of(VALUE, GLOSS)}(?:{_STRICT}{VALUE}|(?:{_LOOSE})?{GLOSS}|(?<=[}}])(?:{_LOOSE})?{VALUE})*"
_INLINE_ERASURE = rf"°(?:{_PARTS})?\\(?:{_PARTS})?°"
WORD = rf"{OPENING}*(?:{_INLINE_ERASURE}(?:{_LOOSE})?)*{_PARTS}(?:(?:{_LOOSE})?{_INLINE_ERASURE}(?:(?:{_LOOSE})?{_PARTS})?)*{CLOSING}*"
#: A word in which nothing was erased: a sixth of the pattern.
_UNERASED_WORD = f"{OPENING}*{_PARTS}{CLOSING}*"
LONE_DETERMINATIVE = rf"{OPENING}*\{{\+?{_BODY}\}}{CLOSING}*"
_DIVIDER_MARK = one_of(":'", ':"', r":\.", "::", ":", ";", "/")
DIVIDER = f"{_DIVIDER_MARK}{_MODIFIERS}{_FLAGS}"
DIVIDER_VARIANT = one_of(f"{DIVIDER}/{one_of(DIVIDER, _VARIANT_PART)}", f"{_VARIANT_PART}/{DIVIDER}")
_STRING = one_of(f"[{AKKADIAN_LETTERS}]+", DOTS)
AKKADIAN_WORD = rf"(?=.*[{AKKADIAN_LETTERS}])[\[(<]*{_STRING}(?:(?:[\[\]()<>]+-?|-[\[\]()<>]*)?{_STRING})*[#?!]{{0,3}}[\])>]*"
LACUNA = rf"[\[(<]*{DOTS}[\])>]*"
GREEK_WORD = rf"(?:{OPENING}|{CLOSING})*(?:{one_of(f'[{GREEK_LETTERS}]{_FLAGS}', UNKNOWN, DOTS)}(?:{OPENING}|{CLOSING})*)+"
#: Signs, glosses, joiners and enclosures of a word, one after the other.
PIECE = one_of(VARIANT, DOTS, UNKNOWN + rf"(?![{READING_LETTERS}{LOGOGRAM_LETTERS}])", COMPOUND, READING, LOGOGRAM, NUMBER, FEET, r"\{\{", r"\}\}", r"\{\+", r"[{}]", ENCLOSURE, JOINER, r"[°\\]", ".")


#: Readings and hyphens alone: most words, told without the rest of the grammar.
SIMPLE_WORD = f"^{_VS}[₀-₉]*+(?:-{_VS}[₀-₉]*+)*+$"
_USUAL_SIGN = rf"(?:{_VS}[₀-₉]*+|[xX])[#?!*]*+"
_USUAL_SIGNS = rf"{_USUAL_SIGN}(?:-{_USUAL_SIGN})*+"
#: Such words with marks, glosses around them and brackets. A matcher of WORD has a slot for each of its many loops, so to begin with it takes longer than to match: it comes last.
USUAL_WORD = rf"^(?:<\(|<<|[<\[(])?+(?:\{{{_USUAL_SIGNS}\}})*+{_USUAL_SIGNS}(?:\{{{_USUAL_SIGNS}\}})*+(?:\)>|>>|[>\])])?+$"
#: What no sign has: letters without a reading (c and v are modifiers, too), an x next to a letter.
NO_SIGN = r"[joJO]|(?<![@~])[cvCV]|(?<=[a-zA-Z])[xX]|[xX](?=[a-zA-Z])"
_USUAL_READING = f"^{_VS}[₀-₉]*+$"
_USUAL_PIECE = rf"{_USUAL_SIGN}|<\(|\)>|<<|>>|."


def whole(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def seldom(text: Column, pattern: str) -> Column:
    """Whether all of a text fits a long pattern that few texts are tried on: read in a lambda it is compiled by the tasks that come to it, not written into the code of each."""
    return F.exists(F.array(text), lambda t: t.rlike(whole(pattern)))


def pieces(word: Column) -> Column:
    """array<string>: signs, glosses, joiners and enclosures of a word, one after the other (see PIECE)."""
    return F.when(word.rlike(USUAL_WORD), F.regexp_extract_all(word, F.lit(_USUAL_PIECE), F.lit(0))).otherwise(F.regexp_extract_all(word, F.lit(PIECE), F.lit(0)))


def piece_type(piece: Column) -> Column:
    """What one piece of a word is."""
    kinds = (("Reading", READING), ("Logogram", LOGOGRAM), ("UnclearSign", f"x{_FLAGS}"), ("UnknownNumberOfSigns", DOTS), ("UnidentifiedSign", f"X{_FLAGS}"), ("CompoundGrapheme", COMPOUND), ("Number", NUMBER), ("Variant", VARIANT), ("EgyptianMetricalFeetSeparator", FEET))
    marks = (("LinguisticGloss", ("{{", "}}")), ("PhoneticGloss", ("{+",)), ("Determinative", ("{", "}")), ("Joiner", tuple("-+.:;,")), ("Erasure", ("°", "\\")), *((camel(name), (a, b)) for name, a, b in ENCLOSURES[:6]))
    return F.coalesce(F.when(piece.rlike(_USUAL_READING), "Reading"), *[F.when(piece.isin(*texts), name) for name, texts in marks], *[F.when(piece.rlike(whole(pattern)), name) for name, pattern in kinds], F.lit("Invalid"))


def camel(name: str) -> str:
    return "".join(w.capitalize() for w in name.split("_"))


def sub_index(piece: Column) -> Column:
    """The sign's index: 1 where none is written, null for ₓ."""
    digits = F.translate(F.regexp_extract(piece, f"^[^₀-₉ₓ0-9(@#?!*°]*({_INDEX})", 1), "₀₁₂₃₄₅₆₇₈₉", "0123456789")
    return F.when(digits == "", 1).when(digits != "ₓ", digits.try_cast("int"))


def sign_parts(piece: Column, kind: Column) -> Column:
    """struct (type, value, name, index, modifiers, flags, sign) of a piece of a kind; what it does not have is null. name is free of brackets."""
    bare = F.regexp_replace(piece, r"\(.*\)>?$|<\(.*$|[\[\]]", "")
    named = kind.isin("Reading", "Logogram", "Number")
    flagged = named | kind.isin("UnidentifiedSign", "UnclearSign", "EgyptianMetricalFeetSeparator")
    return F.struct(
        kind.alias("type"),
        piece.alias("value"),
        F.when(named, F.regexp_extract(bare, rf"^({_V}+|{_L}+|{_NUMBER})", 1)).alias("name"),
        F.when(kind.isin("Reading", "Logogram"), sub_index(bare)).alias("index"),
        F.when(named, F.regexp_extract_all(bare, F.lit(rf"[@~]({one_of(*MODIFIERS, '[0-9]+')})"), 1)).alias("modifiers"),
        F.when(flagged, F.filter(F.split(F.regexp_extract(bare, rf"([{FLAGS}]*)$", 1), ""), lambda c: c != "")).alias("flags"),
        F.when(named & F.contains(piece, F.lit("(")), F.nullif(F.regexp_extract(piece, r"[^<]\(([^()]*(?:\([^()]*\)[^()]*)*)\)$", 1), F.lit(""))).alias("sign"),
    )


def parts(word: Column) -> Column:
    """array of sign_parts of a word's pieces."""
    plain = lambda p: F.struct(
        F.when(p == "-", "Joiner").otherwise("Reading").alias("type"),
        p.alias("value"),
        F.when(p != "-", F.translate(p, "₀₁₂₃₄₅₆₇₈₉", "")).alias("name"),
        F.when(p != "-", sub_index(p)).alias("index"),
        F.when(p != "-", F.array().cast("array<string>")).alias("modifiers"),
        F.when(p != "-", F.array().cast("array<string>")).alias("flags"),
        F.lit(None).cast("string").alias("sign"),
    )
    # the kind is told once and read from the struct
    told = F.transform(pieces(word), lambda p: F.struct(p.alias("p"), piece_type(p).alias("k")))
    usual = lambda x: F.when(x["p"].rlike(_USUAL_READING) | (x["p"] == "-"), plain(x["p"])).otherwise(sign_parts(x["p"], x["k"]))
    return F.when(word.rlike(SIMPLE_WORD), F.transform(F.regexp_extract_all(word, F.lit("[^-]+|-"), F.lit(0)), plain)).otherwise(F.transform(told, usual))


def language_of(shift: Column) -> Column:
    """The language that a shift turns to; unknown if it is none of the listed."""
    known = [F.when(shift.isin(*[f"%{c}" for c in codes]), name) for name, codes in LANGUAGES.items()]
    return F.coalesce(*known, F.lit("UNKNOWN"))


def normalized_of(shift: Column) -> Column:
    return F.coalesce(shift == NORMALIZED, F.lit(False))


def token_type(token: Column, shift: Column) -> Column:
    """What one token of a text line is, given the last shift before it (null at the start)."""
    greek, latin = F.coalesce(shift.isin(*GREEK_SHIFTS), F.lit(False)), ~normalized_of(shift)
    is_ = lambda pattern: token.rlike(whole(pattern))
    normalized = [
        F.when(token.isin("||", "(||)"), "Caesura"),
        F.when(token.isin("|", "(|)"), "MetricalFootSeparator"),
        F.when(is_(LACUNA), "Lacuna"),
        F.when(is_(AKKADIAN_WORD), "AkkadianWord"),
    ]
    usual = [
        F.when(token.isin("!qt", "!bs", "!cm", "!zz"), "CommentaryProtocol"),
        F.when(token == "ø", "WordOmitted"),
        F.when(token == "($___$)", "Tabulation"),
        F.when(F.left(token, F.lit(1)).isin(":", ";", "/") & is_(DIVIDER), "Divider"),
        F.when(token == "|", "LineBreak"),
        F.when(F.startswith(token, F.lit("°")) & is_(r"°[^°\\]*\\[^°]*°"), "Erasure"),
        F.when(~F.contains(token, F.lit("°")) & token.rlike(NO_SIGN), "Invalid"),
        F.when(F.contains(token, F.lit("/")) & seldom(token, DIVIDER_VARIANT), "DividerVariant"),
        F.when(F.contains(token, F.lit("{")) & seldom(token, LONE_DETERMINATIVE), "LoneDeterminative"),
        F.when(F.when(F.contains(token, F.lit("°")), seldom(token, WORD)).otherwise(seldom(token, _UNERASED_WORD)), "Word"),
    ]
    found = F.coalesce(
        F.when(F.length(token) > LONGEST_WORD, "Invalid"),
        F.when(latin & ~greek & token.rlike(USUAL_WORD), "Word"),
        F.when(F.startswith(token, F.lit("%")) & is_("%[a-zA-Z0-9]+"), "LanguageShift"),
        F.when(F.startswith(token, F.lit("&")) & is_("&(?:[1-9][0-9]*)?") & latin, "Column"),
        F.when(greek & is_(GREEK_WORD), "GreekWord"),
        *[F.when(latin & ~greek, t) for t in usual],
        *[F.when(~latin, t) for t in normalized],
    )
    enclosure = F.coalesce(*[F.when(token.isin(a, b), camel(name)) for name, a, b in ENCLOSURES if a])
    return F.coalesce(enclosure, found, F.lit("Invalid"))


def clean(token: Column) -> Column:
    """A token without enclosures, flags and what was erased; brackets around the name of a sign stay."""
    kept = F.regexp_replace(token, r"°[^°\\]*\\([^°]*)°", "$1")
    kept = F.regexp_replace(kept, rf"(?<=[\p{{L}}\p{{N}}{FLAGS}])\(({COMPOUND}|{_GRAPHEME})\)", "\u0001$1\u0002")
    kept = F.regexp_replace(kept, rf"<<|>>|<\(|\)>|[<>()\[\]{FLAGS}]", "")
    return F.translate(kept, "\u0001\u0002", "()")


# Lines

_LABEL_STATUS = "['′’ʾ?!*°]*"
_LINE_NUMBER = r"(?:[A-Za-z]\+)?\d+['′’ʾ]?[A-Za-z]?"
_OBJECTS, _SURFACES = ("tablet", "envelope", "prism", "bulla"), ("obverse", "reverse", "left", "right", "top", "bottom")
_SURFACE_LABEL, _COLUMN_LABEL = rf"{one_of('o', 'r', r'b[.]e[.]', r'l[.]e[.]', r'r[.]e[.]', r't[.]e[.]', r'e[.]')}{_LABEL_STATUS}", f"[ivxlcdm]+{_LABEL_STATUS}"
LABELS = one_of(f"{_SURFACE_LABEL} {_COLUMN_LABEL}", _SURFACE_LABEL, _COLUMN_LABEL)
_OBJECT = one_of(*_OBJECTS, "fragment .+?", "object .+?")
_SURFACE = one_of(*_SURFACES, "face [a-z]", "edge(?: [a-z])?", "surface .+?")
_DOLLAR_STATUS = one_of(r"!\?", r"[*?!°]")
_QUALIFICATION = one_of("at least", "at most", "about")
_EXTENT = one_of(r"\d+ ?- ?\d+", r"\d+", "several", "some", "rest of", "start of", "beginning of", "middle of", "end of")
_SCOPE = one_of("columns", "column", "lines", "line", "cases", "case", "side", "excerpt", "surface", _OBJECT, _SURFACE)
_STATE = one_of("blank", "broken", "effaced", "illegible", "missing", "traces", "omitted", "continues")
#: Possessive throughout: a loop over alternatives that may go back needs stack for each character, and lines have no bound.
_MARKUP = r"(?:@(?:akk|sux|es|i|sup|sub|b)\{[^{}]+\}|@bib\{(?:[^@{}\\]++|\\[@{}\\])++(?:@(?:[^@{}\\]++|\\[@{}\\])++)?\}|@url\{[^}]+\}(?:\{[^@{}]+\})?|[^@{}]++)++"
# Genres and stages of texts.
_GENRE = one_of("Lex", "Med", "L", "D", "Mag", "Sum", "Šui")
_STAGE = one_of("Ur3", "OA", "OB", "OElam", "PElam", "MB", "MElam", "MA", "Hit", "NA", "NB", "NElam", "LB", "Per", "Hel", "Par", "Uruk4", "JN", "ED1_2", "Fara", "PSarg", "Sarg", "Aram", "Luw", "Unc", "SB")

#: Kinds of lines: name, pattern, and what its groups are. The first that fits counts.
LINE_KINDS = (
    ("EmptyLine", r"^\s*$", ()),
    ("NoteLine", rf"^#note: ({_MARKUP})$", ("text",)),
    ("TranslationLine", rf"^#tr(?:\.([a-z]{{2}}))?(?:\.\((?:({LABELS}) )?({_LINE_NUMBER}(?:-{_LINE_NUMBER})?)\))?: ({_MARKUP})$", ("language", "label", "number", "text")),
    ("TextLine", rf"^({_LINE_NUMBER}(?:-{_LINE_NUMBER})?)\. +(.*\S) *$", ("number", "text")),
    ("SealAtLine", r"^@(seal) (\d+)$", ("label", "number")),
    ("ColumnAtLine", rf"^@(column)(?: (\d+))? ?({_LABEL_STATUS})$", ("label", "number", "status")),
    ("HeadingAtLine", rf"^@(h)(\d+)(?: ({_MARKUP}))?$", ("label", "number", "text")),
    ("DiscourseAtLine", "^@(catchline|colophon|date|signatures|signature|summary|witnesses)$", ("label",)),
    ("ObjectAtLine", rf"^@({_OBJECT}) ?({_LABEL_STATUS})$", ("label", "status")),
    ("SurfaceAtLine", rf"^@({_SURFACE}) ?({_LABEL_STATUS})$", ("label", "status")),
    ("DivisionAtLine", r"^@m=division (.+?)(?: (\d+))?$", ("text", "number")),
    ("CompositeAtLine", r"^@(composite)$", ("label",)),
    ("CompositeAtLine", r"^@(div|m=locator) (.+?)(?: (\d+))?$", ("label", "text", "number")),
    ("CompositeAtLine", "^@(end) (.+)$", ("label", "text")),
    ("RulingDollarLine", rf"^\$ *[( ]*(single|double|triple) ruling ?({_DOLLAR_STATUS})?[ )]*$", ("label", "status")),
    ("ImageDollarLine", r"^\$ *\( ?image (\d+[a-z]?) = (.+)\)$", ("number", "text")),
    ("SealDollarLine", r"^\$ *[( ]*(seal) (\d+)[ )]*$", ("label", "number")),
    ("StateDollarLine", rf"^\$ *[( ]*(?=[^)])(?:({_QUALIFICATION})(?: |(?=[)]|$)))?(?:({_EXTENT})(?: |(?=[)]|$)))?(?:({_SCOPE})(?: |(?=[)]|$)))?(?:({_STATE})(?: |(?=[)]|$)))?({_DOLLAR_STATUS})?[ )]*$", ("qualification", "extent", "scope", "state", "status")),
    ("LooseDollarLine", r"^\$ *\((.+)\)$", ("text",)),
    ("ParallelFragment", rf"^// (cf\. )?F (.+?\.[^. ]+(?:\.[^. ]+)?) (?:&d )?(?:{one_of(*_OBJECTS)}{_LABEL_STATUS} )?(?:{LABELS} )?({_LINE_NUMBER}(?:-{_LINE_NUMBER})?)$", ("label", "text", "number")),
    ("ParallelText", rf'^// (cf\. )?({_GENRE} (?:0|[IVXLCDM]+)\.\d+)(?: {_STAGE} (?:"[^"]+" )?"[^"]+")? ({_LINE_NUMBER}(?:-{_LINE_NUMBER})?)$', ("label", "text", "number")),
    ("ParallelComposition", rf"^// (cf\. )?\((.+) ({_LINE_NUMBER}(?:-{_LINE_NUMBER})?)\)$", ("label", "text", "number")),
    ("ControlLine", "^((?:=:|&).*)$", ("text",)),
)
LINE_FIELDS = ("label", "number", "status", "language", "text", "qualification", "extent", "scope", "state")


def line_type(line: Column) -> Column:
    """What a line is; Invalid if no kind fits."""
    return F.coalesce(*[F.when(line.rlike(pattern), name) for name, pattern, _ in LINE_KINDS], F.lit("Invalid"))


def line_field(line: Column, kind: Column, field: str) -> Column:
    """One of LINE_FIELDS of a line of a kind; null where it has none."""
    found = [F.when((kind == name) & line.rlike(pattern), F.nullif(F.trim(F.regexp_extract(line, pattern, groups.index(field) + 1)), F.lit(""))) for name, pattern, groups in LINE_KINDS if field in groups]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def number_parts(number: Column) -> Column:
    """struct (prefix, number, prime, suffix, last) of a line number or range of numbers; last is the greatest number of a range."""
    one = r"^(?:([A-Za-z])\+)?(\d+)(['′’ʾ])?([A-Za-z])?"
    got = lambda i: F.nullif(F.regexp_extract(number, one, i), F.lit(""))
    return F.struct(got(1).alias("prefix"), got(2).try_cast("long").alias("number"), got(3).isNotNull().alias("prime"), got(4).alias("suffix"), F.nullif(F.regexp_extract(number, rf"-(?:[A-Za-z]\+)?(\d+)['′’ʾ]?[A-Za-z]?$", 1), F.lit("")).try_cast("long").alias("last"))
