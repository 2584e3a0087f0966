"""Token classes as column expressions.

Everything here stays in the JVM: regular expressions, string functions and higher-order functions, no Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a bullet, a currency code, a defining word and so on.
BULLETS = "• ▪ ◦ ■ □ ● ○ ‣ ⁃ ∙ · – — - *".split()
CURRENCY_CODES = (
    "AED AFN ALL AMD AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW "
    "CLF CLP CNY COP COU CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG "
    "HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK "
    "MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR "
    "SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU UYW "
    "UZS VED VES VND VUV WST XAF XCD XCG XOF XPF YER ZAR ZMW ZWG"
).split()
NOT_CALLS = ["st", "nd", "rd", "th", "®", "™", "©", "SM", "TM"]
DEFINITION_WORDS = "definition definitions glossary legend interpretation interpretations abbreviation abbreviations".split()
DEFINING_VERBS = ["means", "mean", "shall mean", "refers to", "refer to", "is defined", "are defined", "has the meaning", "have the meaning", "shall have the meaning"]
SPELLED = {1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: "six", 7: "seven", 8: "eight", 9: "nine", 10: "ten", 11: "eleven", 12: "twelve", 13: "thirteen", 14: "fourteen", 15: "fifteen", 16: "sixteen", 17: "seventeen", 18: "eighteen", 19: "nineteen", 20: "twenty", 30: "thirty", 40: "forty", 50: "fifty", 60: "sixty"}
FUNCTION_WORDS = (
    "and or except excluding including than that if of to for in by with the a an is are be as at on from provided least plus per over under between "
    "has have had either both whether"
).split()
# Fixed patterns. None has a lookahead but those marked; they hold in Java's, RE2's and Python's syntax alike.
ENUMERATOR = r"([0-9]{1,3}|[a-z]|[ivxlc]{1,6}|[A-Z])[.)]|\(([0-9]{1,3}|[a-z]|[ivxlc]{1,6})\)"
SECTION_NUMBER = r"[0-9]+(\.[0-9]+)*\.?|[A-Z]\."
YEAR = r"(19|20)[0-9][0-9]"
NOTE_MARK = "[0-9]{1,3}|[*†‡§¶#]{1,3}"
MARK = r"(?:[*†‡§¶#^~+!&⧫■-◿]|\p{So}){1,4}"
SIGN, SYMBOL, MAGNITUDE = "[-+−]", "[$€£¥₹₣R]", "(?:bn|mn|k|m|K|M|B)"
NUMBER = SIGN + "?(?:[0-9]{1,3}(?:[,.'   ][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)"
CODES = "(?:" + "|".join(CURRENCY_CODES) + ")"
ROMAN = r"(?i:m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
CHART_NUMBER = r"[-+−]?[$€£]?([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)?(?:([.,])([0-9]+))?%?"
EDGE_MARKS = "-–—()[]|.:"
PAGE_DIGITS = "[0-9]{1,4}(?:/[0-9]{1,4})?"
NAMED = r"(?i)\bfootnotes?\s+([0-9]{1,3})\b"


def value_pattern(code: str) -> str:
    """The value grammar, around a pattern of currency codes."""
    currency = f"(?:{SYMBOL}|{code})"
    unit = f"(?:%|bps|bp|‰|{SYMBOL}|{code})"
    one = f"{SIGN}?(?:{currency} ?)?{NUMBER}{MAGNITUDE}?(?: ?{unit})?(?:/[A-Za-z]+)*[*†‡]*"
    return rf"{one}|\( ?{one} ?\)|{one} ?(?:-|–|to) ?{one}|—|–|-|(?i:n/a|nil|free)"


VALUE = value_pattern(CODES + "(?![A-Za-z])")  # with lookahead
STRONG_MARK = f"{SYMBOL}|{CODES}(?![A-Za-z])|%|bps?|‰|[0-9][.,'  ][0-9]|[0-9]{MAGNITUDE}(?![A-Za-z])"  # with lookahead


def full(c: Column, pattern: str) -> Column:
    """The whole text matches."""
    return c.rlike(f"^(?:{pattern})\\z")


def normalize_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def content_key(kind: Column, text: Column) -> Column:
    return F.concat(F.lit("k"), F.substring(F.sha2(F.concat(kind, F.lit("\x1f"), normalize_ws(text)), 256), 1, 16))


def strip_label(c: Column) -> Column:
    return F.regexp_replace(c, r"^[().]+|[().]+\z", "")


def well_shaped(c: Column) -> Column:
    """No white space but single blanks and line ends, and none at the ends."""
    return ~c.rlike(r"(?U)^[ \n]|[ \n]\z|[\s&&[^ \n]]|\s\s")


def is_bullet(c: Column, bullets: tuple[str, ...] = tuple(BULLETS)) -> Column:
    return c.isin(*bullets)


def enumerator(c: Column) -> Column:
    return F.when(full(c, ENUMERATOR), c)


def section_number(c: Column) -> Column:
    return F.when(full(c, SECTION_NUMBER) & ~full(c, YEAR), c)


def note_label(c: Column) -> Column:
    return F.when(full(c, ENUMERATOR) | full(c, NOTE_MARK), c)


def is_mark(c: Column) -> Column:
    return full(c, MARK)


def call_parts(c: Column) -> Column:
    parts = F.transform(F.split(c, r",|\)\(|\s+"), strip_label)
    return F.filter(parts, lambda p: (p != "") & (F.length(p) <= 4) & ~p.isin(NOT_CALLS))


def is_value(c: Column) -> Column:
    t = F.trim(c)
    return ~full(t, YEAR) & full(t, VALUE)


def is_strong_value(c: Column) -> Column:
    return is_value(c) & c.rlike(STRONG_MARK)


def is_value_piece(tokens: Column) -> Column:
    """tokens: an array without note marks. A strong value as a whole, or up to four tokens that open with one."""
    whole = is_strong_value(F.array_join(tokens, " "))
    return (F.size(tokens) > 0) & (whole | ((F.size(tokens) <= 4) & is_strong_value(F.coalesce(F.get(tokens, 0), F.lit("")))))


def chart_number(c: Column) -> Column:
    core = F.regexp_replace(c, r"^[()]+|[()]+\z", "")
    whole = F.regexp_extract(core, f"^{CHART_NUMBER}\\z", 1)
    mark = F.regexp_extract(core, f"^{CHART_NUMBER}\\z", 2)
    part = F.regexp_extract(core, f"^{CHART_NUMBER}\\z", 3)
    ok = full(core, CHART_NUMBER) & ((whole != "") | (part != "")) & ~(whole.contains(",") & (mark == ","))
    digits = F.concat(F.when(whole == "", "0").otherwise(F.replace(whole, F.lit(","), F.lit(""))), F.lit("."), F.when(part == "", "0").otherwise(part))
    value = F.when(ok, digits).cast("double")
    return F.when(F.substring(core, 1, 1).isin("-", "−"), -value).otherwise(value)


def is_roman(c: Column) -> Column:
    return (F.length(c) > 0) & (F.length(c) <= 6) & full(c, ROMAN)


def line_key(tokens: Column) -> Column:
    """Digit runs masked; page numbers at the ends taken off a line that has words."""
    masked = F.transform(tokens, lambda t: F.regexp_replace(t, r"(?U)\d+", "#"))
    wordless = ~F.exists(masked, lambda t: t.rlike(r"\p{L}") & ~is_roman(t))
    number = lambda t: (t == "#") | is_roman(t)
    first = F.array_position(F.transform(masked, lambda t: ~number(t)), True)
    last = F.array_position(F.reverse(F.transform(masked, lambda t: ~number(t))), True)
    inner = F.slice(masked, F.greatest(first.cast("int"), F.lit(1)), F.greatest(F.size(masked) - first.cast("int") - last.cast("int") + 2, F.lit(0)))
    return (
        F.when(wordless, F.array_join(F.transform(masked, lambda t: F.when(is_roman(t), "#").otherwise(t)), " "))
        .when(F.exists(masked, lambda t: t.rlike(r"\p{L}{3}")), F.array_join(inner, " "))
        .otherwise(F.array_join(masked, " "))
    )


def text_key(text: Column) -> Column:
    """``line_key`` of a line's text. A line that neither opens nor ends with what may be a number, and has words, is not taken apart."""
    masked = F.regexp_replace(text, r"(?U)\d+", "#")
    other = "[^ #ivxlcdmIVXLCDM]"
    whole = masked.rlike(f"^[^ ]*{other}") & masked.rlike(f"{other}[^ ]*\\z") & masked.rlike(r"[\p{L}&&[^ivxlcdmIVXLCDM]]") & masked.rlike(r"\p{L}{3}")
    return F.when(whole, masked).otherwise(line_key(F.split(text, " ")))


def page_number_token(c: Column) -> Column:
    core = edge_core(c)
    return ~full(c, ENUMERATOR) & ~full(core, YEAR) & (full(core, PAGE_DIGITS) | is_roman(core))


def edge_core(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\-–—()\[\]|.:]+|[\-–—()\[\]|.:]+\z", "")


def page_digits(c: Column) -> Column:
    return page_number_token(c) & full(edge_core(c), PAGE_DIGITS)


def prints_page_number(text: Column) -> Column:
    tokens = F.split(F.regexp_replace(text, r"^[\-–—()\[\]|.: ]+|[\-–—()\[\]|.: ]+\z", ""), " +")
    n, first, last = F.size(tokens), F.get(tokens, 0), F.element_at(tokens, -1)
    return F.when(n <= 1, (first != "") & page_number_token(first)).when((n == 3) & page_digits(first) & full(last, YEAR), False).otherwise(page_digits(first) | page_digits(last))


def is_definitions_title(text: Column) -> Column:
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    words = F.when((F.size(words) > 0) & section_number(F.coalesce(F.get(words, 0), F.lit(""))).isNotNull(), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    tokens = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[():,;.]+|[():,;.]+\z", "")))
    return (F.size(words) >= 1) & (F.size(words) <= 8) & ~text.contains("..") & (F.arrays_overlap(tokens, F.array(*map(F.lit, DEFINITION_WORDS))) | F.array_join(tokens, " ").rlike(r"(^| )defined terms( |\z)"))


def defines(tokens: Column) -> Column:
    opening = F.array_join(F.transform(F.slice(tokens, 1, 4), lambda t: F.lower(F.regexp_replace(t, r"[.,:;]+\z", ""))), " ")
    return full(F.concat(opening, F.lit(" ")), "(?:" + "|".join(DEFINING_VERBS) + ") .*")


def named_calls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NAMED), 1)


def rejection(before: Column, n: Column) -> Column:
    """Why the ``(n)`` after ``before`` is no call, or null. The first convention that holds decides."""
    pb = F.rtrim(before)
    glued = pb == before
    word = F.regexp_extract(pb, r"([A-Za-z]+)[^A-Za-z]*\z", 1)
    group = F.regexp_extract(pb, r"\(([^()]*)\)\z", 1)
    spelled = F.element_at(F.create_map(*(F.lit(x) for kv in SPELLED.items() for x in kv)), n)
    return (
        F.when(pb == "", "clause-initial")
        .when(pb.rlike(r"[,;:]\z"), "sub-clause-enumerator")
        .when(pb.endswith(")") & glued & full(group, "[a-z]|[ivxl]{1,4}"), "statutory-citation")
        .when(pb.endswith(")"), F.lit(None).cast("string"))
        .when(glued & pb.rlike(r"[0-9]\z"), "attached-to-number")
        .when((word != "") & (F.lower(word) == F.coalesce(spelled, F.lit("?"))), "spelled-number-gloss")
        .when(word.isin(FUNCTION_WORDS), "function-word")
        .when(~pb.rlike(r"(?U)[\w%.\]}]\z"), "no-anchor")
    )


def escape_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<(?=[A-Za-z/!?])", r"\\<")


def escape_opening(c: Column) -> Column:
    return F.when(c.rlike(r"^[#>\-+*]"), F.concat(F.lit("\\"), c)).otherwise(F.regexp_replace(c, r"^([0-9]+)(?=[.)])", r"$1\\"))


def escape_cell(c: Column) -> Column:
    return F.replace(escape_tags(c), F.lit("|"), F.lit("\\|"))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def char_class(c: Column) -> Column:
    """Of one character: space, no_unicode, invisible or word."""
    return F.when(c.rlike(r"(?U)^[\s\x{200b}]\z"), "space").when(c.rlike(r"^\p{Cs}\z"), "no_unicode").when(c.rlike(r"^[\p{Cc}\p{Cf}\p{Co}\p{Cn}]\z"), "invisible").otherwise("word")


def half(name: Column, item: Column, salt: str = "half") -> Column:
    """dev or test, by the first hex digit of a digest; the salt is a parameter."""
    return F.when(F.substring(F.sha2(F.concat_ws(":", F.lit(salt), name, item), 256), 1, 1).between("0", "7"), "dev").otherwise("test")


# Fixed values of quoted terms.
QUOTE_OPENS, QUOTE_CLOSES = "“\"‘'", "”\"’'"
ALTERNATES = ["or", "and", "/"]
QUOTED_WORDS, PARENTHESIS_WORDS = 12, 6


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[.,:;]+\z", "")


def _quoted_run(words: Column, start: Column) -> Column:
    """The place after a quoted phrase that opens at ``start``, or 0."""
    places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), _bare(w).alias("t"))), lambda p: (p.i >= start) & (p.i < start + QUOTED_WORDS) & p.t.rlike(f"[{QUOTE_CLOSES}]\\z") & ((p.i > start) | (F.length(p.t) > 1)))
    opens = F.coalesce(F.get(words, start), F.lit("")).rlike(f"^[{QUOTE_OPENS}]")
    return F.when(opens & (F.size(places) > 0), F.get(places, 0).i + 1).otherwise(0)


def quoted_term(words: Column) -> Column:
    """How many of the first words are a quoted term: a phrase, its alternates, and one short parenthesis, with words after them; or 0. words: an array."""
    n = F.size(words)
    more = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), _quoted_run(words, F.lit(0)), lambda end, _: F.when((end > 0) & F.coalesce(F.get(words, end), F.lit("")).isin(ALTERNATES), F.greatest(end, _quoted_run(words, end + 1))).otherwise(end))

    def closed(end: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), _bare(w).alias("t"))), lambda p: (p.i >= end) & (p.i < end + PARENTHESIS_WORDS) & p.t.endswith(")"))
        return F.when(F.coalesce(F.get(words, end), F.lit("")).startswith("(") & (F.size(places) > 0), F.get(places, 0).i + 1).otherwise(end)

    end = F.aggregate(F.array(F.lit(0)), more, lambda e, _: closed(e))
    return F.when((more > 0) & (end < n), end).otherwise(0)


def glyph_stem(name: Column) -> Column:
    return F.split_part(name, F.lit("."), F.lit(1))


def glyph_reading(name: Column, font: Column, listed: Column, dingbat: Column) -> Column:
    """What a glyph of a name of digits reads as: a dingbat's character or U+FFFD; null for names that tell of themselves. listed: whether the public glyph list has the stem; dingbat: the code that a table of dingbats has for it."""
    blind = ~listed & full(glyph_stem(name), "a?[0-9]+")
    return F.when(blind & font.contains("Dingbats") & dingbat.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(dingbat), 8, "0")), "UTF-32")).when(blind, "�")


def slashed_names(text: Column) -> Column:
    """The distinct names after slashes, as fonts' encodings and character sets list them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"/([^\s/\[\]<>(){}%]+)"), 1))


def differences_names(encoding: Column) -> Column:
    body = F.regexp_extract(encoding, r"(?s)/Differences([^\]]*)", 1)
    return slashed_names(body)


def xml_chars(c: Column) -> Column:
    """Without the characters that XML 1.0 forbids."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")


def join_surrogates(units: Column) -> Column:
    """Code points of an array of UTF-16 units: a high and a low surrogate side by side are one, a lone one stays."""
    high = lambda u: u.between(0xD800, 0xDBFF)
    low = lambda u: u.between(0xDC00, 0xDFFF)
    paired = F.transform(units, lambda u, i: F.when(high(u) & low(F.coalesce(F.get(units, i + 1), F.lit(0))), F.lit(0x10000) + (u - 0xD800) * 1024 + (F.get(units, i + 1) - 0xDC00)).when(low(u) & (i > 0) & high(F.coalesce(F.get(units, i - 1), F.lit(0))), F.lit(-1)).otherwise(u))
    return F.filter(paired, lambda u: u >= 0)


def scorable(units: Column) -> Column:
    """The text of UTF-16 units as a UTF-8 reader has it: lone surrogates read U+FFFD."""
    points = F.transform(join_surrogates(units), lambda u: F.when(u.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(u))
    return F.array_join(F.transform(points, lambda u: F.decode(F.unhex(F.lpad(F.hex(u), 8, "0")), "UTF-32")), "")


def compared(fold: bool):
    """A function of columns: NFKC, without white space, and case-folded if asked. Unicode's normal forms are no built-in function, hence Arrow batches."""
    import unicodedata

    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join((unicodedata.normalize("NFKC", t).casefold() if fold else unicodedata.normalize("NFKC", t)).split()))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")
