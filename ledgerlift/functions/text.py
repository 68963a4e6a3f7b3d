"""Column functions for identifiers, names and free text.  All of them stay JVM-side."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterable, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped from company names before matching.
LEGAL_FORMS = ("oyj", "oy", "ab", "ltd", "limited", "inc", "gmbh", "as")
STATUS_WORDS = ("suljettu", "closed", "myynti", "hr lahjat", "ei saa laskuttaa", "ylitoimituksia")
ACCOUNT_FORMS = ("oyj", "oy", "ab", "ltd", "limited", "inc", "gmbh", "plc", "konserni", "group")

# Words damaged in earlier exports (the last letter became U+FFFD), and the right word.
KNOWN_MISREADINGS = (
    ("keitti\ufffd", "keittiö"),
    ("Keitti\ufffd", "Keittiö"),
    ("hyv\ufffdntekev\ufffdisyys", "hyväntekeväisyys"),
    ("Hyv\ufffdntekev\ufffdisyys", "Hyväntekeväisyys"),
    ("Ty\ufffd", "Työ"),
    ("ty\ufffd", "työ"),
    ("k\ufffdsittely", "käsittely"),
    ("K\ufffdsittely", "Käsittely"),
)

# Words ignored when a product name is cut into tokens.
NAME_STOP_WORDS = ("and", "the", "for", "with", "sis", "cm", "mm", "kpl", "sekä", "ja")

WORD_CHARS = "a-z0-9åäö"


def _decompositions() -> tuple[str, dict[str, str], dict[str, str]]:
    """From Unicode's own data: all combining marks, and what lower-case characters beyond ASCII decompose to
    (compatibly, marks left out) where that has a letter or digit: one character, or several."""
    marks, one, several = [], {}, {}
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
        elif char == char.lower() and (plain := unicodedata.normalize("NFKD", char)) != char:
            plain = "".join(c for c in plain if not unicodedata.combining(c)).lower()
            if any(c.isascii() and c.isalnum() for c in plain):
                (one if len(plain) == 1 else several)[char] = plain
    return "".join(marks), one, several


def _ranges(chars: Iterable[str]) -> str:
    """A pattern for any of these characters, neighbours as ranges."""
    out: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return f"[{''.join(f'{chr(a)}-{chr(b)}' for a, b in out)}]"


_MARKS, _ONE, _SEVERAL = _decompositions()
_ANY_OF_SEVERAL = _ranges(_SEVERAL)


def _lookup(table: dict[str, str]) -> Column:
    """A table as one constant."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def id_text(col: Column, dtype: str) -> Column:
    """Text of an identifier column; whole floats lose their ``.0``."""
    if dtype in ("double", "float") or dtype.startswith("decimal"):
        whole = col.try_cast("bigint")
        return F.when(whole == col, whole.cast("string")).otherwise(col.cast("string"))
    return col.cast("string")


def business_id(col: Column, *, on_fail: str = "null", country_prefix: str = "leading") -> Column:
    """Business id as ``NNNNNNN-N``.

    on_fail: ``null``; ``keep`` gives back the trimmed text (null becomes ""); ``blank`` gives "".
    country_prefix: drop only a leading ``FI`` or every one; as only digits are kept, both give the same.
    """
    text = F.trim(col)
    # a zero before seven digits stays, one before more goes; fewer match no group and leave the dash alone
    digits = F.concat(F.lit("0"), F.regexp_replace(col, r"[^0-9]+", ""))
    formatted = F.nullif(F.regexp_replace(digits, r"^(?:0(?=\d{8})|(?=\d{8}$))(\d{7,})(\d)$|^\d{1,7}$", "$1-$2"), F.lit("-"))
    if on_fail == "null":
        return formatted
    if on_fail == "blank":
        return F.coalesce(formatted, F.lit(""))
    kept = F.when(F.lower(text) == "nan", F.lit("")).otherwise(F.regexp_replace(text, r"^(?i)FI", ""))
    return F.coalesce(formatted, kept, F.lit(""))


def _without_words(col: Column, words: Sequence[str]) -> Column:
    return F.regexp_replace(col, rf"(?U)\b({'|'.join(words)})\b", " ")


def name_plain(col: Column) -> Column:
    """Lower case, everything but letters, digits and å ä ö becomes a space; null becomes ""."""
    return F.coalesce(collapse(F.regexp_replace(F.lower(col), rf"[^{WORD_CHARS}]+", " ")), F.lit(""))


def name_for_matching(col: Column, *, own_words: Sequence[str] = ()) -> Column:
    """Name without brackets, legal forms and status words (and ``own_words``), folded to a-z; nothing left is null."""
    text = F.regexp_replace(F.lower(F.trim(col)), r"\([^)]*\)", " ")
    text = F.translate(text, "äöå", "aoa")
    text = _without_words(_without_words(text, LEGAL_FORMS), [*STATUS_WORDS, *own_words])
    return F.nullif(collapse(F.regexp_replace(text, r"[^a-z0-9]+", " ")), F.lit(""))


def name_of_account(col: Column) -> Column:
    """Name without brackets and company forms, å ä ö kept; null becomes ""."""
    text = _without_words(F.regexp_replace(F.lower(col), r"\([^)]*\)", " "), ACCOUNT_FORMS)
    return F.coalesce(collapse(F.regexp_replace(text, rf"[^{WORD_CHARS}]+", " ")), F.lit(""))


def fold(col: Column) -> Column:
    """Lower case, compatibly decomposed, without combining marks; other characters become single spaces; null becomes "".

    One ``translate`` folds what becomes one character and drops the marks; only texts in which ligatures, fractions
    and the like are left are taken apart by character.
    """
    text = F.translate(F.lower(F.trim(col)), "".join(_ONE) + _MARKS, "".join(_ONE.values()))
    apart = _lookup(_SEVERAL)
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(apart, c), c)), "")
    text = F.when(text.rlike(r"[^\x00-\x7F]") & text.rlike(_ANY_OF_SEVERAL), spelt).otherwise(text)
    return F.coalesce(collapse(F.regexp_replace(text, r"[^a-z0-9]+", " ")), F.lit(""))


def product_name_key(col: Column) -> Column:
    return F.coalesce(collapse(F.lower(col)), F.lit(""))


def compact_key(col: Column) -> Column:
    return F.regexp_replace(product_name_key(col), rf"[^{WORD_CHARS}]+", "")


def code_key(col: Column, *, drop_spaces: bool = False, drop_decimal: bool = False) -> Column:
    """Upper-cased product code; null becomes ""."""
    text = F.upper(F.trim(col))
    if drop_spaces:
        text = F.regexp_replace(text, r"\s+", "")
    if drop_decimal:
        text = F.regexp_replace(text, r"\.0$", "")
    return F.coalesce(text, F.lit(""))


def source_code_key(col: Column) -> Column:
    """Code as used by the fill cascade: "", ``nan`` and ``none`` are no code."""
    text = F.upper(F.trim(col))
    return F.when(text.isin("", "NAN", "NONE"), F.lit("")).otherwise(F.coalesce(text, F.lit("")))


def numeric_id_key(col: Column) -> Column:
    """Number ids cut to whole numbers, other ids trimmed without ``.0``; null becomes ""."""
    text = F.trim(col)
    whole = text.try_cast("double").try_cast("bigint").cast("string")
    return F.coalesce(whole, F.regexp_replace(text, r"\.0$", ""), F.lit(""))


def package_size_text(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    return F.when(F.lower(text).isin("", "nan", "none", "null"), F.lit("")).otherwise(
        F.coalesce(F.regexp_replace(text, r"\.0$", ""), F.lit(""))
    )


def variant_text(col: Column, *, join_cm: bool = False) -> Column:
    """Spelling variants made one: ``-`` to space, ``3 x 4`` to ``3x4`` and, if asked, ``70 cm`` to ``70cm``."""
    text = F.regexp_replace(F.lower(F.trim(col)), "-", " ")
    text = F.regexp_replace(text, r"(?<=\d)\s*x\s*(?=\d)", "x")
    if join_cm:
        text = F.regexp_replace(text, r"(?<=\d)\s+cm\b", "cm")
    return F.coalesce(F.regexp_replace(text, r"\s+", " "), F.lit(""))


def strip_control(col: Column) -> Column:
    return F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def repair_misread(col: Column) -> Column:
    for wrong, right in KNOWN_MISREADINGS:
        col = F.replace(col, F.lit(wrong), F.lit(right))
    return col


def has_any(col: Column, words: Sequence[str], *, whole_words: bool = False) -> Column:
    body = "|".join(_literal(word) for word in words)
    pattern = rf"(?<![{WORD_CHARS}])({body})(?![{WORD_CHARS}])" if whole_words else f"({body})"
    return F.coalesce(col.rlike(pattern), F.lit(False))


def _literal(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in word)


def tokens(col: Column, min_len: int) -> Column:
    return F.regexp_extract_all(col, F.lit(rf"([{WORD_CHARS}]{{{min_len},}})"), F.lit(1))


def bigrams(words: Column) -> Column:
    """Neighbouring words as ``"first second"``."""
    return F.when(
        F.size(words) >= 2,
        F.zip_with(
            F.slice(words, F.lit(1), F.size(words) - 1),
            F.slice(words, F.lit(2), F.size(words) - 1),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))


def name_tokens(col: Column) -> Column:
    """Words of at least three characters, without stop words, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(col), F.lit("([a-zåäö0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*NAME_STOP_WORDS))


def search_text(*cols: Column) -> Column:
    return fold(F.concat_ws(" ", *cols))


def sentence(parts: Sequence[Column], *, limit: int, default: str, sep: str = ", ") -> Column:
    """First ``limit`` parts that are not null, joined; ``default`` where there is none."""
    present = F.filter(F.array(*parts), lambda part: part.isNotNull())
    return F.when(F.size(present) == 0, F.lit(default)).otherwise(F.array_join(F.slice(present, 1, limit), sep))


def positive_signals(limit: int = 4) -> Column:
    """Why a company looks good, from its segment columns."""
    lift = F.coalesce(F.col("segment_lift"), F.lit(0.0))
    return sentence(
        [
            F.when(lift >= 1.2, F.format_string("vahva segmenttiosuma (lift %.2f)", lift)),
            F.when(F.col("revenue_bucket") != "unknown", F.concat(F.lit("liikevaihtoluokka "), F.col("revenue_bucket"))),
            F.when(F.col("headcount_bucket") != "unknown", F.concat(F.lit("henkilöstöluokka "), F.col("headcount_bucket"))),
            F.when(F.col("growth_bucket").isin("growth", "high_growth"), F.concat(F.lit("kasvuluokka "), F.col("growth_bucket"))),
            F.when(F.col("industry").isNotNull(), F.concat(F.lit("toimiala "), F.col("industry"))),
        ],
        limit=limit,
        default="profiili muistuttaa parhaita asiakkaita",
    )


def url_clean(col: Column, *, keep_query: bool = False) -> Column:
    """URL with a scheme, without fragment, trailing slash and (unless kept) query; no host is null."""
    text = F.nullif(F.trim(col), F.lit(""))
    text = F.when(F.lower(text) == "nan", F.lit(None)).otherwise(text)
    text = F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    text = F.regexp_replace(text, r"#.*$", "")
    base = F.regexp_replace(F.regexp_replace(text, r"\?.*$", ""), r"/+$", "")
    if keep_query:
        base = F.concat(base, F.regexp_extract(text, r"(\?.*)$", 1))
    return F.when(base.rlike(r"^https?://[^/]+"), base)


def url_domain(col: Column) -> Column:
    return F.lower(F.regexp_extract(col, r"^https?://([^/?#]+)", 1))


def page_links(html: Column, base_url: Column) -> Column:
    """Distinct links of a page that stay on its own domain, absolute, in page order."""
    hrefs = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*?\bhref\s*=\s*["\']([^"\']+)["\']'), F.lit(1))
    root = F.regexp_extract(base_url, r"^(https?://[^/?#]+)", 1)
    absolute = F.transform(
        hrefs,
        lambda h: F.when(h.rlike("^https?://"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(base_url, "^(https?:)", 1), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.rlike("^[a-zA-Z]+:"), F.lit(None))
        .otherwise(F.concat(F.regexp_replace(F.regexp_replace(base_url, r"[?#].*$", ""), r"(^https?://[^/]+)?/?[^/]*$", "$1/"), h)),
    )
    cleaned = F.transform(absolute, lambda u: url_clean(u, keep_query=True))
    same = F.filter(cleaned, lambda u: u.isNotNull() & (url_domain(u) == url_domain(base_url)))
    return F.array_distinct(same)


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed, entities resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    text = decode_references(text)
    return collapse(F.translate(text, " ", " "))


def decode_references(text: Column) -> Column:
    """HTML's named and numeric character references as the characters they stand for; unknown ones stay."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(&#?[0-9a-zA-Z]+;?|&|[^&]+)"), F.lit(1))
    named = _lookup(dict(html5))

    def plain(piece: Column) -> Column:
        number = F.coalesce(
            F.try_to_number(F.regexp_extract(piece, r"^&#0*([0-9]{1,7});?$", 1), F.lit("9999999")).cast("int"),
            F.conv(F.nullif(F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]{1,6});?$", 1), F.lit("")), 16, 10).cast("int"),
        )
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number)), 8, "0")), "UTF-32")
        name = F.substring(piece, 2, 64)
        return F.when(~piece.startswith("&"), piece).otherwise(F.coalesce(char, F.element_at(named, name), piece))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, plain), "")).otherwise(text)
