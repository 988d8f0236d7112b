"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

TOKEN = r"([\p{L}\p{N}_]+)"
#: White space that Python's strip() removes.
BLANKS = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Abbreviations, applied longest first, in this order among equals.
ABBREVIATIONS = (
    ("như thế nào", "ntn"), ("khách hàng", "kh"), ("điện thoại", "dt"), ("bao nhiêu", "bn"), ("hướng dẫn", "hd"),
    ("tài khoản", "tk"), ("gói cước", "gói"), ("thuê bao", "tb"), ("thế nào", "tn"), ("dịch vụ", "dv"),
    ("đăng ký", "dk"), ("sử dụng", "sd"), ("không", "ko"), ("nhưng", "nhg"), ("được", "dc"), ("với", "vs"),
)
def _mark_tables() -> tuple[str, str]:
    """By Unicode's decompositions: the letters that are one letter with marks, then all marks; and what stays of the former.

    Đ has no decomposition and counts as D.
    """
    plain, marks = {"đ": "d", "Đ": "D"}, []
    for code in (*range(0xD800), *range(0xE000, 0x10000)):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif unicodedata.decomposition(c):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(base) == 1 and base != c:
                plain[c] = base
    return "".join([*plain, *marks]), "".join(plain.values())


MARKED, PLAIN = _mark_tables()


def _composition_doubts() -> str:
    """A regular expression for one character that NFC may change, or that may join the one before it.

    By Unicode's quick check: a text without any is in composed form already. Wide spans without such
    characters are told off first, so that most letters are not held against all ranges.
    """
    changed = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # Hangul's vowels and finals join by rule, not by table
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        c = chr(code)
        if unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c):
            changed.add(code)
        elif (parts := unicodedata.decomposition(c).split()) and len(parts) == 2 and not parts[0].startswith("<"):
            changed.add(int(parts[1], 16))
    spans: list[list[int]] = []
    for code in sorted(changed):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    ends = [-1, *(high for _, high in spans)]
    wide = [(end + 1, low - 1) for end, (low, _) in zip(ends, spans) if low - end > 128]
    of = lambda ranges: "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges)
    return f"[[^{of(wide)}]&&[{of(spans)}]]"


DOUBTS = _composition_doubts()


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).strip())


@F.pandas_udf(BooleanType())
def _is_composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.is_normalized("NFC", x))


def doubtful(c: Column) -> Column:
    """``c`` where it may not be in Unicode's composed form, else null."""
    return F.when(c.rlike(DOUBTS), c)


def nfc(c: Column) -> Column:
    """Unicode NFC and outer white space removed. No built-in normalises: doubtful texts go to Python, all others stay where they are."""
    return F.coalesce(_composed(doubtful(c)), strip(c))


def is_nfc(c: Column) -> Column:
    """Whether a text is in Unicode's composed form; Python sees doubtful texts only."""
    return F.coalesce(_is_composed(doubtful(c)), F.when(c.isNotNull(), True))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def strip_marks(c: Column) -> Column:
    """All combining marks removed, đ to d; Hangul syllables, which fall into letters and not marks, stay whole."""
    return F.translate(c, MARKED, PLAIN)


@F.pandas_udf(BooleanType())
def is_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.is_normalized("NFC", x))


def tokens(c: Column) -> Column:
    """Unicode words of the lower-cased text, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1))


def containment(query: Column, doc: Column) -> Column:
    """Share of query tokens, repeats counted, that the document's tokens hold; 1 for an empty query."""
    held = F.size(F.filter(query, lambda w: F.array_contains(doc, w)))
    return F.when(F.size(query) == 0, F.lit(1.0)).otherwise(held / F.size(query))


def longest_common_ngram(a: Column, b: Column, cap: int = 12) -> Column:
    """Length of the longest word n-gram (at most ``cap``) that both have; 0 if either is empty.

    A common n-gram implies a common one of n - 1, so the length is found bit by bit. Words are hashed once,
    n-grams by the hashes of their words; where two meet, their words are compared.
    """
    steps = [1 << bit for bit in reversed(range(cap.bit_length()))]

    def grams(hashes: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - n + 1), lambda i: F.xxhash64(F.slice(hashes, i, n)))

    def both(x: Column, n: Column) -> Column:
        met = F.transform(F.array(F.struct(grams(x["ha"], n).alias("a"), grams(x["hb"], n).alias("b"))), lambda g: F.exists(
            F.array_intersect(g["a"], g["b"]),
            lambda h: F.slice(x["a"], F.array_position(g["a"], h).cast("int"), n) == F.slice(x["b"], F.array_position(g["b"], h).cast("int"), n)))
        return F.when(n <= F.least(F.lit(cap), F.size(x["a"]), F.size(x["b"])), met[0]).otherwise(False)

    def longest(x: Column) -> Column:
        return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda n, s: F.when(both(x, n + s), n + s).otherwise(n))

    hashed = lambda w: F.transform(w, lambda t: F.xxhash64(t))
    # an array of one struct names what is used more than once
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), hashed(a).alias("ha"), hashed(b).alias("hb"))), longest)[0]


def abbreviate(c: Column) -> Column:
    c = F.lower(c)
    for long, short in ABBREVIATIONS:
        c = F.replace(c, F.lit(long), F.lit(short))
    return c


def looks_like_text(c: Column) -> Column:
    """At least 8 characters, not a bracketed structure, and letters for three tenths of it (4 at least)."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    bracketed = F.substring(c, 1, 1).isin("[", "{") & F.substring(F.rtrim(c), -1, 1).isin("]", "}")
    return (F.length(c) >= 8) & ~bracketed & (letters >= F.greatest(F.lit(4.0), 0.3 * F.length(c)))


def chunk_key(doc: Column, index: Column) -> Column:
    return F.concat_ws("::", doc.cast("string"), F.coalesce(index, F.lit(0)).cast("string"))


def chunk_of(key: Column) -> Column:
    return F.substring_index(key, "#", 1)


def md5_number(c: Column) -> Column:
    """The first 12 hex digits of the MD5 as a number: a seedable order that SQL can replay."""
    return F.conv(F.substring(F.md5(c), 1, 12), 16, 10).cast("long")


def typo(text: Column, seed: Column, words: int = 2) -> Column:
    """Swaps two neighbouring letters in up to ``words`` words of more than four letters, chosen by MD5 of the seed; blanks collapse."""
    parts = F.array_remove(F.split(strip(text), r"\s+"), "")
    long = F.filter(F.transform(parts, lambda w, i: F.when(F.length(w) > 4, i)), lambda i: i.isNotNull())
    order = F.array_sort(F.transform(long, lambda i: F.struct(md5_number(F.concat_ws("|", seed, i.cast("string"))).alias("h"), i.alias("i"))))
    chosen = F.transform(F.slice(order, 1, words), lambda x: x["i"])

    def swapped(w: Column, i: Column) -> Column:
        j = (md5_number(F.concat_ws("|", seed, i.cast("string"), F.lit("at"))) % (F.length(w) - 1)).cast("int") + 1
        turned = F.concat(F.substring(w, F.lit(1), j - 1), F.substring(w, j + 1, F.lit(1)), F.substring(w, j, F.lit(1)), F.substring(w, j + 2, F.length(w)))
        return F.when(F.array_contains(chosen, i), turned).otherwise(w)

    return F.array_join(F.transform(parts, swapped), " ")
