"""Text keys, similarity, labels and HTML clean-up as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(char: str) -> str:
    wide = unicodedata.normalize("NFKD", char).lower()
    return "".join(c for c in wide if not 0x300 <= ord(c) <= 0x36F)


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility folding derived from the Unicode database, not from a word list."""
    singles, targets, multiples = [], [], []
    useful = set("abcdefghijklmnopqrstuvwxyz0123456789&")
    for code in range(0x80, 0x20000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        folded = _folded(char)
        if not useful & set(folded):
            continue
        if len(folded) == 1:
            singles.append(char)
            targets.append(folded)
        elif code < 0x2180 or 0xFB00 <= code <= 0xFB06:
            multiples.append((char, folded))
    return "".join(singles), "".join(targets), tuple(multiples)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def fold_accents(value: Column) -> Column:
    singles, targets, multiples = _fold_tables()
    codes = sorted(ord(char) for char, _ in multiples)
    starts = [c for i, c in enumerate(codes) if i == 0 or c - codes[i - 1] > 64]
    ends = [c for i, c in enumerate(codes) if i == len(codes) - 1 or codes[i + 1] - c > 64]
    # A few ranges around the characters that widen: a superset is cheap to test and harmless.
    wide = "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends)) + "]"
    pairs = F.split(F.lit("\n".join(f"{char}\t{folded}" for char, folded in multiples)), "\n")
    expanded = F.aggregate(pairs, value, lambda done, pair: F.replace(
        done, F.split(pair, "\t")[0], F.split(pair, "\t")[1]
    ))
    flat = F.translate(
        F.when(value.rlike(wide), expanded).otherwise(value), singles, targets
    )
    plain = F.regexp_replace(flat, "[\\u0300-\\u036f]", "")
    return F.when(value.rlike("[^\\x00-\\x7F]"), plain).otherwise(value)


def text_key(value: Column) -> Column:
    """Accent-free lower-case words separated by single blanks."""
    lowered = F.lower(fold_accents(value))
    words = F.regexp_replace(F.replace(lowered, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    return F.trim(words)


def comparable_key(value: Column) -> Column:
    """Key used to cluster near-identical postings for review."""
    decoded = F.replace(F.lower(value), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(decoded, "[^a-z0-9]+", " "))


def plain_words(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


# Employment type aliases used for comparing postings.
EMPLOYMENT_KEYS = {
    "fulltime": "fulltime",
    "permanent": "fulltime",
    "parttime": "parttime",
    "contract": "contract",
    "contractor": "contract",
    "temporary": "temporary",
    "temp": "temporary",
    "internship": "internship",
    "intern": "internship",
}

# Published employment type labels and the phrases that mean them.
EMPLOYMENT_LABELS = ["Full time", "Part time", "Contract", "Temporary", "Internship"]
EMPLOYMENT_PHRASES = {
    "fulltime": "Full time",
    "full-time": "Full time",
    "full time": "Full time",
    "permanent": "Full time",
    "parttime": "Part time",
    "part-time": "Part time",
    "part time": "Part time",
    "contract": "Contract",
    "contractor": "Contract",
    "freelance": "Contract",
    "temporary": "Temporary",
    "temp": "Temporary",
    "internship": "Internship",
    "intern": "Internship",
}


def lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def employment_key(value: Column) -> Column:
    key = F.replace(text_key(value), F.lit(" "), F.lit(""))
    return F.coalesce(lookup(key, EMPLOYMENT_KEYS), key)


def employment_label(value: Column) -> Column:
    """Published label for a free-text employment type, or null."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[_-]+", " "), "\\s+", " "))
    known = {label.lower(): label for label in EMPLOYMENT_LABELS}
    return F.coalesce(
        lookup(words, known),
        lookup(F.replace(words, F.lit(" "), F.lit("")), EMPLOYMENT_PHRASES),
        lookup(words, EMPLOYMENT_PHRASES),
    )


def token_set(key: Column) -> Column:
    """Distinct tokens longer than one character of an existing text key."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: F.length(t) > 1))


def jaccard(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        shared / union
    )


def location_similarity(left_key: Column, right_key: Column, left: Column, right: Column) -> Column:
    return (
        F.when((left_key == "") | (right_key == ""), F.lit(0.0))
        .when(left_key == right_key, F.lit(1.0))
        .otherwise(jaccard(left, right))
    )


def squeeze(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, "\\s+", " "))


def summary(title: Column, description: Column) -> Column:
    body = squeeze(F.coalesce(description, F.lit("")))
    return F.when(body != "", F.substring(body, 1, 220)).otherwise(
        F.concat(F.lit("Canonical posting for "), title, F.lit("."))
    )


def retained_body(incoming: Column, stored: Column) -> Column:
    """Keep the stored description when the incoming one is blank."""
    blank_in = F.trim(F.coalesce(incoming, F.lit(""))) == ""
    has_stored = F.trim(F.coalesce(stored, F.lit(""))) != ""
    return F.when(blank_in & has_stored, stored).otherwise(incoming)


def decode_entities(value: Column) -> Column:
    text = value
    # The entities decoded before comparing titles.
    for pattern, char in [
        ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"),
        ("(?i)&lt;", "<"), ("(?i)&gt;", ">"),
    ]:
        text = F.regexp_replace(text, pattern, char)
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(\\d+);"), F.lit(1)))
    numeric = F.aggregate(
        codes, text,
        lambda done, code: F.replace(
            done, F.concat(F.lit("&#"), code, F.lit(";")),
            F.when(code.cast("long") < 128, F.chr(code.cast("long"))).otherwise(
                F.decode(_utf8(code.cast("long")), "UTF-8")
            ),
        ),
    )
    return squeeze(F.when(F.size(codes) > 0, numeric).otherwise(text))


def _utf8(code: Column) -> Column:
    """UTF-8 bytes of a code point at or above 128."""
    def byte(number: Column) -> Column:
        return F.lpad(F.hex(number), 2, "0")

    def tail(shift: int) -> Column:
        return byte(F.shiftright(code, shift).bitwiseAND(63) + 128)

    two = F.concat(byte(F.shiftright(code, 6) + 192), tail(0))
    three = F.concat(byte(F.shiftright(code, 12) + 224), tail(6), tail(0))
    four = F.concat(byte(F.shiftright(code, 18) + 240), tail(12), tail(6), tail(0))
    return F.unhex(F.when(code < 2048, two).when(code < 65536, three).otherwise(four))


def strip_tags(html: Column) -> Column:
    """Readable text of an HTML fragment."""
    bare = F.regexp_replace(html, "(?is)<script\\b.*?</script>", " ")
    bare = F.regexp_replace(bare, "(?is)<style\\b.*?</style>", " ")
    return decode_entities(F.regexp_replace(bare, "(?s)<[^>]+>", " "))


def plain_html(html: Column) -> Column:
    """Tag-free text with the few entities career pages use decoded."""
    text = F.regexp_replace(html, "(?s)<[^>]*>", " ")
    for pattern, char in [
        ("(?i)&nbsp;|&#160;", " "), ("(?i)&amp;", "&"),
        ('(?i)&quot;|&#34;', '"'), ("(?i)&#39;|&apos;", "'"),
    ]:
        text = F.regexp_replace(text, pattern, char)
    return squeeze(text)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", "")


def domain_title(domain: Column) -> Column:
    """Readable name from the first label of a domain."""
    parts = F.split(F.split(domain, "\\.")[0], "[-_]")
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))),
        " ",
    )


def round_half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5))
