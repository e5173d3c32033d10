"""Column functions on text. All are built-in expressions.

Edge cases: a null text gives null (no words, no label, no key); an empty one has no words, at
least one reading minute all the same, and is its own escape; texts may have any length; each
row is judged by itself, so ties and repeated rows don't arise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters except tab, line feed and carriage return, and every format character.
FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]|\p{Cf}"
FORBIDDEN_FORMAT = r"\p{Cf}"
#: A word: letters and digits, joined on by marks, apostrophes and hyphens.
WORD = r"[\p{L}\p{N}]+(?:[\p{M}'’-][\p{L}\p{M}\p{N}]+)*"
WORDS_PER_MINUTE = 220
DANGEROUS_SCHEMES = ("data", "file", "javascript", "vbscript")
#: Fixed labels: evidence levels and layers, Russian and English.
EVIDENCE_LABELS = {
    "traditional": ("Традиционное представление", "Traditional belief"),
    "laboratory": ("Лабораторное наблюдение", "Laboratory observation"),
    "clinical": ("Клинические данные", "Clinical evidence"),
    "none": ("Доказательств нет", "No supporting evidence"),
}
LAYER_LABELS = {
    "legend": ("Легенда", "Legend"),
    "context": ("Культурный контекст", "Cultural context"),
    "confirmed": ("Что подтверждено", "What is supported"),
}


def has_forbidden_control(text: Column, bytes_only: bool = False) -> Column:
    return text.rlike(FORBIDDEN_FORMAT if bytes_only else FORBIDDEN)


def has_dangerous_scheme(text: Column) -> Column:
    """A scheme that can run or read something, with tabs and line breaks inside it ignored."""
    return F.regexp_replace(text, r"[\t\n\r]", "").rlike(rf"(?i)(?:^|[^a-z0-9+.-])(?:{'|'.join(DANGEROUS_SCHEMES)})\s*:")


def word_count(text: Column) -> Column:
    # The matches are replaced by one mark each and all else by none; no array of words is built.
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / WORDS_PER_MINUTE)).cast("int")


def pad_left(value: Column, width: int, fill: str = "0") -> Column:
    """Padded to `width`, never cut."""
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def numbered(position: Column) -> Column:
    """A literal 0 before the one-based position (so ten is 010)."""
    return F.concat(F.lit("0"), position.cast("string"))


def encode_component(text: Column) -> Column:
    """Percent-encoding as scripts in a browser do it: a space is %20, and ! ' ( ) * ~ stay."""
    out = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def escape_html(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def code_units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def code_unit_key(text: Column) -> Column:
    """A binary key that sorts by UTF-16 code units."""
    return F.encode(text, "UTF-16BE")


def is_iso_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def origin_of(url: Column) -> Column:
    """scheme://host[:port] of an http or https URL, without a default port; null for others."""
    parts = F.regexp_extract(url, r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::(\d+))?(?:[/?#]|$)", 1)
    group = lambda k: F.regexp_extract(url, r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::(\d+))?(?:[/?#]|$)", k)
    scheme, port = F.lower(parts), group(3)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.when(parts != "", F.concat(scheme, F.lit("://"), F.lower(group(2)), F.when(default, "").otherwise(F.concat(F.lit(":"), port))))


def label(value: Column, labels: dict[str, tuple[str, str]], locale: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, (ru, en) in labels.items():
        out = F.when(value == key, F.when(locale == "en", en).otherwise(ru)).otherwise(out)
    return out


def translated(locale: Column, ru: Column, en: Column) -> Column:
    return F.when(locale == "en", en).otherwise(ru)


def clamp(value: Column, low: float = 0, high: float = 100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def neighbour(position: Column, step: Column, size: Column) -> Column:
    """The next position, held inside 0 to size - 1."""
    return F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), size - 1), position + step))


def wrapped(position: Column, step: Column, size: Column) -> Column:
    return F.pmod(position + step, size)


def percent_position(value: Column, low: Column, high: Column) -> Column:
    return F.round(clamp((value - low) / (high - low) * 100), 2)


def mask_ranges(text: Column, ranges: Column) -> Column:
    """Non-overlapping ranges array<struct<start,end>> (zero-based, in any order) overwritten with spaces; empty ones don't count."""
    blank = lambda s, r: F.overlay(s, F.repeat(F.lit(" "), (r["end"] - r["start"]).cast("int")), r["start"] + 1, r["end"] - r["start"])
    return F.aggregate(F.array_sort(F.filter(ranges, lambda r: r["end"] > r["start"])), text, blank)


def panel_id(record_id: Column) -> Column:
    """The id of a record's panel."""
    return F.concat(F.lit("era-panel-"), record_id)


def unique_array(values: Column, least: int = 0) -> Column:
    return (F.size(values) >= least) & (F.size(F.array_distinct(values)) == F.size(values))
