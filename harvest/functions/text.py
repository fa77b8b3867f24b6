"""Text functions over columns; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as Unicode has it; Java's ``\s`` is ASCII alone.
SPACE = r"[\s\x{85}\p{Z}]"

# The entities that are decoded, in this order, and the labels of a place, by priority.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]
PLACE_LABELS = ["Location:", "📍", "Location :", "Локація:", "Локація :"]


def strip(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", "")


def compact(s: Column) -> Column:
    """White-space runs to one space, none at the ends."""
    return strip(F.regexp_replace(s, rf"{SPACE}+", " "))


def normalize(s: Column) -> Column:
    return F.lower(compact(s))


def contains_fold(s: Column, part: Column) -> Column:
    return F.contains(F.lower(s), F.lower(part))


def tokens(s: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")


def sha16(s: Column) -> Column:
    return F.substring(F.sha1(s), 1, 16)


def slug(s: Column) -> Column:
    s = F.replace(F.replace(F.lower(strip(s)), F.lit(" & "), F.lit(" and ")), F.lit("/"), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(s, " +", "-"), "[^a-z0-9-]", "")


def title_case(s: Column) -> Column:
    """Each run of letters capitalised, also after a hyphen."""
    parts = F.regexp_extract_all(s, F.lit(r"([\p{L}\p{Nd}']+|[^\p{L}\p{Nd}']+)"), 1)
    first = lambda w: F.when(F.substring(w, 1, 1) == "ß", "Ss").otherwise(F.upper(F.substring(w, 1, 1)))
    return F.array_join(F.transform(parts, lambda w: F.concat(first(w), F.lower(w.substr(F.lit(2), F.length(w))))), "")


def slug_to_title(path: Column) -> Column:
    return title_case(F.translate(F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(-1)), "-_", "  "))


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def like_ascii(s: Column, query: str) -> Column:
    """LIKE '%query%' that folds ASCII case only; % and _ in the query are wildcards, a backslash is none."""
    pattern = "%" + query.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%"
    return ascii_lower(s).like(pattern)


def strip_html(s: Column) -> Column:
    """Without tags; seven entities decoded in order (so ``&amp;lt;`` ends as ``<``); no blank lines."""
    s = F.regexp_replace(s, "<[^>]*>", "")
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(s, "\n"), strip), lambda x: x != ""), "\n")


def repair_xml(s: Column) -> Column:
    """Bare ampersands escaped; named and numeric references stay."""
    return F.regexp_replace(s, "&(?!#|[A-Za-z0-9]*;)", "&amp;")


def place_label(s: Column) -> Column:
    """What follows the first label with a place of 1 to 99 bytes on its line, or ''."""
    found = []
    for label in PLACE_LABELS:
        place = F.regexp_extract(s, f"(?iu){label}([^\n]*)", 1)
        place = F.regexp_replace(F.regexp_replace(strip(place), "<.*$", ""), "[,.]+$", "")
        found.append(F.when((F.octet_length(place) > 0) & (F.octet_length(place) < 100), place))
    return F.coalesce(*found, F.lit(""))


def first_bytes(s: Column, n: int) -> Column:
    """The first n characters and an ellipsis where there are more than n bytes."""
    return F.when(F.octet_length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("…"))).otherwise(s)


def has_any(s: Column, words: list[str]) -> Column:
    """Whether any of the words occurs anywhere."""
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(s, w)), F.lit(False)) if words else F.lit(False)


def trim_lines(s: Column, most: int = 400) -> Column:
    """Lines without white space around them, joined by spaces, blank ones left out; cut with dots behind ``most`` characters."""
    lines = F.filter(F.transform(F.split(s, r"\r?\n"), strip), lambda x: x != "")
    joined_ = F.array_join(lines, " ")
    return F.when(F.length(joined_) > most, F.concat(F.left(joined_, F.lit(most)), F.lit("..."))).otherwise(joined_)


def decode_entities(s: Column) -> Column:
    """The entities of ENTITIES, ``&amp;`` last, so that none is made by another."""
    for entity, char in sorted(ENTITIES, key=lambda e: e[0] == "&amp;"):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


def etag(s: Column) -> Column:
    """The content's MD5 in hexadecimal digits, in quotes."""
    return F.concat(F.lit('"'), F.md5(s.cast("binary")), F.lit('"'))


def key_id(*parts: Column) -> Column:
    """An id of 32 hexadecimal digits from a row's key: the same again when a task runs again, unlike a random one."""
    return F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(32))


def pick_list(s: Column, fallback: list[str]) -> Column:
    items = F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), r"[\n\r,;\t]+"), strip), lambda x: x != "")
    return F.when(F.size(items) > 0, items).otherwise(F.array(*map(F.lit, fallback)))


def parse_float(s: Column, default: float) -> Column:
    return F.coalesce(F.regexp_extract(strip(s), r"^[+-]?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double"), F.lit(default))


def empty_if_dash(s: Column) -> Column:
    return F.when(strip(s) == "-", "").otherwise(s)


def joined(first: Column, second: Column, separator: str = " • ") -> Column:
    return F.array_join(F.concat(first, second), separator)


def phrase(text: Column, words: str) -> Column:
    """Whether a phrase occurs, with any white space between its words, at word bounds."""
    import re

    pattern = r"\s+".join(re.escape(w) for w in words.split())
    return text.rlike(rf"(?iu)\b{pattern}\b")


def keyword_set(good: Column, roles: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(F.concat(good, roles), lambda x: F.lower(strip(x)))), lambda x: x != "")


def plain(s: Column) -> Column:
    """Tags to spaces, every entity decoded, white space compacted."""
    from .html import unescape

    return unescape(s)


def split_at(s: Column) -> tuple[Column, Column]:
    """(title, company) of 'Title at Company', split at the first ' at '; no company without it."""
    at = F.instr(s, " at ")
    title = F.when(at > 0, F.left(s, at - 1)).otherwise(s)
    return strip(title), F.when(at > 0, strip(s.substr(at + 4, F.length(s)))).otherwise("")
