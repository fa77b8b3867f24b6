"""Contact details in text; columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# What an address and a number look like.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"[\+]?[0-9]{1,4}[\s\-\.]?[0-9]{1,4}[\s\-\.]?[0-9]{1,9}"
# What announces an address, by priority.
MARKERS = ["to:", "email:", "contact:", "at:", "send to", "send your cv", "send cv"]


def first_email(s: Column) -> Column:
    return F.regexp_extract(s, EMAIL, 0)


def first_phone(s: Column) -> Column:
    return strip(F.regexp_extract(s, PHONE, 0))


def email_between(s: Column) -> Column:
    """The first word with one @, something on both sides and a dot after it; '' for none."""
    parts = F.transform(F.split(s, r"[ \n\r\t,;()\[\]{}<>\"']+"), lambda p: F.regexp_replace(F.regexp_replace(p, "^:+", ""), "[.,;:!?]+$", ""))
    good = F.filter(parts, lambda p: p.rlike(r"^[^@]+@[^@]*\.[^@]*$") & ~F.lower(p).startswith("mailto:"))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def email_announced(s: Column) -> Column:
    found = []
    for m in MARKERS:
        at = F.instr(F.lower(s), m)
        tail = F.when(at > 0, s.substr(at + len(m), F.length(s)))
        found.append(F.nullif(email_between(tail), F.lit("")))
    return F.coalesce(*found, email_between(s), F.lit(""))


def mailto(s: Column) -> Column:
    return email_between(F.regexp_replace(F.regexp_replace(strip(s), "(?i)^mailto:", ""), r"\?.*$", ""))


def valid_phone(s: Column) -> Column:
    """8 to 13 digits, not one digit alone, no half twice, zeros no more than half; and a local or a + number."""
    s = strip(s)
    d = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    zeros = n - F.length(F.replace(d, F.lit("0"), F.lit("")))
    odd = d.rlike(r"^(.)\1*$") | ((n % 2 == 0) & (F.left(d, half) == F.right(d, half))) | (zeros > half)
    local = ((n == 10) & d.rlike("^(05[0-9]|02|03|04|08|09|077)")) | (n.isin(9, 10) & d.startswith("972"))
    return (s != "") & ~s.startswith("-") & n.between(8, 13) & ~odd & (local | (s.startswith("+") & (n >= 10)))


def normal_phone(s: Column) -> Column:
    """+972-AA-NNN-NNNNNN from the last eleven digits, 0XX-XXX-XXXX, or as it is."""
    s = strip(s)
    d = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(d)
    far = F.concat(F.lit("+972-"), d.substr(n - 10, F.lit(2)), F.lit("-"), d.substr(n - 8, F.lit(3)), F.lit("-"), d.substr(n - 5, F.lit(6)))
    near = F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4))
    return F.when(d.startswith("972") & (n >= 12), far).when(d.startswith("0") & (n == 10), near).otherwise(s)
