"""URL functions over columns. Addresses without ``scheme://`` have no host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, title_case

# Parameters that only track, portals, hosts of applicant systems, schemes and file types to skip.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "mc_cid", "mc_eid", "igshid", "msclkid", "pk_campaign", "pk_kwd", "ref", "ref_src", "ref_url", "s", "spm", "mkt_tok"]
PORTALS = ["lever.co", "jobs.lever.co", "workable.com", "apply.workable.com", "greenhouse.io", "boards.greenhouse.io", "ashbyhq.com", "jobs.ashbyhq.com", "smartrecruiters.com", "jobs.smartrecruiters.com", "recruitee.com", "comeet.co", "bamboohr.com"]
SYSTEMS = ["greenhouse.io", "boards.greenhouse.io", "lever.co", "jobs.lever.co", "workable.com", "bamboohr.com", "smartrecruiters.com", "recruitee.com", "ashbyhq.com", "comeet.co"]
SKIPPED_SCHEMES = ["#", "javascript:", "mailto:", "tel:", "sms:", "data:"]
SKIPPED_FILES = r"(?i)\.(pdf|docx?|xlsx?|csv|zip|rar|7z|png|jpe?g|gif|svg|webp|mp4|mp3|avi|mov|wmv)([?#].*)?$"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(u: Column) -> Column:
    """Lower-cased host without port."""
    return F.lower(F.regexp_replace(authority(u), ":[0-9]*$", ""))


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def host_of(u: Column) -> Column:
    """The host, also of an address without a scheme."""
    u = strip(u)
    return F.when(u == "", "").otherwise(host(F.when(F.lower(u).rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))))


def _kept_query(u: Column, drop) -> Column:
    """Parameters that stay, ordered by name and then as they came."""
    parts = F.filter(F.split(query(u), "&"), lambda p: (p != "") & ~drop(F.lower(F.split(p, "=")[0])))
    keyed = F.array_sort(F.transform(parts, lambda p, i: F.struct(F.split(p, "=")[0].alias("k"), i.alias("i"), p.alias("p"))))
    kept = F.array_join(F.transform(keyed, lambda x: F.when(F.contains(x["p"], F.lit("=")), x["p"]).otherwise(F.concat(x["p"], F.lit("=")))), "&")
    return F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))


def _front(u: Column) -> Column:
    return F.when(scheme(u) == "", "").otherwise(F.concat(scheme(u), F.lit("://"), F.lower(authority(u))))


def canonical_stored(u: Column) -> Column:
    """The store's key: no fragment, no utm_ parameter, no slash at the end."""
    u = strip(u)
    return F.concat(_front(u), F.regexp_replace(path(u), "/+$", ""), _kept_query(u, lambda k: k.startswith("utm_")))


def canonical_checked(u: Column) -> Column:
    """The validator's form: gclid and fbclid go too; a root path stays, else one slash at the end goes."""
    u = strip(u)
    p = path(u)
    p = F.when((p == "") | (p == "/"), "/").otherwise(F.regexp_replace(p, "/$", ""))
    return F.when(u == "", "").otherwise(F.concat(_front(u), p, _kept_query(u, lambda k: k.startswith("utm_") | k.isin("gclid", "fbclid"))))


def canonical_listed(u: Column) -> Column:
    """The utility form: parameters of a fixed list go, the path stays."""
    u = strip(u)
    return F.concat(_front(u), path(u), _kept_query(u, lambda k: k.isin(TRACKING)))


def without_tracking(u: Column) -> Column:
    front = F.when(scheme(u) == "", "").otherwise(F.concat(scheme(u), F.lit("://"), authority(u)))
    return F.concat(front, path(u), _kept_query(u, lambda k: k.startswith("utm_") | k.isin("gclid", "fbclid")))


def resolve(href: Column, base: Column) -> Column:
    """The common relative forms against a base, without fragment: absolute, //host, /path, ?query, name and ''.

    Dot segments stay as they are; ``harvest.functions.html.resolve_any`` removes them.
    """
    href, site = F.regexp_replace(strip(href), "#.*$", ""), F.concat(scheme(base), F.lit("://"), authority(base))
    own = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path(own) == "", F.concat(own, F.lit("/"))).otherwise(F.regexp_replace(own, "[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(own, href))
        .when(href == "", F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(folder, href))
    )


def path_prefix(p: Column, prefix: Column) -> Column:
    return F.startswith(F.regexp_replace(p, "/$", ""), F.regexp_replace(prefix, "/$", ""))


def bad_href(h: Column) -> Column:
    low = F.lower(strip(h))
    test = (low == "") | low.rlike(SKIPPED_FILES)
    for s in SKIPPED_SCHEMES:
        test = test | low.startswith(s)
    return test


def skip_href(h: Column) -> Column:
    """The older, shorter guard: nothing, the bare mark ``#``, and addresses of mail, phone and script."""
    low = F.lower(strip(h))
    return F.coalesce((low == "") | (low == "#") | low.startswith("mailto:") | low.startswith("tel:") | low.startswith("javascript:"), F.lit(True))


def is_portal(h: Column) -> Column:
    test = F.lit(False)
    for p in PORTALS:
        test = test | F.contains(F.lower(h), F.lit(p))
    return test


def in_scope(u: Column, base: Column) -> Column:
    test = (scheme(u) == scheme(base)) & (host(u) == host(base))
    for s in SYSTEMS:
        test = test | F.contains(host(u), F.lit(s))
    return test


def segments(u: Column) -> Column:
    return F.filter(F.split(path(u), "/"), lambda x: x != "")


def title_from(u: Column) -> Column:
    return F.coalesce(strip(F.translate(F.try_element_at(segments(u), F.lit(-1)), "-_", "  ")), F.lit(""))


def company_from(u: Column) -> Column:
    h = host(u)
    for prefix in ("www.", "jobs.", "careers.", "boards."):
        h = F.regexp_replace(h, "^" + prefix.replace(".", r"\."), "")
    labels = F.split(h, r"\.")
    first = F.when(F.size(labels) > 2, labels[0]).otherwise(F.coalesce(F.get(segments(u), F.lit(0)), F.lit("")))
    return title_case(first)


def _titled(s: Column) -> Column:
    return title_case(F.translate(F.coalesce(s, F.lit("")), "-", " "))


def company_and_portal(u: Column) -> Column:
    """struct(company, apply_url, is_portal): each portal has its own place for the company."""
    h, s = host(u), segments(u)
    company = (
        F.when(F.contains(h, F.lit("lever.co")), _titled(F.get(s, F.lit(0))))
        .when(F.contains(h, F.lit("workable.com")), F.when(F.get(s, F.lit(0)) == "j", _titled(F.get(s, F.lit(1)))).otherwise(company_from(u)))
        .when(F.contains(h, F.lit("greenhouse.io")), _titled(F.nullif(F.regexp_extract(path(u), "([^/]+)/jobs(/|$)", 1), F.lit(""))))
        .otherwise(company_from(u))
    )
    return F.struct(F.coalesce(company, F.lit("")).alias("company"), u.alias("apply_url"), is_portal(h).alias("is_portal"))


#: A posting's code, such as A1.23B.
COMEET_CODE = r"(?i)^\s*[a-z0-9]{1,4}\.[a-z0-9]{2,}\s*$"


def comeet_job(u: Column) -> Column:
    """An address of a posting there: under jobs/, three parts or more, and a code at the end."""
    s = segments(u)
    return host(u).rlike(r"(^|\.)comeet\.com$") & (F.lower(F.get(s, F.lit(0))) == "jobs") & (F.size(s) >= 3) & F.try_element_at(s, F.lit(-1)).rlike(COMEET_CODE)


def comeet_title(u: Column) -> Column:
    """The last part of the path that is no code, as a title; the host where there is none."""
    named = F.try_element_at(F.filter(segments(u), lambda x: ~x.rlike(COMEET_CODE)), F.lit(-1))
    return F.coalesce(text_title(named), host(u), F.lit(""))


def text_title(slug: Column) -> Column:
    return title_case(strip(F.translate(slug, "-_", "  ")))


def with_item(u: Column, slug: Column, parameter: str = "_item") -> Column:
    """An address of its own for one of several postings on a page: a parameter and the fragment."""
    parts = F.filter(F.split(query(u), "&"), lambda p: (p != "") & (F.split(p, "=")[0] != parameter))
    kept = F.array_join(F.array_sort(F.concat(parts, F.array(F.concat(F.lit(f"{parameter}="), slug)))), "&")
    return F.concat(F.regexp_replace(u, r"[?#].*$", ""), F.lit("?"), kept, F.lit("#"), slug)


def company_hint(u: Column) -> Column:
    """The host's first label without www., jobs. and careers., as a title."""
    h = host(u)
    for prefix in ("www", "jobs", "careers"):
        h = F.regexp_replace(h, rf"^{prefix}\.", "")
    return title_case(F.split(h, r"\.")[0])


def has_host_suffix(h: Column, suffixes: list[str]) -> Column:
    """The host is one of the names or below one."""
    low = F.lower(h)
    return F.exists(F.array(*map(F.lit, suffixes)), lambda s: (low == F.lower(s)) | F.endswith(low, F.concat(F.lit("."), F.lower(s))))


def below(u: Column, base: Column) -> Column:
    """Same scheme and host, and under the base's path."""
    return (scheme(u) == scheme(base)) & (host(u) == host(base)) & F.startswith(path(u), F.regexp_replace(path(base), "([^/])$", "$1/"))


def looks_like_job(title: Column, u: Column) -> Column:
    return F.lower(F.concat_ws(" ", title, u)).rlike("job|career|position|opening")


# Which paths of a site lead to postings.
SITE_PATHS = {"site_codes": r"^/careers/[a-z0-9-]+/[A-Z0-9.]+/?$", "site_sections": "/careers/positions/", "site_positions": "/open-positions/", "board_grid": "(?i)/jobs/"}


def site_path(u: Column, site: str) -> Column:
    return path(u).rlike(SITE_PATHS[site])


def host_contains(u: Column, part: str) -> Column:
    """Whether the host holds a text, in any case."""
    return F.contains(host(u), F.lit(part.lower()))


def source_kind(kind: Column) -> Column:
    """Which source a registry entry's type asks for, in any case; anything else is read as a company's own site."""
    k = F.lower(strip(kind))
    return F.when(k == "rss_feed", "feed").when(k == "scraper", "board").otherwise("company")


def board_host(u: Column) -> Column:
    """The host as boards are matched by it: without www. and then jobs."""
    return F.regexp_replace(F.regexp_replace(host(u), r"^www\.", ""), r"^jobs\.", "")


def route(u: Column) -> Column:
    """The extractor that a source address asks for; the first match wins."""
    out = F
    for part, name in ROUTES:
        out = out.when(F.contains(u, F.lit(part)), name)
    return out.otherwise("generic")


# Which part of an address asks for which extractor.
ROUTES = [("telfed.org.il/job", "board_grid"), ("secrettelaviv.com", "board_table"), ("40seas.com", "site_positions"), ("agrematch.com", "site_headings"), ("ai21.com", "site_codes"), ("akeyless.io", "site_links"), ("audiocodes.com", "site_sections")]
