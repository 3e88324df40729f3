"""URL expressions of the crawler."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of links that are not visited; case matters.
EXCLUDED = (r"/search", r"/login", r"/register", r"/logout", r"/api/", r"/cdn-cgi/", r"\?", r"#", r"/print/", r"/share/", r"/email/")
#: Endings of paths that are documents to download.
DOCUMENTS = r"(?i)\.(pdf|doc|docx|xls|xlsx|ppt|pptx)$"
#: The name of a page without a path, and how long names may be.
INDEX, NAME_LENGTH = "index", 100


def normalize_url(url: Column) -> Column:
    """Without query and fragment and trailing slashes; case kept."""
    return F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*\z", ""), r"/+\z", "")


def visit_key(url: Column) -> Column:
    return F.lower(normalize_url(url))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """The path of an absolute URL, or all of a relative one, without query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*\z", ""), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")


def excluded(url: Column) -> Column:
    return url.rlike("|".join(EXCLUDED))


def is_document(url: Column) -> Column:
    return path(url).rlike(DOCUMENTS)


def same_site(url: Column, domain: Column) -> Column:
    """Whether the authority holds the domain or is part of it, letter by letter."""
    a, d = authority(url), F.lower(domain)
    return (a != "") & (F.contains(a, d) | F.contains(d, a))


def should_visit(url: Column, domain: Column | None = None) -> Column:
    """Of the allowed site, not excluded and no document; whether it was visited before is a join (see visit_key)."""
    wanted = ~excluded(url) & ~is_document(url)
    return wanted if domain is None else wanted & same_site(url, domain)


def is_page(content_type: Column) -> Column:
    """Responses that are pages."""
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))


def page_name(url: Column) -> Column:
    """A safe name from the path: slashes and other signs as one ``_``, at most 100 characters; ``index`` without a path."""
    inner = F.regexp_replace(path(url), r"\A/+|/+\z", "")
    inner = F.when(inner == "", INDEX).otherwise(inner)
    return F.left(F.regexp_replace(F.regexp_replace(inner, r"(?U)[^\w-]", "_"), "_+", "_"), F.lit(NAME_LENGTH))


def file_name(url: Column) -> Column:
    return F.concat(page_name(url), F.lit(".json"))


def download_name(url: Column) -> Column:
    """The last part of the path, as it is."""
    return F.regexp_extract(F.regexp_replace(path(url), r"/+\z", ""), r"([^/]*)\z", 1)
