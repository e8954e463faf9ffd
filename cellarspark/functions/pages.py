"""Reading HTML in columns, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the common character entities, '&amp;' last ----
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
# ---- end of fixed values ----


def decoded(c: Column) -> Column:
    """Text without its character entities."""
    for entity, sign in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def title(html: str) -> Column:
    """The content of the title; '' where there is none."""
    return decoded(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1))


def meta(html: str, name: str) -> Column:
    """The content of a named meta tag; '' where there is none."""
    return decoded(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), f'(?is)<meta\\s+name="{name}"\\s+content="([^"]*)"', 1))


def visible_text(html: str) -> Column:
    """What is left without scripts, styles and tags; blank runs as one."""
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(bare, "(?s)<[^>]*>", " ")), "[ \\t\\r\\n]+", " "))


def links(html: str) -> Column:
    """The addresses of all anchors in order, empty ones left out."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit('(?is)<a\\s[^>]*href="([^"]*)"'), F.lit(1))
    return F.filter(found, lambda x: x != "")


def meta_any(html: str, attribute: str, name: str) -> Column:
    """The content of the first meta tag whose attribute has the name, whatever the order of its attributes; '' where there is none."""
    pattern = f"(?is)<meta\\b(?=[^>]*\\b{attribute}\\s*=\\s*['\"]{name}['\"])[^>]*\\bcontent\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)')"
    text = F.coalesce(F.col(html), F.lit(""))
    found = F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
    return F.trim(F.regexp_replace(decoded(found), "\\s+", " "))


def target_url(href: Column, redirect_host: str, redirect_path: str, key: str) -> Column:
    """Where a search result's link leads: the address packed in a redirect of the search host, else the link itself; '' for
    links that lead nowhere or stay on the search host."""
    plain = F.trim(decoded(F.coalesce(href, F.lit(""))))
    whole = F.when(F.startswith(plain, F.lit("//")), F.concat(F.lit("https:"), plain)).otherwise(plain)
    host = F.coalesce(F.regexp_extract(whole, "^https?://([^/?#]*)", 1), F.lit(""))
    packed = F.regexp_extract(whole, f"[?&]{key}=([^&#]*)", 1)
    inner = F.coalesce(F.try_url_decode(packed), F.lit(""))
    target = F.when(F.contains(host, F.lit(redirect_host)) & F.contains(whole, F.lit(redirect_host + redirect_path)), inner).otherwise(whole)
    own = F.contains(F.lower(F.regexp_extract(target, "^https?://([^/?#]*)", 1)), F.lit(redirect_host))
    return F.when(F.startswith(target, F.lit("http")) & ~own, target).otherwise("")


def anchors(html: str, css_class: str) -> Column:
    """array of struct(href, title): the anchors of a class in order, whatever the order of their attributes."""
    tag = f"(?is)<a\\b(?=[^>]*\\bclass=\"[^\"]*{css_class}[^\"]*\")[^>]*\\bhref=\"([^\"]+)\"[^>]*>(.*?)</a>"
    text = F.coalesce(F.col(html), F.lit(""))
    hrefs, titles = F.regexp_extract_all(text, F.lit(tag), F.lit(1)), F.regexp_extract_all(text, F.lit(tag), F.lit(2))
    clean = lambda t: F.trim(F.regexp_replace(decoded(F.regexp_replace(t, "<[^>]+>", " ")), "\\s+", " "))
    return F.zip_with(hrefs, titles, lambda h, t: F.struct(h.alias("href"), clean(t).alias("title")))


def region_named(text: str) -> Column:
    """The region that a text names after the word for it, '' for none."""
    found = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), "(?iu)(?:регион|region)\\s*[:\\-–]?\\s*([A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё \\-]{2,40})", 1)
    return F.trim(F.regexp_replace(found, "\\s+", " "))


def joined_text(parts: list[Column], limit: int) -> Column:
    """The distinct parts that are not blank, blank runs as one, in one text of at most `limit` characters."""
    flat = [F.trim(F.regexp_replace(F.coalesce(p, F.lit("")), "\\s+", " ")) for p in parts]
    return F.substring(F.array_join(F.array_distinct(F.filter(F.array(*flat), lambda x: x != "")), " "), 1, limit)
