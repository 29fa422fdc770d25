"""URLs, links and payloads as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts and address patterns that are pages, not documents.
SKIP_HOSTS = ["www.linkedin.com", "www.emerald.com", "cc.preventionweb.net"]
SKIP_PATTERNS = [r"/v\.php\?id=", r"/arise/case-studies", r"/publications/view/", r"hfa-mtr/?$", r"/home/?$", r"/home/index\.html", r"\.html?(\?|$)"]
STAMPED_HOSTS = ["preventionweb.net/", "undrr.org/"]
EXTENSIONS = [".pdf", ".docx", ".doc", ".xls", ".xlsx", ".pptx"]


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def downloadable(url: Column) -> Column:
    bad = host(url).isin(SKIP_HOSTS) | (F.regexp_replace(path(url), "/+$", "") == "")
    for p in SKIP_PATTERNS:
        bad = bad | url.rlike(p)
    return ~bad


def download_url(url: Column, day: str) -> Column:
    """Media addresses get /download; two hosts' addresses without a query get the day (yyyymmdd, a parameter)."""
    media = F.when(url.rlike(r"/media/\d+") & ~F.contains(url, F.lit("/download")), F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/download"))).otherwise(url)
    stamped = (F.contains(media, F.lit(STAMPED_HOSTS[0])) | F.contains(media, F.lit(STAMPED_HOSTS[1]))) & ~F.contains(media, F.lit("?"))
    return F.when(stamped, F.concat(media, F.lit(f"?startDownload={day}"))).otherwise(media)


def same_origin(url: Column, base: str) -> Column:
    return F.startswith(url, F.lit(base))


def sniff(head: Column, url: Column) -> Column:
    """The type by the first bytes (hex), else by the address's ending; null for none."""
    low = F.lower(F.substring_index(url, "?", 1))
    kind = F.when(F.startswith(head, F.lit("25504446")), ".pdf").when(F.startswith(head, F.lit("504B0304")), ".docx")
    for e in EXTENSIONS:
        kind = kind.when(low.endswith(e), e)
    return kind


def links(html: Column, base: str) -> Column:
    """Document links in four passes (media, .pdf, download buttons, download boxes), absolute, each once, first place kept."""
    absolute = lambda a: F.transform(a, lambda h: F.when(h.rlike("^[a-z]+://"), h).otherwise(F.concat(F.lit(base), F.regexp_replace(h, "^/*", "/"))))
    find = lambda p: F.regexp_extract_all(html, F.lit(p), F.lit(1))
    media = F.transform(find(r'<a[^>]*href="([^"]*/media/\d+(?:/download)?)"'), lambda h: F.when(h.endswith("/download"), h).otherwise(F.concat(h, F.lit("/download"))))
    pdf = find(r'(?i)<a[^>]*href="([^"]*\.pdf(?:\?[^"]*)?)"')
    button = find(r'<a(?=[^>]*(?:class="[^"]*\bdownload\b(?!-)|\sdownload[\s=>]|data-download))[^>]*href="([^"]+)"')
    box = find(r'<a(?=[^>]*class="[^"]*download-box__link)[^>]*href="([^"]+)"')
    return F.array_distinct(absolute(F.concat(media, pdf, button, box)))


def legacy_text(decoded: Column) -> Column:
    """Runs of 20 or more printable ASCII characters, then the lines of which over 30 % are letters."""
    runs = F.array_join(F.regexp_extract_all(decoded, F.lit(r"[\x20-\x7E\r\n\t]{20,}"), F.lit(0)), "\n")
    share = lambda x: F.length(F.regexp_replace(x, "[^A-Za-z]", "")) > 0.3 * F.length(x)
    return F.array_join(F.filter(F.split(runs, "\n"), lambda x: (x != "") & share(x)), "\n")


def page_text(text: Column) -> Column:
    """Four newlines or more become two."""
    return F.regexp_replace(text, "\n{4,}", "\n\n")
