"""URL functions on columns. A malformed URL gives null or stays as it is; nothing fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FILE_PATTERN, safe_file_name, text_or_empty

#: Hosts of the platforms whose pages are read.
HOSTS = {"chatgpt.com": "chatgpt", "chat.openai.com": "chatgpt", "claude.ai": "claude"}
LABELS = {"chatgpt": "ChatGPT", "claude": "Claude"}
TRUSTED_HOST = r"^(?:chatgpt\.com|chat\.openai\.com|claude\.ai)$"
RESOURCE_HOST = r"^(?:chatgpt\.com|chat\.openai\.com|claude\.ai|(?:[\w-]+\.)*(?:openai\.com|oaiusercontent\.com|oaistatic\.com|anthropic\.com|claude\.ai))$"

#: Query keys whose values are secret.
SECRET_KEY = (
    "^(?:token|sig|signature|auth|authorization|jwt|access_token|refresh_token|id_token|api[_-]?key|key|policy|key-pair-id|"
    "x-amz-(?:signature|credential|security-token)|x-goog-(?:signature|credential))$"
)


_PARTS = {
    "PROTOCOL": r"^([a-zA-Z][a-zA-Z0-9+.-]*):",
    "AUTHORITY": r"^[a-zA-Z][a-zA-Z0-9+.-]*:\/\/([^\/?#]*)",
    "USERINFO": r"^[a-zA-Z][a-zA-Z0-9+.-]*:\/\/([^\/?#@]*)@",
    "HOST": r"^[a-zA-Z][a-zA-Z0-9+.-]*:\/\/(?:[^\/?#@]*@)?([^\/?#:]*)",
    "PATH": r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?:\/\/[^\/?#]*)?([^?#]*)",
}


def part(url: Column, name: str) -> Column:
    """A part of a URL, as browsers part it: a stray % is no error. Null without a scheme."""
    return F.when(url.rlike(_PARTS["PROTOCOL"]), F.regexp_extract(url, _PARTS[name], 1))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def percent_decoded(c: Column) -> Column:
    """Percent-decoding in which + stays +; null if it is malformed."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def platform_of_url(url: Column) -> Column:
    h, out = host(url), F.lit("unknown")
    for name, platform in HOSTS.items():
        out = F.when(h == name, platform).otherwise(out)
    return F.when(h.endswith(".claude.ai"), "claude").otherwise(out)


def platform_label(url: Column) -> Column:
    p, out = platform_of_url(url), F.coalesce(F.nullif(host(url), F.lit("")), F.lit("Sitio desconocido"))
    for platform, label in LABELS.items():
        out = F.when(p == platform, label).otherwise(out)
    return out


def conversation_id_of_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(text_or_empty(part(url, "PATH")), r"(?i)\/c\/([a-z0-9-]{20,})", 1), F.lit(""))


def navigation_key(url: Column) -> Column:
    """Origin and path: what a page's state belongs to."""
    return F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), F.lower(part(url, "AUTHORITY")), F.coalesce(F.nullif(part(url, "PATH"), F.lit("")), F.lit("/")))


def basename_of_url(url: Column, fallback: str | Column) -> Column:
    """The decoded last part of the path as a safe name; the fallback for data URLs, malformed ones and empty paths."""
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    last = F.element_at(F.filter(F.split(part(url, "PATH"), "/"), lambda x: x != ""), -1)
    decoded = percent_decoded(F.coalesce(last, F.when(part(url, "PROTOCOL").isNotNull(), "")))
    return F.when(url.startswith("data:") | decoded.isNull(), fallback).otherwise(safe_file_name(decoded, fallback))


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, its segments . and .. resolved."""
    segments = F.split(F.substring(path, 2, F.length(path)), "/", -1)
    start = F.array().cast("array<string>")
    kept = F.aggregate(segments, start, lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    ends = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), ends)


def absolute_url(url: Column, base: Column) -> Column:
    """Resolved against the page's URL; null and empty give an empty text, and what has its own scheme stays, as all does without such a page."""
    head = r"^([a-zA-Z][a-zA-Z0-9+.-]*):(//[^/?#]*)([^?#]*)(\?[^#]*)?"
    scheme, host, path, query = (F.regexp_extract(base, head, i) for i in (1, 2, 3, 4))
    path = F.when(path == "", "/").otherwise(path)
    own = url.rlike(r"(?i)^(data:|blob:|about:|moz-extension:)|^[a-z][a-z0-9+.-]*:")
    page = F.concat(scheme, F.lit(":"), host)
    to = F.regexp_extract(url, "^[^?#]*", 0)
    rest = F.substring(url, F.length(to) + 1, F.length(url))
    folder = F.regexp_replace(path, "[^/]*$", "")
    target = F.when(to.startswith("/"), to).otherwise(F.concat(folder, to))
    return (
        F.when(text_or_empty(url) == "", "").when(own | ~F.coalesce(base.rlike(head), F.lit(False)), url).when(url.startswith("//"), F.concat(scheme, F.lit(":"), url))
        .when(url.startswith("#"), F.concat(page, path, query, url)).when(url.startswith("?"), F.concat(page, path, url)).otherwise(F.concat(page, _without_dots(target), rest))
    )



def redact_url(url: Column) -> Column:
    """Values of secret query keys of http and https URLs as REDACTED; a key that can't be decoded loses its name too.

    Pairs follow ?, & or &amp;, and end at &, # or a blank.
    """
    url = text_or_empty(url)
    pieces = F.regexp_extract_all(url, F.lit(r"(?is)(?:&amp;|[?&])[^=&#\s]+=[^&#\s]*|[?&]|[^?&]+"), F.lit(0))

    def safe(p: Column) -> Column:
        sep = F.regexp_extract(p, r"(?i)^(&amp;|[?&])", 1)
        key = F.regexp_extract(p, r"(?is)^(?:&amp;|[?&])([^=&#\s]+)=", 1)
        name = F.lower(percent_decoded(key))
        return F.when(key == "", p).when(name.isNull(), F.concat(sep, F.lit("redacted=REDACTED"))).when(name.rlike(SECRET_KEY), F.concat(sep, key, F.lit("=REDACTED"))).otherwise(p)

    return F.when(url.rlike("(?i)^https?:"), F.array_join(F.transform(pieces, safe), "")).otherwise(url)


def allowed_page(url: Column) -> Column:
    return F.coalesce((F.lower(part(url, "PROTOCOL")) == "https") & host(url).rlike(TRUSTED_HOST), F.lit(False))


def allowed_resource(url: Column) -> Column:
    user = text_or_empty(part(url, "USERINFO"))
    return F.coalesce((F.lower(part(url, "PROTOCOL")) == "https") & user.isin("", ":") & host(url).rlike(RESOURCE_HOST), F.lit(False))


def is_file_link(href: Column, download: Column, cited: Column | None = None, attachment: Column | None = None) -> Column:
    """Whether a link is a file. `download`: it has that attribute; `cited`, `attachment`: it stands in a citation, in an attachment's tile."""
    cited = F.lit(False) if cited is None else cited
    attachment = F.lit(False) if attachment is None else attachment
    h, path = host(href), text_or_empty(part(href, "PATH"))
    name = percent_decoded(F.element_at(F.split(path, "/"), -1))
    return F.coalesce(
        F.when(text_or_empty(href) == "", False)
        .when(href.rlike("(?i)^(?:javascript|vbscript):"), False)
        .when(download, True)
        .when(href.rlike("(?i)^(?:sandbox:|blob:)"), True)
        .when(part(href, "PROTOCOL").isNull(), False)
        .when(((h == "github.com") & path.rlike(r"\/(?:blob|tree)\/")) | (h == "gist.github.com"), False)
        .when(cited, False)
        .when(name.isNull(), False)
        .when(name.rlike(r"(?i)\.html?$"), h.rlike(TRUSTED_HOST) & attachment)
        .otherwise(href.rlike(FILE_PATTERN)),
        F.lit(False),
    )
