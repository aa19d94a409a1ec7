"""String functions on columns: cleaning, escaping, naming, redaction, hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The extensions that mark a link as a file.
FILE_PATTERN = (
    r"(?i)\.(pdf|docx?|xlsx?|pptx?|csv|tsv|zip|xpi|7z|rar|tar|gz|json|jsonl|txt|md|rtf|py|js|mjs|cjs|ts|tsx|jsx|html?|css|xml|ya?ml|sql|ipynb|"
    r"png|jpe?g|gif|webp|svg|mp3|wav|m4a|mp4|webm|mov)($|[?#])"
)

#: Display labels of roles.
ROLE_LABELS = {"user": "Usuario", "assistant": "Asistente"}
OTHER_ROLE_LABEL = "Elemento de conversación"

#: Extension of a MIME type.
EXTENSION_OF_MIME = {
    "image/png": ".png", "image/jpeg": ".jpg", "image/webp": ".webp", "image/gif": ".gif", "image/svg+xml": ".svg",
    "video/mp4": ".mp4", "video/webm": ".webm", "audio/mpeg": ".mp3", "audio/wav": ".wav", "audio/mp4": ".m4a",
    "application/pdf": ".pdf", "application/json": ".json", "text/plain": ".txt", "text/markdown": ".md", "application/zip": ".zip", "text/csv": ".csv",
}


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim_all(c: Column) -> Column:
    """Trim every Unicode blank, not only the ASCII space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """No-break spaces as spaces, no blanks around line ends, at most three line ends in a row, trimmed; null as empty."""
    c = F.translate(text_or_empty(c), "\u00a0", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n")
    return trim_all(F.regexp_replace(c, r"\n{4,}", "\n\n\n"))


def escape_html(c: Column) -> Column:
    c = text_or_empty(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), r"([\\`*_{}\[\]()#+.!|>-])", r"\\$1")


def fence_code(body: Column, language: Column | None = None) -> Column:
    """A fence one backtick longer than the longest run inside, three at least; `text` gives no language tag."""
    body = text_or_empty(body)
    longest = F.array_max(F.transform(F.regexp_extract_all(body, F.lit("`+"), F.lit(0)), F.length))
    tick = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))
    tag = F.regexp_replace(text_or_empty(language if language is not None else F.lit("")), r"[^\w+.#-]", "")
    return F.concat(tick, F.when(tag == "text", "").otherwise(tag), F.lit("\n"), body, F.when(body.endswith("\n"), "").otherwise("\n"), tick)


def role_label(c: Column) -> Column:
    out = F.lit(OTHER_ROLE_LABEL)
    for role, label in ROLE_LABELS.items():
        out = F.when(c == role, label).otherwise(out)
    return out


def safe_file_name(c: Column, fallback: str | Column = "archivo") -> Column:
    """Illegal characters as _, runs of blanks as one space, 140 characters; an empty name gives the fallback."""
    c = F.regexp_replace(text_or_empty(c), r'[<>:"/\\|?*\x00-\x1f]', "_")
    c = F.substring(trim_all(F.regexp_replace(c, r"(?U)\s+", " ")), 1, 140)
    return F.coalesce(F.nullif(c, F.lit("")), fallback if isinstance(fallback, Column) else F.lit(fallback))


def visible_name(c: Column, match_unnamed: bool = False) -> Column:
    """The last path part as a safe lower-case name. Null for none; with `match_unnamed`, the fallback name instead."""
    last = F.element_at(F.split(text_or_empty(c), r"[\\/]"), -1)
    return F.when(F.lit(match_unnamed) | (trim_all(last) != ""), F.lower(safe_file_name(last)))


def export_base_name(title: Column, at: Column) -> Column:
    """Safe title without its extension, and a UTC time stamp whose : and . are -."""
    stamp = F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "[:.]", "-")
    return F.concat(safe_file_name(F.regexp_replace(text_or_empty(title), r"(?i)\.[a-z0-9]{1,8}$", ""), "conversation"), F.lit(" - "), stamp)


def guess_extension(mime: Column, url: Column) -> Column:
    """By MIME type, else the suffix of the URL's path (1 to 8 letters or digits), else .bin."""
    kinds = F.create_map(*[F.lit(x) for kv in EXTENSION_OF_MIME.items() for x in kv])
    suffix = F.regexp_extract(F.regexp_extract(text_or_empty(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?:\/\/[^\/?#]*)?([^?#]*)", 1), r"(?i)\.[a-z0-9]{1,8}$", 0)
    return F.coalesce(kinds[F.lower(F.split(text_or_empty(mime), ";")[0])], F.nullif(F.lower(suffix), F.lit("")), F.lit(".bin"))


def archive_path(kind: Column, index: Column, name: Column, extension: Column) -> Column:
    """files/ or assets/, a number of three digits, a safe name, its extension if it has none."""
    base = safe_file_name(name)
    base = F.when(base.rlike(r"(?i)\.[a-z0-9]{1,8}$"), base).otherwise(F.concat(base, extension))
    return F.concat(F.when(kind == "file", "files/").otherwise("assets/"), F.format_string("%03d-", index), base)


def redact_text(c: Column, limit: int = 400, strict: bool = False) -> Column:
    """Extension ids, URLs, bearer values and token-like values taken out, then cut. `strict` also takes quoted values."""
    # The patterns and what stands in their place.
    c = F.regexp_replace(text_or_empty(c), r"(?i)moz-extension:\/\/[^/\s]+", "moz-extension://EXTENSION")
    c = F.regexp_replace(c, r"(?i)(https?:|blob:|data:)[^\s<>\"']+", "[URL omitida]")
    c = F.regexp_replace(c, r"(?i)Bearer\s+[A-Za-z0-9._~+\/-]+=*", "Bearer [omitido]")
    names = r"(?i)((?:access[_-]?token|refresh[_-]?token|token|signature|sig|api[_-]?key)\s*[=:]\s*)"
    if strict:
        c = F.regexp_replace(c, names + r"\"[^\"]*\"", '$1"[omitido]"')
    return F.substring(F.regexp_replace(c, names + r"[^\s&;,\"']+", "$1[omitido]"), 1, limit)


def file_id_of(c: Column) -> Column:
    """The file id that a pointer or any text holds, else null."""
    c = text_or_empty(c)
    pointer = F.regexp_extract(c, r"(?i)^(?:file-service|sediment):\/\/(file_[a-z0-9_-]+)", 1)
    return F.coalesce(F.nullif(pointer, F.lit("")), F.nullif(F.regexp_extract(c, r"(?i)\b(file_[a-z0-9_-]{8,})\b", 1), F.lit("")))


def _fnv(texts: pd.Series) -> pd.Series:
    """All texts of a batch at once, unit by unit, longest first."""
    units = [np.frombuffer((t or "").encode("utf-16-le"), "<u2").astype(np.uint64) for t in texts]
    order = sorted(range(len(units)), key=lambda i: -len(units[i]))
    h = np.full(len(units), 2166136261, np.uint64)
    lengths = np.array([len(units[i]) for i in order])
    at, step = 0, 4096
    while len(lengths) and at < lengths[0]:
        n = int((lengths > at).sum())
        block = np.zeros((n, step), np.uint64)
        for r in range(n):
            some = units[order[r]][at : at + step]
            block[r, : len(some)] = some
        for k in range(min(step, int(lengths[0]) - at)):
            m = int((lengths > at + k).sum())
            h[:m] = ((h[:m] ^ block[:m, k]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
        at += step
    out = [""] * len(units)
    for r, i in enumerate(order):
        out[i] = f"{int(h[r]):08x}"
    return pd.Series(out, dtype=str)


#: FNV-1a (32 bits) of the UTF-16 code units, as eight hex digits; null as the empty text.
fnv1a32 = F.pandas_udf(_fnv, StringType())


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, where a score must count them."""
    return (F.octet_length(F.encode(text_or_empty(c), "UTF-16LE")) / 2).cast("long")
