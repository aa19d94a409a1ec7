"""Bytes: data URLs, hashes, and the checks of a resource's head."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty
from .urls import percent_decoded


def utf8(c: Column) -> Column:
    return F.encode(text_or_empty(c), "UTF-8")


def sha256_hex(c: Column) -> Column:
    return F.sha2(utf8(c), 256)


def crc32_of(c: Column) -> Column:
    return F.crc32(utf8(c))


def utf8_size(c: Column) -> Column:
    return F.octet_length(utf8(c)).cast("long")


def decode_data_url(url: Column) -> Column:
    """struct(mime, bytes, error). Not base64: percent-decoded, a byte for each character. No comma: an error."""
    at = F.instr(text_or_empty(url), ",")
    head, body = F.substring(url, F.lit(1), at - 1), F.substring(url, at + 1, F.length(url))
    mime = F.coalesce(F.nullif(F.regexp_extract(head, r"(?i)^data:([^;,]+)", 1), F.lit("")), F.lit("image/jpeg"))
    plain = F.encode(percent_decoded(body), "ISO-8859-1")
    data = F.when(head.rlike("(?i);base64"), F.try_to_binary(body, F.lit("base64"))).otherwise(plain)
    error = F.when(at == 0, "no comma in the data URL").when(data.isNull(), "the body can't be decoded")
    return F.struct(F.when(error.isNull(), mime).alias("mime"), F.when(error.isNull(), data).alias("bytes"), error.alias("error"))


def encode_data_url(data: Column, mime: Column) -> Column:
    kind = F.coalesce(F.nullif(mime, F.lit("")), F.lit("application/octet-stream"))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"[\r\n]", ""))


def resource_error(data: Column, mime: Column, name: Column, expected: Column) -> Column:
    """Why a resource is not what its name says; null if it is. Size first, then the head, then a page sent instead."""
    head, name = F.hex(F.substring(data, 1, 8)), text_or_empty(name)
    return (
        F.when((expected > 0) & (F.octet_length(data) != expected), F.concat(F.lit("unexpected size: "), F.octet_length(data), F.lit(", expected "), expected))
        .when(name.rlike(r"(?i)\.png$") & (head != "89504E470D0A1A0A"), "no PNG head")
        .when(name.rlike(r"(?i)\.(?:zip|xpi|docx|xlsx|pptx)$") & ~head.rlike("^504B0[357]"), "no ZIP head")
        .when(name.rlike(r"(?i)\.jpe?g$") & ~head.startswith("FFD8FF"), "no JPEG head")
        .when(name.rlike(r"(?i)\.pdf$") & ~head.startswith("255044462D"), "no PDF head")
        .when(text_or_empty(mime).rlike("(?i)text/html") & ~name.rlike(r"(?i)\.html?$"), "a page instead of the file")
    )
