"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import text as T
from ..functions import urls as U
from .catalog import given, query

TRIM = r"regexp_replace({}, '^[\s\v\pZ\x{{feff}}]+|[\s\v\pZ\x{{feff}}]+$', '', 'g')"
HTTPS = r"lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))"
AUTHORITY = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
HOST = f"lower(regexp_replace(regexp_replace({AUTHORITY}, '^[^@]*@', ''), ':[0-9]+$', ''))"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
BAD_PERCENT = "regexp_matches({0}, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)')"


def clean_sql(x: str) -> str:
    return TRIM.format(rf"regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), '\n{{4,}}', repeat(chr(10), 3), 'g')")


def name_sql(x: str, fallback: str = "'archivo'") -> str:
    legal = rf"""regexp_replace(coalesce({x}, ''), '[<>:"/\\|?*\x00-\x1f]', '_', 'g')"""
    spaced = rf"regexp_replace({legal}, '[\s\v\pZ\x{{feff}}]+', ' ', 'g')"
    return f"coalesce(nullif(substr({TRIM.format(spaced)}, 1, 140), ''), {fallback})"


FNV_SQL = "printf('%08x', CAST(list_reduce(list_transform(string_split({0}, ''), lambda x: CAST(unicode(x) AS bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS bigint)) AS bigint))"
ROLE_SQL = "CASE role WHEN 'user' THEN 'Usuario' WHEN 'assistant' THEN 'Asistente' ELSE 'Elemento de conversación' END"
HTML_SQL = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"


def _simple(name: str, source: str, keys: str, sql: str, column, as_: str = "value") -> None:
    """A query of one function of one input: its keys and the function's value."""

    def run(spark, sf_dir):
        return given(spark, sf_dir, source).select(*keys.split(", "), column().alias(as_))

    query(name, f"SELECT {keys}, {sql} AS {as_} FROM {{{source}}} x")(run)


_simple("clean_text", "messy", "conv_id, turn", clean_sql("text"), lambda: T.clean_text(F.col("text")))
_simple("fnv1a32", "conversations", "conv_id, turn", FNV_SQL.format("text"), lambda: T.fnv1a32(F.col("text")))
_simple("escape_markdown", "rich", "conv_id, turn", r"regexp_replace(text, '([\\`*_{}\[\]()#+.!|>-])', '\\\1', 'g')", lambda: T.escape_markdown(F.col("text")))
_simple("escape_html", "rich", "conv_id, turn", HTML_SQL.format("text"), lambda: T.escape_html(F.col("text")))
_simple("role_label", "conversations", "conv_id, turn", ROLE_SQL, lambda: T.role_label(F.col("role")))
_simple("safe_file_name", "documents", "doc_id", name_sql("text"), lambda: T.safe_file_name(F.col("text")))
_simple(
    "visible_name", "files", "conv_id, turn",
    f"CASE WHEN turn % 5 = 0 THEN NULL ELSE lower({name_sql('name')}) END",
    lambda: T.visible_name(F.when(F.col("turn") % 5 != 0, F.concat(F.lit("C:\\dir/sub/"), "name"))),
)
_simple(
    "fence_code", "rich", "conv_id, turn",
    "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda y: length(y))), 0) + 1)) || "
    "CASE WHEN language = 'text' THEN '' ELSE regexp_replace(coalesce(language, ''), '[^\\w+.#-]', '', 'g') END || chr(10) || text || CASE WHEN text LIKE '%' || chr(10) THEN '' ELSE chr(10) END || "
    "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda y: length(y))), 0) + 1))",
    lambda: T.fence_code(F.col("text"), F.col("language")),
)
_simple("sha256_hex", "conversations", "conv_id, turn", "sha256(text)", lambda: B.sha256_hex(F.col("text")))
#: CRC-32 folded bit by bit: each byte is added to the lowest eight bits, then eight times a division step by the reversed polynomial.
_STEP = "list_reduce(list_prepend({0}, [0, 0, 0, 0, 0, 0, 0, 0]), lambda h, z: CASE WHEN h % 2 = 1 THEN xor(h // 2, 3988292384) ELSE h // 2 END)"
CRC_SQL = "xor(list_reduce(list_prepend(CAST(4294967295 AS bigint), list_transform(range(0, octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS int), 2) AS bigint))), lambda h, b: {step}), 4294967295)".format(
    step=_STEP.format("xor(h, b)")
)
_simple("crc32_of", "conversations", "conv_id, turn", CRC_SQL, lambda: B.crc32_of(F.col("text")))
_simple("utf8_size", "conversations", "conv_id, turn", "CAST(octet_length(encode(text)) AS bigint)", lambda: B.utf8_size(F.col("text")))
SECRETS_SQL = "concat('token=abc', doc_id, '; Bearer ey.S== see https://h.example/x?y at moz-extension://id-1/a.js:3 ', coalesce(text, ''))"
_simple(
    "redact_text", "documents", "doc_id",
    rf"""substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace({SECRETS_SQL}, '(?i)moz-extension://[^/\s]+', 'moz-extension://EXTENSION', 'g'), '(?i)(https?:|blob:|data:)[^\s<>"'']+', '[URL omitida]', 'g'),
    '(?i)Bearer\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [omitido]', 'g'), '(?i)((?:access[_-]?token|refresh[_-]?token|token|signature|sig|api[_-]?key)\s*[=:]\s*)[^\s&;,"'']+', '\1[omitido]', 'g'), 1, 400)""",
    lambda: T.redact_text(F.expr(SECRETS_SQL)),
)
_simple("platform_of_url", "links", "page_id", f"CASE WHEN {HOST} IN ('chatgpt.com', 'chat.openai.com') THEN 'chatgpt' WHEN {HOST} = 'claude.ai' OR {HOST} LIKE '%.claude.ai' THEN 'claude' ELSE 'unknown' END", lambda: U.platform_of_url(F.col("url")))
_simple("conversation_id_of_url", "links", "page_id", rf"nullif(regexp_extract({PATH}, '(?i)/c/([a-z0-9-]{{20,}})', 1), '')", lambda: U.conversation_id_of_url(F.col("url")))
_simple("navigation_key", "pages", "page_id", f"{HTTPS} || '://' || lower({AUTHORITY}) || coalesce(nullif({PATH}, ''), '/')", lambda: U.navigation_key(F.col("url")))
_simple("allowed_page", "links", "page_id", f"{HTTPS} = 'https' AND {HOST} IN ('chatgpt.com', 'chat.openai.com', 'claude.ai')", lambda: U.allowed_page(F.col("url")))
_simple(
    "allowed_resource", "links", "page_id",
    rf"{HTTPS} = 'https' AND NOT contains({AUTHORITY}, '@') AND regexp_full_match({HOST}, '(?:chatgpt\.com|(?:[\w-]+\.)*(?:openai\.com|oaiusercontent\.com|oaistatic\.com|anthropic\.com|claude\.ai))')",
    lambda: U.allowed_resource(F.col("url")),
)
SECRET_SQL = f"regexp_matches(lower(url_decode({{0}})), '{U.SECRET_KEY}')"
REDACT_SQL = rf"""CASE WHEN regexp_matches(url, '(?i)^https?:') THEN array_to_string(list_transform(regexp_extract_all(url, '(?is)(?:&amp;|[?&])[^=&#\s]+=[^&#\s]*|[?&]|[^?&]+'), lambda p:
    CASE WHEN regexp_extract(p, '(?is)^(?:&amp;|[?&])([^=&#\s]+)=', 1) = '' THEN p
    WHEN {BAD_PERCENT.format("regexp_extract(p, '(?is)^(?:&amp;|[?&])([^=&#\\s]+)=', 1)")} THEN regexp_extract(p, '(?i)^(&amp;|[?&])', 1) || 'redacted=REDACTED'
    WHEN {SECRET_SQL.format("regexp_extract(p, '(?is)^(?:&amp;|[?&])([^=&#\\s]+)=', 1)")} THEN regexp_extract(p, '(?is)^((?:&amp;|[?&])[^=&#\s]+=)', 1) || 'REDACTED' ELSE p END), '') ELSE url END"""
_simple("redact_url", "links", "page_id", REDACT_SQL, lambda: U.redact_url(F.col("url")))
FILE_LINK_SQL = rf"""CASE WHEN download OR regexp_matches(url, '^(sandbox|blob):') THEN true WHEN {HOST} = 'github.com' AND regexp_matches({PATH}, '/(?:blob|tree)/') THEN false WHEN cited THEN false
    WHEN regexp_matches(regexp_extract({PATH}, '([^/]*)$', 1), '(?i)\.html?$') THEN false ELSE regexp_matches(url, '{T.FILE_PATTERN}') END"""
_simple("is_file_link", "links", "page_id", FILE_LINK_SQL, lambda: U.is_file_link(F.col("url"), F.col("download"), F.col("cited")))
LAST_SQL = f"regexp_extract({PATH}, '([^/]*)/*$', 1)"
_simple(
    "basename_of_url", "links", "page_id",
    f"CASE WHEN {HTTPS} = 'sandbox' THEN {name_sql("regexp_extract(url, '([^/]*)$', 1)")} ELSE {name_sql(f'url_decode({LAST_SQL})', "'resource'")} END",
    lambda: U.basename_of_url(F.col("url"), "resource"),
)
_simple(
    "guess_extension", "links", "page_id",
    rf"CASE WHEN page_id % 4 = 0 THEN '.jpg' ELSE coalesce(nullif(lower(regexp_extract(CASE WHEN {HTTPS} = 'sandbox' THEN url ELSE {PATH} END, '(?i)\.[a-z0-9]{{1,8}}$', 0)), ''), '.bin') END",
    lambda: T.guess_extension(F.when(F.col("page_id") % 4 == 0, "Image/JPEG; q=1").otherwise("x/y"), F.col("url")),
)
_simple(
    "archive_path", "files", "conv_id, turn",
    f"CASE WHEN kind = 'linked_file' THEN 'files/' ELSE 'assets/' END || printf('%03d', turn) || '-' || {name_sql('CASE WHEN turn % 2 = 0 THEN name ELSE \'plain: name\' END')} || CASE WHEN turn % 2 = 0 THEN '' ELSE '.bin' END",
    lambda: T.archive_path(F.when(F.col("kind") == "linked_file", "file").otherwise("image"), F.col("turn"), F.when(F.col("turn") % 2 == 0, F.col("name")).otherwise("plain: name"), F.lit(".bin")),
)
_simple(
    "export_base_name", "files", "conv_id, turn",
    f"{name_sql(r"regexp_replace(name, '(?i)\.[a-z0-9]{1,8}$', '')")} || ' - 2026-01-02T03-04-05-678Z'",
    lambda: T.export_base_name(F.col("name"), F.lit("2026-01-02 03:04:05.678").cast("timestamp")),
)
_simple(
    "file_id_of", "conversations", "conv_id, turn",
    "CASE turn % 3 WHEN 0 THEN 'file_ab-' || conv_id WHEN 1 THEN 'file_12345678' || turn END",
    lambda: T.file_id_of(
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("sediment://file_ab-"), "conv_id")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" file_12345678"), "turn", F.lit(" "), "text")).otherwise(F.col("text"))
    ),
)
_simple(
    "absolute_url", "pages", "page_id",
    r"CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/a/b.png' WHEN 1 THEN 'https://cdn.example.org/x' WHEN 2 THEN 'data:text/plain,x' "
    r"ELSE regexp_replace(regexp_extract(url, '^([a-z]+://[^?#]*/)', 1), '([^/])/[^/]+/$', '\1/') || 'up.png' END",
    lambda: U.absolute_url(
        F.when(F.col("page_id") % 4 == 0, "/a/b.png").when(F.col("page_id") % 4 == 1, "https://cdn.example.org/x").when(F.col("page_id") % 4 == 2, "data:text/plain,x").otherwise("./../up.png"), F.col("url")
    ),
)


@query("encode_data_url", "SELECT conv_id, turn, 'data:' || CASE WHEN turn % 2 = 0 THEN 'text/plain' ELSE 'application/octet-stream' END || ';base64,' || base64(encode(text)) AS value FROM {conversations}")
def encode_data_url(spark, sf_dir):
    rows = given(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", B.encode_data_url(F.encode("text", "UTF-8"), F.when(F.col("turn") % 2 == 0, "text/plain")).alias("value"))


@query(
    "decode_data_url",
    "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'image/jpeg' END AS mime, CASE turn % 3 WHEN 0 THEN hex(encode(text)) WHEN 1 THEN hex(encode('a b+' || turn)) END AS hex, CASE WHEN turn % 3 = 2 THEN 'no comma in the data URL' END AS error FROM {conversations}",
)
def decode_data_url(spark, sf_dir):
    rows = given(spark, sf_dir, "conversations")
    url = F.when(F.col("turn") % 3 == 0, B.encode_data_url(F.encode("text", "UTF-8"), F.lit("text/plain"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("data:,a%20b+"), "turn")).otherwise("data:text/plain")
    got = rows.withColumn("d", B.decode_data_url(url))
    return got.select("conv_id", "turn", "d.mime", F.hex("d.bytes").alias("hex"), "d.error")
