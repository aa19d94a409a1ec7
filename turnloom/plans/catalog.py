"""The registry of queries, and the derived inputs that Spark and the SQL oracle share as one text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TABLES = ("conversations", "pages", "events", "documents")

#: Derived inputs, in SQL that both engines read. {name} is a table or another input.
INPUTS = {
    "messy": """SELECT conv_id, turn, role, concat('  ', replace(text, ' a ', concat(' ', chr(9), chr(10), chr(10), '  ', chr(10), chr(10), chr(10), chr(10), 'a', chr(160))), chr(10), ' ') AS text FROM {conversations}""",
    "rich": """SELECT conv_id, turn, role, concat('# <', role, '> & "', text, '" ', CASE WHEN turn % 3 = 0 THEN concat('```', chr(10), 'x_y*z', chr(10), '````') ELSE '[a](b) it''s' END, CASE WHEN turn % 2 = 0 THEN chr(10) ELSE '' END) AS text,
        CASE turn % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'c++' WHEN 2 THEN 'py thon!' ELSE NULL END AS language FROM {conversations}""",
    "gaps": """SELECT conv_id, turn, role, text FROM {conversations} WHERE (conv_id * 7 + turn) % 5 <> 0""",
    "captures": """SELECT conv_id, concat('t', turn) AS turn_id, CAST(0 AS int) AS capture_seq, 'mounted' AS source, CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(turn AS int) END AS order_hint, role, substr(text, 1, CAST(floor(length(text) / 2) AS int)) AS text, CAST(turn AS int) AS turn FROM {conversations}
        UNION ALL SELECT conv_id, concat('t', turn), CAST(1 AS int), 'mounted', CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(turn AS int) END, role, text, CAST(turn AS int) FROM {conversations}
        UNION ALL SELECT conv_id, concat('t', turn), CAST(2 AS int), 'evicted', CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(turn AS int) END, role, text, CAST(turn AS int) FROM {conversations} WHERE turn % 2 = 0""",
    "links": """SELECT page_id, CASE page_id % 9
        WHEN 0 THEN concat('https://chatgpt.com/c/', lpad(CAST(page_id AS string), 24, 'a'), '?token=s', CAST(page_id AS string), '&page=2')
        WHEN 1 THEN concat('https://claude.ai/chat/x?SIG=abc', CAST(page_id AS string), '&amp;Key=1&x=2#sig=frag')
        WHEN 2 THEN concat('https://files.oaiusercontent.com/a/report%20', CAST(page_id AS string), '.pdf?%74oken=1&a=2')
        WHEN 3 THEN concat('sandbox:/mnt/data/part', CAST(page_id AS string), '.html')
        WHEN 4 THEN 'https://github.com/org/repo/blob/main/README.md'
        WHEN 5 THEN concat(url, '?%zz=secret&q=a+b')
        WHEN 6 THEN concat('https://docs.example.org/guide/page', CAST(page_id AS string), '.html')
        WHEN 7 THEN concat('https://user:pw@cdn.openai.com/x/y.JPEG?auth=', CAST(page_id AS string))
        ELSE url END AS url, page_id % 5 = 0 AS download, page_id % 7 = 0 AS cited FROM {pages}""",
    "files": """SELECT conv_id, turn, role, concat('t', turn) AS turn_id, CASE turn % 4 WHEN 0 THEN concat('https://files.example.org/', conv_id, '/', turn, '.txt?sig=1') WHEN 1 THEN NULL ELSE concat('https://files.example.org/', conv_id, '/shared.pdf') END AS href,
        concat('Report ', turn % 3, CASE turn % 4 WHEN 0 THEN '.txt' ELSE '.pdf' END) AS name, CASE turn % 4 WHEN 1 THEN 'ui_attachment' ELSE 'linked_file' END AS kind FROM {conversations}""",
    "blobs": """SELECT conv_id, concat('https://files.example.org/', conv_id, '/', turn, '.txt?sig=1') AS url, 'text/plain' AS mime, concat('body ', text) AS body FROM {conversations} WHERE turn % 8 = 0
        UNION ALL SELECT conv_id, concat('https://files.example.org/', conv_id, '/shared.pdf'), 'application/pdf', concat(CASE WHEN min(conv_id) % 3 = 0 THEN 'oops' ELSE '%PDF-1.7 ' END, max(text)) FROM {conversations} GROUP BY conv_id""",
    "tiles": """SELECT conv_id, concat('t', turn) AS turn_id, CAST(turn AS int) AS turn_ordinal, CAST(n AS int) AS tile, concat('Turno ', turn, ' vista ', n) AS label, CAST(5000 - 400 * n AS int) AS bottom, CAST(700 AS int) AS height
        FROM (SELECT conv_id, turn, {EACH}(CAST(1 AS bigint), CAST((turn * 3 + conv_id) % 15 + 1 AS bigint))) AS n FROM {conversations}) t""",
    "entries": """SELECT conv_id, concat('turns/', lpad(CAST(turn AS string), 4, '0'), '.md') AS path, text AS data FROM {conversations}""",
    "changes": """SELECT event_id, CAST(ts AS timestamp) AS ts, CAST(user_id AS string) AS turn_id, event_type AS signature, event_type = 'view' AS empty FROM {events}""",
}


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


#: How each engine makes a row for every number from one to another.
EACH, EACH_DUCK = "explode(sequence", "unnest(generate_series"


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a derived input."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = INPUTS[name]
    return spark.sql(text.replace("{EACH}", EACH), **{x: given(spark, sf_dir, x) for x in (*TABLES, *INPUTS) if f"{{{x}}}" in text})


def _filled(text: str) -> str:
    text = text.replace("{EACH}", EACH_DUCK)
    for x in (*TABLES, *INPUTS):
        if f"{{{x}}}" in text:
            text = text.replace(f"{{{x}}}", duck(x))
    return text


def duck(name: str) -> str:
    """The same input as a subquery of the oracle."""
    if name in TABLES:
        return name
    text = INPUTS[name]
    return f"({_filled(text)})"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir); {name} in its SQL is an input."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = _filled(sql)
        return f

    return add
