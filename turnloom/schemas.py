"""Explicit schemas of the working tables, for reads without inference."""

from __future__ import annotations

CODE_BLOCK = "struct<index: int, kind: string, language: string, label: string, text: string, source: string>"
TOOL_EXECUTION = "struct<index: int, tool: string, command: string, command_language: string, output: string, status: string>"
ACTIVITY = "struct<type: string, text: string, expanded: boolean, test_id: string>"
EXPANDABLE = "struct<label: string, expanded: boolean, aria_controls: string>"
LINK = "struct<text: string, href: string, title: string, download_name: string>"
FILE = "struct<text: string, href: string, download_name: string, kind: string, file_id: string, archive_status: string, local_path: string>"
MEDIA = "struct<kind: string, url: string, alt: string, title: string, decorative: boolean>"

#: A turn as it is published; also the shape of `turns` in an exported conversation.
TURN = (
    f"turn_id string, ordinal int, role string, model string, order_hint int, text string, markdown string, code_blocks array<{CODE_BLOCK}>, "
    f"tool_executions array<{TOOL_EXECUTION}>, activities array<{ACTIVITY}>, expandables array<{EXPANDABLE}>, links array<{LINK}>, files array<{FILE}>, media array<{MEDIA}>"
)
CONVERSATION = f"conversation_id long, schema string, schema_version string, title string, platform string, warnings array<string>, turns array<struct<{TURN.replace(' ', ': ', 0)}>>"

SOURCE_GRAPH = (
    "struct<current_node: string, mapping: map<string, struct<id: string, parent: string, message: struct<id: string, "
    "author: struct<role: string>, content: struct<parts: array<string>>, "
    "metadata: struct<attachments: array<struct<id: string, name: string, mime_type: string, size: bigint>>, "
    "citations: array<struct<file_id: string, title: string>>>>>>>"
)
