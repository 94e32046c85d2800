"""Which kinds of items a search or grep looks at."""

from __future__ import annotations

from pyspark.sql import Column

MESSAGES = ("user_message", "agent_message")
THINKING = ("reasoning_summary",)
TOOLS = ("command_execution", "web_search", "mcp_tool_call")


def kinds(thinking: bool = False, tools: bool = False) -> list[str]:
    """Messages always; reasoning and tools on demand; changed files and other kinds never."""
    return [*MESSAGES, *(THINKING if thinking else ()), *(TOOLS if tools else ())]


def in_scope(kind: Column, thinking: bool = False, tools: bool = False) -> Column:
    return kind.isin(kinds(thinking, tools))
