"""Chat messages for a model call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: system message used when none is configured.
DEFAULT_SYSTEM_PROMPT = (
    "You are an intelligent assistant designed to provide accurate answers and assist with various tasks."
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_messages(prompt: Column, system: Column | None = None) -> Column:
    """An optional system message and the user prompt; a null or empty system text adds none."""
    user = message("user", prompt)
    if system is None:
        return F.array(user)
    configured = F.coalesce(system, F.lit("")) != ""
    return F.when(configured, F.array(message("system", system), user)).otherwise(F.array(user))


def system_or_default(configured: Column) -> Column:
    return F.coalesce(F.nullif(configured, F.lit("")), F.lit(DEFAULT_SYSTEM_PROMPT))


def message_content(prompt: Column, image_urls: Column) -> Column:
    """Content items: the text, then one image item per URL (web address or data URL)."""

    def item(kind: Column, text: Column, url: Column) -> Column:
        return F.struct(
            kind.alias("type"),
            text.alias("text"),
            F.when(url.isNotNull(), F.struct(url.alias("url"))).alias("image_url"),
        )

    none = F.lit(None).cast("string")
    images = F.transform(image_urls, lambda url: item(F.lit("image_url"), none, url))
    text = F.array(item(F.lit("text"), prompt, none))
    return F.when(image_urls.isNull(), text).otherwise(F.concat(text, images))


def format_history(history: Column, current: Column, last: int) -> Column:
    """Last ``last`` (user, assistant) pairs as messages, then the current message.

    The start is clamped, because slicing from ``-last`` on a shorter array gives nothing.
    """
    start = F.greatest(F.size(history) - last + 1, F.lit(1))
    recent = F.slice(history, start, F.lit(last))
    turns = F.flatten(
        F.transform(
            recent,
            lambda pair: F.array(message("user", pair["user"]), message("assistant", pair["assistant"])),
        )
    )
    now = F.array(message("user", current))
    return F.when(F.size(history) > 0, F.concat(turns, now)).otherwise(now)
