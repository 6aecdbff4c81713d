"""String helpers built from JVM-side expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes at both ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Extension to MIME type, and the type for everything else.
MIME_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
    ".gif": "image/gif",
    ".bmp": "image/bmp",
}
DEFAULT_MIME_TYPE = "image/jpeg"

# Marks of a failed generation and of an HTML error page, and the canned replies.
GENERATION_ERROR_PREFIX = "Error generating response:"
HTML_MARKS = ("<!DOCTYPE html>", "<html")
UNAVAILABLE_REPLY = "Sorry, the service is currently unavailable. Please try again later."
ERROR_REPLY_PREFIX = "Sorry, I encountered an error: "


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Needed inside higher-order functions, where Spark does not share common subexpressions.
    """
    return F.transform(F.array(value), body).getItem(0)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends; ``trim`` alone removes only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def last_match(text: Column, pattern: str, group: int = 0) -> Column:
    """Last match of ``pattern`` in the whole text, null when there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.try_element_at(found, F.lit(-1))


def is_failed_response(text: Column) -> Column:
    """A generation failed when it carries the error prefix or holds nothing but whitespace."""
    value = F.coalesce(text, F.lit(""))
    return value.startswith(GENERATION_ERROR_PREFIX) | is_blank(value)


def is_url(text: Column) -> Column:
    """True when both a scheme and a network location are present."""
    return F.coalesce(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))


def file_extension(path: Column) -> Column:
    """Lower-case extension of the last path segment with its dot, ``''`` when it has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, file_extension(path)), F.lit(DEFAULT_MIME_TYPE))


def is_html_page(content: Column) -> Column:
    """Content of a reply that is an HTML page rather than an answer."""
    body = strip(content)
    return body.startswith(HTML_MARKS[0]) | body.startswith(HTML_MARKS[1])


def mentions_html(error_text: Column) -> Column:
    """Error text that carries an HTML page anywhere."""
    return error_text.contains(HTML_MARKS[0]) | error_text.contains(HTML_MARKS[1])


def reply_content(content: Column, error_text: Column) -> Column:
    """Text shown to the user for one finished call: the content, or a canned apology."""
    return (
        F.when(
            error_text.isNotNull(),
            F.when(mentions_html(error_text), F.lit(UNAVAILABLE_REPLY)).otherwise(
                F.concat(F.lit(ERROR_REPLY_PREFIX), error_text)
            ),
        )
        .when(is_html_page(content), F.lit(UNAVAILABLE_REPLY))
        .otherwise(content)
    )


def name_tail(name: Column) -> Column:
    """Last ``/`` segment of a dataset or model name."""
    return F.substring_index(name, "/", -1)


def title_case(text: Column) -> Column:
    """Capitalise the first letter of every letter run, lower-case the rest of it.

    ``initcap`` restarts only after spaces, so letter runs are separated first.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def display_name_of_folder(folder: Column) -> Column:
    return title_case(F.replace(folder, F.lit("_"), F.lit(" ")))


def repository_slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))
