"""Text helpers: message text, names, paths, report lines."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the archive tool's behaviour).
# Placeholder for a post without text.
NO_MESSAGE = "No post message!"
# Characters kept by the name sanitiser besides letters and digits; all others become "_".
SANITIZE_KEEP = " _-()"
# Line breaks recognised when a message is split into lines (Python's str.splitlines set).
LINE_BREAKS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
# Indentation per reply level, the rule line drawn above each reply, and the quote prefix.
INDENT_PER_LEVEL = 5
RULE = "__________"
QUOTE_PREFIX = "> "
# Artist-name patterns tried on an original file name, in this order; every group of
# every match is a candidate (the first pattern has two groups).
ARTIST_NAME_PATTERNS = (
    r"by(?:-|_)((\w+)(?:-|_)(?:.$)?)",
    r"^([-_A-Za-z0-9]+?)(?:_|-)\d{4,}(?:_|-)",
    r"^\d{4,}_([-_A-Za-z0-9]+)_",
    r"^\d{4,}-([-_A-Za-z0-9]+)-",
    r"\d{4,}\.([-_A-Za-z0-9]+)_",
)
# Size and resolution in a file line such as "File: name.jpg (128 KB, 620x465)".
FILE_TEXT_PATTERN = r"File: .+ \(([0-9\.]+ [KMB]{1,2}), (\d+x\d+)\)"
# A character reference: decimal, hexadecimal or named.
ENTITY = r"&(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);"
# Stands for a tag while text nodes are cut out; dropped from the input first.
TAG_MARK = "\ue000"

# Python-compatible regex flags for the JVM engine: Unicode classes for \w and \d,
# and "\n" as the only line terminator for "." and "$".
PY_FLAGS = "(?Ud)"


def html_text(html: Column) -> Column:
    """Text nodes of an HTML fragment joined by newlines; entities undone."""
    return unescape(text_nodes(html))


def text_nodes(html: Column) -> Column:
    """Text nodes of an HTML fragment joined by newlines, as they are written."""
    # One mark per tag, then runs of that one character: a repeated group would recurse once
    # per tag in the JVM's regex engine and overflow its stack.
    t = F.regexp_replace(F.translate(html, TAG_MARK, ""), r"<[^>]*>", TAG_MARK)
    t = F.regexp_replace(t, TAG_MARK + "+", "\n")
    return F.regexp_replace(t, r"^\n+|\n+$", "")


def _named_entities() -> Column:
    """Names known to HTML and their characters (from the language's own table)."""
    pairs = [F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))]
    return F.create_map(*pairs, F.lit("apos"), F.lit("'"))


def referenced_character(ref: Column) -> Column:
    """The character of a reference (``&...;``); the reference itself if there is none."""
    body = F.substring(ref, F.lit(2), F.length(ref) - 2)
    digits = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)).when(
        body.startswith("#"), F.substring(body, F.lit(2), F.length(body)))
    code = digits.cast("bigint")
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.coalesce(char, F.try_element_at(_named_entities(), body), ref)


def unescape(text: Column) -> Column:
    """Character references undone, each once, from left to right."""
    refs = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    chars = F.concat(F.transform(refs, referenced_character), F.array(F.lit("")))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, ENTITY, -1), chars, lambda a, b: F.array(a, b))), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def py_strip(text: Column) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace (incl. \\x1c-\\x1f)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "")


def sanitize_name(name: Column) -> Column:
    """Keep letters, digits, space, ``_ - ( )``; replace anything else by ``_``; trim."""
    return F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _()\-]", "_"))


def strip_ext(name: Column) -> Column:
    """Drop the last ``.ext`` (a name without a dot is returned whole)."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Parent directory of a ``/``-separated relative path; ``""`` at top level."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def split_name_ext(file_name: Column) -> tuple[Column, Column]:
    """(name, ext) split at the last dot; ext is NULL when there is no dot."""
    has_dot = file_name.contains(".")
    name = F.when(has_dot, F.regexp_extract(file_name, r"^(.*)\.[^.]*$", 1))
    ext = F.when(has_dot, F.regexp_extract(file_name, r"\.([^.]*)$", 1))
    return name, ext


def normalize_rel_path(path: Column) -> Column:
    """Backslashes to ``/``, repeated and ``./`` segments removed, no leading ``/``."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(p, r"/{2,}", "/")
    p = F.regexp_replace(p, r"(^|(?<=/))(?:\./)", "")
    p = F.regexp_replace(p, r"/\.$", "")
    return F.regexp_replace(p, r"^/+", "")


def split_lines(msg: Column) -> Column:
    """``str.splitlines()``: split on every line break, no trailing empty element."""
    parts = F.split(msg, LINE_BREAKS)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)


def indent_line(line: Column, level: Column) -> Column:
    """A reply line at ``level``: ``"> "`` then ``5*level`` spaces then the line."""
    return F.concat(F.lit(QUOTE_PREFIX), F.repeat(F.lit(" "), level * INDENT_PER_LEVEL), line)


def rule_line(level: Column) -> Column:
    """Separator above a reply at ``level``: two spaces, ``5*level`` spaces, ten ``_``."""
    return F.concat(F.lit("  "), F.repeat(F.lit(" "), level * INDENT_PER_LEVEL), F.lit(RULE))


def no_message(msg: Column) -> Column:
    return F.coalesce(F.nullif(msg, F.lit("")), F.lit(NO_MESSAGE))


def artist_names(orig_name: Column) -> Column:
    """All groups of all matches of the artist patterns, in pattern order (ARRAY<STRING>)."""
    first = ARTIST_NAME_PATTERNS[0]
    g1 = F.regexp_extract_all(orig_name, F.lit(PY_FLAGS + first), 1)
    g2 = F.regexp_extract_all(orig_name, F.lit(PY_FLAGS + first), 2)
    parts = [F.flatten(F.zip_with(g1, g2, lambda a, b: F.array(a, b)))]
    for pat in ARTIST_NAME_PATTERNS[1:]:
        parts.append(F.regexp_extract_all(orig_name, F.lit(PY_FLAGS + pat), 1))
    return F.concat(*parts)


def file_text_parts(file_text: Column) -> tuple[Column, Column]:
    """(size text, ``WxH``) from a file line; NULLs when the line does not match."""
    pattern = PY_FLAGS + "^" + FILE_TEXT_PATTERN
    ok = file_text.rlike(pattern)
    size = F.when(ok, F.regexp_extract(file_text, pattern, 1))
    res = F.when(ok, F.regexp_extract(file_text, pattern, 2))
    return size, res


def report_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
