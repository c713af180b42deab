"""HTML to visible text by column expressions, and the same in SQL."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


_CLOSED = r"<{0}\b[^>]*>.*?(?:</{0}\s*>|\z)"
#: What goes in one pass from left to right, so that a comment in a script is script and a script in a comment is comment; then elements that may hold these.
RAW = "(?is)" + "|".join([r"<!--.*?(?:-->|\z)", *(_CLOSED.format(t) for t in ("script", "style"))])
UNSEEN = "(?is)" + "|".join(_CLOSED.format(t) for t in ("title", "noscript", "template"))
HEAD = "(?is)" + _CLOSED.format("head")
BREAK = r"(?is)</?(?:p|div|br|li|tr|h[1-6]|section|article|table|ul|ol|blockquote|pre)\b[^>]*(?:>|\z)"
TAG = r"(?is)</?[a-z][^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)"
PIECES = "(?i)&#?[a-z0-9]+;?|[^&]+|&"
DECIMAL, HEXADECIMAL = "^&#[0-9]{1,7};?$", "(?i)^&#x[0-9a-f]{1,6};?$"
BLANKS, ENDS = r"[ \t\x0B\f\r\p{Z}\x1C-\x1F\x85]+", "^ | $"

#: What stands for &name; and, where that is allowed, &name: the standard library's table of HTML 4.
ENTITIES = {f"&{n};": chr(c) for n, c in name2codepoint.items()} | {f"&{n}": html5[n] for n in html5 if not n.endswith(";") and n in name2codepoint}


def _decoded(piece: Column) -> Column:
    """A character reference as its character; other pieces as they are."""
    table = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    digits = F.regexp_replace(piece, "[^0-9a-fA-F]", "")
    code = F.when(piece.rlike(DECIMAL), digits.try_cast("long")).when(piece.rlike(HEXADECIMAL), F.conv(digits, 16, 10).try_cast("long"))
    there = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    number = F.when(there, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(code.isNotNull(), F.lit("�"))
    return F.when(~piece.startswith("&"), piece).otherwise(F.coalesce(number, F.try_element_at(table, piece), piece))


def visible_text(html: Column) -> Column:
    """What a reader sees: lines of text, without blank ones and with single blanks; '' for null.

    Comments, scripts, styles, titles, heads, noscript and template elements go, also unclosed ones; block tags break lines and other tags vanish, each up to its first '>';
    numeric references and the names of HTML 4 become characters, unknown ones stay. Regular expressions and array functions only: no Python runs.
    """
    text = F.coalesce(html, F.lit(""))
    for pattern, instead in ((RAW, ""), (UNSEEN, ""), (HEAD, ""), (BREAK, "\n"), (TAG, "")):
        text = F.regexp_replace(text, pattern, instead)
    text = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECES), 0), _decoded), "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, BLANKS, " "), ENDS, ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def visible_text_sql(html: str) -> str:
    """The same for DuckDB."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    text = f"coalesce({html}, '')"
    for pattern, instead in ((RAW, "''"), (UNSEEN, "''"), (HEAD, "''"), (BREAK, "chr(10)"), (TAG, "''")):
        text = f"regexp_replace({text}, {quoted(pattern)}, {instead}, 'g')"
    table = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in ENTITIES.items()) + "}"
    digits = "regexp_replace(p, '[^0-9a-fA-F]', '', 'g')"
    code = f"CASE WHEN regexp_matches(p, {quoted(DECIMAL)}) THEN TRY_CAST({digits} AS BIGINT) WHEN regexp_matches(p, {quoted(HEXADECIMAL)}) THEN TRY_CAST('0x' || {digits} AS BIGINT) END"
    number = f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr(CAST({code} AS INTEGER)) WHEN {code} IS NOT NULL THEN chr(65533) END"
    piece = f"CASE WHEN NOT starts_with(p, '&') THEN p ELSE coalesce({number}, {table}[p], p) END"
    text = f"array_to_string(list_transform(regexp_extract_all({text}, {quoted(PIECES)}), lambda p: {piece}), '')"
    line = f"regexp_replace(regexp_replace(x, {quoted(BLANKS)}, ' ', 'g'), {quoted(ENDS)}, '', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda x: {line}), lambda x: x <> ''), chr(10))"
