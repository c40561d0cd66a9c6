"""Markdown text as column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 characters that strip() removes from text, and the same as a class for regular expressions.
WS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WS_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in WS) + "]"
#: A character that strip() removes, space and line feed aside; looked for behind what isn't printable ASCII, which most texts are free of.
ODD_WS = r"[^ -~\n](?<=" + WS_CLASS + ")"
MAX_COLS, MAX_CELL, MAX_SUBHEADERS, MIN_WIDTH = 8, 200, 3, 3
RECORD_BREAK = "\n\n---\n\n"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def strip(x: Column | str) -> Column:
    return F.trim(col(x), F.lit(WS))


def rstrip(x: Column | str) -> Column:
    return F.rtrim(col(x), F.lit(WS))


def bold0(x: Column | str) -> Column:
    return strip(F.replace(col(x), F.lit("**"), F.lit("")))


def is_blank(x: Column | str) -> Column:
    """Nothing left after stripping, bold marks aside."""
    return bold0(x) == ""


def is_blank_cell(x: Column) -> Column:
    """The same for a cell, which is stripped already."""
    return (x == "") | (F.contains(x, F.lit("**")) & (bold0(x) == ""))


def strip_parts(parts: Column, whole: Column) -> Column:
    """The parts of a text stripped; where it holds no other white space, by the much faster trim of spaces."""
    return F.when(whole.rlike(ODD_WS), F.transform(parts, strip)).otherwise(F.transform(parts, lambda p: F.trim(p)))


def normalize_endings(x: Column | str) -> Column:
    return F.regexp_replace(col(x), "\r\n?", "\n")


def split_lines(x: Column | str) -> Column:
    return F.split(col(x), "\n", -1)


def strip_line_ends(x: Column | str) -> Column:
    return F.array_join(F.transform(split_lines(x), rstrip), "\n")


def cleanup_whitespace(x: Column | str) -> Column:
    return F.regexp_replace(strip_line_ends(x), "\n{4,}", "\n\n\n")


def is_table_line(x: Column | str) -> Column:
    return F.ltrim(col(x), F.lit(WS)).startswith("|")


def is_separator(x: Column | str) -> Column:
    return strip(x).rlike(r"\A\|" + WS_CLASS[:-1] + r"\-:|]+\|\z")


def split_cells(x: Column | str) -> Column:
    """The cells of a table line: empty ends dropped, the rest stripped."""

    def inner(parts: Column) -> Column:
        first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
        last = F.when((F.size(parts) > first) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return F.slice(parts, first + 1, F.size(parts) - first - last)

    return bound(strip_parts(F.split(strip(x), r"\|", -1), col(x)), inner)


def is_all_bold(cells: Column | str) -> Column:
    full = lambda c: strip(c) != ""
    return F.exists(col(cells), full) & F.forall(F.filter(col(cells), full), lambda c: F.contains(c, F.lit("**")))


def has_marker(x: Column | str) -> Column:
    return col(x).rlike(r"\A(?:[-+]|\p{Nd}+\.)")


def format_cell(x: Column | str) -> Column:
    return strip(F.regexp_replace(col(x), " {2,}", "\n"))


def items(formatted: Column) -> Column:
    """The non-empty lines of a cell as list items."""
    lines = F.filter(F.transform(split_lines(formatted), strip), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  "), F.when(has_marker(x), x).otherwise(F.concat(F.lit("- "), x)))), "\n")


def field_text(name: Column | str, value: Column | str) -> Column:
    """A field of a record; name is empty or null if the column has none."""
    named = F.coalesce(col(name), F.lit("")) != ""
    label = F.concat(F.lit("**"), col(name), F.lit(":**"))

    def body(f: Column) -> Column:
        many = F.contains(f, F.lit("\n"))
        return (
            F.when(named & many, F.concat(label, F.lit("\n"), items(f)))
            .when(named, F.concat(label, F.lit(" "), f))
            .when(many, items(f))
            .otherwise(F.concat(F.lit("  - "), f))
        )

    return bound(format_cell(value), body)


def pad_cell(x: Column, width: Column) -> Column:
    return F.concat(F.lit(" "), F.rpad(F.coalesce(x, F.lit("")), width, " "), F.lit(" "))


def separator_cell(width: Column) -> Column:
    return F.repeat(F.lit("-"), width + 2)


def extension(name: Column | str) -> Column:
    """The last suffix with its dot; names that only start with dots have none."""
    base = F.regexp_extract(col(name), r"([^/]*)\z", 1)
    return F.regexp_extract(base, r"\A\.*[^.](?s:.*)(\.[^.]*)\z", 1)


def output_name(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"\.[^/.]+\z", ".md")


def ensure_suffix(name: Column | str) -> Column:
    return F.when(F.endswith(col(name), F.lit(".md")), col(name)).otherwise(F.concat(col(name), F.lit(".md")))


def percent_done(loaded: Column | str, total: Column | str) -> Column:
    return F.when(col(total) > 0, F.floor(col(loaded) * 100 / col(total) + 0.5))


#: The names of the stages of a job, in order.
STAGES = ("uploading", "extracting", "generating", "formatting")


def stage_index(stage: Column | str) -> Column:
    """Place in STAGES; complete is their number, anything else -1."""
    known = F.array(*map(F.lit, STAGES))
    return F.when(col(stage) == "complete", len(STAGES)).otherwise(F.coalesce(F.array_position(known, col(stage)) - 1, F.lit(-1))).cast("int")
