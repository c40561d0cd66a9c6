"""Cleaning as one expression per document: no shuffle, so it serves batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdloom.functions.text import (
    MAX_CELL,
    MAX_COLS,
    MAX_SUBHEADERS,
    MIN_WIDTH,
    RECORD_BREAK,
    bold0,
    bound,
    cleanup_whitespace,
    col,
    field_text,
    is_all_bold,
    is_blank_cell,
    is_separator,
    is_table_line,
    normalize_endings,
    pad_cell,
    separator_cell,
    split_cells,
    split_lines,
)


def places(n: Column) -> Column:
    """n zeros, to be transformed by position."""
    return F.array_repeat(F.lit(0), n.cast("int"))


def parse_rows(lines: Column) -> Column:
    """Lines of a table block to structs (is_sep, cells); a separator has no cells."""
    none = F.array().cast("array<string>")
    return F.transform(lines, lambda x: bound(is_separator(x), lambda s: F.struct(s.alias("is_sep"), F.when(s, none).otherwise(split_cells(x)).alias("cells"))))


def data_of(rows: Column) -> Column:
    return F.filter(rows, lambda r: ~r["is_sep"])["cells"]


def width_of(data: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(data, F.size)), F.lit(0))


def is_complex(data: Column, max_cols: int = MAX_COLS, max_cell: int = MAX_CELL) -> Column:
    return (width_of(data) > max_cols) | F.exists(data, lambda c: F.exists(c, lambda x: F.length(x) > max_cell))


def empty_mask(data: Column) -> Column:
    return F.transform(places(width_of(data)), lambda _, i: ~F.exists(data, lambda c: ~is_blank_cell(F.coalesce(F.get(c, i), F.lit("")))))


def rebuild(rows: Column) -> Column:
    """Rows back to lines of even width; empty if no column is left."""

    def lined(n: Column) -> Column:
        data = data_of(rows)
        widths = F.transform(places(n), lambda _, i: F.greatest(F.lit(MIN_WIDTH), F.coalesce(F.array_max(F.transform(data, lambda c: F.length(F.get(c, i)))), F.lit(0))))

        def line(w: Column) -> Column:
            rule = F.array_join(F.transform(w, separator_cell), "|")
            text = lambda r: F.array_join(F.transform(w, lambda x, i: pad_cell(F.get(r["cells"], i), x)), "|")
            return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("|"), F.when(r["is_sep"], rule).otherwise(text(r)), F.lit("|"))), "\n")

        return F.when(n == 0, "").otherwise(bound(widths, line))

    return bound(width_of(data_of(rows)), lined)


def without_columns(rows: Column, mask: Column) -> Column:
    keep = lambda r: F.filter(r["cells"], lambda _, i: ~F.coalesce(F.get(mask, i), F.lit(False)))
    return F.transform(rows, lambda r: F.struct(r["is_sep"].alias("is_sep"), keep(r).alias("cells")))


def n_subheaders(data: Column, most: int = MAX_SUBHEADERS) -> Column:
    """How many data rows right below the header are bold in all of their cells, at most so many."""

    def counted(bold: Column) -> Column:
        n_sub = F.size(bold)
        for i in range(most - 1, -1, -1):
            n_sub = F.when(~F.coalesce(F.get(bold, F.lit(i)), F.lit(False)), i).otherwise(n_sub)
        return n_sub

    return bound(F.transform(F.slice(data, 2, most), is_all_bold), counted)


def column_names(data: Column, n_sub: Column) -> Column:
    """Per column, its name from the header, else from the first sub-header row that names it; null if none."""

    def named(heads: Column) -> Column:
        name = lambda i: F.get(F.filter(F.transform(heads, lambda h: bold0(F.get(h, i))), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
        return F.transform(places(width_of(data)), lambda _, i: name(i))

    return bound(F.slice(data, F.lit(1), n_sub + 1), named)


def structured_list(data: Column) -> Column:
    """Data rows to records of fields; empty if there is no record."""

    def with_names(n_sub: Column) -> Column:
        def records(names: Column) -> Column:
            body = F.filter(F.slice(data, n_sub + 2, F.size(data)), lambda c: F.exists(c, lambda x: ~is_blank_cell(x)))
            fields = lambda c: F.filter(F.transform(c, lambda x, i: F.when(~is_blank_cell(x), field_text(F.get(names, i), x))), lambda x: x.isNotNull())
            return F.array_join(F.transform(body, lambda c: F.array_join(fields(c), "\n")), RECORD_BREAK)

        return bound(column_names(data, n_sub), records)

    return F.when(F.size(data) == 0, "").otherwise(bound(n_subheaders(data), with_names))


def outcome(text: Column, action: Column | str | None = None) -> Column:
    """What became of a block: its text, and what was done to it (null if nothing)."""
    return F.struct(text.alias("text"), (F.lit(action) if action is None or isinstance(action, str) else action).cast("string").alias("action"))


def clean_block(lines: Column, max_cols: int = MAX_COLS, max_cell: int = MAX_CELL) -> Column:
    """One run of table lines by the routes R1 to R5: a struct of its text and the action (list, fallback, removed n, or null)."""
    as_is = F.array_join(lines, "\n")

    def route(rows: Column) -> Column:
        def simple(mask: Column) -> Column:
            n = F.size(F.filter(mask, lambda m: m))
            return F.when(n > 0, outcome(rebuild(without_columns(rows, mask)), F.concat(F.lit("removed "), n.cast("string")))).otherwise(outcome(as_is))

        def valid(data: Column) -> Column:
            listed = bound(structured_list(data), lambda s: F.when(s != "", outcome(s, "list")).otherwise(outcome(as_is, "fallback")))
            return F.when(is_complex(data, max_cols, max_cell), listed).otherwise(bound(empty_mask(data), simple))

        return F.when(~F.exists(rows, lambda r: r["is_sep"]), outcome(as_is)).otherwise(bound(data_of(rows), valid))

    return bound(parse_rows(lines), route)


def cleaned_parts(content: Column | str, max_cols: int = MAX_COLS, max_cell: int = MAX_CELL) -> Column:
    """The runs of a text (table lines, or others) in order, as structs (first_line from 1, text, action); documents without a table
    line pass by as one."""

    def by_runs(lines: Column) -> Column:
        def cut(flags: Column) -> Column:
            at = F.filter(F.transform(flags, lambda f, i: F.when((i == 0) | (f != F.get(flags, i - 1)), i)), lambda i: i.isNotNull())

            def runs(starts: Column) -> Column:
                end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(lines))
                made = lambda s, x: F.when(F.get(flags, s), clean_block(x, max_cols, max_cell)).otherwise(outcome(F.array_join(x, "\n")))
                part = lambda s, i: bound(bound(F.slice(lines, s + 1, end(i) - s), lambda x: made(s, x)), lambda m: F.struct((s + 1).alias("first_line"), m["text"].alias("text"), m["action"].alias("action")))
                return F.transform(starts, part)

            return bound(at, runs)

        return bound(F.transform(lines, is_table_line), cut)

    def whole(x: Column) -> Column:  # bound, so that what content is made of is worked out once
        has_table = F.contains(x, F.lit("|")) & F.exists(split_lines(x), is_table_line)
        alone = F.array(F.struct(F.lit(1).alias("first_line"), x.alias("text"), F.lit(None).cast("string").alias("action")))
        return F.when(has_table, bound(split_lines(x), by_runs)).when(x.isNotNull(), alone)

    return bound(col(content), whole)


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "\n")


def clean_tables(content: Column | str, max_cols: int = MAX_COLS, max_cell: int = MAX_CELL) -> Column:
    """Every run of table lines replaced by its cleaned text."""
    return joined(cleaned_parts(content, max_cols, max_cell))


def clean_markdown(content: Column | str, max_cols: int = MAX_COLS, max_cell: int = MAX_CELL) -> Column:
    return cleanup_whitespace(clean_tables(normalize_endings(content), max_cols, max_cell))


def clean_with_audit(content: Column | str, max_cols: int = MAX_COLS, max_cell: int = MAX_CELL) -> Column:
    """The cleaned text and what was done on the way, from one pass: struct (content_clean, audit), audit being an array of (first_line,
    action) of the tables that changed or fell back, by their place in the raw text."""

    def both(parts: Column) -> Column:
        done = F.transform(F.filter(parts, lambda p: p["action"].isNotNull()), lambda p: F.struct(p["first_line"].alias("first_line"), p["action"].alias("action")))
        return F.struct(cleanup_whitespace(joined(parts)).alias("content_clean"), done.alias("audit"))

    return bound(cleaned_parts(normalize_endings(content), max_cols, max_cell), both)


def audit_metrics(audit: Column | str) -> list[Column]:
    """Aggregates of an audit column for DataFrame.observe: documents and tables by action, counted while the rows are written."""
    of = lambda a: F.coalesce(F.sum(F.size(F.filter(col(audit), lambda x: x["action"].startswith(a)))), F.lit(0))
    return [F.count("*").alias("documents"), *(of(a).alias(a) for a in ("list", "fallback", "removed"))]


def block_facts(lines: Column, first_line: Column, max_cols: int = MAX_COLS, max_cell: int = MAX_CELL) -> Column:
    """What table_stats tells of one run of table lines, as a struct."""

    def of_rows(rows: Column) -> Column:
        def of_data(data: Column) -> Column:
            n = F.size(lines)
            behind = F.array_position(F.reverse(F.transform(rows, lambda r: r["is_sep"])), True)
            last_sep = F.when(behind == 0, -1).otherwise(n - behind).cast("int")
            longest = F.coalesce(F.array_max(F.transform(data, lambda c: F.array_max(F.transform(c, F.length)))), F.lit(0))
            n_empty = F.size(F.filter(empty_mask(data), lambda m: m)).cast("long")
            sizes = F.struct(last_sep.alias("last_sep_row"), width_of(data).alias("n_cols"), longest.alias("max_cell_len"), n_empty.alias("n_empty_cols"))

            def told(x: Column) -> Column:
                wide = (x["n_cols"] > max_cols) | (x["max_cell_len"] > max_cell)
                listed = F.when(structured_list(data) != "", "R2").otherwise("R3")
                route = F.when(x["last_sep_row"] < 0, "R1").when(wide, listed).when(x["n_empty_cols"] > 0, "R4").otherwise("R5")
                own = [x[c].alias(c) for c in ("last_sep_row", "n_cols", "max_cell_len", "n_empty_cols")]
                return F.struct(first_line.alias("first_line"), (first_line + n - 1).alias("last_line"), n.cast("long").alias("n_lines"), *own, wide.alias("is_complex"), route.alias("route"))

            return bound(sizes, told)

        return bound(data_of(rows), of_data)

    return bound(parse_rows(lines), of_rows)


def table_facts(content: Column | str, max_cols: int = MAX_COLS, max_cell: int = MAX_CELL) -> Column:
    """The facts of a text's table blocks in order (block_facts), as an array; without a shuffle or a sort."""

    def by_lines(lines: Column) -> Column:
        def by_flags(flags: Column) -> Column:
            opens = F.filter(F.transform(flags, lambda f, i: F.when(f & ((i == 0) | ~F.coalesce(F.get(flags, i - 1), F.lit(False))), i)), lambda i: i.isNotNull())
            closes = F.filter(F.transform(flags, lambda f, i: F.when(f & ~F.coalesce(F.get(flags, i + 1), F.lit(False)), i)), lambda i: i.isNotNull())

            def facts(ends: Column) -> Column:
                return F.transform(opens, lambda a, k: bound(F.slice(lines, a + 1, F.get(ends, k) - a + 1), lambda x: block_facts(x, a + 1, max_cols, max_cell)))

            return bound(closes, facts)

        return bound(F.transform(lines, is_table_line), by_flags)

    return bound(normalize_endings(content), lambda x: F.when(F.contains(x, F.lit("|")), bound(split_lines(x), by_lines)))


def table_stats(docs: DataFrame, max_cols: int = MAX_COLS, max_cell: int = MAX_CELL) -> DataFrame:
    """One row per table block of docs (doc_id, content): doc_id, table_no (from 0), and its facts; the same as the exploded form gives."""
    return docs.select("doc_id", F.posexplode(table_facts("content", max_cols, max_cell)).alias("table_no", "t")).select("doc_id", "table_no", "t.*")
