"""Malformed JSON lines: strict parse, then a ladder of repairs on the rows that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions import fixed
from pressmill.functions.binding import bind
from pressmill.functions.urls import repair_scheme
from pressmill.sources.lines import is_blank


_END = "\u0001end of line\u0001"
_END_ESCAPED = _END.replace("\u0001", "\\u0001")


def parse_strict(c: Column) -> Column:
    """The value as VARIANT, NULL unless the whole of it is one JSON value.

    The parser stops after the first complete value, so the text becomes the first of two
    elements: text after the value, or a bracket closing the list early, loses the second one.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), c, F.lit(f', "{_END_ESCAPED}"]')))
    return bind(
        boxed,
        lambda b: F.when(
            F.try_variant_get(b, "$[1]", "string") == _END, F.try_variant_get(b, "$[0]", "variant")
        ),
    )


def repair_unicode(c: Column) -> Column:
    """Typographic characters to plain ones, control characters away."""
    for old, new in fixed.JSON_TEXT_REPLACEMENTS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(c, fixed.JSON_CONTROL, "")


# A string after a colon ends at a quote followed by , } ] or the end; elsewhere it is a key,
# or an element of a list, and may end before a colon as well.  Groups are possessive, so texts of any
# length need no stack; other text is taken in runs without quote and colon, which can't begin a string.
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PLAIN = r'(?:[^"\\]++|\\.)*+'
_OPENING = rf':[{_SPACE}\[]*+"'


def _string(ends: str) -> str:
    return rf'{_PLAIN}(?:"(?![{_SPACE}]*+(?:[{ends}]|\z)){_PLAIN})*+"'


_PARTS = rf'(?s){_OPENING}{_string(r",}\]")}|"{_string(r":,}\]")}|[^":]++|.'


def repair_quotes(c: Column) -> Column:
    """Escape quotes inside strings.  NULLs pass through untouched, so callers send only bad rows."""

    def escaped(part: Column) -> Column:
        head = F.length(F.regexp_extract(part, f'^(?:{_OPENING}|")', 0))
        body = F.regexp_replace(F.substr(part, head + 1, F.length(part) - head - 1), rf'(?s)\G({_PLAIN})"', '$1\\\\"')
        return F.when((head > 0) & (F.length(part) > head), F.concat(F.substr(part, F.lit(1), head), body, F.lit('"'))).otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PARTS), F.lit(0)), escaped), "")


def _field(c: Column, name: str, body: str) -> Column:
    pattern = f'"{name}"{fixed.WS}*:{fixed.WS}*"({body})"'
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def salvage_fields(c: Column) -> Column:
    """Last resort: ``document_id`` and ``text`` by pattern, plus five optional string fields.

    The text runs to the first quote before a comma or closing brace, else to the end.
    """
    doc = _field(c, "document_id", '[^"]+')
    opening = f'"text"{fixed.WS}*:{fixed.WS}*"'
    rest = F.regexp_replace(c, f"(?s)^.*?{opening}", "")
    # An escape is skipped as a pair: an even run of backslashes leaves the quote bare.
    body = F.split(rest, '(?<!\\\\)(?:\\\\\\\\)*+"[ \\t\\n\\r]*[,}]', 2).getItem(0)
    dropped = F.regexp_extract(F.substr(rest, F.length(body) + 1), '^\\\\*', 0)
    text = F.when(c.rlike(opening), F.concat(body, dropped))
    pairs = [("document_id", doc), ("text", text)]
    pairs += [(name, _field(c, name, '[^"]*')) for name in fixed.SALVAGE_FIELDS]
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]),
        lambda e: e["value"].isNotNull(),
    )
    usable = doc.isNotNull() & text.isNotNull()
    return F.when(usable, F.parse_json(F.to_json(F.map_from_entries(entries))))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``document`` (VARIANT), ``repair_strategy`` and ``parse_error``.

    Each rung sees only what the rungs before it left: its input is NULL for settled rows, so
    sound lines never leave the JVM.
    """
    source = F.regexp_replace(F.col(value), f"^{fixed.WS}+|{fixed.WS}+$", "")
    blank = is_blank(F.col(value))
    df = lines.withColumn("_line", F.when(~blank, source)).withColumn("_strict", parse_strict(F.col("_line")))
    bad = F.when(F.col("_strict").isNull(), F.col("_line"))
    df = df.withColumn("_plain", repair_unicode(bad))
    df = df.withColumn("_q", repair_quotes(bad)).withColumn(
        "_qp",
        repair_quotes(F.when(~F.col("_plain").eqNullSafe(F.col("_line")), F.col("_plain"))),
    )
    df = (
        df.withColumn("_r2", parse_strict(F.col("_q")))
        .withColumn("_r3", F.when(F.col("_r2").isNull(), parse_strict(F.col("_plain"))))
        .withColumn(
            "_r4", F.when(F.col("_r2").isNull() & F.col("_r3").isNull(), parse_strict(F.col("_qp")))
        )
    )
    settled = F.coalesce("_strict", "_r2", "_r3", "_r4")
    df = df.withColumn("_r5", F.when(settled.isNull(), salvage_fields(F.col("_line"))))
    rungs = [("strict", "_strict"), ("quotes", "_r2"), ("unicode", "_r3"), ("combined", "_r4"), ("salvage", "_r5")]
    strategy = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in rungs])
    return (
        df.withColumn("document", F.coalesce(settled, "_r5"))
        .withColumn("repair_strategy", strategy)
        .withColumn(
            "parse_error",
            F.when(blank, fixed.EMPTY_LINE).when(
                strategy.isNull(), F.lit(f"{fixed.ALL_FAILED}. Not a JSON value")
            ),
        )
        .drop("_line", "_strict", "_plain", "_q", "_qp", "_r2", "_r3", "_r4", "_r5")
    )


def repaired_url(document: Column, name: str = "source_url") -> Column:
    """A URL field of the parsed document with its scheme mended."""
    return repair_scheme(F.try_variant_get(document, f"$.{name}", "string"))
