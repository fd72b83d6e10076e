"""Article validation on parsed documents, outcome tagging and the dead-letter split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions import fixed
from pressmill.functions.binding import bind, explode_rows
from pressmill.functions.urls import is_http_url, normalize_url, repair_scheme, sanitize_url, sanitize_urls
from pressmill.schema import ARTICLE_FIELDS

OUTCOMES = ["empty", "json_error", "validation_error", "ok"]
_DATE = "^\\d{4}-\\d{2}-\\d{2}(?:[T ]00:00(?::00(?:\\.0+)?)?(?:Z|[+-]00:?00)?)?$"
_WHOLE = f"^{fixed.WS}*[+-]?\\d+(?:\\.0*)?{fixed.WS}*$"
_MESSAGES = {
    "string": "must be a string",
    "date": "must be a date",
    "url": "must be an http(s) URL",
    "strings": "must be a list of strings",
    "urls": "must be a list of http(s) URLs",
    "object": "must be an object",
    "integer": "must be an integer",
}


def _texts(raw: Column) -> Column:
    return F.transform(raw.cast("array<variant>"), lambda x: x.cast("string"))


def _all_texts(raw: Column) -> Column:
    return F.forall(raw.cast("array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")


def _typed(name: str, take: str, raw: Column, kind: Column, sanitize: bool) -> Column:
    """The typed value, NULL when it is absent or does not fit."""
    text = F.when(kind == "STRING", raw.cast("string"))
    if take == "string":
        return text
    if take == "date":
        return F.when(text.rlike(_DATE), F.substring(text, 1, 10).try_cast("date"))
    if take == "integer":
        number = F.when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "BIGINT"), raw.cast("string"))
        exact = number.try_cast("decimal(38,10)")
        return (
            F.when(kind == "BOOLEAN", raw.cast("string").try_cast("boolean").cast("bigint"))
            .when(text.rlike(_WHOLE), F.regexp_replace(F.trim(text), "\\.0*$", "").try_cast("bigint"))
            .when(exact == F.floor(exact), F.floor(exact).try_cast("bigint"))
        )
    if take == "url":
        url = sanitize_url(repair_scheme(text)) if sanitize else repair_scheme(text) if name == "source_url" else text
        return bind(url, lambda u: F.when(is_http_url(u), normalize_url(u)))
    if take == "strings":
        return F.when(kind.startswith("ARRAY"), F.when(_all_texts(raw), _texts(raw)))
    if take == "urls":
        urls = F.when(kind.startswith("ARRAY"), F.when(_all_texts(raw), _texts(raw)))
        urls = sanitize_urls(urls) if sanitize else urls
        return bind(urls, lambda us: F.when(F.forall(us, is_http_url), F.transform(us, normalize_url)))
    return F.when(kind.startswith("OBJECT"), raw.cast("map<string,variant>"))


def _excused(name: str, take: str, raw: Column, kind: Column) -> Column:
    """Values that sanitising removes instead of rejecting."""
    if take == "url":
        text = F.when(kind == "STRING", raw.cast("string"))
        return sanitize_url(repair_scheme(text)).isNull()
    if take == "urls":
        fits = F.when(kind.startswith("ARRAY"), F.when(_all_texts(raw), _texts(raw)))
        return fits.isNotNull() & sanitize_urls(fits).isNull()
    return F.lit(False)


def validate_documents(parsed: DataFrame, document: str = "document", sanitize: bool = True) -> DataFrame:
    """Add the ARTICLE columns and ``errors``, one message per field that is missing or unfit.

    Unknown keys are ignored.  ``sanitize`` mends URLs first and drops those beyond repair, as
    file ingestion does; without it they are errors.
    """


    def field(raw: Column, name: str, take: str, required: bool) -> Column:
        """``struct<value, error>`` of one field; NULL where it is absent, as most are, which costs no look at its kind."""

        def judge(kind: Column, value: Column) -> Column:
            unfit = (kind != "VOID") & value.isNull()
            if sanitize and take in ("url", "urls"):
                unfit = unfit & ~_excused(name, take, raw, kind)
            if required:
                unfit = unfit | (kind == "VOID")
            return F.struct(value.alias("value"), F.when(unfit, F.lit(f"{name}: {_MESSAGES[take]}")).alias("error"))

        judged = bind(
            F.schema_of_variant(raw),
            lambda kind: bind(_typed(name, take, raw, kind, sanitize), lambda v: judge(kind, v)),
        )
        return F.when(raw.isNotNull(), judged)

    def error(checked: Column, name: str, required: bool) -> Column:
        found = checked["error"]
        return F.when(checked.isNull(), F.lit(f"{name}: field required")).otherwise(found) if required else found

    def check(doc: Column) -> Column:
        """The fields are taken out of the object in one pass."""
        taken = F.try_variant_get(doc, "$", f"struct<{', '.join(f'{n} variant' for n, *_ in ARTICLE_FIELDS)}>")
        fields = bind(taken, lambda d: F.struct(*[field(d[n], n, take, req).alias(n) for n, _, take, req in ARTICLE_FIELDS]))
        return bind(
            fields,
            lambda f: F.struct(
                *[f[n]["value"].alias(n) for n, *_ in ARTICLE_FIELDS],
                F.filter(
                    F.array(*[error(f[n], n, req) for n, _, _, req in ARTICLE_FIELDS]), lambda e: e.isNotNull()
                ).alias("errors"),
            ),
        )

    doc = F.col(document)
    is_object = F.schema_of_variant(doc).startswith("OBJECT")
    checked = parsed.withColumn("_ok", F.when(is_object, bind(doc, check)))
    errors = F.when(
        F.col("_ok").isNull() & doc.isNotNull(), F.array(F.lit("document: must be an object"))
    ).otherwise(F.coalesce(F.col("_ok.errors"), F.array().cast("array<string>")))
    return checked.select(
        *parsed.columns, *[F.col(f"_ok.{n}").alias(n) for n, *_ in ARTICLE_FIELDS], errors.alias("errors")
    )


def tag_outcome(validated: DataFrame) -> DataFrame:
    """Add ``outcome``: empty, json_error, validation_error or ok."""
    return validated.withColumn(
        "outcome",
        F.when(F.col("parse_error") == fixed.EMPTY_LINE, "empty")
        .when(F.col("parse_error").isNotNull(), "json_error")
        .when(F.size("errors") > 0, "validation_error")
        .otherwise("ok"),
    )


def default_document_id(document_id: Column, line: Column) -> Column:
    return F.coalesce(document_id, F.concat(F.lit("line-"), line.cast("string")))


def error_rows(tagged: DataFrame) -> DataFrame:
    """Dead-letter rows: file if there is one, line, document id, error type, message and a sample of the raw line.

    A filter on ``outcome`` would move below the parsing and copy all rungs and checks into its
    condition, so the rows are built where they are in error and the others are left out after that.
    """
    limit = fixed.ERROR_TEXT_LENGTH
    is_json = F.col("outcome") == "json_error"
    row = F.struct(
        *[c for c in ("file",) if c in tagged.columns],
        F.col("line").alias("line_number"),
        default_document_id(F.when(~is_json, F.col("document_id")), F.col("line")).alias("document_id"),
        F.when(is_json, "JSONDecodeError").otherwise("ValidationError").alias("error_type"),
        # At most the first three validation errors are reported.
        F.left(
            F.coalesce("parse_error", F.array_join(F.slice("errors", 1, 3), "; ")), F.lit(limit)
        ).alias("error_message"),
        F.left(F.trim("value"), F.lit(limit)).alias("raw_data_sample"),
    )
    wanted = F.when(F.col("outcome").isin("json_error", "validation_error"), row)
    return explode_rows(tagged, F.array(wanted), "_row").select("_row.*")


def validation_report(lines: DataFrame) -> DataFrame:
    """One row: total lines (blank ones included), valid and erroneous ones.  Strict JSON, no repair, no URL mending."""
    return _strictly(lines).agg(
        F.count("*").alias("total_lines"),
        F.count_if(F.col("message").isNull() & ~F.col("blank")).alias("valid"),
        F.count_if(F.col("message").isNotNull()).alias("errors"),
    )


def first_errors(lines: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` errors of the strict check by line number."""
    bad = _strictly(lines).filter(F.col("message").isNotNull())
    return bad.select("line", "message").orderBy("line").limit(n)


def _strictly(lines: DataFrame) -> DataFrame:
    from pressmill.operators.repair import parse_strict
    from pressmill.sources.lines import is_blank

    blank = is_blank(F.col("value"))
    parsed = lines.withColumn("blank", blank).withColumn("document", parse_strict(F.trim("value")))
    checked = validate_documents(parsed, sanitize=False)
    return checked.withColumn(
        "message",
        F.when(F.col("blank"), F.lit(None))
        .when(F.col("document").isNull(), F.lit("Invalid JSON"))
        .when(
            F.size("errors") > 0,
            F.concat(F.lit("Schema validation failed - "), F.size("errors").cast("string"), F.lit(" errors")),
        ),
    )


def output_contract(rows: DataFrame, required: list[str], expected: int, entities: str | None = None) -> DataFrame:
    """One row: row count, NULLs per required column, entity total and whether the output is sound."""
    aggs = [F.count("*").alias("row_count")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required]
    if entities:
        aggs.append(F.coalesce(F.sum(F.size(entities)), F.lit(0)).cast("bigint").alias("entity_count"))
    out = rows.agg(*aggs)
    sound = F.col("row_count") >= expected
    for c in required:
        sound = sound & (F.col(f"missing_{c}") == 0)
    return out.withColumn("sound", sound)


def batch_shape(documents: DataFrame, batch: str = "batch_id", interval: str | None = None) -> DataFrame:
    """Per batch: document count and whether it, and the checkpoint interval, are within bounds."""
    aggs = [F.count("*").alias("documents")]
    if interval:
        aggs.append(F.max(interval).alias("checkpoint_interval"))
    out = documents.groupBy(batch).agg(*aggs)
    fits = F.col("documents").between(fixed.BATCH_MIN_DOCUMENTS, fixed.BATCH_MAX_DOCUMENTS)
    if interval:
        fits = fits & F.coalesce(
            F.col("checkpoint_interval").between(
                fixed.CHECKPOINT_MIN_INTERVAL, fixed.CHECKPOINT_MAX_INTERVAL
            ),
            F.lit(True),
        )
    return out.withColumn("accepted", fits)
