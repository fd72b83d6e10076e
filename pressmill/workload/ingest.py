"""Sources, repair, validation and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressmill.functions.urls import repair_scheme, sanitize_url, sanitize_urls
from pressmill.operators import repair as R
from pressmill.operators import stats as A
from pressmill.operators import validate as V
from pressmill.plans.file_run import check_lines
from pressmill.session import new_shared_path
from pressmill.sources import lines as S
from pressmill.workload import derived as D
from pressmill.workload.base import query
from pressmill.workload.derived import table


def _text_files(spark, sf, label, partitions=4):
    """The raw lines as text files in line order, with their order kept inside each file."""
    path = new_shared_path(spark, label)
    ordered = D.raw_lines(spark, sf).repartitionByRange(partitions, "line").sortWithinPartitions("line")
    ordered.select("value").write.text(path)
    return path


@query(
    "S1 S2",
    "SELECT CAST(line AS BIGINT) AS line, kind = 6 AS blank FROM " + D.RAW_LINES,
)
def read_numbered_lines(spark, sf):
    """Lines written in order to several files: each one's number, after the files before its own."""
    numbered = S.read_lines(spark, _text_files(spark, sf, "lines"))
    sizes = numbered.groupBy("file").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    joined = numbered.join(offsets, "file")
    return joined.select((F.col("line") + F.col("before")).alias("line"), S.is_blank(F.col("value")).alias("blank"))


@query(
    "S3",
    """SELECT conv_id, turn, ok, pos AS seq, sentence FROM (
      SELECT conv_id, turn, turn % 4 <> 3 AS ok,
        CASE WHEN turn % 4 = 3 THEN [NULL] ELSE string_split(t, '. ') END AS parts
      FROM (SELECT conv_id, turn, regexp_replace(text, '[\\x00-\\x1f"\\\\\\x7f]', ' ', 'g') AS t FROM conversations)) x,
      LATERAL (SELECT unnest(x.parts) AS sentence, CASE WHEN x.ok THEN unnest(range(len(x.parts))) END AS pos)""",
)
def explode_json_batches(spark, sf):
    """Each turn is a batch of sentences; every fourth batch is no array."""
    c = table(spark, sf, "conversations")
    sentences = F.transform(F.split(D._plain(F.col("text")), "\\. "), lambda s: F.struct(s.alias("s")))
    value = F.when(F.col("turn") % 4 == 3, F.lit('{"not":"a list"}')).otherwise(F.to_json(sentences))
    items = S.explode_batch(c.select("conv_id", "turn", value.alias("documents")))
    return items.select(
        "conv_id",
        "turn",
        F.col("batch_ok").alias("ok"),
        F.col("seq").cast("bigint").alias("seq"),
        F.try_variant_get("document", "$.s", "string").alias("sentence"),
    )


@query("S4", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed_rows(spark, sf):
    done = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("processed"))
    marked = table(spark, sf, "documents").join(done, "doc_id", "left")
    flagged = marked.withColumn("processed", F.coalesce("processed", F.lit(False)))
    return S.unprocessed(flagged).select("doc_id", "source")


# --- repair -----------------------------------------------------------------------------------


@query(
    "R1 R2 R4 R6 R7 V1 V5",
    f"""SELECT line, strategy, document_id, title, text, source_url, outcome, errors FROM {D.EXPECTED_LINES}""",
)
def repair_and_validate_lines(spark, sf):
    """Eleven kinds of lines through the whole ladder and the article check."""
    checked = check_lines(D.raw_lines(spark, sf))
    settled = F.col("outcome").isin("ok", "validation_error")
    return checked.select(
        "line",
        F.when(settled | F.col("repair_strategy").isNotNull(), F.col("repair_strategy")).alias("strategy"),
        "document_id",
        "title",
        "text",
        "source_url",
        "outcome",
        F.array_join("errors", "|").alias("errors"),
    )


@query(
    "R1",
    "SELECT line, kind IN (0, 7, 8, 9, 10) AS sound FROM " + D.EXPECTED_LINES,
)
def strict_parse(spark, sf):
    return D.raw_lines(spark, sf).select("line", R.parse_strict(F.col("value")).isNotNull().alias("sound"))


@query(
    "R2",
    """SELECT line, '{"document_id":"d' || doc_id || '","title":"The \\"' || source || '\\" desk","tags":["a \\"b\\" c","d"],"text":"'
      || body || '"}' AS value FROM """
    + D.RAW_LINES,
)
def repair_inner_quotes(spark, sf):
    d = table(spark, sf, "documents")
    value = F.concat(
        F.lit('{"document_id":"d'),
        F.col("doc_id").cast("string"),
        F.lit('","title":"The "'),
        "source",
        F.lit('" desk","tags":["a "b" c","d"],"text":"'),
        D._plain(F.col("text")),
        F.lit('"}'),
    )
    return d.select((F.col("doc_id") + 1).alias("line"), R.repair_quotes(value).alias("value"))


@query(
    "R3",
    f"SELECT l_orderkey, l_partkey, l_linenumber, {D.sql_json_unicode('text')} AS value FROM {D.RECEIPTS}",
)
def repair_typography(spark, sf):
    return D.receipts(spark, sf).select(
        "l_orderkey", "l_partkey", "l_linenumber", R.repair_unicode(F.col("text")).alias("value")
    )


@query(
    "R5",
    """SELECT line, kind IN (0,1,2,3,4,7) AS usable, CASE WHEN kind IN (0,1,2,3,4,7) THEN 'd' || doc_id END AS document_id,
      CASE WHEN kind IN (0,1,2,3,7) THEN body WHEN kind = 4 THEN body || '"' END AS text,
      CASE kind WHEN 0 THEN 'From ' || source WHEN 1 THEN 'The ' WHEN 2 THEN 'Tab' || chr(1) || source WHEN 3 THEN 'A ' END AS title
    FROM """
    + D.RAW_LINES,
)
def salvage_fields(spark, sf):
    """The last resort on every line, sound or not."""
    df = D.raw_lines(spark, sf).withColumn("doc", R.salvage_fields(F.col("value")))
    return df.select(
        "line",
        F.col("doc").isNotNull().alias("usable"),
        *[F.try_variant_get("doc", f"$.{n}", "string").alias(n) for n in ("document_id", "text", "title")],
    )


_BAD_URL = """CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?', 'httpss')
  WHEN 2 THEN regexp_replace(url, '^https?', 'httpp') WHEN 3 THEN regexp_replace(url, '^https?', 'ftp')
  WHEN 4 THEN '  ' || regexp_replace(url, '^https?://', '') ELSE 'page' || page_id END"""


def _bad_urls(spark, sf):
    url = F.col("url")
    kinds = [
        url,
        F.regexp_replace(url, "^https?", "httpss"),
        F.regexp_replace(url, "^https?", "httpp"),
        F.regexp_replace(url, "^https?", "ftp"),
        F.concat(F.lit("  "), F.regexp_replace(url, "^https?://", "")),
        F.concat(F.lit("page"), F.col("page_id").cast("string")),
    ]
    bad = F.get(F.array(*kinds), F.pmod("page_id", F.lit(6)).cast("int"))
    return table(spark, sf, "pages").select("page_id", bad.alias("url"))


@query(
    "R7",
    f"""SELECT page_id, CASE WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') THEN u
      WHEN contains(u, '://') THEN 'https://' || substr(u, strpos(u, '://') + 3) ELSE u END AS url
    FROM (SELECT page_id, replace(replace(replace({_BAD_URL}, 'httpss://', 'https://'), 'httpp://', 'http://'), 'httpps://', 'https://') AS u
      FROM pages)""",
)
def url_scheme_repair(spark, sf):
    return _bad_urls(spark, sf).select("page_id", repair_scheme(F.col("url")).alias("url"))


_SANE = """CASE WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') THEN u
  WHEN contains(u, '.') AND NOT starts_with(u, '//') THEN 'https://' || u END"""


@query(
    "R8",
    f"""SELECT page_id, {_SANE} AS url FROM (SELECT page_id,
      replace(replace(trim({_BAD_URL}), 'httpss://', 'https://'), 'httpps://', 'https://') AS u FROM pages)""",
)
def url_sanitize(spark, sf):
    return _bad_urls(spark, sf).select("page_id", sanitize_url(F.col("url")).alias("url"))


@query(
    "R9",
    f"""SELECT page_id, nullif(concat_ws('|', {_SANE}, CASE WHEN page_id % 2 = 0 THEN 'https://a.b/' || page_id END), '') AS urls
    FROM (SELECT page_id, replace(replace(trim({_BAD_URL}), 'httpss://', 'https://'), 'httpps://', 'https://') AS u FROM pages)""",
)
def url_list_sanitize(spark, sf):
    other = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a.b/"), F.col("page_id").cast("string"))).otherwise("none")
    urls = F.array("url", other)
    return _bad_urls(spark, sf).select("page_id", F.array_join(sanitize_urls(urls), "|").alias("urls"))


# --- validation and reports ---------------------------------------------------------------------


@query(
    "V2",
    """SELECT count(*) AS total_lines, count(*) FILTER (kind IN (0, 7)) AS valid,
      count(*) FILTER (kind NOT IN (0, 6, 7)) AS errors FROM """
    + D.RAW_LINES,
)
def strict_validation_report(spark, sf):
    """Kind 7 has a scheme that no repair sees here, so it stays valid only as far as the check goes."""
    return V.validation_report(D.raw_lines(spark, sf))


@query(
    "V2 L2",
    """SELECT line, CASE kind WHEN 8 THEN 'Schema validation failed - 2 errors' WHEN 9 THEN 'Schema validation failed - 3 errors'
      WHEN 10 THEN 'Schema validation failed - 1 errors' ELSE 'Invalid JSON' END AS message
    FROM """
    + D.RAW_LINES
    + " WHERE kind NOT IN (0, 6, 7) ORDER BY line LIMIT 10",
)
def first_ten_errors(spark, sf):
    return V.first_errors(D.raw_lines(spark, sf))


@query(
    "V5 L2",
    """SELECT line AS line_number, 'line-' || line AS document_id,
      CASE WHEN kind = 5 THEN 'JSONDecodeError' ELSE 'ValidationError' END AS error_type,
      CASE kind WHEN 5 THEN 'All parsing failed. Not a JSON value'
        WHEN 8 THEN 'document_id: must be a string; publication_date: must be a date'
        WHEN 9 THEN 'document_id: field required; text: field required; tags: must be a list of strings'
        ELSE 'document: must be an object' END AS error_message,
      CASE kind WHEN 5 THEN 'no json at all ' || doc_id WHEN 8 THEN substr('{"document_id":' || doc_id
        || ',"publication_date":"2024-13-45","text":"' || body || '"}', 1, 200)
        WHEN 9 THEN '{"title":"x","tags":["a",' || doc_id || ']}' ELSE '[' || doc_id || ']' END AS raw_data_sample
    FROM """
    + D.RAW_LINES
    + " WHERE kind IN (5, 8, 9, 10)",
)
def dead_letter_rows(spark, sf):
    return V.error_rows(check_lines(D.raw_lines(spark, sf)))


@query(
    "A1 A2",
    """SELECT count(*) AS total_lines, count(*) FILTER (kind = 6) AS empty_lines,
      count(*) FILTER (kind IN (0,1,2,3,4,7)) AS processed_successfully, count(*) FILTER (kind = 5) AS json_decode_errors,
      count(*) FILTER (kind IN (8,9,10)) AS validation_errors, CAST(0 AS BIGINT) AS processing_errors,
      count(*) FILTER (kind IN (5,8,9,10)) AS total_errors,
      printf('%.1f%%', count(*) FILTER (kind IN (0,1,2,3,4,7)) / greatest(1, count(*) FILTER (kind <> 6)) * 100.0) AS success_rate
    FROM """
    + D.RAW_LINES,
)
def run_summary(spark, sf):
    return A.run_summary(check_lines(D.raw_lines(spark, sf)))


@query(
    "V3",
    f"""SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS missing_doc_id,
      count(*) FILTER (nullif({D.sql_clean('text')}, '') IS NULL) AS missing_cleaned,
      count(*) FILTER (nullif({D.sql_clean('text')}, '') IS NULL) = 0 AS sound FROM documents""",
)
def output_contract(spark, sf):
    from pressmill.functions.metadata import clean_string

    rows = table(spark, sf, "documents").select("doc_id", clean_string(F.col("text")).alias("cleaned"))
    return V.output_contract(rows, ["doc_id", "cleaned"], expected=1)


@query(
    "V4",
    """SELECT 'customer-' || o_custkey AS batch_id, count(*) AS documents, max(o_custkey % 1200) AS checkpoint_interval,
      count(*) BETWEEN 1 AND 10000 AND max(o_custkey % 1200) BETWEEN 1 AND 1000 AS accepted FROM orders GROUP BY o_custkey""",
)
def batch_shapes(spark, sf):
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("batch_id"),
        (F.col("o_custkey") % 1200).alias("interval"),
    )
    return V.batch_shape(o, "batch_id", "interval")
