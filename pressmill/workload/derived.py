"""Tables derived from the given ones, each as Spark code and as the SQL that says the same.

The given texts hold no currency, units, typographic characters or broken JSON, so these are
built from their rows; every derived table has a row for every row of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS2 = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- receipts: one text per line item ---------------------------------------------


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    qty = F.col("l_quantity").cast("int").cast("string")
    pct = (F.col("l_tax") * 100).cast("decimal(12,0)").cast("string")
    text = F.concat(
        F.lit("<p>Order "),
        F.col("l_orderkey").cast("string"),
        F.lit(":\u00a0 "),
        qty,
        F.lit("kg for $ "),
        price,
        F.lit(" ("),
        qty,
        F.lit(" € or £"),
        price,
        F.lit("), tax "),
        pct,
        F.lit(" % \u2014 \u201c"),
        F.col("l_returnflag"),
        F.lit("\u201d \u2018"),
        F.col("l_linestatus"),
        F.lit("\u2019,, "),
        qty,
        F.lit(" m,"),
        qty,
        F.lit("km 7ft 3 lbs 9mi 5 g 2cm\u2026\tin US Dollars, Euros!!! gbp??? poundsterling -- done...now"),
        F.lit("\u200b</p>\n"),
    )
    return li.select("l_orderkey", "l_partkey", "l_linenumber", text.alias("text"))


RECEIPTS = (
    "(SELECT l_orderkey, l_partkey, l_linenumber, '<p>Order ' || l_orderkey || ':' || chr(160) || ' ' || CAST(l_quantity AS INTEGER)"
    " || 'kg for $ ' || CAST(l_extendedprice AS DECIMAL(12,2)) || ' (' || CAST(l_quantity AS INTEGER)"
    " || ' € or £' || CAST(l_extendedprice AS DECIMAL(12,2)) || '), tax ' || CAST(l_tax * 100 AS DECIMAL(12,0))"
    " || ' % ' || chr(8212) || ' ' || chr(8220) || l_returnflag || chr(8221) || ' ' || chr(8216) || l_linestatus || chr(8217) || ',, '"
    " || CAST(l_quantity AS INTEGER) || ' m,' || CAST(l_quantity AS INTEGER)"
    " || 'km 7ft 3 lbs 9mi 5 g 2cm' || chr(8230) || chr(9) || 'in US Dollars, Euros!!! gbp??? poundsterling -- done...now'"
    " || chr(8203) || '</p>' || chr(10) AS text FROM lineitem)"
)

# --- cleaning in SQL ----------------------------------------------------------------


def gsub(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


def sql_tags(c: str) -> str:
    return gsub(c, "(?s)<.*?>", " ")


def sql_space(c: str) -> str:
    return f"trim({gsub(c, WS2 + '+', ' ')}, ' ')"


def sql_currency(c: str) -> str:
    c = gsub(c, "\\$" + WS2 + "*(\\d+(?:\\.\\d{1,2})?)", "USD \\1")
    c = gsub(c, "(\\d+)" + WS2 + "*€", "\\1 EUR")
    c = gsub(c, "£" + WS2 + "*(\\d+(?:\\.\\d{1,2})?)", "GBP \\1")
    c = gsub(c, "(?i)\\b(?:usd|us dollars?)\\b", "USD")
    c = gsub(c, "(?i)\\b(?:eur|euros?)\\b", "EUR")
    return gsub(c, "(?i)\\b(?:gbp|pounds?sterling)\\b", "GBP")


def sql_units(c: str) -> str:
    c = gsub(c, "(\\d+(?:\\.\\d+)?)" + WS2 + "*%", "\\1 percent")
    for short, name in [
        ("m", "meters"), ("km", "kilometers"), ("kg", "kilograms"), ("cm", "centimeters"),
        ("ft", "feet"), ("lbs", "pounds"), ("mi", "miles"), ("g", "grams"),
    ]:
        c = gsub(c, "(\\d+)" + WS2 + f"*{short}\\b", f"\\1 {name}")
    return c


def sql_dashes(c: str) -> str:
    return gsub(c, "[\\x{2010}-\\x{2015}\\x{2212}]", "-")


def sql_quotes(c: str) -> str:
    return gsub(gsub(c, "[\\x{201c}\\x{201d}]", '"'), "[\\x{2018}\\x{2019}]", "''")


def sql_printable(c: str) -> str:
    return gsub(c, "[^\\t-\\r\\x20-\\x7e]", "")


def sql_repeats(c: str) -> str:
    for mark in [".", ",", "!", "?", "-"]:
        c = gsub(c, f"[{mark}]{{2,}}", mark)
    return c


def sql_spacing(c: str) -> str:
    return gsub(c, "([.,?!])([a-zA-Z0-9])", "\\1 \\2")


def sql_clean(c: str) -> str:
    c = sql_units(sql_currency(sql_space(sql_tags(c))))
    return sql_space(sql_spacing(sql_repeats(sql_printable(sql_quotes(sql_dashes(c))))))


# --- raw lines: one JSON line per document, most of them damaged in a known way ----------


def _plain(c: Column) -> Column:
    """The text without characters that JSON would escape."""
    return F.regexp_replace(c, '[\\x00-\\x1f"\\\\\\x7f]', " ")


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``line, value``: kinds of damage alternate with the document id."""
    d = table(spark, sf, "documents")
    ident = F.col("doc_id").cast("string")
    body = _plain(F.col("text"))
    head = F.concat(F.lit('{"document_id":"d'), ident, F.lit('",'))
    text = F.concat(F.lit('"text":"'), body, F.lit('"'))
    src = F.col("source")
    kinds = [
        F.concat(head, F.lit('"title":"From '), src, F.lit('",'), text, F.lit("}")),
        F.concat(head, F.lit('"title":"The "'), src, F.lit('" desk",'), text, F.lit("}")),
        F.concat(head, F.lit('"title":"Tab'), F.lit("\x01"), src, F.lit('",'), text, F.lit("}")),
        F.concat(head, F.lit('"title":"A "'), src, F.lit("\x02"), F.lit('" b",'), text, F.lit("}")),
        F.concat(head, text),
        F.concat(F.lit("no json at all "), ident),
        F.lit("  \t "),
        F.concat(head, F.lit('"source_url":"httpss://ex.com/'), ident, F.lit('",'), text, F.lit("}")),
        F.concat(F.lit('{"document_id":'), ident, F.lit(',"publication_date":"2024-13-45",'), text, F.lit("}")),
        F.concat(F.lit('{"title":"x","tags":["a",'), ident, F.lit("]}")),
        F.concat(F.lit("["), ident, F.lit("]")),
    ]
    value = F.get(F.array(*kinds), F.pmod("doc_id", F.lit(len(kinds))).cast("int"))
    return d.select((F.col("doc_id") + 1).alias("line"), value.alias("value"))


RAW_LINES = """(SELECT doc_id + 1 AS line, doc_id, doc_id % 11 AS kind, source,
  regexp_replace(text, '[\\x00-\\x1f"\\\\\\x7f]', ' ', 'g') AS body FROM documents)"""

# Outcome, strategy and fields that each kind of damage must lead to.
EXPECTED_LINES = f"""(SELECT line, doc_id, kind, source, body,
  CASE kind WHEN 0 THEN 'strict' WHEN 1 THEN 'quotes' WHEN 2 THEN 'unicode' WHEN 3 THEN 'combined'
    WHEN 4 THEN 'salvage' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'strict' END AS strategy,
  CASE WHEN kind IN (0,1,2,3,4,7) THEN 'd' || doc_id END AS document_id,
  CASE kind WHEN 0 THEN 'From ' || source WHEN 1 THEN 'The "' || source || '" desk'
    WHEN 2 THEN 'Tab' || source WHEN 3 THEN 'A "' || source || '" b' WHEN 9 THEN 'x' END AS title,
  CASE WHEN kind IN (0,1,2,3,7,8) THEN CASE WHEN kind IN (2,3) THEN {{unicode}} ELSE body END
    WHEN kind = 4 THEN body || '"' END AS text,
  CASE WHEN kind = 7 THEN 'https://ex.com/' || doc_id END AS source_url,
  CASE kind WHEN 5 THEN 'json_error' WHEN 6 THEN 'empty' WHEN 8 THEN 'validation_error'
    WHEN 9 THEN 'validation_error' WHEN 10 THEN 'validation_error' ELSE 'ok' END AS outcome,
  CASE kind WHEN 8 THEN 'document_id: must be a string|publication_date: must be a date'
    WHEN 9 THEN 'document_id: field required|text: field required|tags: must be a list of strings'
    WHEN 10 THEN 'document: must be an object' ELSE '' END AS errors
  FROM {RAW_LINES})"""


def sql_json_unicode(c: str) -> str:
    for code, to in [
        (0x201C, '\\"'), (0x201D, '\\"'), (0x2018, "''"), (0x2019, "''"), (0x2014, "--"), (0x2013, "-"),
        (0x2026, "..."), (0xA0, " "), (0x200B, ""), (0x200C, ""), (0x200D, ""), (0xFEFF, ""), (0x2028, " "), (0x2029, " "),
    ]:
        c = f"replace({c}, chr({code}), '{to}')"
    return gsub(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


EXPECTED_LINES = EXPECTED_LINES.replace("{unicode}", sql_json_unicode("body"))

# --- job ledger: each order is a job -------------------------------------------------


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    total = F.col("o_custkey") % 50 + 10
    end = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("paused")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "running").when(
        (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "P"), "queued"
    )

    def row(seq, hours, status=None, total=None, done=None, failed=None, error=None, meta=None):
        none = F.lit(None)
        return F.struct(
            F.lit(seq).cast("bigint").alias("ledger_seq"),
            (at + F.expr(f"interval {hours} hours")).alias("at"),
            (none if status is None else status).cast("string").alias("status"),
            (none if total is None else total).cast("bigint").alias("total_documents"),
            (none if done is None else done).cast("bigint").alias("processed_documents"),
            (none if failed is None else failed).cast("bigint").alias("failed_documents"),
            (none if error is None else error).cast("string").alias("error_message"),
            (none if meta is None else meta).cast("map<string,string>").alias("metadata"),
        )

    rows = F.array(
        row(0, 0, F.lit("queued"), total, F.lit(0), F.lit(0), None, F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("origin"), F.lit("api"))),
        row(1, 1, F.lit("running"), None, None, None, None, F.create_map(F.lit("worker"), (F.col("o_orderkey") % 7).cast("string"))),
        row(2, 2, None, None, F.floor(total / 2), F.lit(1)),
        row(3, 3, end, None, None, None, F.when(end == "failed", F.lit("boom")), F.create_map(F.lit("origin"), F.lit("final"))),
        F.when(urgent.isNotNull(), row(4, 4, urgent)),
    )
    exploded = o.select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        F.concat(F.lit("batch-"), (F.col("o_custkey") % 20).cast("string")).alias("batch_id"),
        F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"),
    )
    out = exploded.select("job_id", "batch_id", "r.*")
    return out.withColumn("statistics", F.lit(None).cast("map<string,string>"))


LEDGER_SQL = """(
  SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'batch-' || (o_custkey % 20) AS batch_id, 0 AS ledger_seq,
    o_orderdate AS happened, 'queued' AS status, o_custkey % 50 + 10 AS total_documents, 0 AS processed_documents,
    0 AS failed_documents, NULL AS error_message FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'batch-' || (o_custkey % 20), 1, o_orderdate + INTERVAL 1 HOUR, 'running',
    NULL, NULL, NULL, NULL FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'batch-' || (o_custkey % 20), 2, o_orderdate + INTERVAL 2 HOUR, NULL,
    NULL, (o_custkey % 50 + 10) // 2, 1, NULL FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'batch-' || (o_custkey % 20), 3, o_orderdate + INTERVAL 3 HOUR,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'paused' END,
    NULL, NULL, NULL, CASE o_orderstatus WHEN 'O' THEN 'boom' END FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'batch-' || (o_custkey % 20), 4, o_orderdate + INTERVAL 4 HOUR,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'running' ELSE 'queued' END, NULL, NULL, NULL, NULL
    FROM orders WHERE o_orderpriority = '1-URGENT' OR (o_orderpriority = '2-HIGH' AND o_orderstatus = 'P')
)"""

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(c: str | Column) -> Column:
    return F.date_format(c, STAMP)


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


# --- document outcomes: each event is a processed document ---------------------------------


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """``job_id, seq, document_id, at, outcome``; a job is a user, errors are failures."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").cast("string").alias("job_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("doc-"), F.floor("value").cast("string")).alias("document_id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type") == "error", "processing_error").otherwise("ok").alias("outcome"),
    )


OUTCOMES = """(SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq,
  'doc-' || CAST(floor(value) AS BIGINT) AS document_id, ts AS happened,
  CASE WHEN event_type = 'error' THEN 'processing_error' ELSE 'ok' END AS outcome FROM events)"""

BACKENDS = ["redis_streams", "webhook", "kafka"]
