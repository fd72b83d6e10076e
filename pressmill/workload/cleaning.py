"""Text and metadata cleaning over documents, pages, receipts, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.functions import cleaning as C
from pressmill.functions import metadata as M
from pressmill.functions.counts import count_words, reading_time, word_count
from pressmill.operators.encoding import repair_encoding
from pressmill.workload import derived as D
from pressmill.workload.base import query
from pressmill.workload.derived import table


def _docs(spark, sf, f):
    return table(spark, sf, "documents").select("doc_id", f(F.col("text")).alias("cleaned"))


def _docs_sql(f):
    return f"SELECT doc_id, {f('text')} AS cleaned FROM documents"


def _pages(spark, sf, f):
    return table(spark, sf, "pages").select("page_id", f(F.col("html")).alias("cleaned"))


def _receipts(spark, sf, f):
    return D.receipts(spark, sf).select("l_orderkey", "l_partkey", "l_linenumber", f(F.col("text")).alias("cleaned"))


def _receipts_sql(f):
    return f"SELECT l_orderkey, l_partkey, l_linenumber, {f('text')} AS cleaned FROM {D.RECEIPTS}"


@query("C1", f"SELECT page_id, {D.sql_tags('html')} AS cleaned FROM pages")
def clean_html_tags(spark, sf):
    return _pages(spark, sf, C.strip_tags)


@query("C2", _docs_sql(D.sql_space))
def clean_whitespace(spark, sf):
    return _docs(spark, sf, C.collapse_whitespace)


@query("C4", _receipts_sql(D.sql_currency))
def clean_currency(spark, sf):
    return _receipts(spark, sf, C.spell_currency)


@query("C5", _receipts_sql(D.sql_units))
def clean_units(spark, sf):
    return _receipts(spark, sf, C.spell_units)


@query("C6", _receipts_sql(D.sql_dashes))
def clean_dashes(spark, sf):
    return _receipts(spark, sf, C.plain_dashes)


@query("C7", _receipts_sql(D.sql_quotes))
def clean_smart_quotes(spark, sf):
    return _receipts(spark, sf, C.straight_quotes)


@query("C8", _docs_sql(D.sql_printable))
def clean_non_printable(spark, sf):
    return _docs(spark, sf, C.printable_ascii)


@query("C9", _docs_sql(D.sql_repeats))
def clean_repeated_punctuation(spark, sf):
    return _docs(spark, sf, C.single_punctuation)


@query("C10", _docs_sql(D.sql_spacing))
def clean_punctuation_spacing(spark, sf):
    return _docs(spark, sf, C.space_after_punctuation)


@query("C11", _docs_sql(D.sql_clean))
def clean_chain_documents(spark, sf):
    return _docs(spark, sf, C.clean_text)


@query("C11", f"SELECT page_id, {D.sql_clean('html')} AS cleaned FROM pages")
def clean_chain_pages(spark, sf):
    return _pages(spark, sf, C.clean_text)


@query("C11", _receipts_sql(D.sql_clean))
def clean_chain_receipts(spark, sf):
    return _receipts(spark, sf, C.clean_text)


@query(
    "C12 U2",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, CASE
      WHEN l_returnflag = 'A' THEN {D.sql_space(D.sql_spacing(D.sql_repeats(D.sql_units(D.sql_space(D.sql_tags('text'))))))}
      ELSE {D.sql_clean('text')} END AS cleaned
    FROM (SELECT r.*, x.l_returnflag FROM {D.RECEIPTS} r JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber,
      l_returnflag FROM lineitem) x USING (l_orderkey, l_partkey, l_linenumber)
      WHERE contains(r.text, chr(8220) || x.l_returnflag || chr(8221)))""",
)
def clean_per_row_switches(spark, sf):
    """Rows with return flag A switch currency and punctuation normalisation off, the rest say nothing."""
    off = F.when(F.regexp_extract("text", "\u201c(.)\u201d", 1) == "A", F.lit(False))
    override = F.struct(
        *[
            (off if s in ("standardize_currency", "normalize_punctuation") else F.lit(None).cast("boolean")).alias(s)
            for s in C.SWITCHES
        ]
    )
    df = D.receipts(spark, sf).withColumn("override", override)
    cfg = C.per_row_config(F.col("override"))
    return df.select("l_orderkey", "l_partkey", "l_linenumber", C.clean_text(F.col("text"), cfg).alias("cleaned"))


@query("C3", "SELECT doc_id, text AS cleaned FROM documents")
def clean_encoding(spark, sf):
    """Texts read in the wrong encoding come back as they were."""
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf, "documents").select("doc_id", repair_encoding(damaged).alias("cleaned"))


@query(
    "E1",
    f"""SELECT conv_id, turn, CASE WHEN c <> '' THEN length(c) - length(replace(c, ' ', '')) + 1 END AS words
    FROM (SELECT conv_id, turn, {D.sql_clean('text')} AS c FROM conversations)""",
)
def word_counts(spark, sf):
    cleaned = table(spark, sf, "conversations").select("conv_id", "turn", C.clean_text(F.col("text")).alias("c"))
    return cleaned.select("conv_id", "turn", count_words(F.col("c")).alias("words"))


@query(
    "E1 E2",
    f"""SELECT doc_id, words, CASE WHEN words <> 0 THEN greatest(1, CAST(round_even(words / 200, 0) AS BIGINT)) END AS minutes
    FROM (SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN n_chars // 6 END,
      CASE WHEN c <> '' THEN length(c) - length(replace(c, ' ', '')) + 1 END) AS words
      FROM (SELECT doc_id, n_chars, {D.sql_clean('text')} AS c FROM documents))""",
)
def reading_times(spark, sf):
    """Every fifth document brings its own word count."""
    d = table(spark, sf, "documents")
    given = F.when(F.col("doc_id") % 5 == 0, F.floor(F.col("n_chars") / 6))
    words = d.select("doc_id", given.alias("given"), C.clean_text(F.col("text")).alias("c")).select(
        "doc_id", word_count(F.col("given"), F.col("c")).alias("words")
    )
    return words.withColumn("minutes", reading_time(F.col("words")))


# --- metadata -------------------------------------------------------------------------------


@query(
    "M1 M4",
    f"""SELECT p_partkey, nullif({D.sql_clean("CASE WHEN p_size % 5 = 0 THEN '  <b></b> ' ELSE '<b>' || p_name || '</b>,, 5kg' END")}, '') AS name,
    p_size AS size, CAST(make_date(2000 + p_size % 20, 1, 1) AS VARCHAR) AS made FROM part""",
)
def metadata_strings(spark, sf):
    p = table(spark, sf, "part")
    raw = F.when(F.col("p_size") % 5 == 0, "  <b></b> ").otherwise(F.concat(F.lit("<b>"), "p_name", F.lit("</b>,, 5kg")))
    made = F.make_date(F.col("p_size") % 20 + 2000, F.lit(1), F.lit(1))
    return p.select(
        "p_partkey",
        M.clean_string(raw).alias("name"),
        F.col("p_size").alias("size"),
        made.cast("string").alias("made"),
    )


@query(
    "M2",
    f"""SELECT p_partkey, nullif(concat_ws('|', nullif({D.sql_clean("CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END")}, ''),
      nullif({D.sql_clean("CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_brand || '!!' END")}, ''),
      nullif({D.sql_clean("CASE WHEN p_size % 2 = 0 THEN '<i>' ELSE p_type || '.x' END")}, '')), '') AS tags FROM part""",
)
def metadata_lists(spark, sf):
    size = F.col("p_size")
    tags = F.array(
        F.when(size % 3 == 0, "").otherwise(F.col("p_name")),
        F.when(size % 4 == 0, " ").otherwise(F.concat("p_brand", F.lit("!!"))),
        F.when(size % 2 == 0, "<i>").otherwise(F.concat("p_type", F.lit(".x"))),
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(M.clean_list(tags), "|").alias("tags"))


@query(
    "M3",
    f"""SELECT p_partkey, nullif('price=' || {D.sql_clean("'$' || CAST(p_retailprice AS DECIMAL(12,2))")}
      || coalesce('|type=' || nullif({D.sql_clean("CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_type || '  x' END")}, ''), ''), '') AS fields
    FROM part""",
)
def metadata_maps(spark, sf):
    price = F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    kind = F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.concat("p_type", F.lit("  x")))
    kept = M.clean_string_map(F.create_map(F.lit("price"), price, F.lit("type"), kind))
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf, "part").select("p_partkey", F.array_join(pairs, "|").alias("fields"))


@query(
    "M3 M5",
    """SELECT event_id, '{"cleaned_k":' || json_extract_string(props, '$.k') || ',"cleaned_list":["' || event_type || '"],"cleaned_note":"'
      || event_type || ' note"}' AS metadata FROM events""",
)
def metadata_free_form(spark, sf):
    """Free-form objects: strings cleaned, numbers kept, empty values dropped, keys prefixed."""
    e = table(spark, sf, "events")
    raw = F.concat(
        F.regexp_replace("props", "\\}$", ""),
        F.lit(', "note":"<b>'),
        "event_type",
        F.lit('</b>  note", "empty":" ", "gone":null, "list":["'),
        "event_type",
        F.lit('", 7, " "]}'),
    )
    m = F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>")
    return e.select("event_id", F.to_json(M.clean_additional_metadata(m)).alias("metadata"))
