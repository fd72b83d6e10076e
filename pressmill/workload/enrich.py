"""Typos, language, entities, dates and whole records."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions.binding import explode_rows
from pressmill.functions.cleaning import CleaningConfig, clean_text
from pressmill.functions.dates import WEEKDAYS, last_weekday, parse_date_text, reference_date
from pressmill.operators import entities as E
from pressmill.operators import language as L
from pressmill.operators import typos as T
from pressmill.operators.annotators import annotate
from pressmill.plans.article import Enrichment, envelope, process_articles
from pressmill.session import written
from pressmill.workload import derived as D
from pressmill.workload.base import query
from pressmill.workload.derived import table

_CLEAN_DOCS = f"(SELECT doc_id, lang, {D.sql_clean('text')} AS c FROM documents)"
_CLEAN_TURNS = f"(SELECT conv_id, turn, {D.sql_clean('text')} AS c FROM conversations)"


def _eligible_sql(w: str, lo: int = 2, hi: int = 15) -> str:
    return (
        f"(regexp_full_match({w}, '\\p{{L}}+') AND length({w}) BETWEEN {lo} AND {hi}"
        f" AND NOT (regexp_matches({w}, '^\\p{{Lu}}') AND length({w}) > 5)"
        f" AND NOT regexp_matches({w}, '^\\p{{Lu}}.*\\p{{Lu}}'))"
    )


@query(
    "T1",
    f"""SELECT doc_id, count(DISTINCT CASE WHEN {_eligible_sql('w')} THEN lower(w) END) AS words,
      count(CASE WHEN {_eligible_sql('w')} THEN 1 END) AS tokens
    FROM (SELECT doc_id, unnest(string_split(c, ' ')) AS w FROM {_CLEAN_DOCS}) GROUP BY doc_id""",
)
def typo_eligibility(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("c"))
    return d.select(
        "doc_id",
        F.size(T.eligible_words(F.col("c"))).cast("bigint").alias("words"),
        F.size(F.filter(F.split("c", " "), lambda w: T.is_eligible(w))).cast("bigint").alias("tokens"),
    )


# Words seen often in the conversations are taken for right, the others for possible typos.
_MIN_FREQ = 25
_DICT_SQL = f"""dict AS (SELECT w AS word, count(*) AS freq FROM
  (SELECT lower(unnest(string_split(c, ' '))) AS w FROM {_CLEAN_TURNS}) WHERE regexp_full_match(w, '\\p{{L}}+')
  GROUP BY w HAVING count(*) >= {_MIN_FREQ})"""
_FIX_SQL = f"""tokens AS (SELECT conv_id, turn, unnest(string_split(c, ' ')) AS w FROM {_CLEAN_TURNS}),
  vocab AS (SELECT DISTINCT lower(w) AS word FROM tokens WHERE {_eligible_sql('w')}
    AND lower(w) NOT IN (SELECT word FROM dict)),
  pairs AS (SELECT v.word, d.word AS cand, d.freq, damerau_levenshtein(v.word, d.word) AS dist FROM vocab v, dict d
    WHERE abs(length(v.word) - length(d.word)) <= 2),
  near AS (SELECT * FROM pairs WHERE dist <= 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, cand) AS rn FROM near),
  fixes AS (SELECT word, cand AS correction FROM ranked WHERE rn = 1 AND abs(length(cand) - length(word)) <= 3)"""


def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", clean_text(F.col("text")).alias("c"))


def _turn_dictionary(turns):
    words = explode_rows(turns, F.split(F.lower("c"), " "), "word").filter(F.col("word").rlike("^\\p{L}+$"))
    return T.corpus_dictionary(words, _MIN_FREQ)


@query("T3", f"WITH {_DICT_SQL}, {_FIX_SQL} SELECT word, correction FROM fixes")
def typo_corrections(spark, sf):
    turns = written(_turns(spark, sf), "turns")
    dictionary = written(_turn_dictionary(turns), "dictionary")
    words = explode_rows(turns, T.eligible_words(F.col("c")), "word")
    return T.find_corrections(words, dictionary)


@query(
    "T1 T3 T4",
    f"""WITH {_DICT_SQL}, {_FIX_SQL},
      numbered AS (SELECT conv_id, turn, unnest(string_split(c, ' ')) AS w,
        unnest(range(len(string_split(c, ' ')))) AS pos FROM {_CLEAN_TURNS})
    SELECT conv_id, turn, string_agg(CASE WHEN {_eligible_sql('w')} AND f.correction IS NOT NULL THEN
        CASE WHEN regexp_matches(w, '^\\p{{Lu}}') THEN upper(f.correction[1]) || f.correction[2:] ELSE f.correction END
        ELSE w END, ' ' ORDER BY pos) AS corrected
    FROM numbered LEFT JOIN fixes f ON lower(w) = f.word GROUP BY conv_id, turn""",
)
def typo_corrected_texts(spark, sf):
    turns = written(_turns(spark, sf), "turns")
    dictionary = written(_turn_dictionary(turns), "dictionary")
    out = T.correct_typos(turns.withColumnRenamed("c", "corrected"), ["corrected"], dictionary)
    return out.select("conv_id", "turn", "corrected")


_PLACE_TEXT = """(SELECT c_custkey, c_name || ' of ' || n_name || ' (' || r_name || '), rival of ' || upper(r_name[1:3]) || ' ' ||
  CASE WHEN c_custkey % 2 = 0 THEN r_name || '.' ELSE 'nobody' END AS text, n_name, r_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _place_texts(spark, sf):
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat(
        "c_name", F.lit(" of "), "n_name", F.lit(" ("), "r_name", F.lit("), rival of "),
        F.upper(F.substring("r_name", 1, 3)), F.lit(" "),
        F.when(F.col("c_custkey") % 2 == 0, F.concat("r_name", F.lit("."))).otherwise("nobody"),
    )
    return c.select("c_custkey", text.alias("text"))


def _places(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("phrase"), F.lit("GPE").alias("type"))
    regions = table(spark, sf, "region").select(F.col("r_name").alias("phrase"), F.lit("LOC").alias("type"))
    return nations.unionByName(regions)


_SPANS = f"""(SELECT c_custkey, n_name AS text, 'GPE' AS type, strpos(text, ' of ') + 3 AS start_char FROM {_PLACE_TEXT}
  UNION ALL SELECT c_custkey, r_name, 'LOC', strpos(text, '(') FROM {_PLACE_TEXT}
  UNION ALL SELECT c_custkey, r_name, 'LOC', length(text) - 1 - length(r_name) FROM {_PLACE_TEXT} WHERE c_custkey % 2 = 0)"""


def _spans(df, key):
    e = explode_rows(df, F.col("entities"), "e", key)
    return e.select(key, "e.text", "e.type", "e.start_char", "e.end_char")


@query("E4", f"SELECT c_custkey, text, type, start_char, start_char + length(text) AS end_char FROM {_SPANS}")
def entities_planned_gazetteer(spark, sf):
    """A gazetteer small enough to be constants of the plan."""
    return _spans(E.tag_entities(_place_texts(spark, sf), "text", _places(spark, sf)), "c_custkey")


@query("E4", f"SELECT c_custkey, text, type, start_char, start_char + length(text) AS end_char FROM {_SPANS}")
def entities_joined_gazetteer(spark, sf):
    """The same spans through the join that takes gazetteers of any size."""
    tagged = E.tag_entities(_place_texts(spark, sf), "text", _places(spark, sf), max_planned=0)
    return _spans(tagged, "c_custkey")


@query(
    "E5",
    f"SELECT c_custkey, count(*) AS places FROM {_SPANS} WHERE type = 'GPE' GROUP BY c_custkey",
)
def entities_of_wanted_types(spark, sf):
    tagged = E.tag_entities(_place_texts(spark, sf), "text", _places(spark, sf), types=["GPE"])
    return tagged.select("c_custkey", F.size("entities").cast("bigint").alias("places"))


@query(
    "T2 E6",
    f"""SELECT c_custkey, string_agg(DISTINCT w, ' ' ORDER BY w) AS words FROM
      (SELECT c_custkey, unnest(string_split(lower(text), ' ')) AS w FROM {_SPANS}) GROUP BY c_custkey""",
)
def typo_protected_words(spark, sf):
    tagged = E.tag_entities(_place_texts(spark, sf), "text", _places(spark, sf))
    words = F.array_sort(T.protected_words(F.col("entities")))
    return tagged.select("c_custkey", F.array_join(words, " ").alias("words"))


@query(
    "E6 T2",
    f"SELECT c_custkey, replace(text, ' of ', ' off ') AS corrected FROM {_PLACE_TEXT}",
)
def typo_correction_spares_entities(spark, sf):
    """A dictionary made to change place names and 'of': only 'of' changes."""
    nations = table(spark, sf, "region").select(
        F.explode(F.split(F.lower("r_name"), " ")).alias("word")
    )
    near = nations.select(F.concat(F.substring("word", 1, 2), F.lit("x"), F.expr("substring(word, 3)")).alias("word"))
    own = table(spark, sf, "region").select(F.lower(F.substring("r_name", 1, 3)).alias("word"))
    words = near.unionByName(own).distinct().select("word", F.lit(5).cast("bigint").alias("freq"))
    fixed_words = table(spark, sf, "region").select(
        F.explode(F.array(F.lit("off"), F.lit("nobody"), F.lit("rival"))).alias("word"), F.lit(9).cast("bigint").alias("freq")
    ).distinct()
    dictionary = words.unionByName(fixed_words)
    tagged = E.tag_entities(_place_texts(spark, sf), "text", _places(spark, sf))
    guarded = tagged.withColumn("protected", T.protected_words(F.col("entities")))
    out = T.correct_typos(
        guarded.withColumnRenamed("text", "corrected"), ["corrected"], dictionary,
        CleaningConfig(), "protected", ("corrected",),
    )
    return out.select("c_custkey", "corrected")


_MATCHES = "\n    UNION ALL ".join(
    f"SELECT l_orderkey, l_partkey, l_linenumber, '{kind}' AS type, c, regexp_extract(c, '{pattern}') AS text FROM (SELECT *, {D.sql_clean('text')} AS c FROM {D.RECEIPTS})"
    for kind, pattern in [("MONEY", "USD [0-9]+\\. [0-9]{2}"), ("MONEY", "[0-9]+ EUR"), ("MONEY", "GBP [0-9]+\\. [0-9]{2}"), ("PERCENT", "[0-9]+ percent")]
)


@query(
    "E4 E5",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, type, text, strpos(c, text) - 1 AS start_char, strpos(c, text) - 1 + length(text) AS end_char
    FROM ({_MATCHES})""",
)
def entities_by_pattern(spark, sf):
    r = D.receipts(spark, sf).withColumn("c", clean_text(F.col("text")))
    tagged = r.withColumn("entities", E.tag_patterns(F.col("c"), ["MONEY", "PERCENT"]))
    e = explode_rows(tagged, F.col("entities"), "e", "l_orderkey", "l_partkey", "l_linenumber")
    return e.select("l_orderkey", "l_partkey", "l_linenumber", "e.type", "e.text", "e.start_char", "e.end_char")


# --- language -----------------------------------------------------------------------------------

_GRAMS = """(SELECT doc_id, lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i+2])) AS gram FROM
  (SELECT doc_id, lang, ' ' || unnest(list_filter(string_split(lower(c), ' '), lambda x: x <> '')) || ' ' AS w FROM docs))"""


@query(
    "E3",
    f"""WITH docs AS {_CLEAN_DOCS}, grams AS {_GRAMS},
      counted AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY lang, gram)
    SELECT lang, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rn FROM counted)
    WHERE rn <= 300""",
)
def language_profiles(spark, sf):
    d = table(spark, sf, "documents").select("lang", clean_text(F.col("text")).alias("c"))
    return L.learn_profiles(d, "c", "lang")


_DETECTED = f"""WITH docs AS {_CLEAN_DOCS}, grams AS {_GRAMS},
      counted AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY lang, gram),
      profile AS (SELECT lang, gram FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rn
        FROM counted) WHERE rn <= 300),
      hits AS (SELECT g.doc_id, p.lang, count(DISTINCT g.gram) AS h FROM grams g JOIN profile p ON g.gram = p.gram
        GROUP BY g.doc_id, p.lang),
      best AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, lang) AS rn FROM hits)
    SELECT d.doc_id, CASE WHEN length(trim(d.c)) >= 10 THEN b.lang END AS language
    FROM docs d LEFT JOIN best b ON d.doc_id = b.doc_id AND b.rn = 1"""


@query(
    "E3",
    _DETECTED,
)
def language_detection(spark, sf):
    d = _settled_documents(spark, sf)
    profiles = L.load_profiles(L.learn_profiles(d, "c", "lang"))
    return d.select("doc_id", L.detect_language(F.col("c"), profiles).alias("language"))


@query("E3", _DETECTED)
def language_detection_joined(spark, sf):
    """With the profiles as a table, as profiles of any size are used."""
    d = _settled_documents(spark, sf)
    profiles = written(L.learn_profiles(d, "c", "lang"), "profiles")
    return L.detect_by_join(d, "c", profiles).select("doc_id", "language")


_MODEL = """counted AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY lang, gram),
      totals AS (SELECT lang, sum(n) + 0.5 * (SELECT count(DISTINCT gram) + 1 FROM counted) AS mass FROM counted GROUP BY lang),
      model AS (SELECT lang, gram, n, CAST(round(ln((n + 0.5) / CAST(mass AS DOUBLE)) * 1000000) AS BIGINT) AS weight,
        CAST(round(ln(CAST(0.5 AS DOUBLE) / CAST(mass AS DOUBLE)) * 1000000) AS BIGINT) AS floor FROM counted JOIN totals USING (lang))"""


@query("E3", f"WITH docs AS {_CLEAN_DOCS}, grams AS {_GRAMS}, {_MODEL} SELECT * FROM model")
def language_model(spark, sf):
    """Smoothed log-probability of each letter group in each language."""
    d = table(spark, sf, "documents").select("lang", clean_text(F.col("text")).alias("c"))
    return L.learn_model(d, "c", "lang")


@query(
    "E3",
    f"""WITH docs AS {_CLEAN_DOCS}, grams AS {_GRAMS}, {_MODEL},
      sizes AS (SELECT doc_id, count(*) AS size FROM grams GROUP BY doc_id),
      gained AS (SELECT doc_id, m.lang, max(floor) AS floor, sum(weight - floor) AS gain FROM grams g JOIN model m ON g.gram = m.gram
        GROUP BY doc_id, m.lang),
      scored AS (SELECT doc_id, lang, size, CAST(gain + size * floor AS BIGINT) AS total FROM gained JOIN sizes USING (doc_id)),
      ranked AS (SELECT *, row_number() OVER w AS rn, lead(total) OVER w AS behind FROM scored
        WINDOW w AS (PARTITION BY doc_id ORDER BY total DESC, lang))
    SELECT d.doc_id, r.lang AS language, CAST(total AS DOUBLE) / (size * CAST(1000000 AS DOUBLE)) AS language_score,
      CAST(total - behind AS DOUBLE) / (size * CAST(1000000 AS DOUBLE)) AS language_margin
    FROM docs d LEFT JOIN ranked r ON d.doc_id = r.doc_id AND r.rn = 1 AND length(trim(d.c)) >= 10""",
)
def language_likelihood(spark, sf):
    """The likeliest language of each cleaned text, its score and the margin to the next."""
    d = _settled_documents(spark, sf)
    model = written(L.learn_model(d, "c", "lang"), "language-model")
    return L.detect_by_likelihood(d, "c", model).select("doc_id", "language", "language_score", "language_margin")


def _settled_documents(spark, sf):
    """Cleaned once: learning and detection both read it."""
    return written(table(spark, sf, "documents").select("doc_id", "lang", clean_text(F.col("text")).alias("c")), "cleaned-texts")


# --- dates ---------------------------------------------------------------------------------------


@query(
    "E8",
    f"""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE)
        - CAST((isodow(o_orderdate) - 1 - o_custkey % 7 + 6 + 7) % 7 + 1 AS INTEGER) AS VARCHAR) AS day FROM orders""",
)
def last_weekdays(spark, sf):
    names = F.array(*[F.lit(f"Last {d.title()} noon") for d in WEEKDAYS])
    phrase = F.get(names, F.pmod("o_custkey", F.lit(7)).cast("int"))
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", last_weekday(phrase, F.col("o_orderdate").cast("date")).cast("string").alias("day"))


@query(
    "E9",
    """SELECT o_orderkey, CASE o_custkey % 11 WHEN 10 THEN NULL WHEN 9 THEN NULL
        WHEN 4 THEN strftime(CAST(o_orderdate AS DATE) - 1, '%Y-%m-%d')
        WHEN 5 THEN strftime(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 50 AS INTEGER), '%Y-%m-%d')
        WHEN 6 THEN strftime(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 50 AS INTEGER) * 7, '%Y-%m-%d')
        WHEN 7 THEN strftime(CAST(o_orderdate AS DATE) - to_months(CAST(o_orderkey % 50 AS INTEGER)), '%Y-%m-%d')
        WHEN 8 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def date_texts(spark, sf):
    """Dates written in eleven ways; two of them are no dates."""
    d = F.col("o_orderdate").cast("date")
    n = (F.col("o_orderkey") % 50).cast("string")
    texts = [
        F.date_format(d, "yyyy-MM-dd"),
        F.date_format(d, "MMMM d, yyyy"),
        F.date_format(d, "d MMM yyyy"),
        F.date_format(d, "MM/dd/yyyy"),
        F.lit("Yesterday"),
        F.concat(n, F.lit(" days ago")),
        F.concat(n, F.lit(" weeks ago")),
        F.concat(n, F.lit(" months ago")),
        F.lit("today"),
        F.date_format(d, "MMMM yyyy"),
        F.lit("no date here"),
    ]
    text = F.get(F.array(*texts), F.pmod("o_custkey", F.lit(11)).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", parse_date_text(text, d).alias("day"))


#: Ways to write the day d, seen from the day r at n units' distance: the phrase in SQL, and the day it names.
_DATE_FORMS = [
    ("strftime(d, '%d.%m.%Y')", "d"),
    ("strftime(d, '%-d.%-m.%Y')", "d"),
    ("strftime(d, '%Y.%m.%d')", "d"),
    ("strftime(d, '%Y%m%d')", "d"),
    ("strftime(d, '%d-%b-%Y')", "d"),
    ("strftime(d, '%b-%d-%Y')", "d"),
    ("strftime(d, '%Y %B %-d')", "d"),
    ("strftime(d, '%B %-d %Y')", "d"),
    ("strftime(d, '%B %-dth, %Y')", "d"),
    ("strftime(d, 'the %-dth of %B, %Y')", "d"),
    ("strftime(d, '%A, %-d %b. %Y')", "d"),
    ("strftime(d, '%a %b %d %Y')", "d"),
    ("strftime(d, '%a, %d %b %Y 10:15:30 GMT')", "d"),
    ("strftime(d, '%Y-%m-%dT23:59:59.123Z')", "d"),
    ("strftime(d, '%Y-%m-%d 08:00:00+02:00')", "d"),
    ("strftime(d, '3:30 p.m. EST, %B %-d, %Y')", "d"),
    ("strftime(d, '%-d %B %Y at 7 pm')", "d"),
    ("strftime(d, '%m/%d/%Y')", "d"),
    ("strftime(d, '%m/%d/%y')", "d"),
    ("strftime(d, '%d.%m.%y')", "d"),
    ("strftime(d, '28/%m/%Y')", "make_date(year(d), month(d), 28)"),
    ("n || ' days ago'", "r - n"),
    ("n || ' weeks and 3 days ago'", "r - n * 7 - 3"),
    ("'in ' || n || ' days'", "r + n"),
    ("n || ' weeks from now'", "r + n * 7"),
    ("n || ' years, 2 months ago'", "CAST(r - to_months(n * 12 + 2) AS DATE)"),
    ("'a fortnight ago'", "r - 14"),
    ("'two hours ago'", "r - 1"),
    ("'in 50 hours'", "r + 2"),
    ("'the day before yesterday'", "r - 2"),
    ("'day after tomorrow'", "r + 2"),
    ("'next week'", "r + 7"),
    ("'last month'", "CAST(r - to_months(1) AS DATE)"),
    ("'this year'", "r"),
    ("'Yesterday at 10:30 UTC'", "r - 1"),
    ("'next ' || strftime(d, '%A')", "r + CAST((isodow(d) - isodow(r) + 6) % 7 + 1 AS INTEGER)"),
    ("'this ' || strftime(d, '%a')", "r + CAST(isodow(d) - isodow(r) AS INTEGER)"),
    ("strftime(d, '%B %Y')", "NULL"),
    ("strftime(d, '%B %-d')", "NULL"),
    ("strftime(d, '%A')", "NULL"),
    ("strftime(d, '%Y')", "NULL"),
    ("strftime(d, '%Y-13-%d')", "NULL"),
    ("strftime(d, '31 February %Y')", "NULL"),
    ("n || ' weeks'", "NULL"),
]


def _phrase(form: str) -> Column:
    """The phrase of a form as a column of ``d`` and ``n``."""
    codes = {"Y": "yyyy", "y": "yy", "m": "MM", "-m": "M", "B": "MMMM", "b": "MMM", "d": "dd", "-d": "d", "A": "EEEE", "a": "EEE"}
    parts = []
    for part in form.split(" || "):
        if part == "n":
            parts.append(F.col("n").cast("string"))
        elif not part.startswith("strftime"):
            parts.append(F.lit(part[1:-1]))
        else:
            pieces = re.split("%(-?[a-zA-Z])", part[len("strftime(d, '") : -2])
            parts += [F.date_format("d", codes[p]) if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    return F.concat(*parts)


@query(
    "E9",
    "SELECT o_orderkey, form, CASE form "
    + " ".join(f"WHEN {i} THEN strftime({day}, '%Y-%m-%d')" for i, (_, day) in enumerate(_DATE_FORMS) if day != "NULL")
    + f""" END AS day FROM (SELECT o_orderkey, (o_orderkey + o_custkey) % {len(_DATE_FORMS)} AS form, CAST(o_custkey % 50 AS INTEGER) AS n,
      CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_custkey % 9 AS INTEGER) AS r FROM orders)""",
)
def date_forms(spark, sf):
    """Dates in many absolute and relative forms; the last seven lack a part or don't exist."""
    day = F.col("o_orderdate").cast("date")
    form = (F.col("o_orderkey") + F.col("o_custkey")) % len(_DATE_FORMS)
    r = F.date_add(day, (F.col("o_custkey") % 9).cast("int"))
    o = table(spark, sf, "orders").select("o_orderkey", form.alias("form"), (F.col("o_custkey") % 50).alias("n"), day.alias("d"), r.alias("r"))
    text = F.get(F.array(*[_phrase(f) for f, _ in _DATE_FORMS]), F.col("form").cast("int"))
    return o.select("o_orderkey", "form", parse_date_text(text, F.col("r")).alias("day"))


@query(
    "E7 E10",
    """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'paid on ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'no date' END AS text,
      CASE WHEN o_custkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'no date' END AS date_text,
      CASE WHEN o_custkey % 3 = 0 THEN '2024-06-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS reference FROM orders""",
)
def first_date_entity(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("paid on "), day)).otherwise("no date")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", text.alias("text"))
    o = o.withColumn("entities", E.tag_patterns(F.col("text")))
    known = F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderdate").cast("date"))
    ref = reference_date(known, F.lit("2024-06-01").cast("date"))
    return o.select(
        "o_orderkey",
        "text",
        E.first_date_text(F.col("entities"), F.col("text")).alias("date_text"),
        ref.cast("string").alias("reference"),
    )


# --- whole records -----------------------------------------------------------------------------------


def articles(spark, sf):
    """Documents as ARTICLE rows."""
    d = table(spark, sf, "documents")
    none = F.lit(None)
    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"),
        "text",
        F.concat(F.lit("  <b>Title</b> "), "source", F.lit("!!")).alias("title"),
        none.cast("string").alias("excerpt"),
        F.col("source").alias("author"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(300)).cast("int")).alias("publication_date"),
        none.cast("date").alias("revision_date"),
        none.cast("string").alias("source_url"),
        F.array("lang", F.lit(" ")).alias("categories"),
        none.cast("array<string>").alias("tags"),
        none.cast("array<string>").alias("media_asset_urls"),
        none.cast("map<string,variant>").alias("geographical_data"),
        none.cast("date").alias("embargo_date"),
        none.cast("string").alias("sentiment"),
        F.when(F.col("doc_id") % 4 == 0, F.col("n_chars")).alias("word_count"),
        none.cast("string").alias("publisher"),
        F.create_map(F.lit("n"), F.col("n_chars").cast("variant")).alias("additional_metadata"),
    )


_RECORDS = f"""SELECT 'doc-' || doc_id AS document_id, '1.0' AS version, text AS original_text, c AS cleaned_text,
    'Title ' || source || '!' AS cleaned_title, source AS cleaned_author,
    CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS VARCHAR) AS cleaned_publication_date,
    lang AS cleaned_categories, words AS cleaned_word_count,
    '{{"cleaned_n":' || n_chars || CASE WHEN words <> 0 THEN ',"cleaned_reading_time":' ||
      greatest(1, CAST(round_even(words / 200, 0) AS BIGINT)) ELSE '' END || '}}' AS cleaned_additional_metadata
  FROM (SELECT *, coalesce(CASE WHEN doc_id % 4 = 0 THEN n_chars END,
      CASE WHEN c <> '' THEN length(c) - length(replace(c, ' ', '')) + 1 END) AS words
    FROM (SELECT *, {D.sql_clean('text')} AS c FROM documents))"""


@query("E11", _RECORDS)
def full_records(spark, sf):
    """Documents to processed records without lookups: one projection from scan to result."""
    out = process_articles(articles(spark, sf), F.lit("2024-06-01").cast("date"))
    return out.select(
        "document_id",
        "version",
        "original_text",
        "cleaned_text",
        "cleaned_title",
        "cleaned_author",
        F.col("cleaned_publication_date").cast("string").alias("cleaned_publication_date"),
        F.array_join("cleaned_categories", "|").alias("cleaned_categories"),
        "cleaned_word_count",
        F.to_json("cleaned_additional_metadata").alias("cleaned_additional_metadata"),
    )


@query("E11 E6")
def full_records_enriched(spark, sf):
    """With entities, language and typo correction against the words of the corpus itself."""
    rows = articles(spark, sf)
    cleaned = written(rows.select("text", F.get("categories", F.lit(0)).alias("lang"), clean_text(F.col("text")).alias("c")), "cleaned")
    profiles = L.load_profiles(L.learn_profiles(cleaned, "c", "lang"))
    words = explode_rows(cleaned, F.split(F.lower("c"), " "), "word").filter(F.col("word").rlike("^\\p{L}+$"))
    dictionary = written(T.corpus_dictionary(words, 50), "dictionary")
    tools = Enrichment(dictionary, _places(spark, sf), profiles)
    out = process_articles(rows, F.lit("2024-06-01").cast("date"), tools=tools)
    return out.select(
        "document_id",
        "cleaned_text",
        F.size("entities").alias("entity_count"),
        "temporal_metadata",
        F.to_json("cleaned_additional_metadata").alias("cleaned_additional_metadata"),
    )


@query(
    "E11 K2",
    f"SELECT document_id, version, document_id AS inner_id, original_text, cleaned_text, cleaned_title, cleaned_author, cleaned_publication_date, cleaned_word_count, cleaned_additional_metadata FROM ({_RECORDS})",
)
def result_envelopes(spark, sf):
    out = envelope(process_articles(articles(spark, sf), F.lit("2024-06-01").cast("date")))
    inner = [f"processed_data.{n}" for n in ("original_text", "cleaned_text", "cleaned_title", "cleaned_author", "cleaned_word_count")]
    return out.select(
        "document_id", "version", F.col("processed_data.document_id").alias("inner_id"), *inner,
        F.col("processed_data.cleaned_publication_date").cast("string").alias("cleaned_publication_date"),
        F.to_json("processed_data.cleaned_additional_metadata").alias("cleaned_additional_metadata"),
    )


@query("U1", "SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, 'e', '')) AS letters_e FROM documents")
def injected_annotator(spark, sf):
    """A user's model per Arrow batch, made once per worker."""

    def factory():
        def run(batch):
            import pandas as pd

            return pd.DataFrame({"chars": batch["text"].str.len(), "letters_e": batch["text"].str.count("e")})

        return run

    from pyspark.sql import types as Ty

    added = Ty.StructType([Ty.StructField("chars", Ty.LongType()), Ty.StructField("letters_e", Ty.LongType())])
    d = table(spark, sf, "documents")
    return annotate(d, "letters", factory, added, reads=["text"]).select("doc_id", "chars", "letters_e")
