"""Constants that results depend on, kept together as plain text.

Regular expressions are in Java syntax.  ``WS`` spells out the whitespace class
because the JVM's ``\\s`` leaves out several of these code points.
"""

# --- whitespace -------------------------------------------------------------
WS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# --- cleaning: (pattern, replacement), applied top to bottom -----------------
# Tried on the text up to the last ">" only, and digits from the start of a run only, each run
# once and whole: so a long run of either costs no more than any other text.
HTML_TAG = "<[^>]*+>"
NUMBER = "(?U)(?<!\\d)(\\d++)"

CURRENCY = [
    ("(?U)\\$" + WS + "*+(\\d++(?:\\.\\d{1,2})?)", "USD $1"),
    (NUMBER + WS + "*+€", "$1 EUR"),
    ("(?U)£" + WS + "*+(\\d++(?:\\.\\d{1,2})?)", "GBP $1"),
    # The look-aheads skip most characters before a word's boundary is looked for.
    ("(?iuU)(?=[uU])\\b(?:usd|us dollars?)\\b", "USD"),
    ("(?iuU)(?=[eE])\\b(?:eur|euros?)\\b", "EUR"),
    ("(?iuU)(?=[gGpP])\\b(?:gbp|pounds?sterling)\\b", "GBP"),
]

PERCENT = (NUMBER[:-1] + "(?:\\.\\d++)?+)" + WS + "*+%", "$1 percent")

UNITS = [
    ("m", "meters"),
    ("km", "kilometers"),
    ("kg", "kilograms"),
    ("cm", "centimeters"),
    ("ft", "feet"),
    ("lbs", "pounds"),
    ("mi", "miles"),
    ("g", "grams"),
]
# All of these in one pass: the short name is marked, and the marked names are replaced as plain text.
# The look-ahead keeps decimals that lead to no percent sign out of the second group.
UNIT_MARK = "\uffff"
MARKED_UNITS = (
    NUMBER
    + "(?:(?=(?:\\.\\d++)?+" + WS + "*+%)(\\.\\d++)?+" + WS + "*+(%)"
    + "|" + WS + "*+(" + "|".join(short for short, _ in UNITS) + ")\\b)",
    "$1$2 " + UNIT_MARK + "$3$4" + UNIT_MARK,
)

DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
SMART_DOUBLE = "\u201c\u201d"
SMART_SINGLE = "\u2018\u2019"
NON_PRINTABLE = "[^\\t-\\r\\x20-\\x7e]"
REPEATED = [".", ",", "!", "?", "-"]
PUNCTUATION_SPACING = ("([.,?!])(?=[a-zA-Z0-9])", "$1 ")

# --- cleaning defaults ------------------------------------------------------
TYPO_MIN_LENGTH = 2
TYPO_MAX_LENGTH = 15
TYPO_CONFIDENCE = 0.7
TYPO_CAPITALISED_LENGTH = 5

# --- malformed JSON ---------------------------------------------------------
JSON_TEXT_REPLACEMENTS = [
    ("\u201c", '\\"'),
    ("\u201d", '\\"'),
    ("\u2018", "'"),
    ("\u2019", "'"),
    ("\u2014", "--"),
    ("\u2013", "-"),
    ("\u2026", "..."),
    ("\u00a0", " "),
    ("\u200b", ""),
    ("\u200c", ""),
    ("\u200d", ""),
    ("\ufeff", ""),
    ("\u2028", " "),
    ("\u2029", " "),
]
JSON_CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
SALVAGE_FIELDS = ["title", "excerpt", "author", "source_url", "publication_date"]

EMPTY_LINE = "Empty line"
ALL_FAILED = "All parsing failed"

# --- entities ---------------------------------------------------------------
ENTITY_TYPES = ["PERSON", "ORG", "GPE", "LOC", "DATE", "TIME", "MONEY", "PERCENT"]

# --- jobs -------------------------------------------------------------------
JOB_STATUSES = ["queued", "running", "paused", "completed", "cancelled", "failed"]
JOB_TRANSITIONS = [
    ("queued", "running"),
    ("running", "completed"),
    ("running", "paused"),
    ("paused", "queued"),
    ("queued", "cancelled"),
    ("running", "cancelled"),
    ("running", "failed"),
    ("paused", "cancelled"),
]
BATCH_MIN_DOCUMENTS = 1
BATCH_MAX_DOCUMENTS = 10000
CHECKPOINT_MIN_INTERVAL = 1
CHECKPOINT_MAX_INTERVAL = 1000
CHECKPOINT_INTERVAL = 10
CHECKPOINT_TTL_SECONDS = 86400
JOB_PAGE_LIMIT = 100

# --- resources --------------------------------------------------------------
MEMORY_THRESHOLD = 90.0
CPU_THRESHOLD = 95.0
IDLE_SECONDS = 300

# --- URLs: replacements, applied top to bottom ---------------------------------
SCHEME_REPAIRS = [("httpss://", "https://"), ("httpp://", "http://"), ("httpps://", "https://")]
URL_REPAIRS = [("https.://", "https://"), ("http.://", "http://"), ("httpss://", "https://"), ("httpps://", "https://")]

# --- events -----------------------------------------------------------------
SPEC_VERSION = "1.0"
CONTENT_TYPE = "application/json"
STREAM_MAX_EVENTS = 10000
DELIVERY_ATTEMPTS = 3
BULK_ROWS = 500
ERROR_TEXT_LENGTH = 200
