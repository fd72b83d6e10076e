import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressmill.functions import cleaning as C
from pressmill.functions import fixed, metadata
from pressmill.functions.counts import count_words, reading_time, word_count
from pressmill.functions.urls import is_http_url, normalize_url, repair_scheme, sanitize_url
from pressmill.operators.encoding import repair_encoding

SINGLE = [
    (C.strip_tags, "Hello <b>world</b>!", "Hello  world !"),
    (C.strip_tags, "a <i\nclass='x'>b", "a  b"),
    (C.collapse_whitespace, "Multiple   spaces    here", "Multiple spaces here"),
    (C.collapse_whitespace, "Tab\there\nand\nnewline", "Tab here and newline"),
    (C.collapse_whitespace, "  Multiple\t\tspaces  and\n\nnewlines  ", "Multiple spaces and newlines"),
    (C.collapse_whitespace, "a\x1cb\u00a0 c\u2028d", "a b c d"),
    (C.spell_currency, "Price is $100", "Price is USD 100"),
    (C.spell_currency, "Price is 50€", "Price is 50 EUR"),
    (C.spell_currency, "Price is £25", "Price is GBP 25"),
    (C.spell_currency, "Total $99.95", "Total USD 99.95"),
    (C.spell_currency, "Cost 100 US dollars", "Cost 100 USD"),
    (C.spell_currency, "€50", "€50"),
    (C.spell_units, "95% success rate", "95 percent success rate"),
    (C.spell_units, "Distance is 100m", "Distance is 100 meters"),
    (C.spell_units, "Drive 50km", "Drive 50 kilometers"),
    (C.spell_units, "Weight 75kg", "Weight 75 kilograms"),
    (C.plain_dashes, "2010–2020", "2010-2020"),
    (C.plain_dashes, "Hello—world", "Hello-world"),
    (C.straight_quotes, "“Double” and ‘single’", "\"Double\" and 'single'"),
    (C.printable_ascii, "Hello\x00World\x01", "HelloWorld"),
    (C.single_punctuation, "Wait... what?", "Wait. what?"),
    (C.single_punctuation, "Amazing!!! Really!!!", "Amazing! Really!"),
    (C.single_punctuation, "What??? Why???", "What? Why?"),
    (C.single_punctuation, "First,, second,, third", "First, second, third"),
    (C.single_punctuation, "Wait--what?", "Wait-what?"),
    (C.space_after_punctuation, "First sentence.Second sentence.", "First sentence. Second sentence."),
    (C.space_after_punctuation, "One,two,three", "One, two, three"),
    (C.space_after_punctuation, "First?Second", "First? Second"),
]

WHOLE = [
    ("<p>Hello   world!!!</p>", "Hello world!"),
    ("Price $50 for 10kg", "Price USD 50 for 10 kilograms"),
    ("a.b.c,d?e!f", "a. b. c, d? e! f"),
    ("pi is 3.14, see http://x.y/z", "pi is 3. 14, see http://x. y/z"),
    ("", ""),
    (" \n\t ", ""),
    ("😀 café ok", "caf ok"),
    ("$1,200.50", "USD 1, 200. 50"),
]


def test_single_rules(spark):
    for rule in {rule for rule, _, _ in SINGLE}:
        cases = [(text, want) for r, text, want in SINGLE if r is rule]
        df = spark.createDataFrame(cases, "v string, want string")
        for row in df.select("v", "want", rule(F.col("v")).alias("got")).collect():
            assert row.got == row.want, (rule.__name__, row.v)


def test_whole_chain(column):
    assert column(C.clean_text, [t for t, _ in WHOLE]) == [w for _, w in WHOLE]


def test_units_in_one_pass(spark):
    """Decimals that lead to no percent sign stay where they are; a text that holds the mark goes rule by rule."""
    texts = ["3.5 x 7kg", "3.5 kg, 2.5 % and 4%5m", "1\uffff m\uffff 2 m", "\uffffkg\uffff 5 mi", "12cm\u00a0 5g"]
    want = ["3.5 x 7 kilograms", "3.5 kilograms, 2.5 percent and 4 percent5 meters", "1\uffff m\uffff 2 meters", "\uffffkg\uffff 5 miles", "12 centimeters\u00a0 5 grams"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(C.spell_units(F.col("t"))).collect()] == want
    fast = re.sub(re.escape(fixed.WS), "", spark.range(1).select(C.spell_units(F.col("id").cast("string")))._jdf.queryExecution().toString().split("\n\n")[0])
    assert fixed.UNIT_MARK in fast  # one pass that marks, not a pass for each unit alone


def _python(pattern):
    return re.compile(pattern.replace("(?U)", "").replace("(?iuU)", "(?i)"), 0)


def plain_chain(text):
    """The rules one after the other with Python's own regular expressions and no gates."""
    space = re.compile(r"\s+")

    def chain(text, rules):
        for pattern, to in rules:
            text = _python(pattern).sub(to.replace("$1", "\\1"), text)
        return text

    text = re.sub(r"(?s)<.*?>", " ", text)
    text = space.sub(" ", text).strip()
    text = chain(text, fixed.CURRENCY)
    text = chain(text, [fixed.PERCENT])
    text = chain(text, [(rf"(\d+)\s*{short}\b", f"$1 {name}") for short, name in fixed.UNITS])
    text = re.sub(f"[{fixed.DASHES}]", "-", text)
    text = re.sub(f"[{fixed.SMART_DOUBLE}]", '"', text)
    text = re.sub(f"[{fixed.SMART_SINGLE}]", "'", text)
    text = re.sub(r"[^\t-\r\x20-\x7e]", "", text)
    for mark in fixed.REPEATED:
        text = re.sub(f"[{mark}]{{2,}}", mark, text)
    text = re.sub(r"([.,?!])(?=[a-zA-Z0-9])", r"\1 ", text)
    return space.sub(" ", text).strip()


_PIECES = st.sampled_from(
    list("ab 1$€£%.,!?-<>/\t\n\x1c\x00\u00a0\u2003\u2028—“’é٣m") + ["km", "kg ", "USD", "us dollars", "Euros", "5 g", "10 %", "--", ".."]
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(_PIECES, max_size=25).map("".join), min_size=150, max_size=200))
def test_chain_equals_plain_python(column, texts):
    got = column(C.clean_text, texts)
    for text, cleaned in zip(texts, got):
        assert cleaned == plain_chain(text), repr(text)


def test_switches_per_row_equal_switches_per_plan(spark):
    text = "<b>5kg</b>  for $3 — “x”!!! a.b"
    for off in C.SWITCHES[:-1]:
        df = spark.createDataFrame([(text,)], "t string")
        override = F.struct(*[F.lit(False if s == off else None).cast("boolean").alias(s) for s in C.SWITCHES])
        per_row = C.clean_text(F.col("t"), C.per_row_config(override))
        per_plan = C.clean_text(F.col("t"), C.DEFAULT_CONFIG.override({off: False}))
        row = df.select(per_row.alias("a"), per_plan.alias("b")).first()
        assert row.a == row.b, off


def test_override_merges_nested_and_flat():
    cfg = C.DEFAULT_CONFIG.override({"remove_html_tags": False, "typo_correction": {"min_word_length": 4}, "typo_max_length": 9, "x": 1, "fix_encoding": None})
    assert (cfg.remove_html_tags, cfg.typo_min_length, cfg.typo_max_length, cfg.fix_encoding) == (False, 4, 9, True)


def test_encoding_repair(column):
    texts = ["cafÃ© and donâ€™t &amp; co", "plain", "ﬁne ＡＢ", "Ã tout prix", "<p>&amp;</p>", "e\u0301", None]
    want = ["café and don’t & co", "plain", "fine AB", "Ã tout prix", "<p>&amp;</p>", "é", None]
    assert column(repair_encoding, texts) == want


def test_reading_time(column):
    assert column(reading_time, [50, 300, 500, 700, 900, 0, None], "bigint") == [1, 2, 2, 4, 4, None, None]


def test_word_counts(spark):
    df = spark.createDataFrame([(None, "a b c"), (0, "a b"), (None, ""), (7, "")], "n bigint, t string")
    got = [r[0] for r in df.select(word_count(F.col("n"), F.col("t"))).collect()]
    assert got == [3, 0, None, 7]
    assert df.select(count_words(F.col("t"))).first()[0] == 3


def test_urls(column):
    assert column(repair_scheme, ["httpss://a.b", "httpp://a.b", "ftp://a.b/x://y", "a.b", ""]) == [
        "https://a.b", "http://a.b", "https://a.b/x://y", "a.b", "",
    ]
    assert column(sanitize_url, [" https.://a.b ", "a.b/c", "//a.b", "nothing", None, ""]) == [
        "https://a.b", "https://a.b/c", None, None, None, None,
    ]
    assert column(is_http_url, ["http://a.b:80/x?y#z", "https://", "ftp://a.b", "http://a b", "http://" + "a" * 2100]) == [
        True, False, False, False, False,
    ]
    assert column(normalize_url, ["HTTP://EX.com", "https://Ex.com/Path", "https://ex.com?q=A"]) == [
        "http://ex.com/", "https://ex.com/Path", "https://ex.com/?q=A",
    ]


def test_free_form_metadata(spark):
    raw = '{"domain":"tech","reading_time":7,"e":" ","l":["a  b",1],"o":{"k":" x ","n":null},"z":null,"f":true}'
    df = spark.createDataFrame([(raw,)], "j string").select(
        F.try_variant_get(F.parse_json("j"), "$", "map<string,variant>").alias("m")
    )
    got = df.select(F.to_json(metadata.clean_additional_metadata(F.col("m")))).first()[0]
    assert got == (
        '{"cleaned_domain":"tech","cleaned_f":true,"cleaned_l":["a b"],"cleaned_o":{"k":"x","n":null},"cleaned_reading_time":7}'
    )
    empty = df.select(F.to_json(metadata.clean_additional_metadata(F.lit(None).cast("map<string,variant>")))).first()[0]
    assert empty == "{}"


def test_string_lists_and_maps(spark):
    df = spark.createDataFrame([(["a  b", " ", None], {"x": " y ", "e": ""})], "l array<string>, m map<string,string>")
    row = df.select(
        metadata.clean_list(F.col("l")), metadata.clean_string_map(F.col("m")), metadata.prefix_string_map(F.col("m"))
    ).first()
    assert tuple(row) == (["a b"], {"x": "y"}, {"cleaned_x": "y"})


@pytest.mark.parametrize("size", [300_000])
def test_long_texts_do_not_overflow(column, size):
    assert column(lambda c: F.length(C.clean_text(c)), ["<" + "x" * size]) == [size + 1]
