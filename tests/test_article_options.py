"""Options, overrides and injected models in the whole article plan; cost of hostile texts."""

import time
from dataclasses import replace

from pyspark.sql import functions as F

from pressmill.functions import cleaning as C
from pressmill.functions.dates import parse_date_text
from pressmill.operators.encoding import repair_encoding
from pressmill.plans.article import Enrichment, process_articles
from pressmill.schema import ARTICLE
from pressmill.operators import events as EV
from pressmill.operators import jobs as B

def today():
    return F.lit("2024-01-17").cast("date")



def _articles(spark, *rows):
    base = {f.name: None for f in ARTICLE.fields}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], ARTICLE)


def _dictionary(spark):
    return spark.createDataFrame([("company", 90), ("friendly", 80)], "word string, freq bigint")


def _done(df):
    return {r.document_id: r for r in df.collect()}


def test_list_elements_hold_any_character(spark):
    rows = _articles(spark, {"document_id": "a", "text": "x", "tags": ["Apple Music", "cafÃ©", "R&amp;D", "a &#8217; b"]})
    out = _done(process_articles(rows, today(), replace(C.DEFAULT_CONFIG, keep_unicode=True)))
    assert out["a"].cleaned_tags == ["Apple Music", "café", "R&D", "a ' b"]


def test_typo_switch_and_options_by_row(spark):
    rows = _articles(spark, *({"document_id": d, "text": "the compnay is frendly"} for d in "abc"))
    rows = rows.withColumn("o", F.struct(
        F.when(F.col("document_id") == "b", F.lit(False)).alias("enable_typo_correction"),
        F.when(F.col("document_id") == "c", F.lit(8)).alias("typo_min_length"),
    ))
    cfg = C.per_row_config(F.col("o"), options=["enable_typo_correction", "typo_min_length"])
    out = _done(process_articles(rows, today(), cfg, Enrichment(_dictionary(spark))))
    assert {d: r.cleaned_text for d, r in out.items()} == {
        "a": "the company is friendly", "b": "the compnay is frendly", "c": "the compnay is frendly",
    }


def test_maps_get_the_whole_chain(spark):
    meta = '{"note":"the compnay cafÃ©","list":["frendly"," ",5],"deep":{"a":"compnay","n":7,"e":"  "},"k":3,"gone":" ","nil":null,"url":"a.b"}'
    rows = _articles(spark, {"document_id": "a", "text": "x"}).drop("additional_metadata", "geographical_data")
    as_map = lambda t: F.try_variant_get(F.parse_json(F.lit(t)), "$", "map<string,variant>")
    rows = rows.withColumn("additional_metadata", as_map(meta)).withColumn("geographical_data", as_map('{"city":"compnay","at":[1,"compnay"],"no":" "}'))
    out = process_articles(rows, today(), tools=Enrichment(_dictionary(spark)))
    r = out.select(F.to_json("cleaned_additional_metadata").alias("m"), F.to_json("cleaned_geographical_data").alias("g")).first()
    import json

    got = json.loads(r.m)
    got.pop("cleaned_reading_time", None)
    assert got == {"cleaned_note": "the company caf", "cleaned_list": ["friendly"], "cleaned_deep": {"a": "company", "n": 7}, "cleaned_k": 3, "cleaned_url": "a. b"}
    assert json.loads(r.g) == {"city": "company", "at": [1, "compnay"]}


def test_override_is_for_the_text_alone(spark):
    rows = _articles(spark, {"document_id": "a", "text": "the compnay", "title": "the compnay"})
    tools = Enrichment(_dictionary(spark))
    for override in ({"enable_typo_correction": False}, {"typo_min_length": 9}):
        r = _done(process_articles(rows, today(), tools=tools, text_override=override))["a"]
        assert (r.cleaned_text, r.cleaned_title) == ("the compnay", "the company")


def test_injected_tagger_protects_dates_and_fails_alone(spark):
    def factory():
        def model(text):
            if "boom" in text:
                raise ValueError("no")
            at = text.find("compnay")
            return [(at, at + 7, "ORG")] if at >= 0 else []

        return model

    rows = _articles(spark, {"document_id": "a", "text": "the compnay is frendly"}, {"document_id": "b", "text": "boom frendly"})
    out = _done(process_articles(rows, today(), tools=Enrichment(_dictionary(spark), tagger=factory)))
    assert out["a"].cleaned_text == "the compnay is friendly" and [(e.text, e.type) for e in out["a"].entities] == [("compnay", "ORG")]
    assert out["b"].cleaned_text == "boom friendly" and out["b"].entities == []


def test_hostile_texts_cost_no_more(spark):
    texts = [("5 kg " + "1" * 1_000_000, C.spell_units), ("€" + "1" * 1_000_000, C.spell_currency), ("< " * 500_000, C.strip_tags)]
    for text, rule in texts:
        df = spark.createDataFrame([(text,)], "t string")
        started = time.time()
        assert df.select(F.length(rule(F.col("t")))).first()[0] >= 1_000_000
        assert time.time() - started < 20


def test_tags_only_up_to_the_last_bracket(column):
    texts = ["a < b", "<a\nb>x<i", "<<b>>", "1 > 2", ">", "<>"]
    assert column(C.strip_tags, texts) == ["a < b", " x<i", " >", "1 > 2", ">", " "]


def test_entities_and_marks(column):
    texts = ["it&#8217;s &#x27;q&#x27; caf&eacute; &amp;lt; &nosuch; &lt;", "a <b> &amp;", "é ӂ"]
    assert column(repair_encoding, texts) == ["it’s 'q' café &lt; &nosuch; <", "a <b> &amp;", "é ӂ"]


def test_dates_of_any_length_and_layout(spark):
    want = {
        "Last Friday the company said that it would do this and that": "2024-01-12",
        "Monday, January 15, 2024": "2024-01-15",
        "2024-01-15T10:20:30": "2024-01-15",
        "January 15, 2024 at 3:30 pm": "2024-01-15",
        "2024/01/15": "2024-01-15",
        "5 hours ago": "2024-01-16",
        "99999999999 days ago": None,
        "The board met in January 2024": None,
    }
    df = spark.createDataFrame(list(enumerate(want)), "i int, t string")
    got = df.select("t", parse_date_text(F.col("t"), today()).alias("d")).collect()
    assert {r.t: r.d for r in got} == want


def test_resumed_after_a_progress_row(spark):
    columns = "job_id string, ledger_seq bigint, at timestamp, batch_id string, status string, total_documents bigint, processed_documents bigint, failed_documents bigint, error_message string, statistics map<string,string>"
    import datetime as dt

    at = lambda i: dt.datetime(2024, 1, 1, i)
    steps = [("queued", None), ("running", None), ("paused", None), (None, 5), ("queued", None)]
    ledger = spark.createDataFrame([("j", i, at(i), "b", s, None, n, None, None, None) for i, (s, n) in enumerate(steps)], columns)
    kinds = [r.type for r in EV.build_events(ledger).orderBy("time").collect()]
    assert kinds == ["cleaning.job.started", "cleaning.job.paused", "cleaning.job.progress", "cleaning.job.resumed"]
    assert B.fold_jobs(ledger).first().resumed_at == at(4)
    assert B.fold_jobs(ledger.where("ledger_seq < 2")).first().resumed_at is None
