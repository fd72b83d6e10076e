import math
import random
from collections import Counter

from pyspark.sql import functions as F

from pressmill.functions.cleaning import CleaningConfig, clean_text
from pressmill.functions.dates import parse_date_text
from pressmill.operators import entities as E
from pressmill.operators import language as L
from pressmill.operators import typos as T
from pressmill.operators.annotators import annotate
from pressmill.plans.article import Enrichment, process_articles
from pressmill.schema import ARTICLE
from pressmill.session import written

WORDS = [("test", 50), ("this", 100), ("is", 90), ("a", 200), ("the", 300), ("and", 150), ("cat", 40)]


def _fix(spark, texts, cfg=None, protected=None):
    words = spark.createDataFrame(WORDS, "word string, freq bigint")
    df = spark.createDataFrame([(i, t, protected or []) for i, t in enumerate(texts)], "i int, t string, p array<string>")
    out = T.correct_typos(df, ["t"], words, cfg or CleaningConfig(), "p", ("t",))
    return [r.t for r in out.orderBy("i").collect()]


def test_typos(spark):
    got = _fix(spark, ["tset", "Tset", "tset, x1", "McDonald available", "", "is a cat"])
    assert got == ["test", "Test", "tset, x1", "McDonald available", "", "is a cat"]
    assert _fix(spark, ["thw iz"], CleaningConfig(typo_min_length=4)) == ["thw iz"]
    assert _fix(spark, ["tsets"], CleaningConfig(typo_max_length=4)) == ["tsets"]
    assert _fix(spark, ["tset adn"], protected=["tset"]) == ["tset and"]


def _distance(a, b, limit=3):
    """Fewest single edits and swaps from a to b, by search."""
    letters = set(a) | set(b)
    front, seen = {a}, {a}
    for steps in range(limit):
        if b in front:
            return steps
        grown = set()
        for w in front:
            cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
            grown |= {x + y[1:] for x, y in cuts if y}
            grown |= {x + y[1] + y[0] + y[2:] for x, y in cuts if len(y) > 1}
            grown |= {x + c + y[1:] for x, y in cuts if y for c in letters}
            grown |= {x + c + y for x, y in cuts for c in letters}
        front = grown - seen
        seen |= front
    return limit


def test_corrections_equal_brute_force(spark):
    rng = random.Random(7)

    def word(n):
        return "".join(rng.choice("abc") for _ in range(n))

    dictionary = {word(rng.randint(1, 6)): rng.randint(1, 9) for _ in range(40)}
    unknown = sorted({word(rng.randint(2, 7)) for _ in range(120)} - set(dictionary))
    want = {}
    for w in unknown:
        near = [(_distance(w, d), -f, d) for d, f in dictionary.items() if abs(len(d) - len(w)) <= 2]
        near = [n for n in near if n[0] <= 2]
        if near:
            want[w] = min(near)[2]
    d = spark.createDataFrame(list(dictionary.items()), "word string, freq bigint")
    rows = T.find_corrections(spark.createDataFrame([(w,) for w in unknown + list(dictionary)], "word string"), d).collect()
    assert {r.word: r.correction for r in rows} == want


def test_copies_share_corrections(spark):
    assert _fix(spark, ["tset thsi"] * 50) == ["test this"] * 50


PLACES = [("MIDDLE EAST", "LOC"), ("ASIA", "LOC"), ("EAST ASIA", "GPE"), ("Łódź", "GPE")]


def test_gazetteer_rule_is_the_same_at_every_size(spark):
    df = spark.createDataFrame([("Aa and Paris met the U.S. and the U. S. team",)], "t string")
    places = [("Aa", "ORG"), ("Paris", "ORG"), ("Paris", "GPE"), ("U.S.", "GPE"), (None, "GPE"), ("", "ORG"), ("Aa", None)]
    gazetteer = spark.createDataFrame(places, "phrase string, type string")
    found = [
        [(e.text, e.type) for e in E.tag_entities(df, "t", gazetteer, max_planned=limit).first().entities] for limit in (5000, 0)
    ]
    assert found[0] == found[1] == [("Aa", "ORG"), ("Paris", "GPE"), ("U.S", "GPE"), ("U. S", "GPE")]


def test_entities_both_ways(spark):
    texts = [
        "Order from MIDDLE EAST, and (ASIA) on January 15, 2024 paid USD 12. 50 or 3 percent at 10:30 am",
        "in EAST ASIA. Not EURASIA last Monday",
        "",
        "ASIA ASIA Łódź! 😀 ASIA",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    places = spark.createDataFrame(PLACES, "phrase string, type string")
    results = []
    for limit in (5000, 0):
        rows = E.tag_entities(df, "t", places, max_planned=limit).orderBy("i").collect()
        results.append([[tuple(e) for e in r.entities] for r in rows])
    assert results[0] == results[1]
    for text, found in zip(texts, results[0]):
        assert all(text[e[2] : e[3]] == e[0] for e in found)
    assert [(e[0], e[1]) for e in results[0][0]] == [
        ("MIDDLE EAST", "LOC"), ("ASIA", "LOC"), ("January 15, 2024", "DATE"), ("USD 12. 50", "MONEY"),
        ("3 percent", "PERCENT"), ("10:30 am", "TIME"),
    ]
    assert [e[0] for e in results[0][1]] == ["EAST ASIA", "last Monday"]
    assert [e[0] for e in results[0][3]] == ["ASIA", "ASIA", "Łódź", "ASIA"]


def test_entity_types_and_first_date(spark):
    df = spark.createDataFrame([("paid USD 5 on 2024-01-02",), ("nothing",)], "t string")
    df = df.withColumn("e", E.tag_patterns(F.col("t"))).withColumn("m", E.tag_patterns(F.col("t"), ["MONEY"]))
    rows = df.select(E.first_date_text(F.col("e"), F.col("t")), F.size("m")).collect()
    assert [tuple(r) for r in rows] == [("2024-01-02", 1), ("nothing", 0)]


def test_dates(spark):
    cases = [
        ("last Monday", "2024-01-15", "2024-01-08"),
        ("last friday", "2024-01-15", "2024-01-12"),
        ("yesterday", "2024-01-15", "2024-01-14"),
        ("January 15, 2024", "2020-01-01", "2024-01-15"),
        ("Sept. 5, 2020", "2020-01-01", "2020-09-05"),
        ("March 2024", "2024-01-15", None),
        ("no date here", "2024-01-15", None),
        ("2024-02-30", "2024-01-15", None),
        ("last month", "2024-03-31", "2024-02-29"),
        ("3 weeks", "2024-01-15", None),
        ("last time", "2024-01-15", None),
    ]
    df = spark.createDataFrame(cases, "t string, d string, want string")
    for r in df.select("t", "want", parse_date_text(F.col("t"), F.col("d").cast("date")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_date_grammar(spark):
    want = {  # seen from Wednesday, 2024-01-17
        "25/12/2023": "2023-12-25", "12/25/2023": "2023-12-25", "5.3.2023": "2023-03-05", "1/15/24": "2024-01-15",
        "1/18/24": "1924-01-18", "March 3rd 2021": "2021-03-03", "3rd of March, 2021": "2021-03-03", "2021, March 3": "2021-03-03",
        "MARCH 3 2021": "2021-03-03", "Wed, 03 Mar 2021 10:00:00 +0100": "2021-03-03", "10:30 PM PST March 3, 2021": "2021-03-03",
        "5 pm, 3 March 2021": "2021-03-03", "20210303": "2021-03-03", "20211303": None, "29 Feb 2023": None, "29 Feb 2024": "2024-02-29",
        "one year and two months ago": "2022-11-17", "in three weeks": "2024-02-07", "a decade ago": "2014-01-17",
        "next Friday": "2024-01-19", "next wednesday": "2024-01-24", "this Monday": "2024-01-15", "this week": "2024-01-17",
        "now": "2024-01-17", "tomorrow": "2024-01-18", "in a month": "2024-02-17", "45 minutes ago": "2024-01-16",
        "in 45 minutes": "2024-01-17", "99999999999 decades ago": None, "in 99999999 weeks": None, "March 3": None, "March": None,
        "Wednesday": None, "5": None, "a March 2024": None, "1 2 3": None, "25:00 March 3, 2021": None, "May I ask 2021": None,
        "3 weeks": None, "weeks ago": None, "ago": None, "": None, "2021-03-03-04": None, "12-2021": None, None: None,
    }
    df = spark.createDataFrame(list(enumerate(want)), "i int, t string")
    got = df.select("t", parse_date_text(F.col("t"), F.lit("2024-01-17").cast("date")).alias("d")).collect()
    assert {r.t: r.d for r in got} == want


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", clean_text(F.col("text")).alias("c"))
    profiles = L.load_profiles(L.learn_profiles(docs, "c", "lang"))
    right = docs.filter(F.length("c") >= 10).select((L.detect_language(F.col("c"), profiles) == F.col("lang")).alias("ok"))
    assert right.filter("ok").count() >= 0.97 * right.count()
    short = spark.createDataFrame([("the of",), ("",), ("qqqqqqqqqqqqq",)], "t string")
    assert [r[0] for r in short.select(L.detect_language(F.col("t"), profiles)).collect()] == [None] * 3


def test_likelihood_of_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", clean_text(F.col("text")).alias("c"))
    taught = written(L.learn_model(docs.where("doc_id % 2 = 0"), "c", "lang"), "language-model")
    got = L.detect_by_likelihood(docs.where("doc_id % 2 = 1 AND length(c) >= 10"), "c", taught)
    assert got.where("language = lang").count() >= 0.99 * got.count()
    assert got.where("language_margin <= 0 OR language_score >= 0").count() == 0
    short = spark.createDataFrame([(0, "the of"), (1, ""), (2, None), (3, "\u4e2d" * 20)], "id int, t string")
    assert [r["language"] for r in L.detect_by_likelihood(short, "t", taught).collect()] == [None] * 4
    assert L.detect_by_likelihood(short.limit(0), "t", taught).count() == 0


def test_likelihood_copies_ties_and_unknown_groups(spark):
    rows = [("aa aa ab", "x"), ("aa aa ab", "y"), ("cd cd cd", "z"), ("no language", None), (None, "x")]
    model = L.learn_model(spark.createDataFrame(rows, "t string, l string"), "t", "l").collect()
    counts = Counter()
    for text, lang in rows[:3]:
        counts.update((lang, f" {w} "[i : i + 3]) for w in text.split() for i in range(len(w)))
    size = len({g for _, g in counts}) + 1
    mass = {lang: sum(n for (other, _), n in counts.items() if other == lang) + 0.5 * size for lang in "xyz"}
    log = lambda n, lang: round(math.log((n + 0.5) / mass[lang]) * 1_000_000)
    assert {(r.lang, r.gram): (r.n, r.weight, r.floor) for r in model} == {
        key: (n, log(n, key[0]), log(0, key[0])) for key, n in counts.items()
    }
    # A tie goes to the first language; copies change nothing; what no language has still counts.
    texts = spark.createDataFrame([(1, "aa aa aa aa"), (2, "aa aa aa aa"), (3, "cd  cd zz zz")], "id int, t string")
    got = {r.id: r for r in L.detect_by_likelihood(texts, "t", spark.createDataFrame(model)).collect()}
    assert got[1].language == got[2].language == "x" and got[1].language_margin == 0.0
    assert got[1].language_score == got[2].language_score == sum(log(2, "x") for _ in range(8)) / 8e6
    assert got[3].language == "z" and got[3].language_margin is None
    assert got[3].language_score == (4 * log(3, "z") + 4 * log(0, "z")) / 8e6


def test_likelihood_is_the_same_with_a_joined_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", clean_text(F.col("text")).alias("c"))
    model = written(L.learn_model(docs, "c", "lang"), "language-model")
    found = []
    for bound in (L.MAX_SENT, 0):
        monkeypatch.setattr(L, "MAX_SENT", bound)
        rows = L.detect_by_likelihood(docs, "c", model).select("doc_id", "language", "language_score", "language_margin")
        found.append(sorted(map(tuple, rows.collect())))
    assert found[0] == found[1] and len(found[0]) == docs.count()


def test_letter_groups_of_any_length(spark):
    df = spark.createDataFrame([("a" * 300_000,), ("Ab  c\n\U0001F600d",)], "t string")
    sizes, small = [r.g for r in df.select(L.letter_groups(F.col("t")).alias("g")).collect()]
    assert len(sizes) == 300_000
    assert small == [" ab", "ab ", " c ", " \U0001F600d", "\U0001F600d "]


def test_annotator_and_missing_library(spark):
    from pyspark.sql import types as Ty

    added = Ty.StructType([Ty.StructField("n", Ty.LongType())])
    df = spark.createDataFrame([("ab",), ("c",)], "t string")

    def factory():
        def run(batch):
            return batch[["t"]].assign(n=batch["t"].str.len())

        return run

    assert sorted(tuple(r) for r in annotate(df, "len-test", factory, added).collect()) == [("ab", 2), ("c", 1)]
    assert [r.n for r in annotate(df, "none-test", lambda: None, added).collect()] == [None, None]


def _article(spark, **given):
    row = {f.name: given.get(f.name) for f in ARTICLE.fields}
    meta = row.pop("additional_metadata")
    schema = ARTICLE.fields[:-1]
    from pyspark.sql import types as Ty

    df = spark.createDataFrame([tuple(row[f.name] for f in schema)], Ty.StructType(schema))
    return df.withColumn("additional_metadata", F.try_variant_get(F.parse_json(F.lit(meta)), "$", "map<string,variant>"))


def test_whole_record(spark):
    words = spark.createDataFrame([*WORDS, ("tech", 9), ("xx", 9)], "word string, freq bigint")  # map values are corrected too
    places = spark.createDataFrame([("tset ASIA", "LOC")], "phrase string, type string")
    df = _article(
        spark, document_id="d", text="<p>thsi  tset in tset ASIA — last Monday $5</p>", title="  Ths  cat ",
        word_count=None, tags=["cafÃ©  tset", " ", None, "x"], additional_metadata='{"domain":"tech","language":"xx"}',
    )
    tools = Enrichment(words, places, {"en": [" th", "the"]})
    row = process_articles(df, F.lit("2024-01-15").cast("date"), tools=tools).select(
        "*", F.to_json("cleaned_additional_metadata").alias("meta")
    ).first()
    # "tset" belongs to an entity of the raw text, so it stays.
    assert row.cleaned_text == "this tset is tset ASIA - last Monday USD 5"
    assert row.cleaned_tags == ["cat test", "x"] and row.cleaned_categories is None
    assert row.cleaned_title == "the cat".capitalize()
    assert [e.type for e in row.entities] == ["LOC", "DATE", "MONEY"]
    assert row.temporal_metadata == "2024-01-08" and row.cleaned_word_count == 10
    assert row.meta == '{"cleaned_domain":"tech","cleaned_language":"xx","cleaned_reading_time":1}'


def test_given_counts_stay(spark):
    df = _article(spark, document_id="d", text="a b", word_count=0, additional_metadata='{"reading_time":7}')
    row = process_articles(df, F.current_date()).select(
        "cleaned_word_count", F.to_json("cleaned_additional_metadata")
    ).first()
    assert tuple(row) == (0, '{"cleaned_reading_time":7}')


def test_entities_can_be_switched_off(spark):
    df = _article(spark, document_id="d", text="paid $5 today")
    row = process_articles(df, F.current_date(), tools=Enrichment(entities_enabled=False)).first()
    assert row.entities == []


def test_delete_keys_are_not_sent_whole(spark):
    """However small they look, the keys of neither side go through the driver."""
    words = spark.createDataFrame([("helo",), ("wrold",)], "word string")
    dictionary = spark.createDataFrame([("hello", 5), ("world", 9)], "word string, freq bigint")
    found = T._nearest(words, dictionary, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, found.collect())) == [("helo", "hello"), ("wrold", "world")]
