import pytest
from pyspark.sql import functions as F

from pressmill.functions import fixed
from pressmill.operators import validate as V
from pressmill.operators.repair import parse_lines, parse_strict, salvage_fields
from pressmill.plans.batch_run import run_batches
from pressmill.plans.file_run import check_lines, run_lines
from pressmill.sources import lines as S

LINES = [
    ('{"title": "Test", "body": "Content"}', "strict", '{"body":"Content","title":"Test"}'),
    ('{"title": "Article with "quotes" inside", "body": "Test"}', "quotes", '{"body":"Test","title":"Article with \\"quotes\\" inside"}'),
    ('{"title": "Article with “smartquotes”", "body": "Test"}', "strict", '{"body":"Test","title":"Article with “smartquotes”"}'),
    ('{"title": "Article ‘with’ "mixed" issues", "body": "Test"}', "quotes", '{"body":"Test","title":"Article ‘with’ \\"mixed\\" issues"}'),
    ('{"outer": {"inner": {"deep": "value"}}}', "strict", '{"outer":{"inner":{"deep":"value"}}}'),
    ('{"authors": ["Alice", "Bob"], "tags": ["news", "tech"]}', "strict", '{"authors":["Alice","Bob"],"tags":["news","tech"]}'),
    ('{"document_id":"doc123","text":"Content here"', "salvage", '{"document_id":"doc123","text":"Content here\\""}'),
    ('{"document_id":"a","tags":["x "y" z"],"text":"t"}', "quotes", '{"document_id":"a","tags":["x \\"y\\" z"],"text":"t"}'),
    ('{"title": "a\x01b"}', "unicode", '{"title":"ab"}'),
    ('{"title": "a "q\x01" b"}', "combined", '{"title":"a \\"q\\" b"}'),
    ("[1,2]", "strict", "[1,2]"),
    ("this is not json at all!!!", None, None),
    ('{"document_id":"doc123"', None, None),
    ('{"text":"Content without document_id"', None, None),
    ('{"a":1} x', None, None),
    ('{"a":1}]', None, None),
    ('{"a":1}, 2', None, None),
]


def test_repair_ladder(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(LINES)], "line int, value string")
    rows = parse_lines(df).orderBy("line").select("repair_strategy", F.to_json("document"), "parse_error").collect()
    for (value, strategy, document), row in zip(LINES, rows):
        assert (row[0], row[1]) == (strategy, document), value
        assert (row[2] or "").startswith(fixed.ALL_FAILED if strategy is None else "")


def test_blank_lines(spark):
    df = spark.createDataFrame([(1, ""), (2, " \t ")], "line int, value string")
    assert [r.parse_error for r in parse_lines(df).collect()] == [fixed.EMPTY_LINE] * 2
    assert S.drop_blank(df).count() == 0


def test_salvage_of_long_text(spark):
    value = '{"document_id":"d","text":"' + 'a "b" \\" ' * 30_000 + '\\\\","title":"t" oops'
    df = spark.createDataFrame([(value,)], "v string").select(salvage_fields(F.col("v")).alias("d"))
    row = df.select(F.try_variant_get("d", "$.text", "string"), F.try_variant_get("d", "$.title", "string")).first()
    assert row[0] == 'a "b" \\" ' * 30_000 + "\\\\" and row[1] == "t"


ARTICLES = [
    ('{"document_id":"doc1","text":"Article content"}', 0),
    (
        '{"document_id":"d","text":"t","title":"T","excerpt":"e","author":"a","publication_date":"2024-01-15",'
        '"source_url":"https://ex.com/a","categories":["a","b"],"tags":["x","y"],"word_count":500,"publisher":"p"}',
        0,
    ),
    ('{"document_id":"d","text":"t","source_url":"not-a-valid-url"}', 1),
    ('{"document_id":"d","text":""}', 0),
    ('{"text":"x"}', 1),
    ('{"document_id":"x"}', 1),
    ('{"document_id":"d","text":"t","foo":1}', 0),
    ('{"title":"a","body":"b","date":"2024-01-01"}', 2),
    ('{"document_id":5,"text":"t"}', 1),
    ('{"document_id":"d","text":"t","word_count":"12"}', 0),
    ('{"document_id":"d","text":"t","word_count":3.5}', 1),
    ('{"document_id":"d","text":"t","tags":"x"}', 1),
    ('{"document_id":"d","text":"t","publication_date":"2024-02-30"}', 1),
    ('{"document_id":"d","text":"t","publication_date":"2024-01-15T10:00:00"}', 1),
    ('{"document_id":"d","text":"t","geographical_data":[1]}', 1),
    ("[1,2]", 1),
]


def test_article_check(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(ARTICLES)], "line int, value string")
    checked = V.validate_documents(parse_lines(df), sanitize=False).orderBy("line").collect()
    for (value, n), row in zip(ARTICLES, checked):
        assert len(row.errors) == n, (value, row.errors)
    assert str(checked[1].publication_date) == "2024-01-15" and checked[1].word_count == 500
    assert checked[9].word_count == 12


def test_sanitizing_drops_what_it_cannot_mend(spark):
    value = '{"document_id":"d","text":"t","source_url":"nope","media_asset_urls":["a.b","zz"]}'
    df = spark.createDataFrame([(1, value)], "line int, value string")
    row = V.validate_documents(parse_lines(df)).first()
    assert (row.errors, row.source_url, row.media_asset_urls) == ([], None, ["https://a.b/"])


def test_line_numbers_survive_file_splits(spark, tmp_path):
    texts = [f"line {i}" if i % 4 else "" for i in range(500)]
    (tmp_path / "a.txt").write_text("\n".join(texts) + "\n")
    (tmp_path / "b.txt").write_text("x\ny\u2028z\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = S.read_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in rows}
    want = {("a.txt", i + 1): t for i, t in enumerate(texts)} | {("b.txt", 1): "x", ("b.txt", 2): "y\u2028z"}
    assert got == want


def test_batch_explosion(spark):
    df = spark.createDataFrame([("j1", '[{"a":1},{"a":2}]'), ("j2", "oops"), ("j3", '{"a":1}')], "job string, documents string")
    rows = S.explode_batch(df).select("job", "batch_ok", "seq", F.to_json("document")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [("j1", True, 0, '{"a":1}'), ("j1", True, 1, '{"a":2}'), ("j2", False, None, None), ("j3", False, None, None)], key=str
    )


def test_unprocessed_cap(spark):
    df = spark.range(10).withColumn("processed", F.col("id") % 2 == 0)
    assert S.unprocessed(df).count() == 5 and S.unprocessed(df, cap=2).count() == 2


def test_file_run_reports(spark):
    values = ['{"document_id":"a","text":"x  y"}', "", "bad", '{"document_id":"z"}']
    lines = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "line bigint, value string")
    run = run_lines(lines, F.lit("2024-01-01").cast("date"))
    assert [(r.document_id, r.cleaned_text) for r in run.processed.collect()] == [("a", "x y")]
    errors = {r.line_number: (r.document_id, r.error_type) for r in run.errors.collect()}
    assert errors == {3: ("line-3", "JSONDecodeError"), 4: ("z", "ValidationError")}
    s = run.summary.first()
    assert (s.total_lines, s.empty_lines, s.processed_successfully, s.total_errors, s.success_rate) == (4, 1, 1, 2, "33.3%")


def test_outcomes_cover_every_line(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(LINES)], "line bigint, value string")
    assert {r.outcome for r in check_lines(df).collect()} <= set(V.OUTCOMES)


@pytest.mark.parametrize("text", ['{"a":1}', '[1]', '"x"', "3", "null"])
def test_strict_parse_takes_any_json(column, text):
    assert column(lambda c: parse_strict(c).isNotNull(), [text]) == [True]


def test_fields_are_taken_from_a_document_in_one_pass_and_batches_parsed_once(spark):
    batch = '[{"document_id":"a","text":"t","tags":["x"],"word_count":null},{"document_id":null,"sentiment":1,"text":"t"},{"source_url":"no"},3,{"document_id":"a","text":"u","document_id":"b"}]'
    rows = spark.createDataFrame([("j", batch), ("k", "no list"), ("l", None), ("m", "[null]")], "job_id string, documents string")
    items = S.explode_batch(rows).filter("document IS NOT NULL")
    checked = V.validate_documents(items, sanitize=False)
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get(lambda") == 1
    got = {(r.job_id, r.seq): (r.document_id, r.text, r.tags, r.errors) for r in checked.collect()}
    assert got == {
        ("j", 0): ("a", "t", ["x"], []),
        ("j", 1): (None, "t", None, ["document_id: must be a string", "sentiment: must be a string"]),
        ("j", 2): (None, None, None, ["document_id: field required", "text: field required", "source_url: must be an http(s) URL"]),
        ("j", 3): (None, None, None, ["document: must be an object"]),
        ("j", 4): ("b", "u", None, []),
        ("m", 0): (None, None, None, ["document: must be an object"]),
    }
    run = run_batches(rows, None, F.lit("2024-01-01").cast("date"), settle=False)
    assert run.outcomes._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 3  # one for each look at the rows
    totals = {r.job_id: (r.processed, r.failed) for r in run.totals.collect()}
    assert totals == {"j": (2, 3), "m": (0, 1)} and {r.job_id for r in run.failed_batches.collect()} == {"k", "l"}


def test_dead_letters_parse_a_line_as_often_as_the_check(spark):
    """The choice of rows in error doesn't copy the parsing and the checks into a condition."""
    lines = ['{"document_id":"a","text":"t"}', "no json", " ", '{"document_id":1,"text":"t"}', "[1]", None]
    tagged = check_lines(spark.createDataFrame(list(enumerate(lines)), "line long, value string"))
    errors = V.error_rows(tagged)
    parsings = [df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") for df in (tagged, errors)]
    assert 0 < parsings[1] <= parsings[0]
    found = [(r.line_number, r.document_id, r.error_type, r.raw_data_sample) for r in errors.orderBy("line_number").collect()]
    assert found == [
        (1, "line-1", "JSONDecodeError", "no json"),
        (3, "line-3", "ValidationError", '{"document_id":1,"text":"t"}'),
        (4, "line-4", "ValidationError", "[1]"),
    ]
