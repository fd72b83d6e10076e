"""Quotes inside strings are escaped by Spark's own expressions, as the plain rule says."""

import random
import re

from pressmill.operators.repair import repair_quotes

STRING = re.compile(
    r'(?P<after_colon>:[\s\[]*)?"(?P<body>(?:[^\\]|\\.)*?)"(?(after_colon)(?=\s*(?:[,}\]]|\Z))|(?=\s*(?:[:,}\]]|\Z)))', re.DOTALL
)


def plain(text):
    def escape(found):
        body = re.sub(r'(\\.)|"', lambda m: m.group(1) or '\\"', found.group("body"), flags=re.DOTALL)
        return f'{found.group("after_colon") or ""}"{body}"'

    return None if text is None else STRING.sub(escape, text)


def test_random_lines(column):
    r = random.Random(5)
    texts = ["".join(r.choices(['"', '"', ":", ",", "}", "]", "[", "{", "\\", " ", "\n", "\xa0", "\u2028", "a", "é", "😀", "$1"], k=r.randint(0, 30))) for _ in range(5000)]
    texts += [None, "", '{"text":"' + 'a "b" c\\n ' * 50_000 + '"}', '{"text":"' + "word " * 100_000]
    assert column(repair_quotes, texts) == [plain(t) for t in texts]


def test_no_python_worker(spark):
    from pyspark.sql import functions as F

    plan = spark.range(1).select(repair_quotes(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "Python" not in plan
