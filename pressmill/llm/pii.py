"""Personal data: fixed patterns, and further identifiers found by the company they keep.

What the fixed patterns find are seeds.  The words around seeds are lexical patterns; tokens that
hold a digit or an at sign and are no seeds are candidates.  Spark scores the graph of patterns
and instances in rounds: a pattern is trusted for a kind as far as its instances are of the kind,
a candidate as far as its patterns are trusted.  Candidates that highly trusted patterns name count
towards the support of further patterns, and are added wherever they stand; so are all candidates
of highly trusted patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import slices, texts_of
from pressmill.session import written

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMERIC = re.compile(r"[+0-9][0-9 .()\-]*+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]")
EDGES = "\"'`.,;:!?()[]{}<>|*#$%&"
#: Characters before and after an instance in which its neighbouring words are looked for.
NEAR = 200
LEAST_CANDIDATE, LEAST_DIGITS = 6, 4
#: Rounds of scoring, trust from which a pattern or a value counts, different seeds or such values that a pattern needs.
ROUNDS, TRUST, SUPPORT = 3, 0.8, 5
PLACE = "__place"
SPAN = "struct<rank:int,start:long,end:long,value:string,before:string,after:string>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))
    digits = re.sub("[^0-9]", "", text)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Valid matches as (start, rank of the kind, end) in order, and matches that fail the kind's test.

    Every step is linear in the text: address names are read backwards from each at sign, and
    numbers within runs of the characters that they can hold.
    """
    found, failed, last = [], [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    for run in NUMERIC.finditer(text):
        if run.end() - run.start() < 4:
            continue
        part, offset = run[0], run.start()
        for rank, pattern in ((1, IP), (2, CARD), (3, PHONE)):
            for m in pattern.finditer(part):
                if valid(KINDS[rank], m[0]):
                    found.append((offset + m.start(), rank, offset + m.end()))
                elif m.end() - m.start() >= 7:
                    failed.append((offset + m.start(), offset + m.end()))
    return sorted(found), sorted(failed)


def clear_of(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of sorted ``spans`` that meet none of sorted ``taken`` nor an earlier one of themselves."""
    out, k, reach, last = [], 0, 0, 0
    for a, b in spans:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if a >= max(reach, last):
            out.append((a, b))
            last = b
    return out


def candidates(text: str, found: list[tuple[int, int, int]], failed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that may be identifiers, clear of ``found``: failed matches, and tokens of
    ``LEAST_CANDIDATE`` characters with an at sign or with ``LEAST_DIGITS`` digits."""
    taken = [(a, b) for a, _, b in found]
    near = clear_of(failed, taken)
    tokens = []
    at = MARKED.search(text)
    while at:
        a, b = at.start(), at.end()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        token = text[a:b].rstrip(EDGES)
        left = len(token) - len(token.lstrip(EDGES))
        if len(token) - left >= LEAST_CANDIDATE and ("@" in token or sum(map(token.count, "0123456789")) >= LEAST_DIGITS):
            tokens.append((a + left, a + len(token)))
        at = MARKED.search(text, b)
    return sorted(near + clear_of(tokens, sorted(taken + near)))


def around(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words before a span, and the one after it, in lower case without marks at their edges."""
    before = " ".join(w.strip(EDGES).lower() for w in text[max(0, start - NEAR) : start].split()[-2:])
    after = " ".join(w.strip(EDGES).lower() for w in text[end : end + NEAR].split()[:1])
    return before, after


def extracted(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` its seeds (``base``) and ``candidates``, as lists of ``SPAN``.

    ``place`` tells rows apart (column ``PLACE`` of ``docs`` if there is one).  A null text is
    taken as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("rank", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string())])
        for batch in slices(batches, "text"):
            seeds, others = [], []
            for text in texts_of(batch, "text"):
                found, failed = base_spans(text)
                one = lambda rank, a, b: (rank, a, b, text[a:b], *around(text, a, b))  # noqa: E731, B023
                seeds.append([one(rank, a, b) for a, rank, b in found])
                others.append([one(None, a, b) for a, b in candidates(text, found, failed)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("place"), pa.array(seeds, pa.list_(kind)), pa.array(others, pa.list_(kind))],
                ["doc_id", "place", "base", "candidates"],
            )

    place = F.col(PLACE) if PLACE in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long"), place.alias("place"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id long, place long, base array<{SPAN}>, candidates array<{SPAN}>")


def patterns(span):
    """Lexical patterns of a span: both words before it; the word before it and the one after."""
    last = F.substring_index(span["before"], " ", -1)
    two = F.when(F.instr(span["before"], " ") > 1, F.concat(span["before"], F.lit(" _")))
    return F.array_compact(F.array(two, F.when((last != "") & (span["after"] != ""), F.concat(last, F.lit(" _ "), span["after"]))))


def trusted(found: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Patterns, and values of candidates, trusted for a kind: ``pattern, rank, trust`` and ``value, rank, trust``.

    Copies of a text give one edge, as edges are made distinct first; a very common pattern or
    instance is summed before it is dealt out.  Patterns have a support of different seeds and, from
    the second round on, of values that trusted patterns of the round before name; the one added to a
    pattern's size and the number of rounds keep it from drifting.
    """
    spans = found.select(F.explode(F.concat("base", "candidates")).alias("s"))
    edges = written(spans.select(F.explode(patterns(F.col("s"))).alias("pattern"), "s.value", "s.rank").distinct(), "pii-edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    seeds = edges.where("rank IS NOT NULL").select("pattern", "rank", F.lit(1.0).alias("score"), F.lit(1).alias("support"))
    open_edges = edges.where("rank IS NULL").select("pattern", "value")
    either = lambda score: 1 - F.exp(F.sum(F.log(F.greatest(1 - score, F.lit(1e-9)))))
    scored = seeds
    for k in range(rounds):
        sums = scored.groupBy("pattern", "rank").agg(F.sum("score").alias("score"), F.sum("support").alias("support"))
        rated = sums.join(size, "pattern").select("pattern", "rank", (F.col("score") / (F.col("size") + 1)).alias("trust"), "support")
        good = written(rated.where(F.col("support") >= support).select("pattern", "rank", "trust"), f"pii-patterns-{k}")
        sure = F.when(F.col("trust") >= trust, F.col("trust")).otherwise(0.0)
        instances = open_edges.join(good, "pattern").groupBy("value", "rank").agg(either(F.col("trust")).alias("score"), either(sure).alias("sure"))
        if k < rounds - 1:
            scored = seeds.unionByName(open_edges.join(instances, "value").select("pattern", "rank", "score", (F.col("sure") >= trust).cast("int").alias("support")))
    values = instances.where(F.col("sure") >= trust).select("value", "rank", F.col("sure").alias("trust"))
    return good.where(F.col("trust") >= trust), written(values, "pii-values")


def found_in(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: ``doc_id, place, base`` and ``more``, the spans that patterns and values added.

    Spans are structs of rank (of the kind in ``KINDS``), start and end in code points.  Null and
    empty texts have none; equal rows have equal spans; an empty table gives no row.
    """
    found = written(extracted(docs), "pii-found")
    by_pattern, by_value = trusted(found)
    spans = found.select("place", F.explode("candidates").alias("s"))
    named = spans.select("place", "s", F.explode(patterns(F.col("s"))).alias("pattern")).join(by_pattern, "pattern").select("place", "s.start", "s.end", "rank", "trust")
    named = named.unionByName(spans.select("place", "s.start", "s.end", "s.value").join(by_value, "value").drop("value"))
    named = named.groupBy("place", "start", "end").agg(F.max_by("rank", F.struct("trust", -F.col("rank"))).alias("rank"))
    more = named.groupBy("place").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return found.select("doc_id", "place", plain.alias("base")).join(more, "place", "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<start:long,rank:int,end:long>>")))


def number_of(spans, kind: str):
    """How many of ``spans`` are of ``kind``."""
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind)))


def listed(spans):
    """``kind:start:end`` of spans in order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets, and ``n_chars`` of the new text.

    Where spans overlap, the union is replaced under the first one's kind.  Texts without spans,
    null ones too, stay as they are; so do all other columns.
    """
    numbered = written(docs.withColumn(PLACE, F.monotonically_increasing_id()), "pii-rows")
    spans = found_in(numbered).select(F.col("place").alias(PLACE), F.concat("base", "more").alias("__spans")).where("size(__spans) > 0")
    joined = numbered.join(spans, PLACE, "left")
    kept = [f for f in joined.schema.fields if f.name not in (PLACE, "__spans", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist()):
                if text is not None and spans:
                    parts, last = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], s["rank"])):
                        if s["start"] >= last:
                            parts += [text[last : s["start"]], f"<{KINDS[s['rank']]}>"]
                        last = max(last, s["end"])
                    text = "".join([*parts, text[last:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(out, pa.string())], [*(f.name for f in kept), "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string"])
    changed = joined.select(*(F.col(f"`{f.name}`") for f in kept), "text", "__spans").mapInArrow(run, schema)
    return changed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)
