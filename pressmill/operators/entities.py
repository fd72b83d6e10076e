"""Entity spans from a gazetteer table and from patterns, with character offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions import fixed
from pressmill.functions.binding import bind, explode_rows
from pressmill.schema import ENTITIES

MAX_PLANNED_PHRASES = 5_000
_EDGE = "[^\\p{L}\\p{N}]+"
_TIDY = "^[a-zA-Z0-9](?:.*[a-zA-Z0-9])?$"
_MONTH = (
    "(?:January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\\.?"
)
_AMOUNT = "\\d+(?:, ?\\d{3})*(?:\\. ?\\d{1,2})?"
PATTERNS = [
    (
        "DATE",
        # The look-aheads drop most positions before a boundary and the alternatives are tried.
        "(?=[\\dJFMASONDaltyLTY])\\b(?:\\d{4}-\\d{2}-\\d{2}\\b"
        f"|{_MONTH} \\d{{1,2}}(?:st|nd|rd|th)?,? \\d{{4}}\\b"
        f"|\\d{{1,2}}(?:st|nd|rd|th)? {_MONTH},? \\d{{4}}\\b"
        "|\\d{1,2}/\\d{1,2}/\\d{4}\\b"
        f"|{_MONTH} \\d{{4}}\\b"
        "|(?i:last (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|week|month|year)\\b)"
        "|(?i:(?:\\d+|an?) (?:day|week|month|year)s? ago\\b)"
        "|(?i:(?:today|yesterday|tomorrow)\\b))",
    ),
    (
        "TIME",
        "(?=[\\dNnMm])\\b(?:\\d{1,2}:\\d{2}(?::\\d{2})?(?: ?[AaPp]\\.? ?[Mm]\\b)?|\\d{1,2} ?[AaPp]\\.? ?[Mm]\\b"
        "|(?i:(?:noon|midnight)\\b))",
    ),
    ("MONEY", f"(?=[\\dUEG])\\b(?:(?:USD|EUR|GBP) {_AMOUNT}|{_AMOUNT} (?:USD|EUR|GBP)\\b)"),
    ("PERCENT", "(?=\\d)\\b\\d+(?:\\. ?\\d+)? percent\\b"),
]
_SPAN = "array<struct<start:bigint,rev_end:bigint,priority:int,text:string,type:string>>"


def _span(start: Column, text: Column, priority: int | Column, kind: str | Column) -> Column:
    start = start.cast("bigint")
    return F.struct(
        start.alias("start"),
        (-(start + F.length(text))).alias("rev_end"),
        (F.lit(priority) if isinstance(priority, int) else priority).cast("int").alias("priority"),
        text.alias("text"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
    )


#: Steps that one part of a scan works through before its results are set aside.
SCAN_PART = 128


def scanned(steps: Column, first: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """One pass over an array that carries a state: ``step(state, x)`` gives the next state and an ``array<kind>``.

    An array that grows by one element at a time is copied at each step, which is quadratic in the
    text.  Results are gathered for each part of ``SCAN_PART`` steps and joined once at the end.
    """
    none = F.array().cast(f"array<{kind}>")

    def part(xs: Column, state: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            after, found = step(acc["state"], x)
            return F.struct(after.alias("state"), F.concat(acc["found"], found).alias("found"))

        return F.aggregate(xs, F.struct(state.alias("state"), none.alias("found")), one)

    def whole(xs: Column) -> Column:
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(SCAN_PART))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(
            starts,
            F.struct(first.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("parts")),
            lambda acc, i: bind(
                part(F.slice(xs, i, F.lit(SCAN_PART)), acc["state"]),
                lambda done: F.struct(done["state"].alias("state"), F.concat(acc["parts"], F.array(done["found"])).alias("parts")),
            ),
            lambda acc: F.flatten(acc["parts"]),
        )

    return bind(steps, whole)


def running_starts(steps: Column, offset, width) -> Column:
    """For each step the widths of those before it plus its own offset, in one pass."""
    return scanned(steps, F.lit(0), "int", lambda at, x: ((at + width(x)).cast("int"), F.array((at + offset(x)).cast("int"))))


def pattern_spans(text: Column, pattern: str, kind: str, priority: int = 0) -> Column:
    """Spans of one pattern.  Offsets come from the lengths of the pieces around the matches."""

    def spans(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("size")))
        starts = running_starts(steps, lambda x: x["gap"], lambda x: x["gap"] + x["size"])
        return F.zip_with(found, starts, lambda m, s: _span(s, m, priority, kind))

    def look(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        gaps = F.transform(F.split(t, pattern, -1), F.length)
        return bind(
            found,
            lambda m: F.when(F.size(m) == 0, F.array().cast(_SPAN)).otherwise(bind(gaps, lambda g: spans(m, g))),
        )

    return bind(text, look)


def phrase_candidates(text: Column, max_words: int) -> Column:
    """``array<struct<first, words, phrase>>``: runs of up to ``max_words`` words, outer punctuation off.

    ``first`` is the 0-based number of the run's first word in the single-spaced text, ``words``
    the number of its words.
    """

    def runs(words: Column, k: int) -> Column:
        last = F.size(words) - 1
        positions = F.when(last >= k - 1, F.sequence(F.lit(0), last - (k - 1)))
        return F.transform(
            F.coalesce(positions, F.array().cast("array<int>")),
            lambda i: F.struct(
                i.alias("first"),
                F.lit(k).alias("words"),
                _bare(F.array_join(F.slice(words, i + 1, F.lit(k)), " ") if k > 1 else F.get(words, i)).alias("phrase"),
            ),
        )

    return bind(F.split(text, " "), lambda w: F.concat(*[runs(w, k) for k in range(1, max_words + 1)]))


def _bare(phrase: Column) -> Column:
    """The phrase without punctuation at its ends."""
    return F.when(phrase.rlike(_TIDY), phrase).otherwise(F.regexp_replace(phrase, f"^{_EDGE}|{_EDGE}$", ""))


def _located(text: Column, matches: Column, priority: int = 1) -> Column:
    """Spans of ``array<struct<first, words, phrase, type>>``: where the run starts, then where the phrase does in it."""

    def one(m: Column, words: Column, starts: Column) -> Column:
        run = F.array_join(F.slice(words, m["first"] + 1, m["words"]), " ")
        start = F.get(starts, m["first"]) + F.position(m["phrase"], run) - 1
        return _span(start, m["phrase"], priority, m["type"])

    def look(words: Column) -> Column:
        starts = running_starts(words, lambda w: F.lit(0), lambda w: F.length(w) + 1)
        return bind(starts, lambda s: F.transform(matches, lambda m: one(m, words, s)))

    return F.when(F.size(matches) > 0, bind(F.split(text, " "), look)).otherwise(F.array().cast(_SPAN))


def planned_gazetteer_spans(text: Column, phrases: dict[str, list[str]]) -> Column:
    """Gazetteer spans with the phrases as constant sets in the plan: a projection, no join."""
    known = [p for group in phrases.values() for p in group]
    if not known:
        return F.array().cast(_SPAN)
    widest = max(p.count(" ") + 1 for p in known)

    def kind(phrase: Column) -> Column:
        return F.coalesce(*[F.when(phrase.isin(group), F.lit(t)) for t, group in phrases.items()])

    def look(t: Column) -> Column:
        hits = F.filter(phrase_candidates(t, widest), lambda c: c["phrase"].isin(known))
        typed = F.transform(
            hits, lambda c: F.struct(c["first"].alias("first"), c["words"].alias("words"), c["phrase"].alias("phrase"), kind(c["phrase"]).alias("type"))
        )
        return bind(typed, lambda m: _located(t, m))

    return bind(text, look)


def one_type_each(gazetteer: DataFrame) -> DataFrame:
    """``phrase, type`` with one row per phrase: NULLs and empty phrases out, the first type in order.

    Phrases go through the single spacing and the loss of outer punctuation that the texts'
    candidates go through, so ``U.S.`` is looked up as ``U.S``; a space after an inner full stop,
    as cleaning sets it, makes a phrase of its own.
    """
    single = F.trim(F.regexp_replace("phrase", f"{fixed.WS}+", " "))
    forms = F.array_distinct(F.array(_bare(single), _bare(F.regexp_replace(single, *fixed.PUNCTUATION_SPACING))))
    rows = gazetteer.where("phrase IS NOT NULL AND type IS NOT NULL").select(F.explode(forms).alias("phrase"), "type")
    return rows.where("phrase <> ''").groupBy("phrase").agg(F.min("type").alias("type"))


def resolve_overlaps(spans: Column, types: list[str] | None = None) -> Column:
    """Leftmost spans win, longer before shorter; the rest that overlaps goes.  Offsets are exclusive."""

    def step(end: Column, s: Column) -> tuple[Column, Column]:
        free = s["start"] >= end
        entity = F.struct(s["text"].alias("text"), s["type"].alias("type"), s["start"].alias("start_char"), (-s["rev_end"]).alias("end_char"))
        return F.when(free, -s["rev_end"]).otherwise(end), F.when(free, F.array(entity)).otherwise(F.array().cast(ENTITIES))

    picked = scanned(F.sort_array(spans), F.lit(0).cast("bigint"), ENTITIES.elementType.simpleString(), step)
    return keep_types(picked, types or fixed.ENTITY_TYPES)


def keep_types(entities: Column, types: list[str]) -> Column:
    return F.filter(entities, lambda e: e["type"].isin(types))


def all_pattern_spans(text: Column) -> Column:
    return reduce(
        F.concat, [pattern_spans(text, pattern, kind, i) for i, (kind, pattern) in enumerate(PATTERNS, 2)]
    )


def tag_patterns(text: Column, types: list[str] | None = None) -> Column:
    return bind(text, lambda t: resolve_overlaps(all_pattern_spans(t), types))


def tag_entities(
    df: DataFrame,
    text: str,
    gazetteer: DataFrame | None = None,
    out: str = "entities",
    types: list[str] | None = None,
    max_planned: int = MAX_PLANNED_PHRASES,
    tagger: Callable[[], Callable[[str], list[tuple[int, int, str]]]] | None = None,
) -> DataFrame:
    """Add the entities of a single-spaced text column.

    ``tagger`` makes a model in each task, whose spans win over others that start with them.  A
    text on which it raises an error has no spans of its own; no other text is touched by that.

    ``gazetteer`` has ``phrase, type``.  Up to ``max_planned`` phrases go into the plan as
    constant sets and tagging is a projection; a larger one is joined by phrase.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    if tagger is not None:
        df = df.withColumn("_model_spans", _model_spans(tagger)(plain))
        own = F.col("_model_spans")
    else:
        own = F.array().cast(_SPAN)
    if gazetteer is None:
        tagged = bind(plain, lambda t: resolve_overlaps(F.concat(own, all_pattern_spans(t)), types))
        return df.withColumn(out, tagged).drop("_model_spans")
    gazetteer = one_type_each(gazetteer)
    rows = gazetteer.limit(max_planned + 1).collect()
    if len(rows) <= max_planned:
        phrases: dict[str, list[str]] = {}
        for row in sorted(rows):
            phrases.setdefault(row["type"], []).append(row["phrase"])

        def look(t: Column) -> Column:
            return resolve_overlaps(F.concat(own, all_pattern_spans(t), planned_gazetteer_spans(t, phrases)), types)

        return df.withColumn(out, bind(plain, look)).drop("_model_spans")
    return _tag_by_join(df, text, gazetteer, out, types, own).drop("_model_spans")


def _model_spans(factory):
    """The spans of a caller's model as a column function, row by row in Arrow batches."""

    @F.pandas_udf(_SPAN)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()

        def one(text: str) -> list[dict]:
            try:
                found = model(text)
                return [{"start": a, "rev_end": -b, "priority": 0, "text": text[a:b], "type": kind} for a, b, kind in found]
            except Exception:  # the model's, on this text alone
                return []

        for texts in batches:
            yield texts.map(one)

    return run.asNondeterministic()


def _tag_by_join(
    df: DataFrame, text: str, gazetteer: DataFrame, out: str, types: list[str] | None, own: Column
) -> DataFrame:
    """Any gazetteer size: candidate phrases meet the table, matches return by text hash.

    Copies of a text share its hash, and their equal matches collapse before they are grouped,
    so a group never exceeds the matches of one text.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    widest = gazetteer.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    keyed = df.withColumn("_key", F.sha2(plain, 256))
    runs = explode_rows(keyed, phrase_candidates(plain, widest), "run", "_key").select("_key", "run.*")
    matches = (
        runs.join(gazetteer, "phrase")
        .select("_key", "first", "words", "phrase", "type")
        .distinct()
        .groupBy("_key")
        .agg(F.collect_list(F.struct("first", "words", "phrase", "type")).alias("_matches"))
    )
    located = F.coalesce(_located(plain, F.col("_matches")), F.array().cast(_SPAN))
    spans = F.concat(own, all_pattern_spans(plain), located)
    return keyed.join(matches, "_key", "left").withColumn(out, resolve_overlaps(spans, types)).drop("_key", "_matches")


def first_date_text(entities: Column, cleaned: Column) -> Column:
    """Text of the first DATE entity, else the whole cleaned text."""
    dates = F.filter(entities, lambda e: e["type"] == "DATE")
    return F.coalesce(F.get(dates, F.lit(0))["text"], cleaned)
