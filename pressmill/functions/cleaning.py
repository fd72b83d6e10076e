"""Text cleaning as ``Column -> Column`` functions; no Python runs on the rows."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions import fixed
from pressmill.functions.binding import bind


def _chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def strip_tags(c: Column) -> Column:
    """Each markup tag becomes one space; script and style bodies stay."""

    def strip(x: Column) -> Column:
        rest = F.substring_index(x, ">", -1)  # nothing is a tag after the last ">"
        head = F.left(x, F.length(x) - F.length(rest))
        return F.concat(F.regexp_replace(head, fixed.HTML_TAG, " "), rest)

    return bind(c, lambda x: F.when(x.contains("<"), strip(x)).otherwise(x))


def collapse_whitespace(c: Column) -> Column:
    # A lone blank stays as it is, so only what changes is matched; the look-aheads skip
    # ordinary characters before the long class is tried.
    wide = f"(?![!-~])(?: (?![!-~]){fixed.WS}+|(?! ){fixed.WS}+)"
    return F.trim(F.regexp_replace(c, wide, " "))


def _if_any(c: Column, gate: str, rules: list[tuple[str, str]]) -> Column:
    """Run the rules on texts that match ``gate``, which must match wherever one of them does.

    Most texts hold nothing to replace; one scan then stands for all of them.
    """
    return bind(c, lambda x: F.when(x.rlike(gate), _chain(x, rules)).otherwise(x))


def spell_currency(c: Column) -> Column:
    words = "usd|us dollars?|eur|euros?|gbp|pounds?sterling"
    return _if_any(c, f"[$£€]|(?=[uUeEgGpP])(?iuU:\\b(?:{words})\\b)", fixed.CURRENCY)


def spell_units(c: Column) -> Column:
    """Numbers followed by a unit or percent sign: in one pass, rule by rule where a text holds the mark itself."""
    rules = [fixed.PERCENT]
    rules += [(f"{fixed.NUMBER}{fixed.WS}*+{short}\\b", f"$1 {name}") for short, name in fixed.UNITS]
    names = "|".join(short for short, _ in fixed.UNITS)
    mark = fixed.UNIT_MARK

    def spelled(x: Column) -> Column:
        out = F.regexp_replace(x, *fixed.MARKED_UNITS)
        for short, name in [("%", "percent"), *fixed.UNITS]:
            out = F.replace(out, F.lit(f"{mark}{short}{mark}"), F.lit(name))
        return out

    return bind(
        c,
        lambda x: F.when(~x.rlike(f"(?U)\\d{fixed.WS}*+(?:%|(?:{names})\\b)"), x)
        .when(x.contains(mark), _chain(x, rules))
        .otherwise(spelled(x)),
    )


def plain_dashes(c: Column) -> Column:
    return F.translate(c, fixed.DASHES, "-" * len(fixed.DASHES))


def plain_dashes_and_quotes(c: Column) -> Column:
    """Both in one pass."""
    curly = fixed.SMART_DOUBLE + fixed.SMART_SINGLE
    return F.translate(c, fixed.DASHES + curly, "-" * len(fixed.DASHES) + "\"\"''")


def straight_quotes(c: Column) -> Column:
    return F.translate(c, fixed.SMART_DOUBLE + fixed.SMART_SINGLE, "\"\"''")


def printable_ascii(c: Column) -> Column:
    return F.regexp_replace(c, fixed.NON_PRINTABLE, "")


def single_punctuation(c: Column) -> Column:
    marks = "".join(fixed.REPEATED)
    return F.regexp_replace(c, f"([{marks}])\\1+", "$1")


def space_after_punctuation(c: Column) -> Column:
    return _chain(c, [fixed.PUNCTUATION_SPACING])


@dataclass(frozen=True)
class CleaningConfig:
    """Step switches and typo options: plain values (decided while planning) or Columns (per row)."""

    remove_html_tags: Any = True
    normalize_whitespace: Any = True
    fix_encoding: Any = True
    standardize_currency: Any = True
    standardize_units: Any = True
    normalize_punctuation: Any = True
    normalize_unicode_dashes: Any = True
    normalize_smart_quotes: Any = True
    remove_excessive_punctuation: Any = True
    add_space_after_punctuation: Any = True
    enable_typo_correction: Any = True
    keep_unicode: bool = False
    typo_min_length: Any = fixed.TYPO_MIN_LENGTH
    typo_max_length: Any = fixed.TYPO_MAX_LENGTH
    typo_skip_capitalized: Any = True
    typo_skip_mixed_case: Any = True
    typo_use_ner: Any = True
    typo_confidence: Any = fixed.TYPO_CONFIDENCE

    def override(self, options: dict[str, Any] | None) -> CleaningConfig:
        """Options win over this config; absent or None options keep its values.

        Typo options may come flat (``typo_min_length``) or nested under ``typo_correction``.
        """
        if not options:
            return self
        nested = options.get("typo_correction") or {}
        names = {
            "min_word_length": "typo_min_length",
            "max_word_length": "typo_max_length",
            "skip_capitalized_words": "typo_skip_capitalized",
            "skip_mixed_case": "typo_skip_mixed_case",
            "use_ner_entities": "typo_use_ner",
            "confidence_threshold": "typo_confidence",
        }
        flat = {names[k]: v for k, v in nested.items() if k in names}
        flat.update({k: v for k, v in options.items() if k != "typo_correction"})
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in flat.items() if k in known and v is not None})


DEFAULT_CONFIG = CleaningConfig()
SWITCHES = [
    "remove_html_tags",
    "normalize_whitespace",
    "fix_encoding",
    "standardize_currency",
    "standardize_units",
    "normalize_punctuation",
    "normalize_unicode_dashes",
    "normalize_smart_quotes",
    "remove_excessive_punctuation",
    "add_space_after_punctuation",
    "enable_typo_correction",
]


TYPO_OPTIONS = [
    "typo_min_length",
    "typo_max_length",
    "typo_skip_capitalized",
    "typo_skip_mixed_case",
    "typo_use_ner",
    "typo_confidence",
]


def per_row_config(
    override: Column, base: CleaningConfig = DEFAULT_CONFIG, options: list[str] = SWITCHES
) -> CleaningConfig:
    """Config whose ``options`` (of ``SWITCHES`` and ``TYPO_OPTIONS``) read the fields of an override struct, else ``base``."""
    return replace(base, **{s: F.coalesce(override.getField(s), F.lit(getattr(base, s))) for s in options})


def _apply(switch: Any, step, c: Column) -> Column:
    if isinstance(switch, Column):
        return bind(c, lambda x: F.when(switch, step(x)).otherwise(x))
    return step(c) if switch else c


def _both(a: Any, b: Any) -> Any:
    if isinstance(a, Column) or isinstance(b, Column):
        return (a if isinstance(a, Column) else F.lit(a)) & (b if isinstance(b, Column) else F.lit(b))
    return a and b


def clean_before_encoding(c: Column, cfg: CleaningConfig = DEFAULT_CONFIG) -> Column:
    c = _apply(cfg.remove_html_tags, strip_tags, c)
    return _apply(cfg.normalize_whitespace, collapse_whitespace, c)


def clean_after_encoding(c: Column, cfg: CleaningConfig = DEFAULT_CONFIG) -> Column:
    """Everything between the encoding step and the typo step."""
    c = _apply(cfg.standardize_currency, spell_currency, c)
    c = _apply(cfg.standardize_units, spell_units, c)
    dashes = _both(cfg.normalize_punctuation, cfg.normalize_unicode_dashes)
    quotes = _both(cfg.normalize_punctuation, cfg.normalize_smart_quotes)
    if dashes is True and quotes is True:
        c = plain_dashes_and_quotes(c)
    else:
        c = _apply(quotes, straight_quotes, _apply(dashes, plain_dashes, c))
    if not cfg.keep_unicode:
        c = _apply(cfg.normalize_punctuation, printable_ascii, c)
    c = _apply(cfg.remove_excessive_punctuation, single_punctuation, c)
    return _apply(cfg.add_space_after_punctuation, space_after_punctuation, c)


def clean_text(c: Column, cfg: CleaningConfig = DEFAULT_CONFIG) -> Column:
    """The column-only part of the chain: every step but encoding repair and typos."""
    c = clean_after_encoding(clean_before_encoding(c, cfg), cfg)
    return _apply(cfg.normalize_whitespace, collapse_whitespace, c)
