"""Text functions: cleaning, HTML, small string helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, spelt out so that every engine means the same.
SPACE = r"[ \t\n\x0B\f\r]"
_TRIMMED = " \t\n\r\f\x0b"
# Entities and what they stand for, replaced one after the other in this order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"))
# The cleaner's patterns.
TAG = "<[^>]*>"
PAGE_HEADER = r"^\s*(?:Page|Document)\s+\d+.*?(?:\n|\r\n?)"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

Rule = Callable[[Column], Column]


def regex_rule(pattern: str, replacement: str) -> Rule:
    return lambda c: F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(_TRIMMED))


def decode_entities(c: Column) -> Column:
    """Entities replaced in the table's order, so a doubly escaped one is decoded as far as the order goes."""
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def html_text(c: Column) -> Column:
    """Tags out, white space collapsed, entities decoded, trimmed."""
    return trim_space(decode_entities(collapse_space(F.regexp_replace(c, TAG, ""))))


#: The default rules, in order. White space is collapsed before lines are looked at, so only one line is left.
DEFAULT_RULES: tuple[Rule, ...] = (
    regex_rule(TAG, " "),
    collapse_space,
    regex_rule(PAGE_HEADER, ""),
    regex_rule(CONTROLS, ""),
    decode_entities,
    regex_rule(r"(\r\n|\n|\r){3,}", "\n\n"),
)
#: The rules of the basic cleaner, after the default ones.
BASIC_RULES: tuple[Rule, ...] = (
    regex_rule(r"\r\n", "\n"),
    regex_rule(r"[ \t]+", " "),
    regex_rule(r"\n[ \t]+", "\n"),
    regex_rule(r"[ \t]+\n", "\n"),
    regex_rule(r"\n{3,}", "\n\n"),
    regex_rule(CONTROLS, ""),
)
#: The same work, but lines and paragraphs stay.
STRUCTURED_RULES: tuple[Rule, ...] = (
    regex_rule(TAG, " "),
    regex_rule(r"(?m)^[ \t]*(?:Page|Document)[ \t]+\d+[^\n\r]*(?:\r\n|\n|\r)", ""),
    decode_entities,
    *BASIC_RULES,
)


class Cleaner:
    """Rules applied one after the other, then trimmed. ``mode`` is ``reference``, ``basic`` or ``structured``."""

    def __init__(self, mode: str = "reference", rules: tuple[Rule, ...] | None = None):
        known = {"reference": DEFAULT_RULES, "basic": DEFAULT_RULES + BASIC_RULES, "structured": STRUCTURED_RULES, "none": ()}
        self.rules: list[Rule] = list(known[mode] if rules is None else rules)

    def add_regex(self, pattern: str, replacement: str) -> Cleaner:
        self.rules.append(regex_rule(pattern, replacement))
        return self

    def add(self, rule: Rule) -> Cleaner:
        """``rule`` takes a column and returns one: built-in functions, or a pandas UDF."""
        self.rules.append(rule)
        return self

    def __call__(self, c: Column) -> Column:
        for rule in self.rules:
            c = rule(c)
        return trim_space(c)


def split_on(c: Column, delimiter: str) -> Column:
    """Parts between single characters ``delimiter``; an empty last part is dropped."""
    parts = F.split(c, "\\Q" + delimiter + "\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def collapse_double_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def mask_connection(c: Column) -> Column:
    """A connection string with its passwords replaced."""
    return F.regexp_replace(c, r"(?i)(password|pwd)\s*=\s*[^;]*", "$1=***")
