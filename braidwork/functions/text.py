"""Scalar functions over names, titles and source lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories of story variables by what their names contain, the first that fits. Fixed values.
CATEGORIES = (
    ("relationship", ("affection", "dating", "friend", "love", "lust", "relationship", "romance")),
    ("skill", ("charisma", "intelligence", "skill", "strength", "wits", "wisdom")),
    ("resource", ("cash", "coin", "gold", "inventory", "item", "money", "resource")),
    ("job", ("company", "job", "workplace")),
    ("location", ("location",)),
    ("role", ("member", "role")),
    ("flag", ("allegiance", "cheating", "dating", "event", "flag", "route")),
    ("progression", ("chapter", "day", "progress", "stage", "time", "week")),
)

#: Keys whose values are not to be shown. Fixed values.
SENSITIVE = ("api_key", "apikey", "authorization", "password", "secret", "token")


def folded(text: Column) -> Column:
    """Text for comparison without case: lower case, with sharp s as ss and final sigma as sigma."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ς", "σ")


def category(name: Column) -> Column:
    """The category of a variable by its name; ``unknown`` where no term fits."""
    low = folded(name)
    return F.coalesce(*[F.when(low.rlike("|".join(terms)), label) for label, terms in CATEGORIES], F.lit("unknown"))


def display_name(name: Column) -> Column:
    """``a.b_c`` as ``A B C``: words of a name with a capital each."""
    words = F.filter(F.split(name, r"[._]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def readable(identifier: Column) -> Column:
    """An identifier as a label: camel case and separators as blanks, the first letter a capital."""
    spaced = F.regexp_replace(F.regexp_replace(identifier, r"([a-z0-9])([A-Z])", "$1 $2"), r"[._\-]+", " ")
    low = F.lower(F.trim(spaced))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 20))


def story_marker(title: Column, word: str) -> Column:
    """The number after ``day``, ``chapter``, ``episode`` or ``act`` in a title, whatever their case; null without."""
    return F.nullif(F.regexp_extract(title, rf"(?i)\b{word}[\s_]*([0-9]+)", 1), F.lit("")).cast("int")


def cut(text: Column, most: int) -> Column:
    """The first ``most`` characters; where some are left out, an ellipsis is the last of them."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def source_kind(line: Column) -> Column:
    """The first word of a source line without its colon; ``blank`` and ``comment`` for such lines."""
    bare = F.trim(line)
    return F.when(bare == "", "blank").when(bare.startswith("#"), "comment").otherwise(F.regexp_replace(F.regexp_extract(bare, r"^(\S+)", 1), ":+$", ""))


def instant(at: Column) -> Column:
    """A time as ISO-8601 text in UTC with microseconds, which sorts as the times do."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def in_order(values: Column) -> Column:
    """Distinct values in the order in which they first stand."""
    return F.array_distinct(values)


def literal(text: Column) -> Column:
    """(kind, value) of a literal: none, bool, number or text; null for anything else."""
    bare = F.trim(text)
    quoted = bare.rlike(r"^(?:\"[^\"\\]*\"|'[^'\\]*')$")
    return (
        F.when(bare == "None", F.struct(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("value")))
        .when(bare.isin("True", "False"), F.struct(F.lit("bool").alias("kind"), F.lower(bare).alias("value")))
        .when(bare.rlike(r"^-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"), F.struct(F.lit("number").alias("kind"), bare.alias("value")))
        .when(quoted, F.struct(F.lit("text").alias("kind"), F.substring(bare, F.lit(2), F.length(bare) - 2).alias("value")))
    )


def threshold_class(value: Column, thresholds: list[float]) -> Column:
    """Which of the ranges between sorted thresholds a number is in: ``=t``, ``<t`` for the next one above, ``>t`` past the last."""
    ordered = sorted(thresholds)
    if not ordered:
        return F.lit("numeric")
    cases = [F.when(value == t, f"={t:g}").when(value < t, f"<{t:g}") for t in ordered]
    return F.coalesce(*cases, F.lit(f">{ordered[-1]:g}"))


def sensitive_keys(json: Column) -> Column:
    """The keys of a JSON object, sorted, that name something secret, however they are written."""
    plain = lambda k: F.regexp_replace(F.lower(k), r"[-\s]", "_")
    keys = F.regexp_extract_all(json, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: plain(k).rlike("|".join(SENSITIVE)))))
