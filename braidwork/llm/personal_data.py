"""Personal data in text: generators, boosted trees and calibrated thresholds, with DataFrame functions only.

Exact patterns give the base spans. High-recall generators propose further
spans, which may overlap. Trees score a proposal by its format and by the words
around it. They are fitted to silver labels: a proposal counts as positive if it
overlaps a base span, is an account number whose check digits are right, or
follows an assignment to a secret, counted over all documents. That assignment
is no feature: the trees learn what secrets look like, and find them elsewhere.
A quarter of the documents is held back to set the threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm import boosting, spans
from braidwork.llm.scratch import written

#: Base kinds in report order, their patterns, and a needle without which the pattern can't match. Loops over groups are
#: possessive: nothing follows them, so they match the same, and Java's matcher then takes no stack for each turn. Fixed values.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)

#: Generators: kind, pattern, needle. Fixed values.
PROPOSED = (
    ("secret", r"[A-Za-z0-9_-]{16,}+", None),
    ("number", r"[0-9](?:[\x20().-]{0,2}[0-9]){8,}+", None),
    ("address", r"[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++", "at"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", None),
)

#: Share of redacted proposals that must be positive on the held-back quarter.
PRECISION = 0.95

#: Proposals further than this from a keyword don't have it as context.
CONTEXT = 24

FEATURES = ["kind", "n_chars", "n_digits", "n_letters", "n_breaks", "n_distinct", "upper", "near", "checked", "quoted"]

_DIGITS = "regexp_replace({x}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn check."""
    return f"""aggregate(sequence(1, length({digits})), 0, (acc, i) -> acc + CASE WHEN i % 2 = 1 THEN CAST(substring({digits}, length({digits}) - i + 1, 1) AS INT)
        WHEN substring({digits}, length({digits}) - i + 1, 1) >= '5' THEN 2 * CAST(substring({digits}, length({digits}) - i + 1, 1) AS INT) - 9
        ELSE 2 * CAST(substring({digits}, length({digits}) - i + 1, 1) AS INT) END) % 10 = 0"""


#: Whether an account number has the remainder 1 by 97, read with its first four characters last and letters as two digits.
_ACCOUNT = """aggregate(split(concat(substring({x}, 5), left({x}, 4)), ''), 0, (acc, c) -> CASE WHEN c = '' THEN acc WHEN c <= '9' THEN (acc * 10 + ascii(c) - 48) % 97
        ELSE (acc * 100 + ascii(c) - 55) % 97 END) = 1""".format(x="regexp_replace(m.s, ' ', '')")

_CHECKS = {
    "email": "true",
    "ip": "forall(split(m.s, '[.]'), p -> length(regexp_replace(p, '^0+(?=.)', '')) <= 3 AND CAST(right(p, 3) AS INT) <= 255)",
    "card": f"length({_DIGITS.format(x='m.s')}) BETWEEN 14 AND 19 AND {_luhn(_DIGITS.format(x='m.s'))}",
    "phone": f"length({_DIGITS.format(x='m.s')}) BETWEEN 10 AND 15",
}


def _matches(pattern: str, needle: str | None) -> Column:
    """array<struct<a, b, s>>: leftmost non-overlapping matches in ``_text``, by code points, end exclusive."""
    found = spans.places(spans.cut(F.col("_text"), F.lit(f"({pattern})")), lambda part, _: F.length(part))
    possible = F.col("_text").contains(needle) if needle else F.lit(True)
    return F.when(possible & F.col("_text").rlike(r"[0-9@]|\(at\)|\[at\]|[A-Za-z0-9_-]{16}"), found).otherwise(F.array().cast("array<struct<a:bigint,b:bigint,s:string>>"))


def _bucket(value: str, *limits: int) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {x} THEN {i}" for i, x in enumerate(limits)) + f" ELSE {len(limits)} END"


def proposals(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, base (array of a, kind, b) and proposed (array of spans with features)."""
    out = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    for k, (name, pattern, needle) in enumerate(BASE):
        out = out.withColumn(f"_{name}", _matches(pattern, needle))
        out = out.withColumn(f"_{name}", F.expr(f"transform(filter(_{name}, m -> {_CHECKS[name]}), m -> struct(m.a AS a, {k} AS kind, m.b AS b))"))
    out = out.withColumn("base", F.array_sort(F.concat(*[F.col(f"_{name}") for name, _, _ in BASE]))).drop(*[f"_{name}" for name, _, _ in BASE])
    for k, (name, pattern, needle) in enumerate(PROPOSED):
        out = out.withColumn(f"_{name}", _matches(pattern, needle))
        before = f"lower(substring(_text, CAST(greatest(m.a - {CONTEXT}, 0) + 1 AS INT), CAST(least(m.a, {CONTEXT}) AS INT)))"
        digits = _DIGITS.format(x="m.s")
        out = out.withColumn(
            f"_{name}",
            F.expr(
                f"""transform(_{name}, m -> struct(m.a AS a, {len(BASE) + k} AS kind, m.b AS b, struct({k} AS kind,
                {_bucket('length(m.s)', 15, 20, 31, 40, 64)} AS n_chars, {_bucket(f'length({digits})', 0, 5, 9, 13, 15, 19)} AS n_digits,
                {_bucket("length(regexp_replace(m.s, '[^A-Za-z]', ''))", 0, 3, 10)} AS n_letters,
                {_bucket("length(regexp_replace(m.s, '[A-Za-z0-9]', ''))", 0, 2, 4)} AS n_breaks, IF(m.s rlike '[A-Z]', 1, 0) AS upper,
                {_bucket("size(array_distinct(split(m.s, '')))", 4, 8, 11, 14)} AS n_distinct,
                CASE WHEN {before} rlike '(?:tel|phone|fax|call|mobil)' THEN 2 WHEN {before} rlike '(?:card|visa|iban|account|ssn)' THEN 1 ELSE 0 END AS near,
                IF({_ACCOUNT if name == 'account' else f'length({digits}) BETWEEN 12 AND 19 AND {_luhn(digits)}'}, 1, 0) AS checked,
                IF(m.a > 0 AND substring(_text, CAST(m.a AS INT), 1) IN ('"', "'", '=', '+'), 1, 0) AS quoted) AS f,
                exists(base, s -> s.a < m.b AND m.a < s.b) AS overlaps, {_ACCOUNT if name == 'account' else 'false'} OR {before} rlike '(?:token|secret|passw|api.?key)[a-z_]*.{{0,2}}[=:].{{0,2}}$' AS assigned))"""
            ),
        )
    names = [f"_{name}" for name, _, _ in PROPOSED]
    return out.select("doc_id", "base", F.concat(*names).alias("proposed"))


def fit(found: DataFrame, *, precision: float = PRECISION) -> tuple[str, float]:
    """The score as SQL over a proposal ``m``, and its threshold, from the counts of every proposal in ``found``."""
    held = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, F.lit(False)).alias("held")
    each = found.select(held, F.explode("proposed").alias("m")).select("held", (F.col("m.overlaps") | F.col("m.assigned")).cast("long").alias("y"), *[F.col(f"m.f.{n}").alias(n) for n in FEATURES])
    counts = each.groupBy("held", *FEATURES).agg(F.sum("y").alias("positives"), F.count("*").alias("total")).collect()
    rows = np.array([[r[n] for n in FEATURES] for r in counts], dtype=np.int64).reshape(-1, len(FEATURES))
    positives, totals = (np.array([r[n] for r in counts], dtype=float) for n in ("positives", "total"))
    held = np.array([r["held"] for r in counts], dtype=bool)
    bias, trees = boosting.fit(rows[~held], positives[~held], totals[~held])
    scores = np.array([boosting.probability(bias, trees, r) for r in rows])
    return boosting.sql(bias, trees, [f"m.f.{n}" for n in FEATURES]), boosting.threshold(scores[held], positives[held], totals[held], precision)


def detect(docs: DataFrame, *, precision: float = PRECISION) -> DataFrame:
    """docs(doc_id, text, ..) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, one row per row of ``docs``.

    Null or empty text has no spans. Repeated rows repeat. A proposal is
    reported where its score reaches the threshold and no base span overlaps it.
    Other columns of ``docs`` are not read; an empty table gives none.
    """
    found = written(proposals(docs), name="proposals")
    score, limit = fit(found, precision=precision)
    kinds = F.array(*[F.lit(n) for n, _, _ in (*BASE, *PROPOSED)])
    extra = F.expr(f"transform(filter(proposed, m -> NOT m.overlaps AND {score} >= {limit - 1e-9:.12f}D), m -> struct(m.a AS a, m.kind AS kind, m.b AS b))")

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.a.cast("string"), s.b.cast("string"))), ",")

    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == k)).cast("long")

    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{name}") for k, (name, _, _) in enumerate(BASE)],
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", extra))).alias("spans"),
        F.size(F.concat("base", extra)).cast("long").alias("n_spans"),
    )
