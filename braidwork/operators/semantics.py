"""Beats, scenes and guards from statement rows and control flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators.graphs import chains

#: Speakers whose lines are narration. Fixed values.
NARRATORS = ("narrator", "nvl_narrator", "centered")

_TEXT = r"(?s)^\s*(?:([A-Za-z_][A-Za-z0-9_.]*)(?:\s+[A-Za-z0-9_@]+)*\s+)?(\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+')\s*(?:\(.*\)|nointeract|with\s+\w+)?\s*$"


def spoken(statements: DataFrame) -> DataFrame:
    """Statements that say something, with ``spoken_kind`` (narration or dialogue), ``speaker`` and ``spoken``; ``extend`` is dialogue without a speaker."""
    who, what = F.regexp_extract("text", _TEXT, 1), F.regexp_extract("text", _TEXT, 2)
    said = statements.where("kind = 'statement'").withColumn("_who", who).withColumn("_what", what).where("_what <> ''")
    narrates = (F.col("_who") == "") | F.col("_who").isin(*NARRATORS)
    speaker = F.when(~narrates & (F.col("_who") != "extend"), F.col("_who"))
    return said.select(*statements.columns, F.when(narrates, "narration").otherwise("dialogue").alias("spoken_kind"), speaker.alias("speaker"), F.substring("_what", F.lit(2), F.length("_what") - 2).alias("spoken"))


def scene_classes(statements: DataFrame) -> DataFrame:
    """(label, scene_class): narrative where something is said; utility where it is called, returns and holds code alone; else unknown."""
    said = spoken(statements).select("label").distinct().withColumn("said", F.lit(True))
    called = statements.where("kind = 'call' AND target IS NOT NULL").select(F.col("target").alias("label")).distinct().withColumn("called", F.lit(True))
    plain = F.bool_and(F.col("kind").isin("label", "return") | F.coalesce(F.col("reason") == "embedded_python_not_executed", F.lit(False)))
    rows = statements.groupBy("label").agg(plain.alias("plain"), F.bool_or(F.col("kind") == "return").alias("returns")).join(said, "label", "left").join(called, "label", "left")
    return rows.select("label", F.when(F.col("said"), "narrative").when(F.col("called") & F.col("returns") & F.col("plain"), "utility").otherwise("unknown").alias("scene_class"))


def arm_guards(statements: DataFrame) -> DataFrame:
    """Arms with ``arm``, ``predicate`` and ``guard``: an ``if`` arm holds where its condition does and none before it did; a choice where its own does.

    predicate: if_branch, if_else, choice.
    """
    arms = statements.where("kind IN ('branch', 'choice')").withColumn("owner", F.coalesce("chain", "parent"))
    w = W.partitionBy("path", "owner").orderBy("stmt")
    prior = F.collect_list(F.concat(F.lit("not ("), F.col("condition"), F.lit(")"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    own = F.when(F.col("condition").isNotNull(), F.array(F.concat(F.lit("("), F.col("condition"), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    parts = F.when(F.col("kind") == "branch", F.concat(prior, own)).otherwise(own)
    kind = F.when(F.col("kind") == "choice", "choice").when(F.col("condition").isNull(), "if_else").otherwise("if_branch")
    return arms.select(*statements.columns, (F.row_number().over(w) - 1).alias("arm"), kind.alias("predicate"), F.coalesce(F.nullif(F.array_join(parts, " and "), F.lit("")), F.lit("true")).alias("guard"))


def menu_feasibility(statements: DataFrame) -> DataFrame:
    """(path, stmt, n_arms, n_conditions, no_choice): leaving a menu without a choice is impossible if an arm is free, conditional if all have conditions, unresolved without arms."""
    arms = statements.where("kind = 'choice'").groupBy("path", F.col("parent").alias("stmt")).agg(F.count("*").cast("int").alias("n_arms"), F.count("condition").cast("int").alias("n_conditions"))
    joined = statements.where("kind = 'menu'").select("path", "stmt").join(arms, ["path", "stmt"], "left")
    outcome = F.when(F.col("n_arms").isNull(), "unresolved").when(F.col("n_conditions") < F.col("n_arms"), "impossible").otherwise("conditional")
    return joined.select("path", "stmt", F.coalesce("n_arms", F.lit(0)).alias("n_arms"), F.coalesce("n_conditions", F.lit(0)).alias("n_conditions"), outcome.alias("no_choice"))


def label_spans(statements: DataFrame) -> DataFrame:
    """(path, label, n_lines, start_line, end_line): from a label's first line to its last."""
    return statements.groupBy("path", "label").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).select("path", "label", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"), "start_line", "end_line")


def beats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node, label, claim), edges(src, dst, kind) -> (node, beat, place): runs of narrative nodes and all others alone.

    claim: narrative, or anything else. A run goes on over a fallthrough that is
    the only edge out of its source and into its target, within a label; beat is
    the run's first node, place counts from 0.
    """
    degree_out = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    degree_in = edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    told = nodes.where("claim = 'narrative'").select("node", "label")
    links = (
        edges.where("kind = 'fallthrough' AND src <> dst").join(degree_out, "src").join(degree_in, "dst").where("n_out = 1 AND n_in = 1")
        .join(told.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(told.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
    )
    runs = chains(links.select("src", "dst")).select("node", "head", "at")
    joined = nodes.select("node").join(runs, "node", "left")
    return joined.select("node", F.coalesce("head", "node").alias("beat"), F.coalesce("at", F.lit(0)).cast("long").alias("place"))


def node_reachability(reachable: Column, unresolved: Column, proven: Column, inferred: Column, may_lead: Column, open_world: Column) -> Column:
    """The first that holds of: unresolved input; reached under inferred or proven requirements, or none; perhaps dead; dead as far as is known; dead."""
    return (
        F.when(unresolved, "unresolved_dynamic_behavior")
        .when(reachable & inferred, "reachable_under_inferred_requirements")
        .when(reachable & proven, "conditionally_reachable")
        .when(reachable, "proven_reachable")
        .when(may_lead, "possibly_dead")
        .when(open_world, "unreachable_in_resolved_static_graph")
        .otherwise("proven_unreachable")
    )
