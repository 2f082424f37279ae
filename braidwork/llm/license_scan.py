"""License notices by ordered signature rules, with DataFrame functions only.

A text is brought to its lower-case words joined by blanks. Each rule has a
keyword that the text must hold, a pattern over that form, a label, a priority
and a confidence. Rules are joined to texts by keyword, so a pattern runs only
where its keyword stands. Of two detections in one text, one that lies inside
the other is dropped unless its rule comes before the other's in priority.
Rules are of three kinds: signatures of license texts written by hand, short
identifiers, and the forms in which license names are given.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braidwork.llm import spans

#: Fixed phrases and labels whose places are always reported.
BASE = (("under the mit license", "mit", "mit"), ("apache license version 2", "apache", "apache-2"), ("cc by nc", "cc", "cc-by-nc"))

#: label stem, keyword, pattern of the name in lower-case words, versions ("" for none). Fixed values.
FAMILIES = (
    ("mit", "mit", "mit", ("",)),
    ("apache", "apache", "apache(?: software)?", ("1 0", "1 1", "2 0")),
    ("gpl", "gnu", "gnu general public", ("1 0", "2 0", "3 0")),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public", ("2 0", "2 1", "3 0")),
    ("agpl", "gnu", "gnu affero general public", ("1 0", "3 0")),
    ("gfdl", "gnu", "gnu free documentation", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla", "mozilla public", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public", ("1 0", "2 0")),
    ("cpl", "common", "common public", ("1 0",)),
    ("cddl", "cddl", "(?:cddl|common development and distribution)", ("1 0", "1 1")),
    ("eupl", "european", "european union public", ("1 0", "1 1", "1 2")),
    ("bsd-2-clause", "bsd", "bsd (?:2|two) clause", ("",)),
    ("bsd-3-clause", "bsd", "bsd (?:3|three) clause", ("",)),
    ("bsd-4-clause", "bsd", "bsd (?:4|four) clause", ("",)),
    ("isc", "isc", "isc", ("",)),
    ("zlib", "zlib", "zlib(?: libpng)?", ("",)),
    ("bsl", "boost", "boost software", ("1 0",)),
    ("artistic", "artistic", "artistic", ("1 0", "2 0")),
    ("postgresql", "postgresql", "postgresql", ("",)),
    ("psf", "python", "python software foundation", ("2 0",)),
    ("openssl", "openssl", "openssl", ("",)),
    ("ofl", "sil", "sil open font", ("1 0", "1 1")),
    ("odbl", "odbl", "(?:odbl|open database)", ("1 0",)),
    ("unlicense", "unlicense", "unlicense", ("",)),
    ("wtfpl", "wtfpl", "wtfpl", ("2 0",)),
    ("cc0", "cc0", "cc0", ("1 0",)),
)

#: Short names as in license identifiers, with their versions. Fixed values.
SHORT = (
    ("gpl", ("1 0", "2 0", "3 0")),
    ("lgpl", ("2 0", "2 1", "3 0")),
    ("agpl", ("1 0", "3 0")),
    ("gfdl", ("1 1", "1 2", "1 3")),
    ("mpl", ("1 0", "1 1", "2 0")),
    ("epl", ("1 0", "2 0")),
    ("eupl", ("1 0", "1 1", "1 2")),
    ("cddl", ("1 0", "1 1")),
    ("bsl", ("1 0",)),
    ("ofl", ("1 0", "1 1")),
)

#: Parts of Creative Commons licenses and the versions they have. Fixed values.
CC_PARTS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_VERSIONS = ("", "1 0", "2 0", "2 5", "3 0", "4 0")

#: Signatures of license texts and notices themselves: label, keyword, pattern over lower-case words. Fixed values.
SIGNATURES = (
    ("mit", "sublicense", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "merchantability", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "expat", "(?:the )?expat licen[cs]e"),
    ("mit-0", "mit", "mit no attribution(?: licen[cs]e)?"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "0bsd", "0bsd|zero clause bsd(?: licen[cs]e)?"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of (?:the )?(?:\\S+ ){1,8}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "bsd", "bsd style licen[cs]e"),
    ("bsd", "bsd", "(?:licensed|released|distributed) under (?:the |a )?bsd(?: licen[cs]e)?"),
    ("apache-2.0", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", "www apache org licenses license 2 0"),
    ("apache-2.0", "asl", "asl 2 0"),
    ("apache-2.0", "alv2", "alv2"),
    ("apache", "asf", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", "gnu", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "gnu", "either version 3 of the license or at your option any later version"),
    ("gpl", "copyleft", "the gnu general public license is a free copyleft license for software"),
    ("gpl", "gpl", "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl"),
    ("gpl", "gpl", "gpl licen[cs]ed|(?:the )?(?:gnu )?gpl licen[cs]e"),
    ("gpl-2.0", "gplv2", "gnu gplv2"),
    ("gpl-3.0", "gplv3", "gnu gplv3"),
    ("gpl-2.0-with-classpath-exception", "classpath", "(?:gnu )?classpath exception"),
    ("lgpl", "lgpl", "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl"),
    ("lgpl", "lgpl", "lgpl licen[cs]ed|(?:the )?(?:gnu )?lgpl licen[cs]e"),
    ("lgpl", "lesser", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "agpl", "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("gfdl", "invariant", "with no invariant sections(?: with)? no front cover texts and (?:with )?no back cover texts"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", "mpl", "(?:licensed|released|distributed) under (?:the )?mpl"),
    ("epl-1.0", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? 1 0"),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? 2 0"),
    ("edl-1.0", "eclipse", "eclipse distribution license(?: v(?:ersion)? 1 0)?"),
    ("cddl-1.0", "cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license"),
    ("cc0-1.0", "cc0", "cc0 1 0 universal|cc0 public domain dedication"),
    ("cc-by", "creative", "creative commons attribution(?: licen[cs]e)?(?! (?:share|sharealike|non|noncommercial|no))"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: licen[cs]e)?"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: licen[cs]e)?(?! (?:share|no))"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s(?: licen[cs]e)?"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?"),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[cs]e)?"),
    ("cc-by", "creativecommons", "creativecommons org licenses by(?! (?:sa|nc|nd))"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc(?! (?:sa|nd))"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd"),
    ("ofl-1.1", "ofl", "(?:sil )?ofl 1 1|scripts sil org ofl"),
    ("ofl-1.1", "reserved", "with reserved font name(?:s)?"),
    ("artistic", "perl", "same terms as perl(?: 5)?(?: itself)?"),
    ("psf", "psf", "psf licen[cs]e(?: agreement)?(?: for python)?"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e"),
    ("upl-1.0", "universal", "universal permissive licen[cs]e(?: v(?:ersion)? ?1 0)?"),
    ("vim", "vim", "(?:the )?vim licen[cs]e"),
    ("ruby", "ruby", "(?:the )?ruby licen[cs]e|same terms as ruby"),
    ("php-3.01", "php", "php licen[cs]e(?: version)?(?: 3 01)?"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("beerware", "beer", "buy me a beer in return|beer ?ware licen[cs]e"),
    ("sspl-1.0", "sspl", "sspl(?: v(?:ersion)? ?1)?|server side public licen[cs]e"),
    ("busl-1.1", "busl", "busl 1 1|business source licen[cs]e(?: 1 1)?"),
    ("elastic-2.0", "elastic", "elastic license (?:version )?2 0"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|perimeter|shield) licen[cs]e"),
    ("commons-clause", "commons", "commons clause licen[cs]e condition"),
    ("public-domain", "dedicated", "(?:hereby )?dedicated to the public domain"),
    ("public-domain", "domain", "(?:placed|released) (?:in|into) the public domain"),
    ("proprietary", "confidential", "(?:this (?:software|file|document) is )?proprietary and confidential"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction) of this (?:file|software|document)"),
    ("odc-by", "odc", "odc by(?: 1 0)?|open data commons attribution licen[cs]e"),
    ("pddl", "pddl", "pddl(?: 1 0)?|open data commons public domain dedication"),
    ("ogl-uk", "ogl", "open government licen[cs]e(?: v(?:ersion)? ?(?:2 0|3 0))?"),
)

#: form, pattern with the name and the version in place, confidence, priority (smaller first).
FORMS = (
    ("identifier", "spdx license identifier {name}(?: license)?{version}(?: only| or later)?", 0.99, 1),
    ("notice", "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?{version}(?: or (?:any )?later(?: version)?)?", 0.95, 2),
    ("name", "(?:the )?{name} licen[cs]e{version}", 0.85, 3),
)


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(rule, keyword, pattern, label, priority, confidence) of every rule, base phrases first."""
    found = [(keyword, phrase, label, 0, 0.9) for phrase, keyword, label in BASE]

    def add(name: str, keyword: str, version: str, label: str) -> None:
        major, _, minor = version.partition(" ")
        shown = f" (?:version |v)?{major}(?: {minor})?" if minor == "0" else f" (?:version |v)?{version}" if version else ""
        full = f"{label}-{version.replace(' ', '.')}" if version else label
        found.extend((keyword, form.format(name=name, version=shown), full, priority, sure) for _, form, sure, priority in FORMS)

    for stem, keyword, name, versions in FAMILIES:
        for version in dict.fromkeys((*versions, "")):
            add(name, keyword, version, stem)
    for name, versions in SHORT:
        for version in versions:
            major = version.partition(" ")[0]
            add(name, name, version, name)
            found.append((f"{name}v{major}", f"{name}v{major}", f"{name}-{major}", 4, 0.7))
    found.extend((keyword, f"(?:{pattern})", label, 2, 0.9) for label, keyword, pattern in SIGNATURES)
    for name, versions in SHORT:
        found.extend((name, f"{name} {version}(?: only| or later)?", f"{name}-{version.replace(' ', '.')}", 4, 0.8) for version in versions)
    for parts in CC_PARTS:
        found.extend(("cc", f"cc {parts} {version}", f"cc-{parts.replace(' ', '-')}-{version.replace(' ', '.')}", 4, 0.8) for version in CC_VERSIONS if version)
        for version in CC_VERSIONS:
            add(f"cc {parts}(?! (?:sa|nc|nd) )", "cc", version, f"cc-{parts.replace(' ', '-')}")
    return [(i, *rule) for i, rule in enumerate(dict.fromkeys(found))]


_KINDS = "rule int, keyword string, pattern string, label string, priority int, confidence double"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scan(docs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """docs(doc_id, text, ..) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    One row per row of ``docs``; other columns are not read. Words are runs of a-z, 0-9 and non-ASCII
    characters after folding A-Z. Null or empty text: no words, no labels,
    score 0, null first and last word. Repeated rows repeat in the result.
    """
    spark = spark or docs.sparkSession
    table = rules()
    keywords = sorted({r[1] for r in table})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gate = r"(?i)(?<![0-9a-z\x80-\x{10FFFF}])(?:" + "|".join(keywords) + r")(?![0-9a-z\x80-\x{10FFFF}])"
    start = docs.select(
        "doc_id",
        text.alias("text"),
        F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("gated", F.col("text").rlike(gate))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.filter(F.split(F.translate("text", upper, lower), _BREAK), lambda w: w != "")
    gated = start.where("gated").select("row", "doc_id", "n_words", words.alias("words"))
    gated = gated.select(
        "row",
        "doc_id",
        "n_words",
        F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"),
        F.explode_outer(F.array_intersect("words", F.array(*map(F.lit, keywords)))).alias("keyword"),
    )
    ruled = gated.join(F.broadcast(spark.createDataFrame(table, _KINDS)), "keyword", "left")  # a fixed list of a few hundred rules
    # a match takes the blank before it, so blanks count the words that lie before
    places = spans.places(spans.cut(F.col("line"), F.expr("concat(' (', pattern, ')(?= )')")), lambda part, match: F.regexp_count(part, F.lit(" ")) + match.cast("long"))
    hits = ruled.select("row", "doc_id", "n_words", "rule", "label", "priority", "confidence", F.explode_outer(places).alias("at"))
    base = F.col("rule") < len(BASE)
    outer = W.partitionBy("row").orderBy(F.col("at.a"), F.col("at.b").desc(), "priority", "rule").rowsBetween(W.unboundedPreceding, -1)
    levels = sorted({r[4] for r in table})
    inside = [(F.col("priority") >= p) & F.coalesce(F.max(F.when(F.col("priority") == p, F.col("at.b"))).over(outer) >= F.col("at.b"), F.lit(False)) for p in levels]  # in a detection that comes first
    hits = hits.withColumn("stands", F.col("at").isNotNull() & (~functools.reduce(operator.or_, inside) | base))
    label = F.when(F.col("stands"), F.col("label"))
    base_hit = base & F.col("at").isNotNull()
    found = hits.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base_hit, 1)).alias("n_base"),
        F.min(F.when(base_hit, F.col("at.a"))).alias("first_word"),
        F.max(F.when(base_hit, F.col("at.a"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base_hit, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("stands"), F.col("confidence"))), F.lit(0.0)).alias("score"),
    )
    none = F.lit(None).cast("long")
    plain = start.where("NOT gated").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score")
    )
    return found.drop("row").unionByName(plain)
