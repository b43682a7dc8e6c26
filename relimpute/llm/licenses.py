"""License scans: sparse TF-IDF cosine of lines, headers and whole files to templates, then the nearest licence file above."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relimpute.llm.licence_templates import short_templates, whole_texts
from relimpute.llm.tables import sent_if_small, stored, taken

#: Sentences by which texts state their licence, with public identifiers.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the software without restriction."),
    *short_templates(),
]
#: File names that say what the file is.
NAMED = r"(?i)(^|/)(licen[cs]e|copying)(\.[a-z]+)?$"
BETWEEN = "[^0-9A-Za-z]+"
#: A notice of who wrote a file, which is no part of a licence.
NOTICE = r"(?im)^[^0-9A-Za-z\n]*(copyright\W*(\(c\)|©|[0-9]{4})|(\(c\)|©)\W*[0-9]{4}|all rights reserved)[^\n]*$"
#: A line without letters and digits parts paragraphs, in comments too.
PARTED = r"\n[^0-9A-Za-z]*\n"
#: Templates of more words are compared with whole files and their first paragraphs, 1 to HEAD.
SHORT, HEAD = 100, 12


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def held_of(found: Column, wanted: list[str]) -> Column:
    """The distinct ones of the words that are wanted."""
    return F.array_intersect(found, F.lit(wanted))


def mostly_known(listed: Column, weights: dict[str, float], other: float, least: float) -> Column:
    """Whether words of templates weigh enough among all words for a cosine of `least` with any."""
    idf = F.map_from_arrays(F.lit(list(weights)), F.lit(list(weights.values())))
    times = lambda w: (F.size(listed) - F.size(F.array_remove(listed, w))).cast("double")
    known = F.struct(F.lit(0.0).alias("square"), F.lit(0.0).alias("tokens"))
    add = lambda x, w: F.struct((x["square"] + F.pow(times(w) * idf[w], F.lit(2.0))).alias("square"), (x["tokens"] + times(w)).alias("tokens"))
    # The square of a count is no less than the count.
    enough = lambda x: (x["tokens"] > 0) & (x["square"] * (1 - least**2) >= (F.size(listed) - x["tokens"]) * (other**2 * least**2) - 1e-6)
    return F.aggregate(held_of(F.array_distinct(listed), list(weights)), known, add, enough)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, NOTICE, ""), PARTED), lambda p: F.length(F.regexp_replace(p, BETWEEN, "")) > 0)


def heads(text: Column, first: int, last: int) -> Column:
    """The first paragraphs as one text, for every number of them from `first` to `last`."""
    return F.element_at(F.transform(F.array(paragraphs(text)), lambda p: F.transform(F.sequence(F.lit(first), F.lit(last)), lambda n: F.array_join(F.slice(p, 1, n), "\n"))), 1)


def units(text: Column) -> Column:
    """What is compared with short templates, as (kind, text, words): every line, wrapped paragraph, and the first two and three of them."""
    kind = lambda name: lambda x: F.struct(F.lit(name).alias("kind"), x.alias("text"))
    wrapped = F.filter(paragraphs(text), lambda p: F.contains(p, F.lit("\n")))
    listed = F.array_distinct(F.concat(F.transform(F.split(text, "\n"), kind("line")), F.transform(wrapped, kind("block")), F.transform(heads(text, 2, 3), kind("head"))))
    return F.transform(listed, lambda u: F.struct(u["kind"].alias("kind"), u["text"].alias("text"), words(u["text"]).alias("words")))


def folder_of(path: Column) -> Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def weighted_templates(templates: DataFrame, docs: DataFrame, least: float) -> tuple[DataFrame, float]:
    """license, t (one template), word, idf, w (tf * idf), norm, needed; and the idf of words of no template.

    The idf counts licences, all versions as one, so that many templates of one don't make its name a common word.
    A unit is at most as similar to a template as the part of it that it covers. Words are needed from the one in the
    fewest documents on, until those left weigh less than `least` of the template: a unit without a needed word can't reach it.
    """
    listed = templates.select("license", F.xxhash64("license", "text").alias("t"), words(F.col("text")).alias("words"), F.regexp_replace("license", "-[0-9].*$", "").alias("kin"))
    listed = stored(listed, "template-texts")
    many = listed.agg(F.count_distinct("kin")).first()[0]
    terms = listed.select("license", "t", "kin", F.explode("words").alias("word")).groupBy("license", "t", "kin", "word").agg(F.count(F.lit(1)).alias("tf"))
    idf = terms.groupBy("word").agg(F.log(1 + F.lit(float(many)) / F.count_distinct("kin")).alias("idf"))
    terms = terms.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    terms = stored(terms, "template-terms")
    # In how many documents each template word stands: counted over all, combined before the exchange.
    vocabulary = [r["word"] for r in terms.select("word").distinct().orderBy("word").collect()]
    held = docs.select(F.explode_outer(held_of(words(F.col("text")), vocabulary)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    terms = terms.join(held, "word", "left").na.fill(0, ["held"])
    square, one = F.col("w") * F.col("w"), W.partitionBy("t")
    terms = terms.withColumn("norm", F.sqrt(F.sum(square).over(one)))
    commoner = F.sum(square).over(one.orderBy(F.desc("held"), "word").rowsBetween(W.unboundedPreceding, 0))
    terms = terms.withColumn("needed", commoner >= least * least * F.col("norm") * F.col("norm"))
    terms = terms.withColumn("several", F.count(F.lit(1)).over(one) > 1)
    return stored(terms.select("license", "t", "word", "idf", "w", "norm", "needed", "several"), "templates"), math.log(1 + many)


NOTHING = "key struct<id:string,text:bigint,path:string>, license string, score double, share double"


def stated_licenses(docs: DataFrame, templates: DataFrame, least: float) -> DataFrame:
    """key, license, score of the unit that holds most of a template, and share (of a document's filled lines that state any)."""
    terms, other_idf = weighted_templates(templates, docs, least)
    weights = {r["word"]: r["idf"] for r in terms.select("word", "idf").distinct().orderBy("word").collect()}
    needed = [r["word"] for r in terms.where("needed").select("word").distinct().orderBy("word").collect()]
    if not needed:
        return docs.sparkSession.createDataFrame([], NOTHING)
    # A text, and then a unit, without any of them is out.
    near = docs.where(F.size(held_of(words(F.col("text")), needed)) > 0)
    filled = lambda text: F.size(F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(line)) > 0))
    parts = near.select("key", filled(F.col("text")).alias("n_lines"), F.split("text", "\n").alias("lines"), F.posexplode_outer(units(F.col("text"))).alias("pos", "unit"))
    # Outer, here and below: a plain one would be computed twice, for rows without any.
    parts = parts.where(F.size(held_of(F.col("unit.words"), needed)) > 0).where(mostly_known(F.col("unit.words"), weights, other_idf, least))
    # Equal lines are compared once and count as often as they occur.
    times = F.when(F.col("unit.kind") == "line", F.size("lines") - F.size(F.array_remove(F.col("lines"), F.col("unit.text")))).otherwise(filled(F.col("unit.text")))
    parts = stored(parts.select("key", "n_lines", "pos", F.col("unit.kind").alias("kind"), times.alias("times"), F.col("unit.words").alias("words")), "licence-units")
    spread = parts.select("key", "pos", F.explode("words").alias("word")).groupBy("key", "pos", "word").agg(F.count(F.lit(1)).alias("tf"))
    known = sent_if_small(terms.select("word", "idf").distinct())
    weighed = stored(spread.join(known, "word", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(other_idf))).select("key", "pos", "word", "v"), "licence-words")
    lengths = weighed.groupBy("key", "pos").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    dots = weighed.join(sent_if_small(terms.select("license", "t", "word", "w", "norm", "several")), "word").groupBy("key", "pos", "license", "t", "norm", "several").agg(F.sum(F.col("v") * F.col("w")).alias("dot"), F.count(F.lit(1)).alias("shared"))
    # One word, such as the German `mit`, states a licence only where it is a whole template.
    dots = dots.where((F.col("shared") > 1) | ~F.col("several"))
    scored = dots.join(lengths, ["key", "pos"]).withColumn("score", F.round(F.col("dot") / F.col("norm") / F.col("length"), 9)).where(F.col("score") >= least)
    # Of a unit the nearest template; of a document the unit that holds most of one.
    nearest = scored.groupBy("key", "pos").agg(F.max(F.struct(F.round(F.col("dot") / F.col("norm"), 6).alias("holds"), "score", "license")).alias("best"))
    nearest = nearest.join(parts.select("key", "pos", "kind", "n_lines", "times"), ["key", "pos"])
    stating = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("times"))), F.lit(0))
    best = nearest.groupBy("key").agg(F.max("best").alias("best"), F.greatest(stating("line"), stating("block")).alias("stating"), F.first("n_lines").alias("n_lines"))
    return best.select("key", F.col("best.license").alias("license"), F.col("best.score").alias("score"), (F.col("stating") / F.col("n_lines")).alias("share"))


def whole_licenses(docs: DataFrame, texts: list[tuple[str, str]], least: float) -> DataFrame:
    """key, license, score, share: documents that are, or begin with, a whole licence; share is 1 for those that are.

    Weights are (1 + log tf) * idf, so that words all texts use weigh next to nothing. Words of more than half of the texts are left out
    of the search, never of the cosine: a text must cover the part that is asked for with the rarer words.
    """
    spark = docs.sparkSession
    counts = [Counter(re.findall("[0-9a-z]+", re.sub(NOTICE, "", text).lower())) for _, text in texts]
    df, many = Counter(w for c in counts for w in c), len(texts)
    if not many:
        return spark.createDataFrame([], NOTHING)
    idf, other = {w: math.log((1 + many) / n) for w, n in df.items()}, math.log(1 + many)
    rows, asked, fewest = [], [], math.inf
    for t, ((license_, _), count) in enumerate(zip(texts, counts, strict=True)):
        w = {x: (1 + math.log(n)) * idf[x] for x, n in count.items()}
        square = sum(x * x for x in w.values())
        rare = sorted((w[x] ** 2 for x in w if df[x] <= max(1, many / 2)), reverse=True)
        part = least**2 * square - (square - sum(rare)) - 1e-6
        covered = n = 0
        while covered < part and n < len(rare):
            covered, n = covered + rare[n], n + 1
        fewest = min(fewest, n)
        asked.append((t, part))
        rows += [(t, license_, x, v, math.sqrt(square), df[x] <= max(1, many / 2)) for x, v in w.items()]
    rare = sorted({r[2] for r in rows if r[5]})
    terms = spark.createDataFrame(rows, "t int, license string, word string, w double, norm double, rare boolean")
    found = docs.select("key", F.explode_outer(F.array(held_of(words(F.col("text")), rare))).alias("found")).where(F.size("found") >= fewest)
    covered = found.select("key", F.explode("found").alias("word")).join(F.broadcast(terms.where("rare").select("word", "t", F.col("w").alias("x"))), "word").groupBy("key", "t").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    near = stored(covered.join(F.broadcast(spark.createDataFrame(asked, "t int, part double")), "t").where("square >= part").select("key").distinct(), "near-whole")
    clean = F.array(F.regexp_replace("text", NOTICE, ""))
    # Repeats of a text that has fewer paragraphs go; the whole comes first.
    sides = F.array_distinct(F.transform(F.concat(clean, heads(F.col("text"), 1, HEAD)), lambda x: F.array_join(words(x), " ")))
    chosen = docs.join(near.withColumnRenamed("key", "near"), F.col("key").eqNullSafe(F.col("near")), "left_semi")
    spread = chosen.select("key", F.posexplode(sides).alias("pos", "side")).select("key", "pos", F.explode(F.split("side", " ")).alias("word")).groupBy("key", "pos", "word").agg(F.count(F.lit(1)).alias("tf"))
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "word string, idf double"))
    weighed = stored(spread.join(known, "word", "left").withColumn("v", (1 + F.log("tf")) * F.coalesce("idf", F.lit(other))).select("key", "pos", "word", "v"), "whole-words")
    lengths = weighed.groupBy("key", "pos").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    dots = weighed.join(F.broadcast(terms), "word").groupBy("key", "pos", "license", "t", "norm").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scored = dots.join(lengths, ["key", "pos"]).withColumn("score", F.round(F.col("dot") / F.col("norm") / F.col("length"), 9)).where(F.col("score") >= least)
    best = scored.groupBy("key").agg(F.max(F.struct("score", "license")).alias("best"), F.min("pos").alias("first"))
    return best.select("key", F.col("best.license").alias("license"), F.col("best.score").alias("score"), F.when(F.col("first") == 0, 1.0).otherwise(0.0).alias("share"))


def license_scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", least: float = 0.7, file_share: float = 0.5) -> DataFrame:
    """Find each document's licence, its own or that of the nearest folder above.

    Short templates (up to SHORT words) are compared with every line, paragraph and leading block by the cosine of TF-IDF weights, longer
    ones with the whole text and its first paragraphs; who wrote a file is left out of all but the lines. What reaches `least` counts: a
    whole licence first, else the line or block that holds most of a template (ties: the score, the last name). A document is a licence
    file if its name says so, if it is a whole licence, or if `file_share` of its filled lines state a licence. A document without its own takes
    that of the licence file in its folder or the nearest folder above (several in one: best score, then last name). Returns one
    row per input row: doc_id, path, license, score, origin (own, inherited, none), folder (of the licence file, if
    inherited). NULL and empty texts state nothing; a NULL path is one outside all folders, which inherits nothing. Repeated rows
    come out as often as they went in; empty tables (documents or templates) give no licences; other columns are ignored.

    Native throughout. Texts are searched for words no similar one can lack; only units in which words of templates weigh enough are taken
    apart, as sparse rows. Folders inherit once, whatever the number of documents in them, and hand it on by one join on the folder.
    """
    spark = docs.sparkSession
    rows = taken(docs, doc_id=id_col, text=text_col, path=path_col)
    key = F.struct(F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("text"), F.col("path").alias("path"))
    rows = rows.withColumn("key", key)
    distinct = rows.select("key", "text", "path").where("text IS NOT NULL")
    given = templates if templates is not None else template_table(spark)
    given = taken(given, license="license", text="text").where(F.col("license").isNotNull() & (F.size(words(F.coalesce("text", F.lit("")))) > 0)).distinct()
    long = F.size(words(F.col("text"))) > SHORT
    # Whole texts are few, whatever the number of documents.
    texts = [(r["license"], r["text"]) for r in given.where(long).orderBy("license", "text").collect()] + (whole_texts() if templates is None else [])
    whole = stored(whole_licenses(distinct, texts, least).dropDuplicates(["key"]), "whole-licences")
    short = stated_licenses(distinct, given.where(~long), least)
    both = short.withColumn("whole", F.lit(0)).unionByName(whole.withColumn("whole", F.lit(1)))
    first = both.groupBy("key").agg(F.max(F.struct("whole", "license", "score")).alias("best"), F.max("share").alias("share"))
    own = stored(first.select("key", "best.license", "best.score", "share"), "licences")
    files = own.where(F.col("key.path").isNotNull() & ((F.col("share") >= file_share) | F.col("key.path").rlike(NAMED)))
    licensed = files.groupBy(folder_of(F.col("key.path")).alias("above")).agg(F.max(F.struct("score", "license")).alias("best"))
    folders = rows.where("path IS NOT NULL").select(folder_of(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    # The folder itself, the ones above it, and the top.
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    climbs = folders.select("folder", F.posexplode(F.array_distinct(ups)).alias("depth", "above"))
    nearest = climbs.join(licensed, "above").groupBy("folder").agg(F.max(F.struct("depth", "best", "above")).alias("near"))
    nearest = nearest.select("folder", F.col("near.best.license").alias("near_license"), F.col("near.best.score").alias("near_score"), F.col("near.above").alias("near_folder"))
    # A table of its own, so that the join below has its own exchange, which Spark can split.
    nearest = stored(nearest, "nearest-folders")
    stated = own.select(F.col("key").alias("own_key"), F.col("license").alias("own_license"), F.col("score").alias("own_score"))
    slim = rows.select("doc_id", "path", "key", folder_of(F.col("path")).alias("folder"))
    joined = slim.join(stated, F.col("key").eqNullSafe(F.col("own_key")), "left").join(nearest, "folder", "left")
    mine, near = F.col("own_license").isNotNull(), F.col("near_license").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("own_license", "near_license").alias("license"),
        F.when(mine, F.col("own_score")).otherwise(F.col("near_score")).alias("score"),
        F.when(mine, "own").when(near, "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("near_folder")).alias("folder"),
    )
