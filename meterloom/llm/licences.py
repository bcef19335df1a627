"""Licence scan: a trained paragraph classifier with a calibrated unknown class, confirmed by templates.

DataFrame functions and Spark ML only. Paragraphs are the lines of a text. Candidates are those with a word that every
template has one of, and those without such a word that hold enough of a template to be confirmed. Their word 1- and 2-grams, those of the labelled texts, make a sparse vector; a multinomial logistic regression gives each
licence family and the class "unknown" a probability. A prediction stands if the probability is above the family's
threshold, calibrated on all held-out paragraphs of the corpus, and enough of a template of that family is in the paragraph.
"""
from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import exact_quantiles
from .staging import settle, written

#: Weight of all lines of the corpus together, in labelled texts.
BACKGROUND = 200.0
UNKNOWN = "unknown"
#: Notices by licence family; fixed values.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License", "Licensed under the BSD 3-Clause License",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "You should have received a copy of the GNU General Public License along with this program"],
    "lgpl": ["licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License"],
    "public-domain": ["This is free and unencumbered software released into the public domain", "This work is dedicated to the public domain under CC0 1.0 Universal license"],
    "reserved": ["All rights reserved", "Copyright. All rights reserved", "No part of this work may be reproduced without the prior written permission of the copyright owner"],
}
#: Words of licence texts outside of licences; fixed values.
OTHER = ["She got her driving license last summer", "the rights of the people were reserved for the king", "a public house with a license to sell beer", "permission to land was granted to the pilot",
         "he asked permission to leave the room", "the company licensed its technology to a competitor", "all of the tables are reserved tonight", "the copyright dispute went on for years", "software for the public sector",
         "a fishing licence costs twenty pounds a year", "the museum reserves rooms for school groups", "warranty repairs take two weeks", "the poetic license of the author", "public libraries in the domain of the city"]
#: Words that many lines hold; telling() takes others where it can.
COMMON = {"all", "any", "by", "conditions", "following", "general", "included", "international", "public", "under", "with", "without", "work"}
CUE = r"(?i)licen[cs]|copyright|rights reserved|permission|public domain|redistribut"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def grams(tokens: str) -> Column:
    """Words and pairs of neighbours."""
    pairs = F.zip_with(F.col(tokens), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(F.col(tokens), F.filter(pairs, lambda x: x.isNotNull()))


def telling(least: float) -> list[str]:
    """Words one of which is in every text that holds `least` of the word pairs of a template: together they touch more pairs
    of each template than such a text may lack."""
    chosen: set[str] = set()
    for _, pairs in _shapes():
        lacks = len(pairs) - math.ceil(least * len(pairs) - 1e-9)
        seen = [p.split() for p in pairs]
        for w in sorted({w for p in seen for w in p}, key=lambda w: (w not in chosen, w in COMMON, -len(w), w)):
            if sum(not chosen.isdisjoint(p) for p in seen) > lacks:
                break
            chosen.add(w)
    return sorted(chosen)


def paragraphs(docs: DataFrame, least: float) -> DataFrame:
    """row_id, row_hash and text columns: a row for each candidate line of each text (row_id, row_hash, tokens, grams). A candidate has a
    cue word, or `least` of the word pairs of a template without one; every line is looked at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("row_id", "row_hash", F.posexplode(F.split(text, r"[\r\n]+")).alias("at", "line"))
    lines = lines.select("row_id", "row_hash", "at", F.col("line").rlike(CUE).alias("cue"), words(F.col("line")).alias("tokens")).where("size(tokens) > 0")
    lines = lines.where(F.col("cue") | F.arrays_overlap("tokens", F.array(*map(F.lit, telling(least))))).withColumn("grams", grams("tokens"))
    near = reduce(lambda a, b: a | b, [_share(pairs) >= least for _, pairs in _shapes()])
    return lines.where(F.col("cue") | near).dropDuplicates(["row_id", "row_hash", "at"]).select("row_id", "row_hash", "tokens", "grams")


def _shapes() -> list[tuple[str, list[str]]]:
    """Family and distinct word pairs of each template."""
    return [(f, sorted({a + " " + b for a, b in zip(w, w[1:])})) for f, ts in TEMPLATES.items() for t in ts for w in [_plain(t)]]


def _share(pairs: list[str]) -> Column:
    return F.size(F.array_intersect("grams", F.array(*map(F.lit, pairs)))) / len(pairs)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "row_hash": F.xxhash64(F.coalesce("text", F.lit("")))})


def _templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, template string")
    return rows.select("family", words(F.col("template")).alias("tokens"))


class Classifier:
    """Fitted on the templates (whole, and without each third of them), texts of OTHER and every line of the corpus that is
    no candidate, as examples of unknown; a third of the lines is held out to set the thresholds.

    Features are the words and pairs of the labelled texts. Lines with equal features count once; together the lines weigh as
    much as BACKGROUND labelled texts."""

    def __init__(self, docs: DataFrame, accepted: float = 0.01):
        spark = docs.sparkSession
        families = [*sorted(TEMPLATES), UNKNOWN]
        self.families = families
        whole = _templates(spark)
        third = F.ceil(F.size("tokens") / 3).cast("int")
        cut = whole.where("size(tokens) >= 6").select("family", F.explode(F.array(F.slice("tokens", third + 1, F.size("tokens")), F.concat(F.slice("tokens", F.lit(1), third), F.slice("tokens", 2 * third + 1, F.size("tokens"))), F.slice("tokens", F.lit(1), 2 * third))).alias("tokens"))
        other = spark.createDataFrame([(t,) for t in OTHER], "t string").select(F.lit(UNKNOWN).alias("family"), words(F.col("t")).alias("tokens"))
        labelled = whole.union(cut).union(other).coalesce(1)
        terms = sorted(r[0] for r in labelled.select(F.explode(grams("tokens"))).distinct().collect())  # those of fixed texts
        self.terms = CountVectorizerModel.from_vocabulary(terms, inputCol="grams", outputCol="features", binary=True)
        lines = docs.select(F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\r\n]+")).alias("line")).where(~F.col("line").rlike(CUE) & (F.length("line") > 3))
        lines = self.features(lines.select(words(F.col("line")).alias("tokens"))).select("features", F.xxhash64("features").alias("h")).dropDuplicates(["h"])
        lines = written(lines.select("features", (F.pmod("h", F.lit(3)) == 0).alias("held")), "unknown-lines")
        weight = BACKGROUND / max(1, lines.where("not held").count())
        label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
        train = self.features(labelled).select("features", label.cast("double").alias("label"), F.lit(1.0).alias("weight"))
        train = train.union(lines.where("not held").select("features", F.lit(float(len(families) - 1)), F.lit(weight)))
        self.model = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=60, family="multinomial").fit(train)
        held = self.model.transform(lines.where("held").select("features").union(self.features(other).select("features")))
        each = held.select(F.posexplode(vector_to_array("probability")).alias("k", "p")).where(F.col("k") < len(families) - 1)
        most = {r.k: r.most for r in exact_quantiles(each, "p", {"most": 1 - accepted}, by=["k"], few_groups=True).collect()}  # one row per family
        self.threshold = {f: max(0.5, most.get(i) or 0.0) for i, f in enumerate(families[:-1])}

    def features(self, rows: DataFrame) -> DataFrame:
        return self.terms.transform(rows.withColumn("grams", grams("tokens")))

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """`rows` with p, the probability of each family and of unknown."""
        out = self.model.transform(self.features(rows))
        return out.withColumn("p", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")

    def scan(self, docs: DataFrame, least: float = 0.6) -> DataFrame:
        """doc_id, n_candidates, n_confirmed, n_unknown, families (confirmed ones, sorted, joined by commas), confidence of
        the surest, for every row of `docs` (doc_id, text; others are not looked at).

        Null and empty texts have no candidates. Rows of one doc_id and text have equal results; a doc_id may be null.
        A template confirms if `least` of its word pairs (of its words, if it has one) are in the paragraph.
        """
        keyed = _keyed(docs)
        scored = self.probabilities(paragraphs(keyed, least))
        best = F.array_position("p", F.array_max("p")).cast("int")
        scored = scored.withColumns({"family": F.element_at(F.array(*map(F.lit, self.families)), best), "sure": F.array_max("p")})
        shared = [F.when(F.col("family") == f, _share(pairs)) for f, pairs in _shapes()]
        floor = F.create_map(*[x for f, t in self.threshold.items() for x in (F.lit(f), F.lit(t))])
        holds = (F.col("family") != UNKNOWN) & (F.col("sure") >= floor[F.col("family")]) & (F.greatest(*[F.coalesce(x, F.lit(0.0)) for x in shared]) >= least)
        one = scored.withColumn("holds", F.coalesce(holds, F.lit(False))).groupBy("row_id", "row_hash").agg(
            F.count("*").alias("n_candidates"), F.count_if("holds").alias("n_confirmed"), F.count_if(~F.col("holds")).alias("n_unknown"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("holds"), F.col("family")))), ",").alias("families"), F.max(F.when(F.col("holds"), F.round("sure", 3))).alias("confidence"))
        out = keyed.select("doc_id", "row_id", "row_hash").join(one, ["row_id", "row_hash"], "left")
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_candidates", "n_confirmed", "n_unknown")}
        return out.withColumns(zero | {"families": F.coalesce("families", F.lit(""))}).drop("row_id", "row_hash")


def _plain(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def scan(docs: DataFrame, **options) -> DataFrame:
    """Fit on `docs` and scan them."""
    settle(docs.sparkSession)
    return Classifier(docs, **options).scan(docs)
