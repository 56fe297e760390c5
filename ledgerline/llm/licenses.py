"""License scans by diagonal voting: word k-grams are joined to template positions, and offsets vote."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3


@dataclass(frozen=True)
class Template:
    """exact: every place counts where all words stand consecutively; else spans that cover enough of it."""

    label: str
    phrase: str
    exact: bool = False


# Phrases of public license texts (fixed values); the first three are the base phrases.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "released under the terms of the mit license"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
)

#: What parts words: all of ASCII but letters and digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Share of a template's k-grams that a span must have.
COVER = 0.6

#: Neighbouring diagonals up to this far apart are one span: words were put in or left out.
DRIFT = 3


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text", cover: float = COVER) -> DataFrame:
    """(key, n_words, n_exact, first_word, last_word, exact_labels, labels, score, spans) for every row.

    Native throughout. All rolling k-grams of the words are joined to the templates' positions: as many rows as the
    templates have words, broadcast. Only hits leave a task, a row each; they vote by diagonal (place in the text minus
    place in the template) for the template's places, of which each counts once, however often the text has it. A
    diagonal is joined with those up to DRIFT beyond it, so a span can't drift further than that, and spans that cover
    enough are kept: enough of the template, and enough of those k-grams that no template of another label has, which tell it
    from its family. Of overlapping spans of different labels the one that covers most stays, then the longer one, then
    the first label; exact ones all stay. k-grams are compared by hash and then as words, so every vote is verified.

    score: the largest share covered, 0 to 1, the lesser of the two shares counting. spans: (start, end, label, cover), in words. Null and empty texts: no
    words, no spans, score 0. Repeated rows and null keys: each row by itself. Very long texts are scanned whole. Empty table:
    no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    places, sizes = [], []
    for t, x in enumerate(templates):
        ws = re.findall(WORD, x.phrase)
        sizes.append((t, x.label, x.exact, len(ws)))
        places += [(t, i, " ".join(ws[i : i + K])) for i in range(len(ws) - K + 1)]
    labels_of: dict[str, set[str]] = {}
    for t, _, gram in places:
        labels_of.setdefault(gram, set()).add(templates[t].label)
    longest = max((n for *_, n in sizes), default=1)
    parts = range(0, longest, 60)
    own: dict[int, list[int]] = {t: [0] * len(parts) for t, *_ in sizes}  # places of k-grams of one label only, as bits
    for t, i, gram in places:
        if len(labels_of[gram]) == 1:
            own[t][i // 60] |= 1 << i % 60
    at = spark.createDataFrame(places, "template int, place int, gram string").withColumn("h", F.xxhash64("gram"))
    masks = [f"own_{i}" for i in parts]
    about = spark.createDataFrame([(*x, *own[x[0]]) for x in sizes], f"template int, label string, exact boolean, size int, {', '.join(f'{m} long' for m in masks)}")

    words = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0)).alias("w"))
    gram = F.expr(f"transform(sequence(0, greatest(size(w) - {K}, 0)), i -> xxhash64(concat_ws(' ', {', '.join(f'get(w, i + {j})' for j in range(K))})))")
    grams = words.select("key", "row", "w", F.size("w").alias("n_words"), F.posexplode(gram).alias("pos", "h"))
    same = (grams["h"] == at["h"]) & (F.concat_ws(" ", *(F.get("w", F.col("pos") + j) for j in range(K))) == at["gram"])
    hits = grams.join(F.broadcast(at), same, "left").where("template is not null or pos = 0")
    hits = hits.select("key", "row", "n_words", "template", (F.col("pos") - F.col("place")).alias("diagonal"), "place")

    # votes: the distinct places of the template, as bits
    bits = [f"votes_{i}" for i in parts]
    vote = [F.bit_or(F.expr(f"if(place div 60 = {i}, shiftleft(1L, place % 60), 0L)")).alias(b) for i, b in enumerate(bits)]
    by = hits.groupBy("key", "row", "n_words", "template", "diagonal").agg(*vote, F.min("place").alias("low"), F.max("place").alias("high"))
    by = by.join(F.broadcast(about), "template", "left")
    lines = Window.partitionBy("row", "template").orderBy("diagonal")
    near = lines.rangeBetween(0, DRIFT)  # a diagonal with those up to DRIFT beyond it
    joined = lambda f, c: F.when(F.col("exact"), c).otherwise(f(c).over(near))
    spans = by.select(
        "key", "row", "n_words", "template", "diagonal", "label", "exact", "size", *masks, *(joined(F.bit_or, F.col(b)).alias(b) for b in bits),
        joined(F.min, F.col("diagonal") + F.col("low")).alias("start"), joined(F.max, F.col("diagonal") + F.col("high") + K).alias("end"),
    )
    count = lambda columns: sum((F.bit_count(c) for c in columns[1:]), F.bit_count(columns[0]))
    votes, telling = count([F.col(b) for b in bits]), count([F.col(m) for m in masks])
    share = votes / (F.col("size") - (K - 1))
    told = F.when(F.col("exact") | (telling == 0), share).otherwise(count([F.col(b).bitwiseAND(F.col(m)) for b, m in zip(bits, masks, strict=True)]) / telling)
    spans = spans.withColumn("cover", F.when(F.col("template").isNotNull(), F.least(share, told)).otherwise(0.0))
    # kept diagonals next to each other are one span
    good = F.col("cover") >= F.when(F.col("exact"), 1.0).otherwise(cover)
    gap = F.col("diagonal") - F.last(F.when(good, F.col("diagonal")), ignorenulls=True).over(lines.rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce(F.col("exact") | (gap > DRIFT), F.lit(True))
    spans = spans.withColumn("run", F.sum((good & first).cast("int")).over(lines)).groupBy("key", "row", "n_words", "template", "label", "exact", good.alias("good"), "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("cover").alias("cover")
    )
    # of overlapping spans the best one stays; spans are at most as long as a template and the drift on both sides
    around = Window.partitionBy("row").orderBy("start").rangeBetween(-(longest + 2 * DRIFT), longest + 2 * DRIFT)
    rank = F.struct((-F.col("cover")).alias("a"), (F.col("start") - F.col("end")).alias("b"), F.col("label").alias("c"))
    one = F.when(F.col("good"), F.struct("start", "end", "label", rank.alias("rank")))
    better = lambda y: (y["label"] != F.col("label")) & (y["start"] < F.col("end")) & (F.col("start") < y["end"]) & (y["rank"] < rank)
    spans = spans.withColumn("good", F.coalesce("good", F.lit(False)))
    spans = spans.withColumn("stays", F.col("good") & (F.col("exact") | ~F.exists(F.collect_list(one).over(around), better)))
    full, kept = F.coalesce(F.col("exact") & F.col("good"), F.lit(False)), F.coalesce("stays", F.lit(False))
    join = lambda ok: F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("label")))), ",")
    return spans.groupBy("row", "key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(full, 1)).alias("n_exact"),
        F.min(F.when(full, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(full, F.col("start"))).cast("long").alias("last_word"),
        join(full).alias("exact_labels"),
        join(kept).alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("start", "end", "label", "cover")))).alias("spans"),
    ).drop("row")
