"""Licence scans with a positional rare-token index, in DataFrame functions alone.

Words of the licence templates that are not common English form the index: each posting is a template, and the word's
position in it.  Each of a file's words that the index knows looks up its postings, and postings of one template that
agree on where it would begin in the file are intersected, so no template is left out.  A template counts if enough of its indexed words stand at their places and its mandatory phrases stand in the file.  Base phrases
are looked up the same way and need every one of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (label, phrase).
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: (label, template, mandatory phrases): the notices' own characteristic sentences (fixed values).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted", "associated documentation")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("following conditions", "binary forms")),
    ("apache", "licensed under the apache license version 2 0 the license", ("apache license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("general public license", "free software foundation")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("licensed",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons", "sharealike")),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("accompanying documentation",)),
)
#: Words too common to look up.
COMMON = frozenset("a the of to and or in is it this that as by are be any use with for you can which without following into made under person files file code form met terms covered purpose fee source available 0 2 3 4 v".split())
_NOT_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _postings() -> list[tuple[str, int, str, int, int, str, int]]:
    """(word, number, label, position, indexed words, kind, needed) of phrases and templates."""
    phrases = list(BASE) + [(label, p) for label, _, must in TEMPLATES for p in must]
    rows = []
    for n, (label, phrase) in enumerate(phrases):
        words = [(w, k) for k, w in enumerate(phrase.split()) if w not in COMMON]
        rows += [(w, n, label, k, len(words), "base" if n < len(BASE) else "phrase", len(words)) for w, k in words]
    for n, (label, text, _) in enumerate(TEMPLATES, 1000):
        words = [(w, k) for k, w in enumerate(text.split()) if w not in COMMON]
        rows += [(w, n, label, k, len(words), "template", max(2, -(-len(words) * 3 // 4))) for w, k in words]
    return rows


def words_of(text: Column) -> Column:
    """A text's words, blank-separated; letters keep their case."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _NOT_WORDS, " "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Null, empty and wordless texts have no words, no labels and score 0.  Repeated rows are scanned each, texts of any length whole; several
    templates of one label count once; an empty table gives no rows.  score: the largest share of a template's indexed
    words found at their places, or 0.5 where only a base phrase stands.
    """
    spark = docs.sparkSession
    posting = spark.createDataFrame(_postings(), "word string, number int, label string, k int, size int, kind string, need int")
    index = sorted({r[0] for r in _postings()})
    clean = words_of(F.col(text_col))
    lower = F.translate("clean", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = F.array(*[F.lit(w) for w in index])
    hits = F.filter(F.transform(F.split(lower, " "), lambda w, i: F.struct(w.alias("word"), i.cast("long").alias("at"))), lambda x: F.array_contains(known, x["word"]))
    none = F.expr("cast(array() as array<struct<word: string, at: bigint>>)")
    maybe = F.col("clean").rlike("(?i)(?:^| )(?:" + "|".join(index) + ")(?: |$)")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), clean.alias("clean"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "id",
        F.when(F.col("clean") == "", 0).otherwise(F.length("clean") - F.length(F.replace("clean", F.lit(" "))) + 1).cast("long").alias("n_words"),
        F.when(maybe, hits).otherwise(none).alias("hits"),
    )
    rows = written(rows, "words")
    places = rows.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.word", "h.at")
    found = places.join(F.broadcast(posting), "word").withColumn("begin", F.col("at") - F.col("k"))
    phrases = found.filter("kind <> 'template'").groupBy("row", "number", "label", "kind", "size", "begin").agg(F.count("*").alias("n")).filter("n = size")
    whole = found.filter("kind = 'template'").groupBy("row", "number", "label", "size", "need", "begin").agg(F.count("*").alias("n")).filter("n >= need")
    whole = whole.groupBy("row", "number", "label").agg(F.max(F.col("n") / F.col("size")).alias("share"))
    must = spark.createDataFrame(list(enumerate((t for t, x in enumerate(TEMPLATES, 1000) for _ in x[2]), len(BASE))), "phrase int, number int")
    asked = must.groupBy("number").agg(F.count("*").alias("musts"))
    stands = phrases.filter("kind = 'phrase'").select("row", F.col("number").alias("phrase")).distinct()
    kept = whole.join(F.broadcast(must), "number").join(stands, ["row", "phrase"]).groupBy("row", "number", "label", "share").agg(F.count("*").alias("m"))
    kept = kept.join(F.broadcast(asked), "number").filter("m = musts").groupBy("row").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    base = phrases.filter("kind = 'base'").groupBy("row").agg(F.count("*").alias("n_base"), F.min("begin").alias("first_word"), F.max("begin").alias("last_word"), F.collect_set("label").alias("base"))
    empty = F.expr("cast(array() as array<string>)")
    base_set, own_set = F.coalesce("base", empty), F.coalesce("own", empty)
    return rows.join(base.join(kept, "row", "full"), "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, own_set)), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size(base_set) > 0, 0.5).otherwise(0.0)).alias("score"),
    )

