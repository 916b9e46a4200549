"""License notices in documents, with DataFrame functions only.

Method: texts are cut into overlapping windows of words; MinHash bands over their five-word shingles
retrieve templates, and exact shingle containment verifies them.  A template is compared with windows
of twice its length at every template length, so a notice lies whole in some window and its
shingles are at least a sixth of the window's: with ``BANDS`` bands of one hash each, the chance to
miss it is below (5/6) ** BANDS, about one in six thousand.

Only a window that holds a template's smallest shingle under some hash can collide in that band.  So
whole texts are first searched for those shingles (a bounded list, tested by longest word, first word, then by hash), and windows and
signatures are made around the hits alone; the matches are those of signatures for all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import stored

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 48

# Sentences of public license notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-terms", "you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def _shingles(name: str) -> Column:
    """Distinct hashes of the five-word shingles of an array of words."""
    return F.expr(f"""if(size({name}) < {SHINGLE}, cast(array() as array<bigint>), array_distinct(transform(
        sequence(0, size({name}) - {SHINGLE}), i -> xxhash64({', '.join(f'{name}[i + {k}]' for k in range(SHINGLE))}))))""")


def _signature(name: str) -> Column:
    """The smallest hash of the shingles under each of ``BANDS`` hash functions."""
    return F.expr(f"transform(sequence(1, {BANDS}), k -> array_min(transform({name}, s -> xxhash64(s, k))))")


def _smallest(name: str) -> Column:
    """The shingles that are smallest under some hash function."""
    return F.expr(f"""array_distinct(transform(sequence(1, {BANDS}), k ->
        array_min(transform({name}, s -> struct(xxhash64(s, k) as v, s as s))).s))""")


def templates(spark: SparkSession, notices: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(license, length, shingles, signature, smallest, firsts) of the notices; those under five words cannot be told and are left out."""
    rows = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("notice")) for a, b in notices])
    found = spark.range(1).select(F.explode(rows).alias("r")).select("r.license", words(F.col("r.notice")).alias("w"))
    found = found.where(F.size("w") >= SHINGLE).withColumn("shingles", _shingles("w"))
    return stored(found.select(
        "license", F.size("w").alias("length"), "shingles", _signature("shingles").alias("signature"),
        _smallest("shingles").alias("smallest"), F.expr(f"""array_distinct(transform(sequence(0, size(w) - {SHINGLE}), i ->
            array_max(transform(slice(w, i + 1, {SHINGLE}), x -> struct(length(x) as n, x as x))).x))""").alias("longest"), F.slice("w", F.lit(1), F.size("w") - SHINGLE + 1).alias("firsts")))


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, windows, first_word): a row per document and notice found in it.

    ``containment`` is the best over the windows, ``first_word`` the position of the first matching
    window.  Null, empty and short texts match nothing; repeated rows count as one document.
    """
    known = templates(docs.sparkSession, notices)
    # at most BANDS shingles and a few words per notice
    firsts, smallest = known.agg(
        F.array_distinct(F.flatten(F.collect_list("firsts"))), F.array_distinct(F.flatten(F.collect_list("smallest")))).first()
    listed = ", ".join("'" + w.replace("'", "") + "'" for w in sorted(firsts))
    hashes = ", ".join(f"{h}L" for h in sorted(smallest))
    shingle = ", ".join(f"w[i + {k}]" for k in range(SHINGLE))
    # a match holds one of these shingles, so also the longest word of it
    rare = [r[0] for r in known.select(F.explode("longest")).distinct().orderBy("col").collect()]
    docs = docs.where(F.lower(F.coalesce("text", F.lit(""))).rlike("|".join(rare)))
    # no filter on a computed column: it would be pushed down and split the text once per word
    split = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    hits = F.expr(f"""if(size(w) < {SHINGLE}, cast(array() as array<int>), filter(
        sequence(0, size(w) - {SHINGLE}), i -> w[i] in ({listed}) and xxhash64({shingle}) in ({hashes})))""")
    at = split.select("doc_id", "w", F.explode(hits).alias("i")).withColumn("s", F.expr(f"xxhash64({shingle})"))
    by_shingle = known.select("license", "length", "shingles", "signature", F.explode("smallest").alias("s"))
    met = at.join(F.broadcast(by_shingle), "s")
    windows = met.select("doc_id", "license", "length", "shingles", "signature", "w", F.explode(F.expr(
        "filter(array(i div length - 1, i div length), b -> b >= 0)")).alias("block")).select(
        "doc_id", "license", "shingles", "signature", (F.col("block") * F.col("length")).alias("first_word"),
        F.expr("slice(w, int(block * length) + 1, 2 * length)").alias("window")).distinct()
    # both are written, or the tests below would be pushed into their lambdas; they hold hits alone
    signed = stored(stored(windows).withColumn("mine", _shingles("window")).drop("window"))
    retrieved = signed.where(F.exists(F.zip_with(_signature("mine"), "signature", lambda a, b: a == b), lambda x: x))
    verified = retrieved.withColumn("containment", F.expr("size(array_intersect(mine, shingles)) / size(shingles)")).where(
        F.col("containment") >= CONTAINMENT)
    return verified.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.count(F.lit(1)).alias("windows"), F.min("first_word").alias("first_word"))
