"""License scans: licence notices found inside documents by MinHash bands over overlapping text windows, exact containment after.

Every stage is a DataFrame function; see containment.py for windows, bands and their collision guarantee, and for repeated rows and short notices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containment

# The public wording of common licence notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template_id int, license string, text string")


def scan(docs: DataFrame, refs: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """Licence notices in each document: doc_id, license, template_id, n_shared, n_shingles.

    ``refs`` (template_id, license, text) replaces the built-in notices.  Documents without one give no row; null texts
    and empty tables give none; a text of any length is scanned whole.  Where notices share their wording,
    each that is contained is reported.
    """
    bounded = refs is None  # the built-in notices are few; a caller's may be any number
    refs = templates(docs.sparkSession) if bounded else refs.select("template_id", "license", "text")
    found = containment.search(docs, refs, "template_id", threshold)
    names = refs.select(F.col("template_id").alias("ref"), "license").distinct()
    names = F.broadcast(names) if bounded else names
    return found.join(names, "ref").select("doc_id", "license", F.col("ref").alias("template_id"), F.col("n_shared").cast("long"), F.col("ref_n").cast("long").alias("n_shingles"))


def op3_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs)


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[!-/:-@\[-`{{-~]*[ \x09-\x0D]+[!-/:-@\[-`{{-~]*|^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$'), lambda x: x <> '')"
OP3_SQL = (
    "WITH t(template_id, license, text) AS (VALUES " + ", ".join(f"({i}, '{n}', '{x}')" for i, (n, x) in enumerate(TEMPLATES)) + f"),\n"
    f"tw AS (SELECT template_id, license, {_WORDS.format('text')} AS w FROM t),\n"
    "ts AS (SELECT DISTINCT template_id, license, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM tw, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) >= 3),\n"
    "tn AS (SELECT template_id, license, count(*) AS n FROM ts GROUP BY ALL),\n"
    f"dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL),\n"
    "ds AS (SELECT DISTINCT dw.r, doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM dw, (SELECT DISTINCT least(5, len(w)) AS k FROM tw WHERE len(w) >= 3), unnest(range(1, len(w) - k + 2)) AS x(i)),\n"
    "m AS (SELECT r, doc_id, template_id, count(*) AS c FROM ds JOIN ts USING (s) GROUP BY ALL)\n"
    "SELECT doc_id, license, CAST(template_id AS INTEGER) AS template_id, CAST(max(c) AS BIGINT) AS n_shared, CAST(n AS BIGINT) AS n_shingles FROM m JOIN tn USING (template_id) WHERE c >= 0.8 * n GROUP BY ALL"
)
