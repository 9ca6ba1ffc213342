"""Licence scan: whole texts and their lines in canonical form, looked up by digest.

Canonical form: lower case (A-Z), copyright lines gone, punctuation and white space made single spaces, equivalent
spellings made one. Two texts with one canonical form have one digest; a hash join with the digests of the known
licences, a table of fixed size, names them.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, functions as F

from barweave.llm.license_texts import DIGESTS, EQUIVALENT, KNOWN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT = "^[^a-z0-9]*(copyright|\\(c\\)|©|all rights reserved)[^\n]*$"  # of a lower-case line
OTHER = "[^a-z0-9\u0080-\U0010ffff]+"
_SPELLINGS = "|".join(f"{a}" for a, _ in EQUIVALENT)


def canonical_line(line: str) -> str:
    """The canonical form of one line; the same as ``canonical_column`` gives."""
    low = line.translate(str.maketrans(UPPER, LOWER))
    if re.search(COPYRIGHT, low):
        return ""
    out = " " + re.sub("[^a-z0-9\u0080-\U0010ffff]+", " ", low).strip(" ") + " "
    for a, b in EQUIVALENT:
        out = out.replace(f" {a} ", f" {b} ")
    return out.strip(" ")


def canonical_text(text: str) -> str:
    return " ".join(x for x in map(canonical_line, text.split("\n")) if x)


def canonical_column(line: Column) -> Column:
    low = F.translate(line, UPPER, LOWER)
    out = F.concat(F.lit(" "), F.btrim(F.regexp_replace(low, OTHER, " ")), F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.when(low.rlike(COPYRIGHT), F.lit("")).otherwise(F.btrim(out))


def known_digests() -> list[tuple[str, str]]:
    """(digest, licence) of every known text, each digest once."""
    texts = {hashlib.sha256(canonical_text(text).encode()).hexdigest(): name for name, text in KNOWN}
    return sorted((texts | {digest: name for name, digest in DIGESTS}).items())


def scan(documents: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per document: doc_id, license (of the whole text, or null), line_licenses (sorted, distinct, joined by commas), n_lines.

    ``n_lines`` counts the lines whose canonical form isn't empty. Null and empty texts, and texts of copyright lines
    only, have no licence and 0 lines. Rows with equal doc_id are each scanned by themselves. Columns besides doc_id
    and text are not read. ``known`` is a list in the program, so its broadcast has a fixed size.
    """
    spark = documents.sparkSession
    table = F.broadcast(spark.createDataFrame(known or known_digests(), "digest string, name string"))
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    canon = F.filter(F.transform(lines, canonical_column), lambda x: x != "")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), canon.alias("canon"))
    rows = rows.select("doc_id", "row", F.size("canon").cast("long").alias("n_lines"), F.array_distinct(F.transform("canon", lambda x: F.sha2(x, 256))).alias("lines"), F.sha2(F.array_join("canon", " "), 256).alias("whole"))
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("whole").alias("digest"))), F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("digest"))))
    # the digests of a document lie in one row: explode, hash join and the grouping below stay small, as only matches
    # and one row per document (the whole text's) pass the join
    found = rows.select("doc_id", "row", "n_lines", F.explode(units).alias("unit")).select("doc_id", "row", "n_lines", "unit.*").join(table, "digest", "left").where(F.col("whole") | F.col("name").isNotNull())
    return (
        found.groupBy("row", "doc_id", "n_lines")
        .agg(F.max(F.when(F.col("whole"), F.col("name"))).alias("license"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("name")))), ",").alias("line_licenses"))
        .select("doc_id", "license", "line_licenses", "n_lines")
    )


def oracle() -> str:
    """The same in DuckDB's SQL; doc_id is unique there."""
    line = "translate(line, '" + UPPER + "', '" + LOWER + "')"
    out = f"concat(' ', trim(regexp_replace({line}, '[^a-z0-9\\x{{80}}-\\x{{10ffff}}]+', ' ', 'g'), ' '), ' ')"
    for a, b in EQUIVALENT:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    canon = f"CASE WHEN regexp_matches({line}, '^[^a-z0-9]*(copyright|\\(c\\)|©|all rights reserved)') THEN '' ELSE trim({out}, ' ') END"
    values = ", ".join(f"('{d}', '{n}')" for d, n in known_digests())
    return f"""
    WITH known(digest, name) AS (VALUES {values}),
    parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts),
    canon AS (SELECT doc_id, pos, c FROM (SELECT doc_id, pos, {canon} AS c FROM lines) WHERE c <> ''),
    whole AS (SELECT d.doc_id, count(c) AS n_lines, sha256(coalesce(string_agg(c, ' ' ORDER BY pos), '')) AS digest FROM documents d LEFT JOIN canon USING (doc_id) GROUP BY d.doc_id),
    hits AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM canon JOIN known ON known.digest = sha256(c) GROUP BY doc_id)
    SELECT w.doc_id, k.name AS license, coalesce(h.names, '') AS line_licenses, w.n_lines
    FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN hits h USING (doc_id)"""
