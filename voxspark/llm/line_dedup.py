"""Line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.llm.shared import written

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _UPPER.lower())


def _deduped(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with helper columns, and of these the new text, the lines before, and how many were dropped."""
    own = docs.withColumns({
        "__ld_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))),
        "__ld_text": F.xxhash64(F.coalesce("text", F.lit(""))),
    })
    found = own.select("__ld_id", "__ld_text", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = (
        found.withColumn("key", _key(F.col("line")))
        .filter(F.length("key") >= min_chars)
        .select("__ld_id", "__ld_text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(97), "key").alias("h2"))
    )
    keyed = written(keyed, "line-keys")
    shared = (
        keyed.groupBy("h1", "h2")
        .agg(F.count_distinct("__ld_id").alias("n"), F.max("__ld_id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper", F.xxhash64("h1", "h2").alias("k"))
    )
    dropped = (
        keyed.withColumn("k", F.xxhash64("h1", "h2"))
        .join(shared, ["k", "h1", "h2"])
        .filter(F.col("__ld_id") != F.col("keeper"))
        .groupBy("__ld_id", "__ld_text")
        .agg(F.collect_set("pos").alias("__ld_gone"))
    )
    out = own.join(dropped, ["__ld_id", "__ld_text"], "left").withColumn("__ld_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    # Hashed difference of positions, then a look at each that stays: linear in a text's lines.
    places = F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), "__ld_gone")
    kept = F.array_join(F.transform(places, lambda i: F.get("__ld_lines", i)), "\n")
    return out, {
        "text": F.when(F.col("__ld_gone").isNull(), F.col("text")).otherwise(kept),
        "n_lines": F.size("__ld_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("long"),
    }


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with shared lines taken out of ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without surrounding blanks, A-Z lower-cased. A key of at least ``min_chars`` code
    points that is found in at least ``min_docs`` documents loses its lines in all documents but that with the
    largest ``doc_id``. Null and empty texts are one empty line; a text without a dropped line is returned as it
    is. Rows of one ``doc_id`` are one document; a null ``doc_id`` is one below all others. Repeated rows are
    all returned; an empty table gives no rows; very long texts are split and joined in one row. Other columns pass
    through; where one is called ``n_lines`` or ``n_dropped`` it stays, and that count isn't returned.

    The texts are shuffled once, for the last join. Keys travel as 128-bit hashes, written once: documents of a key
    are counted in two steps, so a line that a third of all documents hold is many partial counts and no large group,
    and the join that finds the dropped lines has an exchange on both sides, which adaptive execution splits.
    """
    out, new = _deduped(docs, min_chars, min_docs)
    own = [new["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own, *[new[c].alias(c) for c in ("n_lines", "n_dropped") if c not in docs.columns])


def without_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the texts of ``dedup_lines`` and all other columns as they were, whatever their names; ``n_chars``,
    where there is one, is counted anew where lines were dropped."""
    out, new = _deduped(docs, min_chars, min_docs)
    new["n_chars"] = F.when(new["n_dropped"] > 0, F.length(new["text"])).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else F.lit(None)
    fields = {f.name: f.dataType for f in docs.schema.fields}
    return out.select(*[new[c].cast(fields[c]).alias(c) if c in ("text", "n_chars") else F.col(f"`{c}`") for c in docs.columns])


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """``dedup_lines`` with a hash for each text: nulls, empty texts, ties and repeated rows as there."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


DIGEST_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS pos, lines[i] AS line,
         translate(trim(lines[i], e' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), e'\n') AS lines FROM documents), unnest(generate_series(1, len(lines))) g(i)
), s AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.doc_id, l.pos, l.line, (s.key IS NOT NULL AND s.keeper <> l.doc_id) AS gone FROM l LEFT JOIN s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, e'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
