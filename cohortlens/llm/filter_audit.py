"""Filter interaction audit by contingency tensor contractions (operator 12).

Every document fails some subset of five filters (``A`` to ``E``).  Documents
are counted by part and subset, which makes one 2x2x2x2x2 tensor per part and
measure (axis value 0: passes, 1: fails).  What a step of an ordered filter
chain keeps, removes or repeats is then a contraction of that tensor with one
selector a filter - pass, fail or all - so every order of the filters is
audited from the counts without reading a document again.

Texts are read once.  Their flags, computed with array and string functions in
the JVM, and a SHA-256 of the text are staged; that filter ``E`` (the text of a
smaller doc_id) needs the least doc_id of each text, a partially aggregated
minimum that is joined back on (digest, doc_id), so a text that a third of all
rows share is spread over the tasks by its doc_ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

FILTERS = "ABCDE"
#: Fixed values of the filters.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
MEASURES = ("docs", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def text_failures(text: Column) -> list[Column]:
    """Whether a text (NULL: empty) fails ``A``, ``B``, ``C``, ``D``."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, WHITE_SPACE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [F.size(words) < LEAST_WORDS,
            100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
            100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
            text.rlike(SYMBOLS)]


def contingency(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, docs, good, toxic``: documents by part and failed filters
    (bit ``k`` of ``mask``: filter ``k`` fails), with those labelled
    ``quality`` = 1 and ``toxic`` = 1; the cells that occur.  A document is
    labelled so if any row of ``labels`` with its doc_id is."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    # rows without a doc_id have no label; their salt keeps them apart in the join
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0).alias("salt")
    known = staged(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("docs"))
                   .select("*", salt).join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
                   .drop("salt"), "flags")
    first = known.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (known.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
            .groupBy("part", (F.col("mask") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))
            .agg(F.sum("docs").alias("docs"),
                 *[F.sum(F.col("docs") * F.coalesce(m, F.lit(0))).alias(m) for m in ("good", "toxic")]))


def _selectors() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The steps ``(order, step)`` and, per count, the selector of every axis
    at every step: shape (steps, 5 axes, 2).  ``before`` are the filters that
    came earlier in the order, ``own`` is the step's filter."""
    steps, out = [], {c: [] for c in ("kept", "removed", "failed", "unique_fails")}
    for order in permutations(range(len(FILTERS))):
        for step, own in enumerate(order, 1):
            before = order[:step - 1]
            steps.append(("".join(FILTERS[k] for k in order), step))
            axis = lambda at_own, at_before, at_rest: [
                at_own if k == own else at_before if k in before else at_rest for k in range(len(FILTERS))]
            out["kept"].append(axis(PASS, PASS, ALL))
            out["removed"].append(axis(FAIL, PASS, ALL))
            out["failed"].append(axis(FAIL, ALL, ALL))
            out["unique_fails"].append(axis(FAIL, PASS, PASS))
    return steps, {c: np.array(s, np.int64) for c, s in out.items()}


def _contract(tensor: np.ndarray, select: np.ndarray) -> np.ndarray:
    """``tensor`` (parts, 2, 2, 2, 2, 2) against the selectors: (parts, steps)."""
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensor, *(select[:, k] for k in range(len(FILTERS))),
                     optimize=["einsum_path", (0, 5), (0, 4), (0, 3), (0, 2), (0, 1)])


def audit_tensors(tensors: np.ndarray) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The steps, and each count of ``COUNTS`` as (parts, steps), of tensors
    (parts, measures, 2, 2, 2, 2, 2)."""
    steps, select = _selectors()
    docs, good, toxic = (tensors[:, k] for k in range(3))
    out = {c: _contract(docs, select[c]) for c in ("kept", "removed", "unique_fails")}
    out["redundant"] = _contract(docs, select["failed"]) - out["removed"]
    out["good_lost"] = _contract(good, select["removed"])
    out["toxic_lost"] = _contract(toxic, select["removed"])
    own = np.array([FILTERS.index(order[step - 1]) for order, step in steps])
    total = np.stack([out["removed"][:, own == k].sum(axis=1) for k in range(len(FILTERS))], axis=1)
    out["shapley"] = total[:, own]
    return steps, out


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = None
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            tensors = np.zeros((part.num_rows, len(MEASURES), 1 << len(FILTERS)), np.int64)
            for row, cells in enumerate(part.column("cells").to_pylist()):
                for cell in cells:
                    tensors[row, :, cell["mask"]] = [cell[m] for m in MEASURES]
            # bit k of the mask is axis k: the lowest bit comes last in memory
            tensors = tensors.reshape(part.num_rows, len(MEASURES), *(2,) * len(FILTERS)).transpose(0, 1, 6, 5, 4, 3, 2)
            steps, counts = audit_tensors(tensors)
            names = names or [pa.array([s[0] for s in steps]), pa.array([s[1] for s in steps], pa.int32())]
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part.column("part").take(pa.array(np.repeat(np.arange(n), len(steps)))),
                 *[x.take(pa.array(np.tile(np.arange(len(steps)), n))) for x in names],
                 *[pa.array(counts[c].ravel(), pa.int64()) for c in COUNTS]],
                names=["part", "filter_order", "step", *COUNTS])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (``source``; NULL: empty string), order of the five
    filters (120) and step (1-5): documents of the part that are kept after
    the step, removed by it, fail its filter but were removed earlier
    (redundant), fail its filter only, are removed and labelled good or toxic,
    and its filter's removals summed over all orders.

    NULL texts count as empty; texts of any length are read whole.  A text
    fails ``E`` if a smaller doc_id has the same text; a NULL doc_id is neither
    smaller nor larger than another, and rows that repeat a doc_id and text
    are equal, so they pass ``E`` together or fail together.  An empty table
    gives no row.  Further columns, clashing names included, are not read.
    """
    cells = contingency(docs, labels).groupBy("part").agg(
        F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))  # at most 32 cells a part
    return cells.mapInArrow(_audit, RESULT)


#: The same audit in DuckDB's SQL.
ORACLE_SQL = """
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
    SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
           min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts
), marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), flags AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           len(w) < 200 AS a,
           100 * len(list_distinct(w)) < 50 * len(w) AS b,
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
           regexp_matches(t, '[#$%&*|]') AS d,
           coalesce(words.doc_id > first_id, FALSE) AS e
    FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id
), cells AS (
    SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL
), fails AS (
    SELECT *, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
              || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM cells
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
    SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders
), each AS (
    SELECT part, filter_order, step, filter_order[step] AS own, n, good, toxic, failed,
           contains(failed, filter_order[step]) AS fails_own,
           len(translate(failed, left(filter_order, step - 1), '')) < len(failed) AS gone_before
    FROM fails CROSS JOIN steps
), counted AS (
    SELECT part, filter_order, step, own,
           coalesce(sum(n) FILTER (NOT gone_before AND NOT fails_own), 0) AS kept,
           coalesce(sum(n) FILTER (NOT gone_before AND fails_own), 0) AS removed,
           coalesce(sum(n) FILTER (gone_before AND fails_own), 0) AS redundant,
           coalesce(sum(n) FILTER (failed = own), 0) AS unique_fails,
           coalesce(sum(good) FILTER (NOT gone_before AND fails_own), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (NOT gone_before AND fails_own), 0) AS toxic_lost
    FROM each GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
