"""N-gram Jaccard join by MinHash banding (operator 1).

Texts with the same word sequence form one *text class*; everything after
that works on one row per class, so copies are never paired.  Each class gets
``bands x rows`` MinHash values over its five-word shingles; classes that
share a band are candidates, and every candidate pair is verified on the full
shingle sets.  The number of bands follows from the recall wanted at the
threshold (:func:`choose_bands`).

Buckets of up to ``SMALL`` classes are compared pair by pair in joins.  Larger
ones are cut into blocks of bounded size, and each pair of blocks is one group
in which all intersections are counted at once by products of incidence
matrices over the shingles that at least two members hold; such a group
returns one row per member (its number of links and a member it is connected
to), never its pairs.  A pair that shares several bands is counted in the
first one only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces_of, staged
from .components import connected_components
from .words import mix, sequence_key, shingle_set, word_hashes

SMALL = 8
#: Bounds of a block of a large bucket: members, and shingles in expectation.
BLOCK_MEMBERS = 1500
BLOCK_SHINGLES = 1_500_000


def choose_bands(threshold: float, recall: float, budget: int = 128) -> tuple[int, int]:
    """``(bands, rows)``: the most rows per band for which ``bands * rows <=
    budget`` still finds a pair at ``threshold`` with probability ``recall``."""
    for rows in range(16, 0, -1):
        miss = 1.0 - threshold ** rows
        bands = 1 if miss <= 0 else math.ceil(math.log(1.0 - recall) / math.log(miss))
        if bands * rows <= budget:
            return bands, rows
    raise ValueError("no banding reaches this recall within the budget")


def _banding(bands: int, rows: int):
    """The function that hashes a shingle set to its bands."""
    rng = np.random.default_rng(20240229)
    mult = (rng.integers(0, 2 ** 63, bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    add = rng.integers(0, 2 ** 63, bands * rows, dtype=np.uint64)

    def bands_of(shingles: np.ndarray) -> np.ndarray:
        least = np.full(mult.size, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, shingles.size, 2048):
            part = shingles[at:at + 2048]
            values = part[None, :] * mult[:, None]
            values += add[:, None]
            values ^= values >> np.uint64(31)
            np.minimum(least, values.min(axis=1), out=least)
        out = np.zeros(bands, np.uint64)
        for k in range(rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + least.reshape(bands, rows)[:, k])
        return out

    return bands_of


def _signer(words_per_shingle: int, bands: int, rows: int):
    bands_of = _banding(bands, rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            keys, sizes, signs = [], [], []
            for text in batch.column("text").to_pylist():
                words = word_hashes(text)
                shingles = shingle_set(words, words_per_shingle)
                keys.append(sequence_key(words) if words.size else None)
                sizes.append(shingles.size)
                signs.append(bands_of(shingles).view(np.int64) if words.size else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(signs, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "bands"])

    return sign


def _sets(words_per_shingle: int, bands: int, rows: int):
    bands_of = _banding(bands, rows)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            keys, out = [], []
            for text, key in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist()):
                words = word_hashes(text)
                if words.size and sequence_key(words) == key:
                    keys.append(key)
                    out.append(shingle_set(words, words_per_shingle))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([x.size for x in out], pa.int64()),
                 pa.array([bands_of(x).view(np.int64) for x in out], pa.list_(pa.int64())),
                 pa.array([x.view(np.int64) for x in out], pa.list_(pa.int64()))], names=["key", "n", "bands", "shingles"])

    return sets


def _pairs(buckets: DataFrame, threshold: float) -> DataFrame:
    """All pairs of buckets of bounded size that sizes alone do not rule out,
    with the first small bucket's band."""
    left = buckets.select("band", "hash", F.col("key").alias("a"), F.col("n").alias("na"))
    right = buckets.select("band", "hash", F.col("key").alias("b"), F.col("n").alias("nb"))
    return (left.join(right, ["band", "hash"]).where(F.col("a") < F.col("b"))
            .where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
            .groupBy("a", "b").agg(F.min("band").alias("band")))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose shingle sets reach the threshold and whose first common
    band is the given one."""
    side = lambda x: sets.select(*[F.col(c).alias(x if c == "key" else x + c) for c in ("key", "shingles", "bands")])
    both = F.size(F.array_intersect("ashingles", "bshingles"))
    shared = F.array_position(F.zip_with("abands", "bbands", lambda x, y: x == y), True) - 1
    return (pairs.join(side("b"), "b").join(side("a"), "a")
            .select("a", "b", both.alias("i"), (F.size("ashingles") + F.size("bshingles")).alias("s"),
                    (shared == F.col("band")).alias("first"))
            .where("first").select("a", "b", (F.col("i") / (F.col("s") - F.col("i"))).alias("similarity"))
            .where(F.col("similarity") >= threshold))


def _intersections(left: np.ndarray, right: np.ndarray, member: np.ndarray, values: np.ndarray, members: int) -> np.ndarray:
    """Sizes of the intersections of the shingle sets of ``left`` with those of
    ``right`` (member numbers), from the flat ``(member, value)`` lists."""
    _, column, often = np.unique(values, return_inverse=True, return_counts=True)
    some = np.flatnonzero(often[column] > 1)
    member, column = member[some], column[some]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    place_l, place_r = np.full(members, -1), np.full(members, -1)
    place_l[left], place_r[right] = np.arange(left.size), np.arange(right.size)
    out = np.zeros((left.size, right.size), np.float32)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(column) > 0))) if column.size else np.zeros(0, int)
    for at in range(0, starts.size, 2048):
        end = starts[at + 2048] if at + 2048 < starts.size else column.size
        part = slice(starts[at], end)
        within = np.unique(column[part], return_inverse=True)[1]
        width = int(within.max()) + 1
        a, b = np.zeros((left.size, width), np.float32), np.zeros((right.size, width), np.float32)
        l, r = place_l[member[part]], place_r[member[part]]
        a[l[l >= 0], within[l >= 0]] = 1
        b[r[r >= 0], within[r >= 0]] = 1
        out += a @ b.T
    return out


def _block_links(threshold: float, bands: int):
    """Links within a pair of blocks: ``key, n_links, root`` of each member
    that has one."""
    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys, half = table.column("key").to_pylist(), table.column("half").to_numpy()
        n = table.column("n").to_numpy().astype(np.float64)
        band = table.column("band")[0].as_py()
        sign = table.column("bands").chunk(0).flatten().to_numpy().reshape(-1, bands)
        shingles = table.column("shingles").chunk(0)
        values = shingles.flatten().to_numpy()
        member = np.repeat(np.arange(len(keys)), np.diff(shingles.offsets.to_numpy()))
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left = np.arange(len(keys)) if one else np.flatnonzero(half == 0)
        right = left if one else np.flatnonzero(half == 1)
        common = _intersections(left, right, member, values, len(keys)).astype(np.float64)
        linked = common >= threshold * (n[left][:, None] + n[right][None, :] - common)
        if one:
            np.fill_diagonal(linked, False)
        count = np.zeros(len(keys), np.int64)
        label = np.arange(len(keys))
        for at in range(0, left.size, 256):
            i, j = np.nonzero(linked[at:at + 256])
            first = (sign[left[at + i]] == sign[right[j]]).argmax(axis=1) == band
            count += np.bincount(left[at + i[first]], minlength=len(keys))
            if not one:
                count += np.bincount(right[j[first]], minlength=len(keys))
        while linked.any():  # least label within each connected component
            before = label.copy()
            label[right] = np.minimum(label[right], np.where(linked, label[left][:, None], len(keys)).min(axis=0))
            label[left] = np.minimum(label[left], np.where(linked, label[right][None, :], len(keys)).min(axis=1))
            if (label == before).all():
                break
        some = np.flatnonzero((count > 0) | (label != np.arange(len(keys))))
        return pa.table([pa.array([keys[k] for k in some], pa.binary()), pa.array(count[some]),
                         pa.array([keys[label[k]] for k in some], pa.binary())], names=["key", "n_links", "root"])

    return links


def _large_links(large: DataFrame, sets: DataFrame, threshold: float, bands: int) -> DataFrame:
    """Links of the members of large buckets, by pairs of blocks."""
    cut = large.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), (F.col("block") > o).cast("int").alias("half")))
    dealt = cut.select("band", "hash", "key", F.explode(others).alias("o")).select("band", "hash", "key", "o.i", "o.j", "o.half")
    return dealt.join(sets, "key").groupBy("band", "hash", "i", "j").applyInArrow(
        _block_links(threshold, bands), "key binary, n_links long, root binary")


def near_links(docs: DataFrame, threshold: float = 0.8, shingle_words: int = 5,
               recall: float = 0.9995) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, degrees, edges)``: the text class of every row (``doc_id,
    key``; key NULL for texts without a word), the number of links of each
    class that has any (``key, n_links``) and edges ``a, b`` that connect the
    classes as the links do."""
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(docs.mapInArrow(_signer(shingle_words, bands, rows),
                                    "doc_id long, key binary, n long, bands array<long>"), "signed")
    classes = (signed.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("key")
               .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    rows_ = classes.select("key", "doc_id", "n", F.posexplode("bands").alias("band", "hash"))
    sizes = rows_.groupBy("band", "hash").agg(F.count("*").alias("size"), F.greatest(
        F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    buckets = staged(rows_.join(sizes.where(F.col("size") > 1), ["band", "hash"]), "buckets")
    involved = buckets.select("key", "doc_id").distinct()
    sets = staged(docs.join(involved, "doc_id").select("text", "key").mapInArrow(
        _sets(shingle_words, bands, rows), "key binary, n long, bands array<long>, shingles array<long>")
        .dropDuplicates(["key"]), "sets")
    small = staged(_verified(_pairs(buckets.where(F.col("size") <= SMALL), threshold), sets, threshold), "links")
    large = staged(_large_links(buckets.where(F.col("size") > SMALL), sets, threshold, bands), "links")
    degrees = (small.select(F.col("a").alias("key"), F.lit(1).cast("long").alias("n_links"))
               .unionByName(small.select(F.col("b").alias("key"), F.lit(1).cast("long").alias("n_links")))
               .unionByName(large.select("key", "n_links")).groupBy("key").agg(F.sum("n_links").alias("n_links")))
    edges = small.select("a", "b").unionByName(
        large.where(F.col("key") != F.col("root")).select(F.col("key").alias("a"), F.col("root").alias("b")))
    return signed.select("doc_id", "key"), degrees, edges


def _text_classes(members: DataFrame, degree: DataFrame, edges: DataFrame) -> DataFrame:
    """``key, text_id, class_id, n_links, keeper`` of every text class: the
    least doc_ids of the class and of its component, and whether it is the
    first class of its component (by doc_id, then key)."""
    roots = connected_components(edges)
    texts = (members.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("key").agg(F.min("doc_id").alias("text_id"))
             .join(roots.withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left")
             .withColumn("root", F.coalesce("root", "key")))
    groups = texts.groupBy("root").agg(F.min(F.struct("text_id", "key")).alias("least"))
    # classes without a link need no join on their root
    linked = texts.where(F.col("n_links").isNotNull()).join(groups, "root").select(
        "key", "text_id", F.col("least.text_id").alias("class_id"), "n_links", (F.col("least.key") == F.col("key")).alias("keeper"))
    alone = texts.where(F.col("n_links").isNull()).select("key", "text_id", F.col("text_id").alias("class_id"),
                                                         F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keeper"))
    return staged(linked.unionByName(alone), "texts")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, shingle_words: int = 5,
                 recall: float = 0.9995) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, text_id, n_links``.

    ``text_id`` is the least doc_id with the same word sequence, ``class_id``
    the least doc_id of the connected component of links between texts, and
    ``n_links`` the number of other texts that this text was verified to
    match.  NULL and word-less texts match nothing: they are their own class.
    A NULL doc_id has NULL ids and no links.  Repeated rows give repeated
    rows of one class; an empty table gives an empty result.  Columns besides
    ``doc_id`` and ``text`` are not read, whatever their names.
    """
    members, degree, edges = near_links(docs, threshold, shingle_words, recall)
    known = _text_classes(members, degree, edges)
    members = members.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("key")))
    return members.join(known, "key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("text_id", "doc_id").alias("text_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the key of the text class as the last column; a text without a word
    gets a key of its own bytes."""
    for batch in pieces_of(batches):
        keys = []
        for text in batch.column("text").to_pylist():
            words = word_hashes(text)
            keys.append(sequence_key(words) if words.size else b"no word " + (text or "").encode())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())],
                                         names=[*batch.schema.names, "__key"])


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: of the texts of a class the one
    with the least doc_id stays.

    Rows with a NULL doc_id and texts without a word stay, NULL and empty ones
    included.  Where a doc_id is repeated, each of its texts is judged by
    itself, and equal texts under one doc_id count once; no text leaves that no
    kept text resembles.  An empty table stays empty.
    """
    members, degree, edges = near_links(docs, **options)
    known = _text_classes(members, degree, edges)
    stays = F.coalesce(F.col("keeper") & (F.col("doc_id") == F.col("text_id")), F.col("key").isNull())
    judged = staged(members.where(F.col("doc_id").isNotNull()).join(known, "key", "left")
                    .select("doc_id", "key", stays.alias("stays")), "judged")
    each = judged.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_and("stays").alias("stays"))
    repeated = each.where(F.col("rows") > 1).select("doc_id")
    if repeated.isEmpty():
        return docs.join(each.where(~F.col("stays")).select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    once = docs.join(each.where(~F.col("stays") | (F.col("rows") > 1)).select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    gone = judged.where(~F.col("stays")).join(repeated, "doc_id", "left_semi").select("doc_id", F.col("key").alias("__key"))
    some = docs.join(repeated, "doc_id", "left_semi").select(docs.columns)
    keyed = some.mapInArrow(_with_key, T.StructType([*some.schema.fields, T.StructField("__key", T.BinaryType())]))
    return once.unionByName(keyed.join(gone.distinct(), ["doc_id", "__key"], "left_anti")
                            .dropDuplicates(["doc_id", "__key"]).select(docs.columns))
