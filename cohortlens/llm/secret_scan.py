"""Secret scans with a battery of randomness tests (operator 9), native.

Three fixed patterns give the base spans.  Further candidates are runs of 20
or more key characters.  Each candidate's encoding is inferred (hex, base32,
alphanumeric, base64) and three statistics are taken: chi-squared uniformity
over the encoding's alphabet, runs of character kinds, and serial correlation
of alphabet positions.  Their z scores are combined into a p-value for "drawn
at random".  Among candidates of one length class, Benjamini-Hochberg control
decides which are rejected as random, that is, as ordinary text; the rest,
where the length gives the tests enough power, are secrets.  P-values are
ranked by a histogram of fixed size, so no candidate list is ever sorted in
one place.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .quality_rules import let

#: Fixed patterns: kind, regular expression, least characters, group that counts.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "(AKIA[A-Z0-9]{14,})"
HEX = "([0-9a-f]{16,})"
CANDIDATE = "([A-Za-z0-9+/_=-]{20,})"
KINDS = ("assign", "access", "hex", "random")
#: Encodings from the narrowest: name, pattern, alphabet size.
ENCODINGS = (("hex", "^([0-9a-f]+|[0-9A-F]+)$", 16), ("base32", "^[A-Z2-7]+=*$", 32),
             ("alnum", "^[A-Za-z0-9]+$", 62), ("base64", "^[A-Za-z0-9+/_=-]+$", 64))
#: Length classes (upper ends) within which false discoveries are controlled.
LENGTHS = (24, 32, 48, 64, 128)
BINS = 400


def _spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """The matches as ``(start, kind, end)`` structs in code points.  The
    pieces that split() leaves between matches give their places."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        both = F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("p"))
        empty = F.struct(F.lit(0).cast("int").alias("at"),
                         F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>").alias("out"))
        return F.aggregate(both, empty, lambda a, x: let(
            a["at"] + F.length(x["p"]), lambda s: F.struct(
                (s + F.length(x["m"])).alias("at"),
                F.concat(a["out"], F.array(F.struct(s.alias("start"), F.lit(kind).alias("kind"),
                                                    (s + F.length(x["m"])).alias("end"),
                                                    x["m"].alias("token")))).alias("out"))), lambda a: a["out"])

    spans = let(whole, lambda found: F.when(F.size(found) == 0, F.array().cast(
        "array<struct<start:int,kind:int,end:int,token:string>>")).otherwise(place(found)))
    return spans if not least else F.filter(
        spans, lambda x: F.length(F.regexp_extract(x["token"], pattern, 2)) >= least)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _battery(tokens: DataFrame) -> DataFrame:
    """Adds ``encoding``, ``length_class`` and ``surprise`` (-ln p)."""
    name, size = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2])
    for n, pattern, k in reversed(ENCODINGS[:-1]):
        name = F.when(F.col("token").rlike(pattern), F.lit(n)).otherwise(name)
        size = F.when(F.col("token").rlike(pattern), F.lit(k)).otherwise(size)
    classed = F.lit(len(LENGTHS))
    for k, end in reversed(list(enumerate(LENGTHS))):
        classed = F.when(F.length("token") <= end, F.lit(k)).otherwise(classed)
    body = F.regexp_replace("token", "=+$", "")
    df = tokens.select("*", name.alias("encoding"), size.cast("double").alias("k"), classed.alias("length_class"),
                       F.filter(F.split(body, ""), lambda c: c != "").alias("chars"))
    code = lambda c: F.ascii(c)
    # place in the order digits, lower case, upper case, signs
    place = lambda c: (F.when(code(c).between(48, 57), code(c) - 48).when(code(c).between(97, 122), code(c) - 87)
                       .when(code(c).between(65, 90), code(c) - 29).otherwise(62 + code(c) % 2))
    kind = lambda c: (F.when(code(c).between(48, 57), 0).when(code(c).between(97, 122), 1)
                      .when(code(c).between(65, 90), 2).otherwise(3))
    df = df.withColumn("n", F.size("chars").cast("double")).withColumn("at", F.transform("chars", place)) \
        .withColumn("kinds", F.transform("chars", kind))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    at, kinds = F.col("at"), F.col("kinds")
    counts = F.transform(F.array_distinct(at), lambda v: F.size(F.filter(at, lambda x: x == v)).cast("double"))
    df = df.withColumn("squares", total(F.transform(counts, lambda c: c * c)))
    # runs of kinds: expected number from the kinds' shares in the token
    shares = F.transform(F.array_distinct(kinds), lambda v: F.size(F.filter(kinds, lambda x: x == v)) / F.col("n"))
    df = df.withColumn("same", total(F.transform(shares, lambda s: s * s)))
    changes = F.zip_with(F.slice(kinds, F.lit(1), F.size(kinds) - 1), F.slice(kinds, F.lit(2), F.size(kinds) - 1),
                         lambda a, b: (a != b).cast("double"))
    df = df.withColumn("changes", total(changes)).withColumn("mean", total(F.transform(at, lambda x: x.cast("double"))) / F.col("n"))
    off = F.transform(at, lambda x: x - F.col("mean"))
    df = df.withColumn("off", off)
    df = df.withColumn("var", total(F.transform("off", lambda x: x * x))) \
        .withColumn("lag", total(F.zip_with(F.slice("off", F.lit(1), F.size("off") - 1),
                                            F.slice("off", F.lit(2), F.size("off") - 1), lambda a, b: a * b)))
    n, k = F.col("n"), F.col("k")
    # Wilson-Hilferty z of the chi-squared statistic
    chi = k / n * F.col("squares") - n
    z1 = (F.cbrt(F.greatest(chi, F.lit(1e-9)) / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    expect = (n - 1) * (1 - F.col("same"))
    z2 = F.coalesce(F.try_divide(expect - F.col("changes"), F.sqrt((n - 1) * F.col("same") * (1 - F.col("same")))), F.lit(0.0))
    z3 = F.coalesce(F.try_divide(F.col("lag"), F.col("var")), F.lit(1.0)) * F.sqrt(n)
    z = (F.greatest(z1, F.lit(-1.0)) + F.greatest(z2, F.lit(-1.0)) + F.greatest(F.abs(z3) - 0.8, F.lit(-0.8))) / math.sqrt(3.0)
    # upper normal tail, logistic approximation
    return df.withColumn("surprise", F.log(1 + F.exp(F.least(F.lit(500.0), 1.5976 * z + 0.070565992 * z * z * z)))) \
        .select(*tokens.columns, "encoding", "length_class", "surprise", "n")


def _rejected(scored: DataFrame, rate: float) -> DataFrame:
    """``(length_class, cut)``: the least bin of surprise that Benjamini-
    Hochberg rejects in the class (NULL: none).  At most ``BINS`` bins."""
    bins = scored.groupBy("length_class", "bin").agg(F.count("*").alias("n"))
    lists = bins.groupBy("length_class").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"),
                                             F.sum("n").alias("m"))
    step = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("cut")),
                       lambda a, b: F.struct(
                           (a["seen"] + b["n"]).alias("seen"),
                           F.when(F.exp(-b["bin"] / 20.0) <= rate * (a["seen"] + b["n"]) / F.col("m"), b["bin"])
                           .otherwise(a["cut"]).alias("cut")), lambda a: a["cut"])
    return lists.select("length_class", step.alias("cut"))


def secret_scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Secrets of every row of ``docs``: ``doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_random``.

    ``rate`` is the false-discovery rate among the candidates called ordinary
    text.  A candidate must hold a digit and a letter and have at least eight
    different characters; shorter or plainer runs give the tests no power.
    NULL and empty texts have no spans; repeated rows are scanned alike, and
    an empty table gives an empty result.
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = F.concat(_spans(text, ASSIGN, 0, 12), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))
    free = F.filter(_spans(text, CANDIDATE, 3), lambda x: x["token"].rlike("[0-9]") & x["token"].rlike("[A-Za-z]"))
    found = staged(rows.select("doc_id", base.alias("base"), free.alias("free"))
                   .select(F.monotonically_increasing_id().alias("row"), "doc_id", plain(F.col("base")).alias("base"), "free"), "spans")
    tokens = found.where(F.size("free") > 0).select("row", F.explode("free").alias("s")).select(
        "row", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.token").alias("token"))
    tokens = tokens.where(F.size(F.array_distinct(F.split("token", ""))) >= 8)
    scored = staged(_battery(tokens).select("row", "start", "end", "encoding", "length_class", F.least(
        F.lit(BINS), F.floor(20 * F.col("surprise"))).cast("int").alias("bin")), "scored")
    cuts = F.broadcast(_rejected(scored, rate))  # one row per length class
    random = (scored.join(cuts, "length_class").where(F.col("cut").isNull() | (F.col("bin") < F.col("cut")))
              .groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("random")))
    with_free = found.where(F.size("free") > 0).select("row", "doc_id", "base").join(random, "row", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    every = with_free.select("doc_id", "base", F.coalesce("random", none).alias("random")).unionByName(
        found.where(F.size("free") == 0).select("doc_id", "base", none.alias("random")))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return every.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.concat("base", "random")).alias("spans"), F.size("random").cast("long").alias("n_random"))
