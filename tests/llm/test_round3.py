"""Whitening, filter audit and byte-level BPE against brute force."""

import base64
import hashlib
import itertools
import re

import numpy as np
import public_tokenizers
import pytest
import regex
from cohortlens.llm import byte_bpe
from cohortlens.llm.byte_bpe import Encoder, Vocabulary, digests, encode_and_decode, pieces, vocabulary
from cohortlens.llm.filter_audit import ORACLE_SQL, audit_filters
from cohortlens.llm.whitening import whiten
from hypothesis import given, reject, settings
from hypothesis import strategies as st

# ---------------------------------------------------------------- whitening


def brute_whitening(vectors, most=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    centred = (n * x - total) / n
    _, sigma, axes = np.linalg.svd(centred, full_matrices=False)
    k = min(most, int((sigma > 1e-11 * sigma[0]).sum()))
    return deviation, centred @ axes[:k].T / sigma[:k] * np.sqrt(n), sigma[:k] ** 2 / (centred ** 2).sum()


def whitened(spark, vectors, most=32, **more):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(5)
    return whiten(df, components=most, **more).toPandas().sort_values(["vec_id", "component"])


@pytest.mark.parametrize("n,dims,scales,shift", [
    (200, 6, [1, 1, 1, 1, 1, 1], 0), (150, 40, np.geomspace(1, 300, 40), 5), (60, 5, [1e-1, 1, 1e2, 1e3, 1e5], -3e4),
    (4, 7, [3] * 7, 1)])
def test_whitening_equals_an_eigendecomposition(spark, n, dims, scales, shift):
    vectors = np.random.default_rng(n).normal(size=(n, dims)) * scales + shift
    got = whitened(spark, [[np.nan, *v[1:]] if i == 1 else [None, *v[1:]] if i == 2 and n > 4 else v
                           for i, v in enumerate(vectors)])
    left = [i for i in range(n) if i != 1 and not (i == 2 and n > 4)]
    deviation, rows, explained = brute_whitening(vectors[left])
    k = rows.shape[1]
    assert k == min(32, dims, len(left) - 1)
    assert got.groupby("vec_id").size().to_dict() == {i: k for i in left}
    assert got[got.component == 1].deviation.map(int).tolist() == deviation
    mine = got.whitened.to_numpy().reshape(len(left), k)
    sign = np.sign((mine * rows).sum(axis=0))
    np.testing.assert_allclose(mine * sign, rows, atol=2e-6)
    np.testing.assert_allclose(got.explained.to_numpy()[:k], explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert set(got.n) == {len(left)}


def test_whitening_edges(spark):
    base = np.random.default_rng(1).normal(size=(30, 3))
    wide = np.hstack([base, base[:, :1] * 0 + 7, base[:, 1:2]])  # a constant and a repeated dimension
    got = whitened(spark, wide)
    assert sorted(set(got.component)) == [1, 2, 3] and got.identity_error.max() < 1e-9
    # repeated rows count each, NULL vectors and infinite entries are left out
    rows = [*base, *base[:5], None, [1.0, float("inf"), 0.0], [1.0, float("-inf"), 0.0]]
    got = whitened(spark, rows, most=2)
    assert set(got.n) == {35} and sorted(set(got.component)) == [1, 2]
    assert got[got.vec_id == 0].whitened.tolist() == got[got.vec_id == 30].whitened.tolist()
    for none in ([], [base[0]], [base[0]] * 4, [[], []]):
        assert whitened(spark, none).empty
    with pytest.raises(Exception, match="between 2 and 3 entries"):
        whitened(spark, [[1, 2, 3], [1, 2]])
    big = spark.createDataFrame([(i, [float(c) * 1e12 for c in v]) for i, v in enumerate(base)], "k long, v array<double>")
    got = whiten(big, "k", "v").toPandas().sort_values(["vec_id", "component"])
    deviation, _, _ = brute_whitening([[float(c) * 1e12 for c in v] for v in base])  # beyond 64 bits
    assert [int(d) for d in got[got.component == 1].deviation] == deviation and max(deviation) > 1 << 63


# ---------------------------------------------------------------- filter audit

AUDIT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failed = []
    for doc, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs)
        failed.append({f for f, fails in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            bool(re.search(r"[#$%&*|]", text)), copy)) if fails})
    out = {}
    for part in {p or "" for _, _, p in docs}:
        own = [(d, f) for (d, _, p), f in zip(docs, failed) if (p or "") == part]
        for order in itertools.permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                here = [d for d, f in own if name in f and not f & set(order[:step - 1])]
                out[part, "".join(order), step] = [
                    sum(not f & set(order[:step]) for _, f in own), len(here), sum(name in f for _, f in own) - len(here),
                    sum(f == {name} for _, f in own), sum(d in good for d in here), sum(d in toxic for d in here)]
    for key in list(out):
        out[key].append(sum(v[1] for (p, o, s), v in out.items() if p == key[0] and o[s - 1] == key[1][key[2] - 1]))
    return out


def test_audit_equals_brute_force_and_sql(spark):
    import duckdb
    import pandas as pd

    rng = np.random.default_rng(3)
    words = ["a", "bb", "É", "Cc", "DDD", "x#", " y", "z|", "e", "f", "g", "h"]
    docs = [(None, "same", "s"), (None, "same", "s"), (0, None, "s"), (1, "", None), (2, " \t\n", ""), (3, "same", "t"),
            (3, "same", "t"), (3, "same", "s"), (2, "same", "t"), (9, "word " * 5000 + "Ä" * 3000, "long"), (8, "same", None)]
    for k in range(60):
        body = " ".join(words[i % (12 if k % 3 else 3)] + ("" if k % 2 else str(i))
                        for i in rng.integers(0, 12 if k % 5 else 2, 30 * (k % 13)))
        docs.append((100 + k, body + ("\n" if k % 4 else ""), ["s", "t", None][k % 3]))
    docs += [(d + 1000, t, "copy") for d, t, _ in docs if d is not None and d % 2]
    labels = [(d, int(d % 3 == 0), int(d % 5 == 0)) for d, _, _ in docs if d is not None and d % 2 == 0]
    labels += [(102, None, 1), (102, 0, None), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "m", 1) for d in docs], "doc_id long, text string, source string, part string, mask int")
    lf = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    want = brute_audit(docs, labels)
    got = {(r.part, r.filter_order, r.step): [r[c] for c in AUDIT] for r in audit_filters(df.repartition(7), lf).collect()}
    assert got == want
    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "source"]).convert_dtypes())
        db.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).convert_dtypes())
        sql = {tuple(r[:3]): list(r[3:]) for r in db.execute(ORACLE_SQL).fetchall()}
    assert sql == want
    assert audit_filters(df.limit(0), lf).count() == 0
    none = {(r.part, r.filter_order, r.step): r for r in audit_filters(df, lf.limit(0)).collect()}
    assert set(none) == set(want) and not any(r.good_lost or r.toxic_lost for r in none.values())


# ---------------------------------------------------------------- byte-level BPE

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPLIT = regex.compile(public_tokenizers.PATTERN)


def merged(ranks, data):
    """Merging by rank, the lowest first and leftmost among equals."""
    if data in ranks:
        return [ranks[data]]
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400)), max_size=40),
       st.lists(st.lists(st.sampled_from(b"abc"), min_size=1, max_size=24).map(bytes), min_size=1, max_size=6))
def test_backtracking_equals_merging_for_any_vocabulary(pairs, texts):
    """Random merges (tokens that no merge makes included) over three letters."""
    tokens = [bytes([b]) for b in b"abc"]
    order = {bytes([b]): b for b in range(256)}
    for a, b in pairs:
        new = tokens[a % len(tokens)] + tokens[b % len(tokens)]
        if new not in order and len(new) < 9:
            order[new] = len(order)
            tokens.append(new)
    try:
        encoder = Encoder(Vocabulary(order))
    except ValueError:  # a token before one that it is merged from
        reject()
    for text in texts:
        assert np.frombuffer(encoder[text.decode()], np.int32).tolist() == merged(order, text)


def test_tokens_that_no_merge_makes():
    order = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257, b"bc": 258, b"abc": 259, b"abxyzc": 260}
    encoder = Encoder(Vocabulary(order))
    for text in ("abc", "abcabc", "xyz", "xyzxyz", "abxyzc", "cabxyzcbc", "bcab"):
        assert np.frombuffer(encoder[text], np.int32).tolist() == merged(order, text.encode())
    with pytest.raises(ValueError, match="lacks the bytes"):
        Vocabulary({b"a": 0})
    with pytest.raises(ValueError, match="no order of merges"):
        Vocabulary({bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257})
    with pytest.raises(ValueError, match="not in the vocabulary"):
        Vocabulary(order).decode(np.array([999]))


def test_encoding_equals_tiktoken(spark, monkeypatch):
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(5)
    odd = "".join(map(chr, rng.integers(1, 0xD7FF, 4000)))
    texts = [None, "", " ", "  a  \n\n b", "it's we'll I've 'really 's", "x" * 3000, "   z", odd, "日本語 ñandú 😀😀",
             "<|endoftext|> tie", "tie", "tie", "=" * 900 + " " * 700 + "end", "".join(rng.choice(list("abcdefgh "), 200_000)),
             "a" * 100_000, "\x1c\x85\x00 \t\r\n"]
    df = spark.createDataFrame([(None if i == 3 else i, t, "n") for i, t in enumerate(texts)],
                               "doc_id long, text string, ids string")
    want = [((None if i == 3 else i), *(lambda x: (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()))(
        own.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)]
    for span, held, pairs in ((1 << 20, 48 << 20, 1 << 18), (64, 4000, 50)):  # whole texts; many cuts and tiny memories
        monkeypatch.setattr(byte_bpe, "SPAN", span)
        monkeypatch.setattr(byte_bpe, "PIECE_BYTES", held)
        monkeypatch.setattr(byte_bpe, "PAIRS", pairs)
        for t in texts:
            assert [p for found in pieces(SPLIT, t or "") for p in found] == SPLIT.findall(t or "")
            encoder = Encoder(vocabulary(RANKS))
            assert [i for p in SPLIT.findall(t or "") for i in np.frombuffer(encoder[p], np.int32).tolist()] \
                == own.encode_ordinary(t or "")
    got = [tuple(r) for r in digests(encode_and_decode(df, RANKS, public_tokenizers.PATTERN)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert digests(encode_and_decode(df.limit(0), RANKS, public_tokenizers.PATTERN)).count() == 0

# ---------------------------------------------------------------- equal polynomial hashes


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_texts_with_equal_polynomials_stay_apart(spark):
    """Thue-Morse words and their complements agree under every polynomial
    hash modulo 2^64."""
    from cohortlens.llm.catalog import word_tokenizer
    from cohortlens.llm.jaccard_join import jaccard_join, keep_one
    from cohortlens.llm.token_records import PieceEncoder
    from cohortlens.llm.words import word_hashes
    import pyarrow as pa
    from tokenizers import Tokenizer

    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    assert len(set(word_hashes(f"{one} {other} {one}").tolist())) == 2
    encode = Tokenizer.from_file(word_tokenizer()).encode
    texts = [f"{one} {other}", f"{other} {one} x", one, other, "a\u2605b \u2605 c", "\u2605"]
    assert [x.tolist() for x in PieceEncoder(word_tokenizer()).texts(pa.array(texts))] \
        == [encode(t, add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join(df).collect()) == [(1, 1, 1, 0), (2, 2, 2, 0), (3, 1, 1, 0)]
    assert sorted(r.doc_id for r in keep_one(df).collect()) == [1, 2]


def test_keep_one_judges_every_text_of_a_repeated_id(spark):
    from cohortlens.llm.jaccard_join import keep_one

    a, b = ("one two three four five six seven", "quite another text with eight words in it")
    rows = [(1, a, "s"), (1, b, "t"), (1, a, "s"), (2, b, "s"), (2, "a third text that stands by itself here", "s"),
            (3, a.upper(), "s"), (4, "!", "s"), (4, "?", "s"), (4, None, "s"), (None, a, "s"), (None, a, "s")]
    kept = sorted(((r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string, key string"))
                   .collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (2, rows[4][1]), (4, "!"), (4, "?"), (4, None), (None, a), (None, a)], key=str)
