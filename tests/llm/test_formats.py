"""Chat formatting, token records and HTML extraction: exact round trips."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cohortlens.llm import token_records as tr
from cohortlens.llm.catalog import word_tokenizer
from cohortlens.llm.chat_format import format_and_read, format_conversations, parse_turns, render_turn, unescape
from cohortlens.llm.common import new_path
from cohortlens.llm.html_extract import deduce_templates, extract_pages
from hypothesis import given, settings
from hypothesis import strategies as st

PIECES = st.sampled_from(["\\", "### User: ", "### Assistant: ", "### Assistant:", "</turn>", "\n", "x", " ", "### ", "~",
                          "### ~a: ", ":", "###", "</turn", ">", "User: "])


@settings(max_examples=400, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "User", "a b:\n", "~x", "é"]),
                          st.lists(PIECES, max_size=9).map("".join)), max_size=4))
def test_grammar_round_trip(turns):
    rendered = [render_turn(*t) for t in turns]
    assert parse_turns("".join(r[0] for r in rendered)) == turns
    assert [unescape(r[0][r[1]:r[2]]) for r in rendered] == [t for _, t in turns]


def test_conversations(spark, monkeypatch):
    odd = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "b\n</turn>"), (1, 0, "user", "a"), (-7, 0, "user", odd), (-7, 1, "assistant", odd),
            (2, 0, "assistant", None), (2, 0, "assistant", None), (3, None, None, ""), (None, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, part string")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or -1))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[conv] = (len(own), digest("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(said), digest(said))
    for part in (1 << 20, 10):  # whole conversations, and one part a turn
        monkeypatch.setattr("cohortlens.llm.chat_format.PART", part)
        got = {r.conv_id: tuple(r)[1:5] for r in format_and_read(df).collect()}
        assert got == want
        parts = format_conversations(df).collect()
        assert {r.conv_id: r.formatted_chars for r in format_and_read(df).collect()}[-7] \
            == sum(len(r.text) for r in parts if r.conv_id == -7)
    assert format_and_read(df.limit(0)).count() == 0


TEXTS = ["Hello world", None, "", "  a\n\tb ", "it's we'll <|endoftext|>x İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ éx ́ y", "a b c\x1cd",
         "x" * 500, " 12 345,.. !! ñandú", "日本 語", "tie", "tie"]


def expected_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(word_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("segment,remembered", [(1 << 21, 400_000), (8, 3)])
def test_encoder_equals_whole_text_encoding(monkeypatch, segment, remembered):
    monkeypatch.setattr(tr, "SEGMENT", segment)
    monkeypatch.setattr(tr, "REMEMBERED", remembered)
    column = pa.array(["skipped", *TEXTS])[1:]
    assert [x.tolist() for x in tr.PieceEncoder(word_tokenizer()).texts(column)] == expected_ids(TEXTS)


def test_records(spark):
    rows = [(10 * (k % 9), x) for k, x in enumerate(TEXTS)] + [(None, "null id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start long").repartition(3)
    path = new_path(spark, "records")
    manifest = tr.write_records(df, path, word_tokenizer())
    got = sorted((tuple(r) for r in tr.read_records(spark, manifest, path).collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = np.array([*expected_ids([t])[0], 1], "<u4")
        assert r == (i, start, ids.size, zlib.crc32(ids.tobytes()))
        start += ids.size
    for row in manifest.collect():  # any order through the index
        places = np.arange(row.records)[::-1]
        assert sum(ids.size for _, ids in tr.read_at(path, row["index"], places)) == row.tokens
    empty = new_path(spark, "records")
    assert tr.read_records(spark, tr.write_records(df.limit(0), empty, word_tokenizer()), empty).count() == 0


def test_damaged_record_is_noticed():
    import struct
    payload = struct.pack("<Bq", 0, 5) + b"\x01\x00"
    head = struct.pack("<Q", len(payload))
    good = head + struct.pack("<I", tr.masked_crc(head)) + payload + struct.pack("<I", tr.masked_crc(payload))
    assert tr.parse_record(good)[0] == 5
    for k in (0, 9, 15, len(good) - 1):
        with pytest.raises((ValueError, struct.error)):
            tr.parse_record(good[:k] + bytes([good[k] ^ 1]) + good[k + 1:])


def page(title, body, extra=""):
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><header>Site</header>"
            f"<nav><ul><li><a href='/x'>One</a></li></ul></nav><div class='cookie-notice'>Accept</div>{extra}"
            f"<main><h1>{title}</h1>{body}<div class='comments'><p>first!</p></div></main>"
            f"<aside>more</aside><form><p>mail</p></form><footer>&copy; me</footer></body></html>")


def test_pages(spark):
    body = "<p>A &amp; b<b>c</b>  d<br>e\n f<p>common line<script>x='</p>'</script><ul><li>i<li>j</ul><table><tr><td>1<td>2</table>"
    text = "A & bc d\ne f\ncommon line\ni\nj\n1 2"
    rows = [(k, f"https://h.example/{k}", page(f"T{k}", body)) for k in range(5)]
    rows += [(10 + k, f"http://plain.example/{k}", f"<body><div class='menu'><a>m</a></div><div class='content'><p>own {k}<p>second</div>"
                                                   f"<div class='sidebar'>s</div></body>") for k in range(4)]
    rows += [(20, "odd", page("T", "<p>x").replace("main>", "article>")), (21, None, None), (22, "", ""), (23, "http://cut/", page("C", "<p>whole text")[:-40]),
             (24, "http://one/", "no markup at all"), (0, "https://h.example/0", page("T0", body))]
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(spark.createDataFrame(
        [(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()}
    for k in range(5):
        assert got[k][0] == f"T{k}\n{text}"
    for k in range(4):
        assert got[10 + k][0] == f"own {k}\nsecond"
    assert got[20][0] == "T\nx" and got[21] == got[22] == ("", 0) and got[23][0] == "C\nwhole text"
    assert got[24][0] == "no markup at all" and all(len(t) == n for t, n in got.values())
    assert extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_equivalence_classes(spark):
    """Elements that occur alike on the pages of a host make its template."""
    rows = [(k, f"https://h.example/{k}", page("T", "<p>x" + "<div class='odd'>y</div>" * (k % 2))) for k in range(4)]
    kept = {r.host: r for r in deduce_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "/html/body/main" in kept["h.example"].keep and "/html/body/nav" in kept["h.example"].drop


def test_remembered_pieces_stay_within_their_bytes(monkeypatch):
    """The arrays of one generation and what the encoder allocates in all, on
    texts of ever new pieces; pieces of an equal hash stay apart."""
    import tracemalloc

    monkeypatch.setattr(tr, "REMEMBERED", 4 << 20)
    monkeypatch.setattr(tr, "SEGMENT", 1 << 14)
    encoder = tr.PieceEncoder(word_tokenizer())
    texts = [" ".join(f"{(k * 500 + j) * 7919:x}" for j in range(500)) for k in range(400)]
    list(encoder.texts(pa.array(texts[:20])))
    tracemalloc.start()
    for at in range(20, 400, 20):
        list(encoder.texts(pa.array(texts[at:at + 20])))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert encoder.known.nbytes + encoder.before.nbytes < 1.5 * tr.REMEMBERED and kept < 1.5 * tr.REMEMBERED
    assert [x.tolist() for x in encoder.texts(pa.array(texts[:3]))] == expected_ids(texts[:3])

    raw = np.frombuffer(b"abcdef", np.uint8)
    known = tr.Pieces(np.dtype("<u2"))
    starts, sizes, hashes = np.array([0, 2, 4]), np.array([2, 2, 2]), np.array([5, 5, 9], np.uint64)
    assert known.add(raw, sizes, hashes, np.arange(3), np.ones(3, int)).tolist() == [0, 1, 2]
    assert known.find(raw, starts, sizes, hashes).tolist() == [0, -1, 2]
    assert known.find(raw, starts, np.array([1, 2, 1]), hashes).tolist() == [-1, -1, -1]


def test_python_workers_build_small_batches():
    from cohortlens.llm.common import pieces_of
    from cohortlens.llm.jaccard_join import _signer

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1200)), "text": [f"text {k}" for k in range(1200)]})
    assert [b.num_rows for b in pieces_of(iter([batch, batch.slice(0, 0)]))] == [512, 512, 176]
    signed = list(_signer(5, 2, 2)(iter([batch])))
    assert max(b.num_rows for b in signed) == 512 and pa.Table.from_batches(signed).column("doc_id").to_pylist() == list(range(1200))
