"""Jaccard join and decontamination against brute force."""

import random
import re

import numpy as np
import pytest
from cohortlens.llm import jaccard_join as jj
from cohortlens.llm.decontaminate import align, drop_contaminated, find_contamination
from cohortlens.llm.words import gram_hashes, word_hashes

WORDS = [f"w{k}" for k in range(400)]
DOCS = "doc_id long, text string"


def tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def shingles(text):
    w = tokens(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows, threshold=0.8):
    """class id, text id and number of other linked texts of each row."""
    text_id, sets = {}, {}
    for i, t in sorted(rows):
        key = tuple(tokens(t)) or ("", i)
        text_id.setdefault(key, i)
        sets.setdefault(key, shingles(t))
    keys = list(sets)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = dict.fromkeys(keys, 0)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in keys:
        least[find(k)] = min(least.get(find(k), text_id[k]), text_id[k])
    out = []
    for i, t in rows:
        k = tuple(tokens(t)) or ("", i)
        out.append((i, least[find(k)], text_id[k], links[k]))
    return sorted(out)


def near_rows(seed=3):
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(60):  # a large group of near copies, edited in a few places
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[5][1].upper() + " !") for i in range(20)]
    rows += [(200 + i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    rows += [(300, "only three words"), (301, "Only three words."), (302, ""), (303, None), (304, " \n "), (305, "x " * 30000)]
    return rows


@pytest.mark.parametrize("small,members", [(2, 1500), (8, 16), (100, 1500)])
def test_join_matches_brute_force(spark, monkeypatch, small, members):
    """Joined pairs, blocks of one group and pairs of blocks agree."""
    monkeypatch.setattr(jj, "SMALL", small)
    monkeypatch.setattr(jj, "BLOCK_MEMBERS", members)
    rows = near_rows()
    got = sorted(tuple(r) for r in jj.jaccard_join(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute(rows)


def test_join_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "k"), (1, "a b c d e f", "k"), (None, "a b c d e f", None), (2, None, "k")],
                               "doc_id long, text string, key string")
    got = sorted((tuple(r) for r in jj.jaccard_join(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, 0), (1, 1, 1, 0), (None, None, None, 0), (2, 2, 2, 0)], key=str)
    kept = jj.keep_one(df).collect()
    assert sorted((r.doc_id or 0, r.key or "") for r in kept) == [(0, ""), (1, "k"), (2, "k")]
    assert jj.jaccard_join(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = jj.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9995 and bands * rows <= 128


def test_word_hashes_follow_the_words(monkeypatch):
    from cohortlens.llm import words
    text = "Ab cd, ab-CD é1 x" + " long" * 40
    whole = word_hashes(text)
    assert len(set(whole.tolist())) == len(set(tokens(text))) and whole.size == len(tokens(text))
    monkeypatch.setattr(words, "SEGMENT", 7)
    assert (word_hashes(text) == whole).all()
    assert gram_hashes(whole[:2], 3).size == 0


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_is_smith_waterman():
    rng = random.Random(1)
    for _ in range(60):
        a = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 14))], np.uint64)
        b = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 18))], np.uint64)
        assert align(a, b)[0] == smith_waterman(a, b)


def test_contamination_finds_copies_and_edited_copies(spark, monkeypatch):
    rng = random.Random(7)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(k, " ".join(say(30))) for k in range(12)] + [(50, "one two"), (51, None), (None, "x y z q r")]
    docs, want = [], {}
    for i in range(80):
        words = say(150)
        if i % 4 == 0:
            k = (i // 4) % 12
            copy = items[k][1].split()
            for _ in range(i // 16):  # up to four edits
                copy[rng.randrange(30)] = "edited"
            at = rng.randrange(100)
            words[at:at] = copy
            want[i] = k
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "one two")]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", __import__("pyspark").sql.functions.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(want.items())
    by = dict(docs)
    for r in got:  # the passage holds the item's score
        passage = word_hashes(by[r.doc_id])[r.start_word:r.start_word + r.n_words]
        item = word_hashes(items[r.item_id][1])
        assert r.score == smith_waterman(item, passage) / (2 * item.size) >= 0.5
    left = {r.doc_id for r in drop_contaminated(df, bench).collect()}
    assert left == {i for i, _ in docs} - set(want)
    from cohortlens.llm import decontaminate
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)  # several blocks of items
    assert {(r.doc_id, r.item_id) for r in find_contamination(df, bench).collect()} == set(want.items())
    assert find_contamination(df.limit(0), bench).count() == 0 == find_contamination(df, bench.limit(0)).count()


@pytest.mark.parametrize("step,share", [(5, 0), (0, 0.15), (0, 0.2), (0, 0.25)])
def test_items_held_only_as_edited_copies_are_found(spark, step, share):
    """Brute-force Smith-Waterman on copies with every fifth word, or 15-25% of
    the words, edited; the corpus has no other copy."""
    rng = random.Random(11)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items, docs, want = [], [], set()
    for k in range(60):
        item = say(rng.randrange(15, 40))
        at = range(step - 1, len(item), step) if step else rng.sample(range(len(item)), round(share * len(item)))
        copy = [f"new{k}x{i}" if i in at else w for i, w in enumerate(item)]
        words = say(30) + copy + say(30)
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(words)))
        if smith_waterman(item, words) >= len(item):
            want.add((k, k))
    assert len(want) > 50
    got = find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_short_items_copied_word_for_word_are_found(spark):
    """Items of 3-14 words, one copy each, with and without a rarest gram in
    the middle (the other grams are held by further documents)."""
    rng = random.Random(13)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items, docs, want = [], [], set()
    for k in range(72):
        n = 3 + k % 12
        item = [f"i{k}w{i}" for i in range(n)]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(say(40) + item + say(40))))
        want.add((k, k))
        if k >= 36:  # all grams but the one in the middle twice more
            middle = (n - 2) // 2
            for d in (100 + k, 200 + k):
                docs.append((d, " ".join(item[:middle + 2] + say(20) + item[middle + 1:])))
    got = {(r.doc_id, r.item_id, r.score) for r in
           find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(d, k) for d, k, score in got if d == k and score == 1.0} == want
    by, words = dict(docs), dict(items)
    assert all(smith_waterman(words[k].split(), by[d].split()) == score * 2 * len(words[k].split()) for d, k, score in got)
