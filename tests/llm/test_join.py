"""The Jaccard join against brute force, with trees small enough to split blocks."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import ngram_join as nj

SCHEMA = "doc_id bigint, text string, cid string, hash string, block string"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    least = {i: i for i, _ in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                least[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n_families=8, copies=14):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    common = [rng.choice(vocab) for _ in range(30)]
    for f in range(n_families):
        base = [rng.choice(vocab) for _ in range(rng.choice((3, 12, 60, 120)))]
        for _ in range(copies if f else 4 * copies):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w += common
            rows.append((k, (" ", "\n", " \t ")[rng.randrange(3)].join(w).upper() if rng.random() < 0.2 else " ".join(w)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \x0b "), (k + 3, "one two"), (k + 4, "One  TWO"), (k + 5, "É"), (k + 6, "é"), (k + 7, "z " * 30_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "leaves"), [(1, 512), (2, 3)])
def test_join_matches_brute_force(spark, seed, leaves):
    rows = corpus(seed)
    d = spark.createDataFrame([(i, t, "c", "h", "b") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.similar(d, leaves=leaves).collect()}
    assert got == brute(rows)


def test_join_odd_rows(spark):
    text = "a b c d e f g h"
    d = spark.createDataFrame([(4, text, "", "", ""), (4, text, "", "", ""), (None, text, "", "", ""), (9, text + " ", "", "", "")], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in nj.similar(d).collect())
    assert got == [(-1, -1), (4, 4), (4, 4), (9, 4)]
    assert nj.similar(d.limit(0)).count() == 0
    assert sorted(r.doc_id or -1 for r in nj.drop_near_copies(d).collect()) == [-1, 4, 4]


def test_shingle_sets_follow_words():
    texts = ["", "a", "A b\tc d e", "a b c d e f", " a  b c\nd e ", "x" * 3000 + " é ß", "a b c d e a b c d e"]
    got = nj.shingle_sets(pa.array(texts))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert np.array_equal(got[2], got[4]) and not np.array_equal(got[2], got[3])
    assert set(got[2]) <= set(got[3]) & set(got[6])


def test_signature_tree_finds_all_links():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = np.unique(rng.integers(0, 2**63, rng.integers(5, 200), dtype=np.uint64))
        for _ in range(9):
            keep = base[rng.random(len(base)) < rng.choice([1, 0.95, 0.85])]
            sets.append(keep if len(keep) else base)
    roots = nj.join_block(list(range(len(sets))), sets)
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if nj.linked(sets[i], sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    assert roots == up


def test_words_of_one_pattern_differ(spark):
    """Thue-Morse words and their complements collide under polynomials modulo a power of two."""
    for size in (64, 1024, 4096):
        word = "".join("ab"[i.bit_count() % 2] for i in range(size))
        other = word.translate(str.maketrans("ab", "ba"))
        one, two = nj.shingle_sets(pa.array([word, other]))
        assert one[0] != two[0]
        d = spark.createDataFrame([(1, word, "", "", ""), (2, other, "", "", ""), (3, word.upper(), "", "", "")], SCHEMA)
        if size == 1024:
            assert sorted((r.doc_id, r.component_id) for r in nj.similar(d).collect()) == [(1, 1), (2, 2), (3, 1)]
    rng = np.random.default_rng(0)
    words = {"".join(rng.choice(list("ab"), rng.integers(1, 30))) for _ in range(20_000)}
    assert len({int(s[0]) for s in nj.shingle_sets(pa.array(sorted(words)))}) == len(words)


def test_classes_of_unequal_sets_get_other_digests(spark, monkeypatch):
    d = spark.createDataFrame([(1, 5, 7), (2, 5, 7), (3, None, None)], "doc_id int, cid bigint, twin bigint")
    assert nj._one_set_each(d)
    assert not nj._one_set_each(d.unionByName(spark.createDataFrame([(4, 5, 8)], "doc_id int, cid bigint, twin bigint")))
    seen = []
    check = nj._one_set_each
    monkeypatch.setattr(nj, "_one_set_each", lambda full: seen.append(check(full)) or len(seen) > 1)
    rows = corpus(3, 3, 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.similar(spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)).collect()}
    assert seen == [True, True] and got == brute(rows)


def test_sketch_is_a_sum_in_any_lanes(spark):
    texts = spark.createDataFrame([(t,) for _, t in corpus(5, 3, 4)], "text string")
    one = nj.frequency_levels(texts.coalesce(1))
    assert np.array_equal(one, nj.frequency_levels(texts.repartition(70)))
