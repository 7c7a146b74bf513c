"""Fingerprints, the filter audit and whitening against plain versions."""

import hashlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from tidewire.llm import filter_audit, fingerprints, queries, whitening

PROSE = "the quick brown fox, jumped over 13 lazy dogs; and then it slept until the morning came again — über alles, señor. "


def plain_syncmers(text, k, s):
    """Runs of k code points whose least inner substring is at an edge, by loops; each run is hashed alone."""
    out = []
    for i in range(len(text) - k + 1):
        run = text[i : i + k]
        inner = [int(fingerprints._inner(fingerprints._codes(run[j : j + s]).astype(np.uint64), s)[0]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, int(fingerprints.syncmers(fingerprints._codes(run), k, s)[1][0])))
    return out


@pytest.mark.parametrize(("k", "s"), [(16, 5), (6, 2), (2, 1)])
def test_syncmers_depend_on_their_own_letters_only(k, s, monkeypatch):
    text = PROSE * 3 + "x" * 40
    expected = plain_syncmers(text, k, s)
    for chunk in (1 << 19, 7):
        monkeypatch.setattr(fingerprints, "CHUNK", chunk)
        at, h = fingerprints.syncmers(fingerprints._codes(text), k, s)
        assert list(zip(at.tolist(), h.tolist(), strict=True)) == expected
    assert max(b - a for (a, _), (b, _) in zip(expected, expected[1:])) <= k - s  # noqa: B905
    assert not len(fingerprints.syncmers(fingerprints._codes("x" * (k - 1)), k, s)[0])


def plain_likeness(a, b):
    """The longest common sequence by its table, over the least anchors of both."""
    kept = sorted({*a, *b})
    if fingerprints.SIZE in (len(a), len(b)):
        kept = kept[: fingerprints.SIZE]
    if not kept:
        return 1.0
    x, y = [h for h in a if h <= kept[-1]], [h for h in b if h <= kept[-1]]
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1] / len(kept)


def test_fingerprints_hashed_together_or_alone(monkeypatch):
    texts = ["", "a", "ab", "abc", "abcdefgh", PROSE[:20], PROSE, PROSE * 40, "ha " * 500, "\U0001f600" * 50, PROSE * 40]
    together = [x.tolist() for x in fingerprints.anchors(texts)]
    assert together == [fingerprints.anchors([t])[0].tolist() for t in texts]
    assert together[-1] == together[-4] and together[0] == []
    assert all(fingerprints.unpacked(fingerprints.packed(np.array(x, np.uint64))) == x for x in together)
    for a in together:
        for b in together:
            assert fingerprints.likeness(a, b) == pytest.approx(plain_likeness(a, b))
    monkeypatch.setattr(fingerprints, "AT_ONCE", 10)
    assert together == [x.tolist() for x in fingerprints.anchors(texts)]
    # Repeats count: half of a repeated text is not the whole one.
    assert fingerprints.likeness(*(x.tolist() for x in fingerprints.anchors(["ha " * 18, "ha " * 9]))) < 0.7


def test_fingerprint_query_matches_plain_rows(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 120)))) for i in rng.permutation(400).tolist()]
    rows += [(None, "no name " * 9), (None, None), (7, rows[0][1]), (7, rows[0][1]), (900, None), (901, ""), (902, "x"), (1000, PROSE * 3000)]
    d = spark.createDataFrame([(i, t, "clash", 1.5) for i, t in rows], "doc_id bigint, text string, fingerprint string, part double").repartition(5)
    order = sorted(((-1 if i is None else i, t or "", i) for i, t in rows), key=lambda r: (r[0], r[1].encode()))
    expected = []
    for k, (_, text, i) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        f, g, h = (x.tolist() for x in fingerprints.anchors([text, edited, after]))
        pack = lambda x: fingerprints.packed(np.array(x, np.uint64))
        expected.append((i is None, i or 0, len(text), hashlib.sha256(edited.encode()).hexdigest(), pack(f), pack(g), plain_likeness(f, g), plain_likeness(f, h)))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.compare_with_edits(d).collect()]
    assert sorted(got) == sorted(expected)
    plain = {(r.doc_id, r.n_chars, r.fingerprint) for r in fingerprints.fingerprints(d).collect()}
    assert plain == {(None if n else i, c, f) for n, i, c, _, f, *_ in expected}


def test_fingerprints_tell_edits_from_others(spark, sf):
    p = queries.op11_fingerprints(spark, sf).toPandas()
    long = p[p.n_chars >= 100]
    assert (long.near_edited > 0.08).all() and (long.near_edited.mean() > 0.3)
    assert (long.near_next < 0.08).mean() > 0.98
    assert (p.near_edited.between(0, 1) & p.near_next.between(0, 1)).all()


def test_fingerprints_of_few_rows(spark):
    d = spark.createDataFrame([(1, "alone in the world")], "doc_id bigint, text string")
    r = fingerprints.compare_with_edits(d).first()
    assert (r.near_next, r.n_chars) == (1.0, 18) and r.edited_sha256 == hashlib.sha256(b"alone in alone in ").hexdigest()
    assert fingerprints.compare_with_edits(d.limit(0)).count() == 0 and fingerprints.fingerprints(d.limit(0)).count() == 0


def odd_documents(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)] + ["Big", "HUGE", "c#", "x&y", " ", "naïve"]
    some = [" ".join(rng.choice(words[: rng.integers(3, 406)], rng.integers(0, 500))) for _ in range(60)]
    rows = [(int(i), some[rng.integers(60)], [None, "", "de", "en"][rng.integers(4)]) for i in range(200)]
    rows += [(3, some[0], "de"), (3, some[0], "de"), (None, some[1], "en"), (None, some[1], "en"), (None, None, None), (500, None, "en"), (501, "", "xx"), (502, "\t \x0b\x0c\r\n", "xx"), (503, "ABC\x1cdef " * 90_000, "en")]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 200, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (501, None, None)]
    d = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id bigint, text string, lang string, part string, n int").repartition(4)
    return rows, labels, d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


SPACE = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def plain_words(text):
    return [w for w in text.translate(SPACE).split(" ") if w]


def test_document_terms_hold_every_word(spark):
    rows, _, d, _ = odd_documents(spark)
    terms = filter_audit.document_terms(d)
    words = {r.word_id: bytes(r.word).decode() for r in terms.words.collect()}
    assert sorted(words) == list(range(len(words)))
    got = []
    for s in terms.shards.collect():
        for doc_id, part, indices, data in filter_audit.sparse_rows(s):
            assert len(indices) == len(set(indices.tolist()))
            got.append((str(doc_id), part, sorted((words[i], n) for i, n in zip(indices.tolist(), data.tolist(), strict=True))))
    assert sorted(got) == sorted((str(i), lang or "", sorted(Counter(plain_words(t or "")).items())) for i, t, lang in rows)
    assert sorted(words.values()) == sorted({w for _, t, _ in rows for w in plain_words(t or "")})


def test_shards_close_by_size():
    shard = filter_audit._Shard()
    shard.add(1, "", "a b a")
    shard.add(2, "", "")
    shard.add(None, "de", "b c")
    words, rows = shard.batches(5)
    assert words.column("word").to_pylist() == [b"a", b"b", b"c"] and words.column("at").to_pylist() == [0, 1, 2]
    r = rows.to_pylist()[0]
    assert [filter_audit._ints(r[c]).tolist() for c in ("indptr", "indices", "data")] == [[0, 2, 2, 4], [0, 1, 1, 2], [2, 1, 1, 1]]
    assert (r["doc_id"], r["part"]) == ([1, 2, None], ["", "", "de"])


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = defaultdict(Counter)
    for i, t, lang in rows:
        t, w = t or "", plain_words(t or "")
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t))
        fails += "D" * any(c in "#$%&*|" for c in t) + "E" * (i is not None and least[t] < i)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[lang or "", order, step]
                here = f in fails and not gone
                c["redundant"] += f in fails and gone
                gone |= f in fails
                c["kept"] += not gone
                c["removed"] += here
                c["unique_fails"] += fails == f
                c["good_lost"] += here and i in good and i is not None
                c["toxic_lost"] += here and i in toxic and i is not None
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {k: [*(int(c[n]) for n in names), shapley[k[0], k[1][k[2] - 1]]] for k, c in out.items()}


def test_audit_matches_plain_orders(spark):
    rows, labels, d, marks = odd_documents(spark)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(d, marks).collect()}
    assert got == plain_audit(rows, labels)
    assert filter_audit.audit(d.limit(0), marks).count() == 0
    assert filter_audit.audit(d, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def matrices():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    few = rng.normal(size=(30, 64))
    wilkinson = np.diag(np.abs(np.arange(-10, 11)) + 2.0) + np.eye(21, k=1) + np.eye(21, k=-1)
    yield from (np.triu(rng.normal(size=(d, d))) for d in (1, 2, 3, 16, 64, 150))
    yield from (np.eye(6), np.diag([1e8, 1.0, 1e-8]), np.zeros((5, 5)), np.linalg.cholesky(wilkinson).T)
    yield np.linalg.qr(np.diag([5.0] * 3 + [4.9999999999] * 3 + [1.0] * 34) @ turn, mode="r")
    yield np.vstack([np.linalg.qr(few - few.mean(0), mode="r"), np.zeros((34, 64))])


def test_components_of_odd_matrices():
    for r in matrices():
        d = r.shape[1]
        a, b, _ = whitening.bidiagonal(r)
        exact = np.linalg.svd(r, compute_uv=False)
        assert np.allclose(np.sqrt([v[0] for v in whitening.dqds(a, b)]), exact, rtol=0, atol=1e-14 * d * max(exact[0], 1))
        values, z = whitening.components(r)
        rank = min(4, int((exact > 1e-15 * d * exact[0]).sum())) if exact[0] else 0
        assert len(values) == rank == z.shape[1]
        if rank:
            assert np.abs(z.T @ z - np.eye(rank)).max() < 1e-14 * d + 1e-15
            assert np.abs(r.T @ (r @ z) - z * values).max() < 1e-14 * d * exact[0] ** 2


def test_small_values_are_as_exact_as_large_ones():
    a, b = np.array([1.0, 1e-6, 1e-12, 1e-18]), np.array([1e-3, 1e-9, 1e-15])
    got = np.sqrt([v[0] for v in whitening.dqds(a, b)])
    # The product of the values is that of the diagonal, whatever their sizes.
    assert np.prod(got / a[np.argsort(-a)]) == pytest.approx(1, rel=1e-13)
    assert got[-1] == pytest.approx(1e-18, rel=1e-5)


def check_whitening(out, kept, most=4):
    """Rows of a whitening against numpy's eigenvectors."""
    x = np.floor(256 * np.array([v for _, v in kept], dtype=float))
    u = np.unique(x, axis=0)
    n = len(u)
    cov = (u - u.mean(0)).T @ (u - u.mean(0)) / n
    e, z = np.linalg.eigh(cov)
    e, z = e[::-1][:most], z[:, ::-1][:, :most]
    p = out.toPandas()
    assert len(p) == most * len(kept) and set(p.n) == {n} and (p.identity_error <= 1e-10).all()
    for k in range(most):
        rows = p[p.component == k + 1]
        assert np.allclose(rows.explained, e[k] / np.trace(cov), rtol=1e-10)
        exact = sorted(zip((str(i) for i, _ in kept), [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, u.sum(0), strict=True)) for row in x], strict=True))
        assert sorted(zip(rows.vec_id.map(lambda v: str(None if v != v else int(v))), map(int, rows.deviation_text), strict=True)) == exact
        assert all(int(t) == d for d, t in zip(rows.deviation, rows.deviation_text, strict=True) if d == d)
        ours, theirs = np.sort(rows.whitened.to_numpy()), (x - u.mean(0)) @ z[:, k] / np.sqrt(e[k])
        assert min(np.abs(ours - np.sort(theirs)).max(), np.abs(ours - np.sort(-theirs)).max()) < 1e-9


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)) * np.arange(1, 13)
    rows = [(i, x[i].tolist()) for i in range(300)] + [(7, x[7].tolist()), (None, x[3].tolist()), (301, x[3].tolist())]
    bad = [(400, None), (401, [1.0] * 11 + [None]), (402, [1.0] * 11 + [float("nan")]), (403, [float("inf")] + [0.0] * 11), (404, []), (405, [1.0, 2.0])]
    d = spark.createDataFrame([(i, v, "clash") for i, v in rows + bad], "vec_id bigint, embedding array<double>, component string").repartition(9)
    check_whitening(whitening.whiten(d), rows)


def test_whitening_of_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(queries.op13_whitening(spark, sf), rows)


def test_whitening_of_few_and_equal_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one distinct vector: nothing varies
    line = whitening.whiten(frame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).toPandas()
    assert set(line.component) == {1} and np.allclose(line.explained, 1) and np.allclose(np.abs(line.whitened), np.abs((np.arange(5) - 2) / np.sqrt(2)))
    far = whitening.whiten(frame([(i, [float(i) * 1e12, 1e12]) for i in range(3)])).toPandas()
    assert far.deviation.isna().sum() == 2 and set(far.deviation_text) == {"0", str((3 * 256 * 10**12) ** 2)}
