"""Exact dedup, mixing and chat formatting: plain versions and odd inputs."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tidewire.llm import chat, exact_dedup, mixing

DOC = "doc_id bigint, text string, source string, slice string, keep_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], DOC)


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]+", "", t or "")


def test_exact_dedup_matches_plain_groups(spark):
    rows = [(5, "a b", "s"), (3, "ab", "s"), (9, "a  b", "s"), (4, None, "s"), (6, " \t", "s"), (7, "Ab", None), (8, "x" * 50_000, "s"), (2, "x" * 50_000, "s"), (1, "a b", "s"), (3, "ab", "s")]
    rows += [(100 + i, "hot text", "s") for i in range(200)]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append((-len(t or ""), i))
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        g = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(g)[1], len(g))
    for sha, g in by_sha.items():
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
        assert [r.doc_id for r in got if r.kept and r.text_sha256 == sha] == [min(g)[1]]


def test_exact_dedup_null_ids_and_nothing(spark):
    got = exact_dedup.exact_dedup(docs(spark, [(None, "a", "s"), (None, "a", "s"), (7, "a", "s"), (None, "b", "s")])).collect()
    assert sorted((r.keep_id is None, r.kept) for r in got) == [(False, False), (False, False), (False, True), (True, True)]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_every_copy_is_merged_by_comparing_neighbours(spark, monkeypatch):
    """With and without slices: rows that don't lead are the copies, all of them; hashes only deal rows out."""
    rows = [(i, f"text {i % 120} {'x' * (i % 120)}", "s") for i in range(600)] + [(1000 + i, "hot  text" if i % 3 else "hot text", "s") for i in range(300)]
    d = docs(spark, rows)
    for most in (1024, 4):
        monkeypatch.setattr(exact_dedup, "HOT", most)
        monkeypatch.setattr(exact_dedup, "SLICES", 7)
        got = exact_dedup.exact_dedup(d)
        assert sum(not r.kept for r in got.collect()) == 900 - 121
        hot = [r for r in got.collect() if r.doc_id >= 1000]
        assert {(r.keep_id, r.group_size) for r in hot} == {(1001, 300)} and [r.doc_id for r in hot if r.kept] == [1001]
        assert sorted(r.doc_id for r in exact_dedup.drop_copies(d).collect()) == [*range(120), 1001]
        # other texts under one hash stay apart
        monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c, f=F.xxhash64: F.lit(7).cast("bigint") if c == ("norm",) else f(*c))
        assert sum(r.kept for r in exact_dedup.exact_dedup(d).collect()) == 121 == exact_dedup.drop_copies(d).count()
        monkeypatch.undo()


def test_drop_copies_keeps_columns_and_one_row(spark):
    d = docs(spark, [(1, "a", "s"), (1, "a", "s"), (2, "a ", None), (3, None, "s"), (4, "", "s")])
    out = exact_dedup.drop_copies(d)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]
    odd = spark.createDataFrame([(1, "a b", 5, 6), (1, "a  b", 7, 8), (1, "a  b", 7, 8)], "doc_id bigint, text string, __own int, norm int")
    assert [tuple(r) for r in exact_dedup.drop_copies(odd).collect()] == [(1, "a  b", 7, 8)]
    assert exact_dedup.drop_copies(odd.limit(0)).columns == odd.columns


def plain_targets(sizes, cap=3.0, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, target, free = float(sum(sizes.values())), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * w[s] for s in free}
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


def test_mixing_targets_and_taken(spark):
    rows = [(i, "w " * (1 + i % 17), f"s{i % 3}") for i in range(900)] + [(2000 + i, "v " * 9, "tiny") for i in range(3)] + [(3000 + i, "u u", None) for i in range(40)] + [(4000, None, "s1"), (4001, " ", "s1"), (5, "w " * 6, "s2")]
    d = docs(spark, rows)
    got = mixing.mix_sources(d).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        base = want[r.source] / sizes[r.source]
        assert r.size == 0 or int(base) <= r.copies <= int(base) + 1 or abs(base - round(base)) < 1e-9
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) < 18
    again = mixing.mix_sources(d.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def test_mixing_misses_by_a_short_document(spark):
    """Large documents are settled first: the last open one is short, whatever the largest is."""
    rng = __import__("random").Random(3)
    rows = [(i, "w " * int(5 + 4000 * rng.random() ** 8), f"s{i % 3}") for i in range(3000)]
    per = defaultdict(lambda: [0.0, 0])
    for r in mixing.mix_sources(docs(spark, rows)).collect():
        per[r.source][0], per[r.source][1] = r.target, per[r.source][1] + r.taken
    assert all(abs(t - n) < 400 for t, n in per.values())


def test_repeat_by_mix_takes_what_the_mix_says(spark):
    """Also for repeated rows, which share their copies, and with any names of columns."""
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(300)] * 2 + [(7, "q " * 8, "b"), (None, "n n", "a"), (None, "n n", "a"), (400, None, "a"), (401, " ", None)]
    d = docs(spark, rows).selectExpr("doc_id", "text", "source", "1 AS __own", "2 AS copies", "3 AS row", "4 AS `a.b`")
    mix = mixing.mix_sources(d).collect()
    want = defaultdict(int)
    for r in mix:
        want[r.doc_id, r.source, r.size] += r.copies
    out = mixing.repeat_by_mix(d)
    assert out.columns == d.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.source, len((r.text or "").split())] += 1
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert mixing.repeat_by_mix(d.limit(0)).count() == 0


def test_mixing_draws_are_fair(spark):
    """Over seeds, the mean number of a document's copies is its source's rate, and each source's words its target."""
    d = docs(spark, [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(60)])
    total, copies, target, size, n = defaultdict(int), defaultdict(int), {}, {}, 40
    for seed in range(n):
        for r in mixing.mix_sources(d, seed=seed).collect():
            total[r.source] += r.copies * r.size
            copies[r.source, r.doc_id] += r.copies
            target[r.source], size[r.source] = r.target, r.source_size
    for s, t in target.items():
        assert abs(total[s] / n - t) < 3
        rates = [c / n for (of, _), c in copies.items() if of == s]
        assert all(abs(x - t / size[s]) < 4 * 0.5 / n**0.5 for x in rates)


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "[\\INST]", "a[SEP]b\\", "<s", "", None, "é" * 3000, "\\\\[SEP]\\", "[/INST]</s><s>user[INST]"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(odd)]
    rows += [(2, 0, "assistant", "x"), (2, 1, "assistant", "y"), (2, 2, None, "z"), (2, 2, "[INST]", "z"), (None, 0, "user", "q"), (3, None, "system", "s"), (3, 0, "assistant", None)]
    d = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, t int, at string")
    parsed = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(d)).collect()}
    want = defaultdict(list)
    for c, turn, role, text in rows:
        want[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in parsed[c].turns] == [t[2:] for t in turns]
        assert parsed[c].loss_text == "".join(t[3] for t in turns if t[2] == "assistant")
    assert parsed[2].formatted.startswith("<s>assistant[/INST]x[SEP]y</s>")
    assert chat.format_chats(d.limit(0)).count() == 0


def test_chat_digest(spark):
    d = spark.createDataFrame([(7, 0, "user", "hi"), (7, 1, "assistant", "yo")], "conv_id bigint, turn bigint, role string, text string")
    r = chat.digest(chat.parse_chats(chat.format_chats(d))).first()
    assert r.turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, 2, hashlib.sha256(b"yo").hexdigest())


def test_native_plans_run_no_python(spark, sf):
    from tidewire.llm import queries

    for name in ("op4_chat_formatting", "op7_mixing", "op8_exact_dedup"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
