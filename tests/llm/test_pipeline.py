"""The pipeline's stages keep their contract and their decisions take effect."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from test_join import brute

from tidewire.llm import langid, mixing, packing
from tidewire.llm._shared import _kept, work_table


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES[:-1]:
        before = docs.count()
        docs = work_table(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(now) <= ids and (name == "mixing" or len(now) == len(set(now)) <= before)
        ids = set(now)
    pieces = cp.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == ids


def test_stages_on_odd_rows(spark, sf):
    rng = random.Random(5)
    text = " ".join("the of and house garden under river old grey".split()[rng.randrange(9)] + "s" * rng.randrange(3) for _ in range(80))
    rows = [(i, f"{text} number {i} of many words here", "en", None if i % 3 else "a", 1, "x") for i in range(12)]
    rows += [(50, None, None, None, None, None), (51, "", "en", "a", 0, "x"), (None, "the old house and the river", "en", "a", 1, "x"), (3, rows[3][1], "en", "a", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, copies string")
    for part in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            part = work_table(stage(spark, part, sf), "odd")
        assert "sequence_id" in part.columns


def corpus(spark):
    """Three languages, exact and near copies, noise, and names that clash."""
    rng = random.Random(9)
    words = {"en": "the of and house garden under river old grey stone", "de": "der die und haus garten unter fluss alt grau stein", "fr": "le la et maison jardin sous rivière vieux gris pierre"}
    rows = []
    for i in range(270):
        lang = "en de fr".split()[i % 3]
        w = words[lang].split()
        rows.append((i, " ".join(rng.choice(w) + rng.choice(("", "s", "en")) for _ in range(60)), lang, f"s{i % 4}", i))
    rows += [(1000 + i, rows[i][1].replace(" ", "  ", i % 3), rows[i][2], "s1", i) for i in range(0, 60, 2)]
    rows += [(2000 + i, rows[i][1] + " stone", rows[i][2], None, i) for i in range(1, 60, 2)]
    rows += [(3000, None, "en", "s0", 0), (3001, "", "en", "s0", 0), (3002, "12 %%", None, "s0", 0), (3003, "zxq vvk qpw " * 30, None, "s0", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_run_matches_plain_stages(spark, tmp_path):
    """Each decision by a plain version on the rows before it; run() returns what they lead to."""
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.train(docs)
    texts = {i: r.text or "" for i, r in rows.items()}
    grams = {i: langid.presence(t) for i, t in texts.items() if any(map(str.isalpha, t))}
    known = dict(zip(grams, model.familiar(list(grams.values()), model.scores(list(grams.values()))), strict=True))
    kept = {i for i in rows if known.get(i)}
    assert 3003 not in kept and len(kept) >= 320
    groups = defaultdict(list)
    for i in kept:
        groups[re.sub(r"[\x20\x09-\x0d]+", "", texts[i])].append((-len(texts[i]), i))
    kept = {min(g)[1] for g in groups.values()}
    near = brute([(i, texts[i]) for i in sorted(kept)])
    kept = {i for i, (_, least) in near.items() if least == i}
    mix = mixing.mix_sources(docs.where(docs.doc_id.isin(*kept)))
    copies = Counter({r.doc_id: r.copies for r in mix.collect() if r.copies})
    ids = {i: [*packing._tokenizer(__import__("public_tokenizers").path("byte_bpe_50k.json")).encode(texts[i], add_special_tokens=False).ids, 0] for i in copies}
    got = cp.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == copies
    for r in got:
        assert bytes(r.ids) == packing.np.array(ids[r.doc_id], "<u4")[r.start : r.start + r.length].tobytes()
    left = [p for p in _kept[spark.sparkContext.applicationId] if "stage-" in p]
    assert len([p for p in left if "stage-packing" in p]) >= 1 and not [p for p in left if "stage-mixing" in p]


def test_run_on_no_rows(spark, tmp_path):
    corpus(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns(spark, sf):
    rows = corpus(spark).where("doc_id < 90 OR doc_id >= 3000").selectExpr("*", "1 AS __p", "2 AS __own", "3 AS __id", "4 AS __copies", "5 AS __n", "6 AS row", "7 AS judged")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, rows, sf)
        assert out.columns == rows.columns and {tuple(r)[5:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7)}
