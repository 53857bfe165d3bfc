"""The co-trained classifier's held-out accuracy, and the pipeline stage by stage."""

from collections import Counter

import corpus_pipeline
import numpy as np
import odd
import pyarrow as pa
import pytest
import public_tokenizers
from conftest import SMALL
from pyspark.sql import functions as F
from test_search_and_sets import components
from test_tokens import check_packing
from tokenizers import Tokenizer

from millrace.llm import common, mixing, quality, queries


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = (F.xxhash64("doc_id") % 5) == 0
    good_share = None
    for rounds in (0, 3):
        model = quality.fit(docs, labels.where(~held), rounds=rounds)
        got = quality.score(docs, model).join(labels.where(held), "doc_id").toPandas()
        share = max(got.quality.mean(), 1 - got.quality.mean())
        accuracy = (got.keep == (got.quality == 1)).mean()
        order = np.argsort(got.score.to_numpy())
        ranks = np.empty(len(got))
        ranks[order] = np.arange(1, len(got) + 1)
        good = (got.quality == 1).to_numpy()
        auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
        print(f"rounds {rounds}: accuracy {accuracy:.4f}, majority {share:.3f}, area {auc:.4f}, rows {len(got)}")
        assert accuracy > share + 0.05 and auc > 0.8
        good_share = good_share or accuracy
        assert accuracy > good_share - 0.005  # pseudo-labels don't spoil what labels teach


def test_views_teach_each_other():
    gain = []
    for seed in range(10):
        rng = np.random.default_rng(seed)
        y = rng.integers(0, 2, 1200)
        text, meta = (np.column_stack([y + rng.normal(0, 0.4, 1200), rng.normal(0, 1, 1200)]) for _ in range(2))
        label = np.where(np.arange(1200) < 40, y, -1)
        alone, together = (quality.co_train(text, meta, label, rounds=r).score(text, meta)[2] for r in (0, 4))
        gain.append(((together >= 0.5) == y).mean() - ((alone >= 0.5) == y).mean())
    assert np.mean(gain) > 0


def co_trained_by_hand(rows, labels, rounds, each, sure):
    """The same exchange in one process, over all features at once."""
    import pyarrow as pa

    text = quality.text_features(pa.array([r["text"] for r in rows]))
    meta = quality.meta_features(*([r[c] for r in rows] for c in ("source", "lang", "n_chars")))
    views, at = {"text": text, "meta": meta}, {r["doc_id"]: i for i, r in enumerate(rows)}
    known = sorted(d for d in labels if d in at)
    held, fitted = known[::4], [d for i, d in enumerate(known) if i % 4]
    given = {v: ([at[d] for d in fitted], [labels[d] for d in fitted]) for v in views}
    share, used = (sum(labels[d] for d in known) + 1) / (len(known) + 2), set()
    many = {y: max(1, int(each * (share if y else 1 - share))) for y in (0, 1)}
    for round_no in range(rounds + 1):
        fits = {v: quality.Logistic.fit(x[given[v][0]], np.array(given[v][1], float)) for v, x in views.items()}
        fixes = [quality._calibrate(fits[v].log_odds(x[[at[d] for d in held]]), np.array([labels[d] for d in held])) for v, x in views.items()]
        model = quality.CoTrained(fits["text"], fits["meta"], *fixes, float(np.log(share / (1 - share))))
        if round_no == rounds:
            return model.score(text, meta), len(used)
        new = {}
        for v, p in enumerate(model.score(text, meta)[:2]):
            for y in (1, 0):
                for source in range(quality.SOURCES):
                    sure_of = [i for i, r in enumerate(rows) if r["doc_id"] not in labels and i not in used and meta[i, source] and (p[i] >= sure if y else p[i] <= 1 - sure)]
                    for i in sorted(sure_of, key=lambda i: (-abs(p[i] - 0.5), i))[: many[y]]:
                        new.setdefault(i, (v, y))
        used |= set(new)
        for to, v in enumerate(views):
            taught = [i for i in sorted(new, key=lambda i: rows[i]["doc_id"]) if new[i][0] != to]
            given[v] = (given[v][0] + taught, given[v][1] + [new[i][1] for i in taught])
        if not new:
            rounds = round_no + 1


def test_fit_equals_co_training_in_one_process(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        good = int(rng.random() < 0.6)
        words = rng.choice(["river", "stone", "cloud", "tree", "light", "road"] if good else ["spam", "buy"], 12 + 8 * good)
        # sources tell quality apart as well, so that either view can teach
        source = f"s{rng.integers(0, 3) + 3 * (good if rng.random() < 0.97 else 1 - good)}"
        rows.append((i, " ".join(words), "en", source, int(rng.integers(50, 300))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = {i: int("spam" not in r[1] and "buy" not in r[1]) for i, r in enumerate(rows[:240])}
    table = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    model = quality.fit(docs, table, rounds=2, each=6, sure=0.9)
    (a, b, both), taught = co_trained_by_hand([r.asDict() for r in docs.collect()], labels, 2, 6, 0.9)
    got = quality.score(docs, model).toPandas().sort_values("doc_id")
    assert taught > 20
    # ties among sure documents may be taken in another order, so the models differ a little
    assert np.abs(got.score.to_numpy() - both).max() < 0.1 and ((got.score.to_numpy() >= 0.5) == (both >= 0.5)).mean() > 0.995


def test_scores_of_odd_rows(spark):
    docs = odd.documents(spark)
    for labels in ([], [(1, 1)], [(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (99, 1)], [(i, i % 2) for i in range(1, 12)]):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = quality.score(docs, model).collect()
        assert len(got) == len(odd.ROWS) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1
        assert quality.score(odd.none(spark), model).collect() == []
        assert quality.kept(docs, model).columns == docs.columns


def test_query_scores_every_document(spark):
    assert queries.op9_quality(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def key(row):
    return tuple(row)


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    good = corpus_pipeline.good_quality(spark, docs, SMALL)
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    keep = {r["doc_id"] for r in quality.score(docs, model).where("keep").collect()}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == keep

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    one = corpus_pipeline.one_of_each(spark, docs, SMALL)
    want = Counter({d for d, n, c in components(rows, 5, 80) if d == c})
    assert one.columns == columns and Counter(r["doc_id"] for r in one.collect()) == want

    mixed = corpus_pipeline.mixed(spark, docs, SMALL)
    assert mixed.columns == columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.packed(spark, docs, SMALL).collect()
    used, least = check_packing(packed, {d: library.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows})
    assert used <= 1.01 * least + 1


@pytest.mark.parametrize("rows", [odd.ROWS, []])
def test_stages_stand_odd_rows(spark, rows):
    docs = odd.documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        got = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        assert got or not rows
    if rows:
        one = Counter(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, SMALL).collect())
        assert one == Counter([1, 3, 4, 5, 6, None, None, 7, 9, 10])


T = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def texts_left(spark, rows):
    docs = odd.documents(spark, [(i, t, "en", "a", len(t)) for i, t in rows])
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, SMALL).collect()), key=str)


def test_near_duplicates_go_by_row(spark):
    other = "quite another text, of the same id as a near copy"
    assert texts_left(spark, [(1, T), (2, T + " more"), (2, other)]) == [(1, T), (2, other)]
    assert texts_left(spark, [(1, T), (None, T), (None, other), (None, other)]) == [(1, T), (None, other)]


def test_mixing_repeats_each_row_as_often_as_it_is_taken(spark):
    rows = [(i % 40, f"{i % 3} " + "w " * (i % 50), "en", f"s{i % 4}", 1) for i in range(400)] + [(None, "no id of its own", "en", "s1", 1)] * 5
    docs = odd.documents(spark, rows)
    want = Counter()
    for r in mixing.mix(docs).select("doc_id", "source", "copies", "text_hash").collect():
        want[r["doc_id"], r["source"], r["text_hash"]] += r["copies"]
    got = Counter(tuple(r) for r in corpus_pipeline.mixed(spark, docs, SMALL).select("doc_id", "source", F.xxhash64("text")).collect())
    assert got == +want


@pytest.mark.parametrize("given, most", [(None, 6 << 20), ("100000000", 50 << 20)])
def test_stages_bound_batches_unless_the_session_does(spark, given, most):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, given) if given else spark.conf.unset(key)
        corpus_pipeline.good_quality(spark, odd.none(spark), SMALL)
        texts = spark.range(40).coalesce(1).selectExpr("repeat('word ', 200000) AS text")
        sizes = [r["n"] for r in texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()]
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    assert sum(sizes) >= 40_000_000 and max(sizes) <= most
    assert not given or len(sizes) == 1


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SMALL), f"by-hand-{name.replace(' ', '-')}")
    got = corpus_pipeline.run(spark, SMALL)
    rows = lambda df: Counter(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert rows(got) == rows(docs) and docs.count() > 0
    assert got.select("sequence_id").distinct().count() == docs.select("sequence_id").distinct().count()
