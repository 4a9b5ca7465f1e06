import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import brown_classes as bc
from lodestar.llm import lm_scoring as lm


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")), ""]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def corpus():
    rng = np.random.default_rng(5)
    kinds = [[f"{side}{k}" for k in range(40)] for side in ("noun", "verb", "Über")]
    docs = []
    for i in range(240):
        words = [kinds[j % 3][min(39, int(rng.exponential(6)))] for j in range(int(rng.integers(0, 30)))]
        docs.append((i, " \n".join(words)))
    rare = [(300 + i, f"noun1 rare{i} Über0 {'rare' + str(i) if i % 2 else ''} never{i}") for i in range(30)]
    return [*docs, *rare, (None, None), (400, ""), (401, " \t"), (401, " \t"), (402, "q " * 3000), (419, " ".join(f"new{i}" for i in range(60)))]


def word_classes(rows, **options):
    texts = rows.select(F.coalesce("text", F.lit("")).alias("text"))
    n = Counter(w for r in rows.collect() for w in tokens(r.text))
    return lm.word_classes(texts, rows.sparkSession.createDataFrame(list(n.items()), "word string, n long"), **options)


def test_gain_of_an_exchange_is_the_likelihoods():
    rng = np.random.default_rng(1)
    words, k = 12, 5
    bigrams = rng.integers(0, 4, (words, words)).astype(float)
    classes = np.concatenate(([0], rng.integers(1, k, words - 1)))

    def pairs(of):
        out = np.zeros((k, k))
        np.add.at(out, (of[:, None], of[None, :]), bigrams)
        return out

    for w in range(1, words):
        rest = np.arange(words) != w
        after, before = np.bincount(classes[rest], bigrams[w, rest], k), np.bincount(classes[rest], bigrams[rest, w], k)
        without = pairs(classes)
        bc.moved(without, classes[w], after, before, bigrams[w, w], -1)
        gain = bc.gains(without, after, before, bigrams[w, w])
        for c in range(k):
            put = classes.copy()
            put[w] = c
            assert gain[c] - gain[classes[w]] == pytest.approx(bc.likelihood(pairs(put)) - bc.likelihood(pairs(classes)), abs=1e-9)
    own, other = np.nonzero(bigrams)
    rows = [np.concatenate(x) for x in ((own, other), (other, own), (np.ones(len(own), bool), np.zeros(len(own), bool)), (bigrams[own, other],) * 2)]
    put = bc.exchanged(pairs(classes), classes, np.arange(words), *rows)
    assert put[0] == 0 and bc.likelihood(pairs(put)) > bc.likelihood(pairs(classes))


def test_many_words_join_as_one_would():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 50, (6, 6)).astype(float)
    after, before = (rng.integers(0, 7, (40, 6)) * (rng.random((40, 6)) < 0.4) for _ in range(2))
    found = bc.Joiner(pairs).of(after.astype(float), before.astype(float))
    for a, b, k in zip(after, before, found, strict=True):
        gain = bc.gains(pairs, a.astype(float), b.astype(float), 0.0)
        assert k > 0 and gain[k] == pytest.approx(gain[1:].max())


def test_unknown_words_are_summed_over_all_classes():
    rng = np.random.default_rng(2)
    model = bc.ClassBigrams(rng.integers(0, 9, (4, 4)), np.array([10, 20, 0, 7]), np.array([1, 5, 0, 7]), 0.6)
    assert model.moves.sum(1) == pytest.approx(1)
    known = np.array([1.0, (20 - 5 * 0.6) / 20, 0, (7 - 7 * 0.6) / 7])
    assert known + model.unknown == pytest.approx(1)
    for length in (0, 1, 2, bc.RUN, bc.RUN + 1, bc.RUN + 30):
        classes = np.array([1, *[bc.UNSEEN] * length, 3, 0], np.uint8)
        reach = np.eye(4)[0] @ model.moves * np.eye(4)[1]
        for _ in range(length):
            reach = reach @ model.moves * model.unknown
        want = reach @ model.moves @ np.eye(4)[3] * model.moves[3, 0]
        assert model.path(classes) == pytest.approx(log10(want), rel=1e-12)


@pytest.mark.parametrize("n_exchanged", [20, 10_000])
def test_equal_to_scoring_token_by_token(spark, n_exchanged, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(lm, "TALLY", 50)
    monkeypatch.setattr(lm, "RUN_BYTES", 300)
    monkeypatch.setattr(lm, "ROW_WORDS", 7)
    docs = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    options = {"n_classes": 4, "n_exchanged": n_exchanged, "rounds": 6}
    got = lm.score_texts(rows, training, **options).collect()
    learned = [tokens(t) for i, t in docs if not held_out(i)]
    n = Counter(w for t in learned for w in t)
    total, kinds = sum(n.values()), len(n)
    others, frequent = word_classes(rows.where(training), **options)
    put = {w: k for w, (_, k) in frequent.items()} | {r["word"]: r["class"] for r in others.collect()}
    assert set(put) == set(n) and put[""] == 0 and all(1 <= k <= 4 for w, k in put.items() if w)
    assert {r["word"]: r["n"] for r in others.collect()} | {w: c for w, (c, _) in frequent.items()} == n
    pairs = np.zeros((5, 5))
    for t in learned:
        np.add.at(pairs, ([0, *[put[w] for w in t[:-1]]], [put[w] for w in t]), 1)
    sums, types = [np.bincount([put[w] for w in n], v, 5) for v in (list(n.values()), np.ones(len(n)))]
    once, twice = (sum(1 for w, c in n.items() if c == x and w) for x in (1, 2))
    model = bc.ClassBigrams(pairs, sums, types, bc.discount_of(once, twice))

    def score(words):
        reach, out = np.eye(5)[0], 0.0
        for w in words:
            reach = reach @ model.moves
            if w in put:
                k = put[w]
                reach = reach * np.eye(5)[k] * ((n[w] - (model.discount if k else 0)) / sums[k])
            else:
                reach = reach * model.unknown
            out += log10(reach.sum())
            reach = reach / reach.sum()
        return out

    want = {}
    for i, t in docs:
        words = tokens(t)
        base = sum(log10((n[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        want[i] = (not held_out(i), len(words), sum(n[w] > 0 for w in words), total, base, score(words))
    assert len(got) == len(docs) and {r.doc_id for r in got} == set(want)
    for r in got:
        exact, near = want[r.doc_id][:4], want[r.doc_id][4:]
        assert (r.training, r.n_tokens, r.n_known, r.train_tokens) == exact
        assert (r.base_score, r.score) == pytest.approx(near, rel=1e-9, abs=1e-9)


def test_classes_tell_kinds_of_words_apart_and_help(spark):
    docs = corpus()[:240]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    options = {"n_classes": 3, "n_exchanged": 10_000, "rounds": 10}
    _, frequent = word_classes(rows, **options)
    of = {}
    for w, (n, k) in frequent.items():
        if w and n >= 5:
            of.setdefault(w[:4].lower(), Counter())[k] += n
    assert all(max(c.values()) > 0.9 * sum(c.values()) for c in of.values())
    scores = lm.score_texts(rows, F.col("doc_id") % 10 > 0, **options).where("NOT training").agg(F.sum("score"), F.sum("base_score")).first()
    assert scores[0] > scores[1]


def test_without_training_texts_and_without_rows(spark):
    rows = spark.createDataFrame([(1, "a b", 1.0), (2, None, 2.0)], "doc_id long, text string, bucket double")
    got = {r.doc_id: r for r in lm.score_texts(rows, F.lit(False)).collect()}
    assert got[1].train_tokens == got[1].n_known == 0 and got[1].n_tokens == 3 and got[1].base_score == 0 and got[1].score < got[2].score < 0
    assert lm.op11_lm_scoring(rows).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert lm.op11_lm_scoring(rows.limit(0)).count() == 0
    ends = lm.score_texts(rows.where("doc_id = 2"), F.lit(True)).first()
    assert ends.train_tokens == ends.n_known == 1 and ends.base_score == pytest.approx(log10(1.1 / 1.2)) and ends.score < 0


def test_tokens_of_bytes_are_those_of_the_pattern():
    texts = ["", " ", "A b\tC", "\x1cÄ\u00a0B\u2003c \x0b\x0cÉA\x85", "x", "\n\ny\n"]
    found, sizes = lm._tokens([t.encode() for t in texts])
    want = [tokens(t) for t in texts]
    assert [w.decode() for w in found.to_pylist()] == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_words_move_in_packed_rows(spark):
    rng = np.random.default_rng(11)
    kinds = np.array(["".join(map(chr, rng.integers(97, 123, 8))) for _ in range(60_000)])
    docs = [(i, " ".join(rng.choice(kinds, 1000))) for i in range(100)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).localCheckpoint()
    context = spark.sparkContext._jsc.sc()

    def moved():
        """Rows that were shuffled or written so far."""
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(s.shuffleWriteRecords() + s.outputRecords() for s in (stages.apply(i) for i in range(stages.size())))

    before = moved()
    assert lm.score_texts(rows, F.col("doc_id") % 10 > 0, n_exchanged=500, rounds=1).count() == 100
    assert moved() - before < 100_000  # as many as tokens; words that moved one to a row, again and again, made several times that
