"""The masked model tells all words apart, not only frequent ones."""

import numpy as np

from millrace.llm import masked_lm


def test_rare_words_follow_from_their_neighbours(spark):
    # 300 pairs of words, each pair in texts of its own
    rows = [(i, f"left{i % 300} right{i % 300} " * 30) for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = masked_lm.score(d, masked_lm.train(d)).agg({"mean_log_prob": "avg"}).first()[0]
    assert got > -2.0, got  # words of shared classes, told apart by their shares alone: -2.48


def test_probabilities_of_all_buckets_add_up_to_one():
    r = np.random.default_rng(2)
    counts = np.floor(r.pareto(0.5, masked_lm.BUCKETS).clip(0, 1e6))
    voc = masked_lm.vocabulary(counts)
    t = masked_lm.Training(voc, 3)
    share = np.log((counts + 1) / (counts + 1).sum())
    ids = np.arange(masked_lm.BUCKETS, dtype=np.int32)
    flat = np.concatenate([masked_lm.log_probs(t.p, voc, masked_lm.stream([ids[lo : lo + 4096]]))[1] for lo in range(0, len(ids), 4096)])
    assert np.allclose(flat, share, atol=1e-3)  # the start gives each word its share
    t.learn([r.choice(ids, 4000, p=np.exp(share)).astype(np.int32)], 3)
    runs = np.full((len(ids), masked_lm.RUN + 2 * masked_lm.SIDE), masked_lm.EDGE, np.int32)
    runs[:, 2], runs[:, 3] = ids, 77  # each bucket beside the same word
    total = 0.0
    for lo in range(0, len(ids), 4096):
        at, lp = masked_lm.log_probs(t.p, voc, runs[lo : lo + 4096])
        total += np.exp(lp[at % masked_lm.RUN == 0]).sum()
    assert abs(total - 1) < 1e-4


def test_every_bucket_has_a_path_of_its_own():
    voc = masked_lm.vocabulary(np.arange(masked_lm.BUCKETS) % 7 * 100.0)
    codes = np.concatenate([voc.top, voc.rest]).T
    assert len(np.unique(codes, axis=0)) == masked_lm.BUCKETS
