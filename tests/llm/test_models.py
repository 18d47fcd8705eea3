"""Parts of the trained operators against plain loops: ratios, hinge loss, path lengths, thresholds; decoding; names that clash."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from tallyforge.llm import bpe, chat, nbsvm, rules, simhash
from tallyforge.llm.tokens import default_path


def test_class_counts_and_ratios(spark):
    texts = [("good prose about things", 1), ("good prose", 1), ("### bad *** bad bad", 0), ("", 0), (None, 1), ("é bad bad bad bad", 0)] * 3
    counts, n = nbsvm.class_counts(spark.createDataFrame(texts, "text string, y int").repartition(4))
    want, flags = np.zeros((2, nbsvm.SIZE)), np.zeros(nbsvm.SIZE, np.uint8)
    for t, y in texts:
        for k in nbsvm.indicators(t, flags):
            want[y, k] += 1
    assert (counts == want).all() and n.tolist() == [9, 9]
    ratio = nbsvm.log_ratios(counts)
    for k in np.flatnonzero(want.sum(0))[:50]:
        p, q = ((want[y, k] + 1) / (want[y].sum() + nbsvm.SIZE) for y in (1, 0))
        assert abs(ratio[k] - (np.log(p) - np.log(q))) < 1e-9


def test_descent_reaches_the_hinge_minimum():
    """Dual coordinate descent against a long projected-gradient run on the same dual."""
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(60, 8))
    y = np.sign(dense[:, 0] + 0.4 * rng.normal(size=60))
    w = nbsvm.descend([(np.arange(8), v) for v in dense], y, c=1.0, epochs=4000)
    x = np.c_[dense, np.ones(60)]
    q = (x * y[:, None]) @ (x * y[:, None]).T
    a = np.zeros(60)
    for _ in range(60000):
        a = np.clip(a - (q @ a - 1) / np.linalg.norm(q, 2), 0, 1)
    best = (x * y[:, None]).T @ a
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    assert loss(np.r_[w[:8], w[-1]]) <= loss(best) * 1.001


def test_labels_of_repeated_ids(spark):
    """Rows that repeat a labelled id are learned from once a text."""
    rows = [(i % 10, f"{'good words here' if i % 2 else '## bad $$'} {i % 10}") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, y int")
    model = nbsvm.fit(docs, labels, fit_rows=10)
    scores = model.scores(["good words here 1", "## bad $$ 2"])
    assert scores[0] > scores[1]


def path(tree, row, at=0, depth=0, rows=None):
    """Depth of a row's leaf by plain recursion."""
    if tree.feature[at] < 0:
        return tree.depth[at]
    return path(tree, row, int(tree.left[at] if row[tree.feature[at]] <= tree.cut[at] else tree.right[at]), depth + 1)


def test_path_lengths():
    rng = np.random.default_rng(3)
    rows = np.r_[rng.normal(size=(300, 4)), [[9, 9, 9, 9]]]
    trees = rules.forest(rows, trees=20)
    got = rules.anomaly(trees, rows)
    want = [2.0 ** -(np.mean([path(t, r) for t in trees]) / rules.mean_depth(rules.SUBSAMPLE)) for r in rows]
    assert np.allclose(got, want) and got.argmax() == 300
    # Leaves hold their depth and what their rows would still need.
    one = rules.grow(rows[:64], np.random.default_rng(0), 8)
    inner = [(int(a), 0) for a in [0]]
    while inner:
        at, depth = inner.pop()
        if one.feature[at] < 0:
            assert one.depth[at] >= depth
        else:
            inner += [(int(one.left[at]), depth + 1), (int(one.right[at]), depth + 1)]


def test_kept_follows_the_threshold(spark):
    """kept by a plain search over all cuts on the anomalies of labelled rows."""
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in rules.verdicts(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rated = [(int(out[i]["anomaly"] * rules.BINS), q) for i, q in labels.items() if i in out and not out[i]["base_failed"]]
    good, bad = [b for b, q in rated if q == 1], [b for b, q in rated if q == 0]
    gains = []
    for cut in range(rules.BINS + 1):
        lost, caught = sum(b >= cut for b in good) / len(good), sum(b >= cut for b in bad) / len(bad)
        gains.append(caught - lost if lost <= 0.001 else -1)
    best = [k for k, g in enumerate(gains) if g == max(gains)]
    most = (best[0] + best[-1]) / 2 / rules.BINS
    assert max(gains) > 0
    for r in out.values():
        assert r["kept"] == (not r["base_failed"] and r["anomaly"] < most)


def test_decoded_text_is_the_librarys(spark):
    library = Tokenizer.from_file(default_path())
    texts = ["plain words", "é 🙂 \n\n  two  blanks", "<|endoftext|> inside", "", None, " tab\tx", "a" * 3000, "ﬀ ① ½"]
    out = {r["doc_id"]: r for r in bpe.digests(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_clashing_names(spark):
    """Columns with the names that operators add stay as they are."""
    record = '{"prompt":"a","completion":"b"}'
    df = spark.createDataFrame([(record, "mine", 1, "p", [1], "s", "f"), (None, None, None, None, None, None, None)], "record string, layout string, r int, _print string, turns array<int>, segments string, formatted string")
    out = chat.formatted(chat.canonical(df), "turns_")
    assert out.columns == [*df.columns, "layout_", "turns_", "segments_", "formatted_"]
    got = sorted(out.collect(), key=lambda r: r["layout_"])
    assert [(r["layout"], r["layout_"], r["turns"], r["r"], r["segments"]) for r in got] == [("mine", "prompt", [1], 1, "s"), (None, "unknown", None, None, None)]
    assert got[0]["formatted_"] == "<s>[INST] a [/INST]</s><s>b</s>" and got[1]["formatted_"] is None
    d = spark.createDataFrame([(1, "some text", 7, 0.5)], "doc_id long, text string, fp int, score double")
    marked = simhash.with_fingerprint(d)
    assert marked.columns == [*d.columns, "fp_"] and marked.first()["fp"] == 7
    scored = nbsvm.with_score(d, nbsvm.Model(np.zeros(nbsvm.SIZE), np.ones(nbsvm.SIZE), 0.0, 1.0, 0.0))
    assert scored.columns == [*d.columns, "score_"] and scored.first()["score_"] == 0.5 == scored.first()["score"]
