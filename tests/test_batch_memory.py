"""What a task of batch search holds, and that its limits change no result."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from marlstone.operators import postings
from marlstone.operators.shared import checkpoints


def test_a_task_holds_a_block_of_questions_and_asked_terms_alone(spark, monkeypatch):
    """More questions are more blocks, not larger ones; terms too many to broadcast still keep the other postings from being dealt."""
    checkpoints(spark)
    monkeypatch.setattr(postings, "POOL", 120)
    monkeypatch.setattr(postings, "BROADCAST", 0)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i + j * j) % 90}" for j in range(12))) for i in range(300)], "id long, t string").repartition(4)
    asked = spark.createDataFrame([(i, f"w{i % 40} w{i % 7}") for i in range(200)], "question long, text string")

    def held(batches, average, k):
        questions, strange = {}, 0
        for b in batches:
            for part, slice_, question, term in zip(*(b.column(c).to_pylist() for c in ("_part", "_slice", "question", "term")), strict=True):
                if question is not None:
                    questions[part, slice_] = questions.get((part, slice_), 0) + 1
                strange += term is not None and int(term[1:]) >= 40
        rows = [(1000 * p + s, n, 1.0 + strange) for (p, s), n in questions.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["question", "key", "score"])

    monkeypatch.setattr(postings, "_best", held)
    got = postings.search(postings.build(docs, "id", "t"), asked, 3).collect()
    assert max(r["key"] for r in got) <= 80 and max(r["score"] for r in got) == 1.0, got  # 200 questions of 3 documents are five blocks
    assert len({r["question"] // 1000 for r in got}) == 5


def test_limits_of_a_task_change_nothing(monkeypatch):
    """Ranges of copies, a null key and ties at the kth score, scored in small pieces, against all scores."""
    rng = np.random.default_rng(7)
    terms, keys = [f"t{i}" for i in range(12)], [None, *range(1, 60)]
    tf = rng.integers(0, 3, (60, 12))
    tf[20:40] = tf[:20]  # copies
    dl, k = tf.sum(axis=1), 4
    weights = np.where(rng.random((40, 12)) < 0.4, rng.random((40, 12)).round(1), 0)
    order, kinds = rng.permutation(60), {"question": pa.int64(), "terms": pa.list_(pa.string()), "weights": pa.list_(pa.float64()), "range": pa.int64(), "term": pa.string(), "keys": pa.list_(pa.int64()), "tfs": pa.list_(pa.int32()), "dls": pa.list_(pa.int32()), "bound": pa.float64()}
    rows = [{"question": q, "terms": [t for t, w in zip(terms, weights[q], strict=True) if w], "weights": [w for w in weights[q] if w]} for q in range(40)]
    for range_ in range(3):
        for i, term in enumerate(terms):
            of = [d for d in order[range_ * 20 : range_ * 20 + 20] if tf[d, i]]
            if of:
                rows.append({"range": range_, "term": term, "keys": [keys[d] for d in of], "tfs": tf[of, i].tolist(), "dls": dl[of].tolist(), "bound": float(postings.gain(tf[of, i], dl[of], 9.0).max())})
    whole = pa.Table.from_pydict({c: pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()})
    for c in ("_slice", "_part"):
        whole = whole.add_column(0, c, pa.array(np.zeros(len(rows), np.int32)))
    scores = np.round(weights @ np.where(tf > 0, postings.gain(tf, dl[:, None], 9.0), 0).T, 6)
    want = {(q, keys[d], round(scores[q, d], 6)) for q in range(40) for d in sorted(range(60), key=lambda d: (-scores[q, d], -1 if keys[d] is None else keys[d]))[:k] if scores[q, d] > 0}
    for name, value in {"CHUNK": 3, "PAIRS": 50, "POOL": 30}.items():
        monkeypatch.setattr(postings, name, value)
    for size in (7, 1000):
        got = [r for b in postings._best(iter(whole.to_batches(max_chunksize=size)), 9.0, k) for r in b.to_pylist()]
        assert len(got) == len(want) and {(r["question"], r["key"], round(r["score"], 6)) for r in got} == want


def test_a_range_of_long_documents_is_short(monkeypatch):
    """A task that writes ranges holds their postings, so these are bounded, not the documents alone."""
    monkeypatch.setattr(postings, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(postings, "POSTINGS", 50, raising=False)
    terms = [[f"t{i}" for i in range(20)]] * 30 + [[f"t{i}" for i in range(80)]]
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(31)), "dl": pa.array([len(t) for t in terms], pa.int32()), "terms": pa.array(terms), "tfs": pa.array([[1] * len(t) for t in terms], pa.list_(pa.int32())), "_like": pa.array([1] * 30 + [2], pa.int32())})
    got = [b for b in postings._inverted(iter([batch.slice(0, 7), batch.slice(7)]), 20.0)]
    assert sum(len(k) for b in got for k in b.column("keys").to_pylist()) == 30 * 20 + 80
    assert sorted({k for b in got for ks in b.column("keys").to_pylist() for k in ks}) == list(range(31))
    assert max(sum(len(k) for k in b.column("keys").to_pylist()) for b in got[:-1]) <= 50 + 20 and len({b.column("range")[0].as_py() for b in got}) == len(got)
