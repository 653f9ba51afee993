"""The registered queries against brute force in plain Python, over whole tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import curriculum, packing, pii, queries, rules, simhash


def docs(spark, at):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]


def bag(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(params=["sf", "odd", "empty"])
def at(request):
    return request.getfixturevalue(request.param)


def fp_brute(text):
    import xxhash

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, within=3):
    distinct, root = sorted(set(fps)), {}
    for f in distinct:
        root[f] = f

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if (x ^ y).bit_count() <= within:
                root[find(x)] = find(y)
    return {f: find(f) for f in distinct}


def test_op1(spark, at):
    rows = docs(spark, at)
    fps = [fp_brute(t) for _, t in rows]
    root = groups(fps)
    least = {}
    for (d, _), f in zip(rows, fps, strict=True):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = Counter((d, f"{f:016x}", least.get(root[f])) for (d, _), f in zip(rows, fps, strict=True))
    assert bag(queries.op1_simhash(spark, at).collect()) == want


def test_simhash_dense_group_and_heavy_buckets(spark, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "HEAVY", 5)
    random.seed(3)
    fps = [random.getrandbits(64) for _ in range(300)]
    for _ in range(500):  # one large ball, and chains
        f = fps[0]
        for b in random.sample(range(64), random.randint(1, 4)):
            f ^= 1 << b
        fps.append(f)
    for k in range(200):
        fps.append(fps[1 + k] ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in set(fps)]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "_fp long")))
    got = defaultdict(set)
    for node, root in found.collect():
        got[root].add(node % (1 << 64))
    want = defaultdict(set)
    for f, r in groups(fps).items():
        want[r].add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_thresholds_meet_the_pigeonhole():
    import numpy as np

    sample = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    for n in (10**3, 10**6, 10**10):
        plan = simhash.plan_partitions(sample, n, 3)
        assert sum(t + 1 for _, t in plan) == 4
        assert len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


def test_op4(spark, at):
    import numpy as np
    from tokenizers import Tokenizer

    from marlstone.llm.tokens import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for d, t in docs(spark, at):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[d, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = queries.op4_packing(spark, at).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 2048
    sizes = np.array([r["length"] for r in rows], dtype=np.int64)
    assert not rows or len(bins) <= packing.best_fit(sizes, 2048)[1]


def test_packing_exchange_and_bounds(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 90, 3000)
    parts = spark.createDataFrame([(i, 0, 0, int(s), 0) for i, s in enumerate(sizes)], packing._TEXTUAL.replace("doc_id string", "doc_id long"))
    packed = packing.pack(parts, length=100, per_task=500)
    per = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sum(r[1] for r in per) == sizes.sum() and max(r[1] for r in per) <= 100
    bound = packing.lower_bound(sizes, 100)
    assert bound == packing.certificate(parts, 100)
    assert bound <= len(per) <= bound * 1.02 + 3
    assert packing.lower_bound(np.array([51, 51, 51, 10]), 100) == 3
    assert packing.lower_bound(np.array([34] * 7), 100) == 4
    for _ in range(50):
        s = rng.integers(1, 100, 12)
        assert packing.lower_bound(s, 100) <= packing.best_fit(s, 100)[1]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def meets(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_op6(spark, at):
    want = {}
    for d, t in docs(spark, at):
        found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if meets(k, m[0])]
        n = Counter(k for k, _, _ in found)
        want[d, t] = (*(n[k] for k in PATTERNS), ",".join(f"{k}:{s}:{e}" for k, s, e in found))
    texts = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    rows = queries.op6_pii(spark, at).collect()
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows)
    assert got == Counter((d, *want[d, t][:4], hashlib.sha256(want[d, t][4].encode()).hexdigest()) for d, t in map(tuple, texts.collect()))
    base = {(d, hashlib.sha256(w[4].encode()).hexdigest()): set(filter(None, w[4].split(","))) for (d, _), w in want.items()}
    for r in rows:
        spans = r["spans"].split(",") if r["spans"] else []
        assert base[r["doc_id"], r["base_sha256"]] <= set(spans)
        assert spans == sorted(spans, key=lambda s: (list(PATTERNS).index(s.split(":")[0]), int(s.split(":")[1])))


def test_pii_extra_spans_and_redaction(spark):
    rows = [
        (1, "please call (212) 555-1234 today"), (2, "order no. 212-555-1234 shipped"), (3, "x a@b.co y +1 (732) 555-3520 z 4111111111111111"),
        (4, None), (5, "nothing here 12 3.5"), (6, "tel. 212.555.9876 and me (at) mail.com"), (7, "😀 a@b.co 😀"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(map(tuple, pii.redact(df).collect()))
    assert out[1] == "please call [PHONE] today"
    assert out[2] == rows[1][1] and out[4] is None and out[5] == rows[4][1]
    assert out[3] == "x [EMAIL] y [PHONE] z [CARD]"
    assert out[6] == "tel. [PHONE] and [EMAIL]"
    assert out[7] == "😀 [EMAIL] 😀"


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_op7(spark, at):
    want = Counter()
    for d, t in docs(spark, at):
        m = brute_measures(t)
        want[d, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]] += 1
    rows = queries.op7_rules(spark, at).collect()
    assert Counter(tuple(r)[:7] for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_rule_ledger_ablation(spark, sf):
    judged = rules.ledger(spark.read.parquet(f"{sf}/documents.parquet"), "ledger").cache()
    masks = [r[0] for r in judged.select("ledger.failed").collect()]
    for policy in rules.POLICIES:
        m = rules.mask(policy)
        got = {r["rule"]: (r["failing"], r["only"]) for r in rules.ablation(judged, "ledger", policy).collect()}
        assert got == {r: (sum(bool(x & rules.BITS[r]) for x in masks), sum(x & m == rules.BITS[r] for x in masks)) for r in rules.POLICIES[policy]}
        assert rules.keep(spark.read.parquet(f"{sf}/documents.parquet"), policy).count() == sum(not x & m for x in masks)
    assert rules.repeated_words("a b c a b c d".split()) == 6


def test_op10(spark, at):
    rows = spark.read.parquet(f"{at}/documents.parquet").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for r in rows:
        total[r["source"]] += size(r["text"])
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * total[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    got = queries.op10_curriculum(spark, at).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], size(r["text"])) for r in rows)
    taken, sizes = defaultdict(int), defaultdict(int)
    by_size = {(r["doc_id"], size(r["text"])): r["source"] for r in rows}
    for r in got:
        s = by_size[r["doc_id"], r["size"]]
        assert r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        sizes[s] = max(sizes[s], r["size"])
    for s in taken:
        assert abs(taken[s] - target[s]) <= sizes[s] / 2 + 1e-6
    stream = curriculum.mix(spark.read.parquet(f"{at}/documents.parquet"), "_position").collect()
    assert len(stream) == sum(r["copies"] for r in got)
    assert [r["_position"] for r in stream] == sorted(r["_position"] for r in stream)
    assert all(0 <= r["_position"] <= 1 for r in stream)
    assert all(r["copies"] <= 3 for r in got)


def test_encoder_is_exact(spark, sf, odd):
    import numpy as np
    from tokenizers import Tokenizer

    from marlstone.llm.tokens import Encoder, default_tokenizer

    texts = [t for a in (sf, odd) for _, t in docs(spark, a)] + ["Σ ΑΣ ΑΣ\nΑΣ á e ́x", "\x1c\x1d \x85a　b", "'s't 're"]
    tok = Tokenizer.from_file(default_tokenizer())
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert Encoder(default_tokenizer()).encode(texts) == want


def test_pii_many_spans_and_clashing_columns(spark):
    """Thousands of spans in one text, and columns named like the operator's own."""
    import time

    many = " ".join(f"é{i} a{i}@b.co +1 (732) 555-{i % 10000:04d}" for i in range(12_000))
    df = spark.createDataFrame([(1, many, 7, "x"), (2, None, 8, "y")], "doc_id long, text string, _body int, _spans string")
    model = pii.train(df)
    began = time.time()
    out = {r["doc_id"]: r for r in pii.redact(df, model=model).collect()}
    assert out[1]["text"] == " ".join(f"é{i} [EMAIL] [PHONE]" for i in range(12_000)) and out[2]["text"] is None
    assert (out[1]["_body"], out[2]["_spans"]) == (7, "y") and time.time() - began < 20


def test_pii_is_fitted_to_real_candidates(spark):
    """Candidates mined from documents teach what their checks tell: held-out ones are told apart."""
    _, least, report = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert report["candidates"] > 100 and report["precision"] >= 0.95 and least < float("inf"), report


def test_clashing_columns_and_one_very_long_text(spark):
    """Columns named like the operators' own come back untouched; a line of megabytes passes every document operator."""
    from marlstone.llm import quality_model, similar

    long = " ".join(f"word{i % 5000}" for i in range(400_000))
    rows = [(i, t, "s", f"keep {i}") for i, t in enumerate([long, long + " tail", "short one", None])]
    mine = ["_name", "_hash", "_size", "_text", "_ledger", "_mix", "_row", "_mark", "_copy", "_at", "_src"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    for c in mine:
        df = df.withColumn(c, F.col("note"))
    model = pii.train(df)
    for out in (rules.keep(df, "corpus"), similar.drop_near_duplicates(df), pii.redact(df, model=model), curriculum.mix(df)):
        got = out.collect()
        assert out.columns == df.columns and got and all(r[c] == f"keep {r['doc_id']}" for r in got for c in mine)
    assert [r["doc_id"] for r in similar.drop_near_duplicates(df).orderBy("doc_id").collect()] == [0, 2, 3]
    assert packing.pack(packing.pieces(df)).agg(F.sum("length")).first()[0] > 800_000
    assert simhash.near_duplicates(df).count() == 4
    forest = quality_model.train(df.union(df), spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int"))
    assert quality_model.score(df, forest).count() == 4
