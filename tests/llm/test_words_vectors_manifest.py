"""Spelling variants, exact top-k and the Merkle manifest against brute force and SQL, on given and awkward tables."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import product

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import merkle, queries, spelling, topk


@pytest.fixture(params=["sf", "odd", "empty"])
def at(request):
    return request.getfixturevalue(request.param)


def whole(spark, at):
    """The documents of a folder, with the columns that awkward ones lack."""
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, kind in (("lang", "string"), ("n_chars", "long")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    return docs


def by_sql(tables, sql):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    found = con.sql(sql)
    return found.columns, Counter(found.fetchall())


def one_edit(word, letters):
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]
        for c in letters:
            yield word[:i] + c + word[i + 1 :]
            yield word[:i] + c + word[i:]
    for c in letters:
        yield word + c


def brute_variants(rows, damage):
    n = Counter()
    for r in rows:
        for run in spelling.RUN.findall(r["text"] or ""):
            run = run.translate(spelling.LOWER)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if damage and h % damage == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    letters = {c for w in n for c in w}
    near = {w: ({x for x in one_edit(w, letters) if x in n} if len(w) < 100 else {x for x in n if x != w and len(x) > 90}) - {w} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = Counter()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None] += 1
    return out


@pytest.mark.parametrize("damage", [None, 7, 199])
def test_variants(spark, at, damage):
    docs = whole(spark, at)
    assert Counter(map(tuple, spelling.variants(docs, damage).collect())) == brute_variants(docs.collect(), damage)


def test_variants_of_awkward_words(spark):
    """Chains of forms, equal counts, repeated bigrams, accents, capitals, very long runs, repeated rows and clashing columns."""
    long = "ab" * 3000
    counts = {"colours": 625, "colour": 125, "colur": 99, "colourz": 25, "kolourz": 5, "bananas": 30, "banana": 30, "bananan": 6, "ananas": 6, "aaaaaa": 50, "aaaaaaa": 10, "écoles": 40, "ecoles": 8, "ÉCOLES": 7, "abcdef": 9, "abcdeg": 9, long: 6, long[1:]: 5, long[:-1] + "c": 30}
    rows = [(k % 3 if k % 4 else None, " ".join([w] * n), "x", 1, "y") for k, (w, n) in enumerate(counts.items())] + [(7, None, None, None, None)] * 3 + [(1, "Bananas BANANAS", "x", 0, "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, n int, Word string")
    want = brute_variants([{"doc_id": r[0], "text": r[1]} for r in rows], 5)
    # The long runs' neighbours, which the brute force of edits doesn't reach: all three differ by one letter or by two.
    got = Counter(map(tuple, spelling.variants(docs, 5).collect()))
    short = lambda c: Counter({k: v for k, v in c.items() if len(k[0]) < 100})
    assert short(got) == short(want)
    plain = {k[0]: k for k in spelling.variants(docs).collect()}
    assert plain["kolourz"]["root"] == "colours" and plain["kolourz"]["form"] == "colourz" and plain["colour"]["form"] == "colours"
    assert plain["ecoles"]["form"] == "écoles" and plain["ecoles"]["n_near"] == 2 and plain["Écoles".replace("É", "É").translate(spelling.LOWER)]["n"] == 7
    assert plain[long[1:]]["form"] is None and plain[long]["form"] == long[:-1] + "c" and plain[long]["n_near"] == 2


@given(st.integers(0, 2**32), st.integers(3, 12))
@settings(max_examples=60, deadline=None)
def test_cheapest_pair(seed, width):
    rng = np.random.default_rng(seed)
    cost = rng.integers(0, 9, (5, width))
    cost[rng.random(cost.shape) < 0.4] = 1000
    left, right = spelling.cheapest_pair(cost, 1000)
    for row, i, j in zip(cost, left, right, strict=True):
        best = min(row[a] + row[b] for a, b in product(range(width), repeat=2) if b >= a + 2)
        assert j >= i + 2 and row[i] + row[j] == best


@pytest.mark.parametrize("alphabet", ["ab", "abcé"])
def test_pairs_of_a_small_alphabet(spark, alphabet):
    """Few letters: every gram is frequent and repeated, prefixes tie."""
    rng = np.random.default_rng(len(alphabet))
    words = sorted({"".join(rng.choice(list(alphabet), size=int(k))) for k in rng.integers(6, 11, 150)})
    counted = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long").repartition(5)
    want = {(w, x, 5 + words.index(x)) for w in words for x in one_edit(w, alphabet) if x in words and x != w}
    got = spelling.near_pairs(counted).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)


def brute_top(rows, asks, k):
    able = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    out = Counter()
    for i, (key, vector) in able:
        if not asks(key):
            continue
        score = lambda v: min(max(sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(vector, v, strict=True)), -topk.LIMIT), topk.LIMIT)  # noqa: E731, B023
        found = sorted(((-score(v), other is None, other or 0) for j, (other, v) in able if j != i and len(v) == len(vector)))[:k]
        for rank, (s, null, other) in enumerate(found):
            out[key, rank + 1, None if null else other, -s] += 1
    return out


def test_top_k_of_awkward_vectors(spark, monkeypatch):
    """Ties by the hundred, repeated and null keys, ids beyond 2^53, nulls, non-finite and huge components, several lengths, empty vectors, clashing columns."""
    rng = np.random.default_rng(3)
    rows = [(2**53 + 1 + i, [float(v) for v in rng.normal(size=3)]) for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.0]) for i in range(300)] + [(None, [0.5, 0.5, 0.0])] * 3 + [(8, [1.0, -1.0, 2.0])] * 3
    rows += [(4, None), (8, [None, 1.0, 1.0]), (12, [float("nan"), 1.0, 1.0]), (16, [float("inf"), 1.0, 1.0]), (20, []), (21, []), (24, [1.0]), (28, [1e300, 1e300, -1e300]), (29, [-1e9, 1e9, 1e9]), (32, [1.0, 2.0]), (33, [-1.0, 2.0])]
    asks = lambda key: key is not None and key % 4 == 0
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<double>, _mid int, Rank string").repartition(5)
    got = Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 4 == 0, 5).collect()))
    assert got == brute_top(rows, asks, 5)
    assert topk.top_k(df.where("vec_id = 3"), F.col("vec_id") % 4 == 0, 5).count() == 0
    assert topk.top_k(df.where("false"), F.col("vec_id") % 4 == 0, 5).columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.top_k(df.where("vec_id = 24"), F.col("vec_id") % 4 == 0, 5).count() == 0


def test_top_k_in_many_blocks(spark):
    """More queries and candidates than one block has, on several partitions."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.integers(-3, 4, (5000, 4)) / 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    x = np.floor(np.array([v for _, v in rows]) * 256).astype(np.int64)
    score = x[::3] @ x.T
    score[np.arange(len(score)), np.arange(0, 5000, 3)] = -(10**12)
    best = np.argsort(-score, axis=1, kind="stable")[:, :4]
    want = {(3 * q, r + 1, int(j), int(score[q, j])) for q in range(len(score)) for r, j in enumerate(best[q])}
    got = topk.top_k(df, F.col("vec_id") % 3 == 0, 4).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_products_of_any_size():
    q, c = np.array([[1e30, -1.0], [3.0, 2.0]]), np.array([[2.0, 5.0], [2.0**60, 1.0]])
    assert topk.products(q, c).tolist() == [[topk.LIMIT, topk.LIMIT], [16, topk.LIMIT]]
    assert topk.products(np.array([[2.0**26, 1.0]]), np.array([[2.0**25, 7.0]])).tolist() == [[2**51 + 7]]


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for r in rows:
        leaf = lambda text: hashed(*[field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")], field(text))  # noqa: E731, B023
        tampered = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r["text"]), leaf(r["text"].replace("\n", "") if tampered else r["text"])))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([hashed(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for _, _, leaf, _ in sorted(by[s])]) for s in sources}
    top, out = tree([trees[s][-1][0] for s in sources]), Counter()
    for place, s in enumerate(sources):
        for i, (known, doc_id, leaf, value) in enumerate(sorted(by[s])):
            siblings = []
            for levels, at in ((trees[s], i), (top, place)):
                for nodes in levels[:-1]:
                    run, slot = nodes[at // 3 * 3 : at // 3 * 3 + 3], at % 3
                    siblings += run[:slot] + run[slot + 1 :]
                    value = hashed(*run[:slot], value, *run[slot + 1 :])
                    at //= 3
            out[doc_id if known else None, leaf, trees[s][-1][0], top[-1][0], hashed(*siblings), value, value == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest(spark, at, levels):
    """Groups of 3, 9 and more leaves: several tiers of groups within a source and above the sources."""
    docs = whole(spark, at)
    if at.endswith("sf0.001"):
        docs = docs.withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.concat("source", (F.col("doc_id") % 9).cast("string"))).otherwise(F.when(F.col("doc_id") % 8 == 0, F.lit("ä"))))
        docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + F.lit(2**53).cast("long")))
    held = merkle.manifest(docs, merkle.without_newlines(), levels)
    want = brute_manifest(docs.collect())
    assert Counter(map(tuple, held.fold().collect())) == want
    assert held.root() == next((k[3] for k in want), None)
    sources = {r["source"]: r["subroot"] for r in held.subroots().collect()}
    assert set(sources) == {r["source"] for r in docs.select("source").distinct().collect()} and set(sources.values()) == {k[2] for k in want}


def test_manifest_of_itself_is_verified(spark, sf):
    rows = merkle.manifest(spark.read.parquet(f"{sf}/documents.parquet").withColumn("_hash", F.lit(1)).withColumn("Root", F.lit(2))).fold()
    assert rows.where("NOT verified").count() == 0 and rows.count() == 200


@given(st.lists(st.binary(min_size=1, max_size=5), min_size=1, max_size=3), st.binary(max_size=4))
@settings(max_examples=40, deadline=None)
def test_parent_folds_from_its_slot(children, other):
    parent = merkle.Parent(children)
    for slot in range(len(children)):
        assert parent.fold(slot, other).decode() == sha256(b"".join([*children[:slot], other, *children[slot + 1 :]])).hexdigest()
    assert parent.digest.decode() == sha256(b"".join(children)).hexdigest()


@pytest.mark.parametrize("name", ["op11_spelling", "op12_topk", "op13_merkle"])
def test_query_matches_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "embeddings")}
    columns, want = by_sql(tables, queries.SQL[name])
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want and sorted(columns) == sorted(df.columns)
