"""Sharding, page extraction, shard files, embeddings and the classifier against brute force or round trips."""

import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import cross_polytope, kd_shards, page_diff, quality_model, queries, sstable
from marlstone.llm.gbt import fit


@pytest.fixture(params=["sf", "odd", "empty"])
def at(request):
    return request.getfixturevalue(request.param)


def test_op2(spark, at):
    docs = spark.read.parquet(f"{at}/documents.parquet")
    if "lang" not in docs.columns:
        docs = docs.selectExpr("*", "cast(null as string) lang")
    rows = kd_shards.shard(docs).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < 8
        by[r["shard"]].append(r)
    for s in by.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    if at.endswith("sf0.001"):
        sizes = [sum(r["size"] for r in s) for s in by.values()]
        assert len(sizes) == 8 and max(sizes) - min(sizes) <= 3 * max(r["size"] for r in rows)
        assert {r["shard"] for r in kd_shards.shard(docs, target_bytes=sum(sizes) // 3 + 1).collect()} == set(range(3))


def test_op2_tree_against_brute_medians(spark, sf):
    """Every cut of the tree, recomputed in plain Python: the widest dimension, and a place that halves the node's bytes as no other place could."""
    rows = kd_shards.coordinates(spark.read.parquet(f"{sf}/documents.parquet"))
    tree, placed = kd_shards.grow(rows, 5)
    held = [r.asDict() for r in placed.collect()]
    bits = kd_shards._BITS

    def check(node, own):
        assert {r["_leaf"] for r in own} <= set(range(node.first, node.first + node.leaves))
        if not node.children:
            return
        width = {d: (max(r[f"_{d}"] for r in own) >> bits) - (min(r[f"_{d}"] for r in own) >> bits) for d in kd_shards.DIMENSIONS}
        assert width[node.dim] == max(width.values())
        left, right = ([r for r in own if (r[f"_{node.dim}"] < node.at) == side] for side in (True, False))
        goal = sum(r["size"] for r in own) * (node.leaves // 2) / node.leaves
        own.sort(key=lambda r: r[f"_{node.dim}"])
        sums = np.r_[0, np.cumsum([r["size"] for r in own])]
        slack = kd_shards.NEAR * sums[-1] / node.leaves
        assert abs(sum(r["size"] for r in left) - goal) <= np.abs(sums - goal).min() + slack + max(r["size"] for r in own) * (len({r[f"_{node.dim}"] for r in own}) < len(own))
        check(node.children[0], left)
        check(node.children[1], right)

    check(tree, held)
    assert len(held) == rows.count()


def test_op2_repeated_rows_are_parted(spark):
    """A thousand times one row, and few others: shards are still as large as each other."""
    rows = [(1, "the same text", "s", "en")] * 1000 + [(i, "x" * i, "t", "de") for i in range(2, 12)]
    placed = kd_shards.shard(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)).collect()
    sizes = Counter()
    for r in placed:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 3 * 14


def test_op2_query_columns(spark, sf):
    df = queries.op2_kd_shards(spark, sf)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}


def test_op3_articles(spark, sf):
    """The article's heading and paragraphs, by a plain reading of the pages' one template."""
    want = Counter()
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", body)
        text = "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks) if t)
        want[r["page_id"], r["url"], text, len(text)] += 1
    assert Counter(map(tuple, queries.op3_page_diff(spark, sf).collect())) == want


def test_op3_structure_and_differencing(spark):
    menu = "<p>All rights kept</p><div>Home | News</div>"
    pages = [
        (1, "http://a.x/n/1", f"<body>{menu}<div>First story text.</div><div>More &amp; more &lt;b&gt;</div></body>"),
        (2, "http://a.x/n/2", f"<body>{menu}<div>Second  story\n text.</div></body>"),
        (3, "http://b.x/n/2", f"<body>{menu}<div>Alone on its host.</div></body>"),
        (4, None, None), (5, "", "plain text"), (5, "", "plain text"), (None, "http://c.x", "<article><nav>n</nav><header><h1>T</h1><p>by me</p></header><p>a<script>x='<p>'</script>b</p><div class='post-comments'><p>nice</p></div><ul><li>one<li>two</ul><form>f</form><p>cut off <b"),
        (8, "http://a.x/n/9", '<main><p>kept</p><div id="cookieNotice">cookies</div><aside>side</aside></main><footer>f</footer><p>All rights kept</p>'),
        (9, "http://d.x/", "<body><div role=banner>B</div><p>x&nbsp;y<br>z</p><!-- <p>no</p> --><p hidden>h</p><p class='notice'>n<p>w</p><span class=ad>buy</span> tail"),
        (11, "http://e.x/", "<head><title>t<body><article class='post'><div class='article-header'><h1>T</h1>by me</div><p>a</p><article class='comment'>c</article></article><article class='comment'>d</article>"),
        (10, "http://a.x/n/3", f"<body>{menu}<article><p>All rights kept</p><p>Passage</p></article></body>"),
    ]
    got = page_diff.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text[1] == "First story text.\n\nMore & more <b>" and text[2] == "Second story text."
    assert text[3] == "All rights kept\n\nHome | News\n\nAlone on its host."
    assert text[4] == "" and text[5] == "plain text"
    assert text[None] == "T\n\nab\n\none\n\ntwo\n\ncut off"
    assert text[8] == "kept" and text[9] == "x y z\n\nw\n\ntail"
    assert text[11] == "T\n\na"
    assert text[10] == "All rights kept\n\nPassage"
    assert page_diff.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 12)).tolist(), rng.integers(0, 6, rng.integers(0, 12)).tolist()
        best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        got = page_diff.common(a, b)
        assert len(got) == best[-1, -1] and got == sorted(set(got))
        it = iter(b)
        assert all(a[k] in it for k in got)


def test_longest_common_subsequence_halved(monkeypatch):
    """Lists too long for one table are halved, and many equal lines cost no more than others."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 300).tolist(), rng.integers(0, 9, 260).tolist()
    whole = len(page_diff.common(a, b))
    monkeypatch.setattr(page_diff, "TABLE_BITS", 500)
    got = page_diff.common(a, b)
    it = iter(b)
    assert len(got) == whole and all(a[k] in it for k in got)
    monkeypatch.undo()
    assert page_diff.common([1] * 3000 + [2], [3] + [1] * 3000) == list(range(3000))


def test_differencing_decides(spark):
    """Random sites against a plain reading of the rule, in which alignment is a table of lengths; without differencing, all comes back."""
    import random

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    random.seed(4)
    pages = []
    for host in range(12):
        template = [f"menu {host} {k}" for k in range(random.choice([0, 2, 30]))] + ["--", f"foot {host}"]
        for k in range(random.randint(1, 9)):
            own = [f"story {host} {k} {x}" for x in range(random.randint(0, 3))]
            pages.append((f"http://h{host}/p/{k:02d}", template[:-2] + own + template[-2:]))
            if random.random() < 0.3:
                pages.append((f"http://h{host}/p/{k:02d}/print", pages[-1][1]))  # the same page under another address
            if random.random() < 0.3:
                pages.append((f"http://h{host}/q/{k:02d}", [*pages[-1][1], f"copied on {k}"]))
    want = {}
    for url, mine in pages:
        host, first = url.split("/")[2], {}
        for u, x in sorted(pages):
            if u.split("/")[2] == host:
                first.setdefault(tuple(x), u)
        order = sorted(first, key=lambda x: first[x])
        i = order.index(tuple(mine))
        votes, voters = Counter(), 0
        for x in [order[j] for j in range(i - 2, i + 3) if j != i and 0 <= j < len(order)]:
            if lcs(mine, x) < len(mine):
                voters += 1
                same, kinds = lcs(mine, x), Counter(x)
                assert same == sum(t in kinds for t in mine)  # here no line is out of order, so shared lines are the alignment
                votes.update(t for t in mine if t in kinds)
        want[url] = [t for t in mine if not voters or votes[t] < min(2, voters)]
    rows = [(i, u, "".join(f"<p>{t}</p>" for t in x)) for i, (u, x) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_sig", F.lit(1))
    assert {r["url"]: r["text"].split("\n\n") if r["text"] else [] for r in page_diff.extract(df).collect()} == want
    plain = {r["url"]: r["text"] for r in page_diff.extract(df, differencing=False).collect()}
    assert plain == {u: "\n\n".join(x) for u, x in pages} and sum(len(x) > len(want[u]) for u, x in pages) > 30


def test_nearest_pages_across_blocks(spark):
    """Every second line of a site is common; a site that spans blocks loses it on all pages."""
    pages = [(i, f"http://big.x/{i:05d}", f"<div>Site notice line</div><div>own {i}</div>") for i in range(300)]
    got = page_diff.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"own {i}" for i in range(300)}


def test_op5(spark, at):
    from tokenizers import Tokenizer

    from marlstone.llm.tokens import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    rows = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    ids = {(r[0], r[1]): tok.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    got = sorted(queries.op5_sstable(spark, at).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(ids[tuple(r)]), zlib.crc32(np.array(ids[tuple(r)], "<u4").tobytes())) for r in rows)
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_shard_file_lookup():
    writer, want = sstable.Writer(), defaultdict(list)
    for k in [*range(-5, 5), 7, 7, 7, *range(100, 40_000, 3), 1 << 62]:
        value = np.arange(k % 50, dtype="<u4").tobytes() * (1 + k % 3)
        writer.add(k, value)
        want[k].append(value)
    raw = writer.finish()
    reader = sstable.Reader(raw)
    assert len(reader.index) > 5 and reader.documents == sum(map(len, want.values()))
    assert [d for d, _ in reader.scan()] == [d for d, v in want.items() for _ in v]
    for k in [*list(want)[::37], 7, 1 << 62]:
        assert reader.get(k) == want[k]
    assert all(not reader.get(k) for k in (8, 101, 39_999 + 5, -6))
    with pytest.raises(ValueError):
        sstable.Reader(raw[:-1])


def brute_links(rows, cosine=0.93):
    """n_links and component of each row by comparing all rows of a label."""
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = {i: np.array(rows[i][1], dtype=np.float64) for i in good}
    links = defaultdict(set)
    for lab, n in {(rows[i][2], len(x[i])) for i in good}:
        own = [i for i in good if rows[i][2] == lab and len(x[i]) == n]
        m = np.stack([x[i] / np.linalg.norm(x[i]) for i in own])
        for a, b in zip(*np.nonzero(m @ m.T >= cosine), strict=True):
            if a != b:
                links[own[a]].add(own[b])
    return links


def test_op8(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    links = brute_links(rows)
    got = {r["vec_id"]: r for r in queries.op8_cross_polytope(spark, sf).collect()}
    assert set(got) == {r[0] for r in rows}
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(map(len, links.values()))
    assert all(got[rows[i][0]]["n_links"] <= len(links[i]) for i in range(len(rows)))


def test_op8_recall_slices_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(cross_polytope, "SLICE", 64)
    base = rng.normal(size=(40, 64))
    rows = []
    for i in range(1200):
        c = base[i % 40 if i > 600 else 0]  # half of all in one cluster
        rows.append((i, (c + rng.normal(size=64) * rng.uniform(0, 0.45)).astype(np.float32).astype(float).tolist(), i % 2 if i < 1100 else 0))
    rows += [(2000, None, 0), (2001, [0.0] * 64, 0), (2002, [float("nan")] + [1.0] * 63, 0), (2003, [None] + [1.0] * 63, 0), (2004, [], 1), (2005, rows[0][1], None), (2006, rows[0][1], 0), (2006, rows[0][1], 0), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0), (2009, [3.0], 0)]
    links = brute_links(rows)
    got = cross_polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert Counter(r["vec_id"] for r in got) == Counter(r[0] for r in rows)
    found, true = sum(r["n_links"] for r in got), sum(map(len, links.values()))
    assert 0.95 * true <= found <= true
    by = {r["vec_id"]: r for r in got}
    assert all(by[v]["n_links"] == 0 and by[v]["component_id"] == v for v in (2000, 2001, 2002, 2003, 2004, 2005, 2009))
    assert by[2007]["component_id"] == by[2008]["component_id"] == 2007 and not by[2008]["kept"]
    assert all(by[rows[i][0]]["n_links"] <= len(links[i]) for i in range(len(rows)))
    assert cross_polytope.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_op8_like_vectors_dont_gather(spark, monkeypatch):
    """A dense label, all cosines about 0.8 and hardly one true link: few pairs pass the sketches, so what is verified isn't all pairs."""
    rng = np.random.default_rng(8)
    base, noise = rng.normal(size=64), rng.normal(size=(3000, 64))
    noise -= np.outer(noise @ base, base) / (base @ base)
    x = np.sqrt(0.8) * base / np.linalg.norm(base) + np.sqrt(0.2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.r_[x, x[:20] + 1e-3]
    counts, components = [], cross_polytope.components
    monkeypatch.setattr(cross_polytope, "components", lambda edges: counts.append(edges.count()) or components(edges))
    got = cross_polytope.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    assert 20 <= counts[0] < 300
    assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"] >= 3000} == {3000 + i: i for i in range(20)}


@pytest.mark.parametrize("width", [3, 64, 300])
def test_op8_sketches_keep_cosines(width):
    """No pair at the limit falls below what sketches are asked for."""
    rng = np.random.default_rng(width)
    a = rng.normal(size=(2000, width))
    b = rng.normal(size=(2000, width))
    b -= a * ((a * b).sum(axis=1) / (a * a).sum(axis=1))[:, None]
    b = 0.93 * a / np.linalg.norm(a, axis=1, keepdims=True) + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (cross_polytope.sketches(v).astype(float) for v in (a, b))
    near = (x * y).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    assert near.min() >= cross_polytope.least_near(0.93, x.shape[1])


def test_op9(spark):
    at = "/root/testdata/sf0.01"
    got = queries.op9_quality(spark, at).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{at}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)
    assert len(held) > 50 and right >= 0.95, right


def test_op9_odd_rows(spark, odd, empty):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, None), (None, 1)], "doc_id long, quality int")
    forest = quality_model.train(docs, labels)
    assert quality_model.score(docs, forest).count() == docs.count()
    none = quality_model.train(docs, labels.where("false"))
    assert {r["score"] for r in quality_model.score(docs, none).collect()} == {0.5}
    assert quality_model.score(spark.read.parquet(f"{empty}/documents.parquet"), forest).count() == 0


def test_trees_and_their_sql(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 1] > 0.2)).astype(float)
    forest = fit(x[:2000], y[:2000])
    assert ((forest.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    spark.createDataFrame(x[:50].tolist(), "a double, b double, c double, d double").createOrReplaceTempView("x")
    sql = [r[0] for r in spark.sql(f"SELECT {forest.sql(list('abcd'))} FROM x").collect()]
    assert np.allclose(sql, forest.margin(x[:50]), atol=1e-3)
