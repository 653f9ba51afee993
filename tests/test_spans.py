"""Chunks over pages against a plain fold over the pages of a document."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import chunkers, spans
from marlstone.operators.shared import checkpoints


def brute(blocks_of_pages, size, overlap, small, low):
    """One document: blocks joined, headings carried, blocks cut, one after the other as they come."""
    carry, carry_kind, out = "", "section", []
    for page, blocks in blocks_of_pages:
        joined = []
        for kind, heading, text in blocks:
            text = text.strip(" ")
            if joined and text and joined[-1][:2] == [kind, heading] and (len(joined[-1][2]) < small or len(text) < small):
                joined[-1][2] += "\n" + text
            elif text:
                joined.append([kind, heading, text])
        for at, (kind, heading, text) in enumerate(joined):
            if at == 0 and not heading and carry:
                heading = carry
                kind = "section" if kind in ("text", "appendix", "table") and carry_kind == "section" else kind
            if heading:
                carry, carry_kind = heading, kind
            for piece in spans.overlapped(text, size, overlap):
                if not low(piece):
                    out.append((page, len(out) + 1, kind, heading, piece))
    return out


@pytest.mark.parametrize("size", [60, 400])
def test_page_chunks(spark, size):
    checkpoints(spark)
    rng = np.random.default_rng(size)
    lines = ["12. Levy of tax on income", "PART II", "CHAPTER IV", "an example of the levy", "(1) the first clause says so", "(2) another one", "77777", "DEFINITIONS", "plain words of a line that goes on and on", "short", "---", "(a) sub item", "x " * 40, ""]
    rows = [(f"d{d}", p, "\n".join(rng.choice(lines, size=int(rng.integers(0, 9)), p=[0.06, 0.04, 0.03, 0.1, 0.1, 0.1, 0.05, 0.03, 0.15, 0.1, 0.05, 0.09, 0.05, 0.05]))) for d in range(12) for p in range(9)]
    rows.append(("d0", 20, None))
    pages = spark.createDataFrame(rows, "d string, p int, t string")
    found = {}
    for r in chunkers.page_blocks(pages.withColumn("k", F.struct("d", "p")), "k", "t").orderBy("k", "block").collect():
        found.setdefault(r["k"]["d"], {}).setdefault(r["k"]["p"], []).append((r["kind"], r["heading"], r["chunk"]))
    texts = sorted({c for pages_ in found.values() for blocks in pages_.values() for *_, c in blocks})
    assert len(texts) > 20
    said = {}

    def low(text):
        if text not in said:
            said[text] = spark.createDataFrame([(text,)], "t string").select(chunkers.low_value(F.col("t"))).first()[0]
        return said[text]

    pieces = {c for by in found.values() for blocks in by.values() for b in blocks for c in spans.overlapped(b[2], size, 20)}
    marked = spark.createDataFrame([(p,) for p in sorted(pieces)], "t string").select("t", chunkers.low_value(F.col("t")).alias("low")).collect()
    said |= {r["t"]: r["low"] for r in marked}
    got = {}
    for r in spans.page_chunks(pages, "d", "p", "t", size, 20, 40).orderBy("d", "chunk_index").collect():
        got.setdefault(r["d"], []).append(tuple(r)[1:])
    want = {d: rows for d, by in found.items() if (rows := brute(sorted(by.items()), size, 20, 40, low))}
    assert got == want
    carried = [r for rows in want.values() for r in rows if r[3]]
    assert len(carried) > 20


def test_overlapped():
    assert spans.overlapped("") == [] and spans.overlapped("  one line ") == ["one line"]
    text = "".join(chr(97 + i % 26) for i in range(250))
    parts = spans.overlapped(text, 100, 20)
    assert [len(p) for p in parts] == [100, 100, 90] and parts[1].startswith(text[80:90]) and parts[-1] == text[160:]
    listed = "(1) aaaa\n(2) bbbb\n(3) cccc\n(4) dddd"
    assert spans.overlapped(listed, 18, 9) == ["(1) aaaa\n(2) bbbb", "(2) bbbb\n(3) cccc", "(3) cccc\n(4) dddd"]
    assert spans.overlapped(listed, 18, 0) == ["(1) aaaa\n(2) bbbb", "(3) cccc\n(4) dddd"]


def test_long_segments_of_a_whole_table(spark, sf):
    """Nothing is lost or moved, no piece is too long, and none could have taken the sentence after it."""
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    pieces = {}
    for r in chunkers.long_segments(docs, "doc_id", "text", 50).orderBy("doc_id", "piece").collect():
        pieces.setdefault(r["doc_id"], []).append((r["n_tokens"], r["chunk"]))
    token = re.compile(r"[0-9A-Za-z_À-ɏঀ-৿]+|[^\s0-9A-Za-z_À-ɏঀ-৿]")
    bare = lambda t: re.sub(r"\s+", "", t)
    assert set(pieces) == {k for k, t in texts.items() if t.strip()}
    for k, own in pieces.items():
        assert bare("".join(c for _, c in own)) == bare(texts[k])
        for n, chunk in own:
            assert n == len(token.findall(chunk)) <= 50
        for i, ((n, _), (_, after)) in enumerate(zip(own, own[1:], strict=False)):
            first = next(s for s in re.split(r"(?<=[.;:!?])\s+", after) if s.strip())
            tail = 50 in (n, own[i - 1][0] if i else 0, own[i + 1][0])  # beside or of a sentence that was cut into windows
            assert tail or n + len(token.findall(first)) > 50


def test_page_chunks_bound_what_python_holds(spark):
    """A batch is bounded by its bytes, not by rows alone, of which a larger table has more in a task."""
    own = spark.newSession()
    checkpoints(own)
    pages = own.createDataFrame([("a", i, "12. Levy of tax\n" + f"word{i} " * 3000) for i in range(40)], "d string, p int, t string").coalesce(1)
    assert spans.page_chunks(pages, "d", "p", "t").select("p").distinct().count() == 40
    assert int(own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
