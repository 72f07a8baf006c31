"""Tokenizer alignment against a plain count of overlapping token pairs."""

import collections
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import align

NAMES = "doc_id long, text string, chunk long, at string, is_doc string, pair long"


@pytest.fixture(scope="module")
def sides():
    a, b = align.ByteLevel(*align.public_paths()[:2]), align.Pieces(align.public_paths()[2])
    return a, b, align.Aligner(a, b)


def _spans(ids, side):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(side.bytes_of[i])))
        at = out[-1][1]
    return out


def _slow(text, sides):
    """(a, b, groups as text, links) by walking over token ranges."""
    left, right, _ = sides
    if not text:
        return [], [], "", []
    left.ids_of.slow or left.ids_of("漢")
    a, b = left.ids_of.slow.encode(" " + text, add_special_tokens=False).ids, right.model.encode(text)
    raw = (" " + text).encode()
    if b"".join(left.bytes_of[i] for i in a) != raw or b"".join(right.bytes_of[i] for i in b) != raw:
        return [], [], "", []
    at_a, at_b = _spans(a, left), _spans(b, right)
    links, first = [], 0
    for i, (lo, hi) in enumerate(at_a):
        while at_b[first][1] <= lo:
            first += 1
        j = first
        while j < len(b) and at_b[j][0] < hi:
            links.append((a[i], b[j]))
            j += 1
    cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
    groups = []
    for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
        inside = lambda ids, at: ",".join(str(i) for i, (s, e) in zip(ids, at, strict=True) if lo <= s and e <= hi)  # noqa: B023, E731
        groups.append(f"{inside(a, at_a)}|{inside(b, at_b)}")
    return a, b, ";".join(groups), links


def _digests(rows, sides):
    found = [(i, *_slow(t, sides)) for i, t in rows]
    count = collections.Counter(link for *_, links in found for link in links)
    highest = collections.Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return [
        (i, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for i, a, b, groups, links in found
    ], count, highest


@given(st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", "é", "漢字", "😀", "<s>", "<unk>", "<|endoftext|>", "<0x41>", "▁", "\t", ".", "don't", "\x00", "​"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_alignment_equals_the_slow_one(sides, parts):
    text = "".join(parts)
    a, b, groups, links = _slow(text, sides)
    got = sides[2](text)
    assert (got.a.tolist(), got.b.tolist(), got.groups()) == (a, b, groups)
    assert list(zip(got.linked_a.tolist(), got.linked_b.tolist(), strict=True)) == links


def test_special_tokens_are_plain_text(sides):
    left, right, align_ = sides
    text = "<|endoftext|> and </s>"
    assert 50256 not in left(text) and 2 not in right(text)
    assert len(align_(text).a)
    assert not any(len(align_(t).a) for t in ("a ▁ b", "", None))


def test_counts_equal_brute_force(spark, tiny, sides):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    from recordloom.llm.queries import QUERIES

    got = QUERIES["op11_tokenizer_alignment"](spark, tiny)
    assert sorted(map(tuple, got.collect())) == sorted(_digests(rows, sides)[0])


@pytest.mark.parametrize("size", [1, 300, 16_000_000])
def test_counts_of_odd_rows_do_not_depend_on_chunks(spark, sides, monkeypatch, size):
    monkeypatch.setattr(align, "CHUNK_BYTES", size)
    monkeypatch.setattr(align, "LISTED", 7)
    prose = "the old mill by the river stands still, and the children walk along. "
    rows = [(1, prose), (1, prose), (2, None), (3, ""), (4, "   \n"), (None, prose + "漢字 тест"), (None, None), (5, "▁"), (6, prose * 300), (7, "x" * 5000), (8, "Ünï <s> 😀")]
    df = spark.createDataFrame([(i, t, 5, "at", "doc", 5) for i, t in rows], NAMES).repartition(3)
    digests, pairs = align.link_counts(df)
    want, count, highest = _digests(rows, sides)
    assert collections.Counter(map(tuple, digests.collect())) == collections.Counter(want)
    got = {(r.a_id, r.b_id): (r["count"], r.best) for r in pairs.collect()}
    assert got == {k: (n, n == highest[k[1]]) for k, n in count.items()}


def test_groups_are_whole(spark, sides):
    df = spark.createDataFrame([(1, "hello  wörld 漢字"), (2, None), (3, "▁")], "doc_id long, text string")
    got = {r.doc_id: r for r in align.aligned(df).collect()}
    assert sum(got[1].a_sizes) == len(got[1].a_ids) and sum(got[1].b_sizes) == len(got[1].b_ids) and len(got[1].a_sizes) == len(got[1].b_sizes) > 2
    assert got[2].a_ids == got[3].b_ids == got[2].a_sizes == []


def test_no_documents(spark):
    digests, pairs = align.link_counts(spark.createDataFrame([], NAMES))
    assert digests.count() == pairs.count() == 0


def test_sums_beyond_a_long():
    import numpy as np

    assert align._weighed(np.array([1 << 62, 5]), np.array([3, 1])) == (1 << 63) - 1
    assert align._weighed(np.array([1 << 40, 5]), np.array([3, 1])) == 3 * (1 << 40) + 5
