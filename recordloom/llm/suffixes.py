"""Suffix-array dedup of repeated byte strings, sorted deep-shallow.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier (smaller
doc_id, or earlier in the same document). Sorting every suffix of the corpus would ship
every byte a hundred times, so the suffix array is sparse: each window is stood for by its
anchor, the ``GRAM`` bytes in it with the least hash. Equal windows have equal anchors at
equal places, so all repeats are found among the suffixes that start at anchors.

1. Documents are dealt into buckets, once; every step below reads that one exchange.
   Each bucket sends its anchors' hashes, four bytes each, dealt by their other bytes;
   anchors that occur once in all the corpus can't lie in a repeated window and are
   dropped, the others come back to their buckets. (Two anchors with one hash only make
   suffixes that are compared in vain.)
2. The suffixes at the others, with the bytes before them that a window can hold, are
   dealt by anchor; of equal ones in a bucket only the first travels whole, the rest are
   repeats already. In each task they are sorted forwards (the bytes from the anchor) and
   backwards (the bytes before it): multikey quicksort on eight-byte characters down to
   ``SHALLOW`` bytes, then blind tries order the groups whose prefixes are still equal.
   The sorted order with its longest common prefixes tells, for every place of the anchor
   in a window, which windows are equal, byte by byte; all but the first are repeats.
3. The repeats' ranges come back to their documents, which drop the bytes.

An anchor that occurs more than ``HOT`` times is not gathered: its windows are reduced to
their first occurrence inside each bucket of documents, and only those meet, by window.

Buckets and parts grow in number with the bytes of text, and so do the tasks.

Defined cases: a null text is empty; texts under ``WINDOW`` bytes lose nothing; a very
long text is one document of its bucket, read in one piece; repeated
rows (same doc_id or none, same text) are one document, whose bytes are no repeats of
themselves, and get the same result each; documents of equal doc_id and different text are
ordered by the hash of their text, those without doc_id come last; any doc_id is legal; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.workers import release

WINDOW = 100
GRAM = 24
SHALLOW = 32
HOT = 100_000
#: Bytes of text in a bucket of documents, about.
BUCKET_BYTES = 8_000_000
_AT_ONCE = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)
#: A document: those without an id come after all others.
_DOC = np.dtype([("none", "u1"), ("id", "<i8"), ("mark", "<i8")])
_SPOT = np.dtype([("doc", _DOC), ("at", "<i8")])


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at every position, by doubling."""
    part, size = raw.astype(np.uint64) + np.uint64(1), 1
    done, have = None, 0
    rest = gram
    while rest:
        if rest & 1:
            if done is None:
                done = part
            else:
                n = len(raw) - have - size + 1
                done = done[:n] * np.uint64(pow(0x100000001B3, size, 1 << 64)) + part[have : have + n]
            have += size
        rest >>= 1
        if rest:
            part = part[:-size] * np.uint64(pow(0x100000001B3, size, 1 << 64)) + part[size:]
            size *= 2
    done = (done ^ (done >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (done ^ (done >> np.uint64(32))) * _MIX


def anchors(raw: np.ndarray, doc_start: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first, last) of the anchors of all windows inside documents that stand one after another in ``raw``.

    ``first`` and ``last`` are the starts of the windows that the anchor stands for. ``doc_start`` has each document's first position and, last, the length of ``raw``.
    """
    if len(raw) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = _gram_hashes(raw, gram)
    doc = np.repeat(np.arange(len(doc_start) - 1), np.diff(doc_start))
    places, windows, step = [], [], (1 << 24) - window
    for lo in range(0, len(raw) - window + 1, step):
        hi = min(len(raw), lo + step + window - 1)
        part = (hashes[lo : hi - gram + 1] & ~_LOW) | np.arange(hi - gram + 1 - lo, dtype=np.uint64)
        span, wide = 1, window - gram + 1
        while span * 2 <= wide:
            part = np.minimum(part[:-span], part[span:])
            span *= 2
        if span < wide:
            part = np.minimum(part[: len(part) - (wide - span)], part[wide - span :])
        n = hi - lo - window + 1
        inside = doc[lo : lo + n] == doc[lo + window - 1 : lo + window - 1 + n]
        places.append((part[:n][inside] & _LOW).astype(np.int64) + lo)
        windows.append(np.flatnonzero(inside) + lo)
    place, start = np.concatenate(places), np.concatenate(windows)
    begin = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
    last = np.concatenate((begin[1:], [len(place)])).astype(np.int64) - 1 if len(place) else begin
    return place[begin], hashes[place[begin]], start[begin], start[last]


def blind_trie(keys: list[int], bits: int) -> tuple[list[int], list[int]]:
    """Order of ``keys`` (integers of ``bits`` bits) and the bits each shares with the one before it.

    The trie holds only the bit at which each branching differs. A key goes down blindly to
    some leaf, one comparison with that leaf gives the first bit in which they differ, and
    the new branch goes where that bit belongs.
    """
    leaves: list[list[int]] = [[0]]
    root: list | int = 0
    for n in range(1, len(keys)):
        key = keys[n]
        node = root
        while not isinstance(node, int):
            node = node[1 + (key >> (bits - 1 - node[0]) & 1)]
        differs = key ^ keys[leaves[node][0]]
        if not differs:
            leaves[node].append(n)
            continue
        at = bits - differs.bit_length()
        leaves.append([n])
        side = key >> (bits - 1 - at) & 1
        above, node = None, root
        while not isinstance(node, int) and node[0] < at:
            turn = 1 + (key >> (bits - 1 - node[0]) & 1)
            above, node = (node, turn), node[turn]
        branch = [at, None, None]
        branch[1 + side], branch[2 - side] = len(leaves) - 1, node
        if above is None:
            root = branch
        else:
            above[0][above[1]] = branch
    order: list[int] = []
    shared: list[int] = []
    stack: list[tuple] = [(root, 0)]
    while stack:
        node, common = stack.pop()
        if isinstance(node, int):
            for i, n in enumerate(leaves[node]):
                order.append(n)
                shared.append(bits if i else common)
        else:
            stack.append((node[2], node[0]))
            stack.append((node[1], common))
    return order, shared


def deep_shallow_sort(rows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of byte strings of one width, sorted inside their groups.

    ``lcp[i]`` is the number of bytes that row ``order[i]`` shares with the row before it,
    -1 where a group begins. All groups are partitioned together: each round splits every
    unsorted run around its own pivot character into less, equal and greater.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    depth_words = min(shallow // 8, words.shape[1])
    order = np.argsort(group, kind="stable")
    run = np.unique(group[order], return_inverse=True)[1]
    depth = np.zeros(n, np.int64)  # by place: characters that the run shares
    while True:
        size = np.bincount(run)
        active = np.flatnonzero((size[run] > 1) & (depth < depth_words))
        if not len(active):
            break
        here = run[active]
        first = np.concatenate(([True], here[1:] != here[:-1]))
        begin = np.flatnonzero(first)
        own = np.cumsum(first) - 1
        char = words[order[active], depth[active]]
        length = np.diff(np.concatenate((begin, [len(active)])))
        thirds = np.sort(np.stack([char[begin], char[begin + length // 2], char[begin + length - 1]]), axis=0)
        pivot = thirds[1][own]
        side = (char > pivot).astype(np.int64) - (char < pivot) + 1
        place = np.argsort(own * 3 + side, kind="stable")
        order[active] = order[active[place]]
        depth[active] = depth[active[place]] + (side[place] == 1)
        mark = np.zeros(n, bool)
        new = (own * 3 + side)[place]
        mark[active] = np.concatenate(([True], new[1:] != new[:-1]))
        mark[1:] |= run[1:] != run[:-1]
        mark[0] = True
        run = np.cumsum(mark) - 1
    # deep: runs that are equal down to the shallow depth
    lcp = np.full(n, -1, np.int64)
    size = np.bincount(run, minlength=1)
    begins = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if n else np.zeros(0, np.int64)
    tail = padded[:, depth_words * 8 :]
    bits = tail.shape[1] * 8
    for b in begins[size > 1].tolist():
        m = int(size[run[b]])
        rows_here = order[b : b + m]
        if not bits:
            lcp[b + 1 : b + m] = width
            continue
        blob, wide = tail[rows_here].tobytes(), bits // 8
        keys = [int.from_bytes(blob[i * wide : (i + 1) * wide], "big") for i in range(m)]
        inner, shared = blind_trie(keys, bits)
        order[b : b + m] = rows_here[inner]
        lcp[b + 1 : b + m] = np.minimum(width, depth_words * 8 + np.array(shared[1:]) // 8)
    # neighbours in one group whose runs were parted: compare characters
    same_group = np.flatnonzero((group[order][1:] == group[order][:-1]) & (run[1:] != run[:-1])) + 1
    if len(same_group):
        differs = padded[order[same_group]] != padded[order[same_group - 1]]
        lcp[same_group] = np.minimum(width, differs.argmax(axis=1))
    return order, lcp


def repeated_ranges(gram_hash: np.ndarray, before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to): bytes around each anchor that lie in windows seen in an earlier row.

    Rows are in order of (document, position). ``before`` holds the bytes before the anchor
    in reverse, ``after`` those from it on, with the numbers of bytes there are.
    """
    n = len(gram_hash)
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    forward, f_lcp = deep_shallow_sort(after, gram_hash)
    backward, b_lcp = deep_shallow_sort(before, gram_hash)
    low, high = np.full(n, window + 1), np.full(n, -1)
    node_f, node_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(before.shape[1] + 1):
        ok = np.flatnonzero((n_before >= d) & (n_after >= window - d))
        if len(ok) < 2:
            continue
        node_f[forward] = np.cumsum(f_lcp < window - d)
        node_b[backward] = np.cumsum(b_lcp < d)
        key = node_b[ok] * (n + 1) + node_f[ok]
        place = np.argsort(key, kind="stable")
        sorted_key = key[place]
        later = ok[place[1:][sorted_key[1:] == sorted_key[:-1]]]
        low[later] = np.minimum(low[later], d)
        high[later] = d
    hit = np.flatnonzero(high >= 0)
    return hit, -high[hit], window - low[hit]


class _Bucket:
    """Documents of a bucket, one after another, in pieces of bounded size."""

    def __init__(self, table: pa.Table, at_once: int = _AT_ONCE):
        self.docs = _doc_keys(table)
        self.texts = [t.as_py().encode("utf-8", "surrogatepass") for t in table.column("text")]
        self.at_once = at_once

    def pieces(self):
        at = 0
        while at < len(self.texts):
            to, size = at, 0
            while to < len(self.texts) and (to == at or size + len(self.texts[to]) <= self.at_once):
                size += len(self.texts[to])
                to += 1
            raw = np.frombuffer(b"".join(self.texts[at:to]), np.uint8)
            starts = np.concatenate(([0], np.cumsum([len(t) for t in self.texts[at:to]]))).astype(np.int64)
            yield at, raw, starts
            at = to


def _doc_keys(table: pa.Table) -> np.ndarray:
    out = np.zeros(len(table), _DOC)
    out["none"] = table.column("doc_id").is_null().to_numpy()
    out["id"] = pa.compute.fill_null(table.column("doc_id"), 0).to_numpy()
    out["mark"] = table.column("mark").to_numpy()
    return out


def _keys(docs: np.ndarray) -> tuple:
    """Sort keys of documents, the last first, as ``lexsort`` takes them."""
    return docs["mark"], docs["id"], docs["none"]


def _once(table: pa.Table) -> pa.Table:
    """One row of each document: a bucket holds all rows of an id and text."""
    docs = _doc_keys(table)
    order = np.lexsort(_keys(docs))
    again = order[1:][docs[order][1:] == docs[order][:-1]]
    return table.take(np.delete(np.arange(len(docs)), again)) if len(again) else table


def _parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _short(hashes: np.ndarray) -> np.ndarray:
    """What tells an anchor from others of its part."""
    return hashes.astype(np.uint32)


def _squeezed(span: np.ndarray) -> bytes:
    """Neighbouring suffixes overlap, so they travel compressed."""
    return pa.compress(span.tobytes(), codec="zstd", asbytes=True)


def _split(part: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
        yield p, order[edge[p] : edge[p + 1]]


def _table(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields.values(), strict=True)], names=[*fields])


_ANCHORS = {"part": pa.int32(), "bucket": pa.int64(), "hashes": pa.binary(), "times": pa.binary()}


def _hash_anchors(parts, window, gram):
    """Step 1, a bucket: its distinct anchors of each part, and how often they occur."""

    def run(key, docs):
        found = [anchors(raw, starts, window, gram)[1] for _, raw, starts in _Bucket(_once(docs)).pieces()]
        hashes = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        begin = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
        times = np.minimum(np.diff(np.concatenate((begin, [len(hashes)]))), (1 << 31) - 1).astype(np.uint32)
        hashes = hashes[begin]
        rows = [(p, key[0].as_py(), _short(hashes[pick]).tobytes(), times[pick].tobytes()) for p, pick in _split(_parts_of(hashes, parts), parts)]
        release()
        return _table(rows, _ANCHORS)

    return run


_REPLIES = {"bucket": pa.int64(), "part": pa.int32(), "hashes": pa.binary(), "hot": pa.binary()}


def _repeated_anchors(hot):
    """Step 1, a part: for each bucket its anchors that occur more than once in the corpus."""

    def run(key, table):
        blobs = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("hashes")]
        hashes, times = np.concatenate(blobs), np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint32)
        total = np.bincount(np.unique(hashes, return_inverse=True)[1], times)[np.unique(hashes, return_inverse=True)[1]]
        rows, at = [], 0
        for bucket, own in zip(table.column("bucket").to_pylist(), blobs, strict=True):
            n = total[at : at + len(own)]
            at += len(own)
            if (n > 1).any():
                rows.append((bucket, key[0].as_py(), own[n > 1].tobytes(), (n > hot)[n > 1].tobytes()))
        release()
        return _table(rows, _REPLIES)

    return run


_CONTEXT = {"part": pa.int32(), "kind": pa.int32(), "hashes": pa.binary(), "spots": pa.binary(), "before": pa.binary(), "after": pa.binary(), "bytes": pa.binary()}


def _contexts(parts, window, gram):
    """Step 2, a bucket: the suffixes at repeated anchors (kind 0), first windows at hot ones (kind 1), and what repeats in the bucket (kinds 2, 3)."""
    reach = window - gram

    def run(docs, replies):
        rows: list[tuple] = []
        if len(docs) and len(replies):
            part_of = replies.column("part").to_numpy()
            blobs = [np.frombuffer(x.as_py(), np.uint32) for x in replies.column("hashes")]
            known = np.repeat(part_of.astype(np.uint64), [len(b) for b in blobs]) << np.uint64(32) | np.concatenate(blobs)
            hot = np.frombuffer(b"".join(replies.column("hot").to_pylist()), bool)
            order = np.argsort(known)
            known, hot = known[order], hot[order]
            bucket = _Bucket(_once(docs))
            hot_windows: list[np.ndarray] = []
            for base, raw, starts in bucket.pieces():
                where, hashes, first, last = anchors(raw, starts, window, gram)
                own = _parts_of(hashes, parts).astype(np.uint64) << np.uint64(32) | _short(hashes)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                found = known[at] == own
                where, hashes, is_hot = where[found], hashes[found], hot[at[found]]
                doc = np.searchsorted(starts, where, "right") - 1
                # equal windows have their anchor in one place, so each anchor answers for its own windows alone
                n_before, n_after = where - first[found], window - (where - last[found])
                if is_hot.any():
                    hot_windows.append(_first_windows(raw, where[is_hot], n_before[is_hot], n_after[is_hot], doc[is_hot], starts, base, window, reach))
                where, hashes, doc, n_before, n_after = (x[~is_hot] for x in (where, hashes, doc, n_before, n_after))
                spots = np.zeros(len(where), _SPOT)
                spots["doc"], spots["at"] = bucket.docs[base + doc], where - starts[doc]
                wide = np.concatenate((np.zeros(reach, np.uint8), raw, np.zeros(window, np.uint8)))
                column = np.arange(-reach, window)[None, :]
                for p, pick in _split(_parts_of(hashes, parts), parts):
                    pick = pick[np.lexsort((spots["at"][pick], *_keys(spots["doc"][pick])))]
                    span = wide[(where[pick] + reach)[:, None] + column]
                    span[(column < -n_before[pick][:, None]) | (column >= n_after[pick][:, None])] = 0
                    nb, na = n_before[pick].astype(np.uint8), n_after[pick].astype(np.uint8)
                    whole = np.concatenate((nb[:, None], na[:, None], span), axis=1)
                    lead = np.unique(whole.view(np.dtype((np.void, whole.shape[1])))[:, 0], return_index=True)[1]
                    again = np.delete(np.arange(len(pick)), lead)
                    for kind, some, spans in ((0, np.sort(lead), True), (3, again, False)):
                        if len(some):
                            rows.append((
                                p, kind, _short(hashes[pick[some]]).tobytes(), spots[pick[some]].tobytes(), nb[some].tobytes(), na[some].tobytes(),
                                _squeezed(span[some]) if spans else b"",
                            ))
            if hot_windows:
                rows += _hot_rows(np.concatenate(hot_windows), bucket, parts)
        release()
        return _table(rows, _CONTEXT)

    return run


_WINDOW_ROW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("place", "<i8"), ("start", "<i8")])


def _first_windows(raw, where, n_before, n_after, doc, starts, base, window, reach) -> np.ndarray:
    """Windows that hold a hot anchor, by a 128-bit hash of their bytes; ``place`` is the document's in the bucket."""
    d = np.arange(reach + 1)[None, :]
    ok = (n_before[:, None] >= d) & (n_after[:, None] >= window - d)
    start = np.unique((where[:, None] - d)[ok])
    out = np.zeros(len(start), _WINDOW_ROW)
    view = np.lib.stride_tricks.sliding_window_view(raw, window)
    digest = [hashlib.blake2b(view[s].tobytes(), digest_size=16).digest() for s in start.tolist()]
    pair = np.frombuffer(b"".join(digest), "<u8").reshape(-1, 2)
    out["h1"], out["h2"] = pair[:, 0], pair[:, 1]
    own = np.searchsorted(starts, start, "right") - 1
    out["place"], out["start"] = base + own, start - starts[own]
    return out


def _hot_rows(found: np.ndarray, bucket: _Bucket, parts: int) -> list[tuple]:
    """Kind 1: the first occurrence of each window in the bucket; kind 2: the later ones, which are repeats already."""
    spots = np.zeros(len(found), _SPOT)
    spots["doc"], spots["at"] = bucket.docs[found["place"]], found["start"]
    order = np.lexsort((spots["at"], *_keys(spots["doc"]), found["h2"], found["h1"]))
    found, spots = found[order], spots[order]
    first = np.concatenate(([True], (found["h1"][1:] != found["h1"][:-1]) | (found["h2"][1:] != found["h2"][:-1])))
    rows = []
    for kind, some in ((1, np.flatnonzero(first)), (2, np.flatnonzero(~first))):
        for p, pick in _split(_parts_of(found["h1"][some], parts), parts):
            at = some[pick]
            rows.append((p, kind, found["h1"][at].tobytes(), spots[at].tobytes(), b"", b"", found["h2"][at].tobytes() if kind == 1 else b""))
    return rows


_RANGES = {"bucket": pa.int64(), "docs": pa.binary(), "froms": pa.binary(), "tos": pa.binary()}


def _find_repeats(buckets, window, gram):
    """Step 2, a part: merged ranges of repeated bytes, by bucket."""
    reach = window - gram

    def run(table):
        load = lambda part, name, kind: np.frombuffer(b"".join(part.column(name).to_pylist()), kind)
        of_kind = lambda k: table.filter(pa.compute.equal(table.column("kind"), k))
        docs, froms, tos = [], [], []

        def add(spots, lo, hi):
            docs.append(spots["doc"])
            froms.append(spots["at"] + lo)
            tos.append(spots["at"] + hi)

        usual = of_kind(0)
        if len(usual):
            h, spots = load(usual, "hashes", np.uint32), load(usual, "spots", _SPOT)
            nb, na = load(usual, "before", np.uint8).astype(np.int64), load(usual, "after", np.uint8).astype(np.int64)
            wide = reach + window
            rows_of = [len(x) for x in usual.column("before").to_pylist()]
            blobs = [pa.decompress(x, n * wide, codec="zstd", asbytes=True) for x, n in zip(usual.column("bytes").to_pylist(), rows_of, strict=True)]
            span = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, wide)
            order = np.lexsort((spots["at"], *_keys(spots["doc"]), h))
            edge = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            size = np.diff(np.concatenate((edge, [len(order)])))
            # anchors in blocks of whole groups, so that memory stays bounded
            block = np.cumsum(size) // 60_000
            for b in np.unique(block):
                groups = np.flatnonzero((block == b) & (size > 1))
                if not len(groups):
                    continue
                pick = order[np.concatenate([np.arange(edge[g], edge[g] + size[g]) for g in groups])]
                pick = pick[np.lexsort((spots["at"][pick], *_keys(spots["doc"][pick])))]
                rows, lo, hi = repeated_ranges(h[pick], span[pick, :reach][:, ::-1], nb[pick], span[pick, reach:], na[pick], window)
                add(spots[pick[rows]], lo, hi)
        again = of_kind(3)
        if len(again):
            add(load(again, "spots", _SPOT), -load(again, "before", np.uint8).astype(np.int64), load(again, "after", np.uint8).astype(np.int64))
        hot = of_kind(1)
        if len(hot):
            h1, h2, spots = load(hot, "hashes", np.uint64), load(hot, "bytes", np.uint64), load(hot, "spots", _SPOT)
            order = np.lexsort((spots["at"], *_keys(spots["doc"]), h2, h1))
            # the least of the buckets' first windows stays
            add(spots[order[1:][(h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])]], 0, window)
        later = of_kind(2)
        if len(later):
            add(load(later, "spots", _SPOT), 0, window)
        rows = []
        if docs:
            found, a, b = merged(np.concatenate(docs), np.concatenate(froms), np.concatenate(tos))
            rows = [(x, found[k].tobytes(), a[k].tobytes(), b[k].tobytes()) for x, k in _split(np.mod(_bucket_hash(found), buckets).astype(np.int64), buckets)]
        release()
        return _table(rows, _RANGES)

    return run


def _bucket_hash(docs: np.ndarray) -> np.ndarray:
    """Bucket of a document, from its id (0 for none) and the hash of its text; the same as in ``remove_repeats``."""
    return np.mod(docs["id"] ^ docs["mark"], 1 << 31)


def merged(docs, froms, tos):
    """The union of ranges, per document."""
    order = np.lexsort((tos, froms, *_keys(docs)))
    docs, froms, tos = docs[order], froms[order], tos[order]
    if not len(docs):
        return docs, froms, tos
    doc = np.cumsum(np.concatenate(([False], docs[1:] != docs[:-1])))
    wide = int(tos.max()) + 2
    reach = np.maximum.accumulate(tos + doc * wide)
    new = np.concatenate(([True], froms[1:] + doc[1:] * wide > reach[:-1]))
    begin = np.flatnonzero(new)
    last = np.concatenate((begin[1:] - 1, [len(docs) - 1]))
    return docs[begin], froms[begin], reach[last] - doc[begin] * wide


_CUT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def _drop_bytes(table, ranges):
    """Step 3: each document of a bucket without its repeated bytes."""
    load = lambda name, kind: np.frombuffer(b"".join(ranges.column(name).to_pylist()), kind)
    cut: dict[tuple, list] = {}
    if len(ranges):
        for doc, a, b in zip(*(x.tolist() for x in merged(load("docs", _DOC), load("froms", np.int64), load("tos", np.int64))), strict=True):
            cut.setdefault(doc, []).append((a, b))
    bucket = _Bucket(table)
    out = []
    for i, doc, text in zip(table.column("doc_id").to_pylist(), bucket.docs.tolist(), bucket.texts, strict=True):
        gone = cut.get(doc, [])
        keep, at = [], 0
        for a, b in gone:
            keep.append(text[at:a])
            at = b
        keep.append(text[at:])
        kept = b"".join(keep)
        out.append((i, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
    release()
    return _table(out, _CUT)


def _schema(fields: dict[str, pa.DataType]) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{n} {names[t]}" for n, t in fields.items())


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) for every row."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(tasks, -(-total // bucket_bytes))
    parts = max(tasks, -(-total // (2 * bucket_bytes)))
    own = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.col("mark")), F.lit(1 << 31)), F.lit(buckets))
    # all three steps below read this exchange, so a text travels once
    base = base.withColumn("bucket", own).repartition(buckets, "bucket").groupBy("bucket")
    by_part = lambda df: df.repartition(parts, "part").groupBy("part")
    by_bucket = lambda df: df.repartition(buckets, "bucket").groupBy("bucket")
    found = base.applyInArrow(_hash_anchors(parts, window, gram), _schema(_ANCHORS))
    replies = by_part(found).applyInArrow(_repeated_anchors(hot), _schema(_REPLIES))
    contexts = base.cogroup(by_bucket(replies)).applyInArrow(_contexts(parts, window, gram), _schema(_CONTEXT))
    ranges = by_part(contexts).applyInArrow(_find_repeats(buckets, window, gram), _schema(_RANGES))
    return base.cogroup(by_bucket(ranges)).applyInArrow(_drop_bytes, _schema(_CUT))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over all of ``documents``."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
