"""The ten operators and the pipeline against brute force, on edge cases and on the tiny tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.llm import chat, langid, mixing, packing, queries, secrets, simhash, sketches, suffixes, templates, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, line long, bucket long"
PROSE = "the river runs down to the old mill and the children walk along its bank every single morning in the early light of spring "


def _edge_rows():
    long_text = " ".join(f"word{i % 977} {PROSE}" for i in range(700))
    rows = [
        (1, PROSE * 2, "en", "a"), (2, PROSE * 2, "en", None), (2, PROSE * 2, "en", None), (3, None, "en", "a"), (4, "", None, "b"), (5, "   \n\t ", "en", "b"),
        (6, "x", "en", "b"), (None, PROSE + "a lost row without any id at all", "en", "c"), (8, long_text, "en", "a"), (9, long_text + " and a tail", None, "a"),
        (10, "Ünïcödé ﬁ 漢字 тест " * 20, "xx", "ü"), (11, PROSE.replace("river", "brook") * 2, "en", "c"), (12, "password: hunter2secret and AKIA" + "A1" * 8 + " then", "en", "c"),
        (13, "<|endoftext|> special 漢字", "en", "c"), (14, "  odd spaces\x0b here\x1c there", "en", "d"),
    ]
    return [(i, t, g, s, None, 7, 7, 7, 7) for i, t, g, s in rows]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(_edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


# --- 1


def test_secret_rules_on_literals():
    text = 'Token = "abcdef12" x PASSWD:\'zz\' api-key=nope api_key= "longenough" AKIA' + "Z9" * 8 + " " + "0a" * 12 + "g"
    kinds = [(text[a:b], k) for a, b, k in secrets.rule_spans(text)]
    assert kinds == [('Token = "abcdef12', 0), ('api_key= "longenough', 0), ("AKIA" + "Z9" * 8, 1), ("0a" * 12, 2)]
    assert secrets.rule_spans("ſecret=abcdefgh") == []


@given(st.text(alphabet="tokensecrTOKEN=:'\" AKIA09af_-", max_size=120))
@settings(max_examples=150, deadline=None)
def test_secret_rules_equal_the_stated_patterns(text):
    want = [(m.start(), m.end(), 0) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    want += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert secrets.rule_spans(text) == sorted(want, key=lambda s: (s[0], s[2]))


@pytest.fixture(scope="module")
def field(docs):
    return secrets.train(secrets.training_chains(sorted(t for _, t in docs[:60])))


def test_field_finds_new_secrets_and_leaves_prose_alone(field, docs):
    secret = "deploy with ghp_" + "aB3dE5gH7jK9" * 3 + " before noon"
    assert [k for _, _, k in secrets.scan(secret, field)] == [3]
    assert secrets.scan("see version v2.10.3-rc1 of file_name_12.txt on 2024-01-02T10:15 at example.com/a/b99", field) == []
    held_out = secrets.training_chains(sorted(t for _, t in docs[100:160]), seed=77)
    assert sum(field.viterbi(n) != m for n, m in held_out) <= 0.02 * len(held_out)


def test_viterbi_is_the_best_path(field):
    names = [["bias", "len=5"], ["bias", "kinds=a9"], ["bias", "hex=True"]]
    score = field.scores(names)
    best = max(
        ((a, b, c) for a in range(3) for b in range(3) for c in range(3)),
        key=lambda p: sum(score[i][p[i]] for i in range(3)) + sum(field.move[x][y] for x, y in zip((0, *p), (*p, 0), strict=True)),
    )
    assert tuple(field.viterbi(names)) == best


def test_candidates_apart_by_marks_are_one_stretch(field):
    a, b = "aB3dE5gH7jK9", "zY8xW6vU4tS2"
    for gap in (" ", " -- " * 40, "\n" * 5000):
        assert len(secrets.stretches(f"see {a}{gap}{b} now")) == 1
    assert len(secrets.stretches(f"see {a} and {b} now")) == 2


@pytest.mark.parametrize("prose", ["и вот снова пришло письмо от города ", "और फिर शहर से एक चिट्ठी आई ", "然后城里又来了一封信， ", "και πάλι ήρθε ένα γράμμα από την πόλη ", "ثم جاءت رسالة أخرى من المدينة "])
def test_secrets_in_prose_of_other_scripts(field, prose):
    """Two secrets far apart in one script's prose are two spans, and the prose between them is none."""
    a, b = "ghp_" + "aB3dE5gH7jK9" * 3, "xoxb" + "-7fG2kL9mQ4" * 3
    text = f"{prose}{a} {prose * 40}{b} {prose}"
    assert len(secrets.stretches(text)) == 2
    spans = secrets.scan(text, field)
    assert [text[x:y] for x, y, _ in spans] == [a, b]
    assert secrets.scan(prose * 50, field) == []


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=12), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_spans_apart_from_others(some, base):
    spans, end = [], 0
    for a, n in sorted(some):
        if a >= end:
            spans.append([a, a + n])
            end = a + n
    base = sorted((a, a + n, 0) for a, n in base)
    assert secrets._apart(spans, base) == [(a, b, 3) for a, b in spans if not any(a < e and s < b for s, e, _ in base)]


def test_added_spans_held_out(field):
    """Precision and recall by token on generated secrets and look-alikes the field never saw."""
    rng_texts = ["the quick brown fox jumps over the lazy dog near a river bank at noon " * 3]
    found = want = both = 0
    for names, marks in secrets.training_chains(rng_texts, seed=991):
        got = field.viterbi(names)
        found += sum(g > 0 for g in got)
        want += sum(m > 0 for m in marks)
        both += sum(g > 0 and m > 0 for g, m in zip(got, marks, strict=True))
    assert both >= 0.97 * found and both >= 0.97 * want


def test_very_long_text_full_of_secrets(spark, field):
    text = "".join(f"token={i:08d}abcd x " for i in range(40_000))
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).first()
    assert row.n_assign == 40_000


def test_secret_query_rows(spark, edge, none, field):
    got = secrets.find_secrets(edge, field).collect()
    assert len(got) == 15
    row = next(r for r in got if r.doc_id == 12)
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 0)
    empty = next(r for r in got if r.doc_id == 3)
    assert empty.base_sha256 == hashlib.sha256(b"").hexdigest() and empty.spans == ""
    assert secrets.find_secrets(none, field).count() == 0 and secrets.fit(none) is not None


# --- 2


def _sizes(rows):
    return [(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]


def _targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted({s for _, s, _ in sizes if s is not None}) + ([None] if any(s is None for _, s, _ in sizes) else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    size = {s: sum(n for _, t, n in sizes if t == s) for s in names}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    rest = float(sum(size.values()))
    while True:
        level = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > most * size[s]]
        if not over:
            return target | {s: weight[s] * level for s in open_}, size
        for s in over:
            target[s] = most * size[s]
            rest -= target[s]
            open_.discard(s)


@pytest.mark.parametrize("block", [512, 16])
def test_mix_reaches_its_targets(spark, edge, block):
    got = mixing.Mix(edge, block_words=block, shard_slots=8).taken().collect()
    want, size = _targets(_sizes(_edge_rows()))
    assert len(got) == 15
    by = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
    doc_source = {r[0]: r[3] for r in _edge_rows()}
    for r in got:
        s = doc_source[r.doc_id]
        by[s] += r.taken
        assert r.source_size == size[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-6)
    assert all(abs(by[s] - want[s]) <= 1 for s in want)


def test_mix_takes_the_same_from_any_number_of_chunks(spark, edge):
    for chunks in (1, 700):
        got = mixing.Mix(edge, block_words=16, shard_slots=8, chunks=chunks).taken().agg(F.sum("taken"), F.sum("size")).first()
        assert abs(got[0] - got[1]) <= 5


def test_slots_are_unrolled_by_many_tasks(spark):
    df = spark.createDataFrame([("a", 0, 500_000), ("b", 3, 40_000)], "source string, lo long, hi long")
    out = mixing._explode_range(df, F.col("lo"), F.col("hi"), "k", 540_000)
    tasks = out.withColumn("t", F.spark_partition_id()).groupBy("t").count().collect()
    assert len(tasks) >= 10 and max(r["count"] for r in tasks) < 140_000 and out.distinct().count() == 539_997


def test_mix_is_repeatable_and_written_out_whole(spark, edge, none):
    a = sorted(map(repr, mixing.Mix(edge, block_words=16, shard_slots=8).taken().collect()))
    assert a == sorted(map(repr, mixing.Mix(edge.repartition(5), block_words=16, shard_slots=8).taken().collect()))
    out = mixing.mixed_documents(edge, block_words=16, shard_slots=8)
    words = out.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == sum(r.taken for r in mixing.Mix(edge, block_words=16, shard_slots=8).taken().collect())
    assert mixing.Mix(none).taken().count() == 0


def test_parts_of_repeated_rows_are_dealt_into_lists(spark, monkeypatch):
    """Many equal rows without an id: short lists give the same documents as one long one."""
    rows = [(None, PROSE * 40, "en", "a")] * 150 + [(i, f"other {i} " + PROSE * 3, "en", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    found = []
    for most in (4, 10**9):
        monkeypatch.setattr(mixing, "PARTS_PER_LIST", most)
        found.append(collections.Counter(map(tuple, mixing.mixed_documents(df).collect())))
    assert found[0] == found[1] and sum(found[0].values()) > 150


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        x = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p"), "id")
        assert sorted(r.p for r in x.collect()) == list(range(n))
        back = x.select(mixing.permuted(F.col("p"), F.lit(n), F.lit(5), inverse=True).alias("b"), "id")
        assert back.where("b != id").count() == 0


# --- 3


@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_bins_never_overflow_and_fit_best(sizes, most):
    bins = packing.Bins(64, most)
    filled = collections.Counter()
    for s in sizes:
        b, at = bins.put(s)
        assert at == filled[b]
        filled[b] += s
        assert filled[b] <= 64 and bins.n_open <= most and bins.bits == sum(1 << f for f, q in enumerate(bins.by_free) if q)


def test_packing_round_trip(spark, edge, none):
    import tokenizers

    path, ranks = packing.tokenizer_paths()
    slow = tokenizers.Tokenizer.from_file(path)
    got = packing.pack(edge).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, text, *_ in _edge_rows():
        ids = slow.encode(text or "", add_special_tokens=False).ids + [2]
        for n, (start, size) in enumerate(packing.cuts(len(ids))):
            crc = zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())
            assert any((r.piece, r.start, r.length, r.ids_crc32) == (n, start, size, crc) for r in by_doc[i])
    for rows in _by(got, "sequence_id").values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(none).count() == 0
    assert packing.cuts(2049) == [(0, 1), (1, 1024), (1025, 1024)] and packing.cuts(1024) == [(0, 1024)]


def test_both_tokenizers_agree(docs):
    ids = packing.TokenIds(*packing.tokenizer_paths())
    slow = packing.TokenIds(packing.tokenizer_paths()[0])
    for _, t in docs[:60]:
        assert ids(t) == slow(t)
    assert ids("a<|endoftext|>b") == slow("a<|endoftext|>b")


@pytest.mark.parametrize("text", [" " * 1_000_000, "x" + "\n \t" * 300_000 + "y", "a" * 1_000_000, "antidisestablish" * 62_500, "né漢т " * 200_000, "." * 1_000_000])
def test_very_long_runs_are_encoded_whole(text):
    ids = packing.TokenIds(*packing.tokenizer_paths())
    slow = packing.TokenIds(packing.tokenizer_paths()[0])
    assert ids(text) == slow(text)


def test_packing_of_very_long_texts(spark):
    rows = [(1, " " * 1_000_000), (2, "b" * 1_000_000), (3, "short")]
    got = _by(packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), "doc_id")
    slow = packing.TokenIds(packing.tokenizer_paths()[0])
    assert {i: sum(r.length for r in rows_) for i, rows_ in got.items()} == {i: len(slow(t)) + 1 for i, t in rows}


def test_packing_needs_few_sequences(spark, docs):
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    least = -(-sum(r.length for r in got) // 1024)
    assert len({r.sequence_id for r in got}) <= 1.02 * least + 1


def _by(rows, key):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


# --- 4


def _brute_repeats(rows, window):
    seen, out = set(), {}
    for i, text in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            w = raw[s : s + window]
            if w in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [100_000, 2])
def test_repeats_equal_brute_force(spark, docs, hot):
    few = docs[:70] + [(10_000 + i, "ab" * 400 + str(i)) for i in range(3)] + [(20_000, "Äöß" * 90), (20_001, "x" * 99), (20_002, "")]
    df = spark.createDataFrame(few, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(df, hot=hot).drop("kept").collect()}
    assert got == _brute_repeats(sorted(few), 100)


def test_repeats_edge_cases(spark, edge, none):
    got = suffixes.remove_repeats(edge).collect()
    assert len(got) == 15
    assert [r.n_removed for r in got if r.doc_id == 2] == [2 * len(PROSE)] * 2
    assert next(r for r in got if r.doc_id is None).n_removed >= 100
    assert next(r for r in got if r.doc_id == 3).n_bytes == 0
    assert suffixes.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [100_000, 1])
def test_repeated_rows_keep_their_text(spark, hot):
    alone = " ".join(f"w{i * i}" for i in range(80))
    rows = [(1, alone), (1, alone), (None, alone[::-1]), (None, alone[::-1]), (2, "x" + alone), (3, "short")]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).collect()
    assert [r.n_removed for r in got if r.doc_id in (1, None)] == [0] * 4
    assert [r.n_removed for r in got if r.doc_id == 2] == [len(alone)]


def test_repeats_take_any_id_and_put_missing_ones_last(spark):
    alone = " ".join(f"w{i * i}" for i in range(80))
    last = (1 << 63) - 1
    rows = [(last, alone), (None, alone + "y"), (-last - 1, "z" * 99), (0, alone[:120]), (None, None)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [
        (False, -last - 1, 99, 0), (False, 0, 120, 0), (False, last, len(alone), 120), (True, 0, 0, 0), (True, 0, len(alone) + 1, len(alone)),
    ]


def test_repeats_ship_each_text_once(spark, tiny):
    out = suffixes.op4_suffix_dedup(spark, tiny)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan parquet") == 1 and plan.count("ReusedExchange") == 2


def test_repeats_of_a_very_long_text(spark):
    body = " ".join(f"v{i * 7919 % 100_003}" for i in range(100_000))
    rows = [(1, body), (2, "start " + body[400_000:400_300] + " end"), (3, body[:500_000])]
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bucket_bytes=100_000).collect()}
    assert got == {1: 0, 2: 300, 3: 500_000}


@given(st.lists(st.binary(min_size=6, max_size=6), min_size=1, max_size=40))
@settings(max_examples=80, deadline=None)
def test_blind_trie_sorts(rows):
    keys = [int.from_bytes(r, "big") for r in rows]
    order, shared = suffixes.blind_trie(keys, 48)
    assert [keys[i] for i in order] == sorted(keys) and sorted(order) == list(range(len(keys)))
    for a, b, n in zip(order, order[1:], shared[1:], strict=False):
        assert n == 48 - (keys[a] ^ keys[b]).bit_length()


@given(st.lists(st.tuples(st.integers(0, 3), st.binary(min_size=40, max_size=40) | st.sampled_from([b"a" * 40, b"a" * 39 + b"b", b"ab" * 20])), min_size=1, max_size=40))
@settings(max_examples=80, deadline=None)
def test_deep_shallow_sort(rows):
    group = np.array([g for g, _ in rows])
    data = np.frombuffer(b"".join(r for _, r in rows), np.uint8).reshape(-1, 40)
    order, lcp = suffixes.deep_shallow_sort(data, group, shallow=16)
    got = [rows[i] for i in order]
    assert got == sorted(rows)
    for i in range(1, len(got)):
        same = got[i][0] == got[i - 1][0]
        n = next((k for k in range(40) if got[i][1][k] != got[i - 1][1][k]), 40)
        assert lcp[i] == (n if same else -1)


# --- 5


def test_chat_on_odd_rows(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|> there"), (1, 2, "bob", None), (1, 300, "ann", "later"), (2, None, None, "who"), (None, 5, "ann", ""),
        (3, 1, "system", "alone"), (1, 1, "ann", "hi <|end|> there"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("perspective", F.lit(1))
    got = chat.rotate(df).collect()
    assert {(r.conv_id, r.perspective, r.part) for r in got} == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (2, "unknown", 0), (None, "ann", 0)}
    ann = next(r for r in got if (r.conv_id, r.perspective, r.part) == (1, "ann", 0))
    spans = [tuple(map(int, s.split(":"))) for s in ann.mask.split(",")]
    assert [ann.text[a:b] for a, b in spans] == ["hi <​|end|> there<|end|>"] * 2 and ann.n_turns == 4
    assert "<|user name=bob|>" in ann.text and chat.rotate(df.limit(0)).count() == 0


def test_chat_pieces_and_names(spark):
    rows = [(1, None, f"s{i % 2}|><|end|>", f"t{i:02d}") for i in range(10)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most_rows=4).collect()
    assert sorted((r.piece, r.n_turns) for r in got) == [(0, 4), (0, 4), (1, 4), (1, 4), (2, 2), (2, 2)]
    assert all(r.text.count("|>\n") == r.n_turns * 2 for r in got)


def test_chat_equals_its_twin(spark, tiny):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tiny}/conversations.parquet'")
    assert sorted(map(tuple, chat.op5_chat_perspectives(spark, tiny).collect())) == sorted(duck.sql(chat.ORACLE).fetchall())


# --- 6


def _brute_lines(rows, min_docs):
    """The template tree, one line after another, over (doc_id, text); and long lines that repeat."""
    mask = lambda x: " ".join("<*>" if re.search(r"[0-9]", t) else t for t in re.split(r"[\x20\x09-\x0D]+", x.strip(" \t\n\x0b\x0c\r")) if t)
    held, whole = collections.defaultdict(set), collections.defaultdict(set)
    for i, text in rows:
        for x in text.split("\n"):
            m = mask(x)
            if len(m.split(" ")) >= 3:
                held[m].add(i)
            if m and (len(m.split(" ")) >= 50 or len(x) >= 300):
                whole[x].add(i)
    leaves = collections.defaultdict(list)
    for m in held:
        leaves[(len(m.split(" ")), *m.split(" ")[:3])].append(m)
    template = {}
    for lines in leaves.values():
        found = []  # [template, its lines]
        for m in sorted(lines, key=lambda m: (-len(held[m]), m)):
            words = m.split(" ")
            fit = next((f for f in found if sum(a == b for a, b in zip(f[0], words, strict=True)) >= 0.7 * len(words)), None)
            if fit is None:
                found.append([words, [m]])
            else:
                fit[0] = [a if a == b else "<*>" for a, b in zip(fit[0], words, strict=True)]
                fit[1].append(m)
        template |= {m: " ".join(words) for words, own in found for m in own}
    members = collections.defaultdict(set)
    for m, t in template.items():
        members[t] |= held[m]
    out, texts = {}, dict(rows)
    for i, text in rows:
        lines = text.split("\n")
        first = [min(whole[x]) if len(whole.get(x, ())) >= 2 else i for x in lines]
        common = collections.Counter()
        for x, j in zip(lines, first, strict=True):
            common[j] += len(x) * (j != i)
        # copies as a whole of the first document that has the line
        copy = {j for j, n in common.items() if texts[j] == text or n >= templates.COPY_SHARE * (len(text) + len(texts[j]) - n)}
        long = [j != i and j not in copy for j in first]
        who = [members.get(template.get(mask(x)), set()) for x in lines]
        out[i] = "\n".join(x for x, w, hit in zip(lines, who, long, strict=True) if not hit and not (len(w) >= min_docs and min(w) != i))
    return out


def test_lines_equal_brute_force(spark, docs):
    extra = [(50_000 + i, f"Served page {i} of the old archive now\nunique words of row number {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]}\nuser {'ann bob cat dan eve'.split()[i % 5]} has logged in from home") for i in range(14)]
    rows = docs + extra
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in templates.drop_recurring(df).collect()}
    assert got == _brute_lines(rows, templates.MIN_DOCS)
    assert got[50_003].count("\n") == 0 and got[50_000] == extra[0][1]


@pytest.mark.parametrize("n", [900, 1100])
def test_the_tree_is_as_deep_at_every_size(spark, n):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    df = spark.createDataFrame([(i, f"one single line that {name(i)} wrote in the log of the town") for i in range(n)], "doc_id long, text string")
    for max_leaf in (10, 1000, 5000):
        assert templates.drop_recurring(df, max_leaf=max_leaf).agg(F.sum("_n_dropped")).first()[0] == n - 1


def test_long_lines_recur_from_two_documents(spark):
    long, glued = " ".join(f"word{chr(97 + i % 26)}" for i in range(60)), "漢字" * 160
    own = lambda n: "\n".join(f"{chr(97 + n)} own line {chr(97 + k)} of a text that has more to say" for k in range(9))
    rows = [(1, f"a title of mine\n{long}"), (2, f"{long}\n{own(0)}"), (3, f"{glued}\nx"), (4, f"{own(1)}\n{glued}"), (5, f"{long}\n{long} once more\n{own(2)}"), (6, "漢字" * 50), (7, "漢字" * 50)]
    rows += [(8, f"{long}\na copy"), (9, f"a title of mine\n{long}")]
    got = {r.doc_id: r.text for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute_lines(rows, templates.MIN_DOCS)
    assert (got[2], got[4], got[5], got[7]) == (own(0), own(1), f"{long} once more\n{own(2)}", "漢字" * 50) and got[8] == rows[7][1] and got[9] == rows[8][1]


@pytest.mark.parametrize("percent", [30, 50, 60, 80, 85, 90, 95])
def test_a_passage_of_many_documents_stays_once(spark, percent):
    """A passage of 120 words in nine documents, at any share of their words, is left once by line and near dedup together."""
    passage = " ".join(f"shared{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    own = lambda n: " ".join(f"own{chr(97 + n)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120 * 100 // percent - 120))
    rows = [(i, f"{passage}\n{own(i)}" if i % 2 else f"{own(i)}\n{passage}") for i in range(1, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = templates.cleaned(df)
    assert {r.doc_id: r.text for r in lines.collect()} == _brute_lines(rows, templates.MIN_DOCS)
    left = simhash.deduplicate(lines).collect()
    assert sum(passage in r.text for r in left) == 1
    assert percent >= 85 or {r.doc_id for r in left} == set(range(1, 10))


def test_copies_of_copies_lose_the_same_lines(spark):
    passage, text = (" ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)) for w in ("p", "t"))
    rows = [(1, f"{passage}\nfirst of all"), (5, f"{passage}\n{text}"), (9, f"{passage}\n{text}"), (11, text), (12, f"{text}\nx")]
    got = {r.doc_id: r.text for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute_lines(rows, templates.MIN_DOCS) == {1: rows[0][1], 5: text, 9: text, 11: "", 12: "x"}


NAMES = (
    "score rejected lang_pred _hits _split _kept _short _long _d _mark _id _m _n_lines _n_dropped d mark pos line leaf whole size total at hits split kept n_lines n_dropped first "
    "id lead doc carried_0 carried_5 kind key shard slot block chunk nth words from_word part parts p all_words _key fp view root node u v"
).split() + ["a.b", "with space", "SCORE2"]


def test_stages_take_columns_of_any_name(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    plain, stage = docs, wide
    for name, step in corpus_pipeline.STAGES[:-1]:
        plain, stage = step(spark, plain, tiny).cache(), step(spark, stage, tiny).cache()
        got = stage.select(*docs.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr), name
        if name != "source_mixing":  # which makes documents of its own
            assert stage.columns == wide.columns
            assert stage.where(" or ".join(f"`{n}` <> concat('{n}', doc_id)" for n in NAMES)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, stage, tiny).count() > 0


def test_lines_of_repeated_and_missing_ids_and_very_long_texts(spark):
    many = "\n".join(f"entry of the log number {i}" if i % 2 else f"{i}" for i in range(40_000))
    rows = [(i, f"entry of the log number {i}\nkept {i}") for i in range(12)] + [(3, "entry of the log number 5\nsecond text"), (50, many)]
    rows += [(None, f"entry of the log number {i}\nlost {i}") for i in range(30)]
    got = templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by = {r.text.split("\n")[-1]: r for r in got}
    assert len(got) == len(rows) and by["second text"].text == "second text" and by["kept 0"].text.count("\n") == 1
    assert all(by[f"lost {i}"].text == f"lost {i}" for i in range(30))
    assert next(r for r in got if r.doc_id == 50)._n_dropped == 20_000


def test_large_leaves_are_parted(spark):
    rows = [(i, f"one two three {'abcdefghij'[i % 10]}x {'klmnopqrst'[i // 10]}y same tail") for i in range(60)] + [(100 + i, "one two three ax ky same tail") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = templates.drop_recurring(df, max_leaf=5).collect()
    assert sum(r._n_dropped for r in got if r.doc_id >= 100) == 12


@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=6, max_size=6), min_size=1, max_size=150), st.sampled_from([0.3, 0.5, 0.7, 0.9]))
@settings(max_examples=150, deadline=None)
def test_lookup_by_blocks_equals_comparing_all(lines, share):
    lines = [(" ".join(x),) for x in lines]
    assert templates._parse_leaf(lines, share, max_leaf=2) == templates._parse_leaf(lines, share, max_leaf=10**9)


def test_a_template_of_many_variants_is_dropped(spark):
    n = templates.MAX_LEAF + 200
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, f"Posted by user {name(i)} in forum of the old town\nonly here {name(i)} {name(i)}{name(i)} {name(3 * i)}") for i in range(n)]
    got = {r.doc_id: r.text for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t if i == 0 else t.split("\n")[1] for i, t in rows} == _brute_lines(rows, templates.MIN_DOCS)


def test_lines_edge_cases(spark, edge, none):
    got = templates.drop_recurring(edge, min_docs=2)
    assert got.count() == 15 and set(edge.columns) <= set(got.columns)
    assert {r.text for r in got.where("doc_id = 3").collect()} == {None}
    assert templates.drop_recurring(none).count() == 0


# --- 7


def test_topk_equals_its_twin(spark, tiny):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tiny}/embeddings.parquet'")
    assert sorted(map(tuple, topk.op7_exact_topk(spark, tiny).collect())) == sorted(duck.sql(topk.ORACLE).fetchall())


def test_topk_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    base = [[float(x) for x in np.round(rng.normal(size=4), 1)] for _ in range(8)]
    rows = [(i, base[i % 8]) for i in range(400)] + [(400, None), (500, [1.0, None, 0.0, 0.0]), (600, [float("nan")] * 4), (700, [float("inf")] * 4), (None, base[0]), (800, []), (0, base[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("q", F.lit(0))
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0).collect()))
    q = {i: [math.floor(1024 * float(np.float32(x))) for x in base[i % 8]] for i in range(400)}
    want = []
    for a in range(0, 400, 100):
        ranked = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in q if b != a)[:10]
        want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(ranked)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_beyond_float_precision(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 1.0]), (2, [3e9, 2.0]), (3, [-3e9, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, scale=1).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(2, 9 * 10**18 + 2), (1, 9 * 10**18 + 1), (3, -9 * 10**18)]


def test_topk_of_huge_components(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e300, -1e300]), (2, [-1e18, 0.0]), (3, [0.5, 0.25])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    most = (1 << 63) - 1
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, most), (3, most), (2, -most - 1)]


# --- 8


def test_languages_held_out(spark, tiny):
    truth = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "lang", "n_chars")
    got = langid.op8_language_id(spark, tiny).join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in got if r.n_chars > 200)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_languages_edge_cases(spark, edge, none, tiny):
    model = langid.fit(langid.training_sample(spark.read.parquet(f"{tiny}/documents.parquet")))
    got = {(r.doc_id): r for r in langid.identify(edge, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[3].score == 0 and got[3].rejected
    assert got[10].rejected or got[10].score < 0.5
    assert langid.fit([]) is None and langid.identify(none, None).count() == 0
    assert {r.lang_pred for r in langid.identify(edge, None).collect()} == {"und"}
    kept = langid.accepted(edge)
    assert kept.columns == edge.columns and {3, 4, 5}.isdisjoint({r.doc_id for r in kept.collect()})
    foreign = spark.createDataFrame([(1, "Быстрая лиса прыгает через ленивую собаку " * 10)], "doc_id long, text string")
    assert langid.identify(foreign, model).first().rejected


def test_most_frequent_languages_are_learned(spark):
    rows = [(i, f"text {i}", "aa" if i < 10 else "bb" if i < 40 else "zz") for i in range(120)]
    got = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=5, max_languages=2)
    assert collections.Counter(lang for lang, _ in got) == {"bb": 5, "zz": 5}


def test_grams_across_pieces(monkeypatch):
    text = "  Ünï code 漢字, тест!! and so on: plain words 12 here " * 40
    whole = langid.gram_counts([text])
    for size in (7, 64, 500):
        monkeypatch.setattr(langid, "_CHARS_AT_ONCE", size)
        pieces = langid.gram_counts([text, "x", text])
        assert (pieces[0][0] == whole[0][0]).all() and (pieces[0][2] == whole[0][0]).all() and pieces[1].tolist() == [whole[1][0], 1, whole[1][0]]


def test_grams_do_not_depend_on_neighbours():
    texts = ["1 ab", "", "--cd ef", "gh", "!"]
    together = langid.gram_counts(texts)
    for i, t in enumerate(texts):
        alone = langid.gram_counts([t])
        assert (alone[0][0] == together[0][i]).all() and alone[1][0] == together[1][i]


def test_repeated_ids_are_learned_from_once(spark):
    x, y, z = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    rows = [(x, f"text {i}", "aa") for i in range(500)] + [(y, "b", "aa"), (z, "c", "bb")]
    got = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(got) == sorted([("aa", langid.packed("text 0")), ("aa", langid.packed("b")), ("bb", langid.packed("c"))])


def test_lang_is_no_input(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = langid.fit(langid.training_sample(docs))
    a = langid.identify(docs.select("doc_id", "text"), model).orderBy("doc_id").collect()
    assert a == langid.identify(docs.withColumn("lang", F.lit("zz")), model).orderBy("doc_id").collect()


# --- 9


def test_fingerprints_equal_brute_force(spark, tiny, docs):
    got = {r.doc_id: r for r in sketches.op9_document_fingerprints(spark, tiny).collect()}
    for n, (i, text) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].edited_fingerprint == sketches.to_text(sketches.sketch(edited))
        assert got[i].near_next == sketches.compare(sketches.sketch(text), sketches.sketch(after))[0]


def _shingles(text, words=5):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def test_likeness_is_close_to_the_true_one(docs):
    """Against the whole shingle sets, by length class: mean error and bias."""
    errors = collections.defaultdict(list)
    for n, (_, text) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        x, y = _shingles(text), _shingles(edited)
        if x and y:
            got = sketches.compare(sketches.sketch(text), sketches.sketch(edited))[0]
            errors[0 if len(x) < 100 else 1 if len(x) < 400 else 2].append(got - len(x & y) / len(x | y))
    assert set(errors) == {0, 1, 2}
    for kind, most in ((0, 0.2), (1, 0.08), (2, 0.04)):
        assert np.mean(np.abs(errors[kind])) < most and abs(np.mean(errors[kind])) < 0.5 * most


def test_a_sketch_is_what_lies_below_the_threshold(docs):
    for _, text in docs[:40]:
        whole = {h >> 32 for h in sketches.shingle_hashes(text).tolist()}
        assert len(sketches.shingle_hashes(text)) == len(_shingles(text))
        assert sketches.sketch(text).tolist() == sorted(h for h in whole if h < sketches.FRACTION * 2**32)


@pytest.mark.parametrize("heavy", [7, None])
def test_successors_of_a_heavy_id(spark, heavy):
    rows = [(heavy, f"row number {i} of a heavy id") for i in range(120)] + [(i, f"other {i}") for i in range(0, 40, 3)] + [(None, "lost"), ((1 << 63) - 1, "last id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = {r.text: r.m for r in df.select("text", F.xxhash64("text").alias("m")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, marks[r[1]]))
    edited = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 4] + b[: len(a) // 4]).encode()).hexdigest()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"
    got = sketches.with_successor(df, sketches._Edited(5, 0.25), schema, names, range_bytes=100).collect()
    want = [(i, edited(t, order[(k + 1) % len(order)][1])) for k, (i, t) in enumerate(order)]
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == collections.Counter(want)


def test_short_texts_are_not_taken_for_equal(docs):
    """Only texts of the same shingles are alike 1, whatever they retain; errors of short texts are small on average."""
    words = [w for _, t in docs for w in t.split()][:3000]
    short = [" ".join(words[i : i + n]) for n in (4, 5, 6, 8, 12) for i in range(0, 2000, n)]
    errors = []
    for x, y in zip(short, short[1:] + [short[0].upper()], strict=True):
        a, b = sketches.sketch(x), sketches.sketch(y)
        true = len(_shingles(x) & _shingles(y)) / len(_shingles(x) | _shingles(y))
        got = sketches.compare(a, b)[0]
        assert (got == 1.0) == (true == 1.0) and got <= sketches._most_alike(a, b)
        back = sketches.from_text(sketches.to_text(a))
        assert back.whole == a.whole and sketches.compare(back, b)[0] == got
        errors.append(abs(got - true))
    assert sum(not len(sketches.sketch(x)) for x in short) > 20 and np.mean(errors) < 0.1
    edited = [(x, x + " tail") for x in short]
    assert np.mean([abs(sketches.compare(sketches.sketch(x), sketches.sketch(y))[0] - len(_shingles(x) & _shingles(y)) / len(_shingles(x) | _shingles(y))) for x, y in edited]) < 0.25
    assert all(sketches.compare(sketches.sketch(x), sketches.sketch(y))[0] < 1.0 for x, y in edited)
    assert sketches.merge(sketches.sketch(short[0]), sketches.sketch(short[1])).whole is None


def test_sketches_merge_and_round_trip(docs):
    a, b = docs[0][1], docs[1][1]
    both = sketches.merge(sketches.sketch(a), sketches.sketch(b))
    true = np.union1d(sketches.shingle_hashes(a), sketches.shingle_hashes(b))
    assert both.tolist() == [h for h in np.unique(true >> np.uint64(32)).tolist() if h < sketches.FRACTION * 2**32]
    assert (sketches.from_text(sketches.to_text(both)) == both).all()
    assert sketches.compare(sketches.sketch(""), sketches.sketch(" \n"))[0] == 1.0
    assert sketches.compare(sketches.sketch(a), sketches.sketch(""))[0] == 0.0


def test_fingerprints_edge_cases(spark, edge, none, tmp_path):
    for name, df, n in (("e", edge, 15), ("n", none, 0), ("o", edge.where("doc_id = 1"), 1)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = sketches.op9_document_fingerprints(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == n
    assert got[0].near_next == 1.0


# --- 10


def test_groups_equal_brute_force(spark, docs):
    near = [(70_000 + i, docs[0][1] + " tail" * i) for i in range(4)]
    rows = docs + near + [(80_000, ""), (80_001, None)]
    got = {r.doc_id: r for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    prints = {i: simhash.simhash64(t) & (2**64 - 1) for i, t in rows}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {i: (r.fp & (2**64 - 1), r.component_id) for i, r in got.items()} == {i: (prints[i], find(i)) for i in ids}


def test_simhash_by_its_definition():
    import xxhash

    text = "The THE the cat Éa sat\x0bon the mat the the the cat"
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.simhash64(text) & (2**64 - 1) == want
    assert simhash.simhash64("One  two") & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("at_once", [6_000_000, 3000])
def test_ball_hashing_finds_all_links(spark, at_once):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 60)
    rows = [int(b) for b in base] + [int(b) ^ sum(1 << int(x) for x in rng.choice(62, 4, replace=False)) for b in base[:40]]
    rows = sorted(set(rows))
    df = spark.createDataFrame([(r,) for r in rows], "fp long")
    links = simhash.fingerprint_links(df, 4, at_once=at_once).collect()
    parent = {r: r for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        assert ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 4
        a, b = find(r.u), find(r.v)
        parent[max(a, b)] = min(a, b)
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                assert find(a) == find(b)


def test_near_copies_equal_brute_force(spark, docs):
    def edited(text, n, seed):
        words = text.split(" ")
        for k in np.random.default_rng(seed).choice(len(words), n, replace=False):
            words[k] = f"edit{seed}x{k}"
        return " ".join(words)

    base = max((t for _, t in docs if 1500 < len(t) < 4000), key=len)
    n = len(base.split(" "))
    rows = docs[:120] + [(90_000, base)] + [(90_001 + i, edited(base, max(1, n * (i % 5 + 1) // 250), i)) for i in range(25)] + [(95_000, base + " one more"), (95_001, None), (95_002, "")]
    got = dict(simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "component_id").collect())
    sets = {i: set(sketches.shingle_hashes(t or "").tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    text = {i: t or "" for i, t in rows}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if text[a] == text[b] or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in ids}


@pytest.mark.parametrize("length", [100, 400])
def test_near_copies_with_edited_passages(spark, length):
    rng = np.random.default_rng(7)
    some = lambda n: [f"w{int(w)}" for w in rng.zipf(1.3, n) % 5000]
    rows, pairs = [], []
    for n in range(90):
        words = some(length)
        cut = int(length * (0.16, 0.12, 0.08)[n % 3])
        near = (words + some(cut), words[: length - cut], words[:20] + some(cut // 2) + words[20 + cut // 2 :])[n // 3 % 3]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(near))]
        a, b = (set(sketches.shingle_hashes(t, 5).tolist()) for _, t in rows[-2:])
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append(2 * n)
    got = dict(simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "component_id").collect())
    assert len(pairs) > 60 and [i for i in pairs if got[i + 1] != i] == []


def test_members_apart_from_the_head_meet_each_other(spark):
    base = [f"base{i}" for i in range(200)]
    other = base[:60] + [f"other{i}" for i in range(30)] + base[90:]
    tail = lambda i, n: [f"tail{i}x{k}" for k in range(n)]
    groups = [base + tail(0, 20), other + tail(1, 4), other + tail(2, 4), other + tail(3, 4), base[:100] + tail(4, 40), *[base + tail(i, 20 + i) for i in range(5, 40)]]
    rows = [(i, " ".join(w)) for i, w in enumerate(groups)]
    sets = [set(sketches.shingle_hashes(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = dict(simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), views=1).select("doc_id", "component_id").collect())
    assert got == dict(enumerate(root)) and root[2] == 1 and len(set(root)) > 2


def _alike_groups(rows, least=0.8):
    """Components of (key, text) at a Jaccard similarity of five-word shingles, by comparing all."""
    sets = {k: _shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_near_copies_of_the_same_words_in_other_order(spark):
    words = [f"w{i}" for i in range(150)]
    rows = []
    for n in range(20):
        own = list(np.random.default_rng(n).permutation(words))
        rows += [(2 * n, " ".join(own)), (2 * n + 1, " ".join([*own[:-1], "end"]))]
    got = dict(simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "component_id").collect())
    assert got == _alike_groups(rows) == {i: i // 2 * 2 for i, _ in rows}


def test_near_copies_that_share_most_of_a_page(spark):
    """A crowd at 0.6 to 0.75, in it chains of 0.8 and a hub: groups of a band part into many."""
    rng = np.random.default_rng(11)
    page = [f"page{i}" for i in range(150)]
    own = lambda k, n: [f"own{k}x{j}" for j in range(n)]
    rows = [(k, " ".join(page + own(k, int(rng.integers(20, 30))))) for k in range(60)]
    rows += [(100 + k, " ".join(page[: 150 - 8 * k] + own(99, 20) + own(98, 8 * k))) for k in range(8)]
    hub = page[:60] + own(97, 140)
    rows += [(200 + k, " ".join([*hub[: 10 * k], f"cut{k}a", f"cut{k}b", f"cut{k}c", *hub[10 * k + 3 :]])) for k in range(12)] + [(300, " ".join(hub))]
    got = dict(simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), views=1).select("doc_id", "component_id").collect())
    want = _alike_groups(rows)
    assert got == want and len(set(want.values())) > 20


def test_texts_of_one_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (3, "c " * 30)]
    got = sorted((r.doc_id, r.text) for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, a), (1, b), (3, "c " * 30)])


def test_hot_prefixes_are_dealt_again(spark):
    rng = np.random.default_rng(5)
    base = [0x7A5A_0000_0000_0000 + int(x) for x in rng.integers(0, 1 << 30, 80)]
    rows = sorted({*base, *[b ^ (1 << int(x)) ^ (1 << int(y)) for b, (x, y) in zip(base, rng.choice(62, (80, 2)), strict=True)], *map(int, rng.integers(0, 1 << 62, 40))})
    find = lambda most: {
        frozenset((r.node, r.root)) for r in simhash.connected_components(simhash.fingerprint_links(spark.createDataFrame([(r,) for r in rows], "fp long"), most=most)).collect()
    }
    assert find(20) == find(10**9) and len(find(20)) > 50


def test_dedup_keeps_one_of_each_group(spark, edge, none):
    kept = simhash.deduplicate(edge).collect()
    ids = collections.Counter(r.doc_id for r in kept)
    assert ids[1] == 1 and ids[2] == 0 and ids[None] == 1 and max(ids.values()) == 1
    assert simhash.deduplicate(none).count() == 0


# --- pipeline


def test_pipeline_equals_its_stages_by_hand(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.fit(langid.training_sample(docs))
    kept = {i: r.text for i, r in rows.items() if not model.predict([r.text or ""])[2][0]}
    cleaned = _brute_lines(sorted(kept.items()), templates.MIN_DOCS)
    sets = {i: set(sketches.shingle_hashes(t).tolist()) for i, t in cleaned.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if cleaned[a] == cleaned[b] or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    single = {i: cleaned[i] for i in ids if find(i) == i}
    want, _ = _targets([(i, rows[i].source, len(re.findall(mixing.WORD, t))) for i, t in single.items()])
    stage = docs
    seen = []
    for _, step in corpus_pipeline.STAGES[:-1]:
        stage = step(spark, stage, tiny).cache()
        assert stage.columns == docs.columns
        seen.append(stage)
    assert {r.doc_id for r in seen[0].collect()} == set(kept)
    assert {r.doc_id: r.text for r in seen[1].collect()} == cleaned
    assert {r.doc_id: r.text for r in seen[2].collect()} == single
    taken = {r.source: r.n for r in seen[3].groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    assert all(abs(taken.get(s, 0) - want[s]) <= 1 for s in want)
    packed = corpus_pipeline.run(spark, tiny).collect()
    assert {r.doc_id for r in packed} <= set(single)
    assert all(sum(r.length for r in rows_) <= 1024 for rows_ in _by(packed, "sequence_id").values())


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) < set(queries.QUERIES) and all(isinstance(sql, str) for sql in queries.ORACLES.values())
