"""Token files, vector codes and the prefix trie against plain Python, on small tables with every kind of odd row."""

import hashlib
import math
import random
import string
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.llm import prefix_trie, token_files, vector_codes

# ---- token files

P = pytest.importorskip("public_tokenizers")


def library(name="word_bpe_49k.json", ordinary=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = ordinary
    return t


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=200))
def test_ranks_round_trip(ranks):
    control, data = token_files.packed_ranks(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4) and len(data) == sum(1 if r < 1 << 8 else 2 if r < 1 << 16 else 3 if r < 1 << 24 else 4 for r in ranks)
    assert token_files.unpacked_ranks(control, data, len(ranks)).tolist() == ranks


def test_a_damaged_file_is_an_error():
    one = token_files.block(np.array([5, 6]), np.array([True, False]), np.array([3, 0]), np.array([1, 2, 70000])) + b"\n"
    (ids, known, sizes, ranks), again = token_files.blocks(one + one)
    assert ids.tolist() == [5, 6] and known.tolist() == [True, False] and sizes.tolist() == [3, 0] and ranks.tolist() == [1, 2, 70000] and again[3].tolist() == ranks.tolist()
    for bad in (one[:-3], one[:40] + b"?" + one[41:], one + b"RKT", b"x" + one):
        with pytest.raises(ValueError):
            list(token_files.blocks(bad))


ODD_TEXTS = [
    "", " ", "one two", "İstanbul İ ΑΣ ας ǅ ŉ ﬁ ß ẞ", "don't we'll 's 't I'VE", "a.b,c;d!!! ...", "x<|endoftext|>y <|startoftext|> <|endoftext|", "tab\tnew\nline\x0b\x0c\r\x1c\x1d\x85\xa0 　end", "é ẹ́ ́lone",
    "123 4५6 ½ ² Ⅷ", "日本語 テキスト 한국어 العربية", "😀😀 👩‍👩‍👧 a😀b", "_under_ __ a_b", "=≠ ≮", "w" * 5000, "É É é " * 50, "a" + "." * 300 + " b", "\x00\x01 \x7f", "(paren) [brack], {curly}. \"quote\"",
]


@pytest.mark.parametrize("ordinary", [False, True])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name, ordinary):
    with open(P.path(name), encoding="utf-8") as f:
        file = f.read()
    encode = token_files.encoder(file, token_files.word_ends(file)[1], ordinary)
    t, rng = library(name, ordinary), random.Random(3)
    letters = string.ascii_letters + "éßñüİΣσς'’.,!?-_ \t\n0123456789́🙂日"
    texts = ODD_TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]
    for again in range(2):  # all words are known the second time
        ids, sizes = encode(pa.array(texts, pa.large_string()))
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40).filter(lambda x: x.isprintable() or True), min_size=1, max_size=5))
def test_any_text(texts):
    texts = [x.encode(errors="replace").decode() for x in texts]
    ids, sizes = WORDS(pa.array(texts, pa.large_string()))
    want = [LIBRARY.encode(x, add_special_tokens=False).ids for x in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


LIBRARY = library()
WORDS = token_files.encoder(LIBRARY.to_str(), token_files.word_ends(LIBRARY.to_str())[1], False)


def test_token_files(spark, monkeypatch):
    """Small blocks and files: every document comes back, in order, with the ids before it."""
    rng = random.Random(5)
    rows = [(k * 3 % 101, rng.choice(ODD_TEXTS) + f" n{k % 7} word word") for k in range(101)] + [(7, "same row")] * 9 + [(None, "no id"), (None, None), (-5, None), (12, "x y " * 3000)]
    docs = spark.createDataFrame([(i, t, 1, "z", 2) for i, t in rows], "doc_id long, text string, n int, ids string, row int").repartition(5)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    with tempfile.TemporaryDirectory() as at:
        token_files.write(docs, f"file://{at}/t", P.path("word_bpe_49k.json"), 2, file_bytes=3000)
        got = token_files.starts(token_files.read(spark, f"file://{at}/t")).collect()
        assert len({r.file for r in got}) > 2
        table = spark.read.parquet(f"file://{at}/t/ranks").orderBy("rank").collect()
    want = [(i, LIBRARY.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    flat = [x for _, ids in want for x in ids]
    assert [r.n for r in table] == sorted((flat.count(x) for x in set(flat)), reverse=True) and {r.id: r.n for r in table} == {x: flat.count(x) for x in set(flat)}
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    as_read = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.ids_crc32) for r in got)
    assert as_read == sorted((str(i), x, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)


def test_no_documents_give_no_tokens(spark):
    with tempfile.TemporaryDirectory() as at:
        token_files.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{at}/t", P.path("word_bpe_49k.json"), 2)
        assert token_files.starts(token_files.read(spark, f"file://{at}/t")).count() == 0


# ---- vector codes


def plain_codes(rows, rounds=4, entries=256):
    """rows: (vec_id, vector, label); codes and errors by comparing everything with everything, in Python's integers."""
    kept = [(i, [math.floor(1024 * c) if abs(c) < 2**53 else int(c) * 1024 for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return [], None
    width = -(-max(1, *(len(v) for _, v, _ in kept)) // 4) * 4
    w = width // 4
    raw = {id(v): u for (_, v, _), u in zip(kept, [v for _, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)], strict=True)}
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, raw[id(r[1])]))[:entries]
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    books = [[(v + [0] * (width - len(v)))[p * w : p * w + w] for _, v, _ in first] for p in range(4)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(v[p * w : p * w + w], books[p])[1]].append(v[p * w : p * w + w])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else y for k, y in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        best = [nearest(v[p * w : p * w + w], books[p]) for p in range(4)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), 2**63 - 1)))
    return out, hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()


def vectors(kind):
    rng = random.Random(1)
    if kind == "empty":
        return []
    if kind == "few":
        return [(k, [rng.gauss(0, 1) for _ in range(8)], k % 3) for k in range(9)]
    near = [(k, [rng.gauss(k % 5, 0.3) for _ in range(8)], [None, 1, 2][k % 3]) for k in range(400)]
    odd = [(None, [0.5] * 8, None), (5, None, 1), (6, [1.0, None], 1), (7, [float("nan")] * 8, 1), (8, [float("inf")] * 8, 1), (9, [], 2), (10, [0.25, -0.25, 1.0], 2), (3, [1.0] * 8, 1), (3, [-1.0] * 8, 1)] + [(20, [0.125] * 8, 7)] * 200
    return near + odd + ([(1000, [1e30, -1e30] * 4, 1), (2, [3.4e38, 0.0, 1e17, -3e5, 1.5] + [0.0] * 3, None)] if kind == "large" else [])


@pytest.mark.parametrize("kind", ["empty", "few", "odd", "large"])
def test_vector_codes(spark, kind):
    rows = vectors(kind)[: 150 if kind == "large" else None] + (vectors(kind)[-2:] if kind == "large" else [])
    table = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, v string, code int").repartition(4)
    codes, books = vector_codes.encode(table, entries=64)
    got = [(r.vec_id, r.label, r.code, r.error) for r in codes.collect()]
    want, digest = plain_codes(rows, entries=64)
    key = lambda r: tuple(str(c) for c in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    if rows:
        assert vector_codes.digest(books) == digest
    if kind == "few":  # as many entries as vectors
        assert [r.v for r in vector_codes.decode(codes, books).orderBy("vec_id").collect()] == [[math.floor(1024 * c) / 1024 for c in v] for _, v, _ in rows]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-40, 40), min_size=3, max_size=3), min_size=1, max_size=40), st.lists(st.lists(st.integers(-60, 60), min_size=3, max_size=3), min_size=1, max_size=20))
def test_bounds_never_lose_the_nearest(entries, asked):
    entry, distance = vector_codes.Cells(np.array(entries)).nearest(np.array(asked))
    want = [min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(entries)) for x in asked]
    assert list(zip(distance.tolist(), entry.tolist(), strict=True)) == want


def test_limbs_add_up():
    whole = np.array([0, 1, -1, 2**30, -(2**30), 2**62, -(2**62), 12345678901234], np.int64)
    for total in (whole, np.array([*map(int, whole), 10**45, -(10**45)], object)):
        sums = [0] * len(total)
        for at, limb, value in vector_codes.limbs(total):
            for a, k, v in zip(at.tolist(), limb.tolist(), value.tolist(), strict=True):
                sums[a] += v << (30 * k)
        assert sums == total.tolist()


# ---- prefix trie


def plain_trie(convs):
    """Nodes of {conv_id: [(turn, code points)]} by grouping all prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (p[-1][1] if p else 0)
    for p, of in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), len(children[p]), leaves[p], saved[p], digest))
    return out


def keyed(convs):
    """(conv_id, key, code points) sorted as ranges are."""
    rows = [(c, "".join(hashlib.md5(repr(t).encode()).hexdigest() for t in turns), [t[1] for t in turns]) for c, turns in convs.items()]
    return sorted(rows, key=lambda r: (r[1], r[0]))


def nodes_of(ranges):
    """Both sweeps over ranges, as Spark runs them."""
    nodes, fragments = [], []
    for part, members in enumerate(ranges):
        for r in prefix_trie.swept(iter(members), part):
            (nodes if r["kind"] == "node" else fragments).append(r)
    fragments.sort(key=lambda r: (r["part"], r["step"], r["depth"], r["block"]))
    nodes += prefix_trie.stitched(iter(fragments))
    of = {n["id"]: n for n in nodes}
    assert len(of) == len(nodes)
    return [(n["conv_id"], n["depth"], n["parent"] and of[n["parent"]]["conv_id"], *(n[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends"))) for n in nodes]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1], r[0], r[7], r[3:7]))


TURNS = st.lists(st.sampled_from([("a", 1), ("b", 5), ("c", 0)]), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(-50, 500), TURNS, min_size=1, max_size=40), st.data())
def test_stacks_are_stitched_wherever_ranges_are_cut(convs, data):
    rows = keyed(convs)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(rows)), max_size=12)))
    ranges = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    assert ordered(nodes_of([r for r in ranges if r])) == ordered(plain_trie(convs))


def test_long_runs_of_one_conversation_are_hashed_in_blocks(monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    convs = {k: [("x", 3), ("y", 2)] if k % 3 else [("x", 3)] for k in range(300)}
    rows = keyed(convs)
    for size in (1, 10, 99, 300):
        assert ordered(nodes_of([rows[a : a + size] for a in range(0, 300, size)])) == ordered(plain_trie(convs))


@given(st.text("01", max_size=9), st.text("01", max_size=9))
def test_common_turns(a, b):
    wide = lambda x: "".join(c * prefix_trie.DIGEST for c in x)
    assert prefix_trie.common(wide(a), wide(b)) == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.md5((str(len((role or "").encode())) + ":" + (role or "") + (text or "")).encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, (role or "", text or ""), len(text or "")))
    own = {c: [(t[3], t[4]) for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def conversation_rows(kind):
    rng = random.Random(2)
    if kind == "empty":
        return []
    rows = [(c, t, "user" if t % 2 else "bot", f"t{rng.randrange(2)}") for c in range(0, 450, 3) for t in range(rng.randrange(1, 8))]
    odd = [(None, 1, "user", "nobody"), (7, None, None, None), (7, 2, None, "é😀"), (7, 2, "user", None), (7, 2, "user", None), (-5, 0, "a", "b"), (-300, 1, "a", "b"), (-301, 9, "", "long " * 30000), (901, 0, "user", "")]
    hot = [(1000 + k, t, "user", f"same {t}") for k in range(120) for t in range(3)]
    return rows + odd + hot + [(5000, t, "user", "x") for t in range(500)]


@pytest.mark.parametrize("kind", ["empty", "odd"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_conversation_trie(spark, kind, adaptive):
    rows = conversation_rows(kind)
    table = spark.createDataFrame([(c, t, r, x, 1, "k", 0) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, first int, key string, depth int").repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = [tuple(r) for r in prefix_trie.trie(prefix_trie.rows(prefix_trie.rebuilt(table))).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert ordered(got) == ordered(plain_trie(plain_rebuilt(rows)))


def test_tables_with_one_column_too_many_keep_their_results(spark):
    """The queries' operators read their own columns, whatever else there is."""
    turns = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "v", "b"), (2, 0, "u", "a")], "conv_id long, turn long, role string, text string")
    plain = prefix_trie.trie(prefix_trie.rows(prefix_trie.rebuilt(turns))).collect()
    extra = turns.select("*", *[F.lit(1).alias(c) for c in ("d", "n", "t", "turns", "lead", "points", "id", "parent")])
    assert sorted(map(str, prefix_trie.trie(prefix_trie.rows(prefix_trie.rebuilt(extra))).collect())) == sorted(map(str, plain))
