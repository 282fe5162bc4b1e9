"""The transducer, the Merkle manifest and the run detector against the library and brute force."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamline.llm import merkle, periodic, queries, topk, transducer
from loamline.llm.spans import mix

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["TEXT_", "ids", "node", "tree", "index_", "value_", "runs", "count_", "at_", "witness", "group_"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.WORD_FILE)


@pytest.fixture(scope="module")
def coder():
    return transducer.transducer(queries.WORD_FILE)


@pytest.fixture(scope="module")
def odd_rows():
    long = " ".join(f"w{i % 7000}" for i in range(60_000))
    return [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, "   \n\t ", "en", None, 6),
        (3, "   \n\t ", "en", None, 6),
        (4, "Ab ab " * 40, "en", "a", 9),
        (5, long, "en", "b", 10),
        (6, "x" * 300_000, "en", "b", 10),
        (6, "Ünïcode ΣΑΣ <|endoftext|> don't 日本語 " * 9, "en", "b", 10),
        (None, "no id", "en", "a", 1),
        (None, None, None, None, None),
    ]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# The transducer.


def ids_of(coder, text, size=None):
    blocks = [text] if size is None else [text[i : i + size] for i in range(0, len(text), size)]
    return np.frombuffer(b"".join(coder.stream(blocks)), "<u4").tolist()


def test_op11_equals_the_library(spark, docs, library):
    rows = {r.doc_id: r for r in queries.QUERIES["op11_word_bpe"](spark, SF_DIR).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


PARTS = st.sampled_from(
    ["transc", "end", "ing", "ation", "'", "'s", "'re", "ll", "r", "e", " ", "\x1c", " ", "Σ", "İ", "é", "é",
     "̣̇", "각", "가", "日本", "0", "12", "!?", "_", "<|endoftext|>", "<|endof", "😂", "❤️", "Ɤ", "A" * 70]
)


@settings(max_examples=60, deadline=None)
@given(st.lists(PARTS, max_size=60), st.integers(1, 90))
def test_blocks_of_any_size_give_the_librarys_ids(parts, size):
    coder, library = transducer.transducer(queries.WORD_FILE), Tokenizer.from_file(queries.WORD_FILE)
    text = "".join(parts)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(coder, text, size) == want
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == want
    cut = [np.array(want[i : i + size], np.int64) for i in range(0, len(want), size)]
    assert "".join(coder.read(cut)) == library.decode(want, skip_special_tokens=False)


def test_long_words_are_given_out_within_the_lookahead(coder, library):
    draw = random.Random(4)
    names = [t.removesuffix("</w>") for t in library.get_vocab() if t.isascii() and t.removesuffix("</w>").isalpha()]
    word = "".join(draw.choice(names).lower() for _ in range(3000))
    stream, ids = transducer.TokenStream(coder.merges), []
    for i in range(0, len(word), 50):
        ids += stream.feed(word[i : i + 50].encode())
        assert len(stream.held) <= stream.window
    ids += stream.feed(b"", True)
    assert ids == library.encode(word, add_special_tokens=False).ids


def test_lookahead_bounds_what_a_continuation_changes(coder):
    m, draw = coder.merges, random.Random(8)
    for _ in range(200):
        common = bytes(draw.choice(b"abcdehinorst") for _ in range(400))
        seen = []
        for _ in range(2):
            word = common + bytes(draw.choice(b"abcdehinorst") for _ in range(draw.randrange(0, 40)))
            ends = np.cumsum([m.sizes[t] for t in m.merge(m.symbols(word, True))])
            seen.append(set(ends[ends <= len(common) - m.lookahead].tolist()))
        assert seen[0] == seen[1]


def test_a_list_of_two_merges_looks_ahead_over_both():
    names = transducer.byte_names()
    vocab = {c: i for i, c in enumerate([*names, *[n + "$" for n in names], "bc", "ab"])}
    model = {"vocab": vocab, "merges": [["b", "c"], ["a", "b"]], "end_of_word_suffix": "$"}
    # Behind "ab" a "c" takes the b away, and so the a stays alone.
    assert transducer.MergeList(model).lookahead == 2
    chained = {"vocab": {**vocab, "za": len(vocab)}, "merges": [["b", "c"], ["a", "b"], ["z", "a"]], "end_of_word_suffix": "$"}
    assert transducer.MergeList(chained).lookahead == 3


def test_text_form_reads_back(coder):
    text = "don't stop 日本 naïve 12 !?"
    ids = np.frombuffer(coder.encode([text])[0], "<u4").astype(np.int64)
    read = "".join(coder.read([ids[i : i + 1] for i in range(len(ids))], "text"))
    assert read == "don 't stop 日本 naïve 1 2 !?"


def test_transducer_edges(spark, odd, odd_rows, none, library):
    coded = transducer.encode_texts(odd, queries.WORD_FILE, keep=["doc_id", "TEXT_", "at_"])
    read = transducer.decode_ids(coded, queries.WORD_FILE, keep=["doc_id", "ids", "at_"]).collect()
    want = [library.encode(r[1] or "", add_special_tokens=False).ids for r in odd_rows]
    got = [np.frombuffer(r.ids, "<u4").tolist() for r in read]
    assert sorted(got) == sorted(want)
    assert sorted(r.decoded for r in read) == sorted(library.decode(w, skip_special_tokens=False) for w in want)
    assert transducer.encode_texts(none, queries.WORD_FILE, keep=["doc_id"]).count() == 0


# The manifest.


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, arity=16):
    """(root, siblings of each node level by level), straight from the definition."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = level[at[i] // arity * arity : at[i] // arity * arity + arity]
            path.append((at[i] % arity, run[: at[i] % arity] + run[at[i] % arity + 1 :]))
            at[i] //= arity
        level = [sha("".join(level[k : k + arity])) for k in range(0, len(level), arity)]
    return level[0], paths


def plain_manifest(rows):
    """Rows (group, order, leaf, changed) to (leaf, subroot, root, proof, folded)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[g] = plain_tree([r[2] for r in groups[g]])
    root, tops = plain_tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        subroot, paths = trees[g]
        for r, path in zip(groups[g], paths):
            full, node = path + top, r[3] or r[2]
            for at, siblings in full:
                node = sha("".join([*siblings[:at], node, *siblings[at:]]))
            proof = sha("".join(s for _, siblings in full for s in siblings))
            out.append((r[1], r[2], subroot, root, proof, node, node == root))
    return out


def test_op12_equals_the_definition(spark, docs):
    rows = []
    for d in docs:
        fields = [d.doc_id, d.source, d.lang, d.n_chars]
        leaf, changed = leaf_of([*fields, d.text]), None
        if zlib.crc32(str(d.doc_id).encode()) % 5 == 0:
            text = d.text and re.sub("[A-Z]", lambda m: m[0].lower(), d.text)
            changed = leaf_of([*fields, text])
        rows.append((d.source, d.doc_id, leaf, changed))
    got = queries.QUERIES["op12_merkle_manifest"](spark, SF_DIR).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_manifest(rows))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1], [4096, 4097, 300], [1] * 40 + [9000]])
def test_trees_of_many_shapes(spark, sizes):
    rows = [(f"g{g:03}", i, sha(f"{g}/{i}"), None) for g, n in enumerate(sizes) for i in range(n)]
    draw = random.Random(1)
    frame = spark.createDataFrame(draw.sample(rows, len(rows)), "g string, i long, digest string, other string")
    made = merkle.manifest(frame, F.col("digest"), "g", "i")
    got = made.select(
        "i", "leaf", "subroot", "root", merkle.siblings_digest(F.col("witness")),
        merkle.folded(F.col("leaf"), F.col("witness")).alias("f"),
    ).withColumn("v", F.col("f") == F.col("root"))
    want = plain_manifest(rows)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert all(r[-1] for r in want)


def test_manifest_edges(spark, odd, odd_rows, none):
    leaf = merkle.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    made = merkle.manifest(odd, leaf, "source", "doc_id", keep=["tree", "value_"])
    got = made.select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("witness")),
        merkle.folded(F.col("leaf"), F.col("witness")), F.lit(True),
    ).collect()
    rows = [(r[3], r[0], leaf_of([r[0], r[3], r[2], r[4], r[1]]), None) for r in odd_rows]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(plain_manifest(rows), key=key)
    assert made.select("tree", "value_").distinct().collect() == [(7, 7)]
    assert merkle.manifest(none, leaf, "source", "doc_id").count() == 0


def test_witnesses_grow_with_each_completed_run():
    runs = merkle.Runs(2)
    for i in range(15):
        runs.append(sha(str(i)))
    assert all(not w for w in runs.witnesses)
    runs.append(sha("15"))
    assert all(len(w) == 1 for w in runs.witnesses)
    for i in range(16, 20):
        runs.append(sha(str(i)))
    root, paths = plain_tree([sha(str(i)) for i in range(20)])
    assert runs.close() == root
    assert [[(p, s) for p, s in w] for w in runs.witnesses] == [[(p, "".join(s)) for p, s in path] for path in paths]


# Periodic runs.


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_row(words):
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *head, sha(lines), sha(kept))


def test_op13_equals_brute_force(spark, docs):
    rows = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_periodic_runs"](spark, SF_DIR).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        words = re.findall("[^\x20\x09-\x0d]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n < 3000:
            assert rows[d.doc_id] == plain_row(words), d.doc_id


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 60), st.integers(1, 70), st.integers(1, 7)), max_size=6), st.integers(0, 999))
def test_runs_of_all_scales(shapes, seed):
    draw, texts = random.Random(seed), []
    for letters, noise, period, times in shapes:
        block = [draw.randrange(letters * 9) for _ in range(period)]
        texts.append([draw.randrange(letters) for _ in range(noise)] + block * times + block[: period // 2])
    texts.append([x for t in texts for x in t])
    values = mix(np.array([x for t in texts for x in t], np.uint64) + np.uint64(5))
    got = periodic.find_runs(values, np.array([len(t) for t in texts]))
    base, want = 0, []
    for t in texts:
        want += [(base + s, n, q) for s, n, q in plain_runs(t)]
        base += len(t)
    assert [tuple(r) for r in got.tolist()] == want


def test_periodic_edges(spark, odd, odd_rows, none):
    got = periodic.periodic_runs(odd, keep=["doc_id", "runs", "TEXT_"])
    assert got.columns == ["doc_id", "runs", "TEXT_", "runs_", "collapsed"]
    rows = periodic.periodic_runs(odd.drop("runs"), keep=["doc_id"]).collect()
    want = []
    for r in odd_rows:
        words = re.findall("[^\x20\x09-\x0d]+", r[1] or "")
        runs = [(0, 60_000, 7000)] if len(words) == 60_000 else plain_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert sorted(([tuple(x) for x in r.runs], r.collapsed) for r in rows) == sorted(want)
    assert periodic.periodic_runs(none, keep=["doc_id"]).count() == 0


# Vectors that bit slices cannot hold, and workers started elsewhere.


def test_large_components_are_ranked_exactly(spark):
    draw = random.Random(2)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    rows += [(100, [1e5, 0.0, 0.0]), (101, [1e5, 0.0, 0.0]), (150, [-1e300, 2.0, 1e300]), (151, [1.7e308, 0.0, 1.0])]
    rows += [(152, [1e300, 0.0]), (200, [float("inf"), 0.0, 0.0]), (201, None), (202, [float("nan"), 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>")
    found = topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5, "vec_id", "v").collect()
    usable = {i: [topk.whole(x, 256.0) for x in v] for i, v in rows if i < 200}
    want = []
    for q in (0, 50, 100, 150):
        scored = [(-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q and len(v) == 3]
        for rank, (score, i) in enumerate(sorted(scored)[:5], start=1):
            want.append((q, rank, i, max(-(2**63), min(2**63 - 1, -score))))
    assert sorted(tuple(r) for r in found) == want


def test_order_keys_sort_as_integers(spark):
    values = [0, 1, -1, 9, 10, -9, -10, 2**63 - 1, -(2**63), 10**400, -(10**400), 10**400 + 1, -(10**400) - 1]
    assert sorted(values, key=topk.order_key) == sorted(values)
    small = [v for v in values if abs(v) <= 2**63 - 1]
    frame = spark.createDataFrame([(v,) for v in small], "v long").select("v", topk._order_of(F.col("v")).alias("k"))
    assert {r.v: r.k for r in frame.collect()} == {v: topk.order_key(v) for v in small}


def test_workers_find_the_package_from_anywhere(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as entry\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print('rows', entry.queries()['op13_periodic_runs'](spark, {SF_DIR!r}).count())"
    )
    names = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=names, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
