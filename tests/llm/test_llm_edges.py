"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.llm import (
    bpe,
    chat,
    cotraining,
    cross_polytope,
    jaccard,
    lengths,
    line_dedup,
    packing,
    queries,
    sharding,
    topk,
)
from loamline.llm.components import components
from loamline.session import scratch_path
from tests.llm.test_llm_queries import brute_components, brute_vectors, check_packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names the operators use inside, as columns of the caller.
CLASH = ["slot", "size", "host_", "keys_", "kept_", "n_dropped", "node", "key", "label", "rank", "cell", "ids", "id_", "text_"]


def words(seed, n, vocabulary=2000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    long = words(1, 60_000, 50_000)
    base = words(2, 80).split()
    near = [*base]
    near[40] = "changed"
    return [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, "   \n\t ", "en", None, 6),
        (4, "Two words", "en", "a", 9),
        (5, "two  WORDS", "en", "b", 10),
        (6, long, "en", "a", len(long)),
        (7, long + " end", "fr", "a", len(long) + 4),
        (8, " ".join(base), "en", "a", 1),
        (9, " ".join(near), "en", "a", 1),
        (9, " ".join(near), "en", "a", 1),
        (10, "é 日本語 　 x y <|endoftext|> z\n\n", "de", "c", 20),
        (11, "one two three four five", "en", "a", 1),
        (12, "one two three four five six", "en", "a", 1),
        (13, "a b c d e f g", "en", "a", 1),
        (14, "a b c d e f g h", "en", "a", 1),
        (None, " ".join(base), "en", "a", 1),
        (None, "lonely text without an id at all", "en", "a", 1),
    ]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    frame = spark.createDataFrame(odd_rows, DOCS)
    return frame.select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding_edges(spark, odd, none):
    def sharded(df, path):
        return sharding.shard_rows(df, 3, path, ["doc_id", "text"], sharding.size_of(F.col("text")), slots=8)

    rows = sharded(odd, scratch_path(spark, "map")).collect()
    assert len(rows) == 17 and {len(r.row) for r in rows} == {len(odd.columns)}
    for shard in range(3):
        places = [r.place for r in rows if r.shard == shard]
        assert sorted(places) == list(range(len(places)))
    assert sharded(none, scratch_path(spark, "map")).count() == 0


def test_rebalancing_moves_only_what_it_must(spark, odd):
    path = scratch_path(spark, "map")
    size = sharding.size_of(F.col("text"))
    docs = spark.range(5000).select("id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    before = {r.row.id: r for r in sharding.shard_rows(docs, 4, path, ["id"], size).collect()}
    after = {r.row.id: r for r in sharding.reshard_rows(docs, 5, path, ["id"], size).collect()}
    assert {i: r.slot for i, r in before.items()} == {i: r.slot for i, r in after.items()}
    moved = [i for i in after if before[i].shard != after[i].shard]
    assert 0 < len(moved) < 0.25 * len(after) and {after[i].shard for i in moved} == {4}
    totals = [sum(r.size for r in after.values() if r.shard == k) for k in range(5)]
    assert max(totals) < 1.02 * min(totals)
    assert sharding.read_map(spark, path, 0).count() == sharding.read_map(spark, path).count() == sharding.SLOTS
    assert {r.shard for r in sharding.reshard_rows(docs, 2, path, ["id"], size).collect()} == {0, 1}
    sharding.write_shards(sharding.shard_rows(docs, 4, scratch_path(spark, "map"), ["id"], size), out := scratch_path(spark, "out"))
    assert spark.read.parquet(out).count() == 5000


def test_chat_edges(spark):
    rows = [
        (1, 2, "assistant", "b\\+c[INST]<s>\\o"),
        (1, 1, "user", None),
        (1, 1, "user", "tie"),
        (1, 3, "assistant", "more"),
        (1, None, "system", "first"),
        (2, 1, None, "]odd[/ROLE]"),
        (2, 2, "tool]:[x", ""),
        (None, 1, "user", "x"),
        (3, 1, "assistant", "same"),
        (3, 1, "assistant", "same"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("row", F.lit(1))
    made = chat.format_conversations(frame)
    out = {
        r.conv_id: r
        for r in made.select(
            "*",
            chat.read_turns(F.col("formatted")).alias("read"),
            chat.loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss"),
        ).collect()
    }
    assert [tuple(t) for t in out[1].read] == [
        ("system", "first"), ("user", ""), ("user", "tie"), ("assistant", "b\\+c[INST]<s>\\o"), ("assistant", "more")
    ]
    assert out[1].loss == ["b\\+c[INST]<s>\\o", "more"] and len(out[1].loss_mask) == 1
    assert [tuple(t) for t in out[2].read] == [("", "]odd[/ROLE]"), ("tool]:[x", "")] and out[2].loss == []
    assert out[3].loss == ["same", "same"] and out[None].formatted == "[INST]x[/INST]"
    assert chat.format_conversations(frame.limit(0)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x"]), st.text("a\\[]<>+sblo/INT ", max_size=12)), min_size=1, max_size=6))
def test_chat_reads_back_any_text(spark, turns):
    frame = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(frame)
    row = made.select(
        chat.read_turns(F.col("formatted")).alias("read"),
        chat.loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss"),
    ).first()
    assert [tuple(t) for t in row.read] == turns
    assert row.loss == [t for r, t in turns if r == "assistant"]


@pytest.fixture(scope="module")
def own():
    ranks = bpe.Vocabulary.read(queries.RANKS).ranks
    return tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab the ' s\n\t 　é日1!<|x"), max_size=40))
def test_encoder_agrees_with_the_library(own, text):
    code = bpe.encoder(queries.RANKS, queries.PATTERN)
    ids = code.encode(text)
    assert ids == own.encode_ordinary(text)
    data, _ = code.decode_ids(np.array(ids, "<u4"), np.array([0, len(ids)]))
    assert bytes(data).decode() == text


def test_prefixes_append_and_edit(own):
    words_ = bpe.encoder(queries.RANKS, queries.PATTERN).vocabulary
    table = bpe.Prefixes(words_, b"internation")
    assert table.append(b"alisation").ids() == bpe.Prefixes(words_, b"internationalisation").ids()
    assert table.replace(5, 11, b"xyz").ids() == bpe.Prefixes(words_, b"interxyzalisation").ids()
    assert table.last == bpe.Prefixes(words_, bytes(table.data)).last
    assert bpe.Prefixes(words_, b"x" * 3000).ids() == own.encode_ordinary("x" * 3000)
    assert bpe.Prefixes(words_).ids() == []


def test_bpe_edges(odd, none, odd_rows, own):
    coded = bpe.encode_texts(odd, queries.RANKS, queries.PATTERN, keep=["doc_id", "size"])
    rows = bpe.decode_ids(coded, queries.RANKS, queries.PATTERN, keep=["doc_id", "ids"]).collect()
    found = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded).decode()) for r in rows)
    assert found == sorted((i or -1, own.encode_ordinary(t or ""), t or "") for i, t, *_ in odd_rows)
    assert bpe.encode_texts(none, queries.RANKS, queries.PATTERN, keep=["doc_id"]).count() == 0


def test_packing_edges(spark, odd, none, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in odd_rows[:9] + odd_rows[10:15]}
    assert 50256 in ids[10]
    single = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces, placed = packing.pack_documents(single, queries.RANKS, queries.PATTERN, special=queries.SPECIAL)
    check_packing(placed.collect(), ids)
    flat = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(pieces, placed).collect()}
    assert sum(map(len, flat.values())) == sum(map(len, ids.values()))
    _, everything = packing.pack_documents(odd, queries.RANKS, queries.PATTERN, special=queries.SPECIAL)
    rows = everything.collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack_documents(none, queries.RANKS, queries.PATTERN)[1].count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 40), max_size=12))
def test_patterns_place_the_whole_histogram(counts):
    patterns = packing.pack_histogram(counts, 32)
    placed = dict.fromkeys(counts, 0)
    for packs, content in patterns:
        assert packs > 0 and sum(size * times for size, times in content) <= 32
        for size, times in content:
            placed[size] += packs * times
    assert placed == counts


def test_length_edges(odd, none, odd_rows, own):
    sizes = np.array([len(own.encode_ordinary(t or "")) for _, t, *_ in odd_rows])
    table = lengths.context_table(lengths.length_histogram(odd, queries.RANKS, queries.PATTERN))
    at = {r.context_limit: r for r in lengths.totals_at(table, [0, 7, 2048, 10**7]).collect()}
    for limit, r in at.items():
        assert (r.n_docs, r.docs_cut, r.truncated_total) == (17, (sizes > limit).sum(), np.minimum(sizes, limit).sum())
    for r in lengths.quantiles(table, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == sorted(sizes)[max(0, math.ceil(r.share * 17) - 1)]
    empty = lengths.length_histogram(none, queries.RANKS, queries.PATTERN)
    assert lengths.context_table(empty).count() == 0
    assert [tuple(r)[1:] for r in lengths.totals_at(lengths.context_table(empty), [5]).collect()] == [(0, 0, 0)]
    assert [tuple(r) for r in lengths.context_table(empty, [5], [0.5]).collect()] == [(5, 0, 0, 0, 0, 0, [])]


def test_length_limits_between_lengths(spark):
    sizes = np.array([3, 3, 10, 10, 10, 2000, 5000, 5000, 70000])
    counted = spark.createDataFrame([(int(n), int((sizes == n).sum())) for n in set(sizes)], "n_tokens long, n_docs long")
    limits, shares = [0, 2, 3, 4, 1024, 4999, 70000, 10**6], [0.0, 0.2, 0.5, 0.99, 1.0]
    table = lengths.context_table(counted, limits, shares)
    rows = {r.n_tokens: r for r in table.collect()}
    assert set(rows) == set(sizes.tolist()) | set(limits)
    for n, r in rows.items():
        assert (r.n_docs, r.docs_up_to, r.docs_from) == ((sizes == n).sum(), (sizes <= n).sum(), (sizes >= n).sum())
        assert r.truncated_total == np.minimum(sizes, n).sum()
    named = {p: n for n, r in rows.items() for p in r.quantile_of}
    assert named == {p: int(np.sort(sizes)[max(1, math.ceil(p * 9)) - 1]) for p in shares}
    for source in (table, lengths.context_table(counted)):
        for r in lengths.totals_at(source, limits).collect():
            n = r.context_limit
            assert (r.n_docs, r.docs_cut, r.truncated_total) == (9, (sizes > n).sum(), np.minimum(sizes, n).sum())
        assert {r.share: r.n_tokens for r in lengths.quantiles(source, shares).collect()} == named


def test_line_dedup_edges(spark, odd, none):
    kept = line_dedup.drop_template_lines(odd)
    assert kept.columns[: len(odd.columns)] == odd.columns and len(kept.columns) == len(odd.columns) + 1
    assert kept.count() == 17 and line_dedup.drop_template_lines(none).count() == 0
    rows = [(i, f"menu\nbody {words(i, 9)}\n\n menu \r\nmenu", "h") for i in range(20)]
    rows += [(100 + i, "copy one\ncopy two", "h") for i in range(10)] + [(200, "menu\nother", None), (201, None, "h"), (202, "", "h")]
    rows += [(300, "menu\nonce on another host", "g")]
    out = {r.doc_id: r for r in line_dedup.drop_template_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i].text == f"body {words(i, 9)}\n" and out[i].n_dropped == 3 for i in range(20))
    # Whole copies are left to another operator, and so is what has no host.
    assert all(out[100 + i].text == "copy one\ncopy two" and out[100 + i].n_dropped == 0 for i in range(10))
    assert out[200].text == "menu\nother" and out[201].text is None and out[202].text == "" and out[300].n_dropped == 0


def test_line_dedup_cuts_pages_that_are_nearly_all_template(spark):
    header, footer = "Home | Shop | About us | Contact", "All rights reserved by the owner"
    rows = [(i, f"{header}\nbody {i}\n{footer}", "h") for i in range(20)]
    # Many copies of one text are one page: their lines are no template, and make no others rare.
    rows += [(100 + i, "copy one\ncopy two", "h") for i in range(2000)]
    # Nothing or only blanks may be left.
    rows += [(5000, f"{header}\n{footer}", "h"), (5001, f"{header}\n", "h"), (5002, "", "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_template_lines(frame).collect()}
    assert {i: out[i] for i in range(20)} == {i: (f"body {i}", 2) for i in range(20)}
    assert all(out[100 + i] == ("copy one\ncopy two", 0) for i in range(2000))
    assert (out[5000], out[5001], out[5002]) == (("", 2), ("", 1), ("", 0))


def test_jaccard_edges(odd, none, odd_rows):
    rows = jaccard.jaccard_components(odd).collect()
    want = brute_components({i: t for i, t, *_ in odd_rows if i is not None})
    named = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert named == want and len(rows) == 17
    assert {r.component_id for r in rows if r.doc_id is None} == {8, None}
    assert jaccard.jaccard_components(none).count() == 0
    stays = jaccard.one_per_component(odd)
    assert stays.columns == odd.columns
    kept = sorted(i for i, (_, c) in want.items() if i == c)
    assert sorted(r.doc_id for r in stays.filter("doc_id IS NOT NULL").collect()) == kept


def test_jaccard_links_at_the_threshold_for_every_size(spark):
    """Sets of all sizes that share just enough, or just not enough, in every band."""
    draw = random.Random(5)
    docs, at = {}, 0
    for size in [*range(1, 60), 75, 76, 77, 99, 100, 101, 150, 237, 240, 300, 500, 749, 751, 1000, 1500, 2400, 5000]:
        for extra in (0, 1):
            text = [f"t{at}x{k}" for k in range(size + 4)]
            # Cutting from an end leaves a subset: the overlap is the smaller set.
            short = max(1, math.ceil(0.75 * size) - extra)
            docs[at], docs[at + 1] = " ".join(text), " ".join(text[: short + 4])
            # Changing words in the middle removes five shingles each and adds five.
            other = [*text]
            for k in draw.sample(range(len(other)), min(len(other), max(1, size // 45))):
                other[k] = "y"
            docs[at + 2] = " ".join(other)
            at += 3
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame).collect()}
    assert found == brute_components(docs)


def test_crowded_sets_get_finer_parts(spark, monkeypatch):
    """With far too few parts, sets whose parts could all differ are found by later levels."""
    monkeypatch.setattr(jaccard, "LOADS", np.full(len(jaccard.TOPS), 400.0))
    docs = {}
    for i in range(12):
        text = words(i, 60).split()
        docs[2 * i] = " ".join(text)
        text[30] = "other"
        docs[2 * i + 1] = " ".join(text)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame).collect()}
    assert found == brute_components(docs)


def test_a_common_passage_is_no_link_and_large_tiles_are_cut(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    passage = words(99, 60)
    docs = {i: f"{passage} {words(i, 60)}" for i in range(60)}
    docs |= {100 + i: f"{passage} {words(1, 60)} tail{i}" for i in range(30)}
    docs |= {200 + i: f"{words(200 + i // 2, 100)}{' x' * (i % 2)}" for i in range(20)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame).collect()}
    assert found == brute_components(docs)


def test_near_copies_look_for_partners_in_few_tiles(spark, monkeypatch):
    """Rows of the first pass over large tiles grow with documents, not with the tiles that they share."""
    seen, survivors = [], jaccard.tile_survivors

    def counted(members, maps, hubs=False):
        if hubs:
            seen.append((members.count(), members.select("node").distinct().count()))
        return survivors(members, maps, hubs)

    monkeypatch.setattr(jaccard, "tile_survivors", counted)
    # Without sketches nothing is linked beforehand.
    monkeypatch.setattr(jaccard, "first_partners", lambda sizes: sizes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    docs, draw = {}, random.Random(8)
    for i in range(60):
        text = words(3, 300).split()
        for k in draw.sample(range(300), 5):
            text[k] = f"o{i}x{k}"
        docs[i] = " ".join(text)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame).collect()}
    assert found == brute_components(docs)
    assert seen and all(rows <= jaccard.HUB_TILES * nodes for rows, nodes in seen)


def test_nodes_short_for_the_same_both_stay_members(spark):
    one, other = 77, 77 + (5 << 8 * jaccard.NODE_BYTES)
    members = spark.createDataFrame([(k, 77, True, 77, 1) for k in range(6)], "key long, short long, own boolean, label long, crowd int")
    sizes = spark.createDataFrame([(one, 4, 2, 0), (other, 4, 1, 0), (78, 4, 0, 0)], "node long, band long, spare long, spare_up long")
    kept = jaccard.without_spare(members, sizes).groupBy("node").count().collect()
    assert {r["node"]: r["count"] for r in kept} == {one: 4, other: 5}


def test_bit_counts_bound_the_overlap():
    draw = np.random.default_rng(3)
    for _ in range(50):
        common = draw.integers(0, 2**63, 40).astype(np.uint64)
        a = np.unique(np.concatenate([common, draw.integers(0, 2**63, draw.integers(0, 30)).astype(np.uint64)]))
        b = np.unique(np.concatenate([common, draw.integers(0, 2**63, draw.integers(0, 30)).astype(np.uint64)]))
        maps = [jaccard.bitmaps(x, np.array([0, len(x)]), 128)[0] for x in (a, b)]
        for width in (128, 64):
            x, y = (jaccard.folded(m, width) for m in maps)
            differ = int(np.bitwise_count(x ^ y).sum())
            assert (len(a) + len(b) - differ) // 2 >= len(np.intersect1d(a, b))


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(200)]
    links += [(5000, 5001 + i) for i in range(300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("vector", F.lit(2))


ODD_VECTORS = [None, [], [0.0, 0.0], [1.0, None], [math.nan, 1.0], [math.inf, 1.0]]


def test_vector_edges(spark):
    draw = np.random.default_rng(1)
    base = draw.standard_normal((40, 16))
    rows = {i: base[i].tolist() for i in range(40)}
    rows |= {100 + i: (base[i] + 0.05 * draw.standard_normal(16)).tolist() for i in range(40)}
    rows |= {200 + i: (3 * base[0]).tolist() for i in range(5)} | {300: [1e200, 2e200], 301: [1.0, 2.0], 302: [1.0]}
    odd_ = [(900 + i, v) for i, v in enumerate(ODD_VECTORS)]
    found = cross_polytope.near_duplicates(vectors(spark, [*rows.items(), *odd_])).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in found}
    rows[300] = [1.0, 2.0]  # the same direction, which norms of plain numpy overflow for
    assert got == brute_vectors(rows) | {i: (0, i) for i, _ in odd_}
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    twice = cross_polytope.near_duplicates(vectors(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])])).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in twice if r.vec_id] == 2 * [(1, 2, 1, True)]
    assert cross_polytope.near_duplicates(vectors(spark, [])).count() == 0


def test_a_lower_threshold_has_its_own_tables(spark):
    draw = np.random.default_rng(6)
    rows = {}
    for i in range(300):
        a, b = np.linalg.qr(draw.standard_normal((64, 2)))[0].T
        rows[2 * i], rows[2 * i + 1] = a.tolist(), (0.81 * a + math.sqrt(1 - 0.81**2) * b).tolist()
    found = cross_polytope.near_duplicates(vectors(spark, list(rows.items())), threshold=0.8).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute_vectors(rows, 0.8)


def test_different_vectors_under_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (2, [-1.0, 0.0])]
    found = cross_polytope.near_duplicates(vectors(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 1, 1), (1, 1, 1), (2, 0, 2), (2, 0, 2)]


def test_large_buckets_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "TILE", 16)
    draw = np.random.default_rng(2)
    center = draw.standard_normal(32)
    rows = {i: (center + 0.03 * draw.standard_normal(32)).tolist() for i in range(150)}
    found = cross_polytope.near_duplicates(vectors(spark, list(rows.items()))).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute_vectors(rows)


def test_recall_at_the_threshold():
    plan = cross_polytope.plan_for(64, 50_000)
    draw = np.random.default_rng(9)
    a = draw.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.standard_normal((3000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = plan.buckets(a), plan.buckets(b)
    met = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any(axis=(1, 2)).mean()
    assert met > 0.995


def brute_top(rows, queries_, k):
    quantised = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in rows}
    out = []
    for q in queries_:
        score = sorted(
            (-int(v @ quantised[q]), i) for i, v in quantised.items() if i != q and len(v) == len(quantised[q])
        )
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(score[:k])]
    return sorted(out)


def test_top_k_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    draw = np.random.default_rng(8)
    rows = [(i, draw.standard_normal(12).round(1).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 12) for i in range(200)] + [(2000, [1.0, -2.0]), (2001, [3.0, 4.0])]
    odd_ = [(3000 + 50 * i, v) for i, v in enumerate(ODD_VECTORS) if v != [0.0, 0.0]]
    frame = vectors(spark, [*rows, *odd_, (None, [1.0] * 12)])
    asked = frame.filter("vec_id % 50 = 0")
    found = topk.search(
        topk.build_index(frame, "vec_id", "embedding", 256.0, 64), topk.query_chunks(asked, "vec_id", "embedding", 256.0), 5
    )
    want = brute_top(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == want
    assert topk.top_k(frame.limit(0), asked, 5, "vec_id", "embedding").count() == 0
    assert topk.top_k(frame, asked.limit(0), 5, "vec_id", "embedding").count() == 0


def test_cotraining_edges(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (8, None), (99, 0), (None, 1)], "doc_id long, quality int")
    scored = cotraining.score_documents(odd, labels)
    assert scored.columns == [*odd.columns, "quality_probability"]
    assert {r.quality_probability for r in scored.collect()} == {None}
    assert scored.filter(cotraining.accepted()).count() == 17
    assert cotraining.score_documents(none, labels).count() == 0
    rows = [(i, words(i, 30) if i % 2 else "!! $$ %% " * 20, "en", "a", 9) for i in range(200)]
    frame = spark.createDataFrame(rows, DOCS)
    known = frame.filter("doc_id < 80").select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    model = cotraining.train(frame, known, "doc_id", "text", ["source", "lang"], "n_chars", "quality")
    found = cotraining.score(frame, model, "text", ["source", "lang"], "n_chars")
    assert all((r.quality_probability > 0.5) == bool(r.doc_id % 2) for r in found.collect())
    more = cotraining.score(odd, model, "text", ["source", "lang"], "n_chars").collect()
    assert len(more) == 17 and all(0 <= r.quality_probability <= 1 for r in more)


def test_every_unlabelled_document_is_offered(spark):
    """Labels that one view gives are counted over all documents it is sure of."""
    rows = [(i, words(i, 30) if i % 3 else f"!! $$ %% {i} " * 20, "en", "a", 9) for i in range(9000)]
    frame = spark.createDataFrame(rows, DOCS).repartition(40)
    known = frame.filter("doc_id % 10 = 0").select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    seen = []
    exchange = cotraining.Evidence.of
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(cotraining.Evidence, "of", lambda *a: seen.append(int(a[3].sum())) or exchange(*a))
        cotraining.train(frame, known, "doc_id", "text", ["source"], "n_chars", "quality")
    fitted = seen[0]
    assert 0 < fitted < 900 and max(seen) == fitted + 8100


def test_categories_are_told_apart_by_their_whole_text():
    hosts = [f"host{i}.example.com" for i in range(2000)]
    _, at = cotraining.metadata_features([pa.array(hosts), pa.array(hosts)], pa.array([1.0] * 2000))
    assert len(np.unique(at[:, 0])) > 1990 and not set(at[:, 0]) & set(at[:, 1])


def test_hosts_without_labels_are_learned_from_the_text(spark):
    """Hosts of one ending, most of them without a label, each with few of 9000 documents."""
    good = {i: i % 3 > 0 for i in range(9000)}
    rows = [(i, words(i, 30) if ok else f"!! $$ %% {i} " * 20, "en", f"n{i % 1500}.example.com", 9) for i, ok in good.items()]
    frame = spark.createDataFrame(rows, DOCS).repartition(40)
    known = frame.filter("doc_id % 10 = 0").select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    model = cotraining.train(frame, known, "doc_id", "text", ["source", "lang"], "n_chars", "quality")
    # Documents 1500 apart share a host, and 1500 is a multiple of 3: hosts are good or bad as a whole.
    hosts = pa.array([f"n{i}.example.com" for i in range(1500)])
    _, at = cotraining.metadata_features([hosts], pa.array([9.0] * 1500))
    odds = model.views.evidence.features(at)[:, 0]
    assert [x > 0 for x in odds] == [good[i] for i in range(1500)]
    found = cotraining.score(frame, model, "text", ["source", "lang"], "n_chars").collect()
    assert all((r.quality_probability > 0.5) == good[r.doc_id] for r in found)


def test_chat_very_long_conversation(spark):
    """Fifty thousand turns, single and in runs, with control strings: exact, and in proportion to the turns."""
    n = 50_000
    spelled = F.concat(F.lit("t[</s>\\+"), F.col("id").cast("string"), F.lit("é"))
    role = F.when(F.col("id") % 7 < 2, "assistant").when(F.col("id") % 3 == 0, "system").otherwise("user")
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), spelled.alias("text"))
    started = time.time()
    made = chat.format_conversations(turns)
    row = made.select(
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss"),
        F.size("loss_mask").alias("spans"),
    ).first()
    took = time.time() - started
    told = [("assistant" if i % 7 < 2 else "system" if i % 3 == 0 else "user", f"t[</s>\\+{i}é") for i in range(n)]
    assert [tuple(t) for t in row.turns] == told
    assert row.loss == [text for who, text in told if who == "assistant"]
    assert row.spans == sum(a[0] == "assistant" != b[0] for a, b in zip(told, [("", ""), *told]))
    assert took < 60
