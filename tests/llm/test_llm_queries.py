"""The registered queries against SQL, libraries and brute force on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from loamline.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def run(spark, name):
    return queries.QUERIES[name](spark, SF_DIR).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    types = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    assert {c: types[t] for c, t in frame.dtypes} == kinds
    want = sorted(tuple(str(r[names.index(c)]) for c in frame.columns) for r in cursor.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in frame.collect()) == want


def test_shards_are_near_equal_and_gapless(spark, texts):
    rows = run(spark, "op1_sharding")
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()
    }
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r)
    totals = [sum(r.size for r in v) for v in held.values()]
    assert max(totals) - min(totals) <= max(r.size for r in rows)
    assert set(held) == set(range(16))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in held.values())


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
        words = re.findall(rb"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components_match_brute_force(spark, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op3_ngram_jaccard")}
    assert found == brute_components(texts)


def check_packing(rows, ids):
    """Pieces lie gapless in documents and in sequences, and carry the right ids."""
    ends, held = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        whole = ids[r.doc_id]
        assert (r.doc_tokens, r.start) == (len(whole), ends[r.doc_id])
        part = np.array(whole[r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and len(part) == 4 * r.length
        ends[r.doc_id] += r.length
        held[r.sequence_id].append((r.offset, r.length))
    assert ends == {i: len(x) for i, x in ids.items()}
    assert set(held) == set(range(len(held)))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(r.length for r in rows) / (2048 * len(held))


def test_packing_holds_every_id_once_with_little_padding(spark, texts, library):
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    assert check_packing(run(spark, "op4_packing"), ids) > 0.97


def test_token_counts(spark, texts, library):
    sizes = np.array([len(library.encode(t, add_special_tokens=False).ids) for t in texts.values()])
    rows = {r.n_tokens: r for r in run(spark, "op6_token_counts")}
    assert set(rows) == set(sizes.tolist()) | set(queries.CONTEXT_LIMITS)
    named = {float(p): n for n, r in rows.items() for p in r.quantile_of.split(",") if p}
    ordered = sorted(sizes.tolist())
    assert named == {p: ordered[max(1, math.ceil(p * len(ordered))) - 1] for p in queries.LENGTH_SHARES}
    for n, r in rows.items():
        assert r.n_docs == (sizes == n).sum() and r.docs_up_to == (sizes <= n).sum()
        assert r.docs_from == (sizes >= n).sum() and r.tokens_from == sizes[sizes >= n].sum()
        assert r.truncated_total == np.minimum(sizes, n).sum()


def test_bpe_matches_the_library(spark, texts):
    ranks = queries.bpe.Vocabulary.read(queries.RANKS).ranks
    own = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run(spark, "op10_byte_bpe"):
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def brute_vectors(vectors, least=0.95):
    ids = sorted(vectors)
    unit = {i: np.array(vectors[i], float) / np.linalg.norm(vectors[i]) for i in ids}
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in ids}


def test_vectors_match_brute_force(spark, duck):
    vectors = dict(duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    found = {r.vec_id: (r.n_links, r.component_id) for r in run(spark, "op2_embedding_near_dedup")}
    assert found == brute_vectors(vectors)


def test_quality_on_labelled_rows(spark, duck):
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = run(spark, "op7_quality_classifier")
    right = [r.accepted == bool(labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.quality_probability <= 1 for r in rows)


def test_pipeline_stages_against_plain_python(spark, duck, library):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard", "packing"]
    scored = {r.doc_id: r.accepted for r in run(spark, "op7_quality_classifier")}
    kept = pipeline.cut_lineage(pipeline.STAGES[0][1](spark, docs, SF_DIR))
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == {i for i, ok in scored.items() if ok}

    lines = pipeline.cut_lineage(pipeline.STAGES[1][1](spark, kept, SF_DIR))
    assert lines.columns == docs.columns
    pages, seen = defaultdict(int), defaultdict(set)
    for source, text in {(r.source, r.text) for r in rows.values()}:
        pages[source] += 1
        for x in {x.strip(" \t\r") for x in text.split("\n")} - {""}:
            seen[source, x].add(text)
    bad = {k for k, v in seen.items() if len(v) >= 5 and len(v) > 0.02 * pages[k[0]]}
    texts = {}
    for i, r in rows.items():
        texts[i] = "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" \t\r")) not in bad)
    assert {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {i: (t, len(t)) for i, t in texts.items()}

    single = pipeline.cut_lineage(pipeline.STAGES[2][1](spark, lines, SF_DIR))
    stays = {i for i, (_, c) in brute_components(texts).items() if i == c}
    assert {r.doc_id: r.text for r in single.collect()} == {i: texts[i] for i in stays}

    ids = {i: [*library.encode(texts[i], add_special_tokens=False).ids, 1] for i in stays}
    check_packing(pipeline.STAGES[3][1](spark, single, SF_DIR).collect(), ids)
    check_packing(run(spark, "pipeline"), ids)
