"""Tokenizer operators against the libraries on whole texts."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from plumbline.llm import bpe, packing, token_counts

random.seed(5)
_CHARS = " \n\t\r\xa0 \x1c\x85abAB.,!?';:1's)(_-éÉÜßé́İΣςAZ中🙂²"
TEXTS = [None, "", " ", "\n\n", "<|endoftext|> a <|startoftext|>", "Don't. E.g. it's! A.B.,;", "a" * 9000, "word " * 300_000, "x" * 1_200_000] + [
    "".join(random.choice(_CHARS) for _ in range(random.randint(0, 60))) for _ in range(1500)
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, "\n\n", 1, "x")], "doc_id long, text string, n_tokens int, start string").repartition(3)


def ranks_library(path, pattern):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_as_tiktoken(spark, docs):
    exact = ranks_library(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        t = TEXTS[r["doc_id"]] or ""
        ids = exact.encode_ordinary(t)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_model_has_the_merges_of_the_ranks(name):
    """Every distinct chunk of the given texts, and fuzzed ones: the tokenizers model gives the rank library's ids."""
    exact, tok = ranks_library(P.path(name), P.PATTERN), bpe._model(P.path(name))[0]
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    chunks = {c for t in texts for c in t.replace("\n", " ").split(" ")} | {"".join(random.choice("abcdefghé中🙂'\u0301 \u00ad") for _ in range(random.randint(1, 30))) for _ in range(5000)}
    for c in chunks:
        assert tok.encode(c, add_special_tokens=False).ids == exact.encode_ordinary(c), c


def test_bpe_by_another_pattern(spark):
    path, pattern = P.path("byte_bpe_50k.tiktoken"), r"\p{L}+|\P{L}+"
    texts = ["a  b c\n\nd. 12", "", "éß 中 1"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_column(df, path, pattern).collect()}
    assert got == {i: ranks_library(path, pattern).encode_ordinary(t) for i, t in enumerate(texts)}


def test_bpe_column_offsets_and_split_characters(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "中 𓀀", [0], "x")], "doc_id long, text string, ids array<int>, at string")
    r = bpe.encode_column(df, path, P.PATTERN, offsets="at").first()
    assert bpe.decode_text(r["ids"], path) == "中 𓀀"
    assert bpe.decode_text(r["ids"][:-1], path).endswith("\ufffd")
    assert r["at"] == [0] * r["at"].count(0) + [1] * r["at"].count(1) + [2] * r["at"].count(2) and r["at"].count(2) > 1  # a split character's ids share its place
    tok = bpe._model(path)[0]
    for r in bpe.encode_column(docs, path, P.PATTERN, offsets="at").collect():
        e = tok.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False)
        assert r["ids"] == e.ids and r["at"] == [a for a, _ in e.offsets] and r["n_tokens"] == 1
    assert bpe.round_trip(df.limit(0), path, P.PATTERN).count() == 0 and bpe.encode_column(df.limit(0), path, P.PATTERN).count() == 0
    assert sorted(bpe.byte_characters()) == sorted(set(bpe.byte_characters())) and len(bpe.byte_characters()) == 256


def slow_chunks(text):
    return re.findall(r" ?[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+", text)


def test_chunks_brute_force():
    from plumbline.llm import chunks

    texts = [t or "" for t in TEXTS if not t or len(t) < 1000]
    arr = pa.array(["skipped", *texts])[1:]  # with an offset
    made, n, chars = chunks.spaced(arr, np.zeros(len(texts), bool))
    want = [slow_chunks(t) for t in texts]
    assert made.to_pylist() == [c for w in want for c in w] and n.tolist() == [*map(len, want)] and chars.tolist() == [len(c) for w in want for c in w]
    made, n, _ = chunks.spaced(arr, np.ones(len(texts), bool))
    assert made.to_pylist() == [t for t in texts if t] and n.tolist() == [int(t != "") for t in texts]
    assert chunks.spaced(arr[:0], np.zeros(0, bool))[1].tolist() == []


def test_very_long_texts_in_parts(monkeypatch):
    from tokenizers import Tokenizer

    from plumbline.llm import chunks

    monkeypatch.setattr(chunks, "BLOCK_CHARS", 60)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc = chunks.SpacedEncoder(lambda c: chunks.encode_chunks(tok, c, offsets=True))
    texts = [None, "", "é word " * 200, "short one", "\xa0odd space " * 60, "x y\n\nz " * 90, "a"]
    rows = [(i, f) for ids, n, first in enc.encoded(pa.array(texts), True) for i, f in zip(np.split(ids, np.cumsum(n)[:-1]), np.split(first, np.cumsum(n)[:-1]), strict=True)]
    for t, (ids, first) in zip(texts, rows, strict=True):
        e = tok.encode(t or "", add_special_tokens=False)
        assert ids.tolist() == e.ids and first.tolist() == [a for a, _ in e.offsets]


MANY_LINES = "\n".join("".join(random.choice(_CHARS) for _ in range(random.randint(0, 40))) for _ in range(30_000))


def test_sections_brute_force(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = {}
    texts = [*TEXTS, MANY_LINES, MANY_LINES.replace("\xa0", "").replace("\x1c", "").replace("\x85", "")]
    more = docs.sparkSession.createDataFrame([(i, texts[i], 1, "x") for i in range(len(TEXTS), len(texts))], docs.schema)
    for r in token_counts.section_counts(docs.unionByName(more), P.path("byte_bpe_50k.json")).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["start"], r["end"], r["n_tokens"])
    for i, t in enumerate(texts):
        t = t or ""
        starts = np.array([a for a, _ in tok.encode(t, add_special_tokens=False).offsets], np.int64)
        at, want = 0, {}
        lines = t.split("\n")
        if len(lines) > 1 and not lines[-1]:
            lines.pop()
        for k, line in enumerate(lines):
            end = min(len(t), at + len(line) + 1)
            want[k] = (at, end, int(((starts >= at) & (starts < end)).sum()) if len(lines) < 5000 else int(np.searchsorted(starts, end) - np.searchsorted(starts, at)))
            at = end
        assert got[i] == want, i
    assert token_counts.section_counts(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    null = spark.createDataFrame([(None, "a b\nc"), (None, None)], "doc_id long, text string")
    assert sorted((r["section"], r["n_tokens"]) for r in token_counts.section_counts(null, P.path("byte_bpe_50k.json")).collect()) == [(0, 0), (0, 3), (1, 1)]
    parted = token_counts.section_counts(spark.createDataFrame([(1, "a--b----é")], "doc_id long, text string"), P.path("byte_bpe_50k.json"), separator="--").collect()
    assert sorted((r["start"], r["end"]) for r in parted) == [(0, 3), (3, 6), (6, 8), (8, 9)]


def test_field_counts(spark):
    df = spark.createDataFrame([(1, "a title", "some body text here", None)], "doc_id long, title string, body string, extra string")
    got = {r["field"]: r["n_tokens"] for r in token_counts.field_counts(df, P.path("byte_bpe_50k.json"), ["title", "body", "extra"]).collect()}
    assert got == {"title": 3, "body": 5, "extra": 0}
    assert token_counts.field_counts(df.limit(0), P.path("byte_bpe_50k.json"), ["title"]).count() == 0


def check_pieces(rows, ids):
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append(r)
        docs.setdefault(r["doc_id"], []).append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        at = 0
        for r in s:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 4096
    padding = sum(4096 - n for s in seqs.values() if (n := sum(r["length"] for r in s)) & (n - 1))
    for d, own in docs.items():
        own.sort(key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[d])
    assert set(docs) == set(ids)
    return padding


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(TEXTS)}
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int").repartition(2)
    rows = packing.pack_documents(df, P.path("word_bpe_49k.json"), group_tokens=50_000).collect()
    assert check_pieces(rows, ids) == 0
    assert packing.pack_documents(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packing_by_a_tokenizer_of_another_form(spark):
    """Case counts for it, so its texts may not be lower-cased or parted as those of the usual one."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["Some Text, HERE.", None, " \n x"]
    rows = packing.pack_documents(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    check_pieces(rows, {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)})


def test_packing_null_ids(spark):
    rows = packing.pack_documents(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"), P.path("word_bpe_49k.json")).collect()
    assert {r["doc_id"] for r in rows} == {None} and sum(r["length"] for r in rows) == 4


def test_pack_balances_cost():
    lengths = [random.randint(1, 1500) for _ in range(400)]
    cost, size = {}, {}
    for _, _, m, s, _ in packing.pack(lengths):
        cost[s] = cost.get(s, 0) + m + m * m / 4096
        size[s] = size.get(s, 0) + m
    full = [cost[s] for s in cost if size[s] == 4096]
    assert sum(size.values()) == sum(lengths) and max(full) < 1.35 * min(full)
    assert packing.pack([]) == [] and packing.pack([4096 * 2]) == [(0, 0, 4096, 0, 0), (0, 4096, 4096, 1, 0)]


def test_repeated_documents_are_packed_apart(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(df, P.path("word_bpe_49k.json")).collect()
    assert sum(r["length"] for r in rows) == 4


def test_full_cache_keeps_results(monkeypatch):
    from tokenizers import Tokenizer

    from plumbline.llm import chunks

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [" ".join(random.choice("abcdefgh") * random.randint(1, 4) + random.choice([".", ",", ""]) for _ in range(50)) for _ in range(200)]
    monkeypatch.setattr(chunks, "CACHE_CHARS", 150)
    monkeypatch.setattr(chunks, "BLOCK_CHARS", 200)
    enc = chunks.WordEncoder(lambda c: chunks.encode_chunks(tok, c, offsets=False))
    assert [x.tolist() for x in enc.documents(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc = chunks.SpacedEncoder(lambda c: chunks.encode_chunks(tok, c, offsets=False))
    got = [x.tolist() for ids, n, _ in enc.encoded(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
