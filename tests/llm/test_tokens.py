"""Operators 1, 4 and 10 against the tokenizer library itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from millrace.llm import packing, token_counts, token_store  # noqa: E402
from millrace.llm.tokens import Encoder  # noqa: E402


@pytest.fixture(scope="module")
def tok():
    return tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))


def ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_codes_random_access():
    r = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        x = r.integers(0, 2 ** r.integers(1, 32, n), dtype=np.uint64).astype(np.uint32) if n else np.zeros(0, np.uint32)
        c = token_store.Codes(token_store.pack(x))
        assert len(c) == n and np.array_equal(c.range(0, n), x)
        for i in r.integers(0, n, 50) if n else []:
            assert c[int(i)] == x[i]
        for _ in range(20 if n else 0):
            a, b = sorted(r.integers(0, n + 1, 2).tolist())
            assert np.array_equal(c.range(a, b), x[a:b])
        with pytest.raises(IndexError):
            c[n]
    with pytest.raises(ValueError):
        token_store.Codes(b"XXXX" + bytes(12))


def test_words_encode_like_the_library(tok):
    odd = ["", None, "a<|endoftext|>b  C D", "é, ×, ß. Ö; a.b.c ..", "'s it's I'D They'Re...", "<|ENDOFTEXT|><|endoftext|>", " ́a x̀, É", "K. Å ſ İI ΣΑΣ,x", "\x1c\x1d x y", "12,3a 1.5", "…, )."]
    for part in (odd, odd[3:], odd * 30):
        got, n = Encoder(P.path("word_bpe_49k.json")).encode(pa.array(part))
        want = [ids(tok, t) for t in part]
        assert n.tolist() == [len(w) for w in want] and got.tolist() == sum(want, [])
    whole = Encoder(P.path("byte_bpe_50k.json"))
    assert not whole.by_word
    got, n = whole.encode(pa.array(["a b", None]))
    assert got.tolist() == tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode("a b", add_special_tokens=False).ids and n.tolist()[1] == 0


def test_forgetting_changes_nothing(tok, monkeypatch):
    from millrace.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    e = Encoder(P.path("word_bpe_49k.json"))
    for t in ["the cat sat on the mat", "the dog saw the cat twice", "one two three four five six the"] * 3:
        assert e.encode(pa.array([t]))[0].tolist() == ids(tok, t)


def test_store(spark, unique, unique_rows, tok):
    got = {r.doc_id: r for r in token_store.read_documents(token_store.write_shards(unique, shard_tokens=500)).collect()}
    at = 0
    for r in sorted(unique_rows):
        want = ids(tok, r[1]) + [2]
        assert (got[r[0]].start, got[r[0]].n_tokens, got[r[0]].ids_crc32) == (at, len(want), crc(want))
        at += len(want)
    assert len(got) == len(unique_rows)


def test_store_odd_tables(spark, docs, rows):
    got = token_store.read_documents(token_store.write_shards(docs)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert token_store.read_documents(token_store.write_shards(docs.limit(0))).count() == 0


def test_packing(spark, unique, unique_rows, tok):
    got = packing.best_fit(packing.pieces(unique, size=256), 256).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for r in unique_rows:
        want, at = ids(tok, r[1]) + [0], 0
        for k, p in enumerate(sorted(by[r[0]], key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, crc(want[at : at + p.length])) and (p.length == 256 or at + p.length == len(want))
            at += p.length
        assert at == len(want)
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(seq) <= 1.02 * -(-total // 256) + 1


def test_packing_odd_tables(spark, docs, rows):
    assert packing.best_fit(packing.pieces(docs.limit(0))).count() == 0
    got = packing.best_fit(packing.pieces(docs), group=20).collect()
    made = packing.pieces(docs).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, got)) == Counter(map(key, made))  # no piece lost or doubled, repeated rows included
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in rows)
    for places in [sorted((r.offset, r.length) for r in got if r.sequence_id == s) for s in {r.sequence_id for r in got}]:
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048


def test_packing_spreads_rows_without_ids(spark):
    """Rows of no id and of one id go to many groups; ids stay exact beside nulls."""
    big = 2**53 + 1
    docs = spark.createDataFrame([(None, "a b c")] * 300 + [(big, "d e")] * 300, "doc_id long, text string")
    got = packing.best_fit(packing.pieces(docs), group=30).collect()
    assert Counter(r.doc_id for r in got) == {None: 300, big: 300}
    groups = Counter(r.sequence_id % 20 for r in got)
    assert len(groups) == 20 and max(groups.values()) <= 60


@pytest.mark.parametrize("seed", range(4))
def test_local_search_beats_best_fit(seed):
    """Never more bins than best-fit decreasing alone, and sound."""
    r = np.random.default_rng(seed)
    lengths = r.integers(20, 700, 400)
    bins, offset = packing.pack(lengths, 1000)
    first, _ = packing.pack(lengths, 1000, rounds=0)
    assert len(set(bins.tolist())) <= len(set(first.tolist()))
    for b in set(bins.tolist()):
        held = sorted((offset[i], lengths[i]) for i in np.flatnonzero(bins == b))
        assert all(x + n == y for (x, n), (y, _) in zip(held, held[1:])) and held[0][0] == 0 and sum(n for _, n in held) <= 1000


def test_search_empties_bins():
    """Best-fit decreasing needs four bins here; exchanges reach three."""
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])  # 30 in bins of 10
    assert len(set(packing.pack(lengths, 10)[0].tolist())) == 3


def test_search_ends_where_no_exchange_raises_squared_fill():
    lengths = np.random.default_rng(0).integers(250, 600, 400)
    bins, _ = packing.pack(lengths, 1000)
    held = [lengths[bins == b].tolist() for b in sorted(set(bins.tolist()))]
    assert len(held) > packing.lower_bound(lengths, 1000)
    for k, mine in enumerate(held):
        for j, other in enumerate(held):
            back = [0, *other, *(x + y for i, x in enumerate(other) for y in other[i + 1 :])]
            assert j == k or not any(s < n and sum(mine) < sum(other) + n - s <= 1000 for n in mine for s in back)


def test_search_reaches_the_lower_bound():
    lengths = np.random.default_rng(0).integers(20, 700, 400)
    assert len(set(packing.pack(lengths, 1000)[0].tolist())) == packing.lower_bound(lengths, 1000)


def test_counts(spark, docs, rows, tok):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, limit=100).collect())
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(ids(tok, r[1])), len(ids(tok, r[1])) > 100) for r in rows)
    assert got == want
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_merging_runs_of_equal_symbols(tok):
    c = token_counts.Counter(P.path("word_bpe_49k.json"))
    texts = ["a" * n for n in range(1, 30)] + ["ee" * 7 + "x", "lll llll lllll", "!!!! ????!!", "öööö ñññ", "it's 's 've"]
    assert c.count(pa.array(texts)).tolist() == [len(ids(tok, t)) for t in texts]
