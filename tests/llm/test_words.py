"""Ranked search, token files and source divergence against plain versions, and on awkward rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docgrid.llm import divergence, lexical, wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, score long, count long, _place int, chunk int"
AWKWARD = [None, "", " ", "\n\n", "one", "One two", "a" * 30_000, "x y " * 5000, "é\U0001f600 中文", "<|endoftext|> tail", "one two", "one two", "ONE, two; ünïcode Ünïcode 42a 42A"]


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves; rows: id, text, lang, source."""
    return spark.createDataFrame([(i, t, lang, source, "t", 7, 8, 9, 1, 2) for i, t, lang, source in rows], SCHEMA)


def words(n, seed, vocabulary=60):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6))) for _ in range(vocabulary)]
    return [" ".join(r.choice(pool[: r.randrange(5, vocabulary)]) for _ in range(r.randrange(0, 60))) for _ in range(n)]


# 11 ranked search


def plain_search(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    found = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(t for _, terms in found for t in set(terms))
    out = []
    for item, text in items:
        scores = []
        for no, (i, terms) in enumerate(found):
            tf, score = Counter(terms), 0
            m = 75 + 25 * len(terms) * n_docs // max(n_terms, 1)
            for t in split(text):
                if t in tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, no))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found_by(spark, docs, items, k):
    d = frame(spark, [(i, t, "en", "s") for i, t in docs])
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, weight long, doc_no long")
    return sorted((tuple(r) for r in lexical.search(d, q, k).collect()), key=repr)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_search_as_the_definition(spark, k):
    texts = words(300, 1)
    docs = [(i, t) for i, t in enumerate(texts)] + [(2**60 + 1, texts[3]), (None, texts[5]), (7, texts[7]), (7, texts[7])]
    items = [(i, t) for i, t in enumerate(words(25, 2))] + [(100, texts[11]), (101, None), (102, ""), (103, "nowhere"), (3, texts[12]), (None, texts[13] + " " + texts[13])]
    assert found_by(spark, docs, items, k) == plain_search(docs, items, k)


def test_search_joins_terms_that_are_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SENT_BYTES", 0)
    monkeypatch.setattr(lexical, "MAP_BITS", 1 << 12)  # which also lets terms through that no item has
    docs, items = list(enumerate(words(120, 3))), list(enumerate(words(8, 4)))
    assert found_by(spark, docs, items, 5) == plain_search(docs, items, 5)


def test_search_leaves_no_candidate_out_when_terms_are_pruned(spark):
    r = random.Random(5)
    common = ["the", "of", "and"]  # in all documents, so that suffix bounds drop them
    docs = [(i, " ".join([*common * r.randrange(1, 4), *(f"w{r.randrange(200)}" for _ in range(r.randrange(3, 30)))])) for i in range(400)]
    items = [(i, " ".join([*common, *(f"w{r.randrange(200)}" for _ in range(6))])) for i in range(20)]
    assert found_by(spark, docs, items, 4) == plain_search(docs, items, 4)


def test_search_awkward(spark):
    docs, items = list(enumerate(AWKWARD)), list(enumerate(AWKWARD))
    assert found_by(spark, docs, items, 20) == plain_search(docs, items, 20)
    assert found_by(spark, [], items, 20) == [] == found_by(spark, docs, [], 20)
    assert found_by(spark, [(1, None), (2, "")], items, 20) == []


# 12 token files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_as_the_library(spark, sf, library):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [t or "" for t in AWKWARD]
    r = random.Random(6)
    odd = "aB.,'s\t \r\n\x0b\x0c\x1c\x85  é́İΣσςßœŒǅ中９²½🙂<|>'ll"
    texts += ["".join(r.choice(odd) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|>x <|startoftext|>", "don't WON'T we'll.", "wow!. wow...", "x" * 70 + "!", "Σ ΑΣ", "ÀÉ İstanbul", "été"]
    own = wavelet.Encoder(PATH)
    for t, ids in zip(texts, own.encode_all(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_makes_no_added_token_by_small_letters(library):
    texts = ["<|ENDOFTEXT|>", "One <|EndOfText|> Two\nThree", "A<|STARTOFTEXT|>b", "<|endoftext|> <|ENDOFTEXT|> Tail"]
    assert [x.tolist() for x in wavelet.Encoder(PATH).encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_forgets_words_and_stays_right(monkeypatch, library):
    monkeypatch.setattr(wavelet, "WORDS", 50)
    own = wavelet.Encoder(PATH)
    texts = [f"word{i} Alpha{i % 7}, beta{'x' * (i % 90)}" for i in range(200)] * 2
    for t in texts:
        assert own.encode(t, 1).tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("size, top", [(0, 1), (1, 1), (5, 2), (1000, 49408), (70_000, 3), (200_000, 49408), (3000, 2**20)])
def test_wavelet_matrix(size, top):
    r = np.random.default_rng(size)
    ids = np.minimum(r.zipf(1.3, size), top - 1).astype(np.uint32)
    lengths = np.array([size // 2, 0, size - size // 2])
    data = wavelet.shard_bytes(np.array([5, -1, 2**60]), np.array([False, True, False]), lengths, ids)
    read = []
    s = wavelet.Shard(lambda offset, n: read.append(n) or data[offset : offset + n])
    assert s.all().tolist() == ids.tolist() and s.lengths.tolist() == lengths.tolist() and s.doc_ids.tolist() == [5, -1, 2**60] and s.no_id.tolist() == [False, True, False]
    read.clear()
    for i in [0, 1, size // 2, size - 1, 65_535, 65_536]:
        if 0 <= i < size:
            assert s.access(i) == ids[i]
    if size > 100_000:
        assert sum(read) < len(data)  # not all of the file
    for t in {*ids[:5].tolist(), int(top) + 1, 0}:
        at = np.flatnonzero(ids == t)
        assert s.count(t) == len(at) and s.count(t, size // 3, 2 * size // 3) == ((at >= size // 3) & (at < 2 * size // 3)).sum()
        assert list(itertools.islice(s.occurrences(t), 40)) == at[:40].tolist()
        if len(at):
            assert s.select(t, len(at) - 1) == at[-1]
        with pytest.raises(IndexError):
            s.select(t, len(at))


def test_token_files(spark, sf, library, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_IDS", 20_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(2**60 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id"), (-5, "below"), (3, "again"), (3, "again")]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    shards = wavelet.write_shards(docs, PATH, str(tmp_path / "files"))
    assert shards.count() > 5 and len(list((tmp_path / "files").glob("*.wvm"))) == shards.count()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = sorted((tuple(r) for r in wavelet.documents_of(shards).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    for i, start, n, crc in got:
        assert start == at and (n, crc) in {(len(x), zlib.crc32(x.tobytes())) for x in by_id[i]}
        at += n
    every = Counter(t for own in by_id.values() for x in own for t in x.tolist())
    some = [1, 320, int(max(every, key=every.get)), 49_000]
    assert {r.token: r.n for r in wavelet.counts(shards, some).collect()} == {t: every[t] for t in some}
    token = ids[2**60 + 5][-2]  # "two"
    places = [(i, int(p)) for i, own in by_id.items() for x in own for p in np.flatnonzero(x == token)]
    assert sorted(((r.doc_id, r.place) for r in wavelet.occurrences(shards, token).collect()), key=repr) == sorted(places, key=repr)


def test_token_files_of_nothing_and_one_id(spark):
    assert wavelet.token_files(frame(spark, [("x", "x", "x", "x")][:0]), PATH).count() == 0
    same = frame(spark, [(1, f"text {i % 3}", "en", "s") for i in range(200)])
    got = sorted(tuple(r) for r in wavelet.token_files(same, PATH).select("start", "n_tokens").collect())
    assert [s for s, _ in got] == [0, *itertools.accumulate(n for _, n in got)][:-1]


# 13 source divergence


def plain_divergence(rows, least=10, top=10):
    split = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    docs = [(lang or "", source or "", split(t)) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t in df if df[t] >= least), key=lambda t: t.encode())
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return [1 + 1000000000 * (c[t] + 2) // total for t in kept]

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        for s in p:
            pairs = [(-sum((a - b) * (a - b) // (a + b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in p if o != s]
            terms = [(-((a - b) * (a - b) // (a + b)), t.encode(), t) for t, a, b in zip(kept, p[s], q) if counts[s][t] and a > b]
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


GROUPED = [(i, t, random.Random(i).choice(["en", "de", None, ""]), random.Random(i * 7).choice(["a", "b", "é", None, "z", "Z"])) for i, t in enumerate(words(400, 8) + AWKWARD * 3)]
GROUPED += [(1, "", "xx", "only"), (2, None, "xx", "second"), (3, "one", "xx", "third"), *[(4, "hot hot hot line", "en", "a")] * 500]


@pytest.mark.parametrize("sent, chunk, held", [(1 << 19, 4096, 1 << 18), (0, 4096, 1 << 18), (1 << 19, 3, 20), (0, 7, 20)])
def test_divergence_as_the_definition(spark, monkeypatch, sent, chunk, held):
    monkeypatch.setattr(divergence, "SENT_TERMS", sent)  # the dictionary is joined where it isn't sent
    monkeypatch.setattr(divergence, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    got = divergence.source_divergence(frame(spark, GROUPED))
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(GROUPED)


@pytest.mark.parametrize("ids, held", [(7, 1 << 18), (7, 20), (1 << 22, 2)])
def test_divergence_counts_numbers_bit_by_bit(spark, monkeypatch, ids, held):
    monkeypatch.setattr(divergence, "HELD_IDS", ids)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    got = divergence.source_divergence(frame(spark, GROUPED))
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(GROUPED)


def test_divergence_awkward(spark):
    assert divergence.source_divergence(frame(spark, [("x", "x", "x", "x")][:0])).count() == 0
    few = [(1, "one two", "en", "a"), (2, "one", "en", "b"), (None, None, None, None)]
    assert sorted(tuple(r) for r in divergence.source_divergence(frame(spark, few)).collect()) == plain_divergence(few) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_beyond_64_bit_products():
    counts = np.array([0, 1, 10**12, 10**15 - 7, 123456789012345])
    total, size = int(counts.sum()), 5
    assert divergence.parts(counts, total, size).tolist() == [1 + 1000000000 * (int(c) + 2) // (total + 2 * size) for c in counts]
