import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from newsloom.llm import counting, packing, wavelet
from newsloom.llm.common import Words, materialise
from newsloom.llm.tokens import PieceEncoder, vocabulary

BYTE, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_pieces_give_the_librarys_ids(path, small):
    rng = random.Random(3)
    signs = " \t\n\r\x0b\x0c\x1c\x85\xa0 　​aé'stlSÀΣ̈1٣.,!<|>中😀_-"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|endoftext|>", "  a  b ", "a 's 'll it's", " x", "x ", ""] + [r.text for r in small.limit(100).collect()]
    encoder = PieceEncoder(path)
    encoder.limit = 500
    want = encoder.library.encode_batch(texts, add_special_tokens=False)
    for text, got, w in zip(texts, encoder.encode(texts), want, strict=True):
        assert got.tolist() == w.ids, text
    for text, w in zip(texts[:300], want, strict=False):
        assert [x.tolist() for x in encoder.encode([text])] == [w.ids], text
    plain = " \t\n\x0ba.'sÀ1"  # no text of these goes through the library whole
    texts = ["".join(rng.choice(plain) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    for at in range(0, len(texts), 1500):
        some = [*texts[at : at + 1500], None, ""]
        want = encoder.library.encode_batch([t or "" for t in some], add_special_tokens=False)
        assert [g.tolist() for g in encoder.encode(some)] == [w.ids for w in want]


def alternating(n):
    """The Thue-Morse word of n letters and its complement, whose polynomial hashes are equal."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_long_words_of_two_letters(path):
    encoder = PieceEncoder(path)
    for k in range(8, 15):
        a, b = alternating(1 << k)
        texts = [a, b, f"{a} {b} {a}", f"one {b}\n{a} two", f"{a}, {b}!"]
        assert [x.tolist() for x in encoder.encode(texts)] == [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_pieces_with_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(Words, "_hashes", lambda w: (w.end - w.start).astype(np.uint64))
    encoder, texts = PieceEncoder(BYTE), ["one two  two\nsix one", "cat one", "dog", None]
    assert [x.tolist() for x in encoder.encode(texts)] == [x.ids for x in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words():
    a, b = alternating(2048)
    texts = [f"{a} {b}", None, "", " x\ty\x0b\x0c", f"{a}", "x\x00 x", "é 中é"]
    w = Words(texts)
    words = [x for t in texts for x in (t or "").encode().split()]
    assert [w.word(i) for i in range(len(w.hash))] == words and w.counts.tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(set(w.hash.tolist())) == len(set(words))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    assert w.same(i, j).tolist() == [words[x] == words[y] for x, y in zip(i.tolist(), j.tolist(), strict=True)]


def test_wavelet_matrix_operations():
    rng = np.random.default_rng(1)
    for size, top in ((0, 1), (1, 1), (700, 3), (5000, 300), (1600, 70000)):
        x = rng.integers(0, top, size)
        ids = x.astype("<u4") if top > 1 << 16 else x.astype("<u2")
        if not size:
            continue
        s = wavelet.Shard.load(wavelet.Shard.of([5, 9], [size - 1, 1], ids).dump())
        assert s.ids().tolist() == x.tolist()
        at = rng.integers(0, size, 40)
        assert s.access(at).tolist() == x[at].tolist()
        for v in [*x[:5].tolist(), top + 1]:
            assert s.count(v) == (x == v).sum()
            where = np.flatnonzero(x == v)
            assert s.locate(v) == [(5, int(i)) if i < size - 1 else (9, 0) for i in where]


def test_stored_ids(spark, small, edge, none, library):
    for docs in (small, edge):
        rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        got = sorted(wavelet.stored(docs, BYTE).collect(), key=lambda r: r.doc_id)
        assert [r.doc_id for r in got] == sorted(rows)
        start = 0
        for r in got:
            ids = np.array([*library.encode(rows[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert wavelet.stored(none, BYTE).collect() == []


def test_counts(small, edge, none, library):
    for docs in (small, edge):
        for r in counting.counted(docs, BYTE, chunk=2000, overlap=16).join(docs.select("doc_id", "text"), "doc_id").collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 1024)
    assert counting.counted(none, BYTE).collect() == []


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (200, 64), (1000, 1)])
def test_resynchronisation(library, chunk, overlap):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word ", "  ", "\n", "a'll ", "é", "x" * 300, " <|endoftext|>", "12 "]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    for t in [*texts, "y" * 5000, " " * 3000, "a " * 3000]:
        assert counting.count_huge(library, t, chunk, overlap) == len(library.encode(t, add_special_tokens=False).ids)


def test_other_vocabularies_are_encoded_whole(edge, tmp_path):
    assert PieceEncoder.suits(BYTE) and PieceEncoder.suits(WORDS)
    t = Tokenizer.from_file(BYTE)
    from tokenizers.pre_tokenizers import ByteLevel

    t.pre_tokenizer = ByteLevel(add_prefix_space=True)
    t.save(str(tmp_path / "v.json"))
    assert not PieceEncoder.suits(str(tmp_path / "v.json"))
    for r in counting.counted(edge.where("doc_id <> 4"), str(tmp_path / "v.json")).join(edge.select("doc_id", "text"), "doc_id").collect():
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids)


def test_sentencepiece_counts(edge):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in counting.counted(edge, path).join(edge.select("doc_id", "text"), "doc_id").collect():
        assert r.n_tokens == len(model.encode(r.text or ""))


@pytest.mark.parametrize("block", [50_000, 150])
def test_packing(small, edge, none, block):
    words = Tokenizer.from_file(WORDS)
    for docs in (small, edge, edge.union(edge)):
        parts = materialise(packing.pieces(docs, WORDS))
        rows = packing.packed(parts, block=block).collect()
        texts = {r.doc_id: r.text for r in docs.collect()}
        by_doc, by_bin = {}, {}
        for r in rows:
            by_doc.setdefault((r.doc_id, r.copy), []).append(r)
            by_bin.setdefault(r.sequence_id, []).append(r)
        assert len(by_doc) == docs.count()
        for (doc, _), own in by_doc.items():
            ids = np.array([*words.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
            own.sort(key=lambda r: r.piece)
            assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        for own in by_bin.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048
        least = -(-sum(r.length for r in rows) // 2048)
        assert len(by_bin) <= least * 1.02 + 1
    assert packing.packed(materialise(packing.pieces(none, WORDS))).collect() == []


@pytest.mark.parametrize("norm", [True, False])
def test_packing_constraints(small, norm):
    parts = materialise(packing.pieces(small, WORDS))
    rows = packing.packed(parts, max_documents=3, max_cost=1 << 22, weights=(1, 0.2, 0.3), norm=norm).groupBy("sequence_id").agg({"length": "sum", "doc_id": "count"}).collect()
    assert all(r["sum(length)"] <= 2048 and r["count(doc_id)"] <= 3 for r in rows)


@pytest.mark.parametrize("norm", [True, False])
@pytest.mark.parametrize("limits", [(2048, 2048, 2048 * 2048), (2048, 3, 2048 * 900)])
def test_the_best_of_all_bins_is_taken(norm, limits):
    weights = (1.0, 0.4, 0.3)
    rng = np.random.default_rng(8)
    bins, left = packing.Bins(limits, weights, norm), []
    for length in np.sort(rng.integers(1, 1400, 1500))[::-1].tolist():
        need = (length, 1, length * length)

        def score(s):
            r, d = [a / m for a, m in zip(s, limits, strict=True)], [a / m for a, m in zip(need, limits, strict=True)]
            return sum(w * ((a - b) ** 2 if norm else a * b) for w, a, b in zip(weights, r, d, strict=True))

        room = [i for i, s in enumerate(left) if all(a >= b for a, b in zip(s, need, strict=True))]
        got = bins.put(length)
        if room:
            assert got in room and score(left[got]) == pytest.approx(min(score(left[i]) for i in room), abs=1e-12)
        else:
            assert got == len(left)
            left.append(limits)
        left[got] = tuple(a - b for a, b in zip(left[got], need, strict=True))


def test_a_known_word_with_signs_is_not_encoded_again():
    encoder = PieceEncoder(BYTE)
    asked, unit = [], encoder._unit
    encoder._unit = lambda x: asked.append(x) or unit(x)
    text = "one word, a word. the word; word"
    ids, counts = encoder.many([text])
    assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
    assert asked.count(" word") == 1
