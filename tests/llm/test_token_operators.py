"""Token counts, the token store and SentencePiece against the libraries and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from paperloom.llm import token_counts, token_store, unigram
from paperloom.llm.flat import distinct, flat, names
from paperloom.llm.tokens import load

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "'s", "'", "é", "日本", "<|endoftext|>", "<|endof", "text|>", "1", "23", "!", "!!", "\x1c", "\x85", "\r\n", ".", ",", "Ab", "\0", "🙂", "▁", "\xa0"]


def texts(n, seed, size=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_pieces_encode_as_whole_texts():
    own, lib = token_counts.ChunkCounter(BPE), load(BPE)
    many = texts(1500, 1)
    ids, sizes = own.encode(*flat(pa.array(many)))
    want = [e.ids for e in lib.encode_batch(many, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_memo_forgets_and_stays_right():
    own = token_counts.ChunkCounter(BPE)
    own.memo.bits = 6
    own.memo.clear()
    many = texts(60, 2)
    for part in (many[:20], many[20:40], many, [f"word{i}" for i in range(500)]):
        want = [len(e.ids) for e in own.tok.encode_batch(part, add_special_tokens=False)]
        assert own.counts(*flat(pa.array(part))).tolist() == want


@pytest.mark.parametrize(("chunk", "overlap"), [(60, 34), (200, 64), (400, 100)])
def test_spliced_counts(chunk, overlap):
    own = token_counts.ChunkCounter(BPE, chunk, overlap)
    for k, t in enumerate(texts(250, 3, 300)):
        t = t[:30] + "x" * (97 * k % 700) + t[30:] if k % 5 == 0 else t
        assert own.spliced(t) == len(own.tok.encode(t, add_special_tokens=False).ids)
    assert own.widened


def thue_morse(n):
    """A word and its complement: polynomial hashes modulo a power of two can't tell them apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [16, 1024, 8192, 65536])
def test_words_that_collide_in_polynomial_hashes(spark, model, n):
    words = thue_morse(n)
    lib = load(BPE)
    rows = frame(spark, [(i, w, "x") for i, w in enumerate(words)])
    want = [lib.encode(w, add_special_tokens=False).ids for w in words]
    own = token_counts.ChunkCounter(BPE)
    assert own.counts(*flat(pa.array(words))).tolist() == [len(w) for w in want]
    assert own.encode(*flat(pa.array(words)))[0].tolist() == want[0] + want[1]
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(rows, BPE).collect()}
    assert [counted[0], counted[1]] == [len(w) for w in want]
    for w in words if n <= 8192 else []:
        assert model.decode(model.encode(*flat(pa.array([words[0], w])))[0].tolist()).endswith(w)
    assert all(r["round_trip"] for r in unigram.encode_documents(rows, PIECES).collect())


def test_names_of_pieces():
    """Up to 15 bytes a name is the piece: zero bytes and lengths count."""
    pieces = [b"a", b"a\0", b"\0", b"\0\0", b"x" * 15, b"x" * 16, b"x" * 255, b"y" * 300, b"12345678", b"12345678\0", b"a"]
    ends = np.cumsum([len(p) for p in pieces])
    low, high = names(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], ends[:-1])), ends)
    assert len(set(zip(low.tolist(), high.tolist(), strict=True))) == len(set(pieces))
    assert (low[0], high[0]) == (low[-1], high[-1])
    same = np.zeros(len(pieces), np.uint64)  # hashes that all collide
    first, back = distinct(low, high, same)
    assert sorted(pieces[i] for i in first.tolist()) == sorted(set(pieces))
    assert [pieces[first[k]] for k in back.tolist()] == pieces


def test_count_tokens(spark):
    many = [None, "", "word " * 9000, "z" * 40000, "<|endoftext|>", *texts(30, 4)]
    rows = token_counts.count_tokens(frame(spark, [(i, t, "x") for i, t in enumerate(many)]), BPE).collect()
    lib = load(BPE)
    for r in rows:
        t = many[r["doc_id"]] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    assert len(rows) == len(many)
    assert token_counts.count_tokens(frame(spark, []), BPE).count() == 0


def test_store_round_trip(spark):
    many = [(5, "b"), (1, None), (3, "shared passage " * 3000), (4, "lead " + "shared passage " * 3000), (2, ""), (2, ""), (9, "z" * 5000)]
    many += [(10 + i, t) for i, t in enumerate(texts(20, 5))]
    path = token_store.write(frame(spark, [(i, t, "x") for i, t in many]), BPE)
    token_store.verify(spark, path)
    lib = load(BPE)
    want, at = [], 0
    for i, t in sorted(many, key=lambda x: x[0]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = sorted(tuple(r) for r in token_store.digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == [w[:4] for w in want]
    back = sorted((r["start"], r["ids"]) for r in token_store.reconstruct(spark, path).collect())
    assert back == [(w[1], w[4]) for w in want]
    chunks = token_store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("name").distinct().count()


def test_store_of_mostly_equal_documents(spark, monkeypatch):
    """Roots and chunks that most documents use go by a broadcast, with the same result."""
    monkeypatch.setattr(token_store, "HOT", 5)
    passage = "licensed under the same terms as before " * 400
    many = [(i, "" if i % 3 else passage + str(i % 6)) for i in range(90)] + [(100 + i, f"other {i}") for i in range(4)]
    path = token_store.write(frame(spark, [(i, t, "x") for i, t in many]), BPE)
    lib = load(BPE)
    want, at = [], 0
    for i, t in many:
        ids = lib.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_store.digests(spark, path).collect()) == want


def test_store_of_nothing(spark):
    path = token_store.write(frame(spark, []), BPE)
    token_store.verify(spark, path)
    assert token_store.digests(spark, path).count() == 0


def test_damage_is_found(spark):
    name = token_store.address(b"\x02ab")
    batch = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"\x02ax"])], ["name", "chunk"])
    with pytest.raises(ValueError, match="damaged"):
        list(token_store._measure([batch]))


def test_shared_passages_share_chunks():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50000, 6000).astype(np.uint32)
    streams = [np.concatenate((rng.integers(0, 50000, n).astype(np.uint32), passage)) for n in (3, 100)]
    names = []
    for s in streams:
        cuts = token_store.boundaries(s, np.array([0, len(s)]))
        sizes = np.diff(np.concatenate(([0], cuts)))
        assert cuts[-1] == len(s) and sizes.max() <= token_store.MOST and (sizes[:-1] >= token_store.LEAST).all()
        names.append({s[a:b].tobytes() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)})
    assert len(names[0] & names[1]) >= len(names[0]) - 4


def test_crc_of_parts():
    rng = random.Random(6)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 4, 40, 400]))) for _ in range(50)]
    offsets = np.array([0, 0, 7, 8, 30, 50])
    got = token_store.crc_of_parts(np.array([zlib.crc32(p) for p in parts], np.uint32), np.array([len(p) for p in parts]), offsets)
    assert got.tolist() == [zlib.crc32(b"".join(parts[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@pytest.fixture(scope="module")
def model():
    return unigram.Unigram(PIECES)


def test_viterbi_is_the_best_path(model):
    """The library's best of n, with the model read as a unigram one; compared by score."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(open(PIECES, "rb").read())
    spec.trainer_spec.model_type = 1
    lib = sentencepiece.SentencePieceProcessor()
    lib.LoadFromSerializedProto(spec.SerializeToString())
    for text in ["the cat", "and with of", "erntsthe tiwhed ththwh", "Heitlich der", "token", "internationalization"]:
        ids = model.viterbi("▁" + text.replace(" ", "▁"))
        score = lambda x: sum(spec.pieces[i].score for i in x)
        assert score(ids) == pytest.approx(max(score(x) for x in lib.nbest_encode(text, nbest_size=5)))


def test_trie_holds_all_pieces():
    keys = {k: i for i, k in enumerate(["a", "ab", "abc", "b", "▁", "▁a", "日本"])}
    trie = unigram.DoubleArray(keys)
    for key, value in keys.items():
        s = 0
        for c in key:
            to = trie.base[s] + trie.code[c]
            assert trie.check[to] == s
            s = to
        assert trie.value[s] == value


def test_sentencepiece_round_trip(spark, model):
    many = [None, "", " ", "  two  spaces ", "\n\nlines\n", "▁literal ▁ marks", "日本🙂é", "a" * 3000, *texts(60, 7)]
    for t in many[1:]:
        ids, _ = model.encode(*flat(pa.array([t])))
        assert ids.tolist() == (model.viterbi("▁" + t.replace(" ", "▁")) if t else [])
        assert model.decode(ids.tolist()) == t.replace("▁", " ")
    rows = unigram.encode_documents(frame(spark, [(i, t, "x") for i, t in enumerate(many)]), PIECES).collect()
    assert len(rows) == len(many) and all(r["round_trip"] for r in rows)
    out = unigram.to_ids(frame(spark, [(i, t, "x") for i, t in enumerate(many)]), PIECES).collect()
    assert {r["doc_id"]: len(r["token_ids"]) for r in out} == {r["doc_id"]: r["n_tokens"] for r in rows}
    assert unigram.encode_documents(frame(spark, []), PIECES).count() == 0
    twice = unigram.encode_documents(frame(spark, [(1, "same text", "x")] * 3), PIECES).collect()
    assert len(twice) == 3 and len(set(twice)) == 1
    df = spark.createDataFrame([(1, "a text", 7, "kept")], "doc_id long, text string, token_ids int, `a.b` string")
    out = unigram.to_ids(df, PIECES)
    assert out.columns == ["doc_id", "a.b", "n_tokens", "token_ids"]
    assert out.collect()[0][1:3] == ("kept", len(model.viterbi("▁a▁text")))


def test_many_paths_at_once(model, monkeypatch):
    """The same ids as one text at a time, for words of all lengths, characters without a piece and empty texts."""
    monkeypatch.setattr(unigram, "TOGETHER", 70)
    rng = random.Random(12)
    letters = ["the", "an", "▁", "e", "r", "日", "🙂", "\n", "ß", "qu", "1", "\x01", "\ud7ff"]
    many = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 9, 30]))) for _ in range(600)] + ["the" * 40, "日" * 100]
    ids, sizes = model.viterbi_many(many)
    want = [model.viterbi(t) for t in many]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert model.viterbi_many([])[0].tolist() == []


def all_segmentations(s, pieces):
    if not s:
        return [[]]
    return [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in pieces for rest in all_segmentations(s[k:], pieces)]


def test_viterbi_by_all_segmentations(model):
    """The path's score is the best of all segmentations, characters without a piece costing the same in each."""
    rng = random.Random(8)
    pieces = {p: model.score[i] for p, i in piece_ids(model).items()}
    for _ in range(150):
        s = "▁" + "".join(rng.choice("theaonisr▁") for _ in range(rng.randint(1, 12)))
        best = max(sum(pieces[p] for p in path) for path in all_segmentations(s, pieces))
        assert sum(model.score[i] for i in model.viterbi(s)) == pytest.approx(best)


def piece_ids(model):
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(open(PIECES, "rb").read())
    return {p.piece: i for i, p in enumerate(spec.pieces) if p.type in (unigram.NORMAL, unigram.USER)}
