"""Byte pairs, token files and the coder."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyflow.llm import byte_pairs, context_coder, token_files
from tallyflow.session import stage_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return byte_pairs.vocabulary(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def unpacked(data):
    return np.frombuffer(data, "<u4").tolist()


def test_pieces_of_every_size(vocabulary, reference):
    rng = random.Random(4)
    pieces = [b"a" * n for n in (1, 2, 7, 8, 9, 63, 64, 65, 1000)]
    pieces += [bytes(rng.choice(b"abcdeinorst") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    pieces += [bytes(rng.randrange(256) for _ in range(rng.randint(1, 80))) for _ in range(100)]
    for piece, ids in zip(pieces, vocabulary.encode_pieces(pieces)):
        want = reference._encode_single_piece(piece)
        assert unpacked(ids) == want and vocabulary.encode_piece(piece) == want
        assert vocabulary.decode(np.array(want)) == piece


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    vocabulary = byte_pairs.vocabulary(RANKS, public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    if any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        return
    assert unpacked(vocabulary.encode_texts([text])[0]) == reference.encode_ordinary(text)


def test_a_full_memory_changes_nothing(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 3)
    texts = ["the thing one", "two three four", "the thing one"]
    assert [unpacked(x) for x in vocabulary.encode_texts(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_round_trip_of_odd_texts(table, odd_rows, reference):
    docs = table(odd_rows)
    got = [tuple(r) for r in byte_pairs.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()]
    want = []
    for k, t, _ in odd_rows:
        ids = reference.encode_ordinary(t or "")
        packed = np.array(ids, "<u4").tobytes()
        want.append((k, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    ids = {r["doc_id"]: r["ids"] for r in byte_pairs.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert ids[8] == reference.encode_ordinary("two words") and ids[2] == []
    assert byte_pairs.round_trip(docs.filter("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_files_of_odd_texts(spark, table, odd_rows, monkeypatch):
    # As many chunks as possible: one for each document.
    monkeypatch.setattr(token_files, "CHUNK_IDS", 1)
    path = stage_path(spark, "test-token-files")
    token_files.write(table(odd_rows), path, WORDS)
    got = [tuple(r) for r in token_files.read_back(spark, path).orderBy("start").collect()]
    tokenizer, want, start = Tokenizer.from_file(WORDS), [], 0
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for k, t, _ in ordered:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" .,'Aa1\u0301\u0307Iı\n<|")), max_size=40))
def test_words_have_the_ids_of_the_whole_text(text):
    text += " It's. so, <|endoftext|> A.\u0301 b.. c.,d"
    words = token_files.tokenizer(WORDS)
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    for t, ids in ((text, want), (text.replace("<|", ""), words.tokenizer.encode(text.replace("<|", ""), add_special_tokens=False).ids)):
        assert words.encode([t.encode()], 2)[0].tolist() == ids + [2]


def test_files_of_no_documents(spark, table):
    path = stage_path(spark, "test-token-files")
    token_files.write(table([(1, "x", "s")]).filter("false"), path, WORDS)
    assert token_files.read_back(spark, path).count() == 0


@pytest.mark.parametrize("case", ["constant", "random", "skewed", "repeating", "uneven"])
def test_coder_round_trip(case):
    rng = np.random.default_rng(3)
    blocks = {
        "constant": [np.zeros(3000, int)],
        "random": [rng.integers(0, 65536, 1500) for _ in range(3)],
        "skewed": [rng.geometric(0.01, 1200) for _ in range(40)],
        "repeating": [np.tile(rng.integers(0, 50_000, 40), 30) for _ in range(5)],
        "uneven": [rng.integers(0, 9, n) for n in (1, 2, 700, 3, 699, 1)],
    }[case]
    payloads = context_coder.encode_blocks(blocks)
    decoded = context_coder.decode_blocks(payloads, np.array([len(b) for b in blocks]))
    assert all(np.array_equal(a, b) for a, b in zip(blocks, decoded))
    raw = sum(2 * len(b) for b in blocks)
    if case in ("constant", "skewed", "repeating"):
        assert sum(map(len, payloads)) < 0.8 * raw
    # A block can be read alone.
    alone = context_coder.decode_blocks(payloads[-1:], np.array([len(blocks[-1])]))
    assert np.array_equal(alone[0], blocks[-1])


def test_ids_beyond_16_bits_and_blocks_that_are_too_long():
    blocks = [np.array([0, 1 << 31, 254, 255, 256, 511, 70_000, 1 << 31]), np.arange(2048) * 300]
    payloads = context_coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, context_coder.decode_blocks(payloads, np.array([8, 2048]))))
    for bad in (np.zeros(40_000, int), np.zeros(0, int), np.arange(2100)):
        with pytest.raises(ValueError):
            context_coder.encode_blocks([bad])


def test_a_coder_beats_plain_frequencies_and_zlib(spark):
    """The ids of documents, in blocks of full size."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    stream = np.concatenate(token_files.tokenizer(WORDS).encode([(t or "").encode() for t in texts], 2)).astype(np.int64)
    blocks = [stream[a : a + 2048] for a in range(0, len(stream) - 2047, 2048)][:16]
    size = sum(map(len, context_coder.encode_blocks(blocks)))
    assert size < sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)
    # Adaptive order 0 with a flat escape, the textbook's plain model.
    plain = 0.0
    for b in blocks:
        seen: dict[int, int] = {}
        for n, x in enumerate(b.tolist()):
            d = len(seen)
            plain -= np.log2(seen[x] / (n + d)) if x in seen else np.log2(max(d, 1) / max(n + d, 1)) - np.log2(49_408)
            seen[x] = seen.get(x, 0) + 1
    assert 8 * size < plain


def test_only_a_tokenizer_that_ignores_spaces_is_used_word_by_word(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"Two": 0, "two": 1, " ": 2, "x": 3}, unk_token="x"))
    plain.pre_tokenizer = pre_tokenizers.Split(" ", "isolated")
    plain.save(f"{tmp_path}/plain.json")
    words = token_files.Words(f"{tmp_path}/plain.json")
    assert not words.by_words and words.encode([b"Two two", b""], 9)[0].tolist() == [0, 2, 1, 9]
    assert token_files.tokenizer(WORDS).by_words


def test_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 49_000, 5000).astype("<u4")
    chunk = token_files.pack([7, None], [ids[:4999], ids[4999:]])
    documents, back = token_files.unpack(chunk)
    assert documents["doc_id"].tolist() == [7, 0] and np.array_equal(back, ids)
    bad = bytearray(chunk)
    bad[-300] ^= 5
    with pytest.raises(ValueError):
        token_files.unpack(bytes(bad))
    with pytest.raises(ValueError):
        token_files.unpack(b"XXXX" + chunk[4:])


def test_an_id_takes_one_step_of_the_range_coder(monkeypatch):
    steps = []
    for side in (context_coder.Encoder, context_coder.Decoder):
        narrow = side.narrow
        monkeypatch.setattr(side, "narrow", lambda self, add, rng, narrow=narrow: (steps.append(len(add)), narrow(self, add, rng)))
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, 3000, n) for n in (400, 90, 400)]
    payloads = context_coder.encode_blocks(blocks)
    assert sum(steps) == 890
    context_coder.decode_blocks(payloads, np.array([400, 90, 400]))
    assert sum(steps) == 2 * 890


def test_the_longest_blocks_with_the_most_ids():
    rng = np.random.default_rng(6)
    n, most = context_coder.LONGEST, context_coder.MOST_IDS
    even = np.concatenate([rng.permutation(most), rng.integers(0, most, n - most)])
    skewed = np.concatenate([np.arange(most), np.minimum(rng.geometric(0.3, n - most), most - 1)])
    sure = np.concatenate([np.arange(most), np.zeros(n - 2 * most, int), rng.permutation(most)])
    payloads = context_coder.encode_blocks([even, skewed, sure])
    for a, b in zip([even, skewed, sure], context_coder.decode_blocks(payloads, np.full(3, n))):
        assert np.array_equal(a, b)


def test_carries_reach_earlier_digits():
    coder = context_coder.Encoder(2, 8)
    coder.out[1:4] = (5, context_coder.DIGIT - 1, context_coder.DIGIT)
    coder.at += 3
    assert coder.finish()[0] == bytes([6, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0])


def test_words_with_marks_are_encoded_once(monkeypatch):
    words = token_files.Words(WORDS)
    encoded = []
    monkeypatch.setattr(words, "keep", lambda by, new, keep=words.keep: (encoded.extend(new), keep(by, new)))
    text = "Thingly thingly, thingly%%% (thingly).  thingly\u00e9 thingly,%%% x|y |"
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert words.encode([text.encode(), b""], 2)[0].tolist() == [*want, 2]
    assert encoded.count("thingly") == 1 and not {"thingly,", "thingly%%%", "thingly,%%%"} & {*encoded}
    # What the generation before knows is not encoded again.
    monkeypatch.setattr(token_files, "REMEMBERED", 0)
    n = len(encoded)
    assert words.encode([text.encode()], 2)[0].tolist() == [*want, 2] and len(encoded) == n


ODD = st.sampled_from(" %$,.'\"(~|<>@_-aZz9\u00e9\u00c9\u00df\u00ff\u00aa\u00b5\u00d7\u00f7\u0301\u0130\u00a0\x85\x1c")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ODD, max_size=25), max_size=4))
def test_marks_and_accents_have_the_ids_of_the_whole_text(texts):
    words = token_files.tokenizer(WORDS)
    found = words.encode([t.encode() for t in texts], 2) if texts else []
    assert [f.tolist() for f in found] == [[*words.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
