import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nearfield.llm.tokens import Encoder, token_output
from nearfield.llm.wavelet import Shard, encode

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN, SHARED = Tokenizer.from_file(PATH), Encoder(PATH)
TEXTS = ["", None, "  a  b\n\nc ", "It's 12.5%, ok...", "naïve café İstanbul ΣΑΣ क़ख़", "ábc d́ ́", "x\x1cy\x85z w　v", "<|endoftext|> <|startoftext|>x", "日本語。テスト,", ",a,b. c,. d.,", "ﬁ ﬂ ¼", "क़. क़", "É. ß, ÿ.", "word " * 20000]


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def encoded(enc, texts):
    got, ends = enc.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(got, ends[:-1])] if texts else []


def test_encoder_against_library():
    enc = Encoder(PATH, cached=6)
    for _ in range(3):
        assert encoded(enc, TEXTS) == [ids(t) for t in TEXTS]
        enc.trim(3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=5))
def test_encoder_on_any_text(texts):
    assert encoded(Encoder(PATH), texts) == [ids(t) for t in texts]


SIGNED = ["word$$$ Word!! WORD.*** word,&&& it's!' don't. [x] x's. a_b x_ x\\ x]^`{|}~ \"x\"", "<|EndOfText|> <|endoftext|>. X<|STARTOFTEXT|>!", "ÜBER$$ Éa.% ª! ×! ÷", "I\u0307. A\u0301!! =\u0338 x=\u0338 K\u212a!", "Word WORD word"]


def test_letters_with_signs_are_encoded_by_parts():
    """Of words in capitals, or with signs after them, letters and signs are encoded once each, not every piece."""
    enc, seen = Encoder(PATH), []
    plain = enc._ids
    enc._ids = lambda pieces: seen.extend(pieces.to_pylist()) or plain(pieces)
    assert encoded(enc, ["word$$$ Word!! WORD.*** word,&&& worD"]) == [ids("word$$$ Word!! WORD.*** word,&&& worD")]
    assert sorted(seen) == sorted(["word", "$$$", "!!", ".***", ",&&&"])
    for text in SIGNED:
        assert encoded(enc, [text, None, text]) == [ids(text), [], ids(text)]
    assert encoded(Encoder(PATH), SIGNED) == [ids(t) for t in SIGNED]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aZé'$.!<|_ \u0301\u0307Is\\`9", max_size=30), min_size=1, max_size=5))
def test_encoder_on_letters_and_signs(texts):
    assert encoded(SHARED, texts) == [ids(t) for t in texts]


def test_output(spark):
    rows = [(i * 13 % 101 - 5, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(3, "again"), (3, "again"), (None, "no id")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, start string")
    for shard_tokens in (8_000_000, 50):
        got = sorted(((r.doc_id is not None, r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in token_output(df, PATH, shard_tokens=shard_tokens).collect()), key=lambda r: r[-1])
        want = sorted((i is not None, i, len(ids(t)) + 1, zlib.crc32(np.array([*ids(t), 2], "<u4").tobytes())) for i, t in rows if i is not None)
        assert sorted(g[:-1] for g in got if g[0]) == want
        assert [g[1] for g in got] == sorted((g[1] for g in got), key=lambda i: (i is not None, i))
        at = 0
        for g in got:
            assert g[-1] == at
            at += g[2]


def test_empty(spark):
    assert token_output(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (5000, 49407), (3000, 3), (777, 70000)])
def test_wavelet_matrix(n, top):
    rng = np.random.default_rng(n)
    a = (rng.zipf(1.3, n) % (top + 1)).astype(np.uint32)
    ends = np.array([n // 3, n // 3, n])
    s = Shard(encode(a, [5, None, 9], ends))
    assert (s.decode() == a).all() and s.doc_ids == [5, None, 9] and (s.ends == ends).all()
    assert (s.ids(2) == a[n // 3 :]).all() if n < 4000 else True
    for i in rng.integers(0, n, 60) if n else []:
        assert s.access(int(i)) == a[i]
        token = int(a[i])
        places = np.flatnonzero(a == token)
        assert s.count(token) == len(places) and s.rank(token, int(i)) == (places < i).sum()
        k = int(rng.integers(len(places)))
        assert s.select(token, k) == places[k]
    assert s.count(top + 1) == 0 and s.count(1 << 40) == 0
    with pytest.raises(IndexError):
        s.access(n)
