import hashlib
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from privloom.llm import byte_bpe, encode_op  # noqa: E402


@pytest.fixture(scope="module")
def both():
    ranks = byte_bpe.load_ranks(P.path(encode_op.RANKS))
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), *byte_bpe.monoid_text_encoder(ranks, P.PATTERN)


TEXTS = ["", " ", "  a", "a  b", "x \n y", "\n\n", "it's 'S don't", "a b c d", "a\x1cb \x1f c", "é" * 500, "ab" * 3000, " " * 1000, "a" * 5000, "\n" * 777 + "x", "日本語テキスト" * 50, "<|endoftext|> x", "١٢٣ Ⅷ ² x", "\x00퟿", "🙂🙃" * 99]


def test_matches_library(both):
    enc, bpe, text_ids = both
    rng = random.Random(7)
    alphabets = ["ab ", "the an\n", "aAbB0 .\t", "éüñ ß", "0123456789abcdef"]
    texts = TEXTS + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 400))) for _ in range(600)]
    for text in texts:
        ids = np.frombuffer(text_ids(text), "<u4").tolist()
        assert ids == enc.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_join_is_a_homomorphism(both):
    enc, bpe, _ = both
    rng = random.Random(3)
    for _ in range(400):
        piece = bytes(rng.choice(b"abcdehnrst \xc3\xa9") for _ in range(rng.randint(2, 300)))
        cut = rng.randint(0, len(piece))
        assert bpe.join(bpe._fold(piece[:cut]) if cut else [], bpe._fold(piece[cut:]) if cut < len(piece) else []) == bpe.merge(piece)


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello there", "x"), (1, "Hello there", "x"), (2, None, "y"), (3, "", "z"), (4, "a b" * 20000, "q")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in encode_op.encode_documents(df).collect()}
    assert got[2].n_tokens == got[3].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].decoded_sha256 == hashlib.sha256(b"a b" * 20000).hexdigest()
    back = {r.doc_id: bytes(r.decoded) for r in encode_op.decode_ids(encode_op.encode_documents(df)).collect()}
    assert back[1] == b"Hello there" and back[2] == b""
    assert encode_op.encode_documents(df).count() == 5
    assert encode_op.encode_documents(df.limit(0)).count() == 0


def test_query(spark, sf_dir, both):
    enc = both[0]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in encode_op.op7_byte_bpe(spark, sf_dir).collect()}
    for r in rows:
        ids = np.array(enc.encode_ordinary(r.text), "<u4")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
