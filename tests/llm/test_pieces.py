import hashlib
import random

import pytest

from capsieve.llm.pieces import SPACE, Codec, encode, read_model

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = list("abcdeth  ▁\n\t.,'é日本1230\u0000<s>") + ["</s>", "<0x41>", "  ", "    ", "the", "ing", "▁▁", "😀", "ﬁ"]
LONG = ["", None, " ", "a" * 5000, " " * 1000 + "x", "ab" * 3000, "é" * 2000, "\n" * 50, "word " * 3000]


@pytest.fixture(scope="module")
def library():
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def run(text):
        ids = p.encode(text or "", add_eos=True)
        return len(ids), " ".join(map(str, ids)), p.decode(ids)

    return run


def test_against_the_library(library):
    own, pick = Codec(*read_model(MODEL)), random.Random(1)
    for _ in range(5000):
        text = "".join(pick.choice(PARTS) for _ in range(pick.randint(0, 25)))
        assert own.encode(text) == library(text)
    for n in range(1, 70):
        assert own.encode(SPACE * n + "t") == library(SPACE * n + "t")


def test_what_decodes_to_other_text(library):
    own = Codec(*read_model(MODEL))
    texts = ["a\u2581b", "\u2581", "\u2581\u2581 x", " \u2581", "\x00 \x01", "\ufffd", "a" * 60 + " " + "\u2581" * 60, "\ud7ff\ue000", "\U0010ffff x"]
    for text in texts * 2:
        assert own.encode(text) == library(text)
        assert own.encode(text)[2] == own.decode_spelt(own.encode(text)[1])


def test_every_fit_is_what_merging_gives():
    own, pick = Codec(*read_model(MODEL)), random.Random(2)
    for _ in range(2000):
        word = SPACE + "".join(pick.choice("etaoinshr.é") for _ in range(pick.randint(1, 15)))
        assert own.split(word) == own.merge(word)


def test_frame(documents, library):
    rows = list(enumerate(LONG)) + [(3, "twice"), (3, "twice")]
    got = encode(documents(rows), MODEL).collect()
    want = sorted((i, *library(t)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in got) == want
    assert encode(documents(rows).limit(0), MODEL).count() == 0


def test_digests(spark, sf, library):
    from capsieve.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((d.doc_id, n, sha(ids), sha(back)) for d in docs for n, ids, back in [library(d.text)])
    assert sorted(map(tuple, QUERIES["op10_pieces"](spark, sf).collect())) == want
