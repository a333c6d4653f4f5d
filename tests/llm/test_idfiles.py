import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from capsieve.llm import idfiles

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["'s", "<|endoftext|>", "x<|endoftext|>", "İ", "Σ", "ΑΣ", "ŉ", "ﬁ", "́", "é", "é", "É", "ß", "ẞ", "日本語", "ひらがな。", "12", "3.5", "\x1c", "\x85", "　", "\xa0", " ", "﻿", "🙂", "don't", "WE'LL", "''s", ".'S", "<|", "|>", "\x00", "Å", "Ω", "½", "x²", "ﬀ", "한", "ᄒ", "ᅡ", "Ǆ", "ǆ", "‍", "͏"]


def texts(n, seed):
    rng = random.Random(seed)
    letters = [*"aAbBcCdDeEzZ'.,<|>-_`^~", *" \t\n\r\x0b\x0c", *SIGNS]
    return ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_library(path):
    own, library = idfiles.Encoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    assert own.by_words == (path == WORD)
    for t in texts(6_000, 1) + [" ".join(SIGNS), "A" * 5_000, "word " * 3_000]:
        assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_pack(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 2, 63, 64, 65, 1_000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        raw = idfiles.pack(ids, width)
        assert len(raw) == -(-n * width // 64) * 8
        bits = "".join(f"{x:0{width}b}"[::-1] for x in ids.tolist())
        assert int.from_bytes(raw, "little") == int(bits[::-1] or "0", 2)
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert idfiles.unpack(raw, width, a, b).tolist() == ids[a:b].tolist()


def test_file(monkeypatch):
    monkeypatch.setattr(idfiles, "BLOCK", 100)
    docs = [(7, 250), (None, 0), (-3, 1), (2**62, 1_003), (9, 46)]
    writer, rng = idfiles.Writer(40_000, 5, 77), np.random.default_rng(0)
    all_ids = [rng.integers(0, 40_000, n).astype(np.uint32) for _, n in docs]
    for (i, _), ids in zip(docs, all_ids):
        writer.add(i, ids)
    file = idfiles.Reader(writer.close() + b"\n")
    assert (file.width, file.shard, file.before, file.n_ids, len(file.offsets)) == (16, 5, 77, 1_300, 14)
    assert [None if n else i for i, n in zip(file.doc_ids.tolist(), file.no_id)] == [i for i, _ in docs]
    whole = np.concatenate(all_ids)
    for i, ids in enumerate(all_ids):
        assert file.document(i).tolist() == ids.tolist()
    for a, b in ((0, 1_300), (99, 101), (100, 200), (1_250, 1_300), (5, 5)):
        assert file.ids(a, b).tolist() == whole[a:b].tolist()
    with pytest.raises(ValueError):
        idfiles.Reader(b"x" * 300)


def brute(rows):
    library, start, out = Tokenizer.from_file(WORD), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("size", [1, 2_000, idfiles.FILE_IDS])
def test_round_trip(documents, size, monkeypatch):
    monkeypatch.setattr(idfiles, "FILE_IDS", size)
    monkeypatch.setattr(idfiles, "BLOCK", 128)
    rows = [(i * 7919 % 1_000, t) for i, t in enumerate(texts(300, 2))] + [(5_000, None), (5_001, ""), (5_002, "long text " * 40_000), (None, "a b")]
    rows += [(6_000, "the same row")] * 150
    got = idfiles.token_files(documents(rows), WORD)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


def test_same_id_other_text(documents):
    rows = [(3, "a"), (3, "b c d e"), (3, "a"), (2, "x y")]
    got = idfiles.token_files(documents(rows), WORD).orderBy("start").collect()
    assert [(r[0], r[1]) for r in got][:2] == [(2, 0), (3, 3)] and sum(r["n_tokens"] for r in got) == 12
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_empty(documents):
    assert idfiles.token_files(documents([(1, "x")]).limit(0), WORD).collect() == []
