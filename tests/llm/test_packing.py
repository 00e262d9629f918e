import zlib
from collections import defaultdict

import numpy as np
import pytest

from tokenizers import Tokenizer

from lumiray.llm import packing, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a  b\n\n c's it's it'sabc ''s  'llx I'll 'd\t\tx  ", " ", "\n", "a b  c", "<|endoftext|>x 12ab3 ½!!! $$ a'", "'", "x're've'm", "日本語 テスト\0\1", "\U0001f600 é é"]


def test_ids_are_the_librarys(words):
    own = tokens.PieceTokenizer(PATH)
    texts = [*ODD, " ".join(words), "\n".join(words[:50]) * 3]
    assert [x.tolist() for x in own.encode(texts)] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_are_the_librarys_by_default(words):
    fresh = Tokenizer.from_file(PATH)
    texts = [*ODD, "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", " ".join(words[:100]), ""]
    found = [x.tolist() for x in tokens.PieceTokenizer(PATH, special=True).encode(texts)]
    assert found == [fresh.encode(t, add_special_tokens=False).ids for t in texts] and [50256] in found
    assert 50256 not in tokens.PieceTokenizer(PATH).encode(["<|endoftext|>"])[0]


def test_pieces_cover_documents_and_fill_sequences(table, words, odd):
    rng = np.random.default_rng(2)
    odd = [*odd, (11, "before<|endoftext|>behind <|endoftext|>", "s")]
    rows = odd + [(1000 + k, " ".join(rng.choice(words, rng.integers(1, 300))), "s") for k in range(300)]
    found = packing.pack(table(rows), PATH, window=256, step=8, group=50, keep_ids=True).collect()
    library = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 256):
            want[i, k, zlib.crc32(ids[k : k + 256].tobytes()), len(ids)] += 1
    have, sequences = defaultdict(int), defaultdict(list)
    for r in found:
        have[r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]] += 1
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) * 256 <= 1.1 * sum(r["length"] for r in found)


def test_least_squares():
    rng = np.random.default_rng(1)
    a, x = rng.random((6, 15)), np.zeros(15)
    x[[2, 7]] = 3, 1.5
    found = packing.nonnegative_least_squares(a, a @ x)
    assert found.min() >= 0 and np.allclose(a @ found, a @ x)
    b = rng.standard_normal(6)
    found = packing.nonnegative_least_squares(a, b)
    slope = a.T @ (b - a @ found)
    assert slope.max() < 1e-6 and np.abs(slope[found > 0]).max(initial=0) < 1e-6


def test_repeats_never_exceed_the_histogram():
    histogram = np.array([5, 0, 9, 1, 30, 2, 4, 8])
    used = np.zeros(8, int)
    for way, n in packing.repeats(histogram):
        assert sum(way) == 8
        for c in way:
            used[c - 1] += n
    assert (used <= histogram).all() and used.sum() > 0


def test_empty_table(table):
    assert packing.pack(table([]), PATH).collect() == []
