import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers

from lumiray.llm import alignment, tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_tokens(text):
    """(id, bytes) of both libraries, each encoding the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    entries = tokens.byte_entries(A)
    side_a = [(i, entries[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
    side_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (side_a, side_b) if text and b"".join(x for _, x in side_a) == whole == b"".join(x for _, x in side_b) else ([], [])


def plain(rows):
    """Every overlap of two byte ranges, token by token."""
    found, counts = [], Counter()
    for doc_id, text in rows:
        sides = plain_tokens(text or "")
        spans = []
        for side in sides:
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        cuts = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, begin = [], 0
        for end in cuts:
            groups.append("|".join(",".join(str(i) for i, a, b in side if begin <= a and b <= end) for side in spans))
            begin = end
        found.append((doc_id, len(spans[0]), len(spans[1]), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return Counter((d, a, b, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), h) for d, a, b, g, x, h in found)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["a ", " a", "  ", "a  b", "\ta\n", "<s>x</s><|endoftext|>", "▁x", "éﬁ", "\0a", "a　b", "don't  we'll\r\n 12345 ---- ", "x" * 900, "    indent\n\n\n  more", "日本語のテキスト"]


def test_every_overlap(table, odd, words):
    rng = random.Random(3)
    short = [(i, t if t is None or len(t) < 3000 else t[:3000], s) for i, t, s in odd]
    rows = short + [(20 + k, t, None) for k, t in enumerate(ODD)] + [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), "s") for k in range(40)]
    found = alignment.align_documents(table(rows), A, B)
    assert tuple(found.columns) == COLUMNS
    assert Counter(map(tuple, found.collect())) == plain([(i, t) for i, t, _ in rows])


def test_shuffled_counts_are_the_same(table, odd, monkeypatch):
    rows = [(i, t if t is None else t[:2000], s) for i, t, s in odd]
    here = Counter(map(tuple, alignment.align_documents(table(rows), A, B).collect()))
    monkeypatch.setattr(alignment, "broadcast_if_small", lambda df: df)
    assert Counter(map(tuple, alignment.align_documents(table(rows), A, B).collect())) == here


def test_lockstep_needs_no_more_steps_for_long_texts():
    rng = np.random.default_rng(4)
    n = 400_000
    a_end, b_end = (np.unique(np.append(rng.integers(1, n, n // 4), n)) for _ in range(2))
    starts = alignment.lanes(a_end, b_end, np.array([n]))
    link_a, link_b, cut = alignment.lockstep(a_end, b_end, *starts)
    every = np.union1d(a_end, b_end)
    assert len(starts[0]) > n // (2 * alignment.STRETCH)
    assert (link_a == np.searchsorted(a_end, every)).all() and (link_b == np.searchsorted(b_end, every)).all()
    assert (cut == np.isin(every, np.intersect1d(a_end, b_end))).all()


def test_a_token_without_shared_ends_and_none():
    assert [x.tolist() for x in alignment.lockstep(np.array([9]), np.arange(1, 10), np.array([0]), np.array([0]))] == [[0] * 9, list(range(9)), [False] * 8 + [True]]
    assert [len(x) for x in alignment.lockstep(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0]


def test_whole_long_text_and_empty_table(table, odd):
    long = next(r for r in odd if r[0] == -8)
    (r,) = alignment.align_documents(table([long]), A, B).collect()
    side_a, side_b = plain_tokens(long[1])
    assert (r["n_a"], r["n_b"]) == (len(side_a), len(side_b)) and r["n_links"] >= max(r["n_a"], r["n_b"])
    assert alignment.align_documents(table([]), A, B).collect() == []


def test_segments_give_the_models_ids(words):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=B)
    rng = random.Random(8)
    texts = ["".join(rng.choice(words + [" ", "  ", "\n", "é", "12", "日本", "▁", "\U0001f600"]) + rng.choice(["", " "]) for _ in range(50)) for _ in range(200)] + [t for t in ODD if t]
    found = tokens.segment_tokenizer(B).encode([(" " + t).encode() for t in texts])
    assert [f.tolist() for f in found] == [model.encode(t) for t in texts]
