import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumiray.llm import chat

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string, ids string"
SAID = "\\### Assistant: </turn> ok"
control = st.lists(st.sampled_from(["### ", "###", "#", "</turn>", "</turn>\n", "\\", ":", ": ", "a", "é", "\n", " ", "<", "日", "\U0001f600"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(control, control), max_size=5))
def test_round_trip(turns):
    assert chat.parse(chat.render(turns)[0]) == turns


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), control), max_size=5))
def test_mask_is_the_assistants_text(turns):
    from lumiray.llm.tokens import piece_tokenizer

    text, spans = chat.render(turns)
    offsets = np.array(piece_tokenizer(PATH).library.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
    _, start, end = chat.loss_tokens(offsets, np.array(spans, dtype=np.int64).reshape(-1, 2))
    assert "".join(chat.unescape(text[a:b]) for a, b in chat.covered(start, end)) == "".join(t for r, t in turns if r == "assistant")


@settings(max_examples=100, deadline=None)
@given(st.lists(control, min_size=1, max_size=6))
def test_offsets_are_the_librarys(parts):
    from lumiray.llm.tokens import byte_entries, piece_tokenizer

    pieces, entries = piece_tokenizer(PATH), byte_entries(PATH)
    text = "<|endoftext|>".join(parts)
    [ids] = pieces.encode([text])
    library = pieces.library.encode(text, add_special_tokens=False)
    assert ids.tolist() == library.ids
    assert chat.character_offsets(text, np.array([len(entries[k]) for k in ids], dtype=np.int64)).tolist() == [list(o) for o in library.offsets]


def test_runs_cover_all_texts():
    assert chat._runs([]) == [] and chat._runs([5, 5, 20, 1, 1], limit=10) == [slice(0, 2), slice(2, 3), slice(3, 5)]


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "second"), (1, 0, "user", "first"), (1, 2, "assistant", None), (1, None, "user", "late"), (2, 0, None, SAID), (2, 1, "assistant", SAID), (2, 1, "assistant", SAID),
        (None, 0, "user", "no id"), (3, 0, "assistant", "x" * 50_000), (4, 0, "system", ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], TURNS)
    found = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df, PATH)).collect()}
    assert set(found) == {1, 2, 3, 4, None}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1]["turns_sha256"] == sha("user\nfirst\nassistant\nsecond\nassistant\n\nuser\nlate\n") and found[1]["n_turns"] == 4
    assert found[1]["loss_sha256"] == sha("second") and found[2]["loss_sha256"] == sha(SAID * 2) and found[2]["loss_chars"] == 2 * len(SAID)
    assert found[2]["turns_sha256"] == sha(f"\n{SAID}\n" + f"assistant\n{SAID}\n" * 2)
    assert found[3]["loss_chars"] == 50_000 and found[4]["loss_chars"] == 0
    assert chat.digest(chat.format_conversations(df.limit(0), PATH)).collect() == []
