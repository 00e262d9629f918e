import random

from lumiray.llm import line_dedup


def near(a, b):
    """Within one insertion, deletion or replacement."""
    if len(a) > len(b):
        a, b = b, a
    p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[p:] == b[p + 1 :]


def by_hand(rows, least):
    """Kept lines of each row by comparing with all earlier lines."""
    place = lambda i: (i is None, i)
    lines = sorted(((*place(i), k), line) for i, t, _ in rows for k, line in enumerate((t or "").split("\n")) if len(line) >= least)
    gone = {p for n, (p, line) in enumerate(lines) if any(q < p and (line == other or near(line, other)) for q, other in lines[:n])}
    return sorted(
        ((i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if len(x) < least or (*place(i), k) not in gone)) for i, t, _ in rows), key=str
    )


def edited(rng, line):
    k = rng.randrange(len(line) + 1)
    return rng.choice([line[:k] + "é" + line[k:], line[: k - 1] + line[k:] if k else line[1:], line[:k] + "\U0001f600" + line[k + 1 :], line])


def test_kept_lines_equal_all_pairs(table, words, odd):
    rng = random.Random(8)
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 9))) for _ in range(40)]
    texts = []
    for _ in range(120):
        lines = [edited(rng, edited(rng, rng.choice(base))) if rng.random() < 0.7 else rng.choice(["", "short", " ".join(rng.choice(words) for _ in range(7))]) for _ in range(rng.randint(1, 6))]
        texts.append("\n".join(lines))
    rows = odd + [(200 + k, t, "s") for k, t in enumerate(texts)]
    df = table(rows)
    found = line_dedup.dedup_lines(df, least=12)
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str) == by_hand(rows, 12)
    for r in found.collect():
        assert r["n_lines"] == (r["text"] or "").count("\n") + 1 + r["n_dropped"] or r["text"] == ""


def test_documents_left_without_words_go(table):
    line = "a line that is long enough to be looked at"
    rows = [(1, line, "s"), (2, line, "s"), (3, line + "\nand more of it, but not the same line", "s"), (4, "", "s"), (5, None, "s")]
    df = table(rows)
    found = line_dedup.without_repeated_lines(df)
    assert found.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in found.collect()) == [(1, line, len(line)), (3, rows[2][1].split("\n")[1], 37), (4, "", 0), (5, None, None)]


def test_empty_table(table):
    assert line_dedup.dedup_lines(table([])).collect() == []
    assert line_dedup.without_repeated_lines(table([])).collect() == []


def test_rows_of_one_id_lose_only_their_own_lines(table):
    x, y = "a line that comes in two of the documents", "another one, which is nowhere else in the corpus"
    rows = [(7, x, "s"), (None, x, "s"), (None, y, "s"), (8, x + "\n" + y[::-1], "s"), (8, y[::-1].upper() + "\n" + x.upper(), "s")]
    df = table(rows)
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(df).collect())
    assert kept == sorted([(7, x), (0, ""), (0, y), (8, y[::-1]), (8, rows[4][1])])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.without_repeated_lines(df).collect()) == sorted([(7, x), (0, y), (8, y[::-1]), (8, rows[4][1])])


def test_near_lines_of_rows_without_an_id(table):
    a, b = "the first of two lines that are much alike", "a line that only the other document has at all"
    rows = [(None, a + "\n" + b, "s"), (None, "nothing like the others, but long enough\n" + a + "x", "s")]
    kept = sorted(r["text"] for r in line_dedup.dedup_lines(table(rows)).collect())
    assert kept == sorted([rows[0][1], rows[1][1].split("\n")[0]])


def test_short_lines_repeat_but_blank_ones_stay(table):
    rows = [(1, "Yes.\n\n }\nNo.", "s"), (2, "Yes\n\nYes.\n }\n \t\nNo.\nNo.", "s"), (3, "Yes.\n\n \t", "s"), (4, "No.", "s")]
    df = table(rows)
    kept = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(df, any_length=True).collect()}
    assert kept == {1: (rows[0][1], 0), 2: ("Yes\n\n \t", 4), 3: ("\n \t", 1), 4: ("", 1)}
    assert sorted(r["doc_id"] for r in line_dedup.without_repeated_lines(df, any_length=True).collect()) == [1, 2]


def test_negative_ids_with_several_lines(table):
    lines = ["one line of some length, the first of all", "a second line that is not at all the same", "and the third, with words of its own again"]
    rows = [(-7, "\n".join(lines), "s"), (-3, "\n".join(x + "!" for x in reversed(lines)), "s"), (2, lines[1] + "?\nthis one stays because nobody else has it", "s")]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(rows)).collect()}
    assert kept == {-7: rows[0][1], -3: "", 2: "this one stays because nobody else has it"}
