"""Benchmark items that are found in whatever type and setting they stand."""

from termweave.llm.decontaminate import Index, templates

NORMAL = "the old miller walks along the quiet river and counts the white stones until the evening bell rings over the valley"
TITLE = "The Annual Report Of The Northern Harbour Company And Its Many Branches"
TABLE = "Oslo 412 17 Bergen 380 21 Tromso 95 3 Narvik 61 8 Bodo 77 12"


def found(items, text):
    return sorted(i for i, _ in Index(list(enumerate(items))).find(text))


def test_verbatim_where_slots_are_dense():
    around = "some words before it. {} and some words after it"
    assert found([NORMAL], around.format(NORMAL.upper())) == [0]
    assert found([TITLE, TABLE], around.format(TITLE)) == [0]
    assert found([TITLE, TABLE], TITLE.lower()) == [0]
    assert found([TITLE, TABLE], around.format(TABLE)) == [1]
    assert found([TITLE, TABLE], "Oslo 410 17 Bergen 382 21 Tromso 91 3 Narvik 62 8 Bodo 70 12") == []


def test_part_with_a_dense_spot():
    words = (NORMAL + " where Anna Bergmann met Karl Olsen 12 April 1987 at 7 and both went home " + NORMAL[::-1]).split()
    spot = words.index("Anna")
    part = " ".join(words[spot - 5 : spot + 13])
    assert found([" ".join(words)], "own words stand here " + part + " and more of them here") == [0]


def test_short_items_in_any_setting():
    items = ["What is the capital of France?", "Pi is irrational", "Gold", "--- ...", ""]
    assert found(items, "Geography\nWhat is the capital of France?") == [0]
    assert found(items, "1) What is the capital of France? Paris.") == [0]
    assert found(items, "Quiz\nWhat is the capital of Norway?") == [0]
    assert found(items, "It is said that Berlin is the capital of Norway.") == []
    assert found(items, "as PI is irrational, so is pi / 2") == [1]
    assert found(items, "a vein of gold, --- ... they said") == [2]
    assert found(items, "pi is rational and marigold is a flower") == []


def test_typographic_signs():
    item = 'He said "the ship - an old one - leaves at 5", and \'nobody\' knew why it did...'
    curly = "He said “the ship — an old one – leaves at 5”, and ‘nobody’ knew why it did…"
    angled = "¿He said «the ship — an old one — leaves at 5», and „nobody“ knew why it did…"
    assert found([item], "Intro. " + curly) == found([curly], "Intro. " + item) == found([item], angled) == [0]
    quoted = "nine plain words stand here for a short item"
    assert found([quoted], f"a “{quoted}” b") == found([quoted], f"a •«{quoted}»™ b") == [0]
    assert found(["two small words"], "a «two small words»") == [0]
    a, b, *_ = map(templates, ("3×4 → x→y cafés", "3÷4 - x-y cafés"))
    assert (a[3] == b[3]).tolist() == [False, True, False, True]
    assert templates("“Bergen”")[0] == templates("\"Bergen\"")[0]
    assert templates("so “Bergen” it is")[1].tolist() == [False, True, False, False]
