"""Decontamination against a plain version that compares every window with every window."""

import random
import re
import string

import pytest

from termweave.llm import decontaminate as dec

rng = random.Random(21)
FRAME = "the old mill by the river sells bread and fresh milk to people who walk along this way every single morning before work".split()
NAMES = ["Anna", "Peter", "Bergen", "Kyoto", "Maria"]


def tokens(text):
    """(plain, template, is slot, value) of each word, word by word."""
    out, ended = [], True
    for raw in re.findall(r"[^\x20\x09-\x0D]+", text):
        bare = raw.strip(string.punctuation)
        low = bare.lower()
        if not bare:
            plain, kind = "<mark>", None
        elif low in dec.NUMBERS or dec.NUMBER.match(low):
            plain, kind = low, "number"
        elif low in dec.UNITS:
            plain, kind = low, "unit"
        elif (q := dec.QUANTITY.match(low)) and q[1] in dec.UNITS:
            plain, kind = low, "quantity"
        elif bare[0].isupper() and (not ended or low in dec.NAMES):
            plain, kind = low, "name"
        else:
            plain, kind = low, None
        out.append((plain, f"<{kind}>" if kind else plain, kind is not None, low))
        ended = raw.rstrip("\"')]*$%&#")[-1:] in tuple(".!?:")
    return out


def holds(hits, total, width):
    hits = sorted(hits)
    if width < dec.WINDOW or len(hits) >= dec.COVER * total:
        return True
    run = longest = 1
    for a, b in zip(hits, hits[1:]):
        run = run + 1 if b == a + 1 else 1
        longest = max(longest, run)
    return longest >= dec.RUN


def consistent(item, doc, line, hits, width):
    seen = {}
    covered = {h + k for h in hits for k in range(width)}
    return all(seen.setdefault(item[k][3], doc[k + line][3]) == doc[k + line][3] for k in sorted(covered) if item[k][2])


def found_by_force(items, text):
    doc, out = tokens(text), {}
    for number, item in enumerate(map(tokens, items)):
        width = min(dec.WINDOW, len(item))
        if not width or all(t[0] == "<mark>" for t in item):
            continue

        def window(words, at, j):
            return tuple(w[j] for w in words[at : at + width])

        def usable(words, at):
            return 2 * sum(w[2] for w in words[at : at + width]) <= width

        long = len(item) >= dec.LEAST_WORDS
        named = [("<name>", "<name>", True, item[0][3]), *item[1:]]
        as_name = long and not item[0][2] and item[0][0] != "<mark>"
        places = range(len(item) - width + 1)
        counts = sum(long and usable(item, k) for k in places)
        for line in range(-len(item), len(doc)):
            fits = [k for k in places if 0 <= k + line <= len(doc) - width]
            plain = {k for k in fits if window(item, k, 0) == window(doc, k + line, 0)}
            masked = {k for k in fits if long and usable(item, k) and usable(doc, k + line) and window(item, k, 1) == window(doc, k + line, 1)}
            if as_name and 0 in fits and usable(named, 0) and usable(doc, line) and window(named, 0, 1) == window(doc, line, 1):
                masked.add(0)
            if 0 in masked and not item[0][2] and item[0][3] != doc[line][3]:
                masked.discard(0)
            best = 0
            if masked and holds(masked, counts, width) and consistent(item, doc, line, masked, width):
                best = len(masked)
            if len(plain) > best and holds(plain, len(places), width):
                best = len(plain)
            both = masked | plain
            if plain and masked and len(both) > best and holds(both, len(places), width) and consistent(item, doc, line, both, width):
                best = len(both)
            if best:
                out[number] = max(best, out.get(number, 0))
    return sorted(out.items())


def sentence(n):
    words = []
    for _ in range(n):
        pick = rng.random()
        words.append(rng.choice(FRAME) if pick < 0.75 else rng.choice(NAMES) if pick < 0.85 else str(rng.randrange(12)) if pick < 0.95 else rng.choice(["kg", "5km", "zwei", "-", "années"]))
    words[0] = words[0].capitalize()
    return " ".join(words) + rng.choice([".", "?", ""])


def varied(text):
    """The text with other values, or with a few words changed or left out."""
    words = text.split()
    swap = {n: rng.choice(NAMES) for n in NAMES} | {str(k): str(rng.randrange(12)) for k in range(12)}
    kind = rng.randrange(4)
    if kind == 0:
        return " ".join(swap.get(w, w) for w in words)
    if kind == 1:
        words[rng.randrange(len(words))] = rng.choice(FRAME)
    elif kind == 2:
        words = words[rng.randrange(len(words)) :]
    return " ".join(words)


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_against_every_pair_of_windows(monkeypatch, most):
    monkeypatch.setattr(dec, "MOST_HITS", most)
    items = [sentence(rng.choice([2, 4, 5, 7, 9, 14, 25])) for _ in range(40)]
    items += [items[20], " ".join(varied(items[21]).split()) or "x"]
    index = dec.Index(list(enumerate(items)))
    hits = 0
    for _ in range(120):
        parts = [sentence(rng.randrange(3, 20)) if rng.random() < 0.5 else varied(rng.choice(items)) for _ in range(rng.randrange(1, 6))]
        text = rng.choice([" ", "\n", " \t"]).join(parts)
        want = found_by_force(items, text)
        hits += len(want)
        assert sorted(index.find(text)) == want, text
    assert hits > 80


def test_items_of_one_template_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(dec, "MOST_HITS", 50)
    items = [f"in the year {k} the old mill by the river sold {k} loaves of bread to the people of the town" for k in range(300)]
    text = " ".join(items[:3])
    got = dict(dec.Index(list(enumerate(items))).find(text))
    assert len(got) == 300  # the template with other numbers is the same question
    sizes = []
    real = dec.np.lexsort
    monkeypatch.setattr(dec.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or real(keys))
    dec.Index(list(enumerate(items))).find(text)
    assert len(sizes) > 10 and max(sizes) < 400


def test_words_of_four_languages():
    for text in ("zwölf Tage", "trois mètres", "cuatro días", "three days"):
        assert dec.templates(text)[1].tolist() == [True, True]
