"""Benchmark decontamination by template canonicalisation (operator 8).

Words of documents and benchmark items are brought to templates: lower case without
punctuation (of all of Unicode) at the ends, numbers, names and units replaced by typed placeholders (slots).
Windows of ``WINDOW`` template words are hash-joined: the windows of a block of items are
a sorted table of hashes, probed by every window of every document. Hits of one item that
lie on one diagonal (document position minus item position) are an alignment; along it a
slot value of the item must always stand for the same value in the document, so questions
with other numbers or names are caught and texts that merely share a frame are not.

A second table has the windows of the plain words (lower case, without punctuation at the
ends, no placeholders). It finds verbatim text where slots are dense: tables, Title Case,
capitals.

A document holds an item if one consistent alignment has a run of ``RUN`` hits (that is
``WINDOW + RUN - 1`` words), or hits at least ``COVER`` of the item's windows. That is asked
of the template hits (of the windows that can hit), of the plain hits, and of both together.

Items are taken in blocks of at most ``BLOCK_WORDS`` words. Documents pass once per block;
only documents that hold an item of the block leave a row, the block's index is deleted when
these rows are written, and so only one block is ever on the driver and in a worker. The rows
are joined to the documents at the end, by id and digest of the text. A benchmark of one
block, as most are, needs no join: the items are added as the documents pass, and nothing is
shuffled. A document's hits are expanded at most ``MOST_HITS`` at a time (by items), so
a benchmark of many items from one template costs time, not memory.

Numbers, units and given names are known in English, German, French and Spanish; in any
language a capitalised word inside a sentence is a name.

Defined results: null texts are empty; an item of less than ``WINDOW`` words is one window
of all its words; of one of less than ``LEAST_WORDS`` only the plain words count, and one
without any letter or digit is never found; as a first word may be a name or just begin a
sentence, it is looked for as both, and as a name only with its own value; windows with less than
half literal words are compared as plain words only; repeated items are all reported, repeated documents
each; a null item_id is reported as null; an empty benchmark finds nothing, an empty table
gives no rows. Other columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

import re
import string
import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import WORD, stage, table, unstage
from termweave.llm.words import BLANK, hashes, spans

WINDOW, RUN, COVER = 8, 6, 0.5
LEAST_WORDS = 5
BLOCK_WORDS = 500_000

#: Hits that are held at once.
MOST_HITS = 2_000_000

# Words that count as numbers, units and given names, by language.
NUMBER_WORDS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice",
    "de": "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen milliarde milliarden",
    "fr": "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent cents mille million millions milliard milliards",
    "es": "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones",
}
UNIT_WORDS = {
    "en": "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons lb lbs oz ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents pound pounds percent degree degrees celsius fahrenheit mph kmh volt volts watt watts joule joules",
    "de": "meter kilometer zentimeter gramm kilogramm kilo tonne tonnen sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad pfund",
    "fr": "mètre mètres kilomètre kilomètres centimètre centimètres gramme grammes kilogramme kilogrammes tonne tonnes seconde secondes heure heures jour jours semaine semaines mois an ans année années degré degrés livre livres pourcent",
    "es": "metro metros kilómetro kilómetros centímetro centímetros gramo gramos kilogramo kilogramos tonelada toneladas litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados libra libras",
}
GIVEN_NAMES = {
    "en": "alice anna bob carol carlos daniel david elena emma eva frank george hans helen henry jack james jane john jose julia karl laura lisa lucas maria mark martin mary michael nina olga oscar paul peter robert rosa sam sara sarah sofia susan thomas tom victor",
    "de": "andreas birgit claudia dieter fritz heinz jürgen klaus lukas monika sabine stefan ursula wolfgang",
    "fr": "antoine camille chloé claire françois henri jean louis luc marie nicolas pierre sophie thierry",
    "es": "alejandro ana antonio carmen diego fernando isabel javier josé juan luis manuel miguel pablo pedro",
}
NUMBERS, UNITS, NAMES = (frozenset(w for x in words.values() for w in x.split()) for words in (NUMBER_WORDS, UNIT_WORDS, GIVEN_NAMES))
NUMBER = re.compile(r"[+-]?\d[\d.,]*(?:st|nd|rd|th)?\Z")
QUANTITY = re.compile(r"[+-]?\d[\d.,]*([a-z]+)\Z")
#: Signs beyond ASCII: punctuation, symbols, formats, spaces. Those that stand for an ASCII
#: sign are taken as it; the others are no part of a word at its ends.
#: (Planes 2 to 13 and the private ones have none.)
KIND = {c: k for c in map(chr, [*range(0x80, 0x20000), *range(0xE0000, 0xE0080)]) if (k := unicodedata.category(c))[0] in "PSZ" or k in ("Cf", "Cc")}
SIGNS = frozenset(KIND)
TYPESET = {ord(c): a for a, signs in (
    ("'", "\u00b4\u2018\u2019\u201a\u201b\u2032\u2039\u203a"),
    ('"', "\u00ab\u00bb\u201c\u201d\u201e\u201f\u2033\u300c\u300d\u300e\u300f"),
    (".", "\u2026\u3002\uff0e"), ("!", "\uff01"), ("?", "\uff1f\u061f"), (":", "\uff1a"), (",", "\u3001\uff0c"),
    ("-", "".join(c for c, k in KIND.items() if k == "Pd") + "\u2212"),
    (" ", "".join(c for c, k in KIND.items() if k[0] == "Z") + "\u0085"),
) for c in signs}
OTHERS = frozenset(c for c in SIGNS if ord(c) not in TYPESET)
DROP, ENDS = dict.fromkeys(map(ord, OTHERS)), OTHERS | set(string.punctuation)
NO_BLANK = WORD.removesuffix("+")


def _bare(m: re.Match) -> str:
    word = m[0]
    first = next((i for i, c in enumerate(word) if c not in ENDS), None)
    if first is None:
        return word.translate(DROP) or "-"
    stop = len(word) - next(i for i, c in enumerate(reversed(word)) if c not in ENDS)
    return word[:first].translate(DROP) + word[first:stop] + word[stop:].translate(DROP)


def plain_signs(text: str) -> str:
    """The text with ASCII signs for typographic ones, and without others at ends of words."""
    if text.isascii() or SIGNS.isdisjoint(text):
        return text
    text = text.translate(TYPESET)
    others = "".join(sorted(OTHERS.intersection(text)))
    # words that hold one, from their start
    return re.sub(rf"(?<!{NO_BLANK}){NO_BLANK}*[{others}]{NO_BLANK}*", _bare, text) if others else text


def _marked(signs: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(signs.encode())] = True
    return out


#: ASCII signs that don't belong to a word at its ends; signs that end a sentence; signs
#: that may stand behind those.
MARKS, STOPS, AFTER = _marked(string.punctuation), _marked(".!?:"), _marked("\"')]*$%&#")
DIGITS = _marked(string.digits)


def code_of(token: str) -> np.uint64:
    a = np.frombuffer(token.encode(), dtype=np.uint8)
    return hashes(a, np.array([0]), np.array([len(a)]))[0]


def _codes(tokens) -> np.ndarray:
    return np.sort(np.array([code_of(t) for t in tokens], dtype=np.uint64))


NUMBER_CODE, UNIT_CODE, QUANTITY_CODE, NAME_CODE, MARK_CODE = (code_of(f"<{x}>") for x in ("number", "unit", "quantity", "name", "mark"))
NUMBER_TABLE, UNIT_TABLE, NAME_TABLE = _codes(NUMBERS), _codes(UNITS), _codes(NAMES)
EVERY_TABLE = _codes(NUMBERS | UNITS | NAMES)


def among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def lower(text: str) -> tuple[bytes, bytes]:
    """The text and its lower case, byte for byte at the same places; a sign whose lower case
    has another length stays."""
    data, low = (t.encode("utf-8", "surrogatepass") for t in (text, text.lower()))
    if len(data) != len(low):
        low = "".join(c if len(c.lower().encode("utf-8", "surrogatepass")) != len(c.encode("utf-8", "surrogatepass")) else c.lower() for c in text).encode("utf-8", "surrogatepass")
    return data, low


def templates(text: str) -> tuple[np.ndarray, np.ndarray, WordsOf, np.ndarray]:
    """Codes of the template words of a text, which of them are slots, the words, and the
    codes of the plain words."""
    data, low = lower(plain_signs(text))
    a, b = np.frombuffer(data, dtype=np.uint8), np.frombuffer(low, dtype=np.uint8)
    start, end = spans(b)
    n = len(start)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool), [], np.zeros(0, dtype=np.uint64)

    def before(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places kept, and how many come before each place."""
        return np.flatnonzero(keep), np.concatenate([[0], np.cumsum(keep)])

    core, n_core = before(~(BLANK[b] | MARKS[b]))
    i, j = n_core[start], n_core[end] - 1
    bare = i <= j
    last = len(core) - 1
    first = np.where(bare, core[np.clip(i, 0, max(last, 0))] if last >= 0 else 0, start)
    stop = np.where(bare, core[np.clip(j, 0, max(last, 0))] + 1 if last >= 0 else 0, start)
    codes = hashes(b, first, stop)
    # a capital: the first sign differs from its lower case (its second byte, if it has one)
    high = np.minimum(first + 1, len(b) - 1)
    capital = bare & ((a[first] != b[first]) | ((a[first] >= 0xC0) & (a[high] != b[high])))
    rest, n_rest = before(~AFTER[b])
    k = n_rest[end] - 1
    at_end = rest[np.maximum(k, 0)] if len(rest) else np.zeros(n, dtype=int)
    ends = (k >= 0) & (at_end >= start) & STOPS[b[at_end]]
    inside = np.zeros(n, dtype=bool)
    inside[1:] = ~ends[:-1]
    # most words are in no table
    listed = np.flatnonzero(bare & among(codes, EVERY_TABLE))
    number, unit, given = (np.zeros(n, dtype=bool) for _ in range(3))
    for which, known in ((number, NUMBER_TABLE), (unit, UNIT_TABLE), (given, NAME_TABLE)):
        which[listed] = among(codes[listed], known)
    name = bare & capital & ~number & ~unit & (inside | given)
    quantity = np.zeros(n, dtype=bool)
    for w in np.flatnonzero(bare & DIGITS[b[first]]):
        token = low[first[w] : stop[w]].decode("utf-8", "replace")
        if NUMBER.match(token):
            number[w] = True
        elif (q := QUANTITY.match(token)) and q[1] in UNITS:
            quantity[w] = True
    codes[~bare] = MARK_CODE
    plain = codes.copy()
    for which, code in ((number, NUMBER_CODE), (unit, UNIT_CODE), (quantity, QUANTITY_CODE), (name, NAME_CODE)):
        codes[which] = code
    return codes, number | unit | quantity | name, WordsOf(low, first, stop), plain


class WordsOf:
    """The words of a text in lower case without marks, cut out when asked for."""

    def __init__(self, low: bytes, first: np.ndarray, stop: np.ndarray) -> None:
        self.low, self.first, self.stop = low, first, stop

    def __getitem__(self, k: int) -> bytes:
        return self.low[self.first[k] : self.stop[k]]

    def __len__(self) -> int:
        return len(self.first)


def windows(codes: np.ndarray, slots: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window, and whether half of it at least is literal."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    key = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += codes[j : j + n]
    summed = np.concatenate([[0], np.cumsum(slots)])
    return key, 2 * (summed[width:] - summed[:-width]) <= width


Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def table_of(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Table:
    """Keys in order, and the item and place of each, from (item, keys, places) rows."""
    key, at = (np.concatenate([r[j] for r in rows]) for j in (1, 2))
    own = np.repeat([k for k, *_ in rows], [len(r[1]) for r in rows])
    order = np.argsort(key, kind="stable")
    return key[order], own[order], at[order]


def located(table: Table, own: np.ndarray, good: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a document that hit, where their rows of the table begin, and how many
    they are."""
    keys = table[0]
    if not len(own) or not len(keys):
        return (np.zeros(0, dtype=np.int64),) * 3
    left = np.searchsorted(keys, own)
    same = keys[np.minimum(left, len(keys) - 1)] == own
    hit = np.flatnonzero(same if good is None else same & good)
    return hit, left[hit], np.searchsorted(keys, own[hit], side="right") - left[hit]


def probe(table: Table, where: tuple[np.ndarray, np.ndarray, np.ndarray], part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, place in the item and diagonal of each hit of one part of the items."""
    _, owner, at = table
    out = []
    hit, left, n = where
    # as many hits at a time as are allowed in memory; a single window has no more than a block has
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // MOST_HITS, prepend=0)) if len(n) else []
    for a, b in zip([0, *cuts], [*cuts, len(n)]):
        m = n[a:b]
        row = np.repeat(left[a:b] - np.cumsum(m) + m, m) + np.arange(m.sum())
        doc = np.repeat(hit[a:b], m)
        if parts > 1:
            keep = owner[row] % parts == part
            row, doc = row[keep], doc[keep]
        out.append((owner[row], at[row], doc - at[row]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


class Index:
    """Windows of a block of items: arrays, so that it is small when sent to workers."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.ids = [i for i, _ in items]
        made = [templates(t) for _, t in items]
        self.words = [w for _, _, w, _ in made]
        self.slots = [np.flatnonzero(s) for _, s, *_ in made]
        self.widths = [min(WINDOW, len(p)) if (p != MARK_CODE).any() else 0 for *_, p in made]
        #: By width: windows of templates, windows of plain words.
        self.tables: dict[int, tuple[Table, Table]] = {}
        self.counts = [0] * len(items)
        for width in sorted({w for w in self.widths if w}):
            masked, plain = [], []
            for k, (c, s, _, p) in enumerate(made):
                if self.widths[k] == width:
                    key, good = windows(c, s, width)
                    good &= len(c) >= LEAST_WORDS
                    place = np.flatnonzero(good)
                    self.counts[k] = len(place)
                    masked.append((k, key[good], place))
                    if len(c) >= LEAST_WORDS and not s[0] and c[0] != MARK_CODE:
                        other, fits = windows(np.append(NAME_CODE, c[1:width]), np.append(True, s[1:width]), width)
                        masked.append((k, other[fits], np.flatnonzero(fits)))
                    every = windows(p, s, width)[0]
                    plain.append((k, every, np.arange(len(every))))
            self.tables[width] = table_of(masked), table_of(plain)

    def find(self, text: str) -> list[tuple[int | None, int]]:
        """(item_id, hits) of the items that a document holds."""
        codes, slots, words, plain = templates(text)
        out = []
        for width, tables in self.tables.items():
            where = [located(tables[0], *windows(codes, slots, width)), located(tables[1], windows(plain, slots, width)[0])]
            total = sum(int(n.sum()) for *_, n in where)
            parts = 1 + total // MOST_HITS
            for part in range(parts if total else 0):
                out += self._aligned([probe(t, w, part, parts) for t, w in zip(tables, where)], words, width)
        return out

    def _aligned(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], words: WordsOf, width: int) -> list[tuple[int | None, int]]:
        """The items of which an alignment holds, from the hits of templates and plain words."""
        item, item_at, line = (np.concatenate([f[j] for f in found]) for j in range(3))
        if not len(item):
            return []
        exact = np.repeat([False, True], [len(f[0]) for f in found])
        order = np.lexsort((item_at, line, item))
        item, item_at, line, exact = item[order], item_at[order], line[order], exact[order]
        ends = np.flatnonzero(np.diff(item) | np.diff(line)) + 1
        best: dict[int, int] = {}
        for a, b in zip([0, *ends], [*ends, len(item)]):
            k, at = int(item[a]), item_at[a:b]
            n = self._hits(k, at[~exact[a:b]], at[exact[a:b]], words, int(line[a]), width)
            if n > best.get(k, 0):
                best[k] = n
        return [(self.ids[k], n) for k, n in best.items()]

    def _hits(self, k: int, masked: np.ndarray, plain: np.ndarray, words: WordsOf, line: int, width: int) -> int:
        """Hits of an alignment that holds, 0 if none does: of templates, of plain words
        (which are consistent), of both."""
        total = len(self.words[k]) - width + 1
        if len(masked) and masked[0] == 0 and 0 not in self.slots[k] and self.words[k][0] != words[line]:
            masked = masked[1:]  # a name, but not this one
        n = 0
        if len(masked) and self._holds(masked, self.counts[k], width) and self._consistent(k, words, line, masked, width):
            n = len(masked)
        if len(plain) > n and self._holds(plain, total, width):
            n = len(plain)
        if len(masked) and len(plain):
            both = np.union1d(masked, plain)
            if len(both) > n and self._holds(both, total, width) and self._consistent(k, words, line, both, width):
                n = len(both)
        return n

    def _holds(self, hits: np.ndarray, total: int, width: int) -> bool:
        if width < WINDOW or len(hits) >= COVER * total:
            return True
        step = np.flatnonzero(np.diff(hits) != 1)
        return int(np.diff(np.concatenate([[-1], step, [len(hits) - 1]])).max()) >= RUN

    def _consistent(self, k: int, words: WordsOf, line: int, hits: np.ndarray, width: int) -> bool:
        """Whether each slot value of the item stands for one value along the alignment."""
        low, high = int(hits[0]), int(hits[-1]) + width
        covered = np.zeros(high - low + 1, dtype=int)
        np.add.at(covered, hits - low, 1)
        np.add.at(covered, hits - low + width, -1)
        covered = np.cumsum(covered) > 0
        values: dict[bytes, bytes] = {}
        for at in self.slots[k]:
            if low <= at < high and covered[at - low]:
                mine, theirs = self.words[k][at], words[at + line]
                if values.setdefault(mine, theirs) != theirs:
                    return False
        return True


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of at most BLOCK_WORDS words (or one item)."""
    block, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        n = len(r.t.split())
        if block and held + n > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((r.i, r.t))
        held += n
    if block:
        yield block


ITEMS = "array<struct<item_id:bigint,hits:bigint>>"
ITEM_ROWS = pa.list_(pa.struct([("item_id", pa.int64()), ("hits", pa.int64())]))


def in_order(found: list[tuple[int | None, int]]) -> list[dict]:
    return [{"item_id": i, "hits": n} for i, n in sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a column ``__items``: the items that the text holds and
    their hits, by item_id (null first)."""
    held = blocks(benchmark)
    first, second = next(held, None), next(held, None)
    none = F.array().cast(ITEMS)
    if first is None:
        return docs.withColumn("__items", none)
    if second is None:
        return with_items(docs, docs.sparkSession.sparkContext.broadcast(Index(first)))
    keyed = docs.withColumns({"__d": F.col("doc_id").cast("long"), "__t": F.sha2(F.coalesce("text", F.lit("")), 256)})
    rows = keyed.select("__d", "__t", "text")
    found = [hits_of(rows, b) for b in chain([first, second], held)]
    every = reduce(DataFrame.unionByName, found).groupBy(F.col("__d").alias("__d2"), F.col("__t").alias("__t2"))
    # rows of one id and text have the same items; one of them counts
    listed = every.agg(F.collect_set(F.struct("block", "items")).alias("s"))
    order = F.array_sort(F.flatten(F.transform("s", lambda x: x["items"])))
    listed = stage(listed.select("__d2", "__t2", order.alias("__items")), "leak-items")
    unstage(*found)
    both = keyed.join(listed, F.col("__d").eqNullSafe(F.col("__d2")) & (F.col("__t") == F.col("__t2")), "left")
    return both.select(*docs.columns, F.coalesce("__items", none).alias("__items"))


def with_items(docs: DataFrame, held) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            names = batch.schema.names
            found = [in_order(index.find(t.as_py() or "")) for t in batch.column(names.index("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, ITEM_ROWS)], [*names, "__items"])

    return docs.mapInArrow(run, docs.withColumn("__items", F.array().cast(ITEMS)).schema)


def hits_of(rows: DataFrame, block: list[tuple[int | None, str]]) -> DataFrame:
    """Staged (__d, __t, block, items) of the rows that hold an item of a block."""
    held = rows.sparkSession.sparkContext.broadcast(Index(block))
    found = with_items(rows, held).where(F.size("__items") > 0)
    out = stage(found.select("__d", "__t", F.lit(uuid.uuid4().hex).alias("block"), F.col("__items").alias("items")), "leak-hits")
    held.destroy()
    return out


def contaminated(items: str = "__items") -> Column:
    return F.size(items) > 0


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    return find_items(docs, benchmark).where(~contaminated()).select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", contaminated().alias("contaminated"), F.transform("__items", lambda x: x["item_id"]).alias("item_ids"), F.aggregate("__items", F.lit(0).cast("long"), lambda a, x: a + x["hits"]).alias("n_hits"))
