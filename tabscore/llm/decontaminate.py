"""Benchmark decontamination: template canonicalisation.

Texts become sequences of words in which numbers, names and units are typed
placeholders.  Windows of ``WINDOW`` such words are hash-joined between
benchmark items and documents.  Neighbouring number or name words are one
placeholder, so values may differ in their number of words.  Windows that line
up (same distance between their places in document and item) must also fill
the placeholders consistently: one value of the item always stands for one
value in the document, and two names never become one.  Lines whose distances
differ by up to ``DRIFT`` words, or a quarter of the item, and that follow each
other in both texts are added up where their values are consistent together,
so words put in or left out do not split a copy.  An item whose windows are
covered to ``COVERAGE`` marks the document, whether it is copied or asked
again with other numbers, names and units; so does a run of ``RUN`` of its
words, whatever its share.

Words are found and hashed with array operations over whole texts in slices of
about ``SLICE_BYTES``; only windows whose hash occurs in the benchmark leave a
task while the benchmark's hashes, counted first, fit a broadcast; beyond that
bound all windows meet the benchmark's in a shuffled join.  Either way the
rest is joins and counts over matching windows, and one sorted pass that holds
the lines of one item near one place of a document.

Canonical words: letters, digits and non-ASCII characters other than spaces
and punctuation make words; a character of a script that is written without
spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese) is a word; case is folded for A-Z and the letters of two
bytes (Latin, Greek, Cyrillic, Armenian); a word that begins with a digit, or
is a number word, is a number; a unit word after a number is a unit; a
capitalised word inside a sentence, or a common given name, is a name.  A line
break is white space and ends no sentence.  With ``any_case`` windows match by
either of two hashes, of the canonical words or of the plain folded words, so
the case of a copy does not matter; the queries use both.

Defined results: null and empty texts have no windows; an item shorter than a
window is matched as a whole, and one of fewer than ``SHORTEST`` words only by
a document that has no other words; windows with fewer
than ``LITERALS`` plain words match by all their words as they are, and count
only where that raises an item's share; rows repeating an id are judged one by
one; items are the benchmark's rows, each with its own number of windows, and
equal texts of one id count once; texts of any length are read whole; an empty
benchmark marks nothing, and empty documents give an empty result.  Other
columns, whatever their names, are not read by ``matches`` and are returned as
they came by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tabscore.llm.common import (python_workers, BROADCAST_BYTES, F, T, col, is_file_scan, located, materialise, small,
                                 without_rows)

WINDOW = 8
SHORTEST = 3
LITERALS = 3
COVERAGE = 0.5
#: Words in which the distances of added-up lines may differ (longer items: a quarter of their windows).
DRIFT = 16
#: Equal words in a row that mark a document by themselves.
RUN = 2 * WINDOW
SLICE_BYTES = 1 << 20

# Number words, unit words, common given names.
NUMBER_WORDS = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
                "million billion half quarter dozen").split()
UNIT_WORDS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce "
              "ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons second seconds minute "
              "minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros "
              "percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres mph kph").split()
GIVEN_NAMES = ("james john robert michael william david richard joseph thomas charles mary patricia jennifer linda "
               "elizabeth barbara susan jessica sarah karen anna maria peter paul mark alice bob tom tim sam ben "
               "emma olivia sophia lucas maya jose juan carlos marie pierre hans").split()

# Thai and Lao, Burmese, Khmer, kana, CJK ideographs (those of three bytes).
SPACELESS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
             (0x4E00, 0x9FFF), (0xF900, 0xFAFF))

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3

def _folded() -> np.ndarray:
    """The lower-case code point of every code point below U+0800 whose lower case also takes two bytes or one."""
    low = np.arange(0x800)
    for c in range(0x80, 0x800):
        folded = chr(c).lower()
        if len(folded) == 1 and 0x80 <= ord(folded) < 0x800:
            low[c] = ord(folded)
    low[0x3C2] = 0x3C3    # final sigma
    return low


_FOLDED = _folded()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_JOINER = np.zeros(256, dtype=bool)
_JOINER[[ord("."), ord(",")]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[ord(c) for c in " \t\r\n"]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 48


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's lower-cased bytes."""
    sizes = ends - starts
    h = mixed(sizes.astype(np.uint64))
    live = np.flatnonzero(sizes <= _LONG_WORD)
    step = 0
    while len(live):
        h[live] = (h[live] + low[starts[live] + step]) * _MUL
        h[live] ^= h[live] >> np.uint64(32)
        step += 1
        live = live[sizes[live] > step]
    for k in np.flatnonzero(sizes > _LONG_WORD):
        h[k] = xxhash.xxh64_intdigest(low[starts[k]:ends[k]].tobytes())
    return mixed(h)


def _known(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    return np.sort(word_hashes(data, starts, starts + sizes))


_NUMBERS, _UNITS, _NAMES = _known(NUMBER_WORDS), _known(UNIT_WORDS), _known(GIVEN_NAMES)
_SLOT_CODE = mixed(np.array([0, 11, 12, 13], dtype=np.uint64) * _MUL)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``known``."""
    if not len(known) or not len(values):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def separators(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of non-ASCII punctuation and spaces, of those that are spaces, of those that end a sentence)."""
    apart, blank, stop = (np.zeros(len(data), dtype=bool) for _ in range(3))

    def mark(at: np.ndarray, size: int, which: np.ndarray) -> None:
        for k in range(size):
            which[at + k] = True

    two = np.flatnonzero(data[:-1] == 0xC2)
    second = data[two + 1]
    mark(two[~np.isin(second, [0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE])], 2, apart)   # not letters, digits
    mark(two[second == 0xA0], 2, blank)
    two = np.flatnonzero(data[:-1] == 0xC3)
    mark(two[np.isin(data[two + 1], [0x97, 0xB7])], 2, apart)
    three = np.flatnonzero((data[:-2] == 0xE2) | (data[:-2] == 0xE3) | (data[:-2] == 0xEF))
    if len(three):
        code = ((data[three] & 0x0F).astype(np.int64) << 12) | ((data[three + 1] & 0x3F).astype(np.int64) << 6) | (
            data[three + 2] & 0x3F)
        between = lambda lo, hi: (code >= lo) & (code <= hi)
        mark(three[between(0x2000, 0x206F) | (code == 0x2212) | between(0x3000, 0x3004) | between(0x3008, 0x3020)
                   | between(0xFF01, 0xFF0F) | between(0xFF1A, 0xFF20) | between(0xFF3B, 0xFF40)
                   | between(0xFF5B, 0xFF65) | (code == 0xFEFF)], 3, apart)
        mark(three[between(0x2000, 0x200B) | np.isin(code, [0x2028, 0x2029, 0x202F, 0x205F, 0x3000])], 3, blank)
        mark(three[np.isin(code, [0x2026, 0x3002, 0xFF01, 0xFF0E, 0xFF1F])], 3, stop)
    return apart, blank, stop


def spaceless(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, bytes) of every character of a script that has no spaces between words."""
    three = np.flatnonzero((data[:-2] >= 0xE0) & (data[:-2] <= 0xEF)) if len(data) > 2 else np.zeros(0, dtype=np.int64)
    code = ((data[three] & 0x0F).astype(np.int64) << 12) | ((data[three + 1] & 0x3F).astype(np.int64) << 6) | (
        data[three + 2] & 0x3F)
    which = np.zeros(len(three), dtype=bool)
    for lo, hi in SPACELESS:
        which |= (code >= lo) & (code <= hi)
    three = three[which]
    four = np.flatnonzero((data == 0xF0) & (np.append(data[1:], 0) >= 0xA0) & (np.append(data[1:], 0) <= 0xB3))    # U+20000 to U+33FFF
    at = np.concatenate([three, four])
    return at, np.concatenate([np.full(len(three), 3), np.full(len(four), 4)])


def canonical(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word hash, type, type inside a sentence, next to the word before) of every word, in order.

    The second type differs for a capitalised first word, which is a name when
    the text stands inside another's sentence.  Words are next to each other
    with only white space or a hyphen between them.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    edges = np.cumsum([len(t) + 1 for t in texts])
    low = _LOWER[data]
    pair = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xDF))
    code = _FOLDED[((data[pair] & 0x1F).astype(np.int64) << 6) | (data[pair + 1] & 0x3F)]
    low[pair], low[pair + 1] = 0xC0 | (code >> 6), 0x80 | (code & 0x3F)
    apart, blank, stop = separators(data)
    word = _WORD[data] & ~apart
    inner = np.flatnonzero(_JOINER[data[1:-1]] & _DIGIT[data[:-2]] & _DIGIT[data[2:]]) + 1
    word[inner] = True
    cut = np.zeros(len(data) + 1, dtype=bool)     # a word ends here and another may start
    alone, size = spaceless(data)
    cut[alone] = cut[alone + size] = True
    padded = np.concatenate([[False], word, [False]])
    starts = np.flatnonzero(word & (~padded[:-2] | cut[:-1]))
    ends = np.flatnonzero(word & (~padded[2:] | cut[1:])) + 1
    h = word_hashes(low, starts, ends)
    kind = np.zeros(len(h), dtype=np.int8)
    if len(h):
        owner = np.searchsorted(edges, starts, side="right")
        number = _DIGIT[data[starts]] | among(h, _NUMBERS)
        follows = np.concatenate([[False], number[:-1] & (owner[1:] == owner[:-1])])
        capital = low[starts] != data[starts]
        after = np.minimum(starts + 1, len(data) - 1)
        capital |= (data[starts] >= 0xC2) & (low[after] != data[after])
        second = np.minimum(starts + np.where(data[starts] >= 0xC0, 2, 1), len(data) - 1)
        after = np.minimum(second + 1, len(data) - 1)
        capital &= (second < ends) & (low[second] == data[second]) & ~_DIGIT[data[second]]
        capital &= (data[second] < 0xC2) | (low[after] == data[after])
        stops = np.concatenate([[0], np.cumsum(_STOP[data] | stop)])
        inside = np.concatenate([[False], (stops[starts[1:]] == stops[ends[:-1]]) & (owner[1:] == owner[:-1])])
        kind[capital & (inside | among(h, _NAMES))] = NAME
        kind[follows & among(h, _UNITS)] = UNIT
        kind[number] = NUMBER
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        quoted = np.where(first & capital & ~number, NAME, kind).astype(np.int8)
        solid = np.concatenate([[0], np.cumsum(~(_BLANK[data] | blank))])
        gap = solid[starts[1:]] - solid[ends[:-1]]
        hyphen = (gap == 1) & (starts[1:] - ends[:-1] == 1) & (data[ends[:-1]] == ord("-"))
        beside = ~first & np.concatenate([[False], (gap == 0) | hyphen])
    else:
        owner, quoted, beside = np.zeros(0, dtype=np.int64), kind, np.zeros(0, dtype=bool)
    return owner, h, kind, quoted, beside


def collapsed(h: np.ndarray, kind: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, hash, type) of every canonical word: neighbouring numbers or names are one, with all their words."""
    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), h, kind
    same = np.concatenate([[False], kind[1:] == kind[:-1]]) & beside & ((kind == NUMBER) | (kind == NAME))
    first = np.flatnonzero(~same)
    end = np.append(first[1:], n)
    place = (np.arange(n) - np.repeat(first, end - first)).astype(np.uint64)
    value = np.add.reduceat(mixed(h + place * _MUL), first)
    return first, end, np.where(end - first == 1, h[first], value), kind[first]


def window_hashes(owner: np.ndarray, h: np.ndarray, kind: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of ``length`` canonical words inside one text."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    code = np.where(kind == LITERAL, h, _SLOT_CODE[kind])
    out = np.full(n, length, dtype=np.uint64)
    for j in range(length):
        out = (out ^ code[j:j + n]) * _MUL
        out ^= out >> np.uint64(32)
    first = np.flatnonzero(owner[:n] == owner[length - 1:])
    return first, out[first]


WINDOWS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("file", T.LongType()), T.StructField("pos", T.LongType()),
    T.StructField("at", T.LongType()), T.StructField("size", T.LongType()), T.StructField("hash", T.LongType()),
    T.StructField("plain", T.BooleanType()), T.StructField("literals", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("kinds", T.ArrayType(T.ByteType()))])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Rows (id, file, pos) with their texts as UTF-8, about ``SLICE_BYTES`` of text at a time."""
    rows, texts, held = [], [], 0
    for b in batches:
        ids, files, places = (b.column(k).to_pylist() for k in range(3))
        for k, t in enumerate(b.column(3)):
            data = t.as_buffer().to_pybytes() if t.is_valid else b""
            rows.append((ids[k], files[k], places[k]))
            texts.append(data)
            held += len(data)
            if held >= SLICE_BYTES:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def window_rows(df: DataFrame, lengths: list[int], only: np.ndarray | None = None, item_texts: bool = False) -> DataFrame:
    """Window rows of (id, file, pos, text) rows.

    ``only``: sorted hashes a window must be among to be listed.
    ``item_texts``: the texts are benchmark items. One shorter than the smallest
    length is one window, and a capitalised first word is taken both ways.
    ``plain`` windows take all their words as literal whatever their case and
    kind; ``literals`` is the number of those that are.  ``at`` and ``size`` are counted in words of the text, as written.
    """
    python_workers(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        seen = None
        if keep is not None:
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(keep & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for rows, texts in slices(batches):
            owner, h, kind, quoted, beside = canonical(texts)
            n_words = np.bincount(owner, minlength=len(texts))
            base = np.cumsum(n_words) - n_words
            plain = np.zeros(len(h), dtype=np.int8)
            literals = np.concatenate([[0], np.cumsum(kind == LITERAL)])
            for types in ([kind, quoted] if item_texts else [kind]) + [plain]:
                begin, end, value, kinds = collapsed(h, types, beside)
                holder = owner[begin]
                count = np.bincount(holder, minlength=len(texts))
                # a text of an item's few words is that item; found inside a text they are nothing
                jobs = [(length, None if length >= SHORTEST else count == length) for length in lengths]
                if item_texts:
                    jobs += [(length, count == length) for length in range(1, min(lengths))]
                for length, which in jobs:
                    first, hashes = window_hashes(holder, value, kinds, length)
                    if which is not None:
                        ok = which[holder[first]]
                        first, hashes = first[ok], hashes[ok]
                    if keep is not None:
                        maybe = np.flatnonzero(seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
                        maybe = maybe[among(hashes[maybe], keep)]
                        first, hashes = first[maybe], hashes[maybe]
                    if not len(first):
                        continue
                    span = first[:, None] + np.arange(length)
                    own = holder[first]
                    offsets = pa.array(np.arange(len(first) + 1) * length, pa.int32())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([rows[k][0] for k in own], pa.int64()), pa.array([rows[k][1] for k in own], pa.int64()),
                        pa.array([rows[k][2] for k in own], pa.int64()), pa.array(begin[first] - base[own], pa.int64()),
                        pa.array(end[first + length - 1] - begin[first], pa.int64()),
                        pa.array(hashes.view(np.int64)), pa.array(np.full(len(first), types is plain)),
                        pa.array(literals[end[first + length - 1]] - literals[begin[first]], pa.int32()),
                        pa.ListArray.from_arrays(offsets, pa.array(value[span].ravel().view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(kinds[span].ravel(), pa.int8()))],
                        [f.name for f in WINDOWS.fields])

    return df.mapInArrow(run, WINDOWS)


def rows_with_text(df: DataFrame, ident: str, text: str, name: str) -> DataFrame:
    return located(df, [col(ident).cast("long").alias("id"), col(text).cast("string").alias("text")], name).select(
        "id", "file", "pos", "text")


CHAINS = T.StructType([
    T.StructField("file", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()),
    T.StructField("same_values", T.BooleanType()), T.StructField("first_word", T.LongType())])


def consistent(slots: frozenset) -> bool:
    """One value of the item stands for one value in the document, and two names never become one."""
    names = [ours for kind, _, ours in slots if kind == NAME]
    return len({s[:2] for s in slots}) == len(slots) and len(set(names)) == len(names)


def stretches(hits: list[tuple[int, int]], shift: int, slots: frozenset) -> list[tuple]:
    """(first, last, shift, slots) of every unbroken stretch of the item's windows on a line."""
    out: list[list[int]] = []
    for first, last in sorted(hits):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b, shift, slots) for a, b in out]


def best_chain(parts: list[tuple], total: int) -> tuple[float, bool, int] | None:
    """(coverage, same values, -first word) of the best chain of stretches in order in both texts, if it reaches ``COVERAGE``."""
    need = COVERAGE * total
    if sum(b - a + 1 for a, b, _, _ in parts) < need:
        return None
    parts = sorted(parts, key=lambda p: p[:3])
    chains: list[tuple[int, int, frozenset]] = []
    for k, (a, b, shift, slots) in enumerate(parts):
        now = (b - a + 1, a + shift, slots)
        for (c, d, other, _), (n, first, held) in zip(parts[:k], chains):
            more = n + b - max(d, a - 1)
            if c < a and d < b and c + other < a + shift and d + other < b + shift and more > now[0]:
                union = held | slots
                if len(union) == len(held) or consistent(union):
                    now = (more, first, union)
        chains.append(now)
    found = [(min(n / total, 1.0), all(t == o for _, t, o in slots), -first) for n, first, slots in chains if n >= need]
    return max(found, default=None)


def judged(band: list[dict]) -> tuple[float, bool, int] | None:
    """The best chain over a band of lines: of equal words alone, or of all or of typed windows of lines without a clash."""
    total = band[0]["windows"]
    found = []
    equal = [p for line in band for p in line["equal"]]
    alike = best_chain(equal, total)
    if alike is not None:
        found.append(alike)
    for a, b, shift, _ in equal:
        if b - a + WINDOW >= RUN:
            found.append((min((b - a + 1) / total, 1.0), True, -(a + shift)))
    for parts, windows in (("parts", total), ("typed_parts", band[0]["typed"])):
        changed = best_chain([p for line in band for p in line[parts]], windows) if windows else None
        if changed is not None:
            found.append(changed)
    return max(found, default=None)


def best_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best chain of every document row and item row of lines sorted by them and by shift."""
    key, band, best, out = None, [], None, []

    def advance(upto: int | None) -> None:
        # bands that begin at a line and cannot grow any more
        nonlocal best
        while band and (upto is None or upto - band[0]["shift"] > max(DRIFT, band[0]["windows"] // 4)):
            if best is None or best[:2] < (1.0, True):
                now = judged(band)
                if now is not None and (best is None or now > best):
                    best = now
            band.pop(0)

    def finish() -> None:
        nonlocal best
        advance(None)
        if best is not None:
            out.append((*key[:4], best[0], best[1], -best[2]))
        best = None

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(CHAINS.fields)
        kinds = [pa.int64()] * 4 + [pa.float64(), pa.bool_(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], CHAINS.names)
        out.clear()
        return batch

    for b in batches:
        for r in b.to_pylist():
            now = (r["file"], r["pos"], r["id"], r["item_id"], r["item_file"], r["item_pos"])
            if now != key:
                finish()
                key = now
            advance(r["shift"])
            slots = frozenset((s["kind"], s["theirs"], s["ours"]) for s in r["slots"])
            hits = [(h["first"], h["last"]) for h in r["hits"]]
            equal = [(h["first"], h["last"]) for h in r["hits"] if h["equal"]]
            typed = [(h["first"], h["last"]) for h in r["hits"] if h["typed"]]
            fits = consistent(slots)
            band.append({"shift": r["shift"], "windows": r["windows"], "typed": r["typed"],
                         "equal": stretches(equal, r["shift"], frozenset()),
                         "parts": stretches(hits, r["shift"], slots) if fits else [],
                         "typed_parts": stretches(typed, r["shift"], slots) if fits else []})
        yield rows()
    finish()
    yield rows()


def matches(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text",
            item: str = "item_id", item_text: str = "text", limit: int = BROADCAST_BYTES,
            any_case: bool = False) -> DataFrame:
    """Contaminated documents: doc_id, item_id, coverage, first_word, same_values, file, pos.

    ``any_case``: windows also match by their plain words, so that a copy in
    capitals or without them is found; else a name only matches a name.

    One row per document row and item id, of the best covered item with that id.  ``same_values`` tells a copy (every
    placeholder holds the item's own value) from a re-parameterised question.
    """
    python_workers(docs.sparkSession)
    literal = F.size(F.filter("kinds", lambda k: k == LITERAL))
    rows = rows_with_text(benchmark, item, item_text, "benchmark").where("text IS NOT NULL").groupBy("id", "text").agg(
        F.min(F.struct("file", "pos")).alias("row")).select("id", "row.file", "row.pos", "text")
    items = window_rows(rows, [WINDOW], item_texts=True)
    used = F.when(F.col("plain"), F.lit(any_case) | (F.col("literals") < LITERALS)).otherwise(literal >= LITERALS)
    items = materialise(items.where(used).dropDuplicates(["file", "pos", "at", "hash", "plain"]).select(
        F.col("id").alias("item_id"), F.col("file").alias("item_file"), F.col("pos").alias("item_pos"),
        F.col("at").alias("item_at"), F.col("size").alias("item_size"), "hash", F.col("plain").alias("item_plain"),
        F.col("words").alias("item_words"), F.col("kinds").alias("item_kinds")), "benchmark-windows")
    lengths = [r[0] for r in items.select(F.size("item_kinds")).distinct().collect()] or [WINDOW]   # at most WINDOW values
    hashes = items.select("hash").distinct()
    only = None
    if hashes.count() * 8 <= limit:
        only = np.sort(hashes.toPandas()["hash"].to_numpy(dtype=np.int64).view(np.uint64))
    found = window_rows(rows_with_text(docs, ident, text, "decontaminate-docs"), sorted(lengths), only)
    side, _ = small(items, 128, limit)
    found = materialise(found.join(side, "hash").where("plain = item_plain"), "benchmark-hits")

    # the same canonical words, by word (the joined hash is no proof)
    same = F.forall(F.sequence(F.lit(0), F.size("kinds") - 1), lambda i: (
        (F.get("kinds", i) == F.get("item_kinds", i))
        & ((F.get("kinds", i) != LITERAL) | (F.get("words", i) == F.get("item_words", i)))))
    found = found.where((F.size("kinds") == F.size("item_kinds")) & same)
    own = ["item_file", "item_pos"]
    pair = ["file", "pos", "id", *own, "item_id"]
    last = F.col("item_at") + F.greatest(F.col("item_size") - WINDOW, F.lit(0))
    total = items.select(*own, "item_plain", F.explode(F.sequence("item_at", last)).alias("start")).groupBy(*own).agg(
        F.count_distinct("start").alias("windows"),
        F.count_distinct(F.when(~F.col("item_plain"), F.col("start"))).alias("typed"))
    slots = F.filter(F.arrays_zip(F.col("kinds").alias("kind"), F.col("item_words").alias("theirs"), F.col("words").alias("ours")),
                     lambda s: s["kind"] != LITERAL)
    equal = F.forall(F.arrays_zip(F.col("words").alias("ours"), F.col("item_words").alias("theirs")),
                     lambda s: s["ours"] == s["theirs"])
    lines = found.groupBy(*pair, (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.struct(F.col("item_at").alias("first"), last.alias("last"), equal.alias("equal"),
                                (~F.col("item_plain")).alias("typed"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list(slots))).alias("slots"))
    lines = lines.join(total, own).select(*pair, "shift", "hits", "slots", "windows", "typed")
    # the lines of a pair are met in order of their shift, those of a band held at a time
    best = lines.repartition(*pair).sortWithinPartitions(*pair, "shift").mapInArrow(best_chains, CHAINS)
    best = best.groupBy("file", "pos", "id", "item_id").agg(F.max(F.struct("coverage", "same_values", -F.col("first_word"))).alias("best"))
    return best.select(F.col("id").alias("doc_id"), "item_id", F.col("best.coverage").alias("coverage"),
                       (-F.col("best.col3")).alias("first_word"), F.col("best.same_values").alias("same_values"),
                       "file", "pos")


def keep_clean(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text",
               any_case: bool = False) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item (``any_case``: see ``matches``)."""
    if not is_file_scan(docs):
        docs = materialise(docs, "decontaminate-docs")    # once, so that both sides see the same files
    marked = materialise(matches(docs, benchmark, ident, text, any_case=any_case).select(
        "file", "pos").distinct(), "contaminated")
    return without_rows(docs, marked, "decontaminate-docs")
