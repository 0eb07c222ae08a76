"""Spelling variant grouping by a variable-length gram index.

Words are maximal runs of letters A to Z and U+00C0 to U+00FF, so every code
point is one byte of Latin-1.  A word is framed by a begin and an end mark.

1.  Gram dictionary.  Grams of the framed words are counted length by length, and
    only grams that occur more than ``limit`` times are extended; so the
    dictionary is a trie pruned at rare grams.  ``limit`` grows with the number of
    gram occurrences, so that the dictionary has at most ``MAX_GRAMS`` frequent
    grams a length.
2.  Decomposition.  At every position starts one gram: the shortest that isn't
    frequent, or the longest allowed.  Which gram starts at a position depends only
    on the letters inside it, so an edit affects no gram but those it touches.
3.  Bounds.  A pair of words is matched in the class m of its longer length; the
    longest gram allowed is a function of m, for both.  Per word the largest number
    of grams that a single edit can touch is counted exactly (a replaced or
    deleted letter: grams that cover it; an inserted one: grams with the gap
    inside).  Two near words share all others.
4.  List merging.  As at most ``touched`` grams are lost, two near words share one of
    the ``touched + 1`` rarest grams of each, at the same place in the longer word.
    Only these are in the inverted lists.  The longer word knows its place; the
    shorter one enters its list once as if the edit came behind the gram, and once
    as if before.  In a list, everything on the gram's other side must agree, which
    cuts the list into runs of words with one equal prefix or suffix.
5.  Verification.  The pairs of a run are compared letter by letter.

The bound of step 4 is never vacuous: a framed word of L letters has L + 1 grams and
its longest gram spans less than L, so for words of five letters or more at least
one gram is shared.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sifter.llm.common import spans, text_column, written
from sifter.llm.words import _tables, mix

_U = np.uint64
BEGIN, END = 1, 2  # marks; no letters
MAX_GRAMS = 1 << 18
SHORTEST, LONGEST = 2, 7  # grams; up to eight letters fit one 64-bit number


@dataclass(frozen=True)
class Rule:
    """Words of at least ``letters`` code points that occur ``times`` or more.
    Where ``typo`` divides the crc32 of ``<id>:<run>`` the run loses one letter
    (0: never).  A form occurs at least ``ratio`` times as often as its variant."""

    letters: int = 5
    times: int = 3
    ratio: int = 2
    typo: int = 0
    rare: int = 32


# --- words of a text ----------------------------------------------------------------

def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def letter_runs(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every run of letters; no run crosses two texts."""
    inside = _LETTER[flat]
    inside[1:] |= flat[:-1] == 0xC3  # the second byte of U+00C0 to U+00FF
    first = np.ones(len(flat) + 1, bool)
    first[1:-1] = ~inside[:-1]
    first[offsets] = True
    start = np.flatnonzero(inside & first[:-1])
    last = first[1:].copy()
    last[:-1] |= ~inside[1:]
    return start, np.flatnonzero(inside & last) + 1


def _crc(flat: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of byte runs, each going on from a crc32 before it."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    reg = state[order] ^ np.uint32(0xFFFFFFFF)
    upto = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    for k, n in enumerate(upto):
        reg[:n] = _CRC[(reg[:n] ^ flat[start[:n] + k]) & 0xFF] ^ (reg[:n] >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    return out


def _slices(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Byte runs as a string column."""
    ends = np.r_[0, np.cumsum(size)]
    take = np.arange(ends[-1]) - np.repeat(ends[:-1] - start, size)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat[take].tobytes()))


_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _count_words(rule: Rule):
    def count(batches):
        for batch in batches:
            col = batch.column(1)
            ids = batch.column(0).to_pylist()
            _, cut = text_column(col)
            for lo, hi in spans(cut):
                flat, offsets = text_column(col.slice(lo, hi - lo))
                start, end = letter_runs(flat, offsets)
                flat = _FOLD[flat]
                points = np.r_[0, np.cumsum((flat & 0xC0) != 0x80)]  # not the second byte
                letters = points[end] - points[start]
                keep = letters >= rule.letters
                start, end, letters = start[keep], end[keep], letters[keep]
                if rule.typo:
                    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[lo:hi]], np.uint32)
                    crc = _crc(flat, start, end - start, seeds[np.searchsorted(offsets, start, "right") - 1])
                    hit = crc % np.uint32(rule.typo) == 0
                    lost: dict[str, int] = {}
                    for s, e, h in zip(start[hit].tolist(), end[hit].tolist(), crc[hit].tolist()):
                        word = flat[s:e].tobytes().decode()
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        lost[word] = lost.get(word, 0) + 1
                    lost = {w: n for w, n in lost.items() if len(w) >= rule.letters}
                    if lost:
                        yield pa.RecordBatch.from_arrays([pa.array(list(lost), pa.string()), pa.array(list(lost.values()), pa.int64())], schema=_COUNTED)
                    start, end = start[~hit], end[~hit]
                byte, power, inverse = _tables(1 << max(20, len(flat).bit_length()))
                total = np.r_[_U(0), np.cumsum(byte[flat] * power[:len(flat)], dtype=_U)]
                h = mix((total[end] - total[start]) * inverse[start])
                _, at, n = np.unique(h, return_index=True, return_counts=True)
                if len(at):
                    yield pa.RecordBatch.from_arrays([_slices(flat, start[at], (end - start)[at]), pa.array(n, pa.int64())], schema=_COUNTED)

    return count


def vocabulary(docs: DataFrame, rule: Rule, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of all texts.  Counts are added up in each task
    before they are shuffled; inside one portion of text words are told apart by
    64-bit hashes, between portions as strings.  A null text has no words; a null
    id counts as the empty string in the crc32."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    found = rows.mapInArrow(_count_words(rule), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rule.times)


# --- grams ------------------------------------------------------------------------------

class Framed:
    """Latin-1 letters of a column of words, each between its marks."""

    def __init__(self, col: pa.Array):
        flat, cut = text_column(col)
        lead = flat == 0xC3
        code = np.where(np.r_[False, lead[:-1]], flat + 0x40, flat)[~lead] if len(flat) else flat
        points = np.r_[0, np.cumsum(~lead)][cut]
        self.length = np.diff(points)
        n = len(self.length)
        self.at = points + 2 * np.arange(n + 1)  # first place of each word, its begin mark
        self.code = np.full(int(self.at[-1]), END, np.uint8)
        self.code[self.at[:-1]] = BEGIN
        inner = np.ones(len(self.code), bool)
        inner[self.at[:-1]] = inner[self.at[1:] - 1] = False
        self.code[inner] = code
        self.word = np.repeat(np.arange(n), self.length + 2)
        self.place = np.arange(len(self.code)) - self.at[self.word]
        self.room = self.length[self.word] + 2 - self.place  # letters to the end, the end mark included

    def grams(self, size: int) -> np.ndarray:
        """The gram of ``size`` letters at every place as one number (only where there is room)."""
        out = np.zeros(len(self.code), _U)
        for k in range(size):
            out[:len(out) - k] |= self.code[k:].astype(_U) << _U(8 * k)
        return out


class Dictionary:
    """Frequent grams by length, each list sorted, with octaves of their counts."""

    def __init__(self):
        self.grams: dict[int, np.ndarray] = {}
        self.octave: dict[int, np.ndarray] = {}

    def add(self, size: int, grams: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(grams)
        self.grams[size] = grams[order]
        self.octave[size] = (1 + np.log2(np.maximum(counts[order], 1))).astype(np.uint8)

    def octaves(self, size: int, grams: np.ndarray) -> np.ndarray:
        """0 for rare grams, else the octave of the count."""
        known = self.grams.get(size)
        if known is None or not len(known):
            return np.zeros(len(grams), np.uint8)
        slot = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        return np.where(known[slot] == grams, self.octave[size][slot], 0).astype(np.uint8)


def build_dictionary(vocab: DataFrame, rule: Rule) -> Dictionary:
    """One job a length over the vocabulary; stops when no gram is frequent.
    Occurrences a length over ``limit`` bound the frequent grams that come to
    the driver by ``MAX_GRAMS``."""
    sc = vocab.sparkSession.sparkContext
    places = vocab.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    limit = max(rule.rare, -(-places // MAX_GRAMS))
    found = Dictionary()
    schema = pa.schema([("gram", pa.int64()), ("c", pa.int64())])
    for size in range(SHORTEST, LONGEST + 1):
        known = sc.broadcast(found)

        def count(batches, size=size, known=known):
            for batch in batches:
                words = Framed(batch.column(0))
                on = words.room >= size
                if size > SHORTEST:
                    shorter = words.grams(size - 1)
                    on &= known.value.octaves(size - 1, shorter) > 0
                grams, c = np.unique(words.grams(size)[on], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(c, pa.int64())], schema=schema)

        counted = vocab.select("word").mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
        table = counted.where(F.col("c") > limit).toArrow()
        if not table.num_rows:
            break
        found.add(size, table["gram"].to_numpy().view(_U), table["c"].to_numpy())
    return found


def longest_gram(m):
    """Longest gram in class m: about half a word and one more letter."""
    return np.minimum(LONGEST, (m + 1) // 2 + 1)


def decompose(words: Framed, known: Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """Per place the gram's length if length were free (0 at the end mark, where
    none starts), and the octaves of the grams of every length, one row each."""
    size = np.where(words.room >= SHORTEST, SHORTEST, 0)
    octaves = np.zeros((LONGEST + 1, len(size)), np.uint8)
    growing = size > 0
    for k in range(SHORTEST, LONGEST + 1):
        at = np.flatnonzero(growing)
        octaves[k, at] = known.octaves(k, words.grams(k)[at])
        growing &= (octaves[k] > 0) & (words.room > k)
        size[growing] = k + 1
    return np.minimum(size, LONGEST), octaves


def touched(words: Framed, size: np.ndarray, shorter: bool) -> np.ndarray:
    """Per word the most grams that one edit can touch: grams that cover a letter,
    or, for the shorter word of a pair, that have a gap between letters inside."""
    step = np.zeros(len(size) + 1, np.int64)
    on = np.flatnonzero(size)
    np.add.at(step, on + shorter, 1)
    np.add.at(step, on + size[on], -1)
    return np.maximum.reduceat(np.cumsum(step)[:-1], words.at[:-1]) if len(words.length) else np.zeros(0, np.int64)


_ENTRY = pa.schema([("list", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("side", pa.int32())])
_ENTRY_DDL = "list long, word string, n long, place int, size int, side int"
BOTH, BEHIND, BEFORE = 0, 1, 2  # where the edit may lie, seen from the gram


def entries(col: pa.Array, n: pa.Array, known: Dictionary) -> pa.RecordBatch:
    """Entries of a portion of words in the inverted lists, in both classes."""
    words = Framed(col)
    free, octaves = decompose(words, known)
    out: dict[str, list] = {k: [] for k in ("list", "row", "place", "size", "side")}
    for shorter in (False, True):
        m = words.length + shorter
        size = np.minimum(free, longest_gram(m)[words.word])
        lost = touched(words, size, shorter)
        at = np.flatnonzero(size)
        gram = np.zeros(len(at), _U)
        for k in range(SHORTEST, LONGEST + 1):
            on = size[at] == k
            gram[on] = words.grams(k)[at[on]]
        rank = (octaves[size[at], at].astype(_U) << _U(56)) | (mix(gram) >> _U(8))
        order = np.lexsort((at, rank, words.word[at]))
        at, gram = at[order], gram[order]
        row = words.word[at]
        turn = np.arange(len(at)) - np.searchsorted(row, row)
        rare = turn <= lost[row]
        at, gram, row = at[rare], gram[rare], row[rare]
        place, ends = words.place[at], size[at] == words.room[at]
        sides = [(BOTH, np.ones(len(at), bool), 0)] if not shorter else [(BEHIND, ~ends, 0), (BEFORE, place > 0, 1)]
        for side, on, shift in sides:
            where = m[row[on]].astype(_U) << _U(32) | (place[on] + shift).astype(_U)
            out["list"].append(mix(gram[on] * _U(0x9E3779B97F4A7C15) + mix(where)).view(np.int64))
            out["row"].append(row[on])
            out["place"].append(place[on])
            out["size"].append(size[at[on]])
            out["side"].append(np.full(int(on.sum()), side))
    cols = {k: np.concatenate(v) for k, v in out.items()}
    take = pa.array(cols["row"])
    return pa.RecordBatch.from_arrays([
        pa.array(cols["list"]), col.take(take), n.take(take), pa.array(cols["place"], pa.int32()),
        pa.array(cols["size"], pa.int32()), pa.array(cols["side"], pa.int32())], schema=_ENTRY)


# --- merging the lists -----------------------------------------------------------------------

def _run_pairs(key: np.ndarray):
    """Positions (i, j), i < j, of equal neighbours in a sorted key, one distance
    at a time; a run is never written out as pairs."""
    i = np.flatnonzero(key[1:] == key[:-1])
    gap = 1
    while len(i):
        yield i, i + gap
        gap += 1
        i = i[i + gap < len(key)]
        i = i[key[i + gap] == key[i]]


def _agree(code: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, most: np.ndarray) -> np.ndarray:
    """How many letters from places a and b on agree, at most ``most``."""
    out = np.zeros(len(a), np.int64)
    on = np.flatnonzero(most > 0)
    k = 0
    while len(on):
        on = on[code[a[on] + step * k] == code[b[on] + step * k]]
        k += 1
        out[on] = k
        on = on[most[on] > k]
    return out


def near_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of whole lists, sorted by list, whose words are one edit apart."""
    lists = table["list"].to_numpy()
    same = lists[1:] == lists[:-1]
    several = np.r_[same, False] | np.r_[False, same]
    rows = np.flatnonzero(several)
    if not len(rows):
        return rows, rows
    table = table.take(pa.array(rows))
    words = Framed(table["word"].combine_chunks())
    lists, side = lists[rows].view(_U), table["side"].to_numpy()
    first = words.at[:-1] + table["place"].to_numpy()
    until = first + table["size"].to_numpy()
    byte, power, inverse = _tables(1 << max(20, len(words.code).bit_length()))
    total = np.r_[_U(0), np.cumsum(byte[words.code] * power[:len(words.code)], dtype=_U)]
    span = lambda a, b: mix((total[b] - total[a]) * inverse[a])
    found = []
    for other, a, b in ((BEHIND, words.at[:-1], until), (BEFORE, first, words.at[1:])):
        on = np.flatnonzero((side == BOTH) | (side == other))
        key = mix(lists[on] + span(a[on], b[on]) * _U(3) + _U(other))
        order = np.argsort(key, kind="stable")
        on, key = on[order], key[order]
        for i, j in _run_pairs(key):
            p, q = on[i], on[j]
            ok = (side[p] == BOTH) | (side[q] == BOTH)
            p, q = p[ok], q[ok]
            least = np.minimum(words.length[p], words.length[q])
            front = _agree(words.code, words.at[p] + 1, words.at[q] + 1, 1, least)
            back = _agree(words.code, words.at[p + 1] - 2, words.at[q + 1] - 2, -1, least - np.minimum(front, least))
            gap = np.abs(words.length[p] - words.length[q])
            hit = (gap <= 1) & (front + back >= least - (gap == 0)) & ((gap == 1) | (front < least))
            found.append(np.stack([p[hit], q[hit]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return rows[pairs[0]], rows[pairs[1]]


_EDGE = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string()), ("other_n", pa.int64())])


def _edges(table: pa.Table) -> pa.RecordBatch:
    i, j = near_pairs(table)
    u, v = pa.array(np.r_[i, j]), pa.array(np.r_[j, i])
    word, n = table["word"], table["n"]
    made = pa.table([word.take(u), n.take(u), word.take(v), n.take(v)], schema=_EDGE)
    return made.group_by(_EDGE.names).aggregate([]).select(_EDGE.names).combine_chunks()


def _merge_lists(batches, least: int = 200_000):
    """Edges of a stream of entries sorted by list.  Whole lists are gathered to
    portions; what follows the last list end waits for the next batch."""
    waiting: list[pa.Table] = []
    rows = 0
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.concat_tables(waiting).combine_chunks()
        lists = table["list"].to_numpy()
        cut = int(np.searchsorted(lists, lists[-1]))
        if cut:
            yield from _edges(table.slice(0, cut)).to_batches()
        waiting = [table.slice(cut)]
        rows = table.num_rows - cut
    if rows:
        yield from _edges(pa.concat_tables(waiting).combine_chunks()).to_batches()


def near_words(vocab: DataFrame, rule: Rule) -> DataFrame:
    """(word, n, other, other_n): every pair of words one inserted, deleted or
    replaced code point apart, in both directions, once each."""
    known = vocab.sparkSession.sparkContext.broadcast(build_dictionary(vocab, rule))

    def enter(batches):
        for batch in batches:
            if batch.num_rows:
                yield entries(batch.column(0), batch.column(1), known.value)

    listed = vocab.select("word", "n").mapInArrow(enter, _ENTRY_DDL)
    merged = listed.repartition("list").sortWithinPartitions("list").mapInArrow(_merge_lists, "word string, n long, other string, other_n long")
    # one shuffle: rows dealt by word are dealt well for (word, other) too
    return merged.repartition("word").dropDuplicates(["word", "other"])


# --- forms and roots ----------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), none null: the end of each word's chain of
    forms.  Chains halve every round; counts at least double along a chain (ratio
    2), so there are few rounds.  Every round is a written table."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        joined = now.join(step, now["root"] == step["via"], "left")
        after = written(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return now
        now = after.drop("moved")


def variants(docs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    Near words differ by exactly one inserted, deleted or replaced code point.  A
    word's form is its near word of largest n (ties: the smallest word), if that n
    is at least ``ratio`` times its own, else null; the root is the last word of
    the chain of forms, the word itself if it has none.  Null and blank texts
    have no words, repeated rows count again, an empty table gives no rows, and
    other columns don't matter, whatever their names.
    """
    if rule.letters < 5 or rule.ratio < 2:
        raise ValueError("words need five letters, so that two near words share a gram, and forms twice the count, so that chains end")
    vocab = written(vocabulary(docs, rule, id_col=id_col, text_col=text_col), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = near_words(vocab, rule).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("own"))
    named = -F.col("best.less") >= rule.ratio * F.col("own")
    near = written(near.select("word", "n_near", F.when(named, F.col("best.word")).alias("form"), F.when(named, -F.col("best.less")).alias("form_n")), "near")
    chains = roots(near.where("form is not null").select("word", "form"))
    out = vocab.join(near, "word", "left").join(chains, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
