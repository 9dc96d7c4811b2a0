"""Packing by minimum bin slack: subset sums as bitsets pick what fills each window closest to its capacity."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_arrow

CAPACITY = 2048
END_ID = 1
#: Pieces of text a worker remembers that it has met twice, and those it has met once; a set that is full starts anew.
KNOWN, FRESH = 250_000, 150_000
#: Characters, or texts, from which on a group of texts is looked up, and the most new words in one call of the tokenizer.
GROUP_CHARS, GROUP_TEXTS, CALL_WORDS = 1 << 17, 500, 500
#: Punctuation between a letter and white space is a part of its own for the tokenizer, too. The pattern begins with
#: the punctuation, which is searched for faster than what must stand before it.
_SIGNS = "[!#$%&*+,./:;=?@^~-]"
_LONE = re.compile(f"{_SIGNS}(?<=[a-z\xdf-\xf6\xf8-\xff]{_SIGNS}){_SIGNS}*(?=\\s|\\Z)")
#: The beginning of the tokenizer's special tokens' names, which may stand inside a word, and white space on which
#: Python and the tokenizer may differ: such a text is encoded as a whole.
_SPECIAL = "<|"
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
#: Two letters whose lower form depends on what stands beside them, and marks that may join a small letter but not its
#: capital, which the tokenizer lowers last: such a text is not lowered before.
_CASE = re.compile("[\u0130\u03a3\u0300-\u036f]")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _part int, _rank long"


class Encoder:
    """Token ids of whole texts as 32-bit bytes, little-endian on every machine Spark runs on here.

    The tokenizer lowers the text, cuts at white space and drops it, so a text's ids are those of its parts
    between white space. Different parts of a group of texts are looked up once, and the new ones that are words
    of letters share calls of the tokenizer. Most different parts come once only, so a part is kept for long from
    its second group on.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}

    def _bytes(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encoded(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Letters alone are one word to the tokenizer, which names the word of each id: several go in one call.

        If it finds more or fewer words than it was given, these parts go one by one, like those with other signs.
        """
        words = [p for p in parts if p.isalpha()]
        single = [p for p in parts if not p.isalpha()]
        for a in range(0, len(words), CALL_WORDS):
            some = words[a : a + CALL_WORDS]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, word = array("I", found.ids).tobytes(), np.array(found.word_ids, np.int64)
            ends = [*(4 * (np.flatnonzero(np.diff(word)) + 1)).tolist(), len(ids)]
            if len(ends) == len(some):
                yield from zip(some, (ids[x:y] for x, y in zip([0, *ends], ends)))
            else:
                single += some
        for part in single:
            yield part, self._bytes(part)

    def ids_of(self, texts: list[str]) -> list[bytes]:
        parts: list[list[str] | None] = []
        for text in texts:
            if _SPECIAL in text or _ODD.search(text):
                parts.append(None)
                continue
            if text.isascii() or not _CASE.search(text):
                text = _LONE.sub(r" \g<0>", text.lower())
            parts.append(text.split())
        known, fresh = self.known, self.fresh
        if len(known) > KNOWN:
            known.clear()
        if len(fresh) > FRESH:
            fresh.clear()
        once = []
        for part in set().union(*(p for p in parts if p is not None)).difference(known):
            ids = fresh.pop(part, None)
            if ids is None:
                once.append(part)
            else:
                known[part] = ids
        known.update(self._encoded(once))
        get = known.__getitem__
        out = [self._bytes(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts)]
        for part in once:
            fresh[part] = known.pop(part)
        return out

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def groups_of(texts: pa.Array) -> Iterator[list[str]]:
    """All texts in order, in lists that end at ``GROUP_CHARS`` characters or ``GROUP_TEXTS`` texts; a null is empty."""
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= GROUP_CHARS or len(group) >= GROUP_TEXTS:
            yield group
            group, size = [], 0
    if group:
        yield group


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """Each document's ids and the end id, cut every ``capacity`` ids. ``_rank`` counts the earlier pieces of
    the same length in the same input partition ``_part``."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids_of
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
        for batch in batches:
            doc_ids = iter(batch.column(0).to_pylist())
            for texts in groups_of(batch.column(1)):
                rows: list[tuple] = []
                for ids, doc_id in zip(encode(texts), doc_ids):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        own = ids[4 * start : 4 * (start + capacity)]
                        length = len(own) // 4
                        rows.append((doc_id, start, length, zlib.crc32(own), n, part, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_part", "_rank"],
                )

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, PIECE)


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum comes closest to ``room`` without passing it.

    Bit s of the set is on if some multiset sums to s. Lengths join from the longest down, in batches of 1, 2,
    4 ... copies, until ``room`` itself is reached or none is left; going back through the sets gives the counts.
    """
    mask, sums = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, batch = min(counts[length], room // length), 1
        while left and not sums >> room:
            batch = min(batch, left)
            steps.append((length, batch, sums))
            sums |= (sums << (length * batch)) & mask
            left -= batch
            batch *= 2
        if sums >> room:
            break
    at, used = sums.bit_length() - 1, {}
    for length, batch, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + batch
            at -= length * batch
    return used


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a window, number of such windows), until every piece has a place.

    The longest piece left opens a window, minimum bin slack fills the rest, and the same filling repeats as
    often as the counts allow; so the work depends on the number of different lengths, not of pieces.
    """
    left, out = dict(counts), []
    while left:
        seed = max(left)
        rest = {x: n - (x == seed) for x, n in left.items() if n > (x == seed)}
        window = closest_fill(rest, capacity - seed)
        window[seed] = window.get(seed, 0) + 1
        times = min(left[x] // n for x, n in window.items())
        for x, n in window.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((window, times))
    return out


def places(windows: list[tuple[dict[int, int], int]]) -> list[np.ndarray]:
    """For each length, ranks in order are dealt to windows: columns length, first rank, first sequence, copies
    in a window, offset of the first copy."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for window, times in windows:
        offset = 0
        for length in sorted(window, reverse=True):
            copies = window[length]
            rows.append((length, used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return list(np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with id 1; it is cut every ``capacity`` ids and its last piece fills windows by minimum
    bin slack over the counts of all lengths (at most ``capacity`` numbers, all that the driver sees). Pieces of
    one length are interchangeable: they get ranks (by input partition, then order) and ranks get places.
    A null or empty text is the end id alone; a null doc_id is kept; repeated rows are packed each; an empty
    table gives no rows. Other columns are not carried. Sequence ids run from 0 without gaps.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.table(pieces(docs, tokenizer, capacity), "pieces")
    groups = scratch.table(cut.groupBy("length", "_part").agg(F.count("*").alias("_n")), "counts")
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("_n")).collect()}
    length, first_rank, sequence, copies, offset = places(patterns(counts, capacity))
    shift = 1 << 48
    starts = length * shift + first_rank

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rank = (batch.column(n).to_numpy() for n in ("length", "_place"))
            at = np.searchsorted(starts, own * shift + rank, side="right") - 1
            past = rank - first_rank[at]
            kept = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept,
                    pa.array(sequence[at] + past // copies[at]),
                    pa.array(offset[at] + past % copies[at] * own),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = groups.select(
        F.col("length").alias("_l"),
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    placed = cut.join(ahead, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    placed = placed.withColumn("_place", F.col("_rank") + F.col("_before")).drop("_l", "_p", "_part", "_rank", "_before")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return in_arrow(placed, deal, schema)
