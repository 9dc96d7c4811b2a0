import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tassel.llm import op9_packing as op
from tassel.llm.common import documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, docs, plain, capacity):
    """Every id of every document in one piece, and every sequence gapless."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc, text in docs:
        ids = plain(text)
        for at in range(0, len(ids), capacity):
            own = np.array(ids[at : at + capacity], "<u4").tobytes()
            want[(doc, len(ids))].append((at, len(own) // 4, zlib.crc32(own)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences)


SPECIAL = ["hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|>b, c.", "<|ENDOFTEXT|> x", "< |endoftext|>", "<|end oftext|>", "x <| y |>"]


def test_special_strings_are_what_the_plain_call_makes_of_them(spark, plain):
    assert plain(SPECIAL[0])[:-1] == [3306, 49407, 1002]
    docs = list(enumerate(SPECIAL * 2))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    check(op.pack(df, PATH, 64).collect(), docs, plain, 64)


def test_random_texts_are_what_the_plain_call_makes_of_them(plain):
    rng, encode = random.Random(3), op.Encoder(PATH)
    signs = list("abzéßÀ09'\"._-+=*&$#@!?,;:/<>|~^%()[]{}\\") + [" ", "  ", "\n", "\t", "\u0301", "\u0338", "Σ", "日", "'s", "n't", "...", "<|"]
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(25)))
        assert np.frombuffer(encode.ids(text), "<u4").tolist() == plain(text)[:-1], repr(text)


def test_documents(spark, plain):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = op.pack(docs, PATH).collect()
    used = check(rows, [(r.doc_id, r.text) for r in docs.collect()], plain, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("capacity", [7, 512])
def test_awkward_rows(awkward, clashing, awkward_rows, empty, plain, capacity):
    docs = [r[:2] for r in awkward_rows]
    for df in (awkward, clashing):
        check(op.pack(df, PATH, capacity).collect(), docs, plain, capacity)
    assert op.pack(empty, PATH, capacity).count() == 0


@pytest.mark.parametrize(
    "text",
    ["a!!, b., c,", "Σας ΣΑΣ. x,", "4.0, 5.", "it's, don't. l'été, d́. é, É. ﬁ, Ω. İstanbul, ŉ.", "x,\x1cy.\x0bz", "",
     "<|endoftext|>, a<|endoftext|>.", "１２, a１. ²."],
)
def test_ids_are_the_tokenizers(text, plain):
    assert np.frombuffer(op.Encoder(PATH).ids(text), "<u4").tolist() == plain(text)[:-1]


class Counting:
    """The tokenizer, with the number of its calls."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode(self, *args, **settings):
        self.calls += 1
        return self.tokenizer.encode(*args, **settings)


def words(rng, n, letters="abcdefghijklmnopqrstuvwxyzßéè"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def test_new_words_share_calls_of_the_tokenizer(plain):
    encode = op.Encoder(PATH)
    encode.tokenizer = Counting(encode.tokenizer)
    text = " ".join(words(random.Random(5), 3000))
    assert np.frombuffer(encode.ids(text), "<u4").tolist() == plain(text)[:-1]
    assert encode.tokenizer.calls <= 12


#: Letters that NFC composes or takes apart, letters with no lower form or two, marks, and other letters.
LETTERS = (
    "abzJ\u00e9\u00df\u00c0\u0132\u0149\u01c5\u01f0\u0130\u0131\u017fK\u212a\u212b\u2126\u03a3\u03c3\u03c2\u0416\u0436\u05d0\u05d9"
    "\ufb1d\ufb2a\u1100\u1161\u11a8\ud55c\u65e5\u672c\uf900\u0e01\U00010400\U0001d400\u00aa\u00ba\u02b0\u216d\ua7ca\u0301\u030c\u05c1"
)


def test_words_of_all_letters_are_what_the_plain_call_makes_of_them(plain, monkeypatch):
    monkeypatch.setattr(op, "CALL_WORDS", 3)
    rng, encode = random.Random(7), op.Encoder(PATH)
    texts = [" ".join(words(rng, rng.randrange(8), LETTERS)) for _ in range(4000)]
    for a in range(0, len(texts), 20):
        for text, ids in zip(texts[a : a + 20], encode.ids_of(texts[a : a + 20]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text)[:-1], repr(text)


def test_texts_of_a_group_keep_their_ids_when_the_worker_forgets(plain, monkeypatch):
    monkeypatch.setattr(op, "KNOWN", 20)
    monkeypatch.setattr(op, "FRESH", 30)
    rng, encode = random.Random(9), op.Encoder(PATH)
    some = [*words(rng, 60), "b,", "c!!", "4.0", "it's", "<|endoftext|>", "a\u2003b", "x\x1cy", "", "Σας"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(600)]
    for a in range(0, len(texts), 7):
        for text, ids in zip(texts[a : a + 7], encode.ids_of(texts[a : a + 7]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text)[:-1], repr(text)


@pytest.mark.parametrize("text", ["J\u030ca Y\u030a, y\u030a", "\u0130\u05c1 \u0130, i"])
def test_capitals_with_marks(text, plain):
    assert np.frombuffer(op.Encoder(PATH).ids(text), "<u4").tolist() == plain(text)[:-1]


def test_groups_hold_all_texts_in_order(monkeypatch):
    monkeypatch.setattr(op, "GROUP_CHARS", 5)
    monkeypatch.setattr(op, "GROUP_TEXTS", 3)
    texts = ["ab", "cde", "f" * 50, None, "", "", "g", "h"]
    assert list(op.groups_of(pa.array(texts))) == [["ab", "cde"], ["f" * 50], ["", "", ""], ["g", "h"]]
    assert list(op.groups_of(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("seed", range(5))
def test_closest_fill_is_the_closest(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
    room = rng.randrange(1, 90)
    items = [x for x, n in counts.items() for _ in range(n)]
    best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
    found = op.closest_fill(counts, room)
    assert sum(x * n for x, n in found.items()) == best and all(n <= counts[x] for x, n in found.items())


@pytest.mark.parametrize("seed", range(3))
def test_patterns_use_every_piece_with_little_padding(seed):
    rng = random.Random(seed)
    counts = Counter(min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(5000))
    windows = op.patterns(dict(counts), 100)
    used = Counter()
    for window, times in windows:
        assert sum(x * n for x, n in window.items()) <= 100
        for x, n in window.items():
            used[x] += n * times
    assert used == counts
    total = sum(times for _, times in windows)
    assert total <= -(-sum(x * n for x, n in counts.items()) // 100) + 1
