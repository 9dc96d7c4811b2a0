"""Language identification by partial matching: code lengths under frozen byte context trees per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, in_arrow, text_beside, text_in, text_slices

#: Expected number of different labelled texts that a language's tree is counted from; whole texts, drawn by hash.
ROWS_PER_LANGUAGE = 1000
DRAWS = 1 << 30
#: A context of three bytes that no language has seen so often is left to its shorter ones.
LEAST_CONTEXT = 4
ORDER = 3
#: Code lengths are whole numbers of 2**-SCALE bits, so sums do not depend on order.
SCALE = 16
UNKNOWN = "und"
LETTER = r"\p{L}"
GRAMS = "lang string, gram long, n long"


def byte_classes() -> np.ndarray:
    """Classes of lowered UTF-8: a-z and bytes from 128 stand for themselves; digits, white space and all other
    ASCII are one class each."""
    table = np.full(256, 1, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[0x30:0x3A] = 2
    table[0x61:0x7B] = np.arange(3, 29)
    table[128:] = np.arange(29, 157)
    return table


CLASSES = byte_classes()
N_CLASSES = 157


def padded(column: pa.Array) -> pa.Array:
    """Lowered texts after as many spaces as the longest context has bytes."""
    column = column.cast(pa.large_string())
    pad = pa.scalar(" " * ORDER, pa.large_string())
    empty = pa.scalar("", pa.large_string())
    return pc.binary_join_element_wise(pad, pc.utf8_lower(column.fill_null("")), empty)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> counts of a byte class with the three before it, packed in base 256."""
    for batch in batches:
        langs = batch.column(0)
        for lang in langs.unique().to_pylist():
            texts = padded(batch.column(1).filter(pc.equal(langs, lang)))
            total: dict[int, int] = {}
            for _, _, raw, offsets in text_slices(texts):
                c = CLASSES[raw].astype(np.int64)
                grams = (c[:-3] << 24) | (c[1:-2] << 16) | (c[2:-1] << 8) | c[3:]
                inside = np.ones(len(grams), bool)
                for j in range(ORDER):  # the gram that begins so near a text's end runs into the next
                    edge = offsets[1:-1] - 1 - j
                    inside[edge[edge >= 0]] = False
                found, n = np.unique(grams[inside], return_counts=True)
                for g, m in zip(found.tolist(), n.tolist()):
                    total[g] = total.get(g, 0) + m
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                names=["lang", "gram", "n"],
            )


@dataclass
class Model:
    """``codes[c * symbols + s, l]``: code length of symbol s in context c under language l."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    context: np.ndarray  # three symbols -> context
    codes: np.ndarray
    symbols: int


def _dense(grams: np.ndarray, n: np.ndarray, order: int, contexts: np.ndarray, a: int) -> np.ndarray:
    """Counts [context, symbol] of the given contexts of ``order`` symbols (base ``a``)."""
    keys = grams % a ** (order + 1)
    out = np.zeros((len(contexts), a), np.float64)
    at = np.searchsorted(contexts, keys // a)
    at = np.minimum(at, len(contexts) - 1)
    known = contexts[at] == keys // a
    np.add.at(out, (at[known], (keys % a)[known]), n[known])
    return out


def code_lengths(levels: list[np.ndarray], a: int) -> np.ndarray:
    """Bits of every symbol in every context, escape method C with exclusion.

    ``levels``: counts [context, symbol] from the longest context to the empty one. A symbol seen in a context
    costs count / (sum + kinds); otherwise the escape kinds / (sum + kinds) leads to the next shorter context,
    where symbols already passed over no longer count. Below the empty context the rest is uniform.
    """
    bits = np.zeros_like(levels[0])
    spent = np.zeros((len(bits), 1))
    passed = np.zeros(bits.shape, bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for counts in levels:
            left = np.where(passed, 0, counts)
            total, kinds = left.sum(axis=1, keepdims=True), (left > 0).sum(axis=1, keepdims=True)
            here = left > 0
            bits = np.where(here, spent - np.log2(left / (total + kinds)), bits)
            spent = np.where(kinds > 0, spent - np.log2(kinds / (total + kinds)), spent)
            passed |= counts > 0
        rest = (~passed).sum(axis=1, keepdims=True)
        return np.where(passed, bits, spent + np.log2(np.maximum(rest, 1)))


def build_model(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    languages = sorted(counts)
    classes = np.unique(np.concatenate([np.concatenate([(g >> s) & 255 for s in (0, 8, 16, 24)]) for g, _ in counts.values()]))
    a = len(classes) + 1  # the last symbol stands for what was never seen
    dense = np.full(256, a - 1, np.int64)
    dense[classes] = np.arange(len(classes))
    grams = {
        x: (sum(dense[(g >> (8 * j)) & 255] * a**j for j in range(ORDER + 1)), n) for x, (g, n) in counts.items()
    }
    common = []
    for g, n in grams.values():
        found, at = np.unique(g // a, return_inverse=True)
        common.append(found[np.bincount(at, n) >= LEAST_CONTEXT])
    third = np.unique(np.concatenate(common))
    second = np.arange(a * a)
    context = np.tile(second + len(third), a)  # (x, y, z) -> (y, z), unless the three are known
    context[third] = np.arange(len(third))
    codes = np.empty(((len(third) + a * a) * a, len(languages)), np.int32)
    for i, x in enumerate(languages):
        own = {k: _dense(*grams[x], k, np.arange(a**k), a) for k in range(ORDER)}
        two = [own[2], own[1][second % a], np.broadcast_to(own[0], (a * a, a))]
        three = [_dense(*grams[x], 3, third, a)] + [t[third % (a * a)] for t in two]
        bits = np.concatenate([code_lengths(three, a), code_lengths(two, a)])
        codes[:, i] = np.rint(bits.ravel() * (1 << SCALE))
    symbol = dense[CLASSES.astype(np.int64)].astype(np.uint8)
    return Model(languages, symbol, context.astype(np.int32), codes, a)


def total_codes(model: Model, texts: pa.Array) -> np.ndarray:
    """Whole code length of every padded text under every language."""
    a, out = np.int32(model.symbols), np.zeros((len(texts), len(model.languages)), np.int64)
    for first, end, raw, offsets in text_slices(texts, SLICE_BYTES // 2):
        s = model.symbol[raw].astype(np.int32)
        place = (s[:-3] * a + s[1:-2]) * a + s[2:-1]
        costs = np.take(model.codes, np.take(model.context, place) * a + s[3:], axis=0)
        edges = np.stack([offsets[:-1], offsets[1:] - ORDER], axis=1).ravel()
        if edges[-1] >= len(costs):
            costs = np.concatenate([costs, np.zeros((1, costs.shape[1]), costs.dtype)])
        sums = np.add.reduceat(costs, edges, axis=0, dtype=np.int64)[::2]
        out[first:end] = np.where((np.diff(offsets) > ORDER)[:, None], sums, 0)
    return out


def train(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Trees from rows (text, lang): of each language's different texts about ``rows_per_language`` are drawn by a hash of
    the text, whole, and the one with the least hash in any case; the driver gets their summed gram counts. None if
    nothing is labelled.

    Copies fall together and count once, so neither a text that makes up most of a language nor rows without an id or
    with one id for all can fill the sample or keep a language out of it.
    """
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    hashed = labelled.withColumn("_h", F.xxhash64("text"))
    draw = F.pmod(F.xxhash64("_h", F.lit("sample")), F.lit(DRAWS))
    sizes = hashed.groupBy("lang").agg(F.count_distinct("_h").alias("texts"), F.min(draw).alias("least")).collect()
    if not sizes:
        return None
    # as many entries as there are languages, which the model holds anyway
    upto = {r["lang"]: max(r["least"], rows_per_language * DRAWS // r["texts"] - 1) for r in sizes}
    limits = F.create_map(*[F.lit(v) for x, n in sorted(upto.items()) for v in (x, n)])
    drawn = hashed.filter(draw <= F.element_at(limits, F.col("lang"))).select("lang", "text").distinct()
    grams = in_arrow(drawn.select("lang", "text"), gram_counts, GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = grams.toPandas()
    counts = {x: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.float64)) for x, g in rows.groupby("lang")}
    return build_model(counts) if counts else None


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` of every whole text.

    The language whose tree gives the shortest code wins, ties by name; the score is its share among equally
    likely languages, 2^-bits over the sum. Null texts, texts without a letter, and all texts if the model is
    None get ``und`` and 0. Equal texts get equal results; rows are independent of each other.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(
        [docs.schema[c] for c in keep] + [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = text_in(batch, text)
            has = pc.fill_null(pc.match_substring_regex(texts, LETTER), False).to_numpy(zero_copy_only=False)
            names, value = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if own is not None and has.any():
                bits = total_codes(own, padded(texts)) / float(1 << SCALE)
                best = bits.argmin(axis=1)
                over = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)
                share = 1 / np.exp2(-over).sum(axis=1)
                names = np.where(has, np.array(own.languages, object)[best], names)
                value = np.where(has, share, value)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(value)], names=[*keep, "lang_pred", "score"]
            )

    return in_arrow(text_beside(docs, keep, text), score, schema)


def predict_languages(
    docs: DataFrame,
    keep: list[str] | None = None,
    rows_per_language: int = ROWS_PER_LANGUAGE,
    text: str = "text",
) -> DataFrame:
    """Learns from the labelled rows of ``docs`` that are not held out and predicts all rows.

    Held out: crc32 of doc_id as text, modulo 4, is 2 (a null doc_id is not held out). Needs doc_id, text, lang.
    """
    model = train(docs.filter(~is_held_out(F.col("doc_id"))).select("text", "lang"), rows_per_language)
    columns = keep or ["doc_id"]
    marked = docs.withColumn("_held_", is_held_out(F.col("doc_id")))
    out = identify(marked, model, [*columns, "_held_"], text)
    return out.withColumnRenamed("_held_", "held_out")
