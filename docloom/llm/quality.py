"""Quality rules: base counts of a text and the fertility of a public tokenizer on it.

A document is measured whole: words, symbols, repeated lines and repeated three-word
windows, then what a public vocabulary makes of its words: characters per token, the
share of tokens that are byte fallbacks, and the entropy of its tokens beyond what a
curve fitted to all documents expects of so many tokens.  The medians and spreads of the
three measures are taken over all documents of a language (of a script where the
language is null); a document outside its band is rejected.  Words are cut into tokens once each and kept
in a bounded table per Python worker, so the cost a word is one look-up.

Defined cases: a null text has no words and fails the base rules; ties and repeated
rows are judged alike; an empty table gives no rows; further columns are kept by
:func:`keep_good`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize

#: Symbols that the base rules count.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Words that a Python worker remembers with their tokens; the table is emptied when it is full.
WORDS_KEPT = 400_000
#: Characters of text whose words are looked up together.
TEXT_AT_ONCE = 4_000_000
#: How many robust standard deviations a band reaches from its median, and the least value of one deviation:
#: characters a token, entropy in bits beyond what so many tokens have, share of byte fallbacks.
WIDTHS = {"fertility": (4.5, 0.02), "surplus": (4.0, 0.05), "fallback": (6.0, 0.01)}
#: From so many tokens on, characters a token vary no more with the length.
SETTLED = 1000
#: Up to this many languages or scripts the bands are broadcast.
BROADCAST_BANDS = 100_000

#: First code points of blocks and the script that starts there (fixed values of the Unicode charts).
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "common"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x1F000, "common"), (0x20000, "han"),
)

METRICS = pa.schema(
    [
        ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
        ("n_tokens", pa.int64()), ("fertility", pa.float64()), ("fallback", pa.float64()), ("entropy", pa.float64()), ("script", pa.string()),
    ]
)


class _Words:
    """Distinct words with their tokens: an index a word, and ragged arrays by index."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.is_byte = np.array([self.model.IsByte(i) for i in range(self.model.GetPieceSize())])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        new = [w for w in set(words) if w not in index]
        if new:
            cut = self.model.encode([w.decode() for w in new], num_threads=1)
            n = len(index)
            index.update(zip(new, range(n, n + len(new))))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(c) for c in cut])])
            self.ids = np.concatenate([self.ids, np.fromiter((i for c in cut for i in c), np.int32)])
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def tokens(self, at: np.ndarray) -> np.ndarray:
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)]


_WORDS: dict[str, _Words] = {}


def repeated_words(at: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more; at has one number a distinct word."""
    if len(at) < 4:
        return 0
    if at.max() < 1 << 21:
        windows = (at[:-2] << 42) | (at[1:-1] << 21) | at[2:]
    else:
        _, windows = np.unique(np.stack([at[:-2], at[1:-1], at[2:]], 1), axis=0, return_inverse=True)
        windows = windows.ravel()
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(ranked), bool)
    again[1:] |= same
    again[:-1] |= same
    inside = np.zeros(len(at), bool)
    first = order[again]
    for k in range(3):
        inside[first + k] = True
    return int(inside.sum())


def script_of(text: str) -> str:
    """The script of most letters."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "common"
    points = np.frombuffer("".join(c for c in text if c.isalpha()).encode("utf-32-le"), np.uint32)
    if not len(points):
        return "common"
    at = np.bincount(np.searchsorted([a for a, _ in SCRIPT_STARTS], points, "right") - 1, minlength=len(SCRIPT_STARTS))
    totals: dict[str, int] = {}
    for (_, name), n in zip(SCRIPT_STARTS, at.tolist()):
        totals[name] = totals.get(name, 0) + n
    return max(sorted(totals), key=totals.__getitem__)


def measure(text: str | None, lang: str | None, cut: list[bytes], at: np.ndarray, words: _Words) -> tuple:
    """The row of METRICS of a text that is cut into words, which have the indexes at."""
    if text is None:
        return 0, 0, 0, 0, 0, 0, None, None, None, None if lang is not None else "common"
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    tokens = words.tokens(at)
    fertility = fallback = entropy = None
    if len(tokens):
        counts = np.bincount(tokens) if len(tokens) > 8192 else np.unique(tokens, return_counts=True)[1]
        share = counts[counts > 0] / len(tokens)
        entropy = float(-(share * np.log2(share)).sum())
        fertility, fallback = chars / len(tokens), float(words.is_byte[tokens].mean())
    return (
        len(cut), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(at),
        len(tokens), fertility, fallback, entropy, script_of(text) if lang is None else None,
    )


def measure_all(texts: list[str | None], langs: list[str | None], words: _Words) -> list[tuple]:
    """Rows of METRICS; some megabytes of text at a time share their look-ups."""
    rows: list[tuple] = []
    start = 0
    while start < len(texts):
        cuts, size = [], 0
        while start + len(cuts) < len(texts) and size < TEXT_AT_ONCE:
            text = texts[start + len(cuts)] or ""
            cuts.append(text.encode().split())
            size += len(text)
        if len(words.index) > WORDS_KEPT:
            words.clear()
        at = words.look_up([w for c in cuts for w in c])
        ends = np.cumsum([len(c) for c in cuts])
        for k, cut in enumerate(cuts):
            rows.append(measure(texts[start + k], langs[start + k], cut, at[ends[k] - len(cut) : ends[k]], words))
        start += len(cuts)
    return rows


def _measured(model: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.get(model) or _WORDS.setdefault(model, _Words(model))
        for batch in batches:
            rows = measure_all(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist(), words)
            found = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in METRICS], METRICS)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + found, names=[*kept, *METRICS.names])

    return run


def metrics(docs: DataFrame, columns: list[Column], model: str) -> DataFrame:
    """columns (with names of their own), the key of the band, and the measures of every document."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    held = docs.select(*columns, F.col("text").alias("_text"), lang.alias("_lang"))
    kept = [c for c in held.columns if c != "_text"]
    types = {"int64": "bigint", "double": "double", "string": "string"}
    schema = ", ".join([f"`{c}` {held.schema[c].dataType.simpleString()}" for c in kept] + [f"{f.name} {types[str(f.type)]}" for f in METRICS])
    out = held.mapInArrow(_measured(model, kept), schema)
    return out.withColumn("band", F.coalesce(F.concat(F.lit("lang:"), "_lang"), F.concat(F.lit("script:"), "script"))).drop("_lang", "script")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _entropy_curve(measured: DataFrame) -> tuple[float, float, float]:
    """Entropy in bits expected of a number of tokens: a parabola in its logarithm, by least squares over all documents."""
    x, y = F.log2("n_tokens"), F.col("entropy")
    sums = measured.where(~base_failed()).agg(*[F.sum(x**k).alias(f"x{k}") for k in range(5)], *[F.sum(y * x**k).alias(f"y{k}") for k in range(3)]).first()
    if not sums["x0"]:
        return 0.0, 0.0, 0.0
    left = np.array([[sums[f"x{i + j}"] for j in range(3)] for i in range(3)], float)
    found, *_ = np.linalg.lstsq(left, np.array([sums[f"y{i}"] for i in range(3)], float), rcond=None)
    return tuple(map(float, found))


def _with_residuals(measured: DataFrame) -> DataFrame:
    a, b, c = _entropy_curve(measured)
    x = F.log2("n_tokens")
    return measured.withColumn("surplus", F.col("entropy") - (F.lit(a) + F.lit(b) * x + F.lit(c) * x * x))


def bands(measured: DataFrame) -> DataFrame:
    """Median and spread of each measure by language or script, over all documents that pass the base rules."""
    middle = measured.where(~base_failed()).groupBy("band").agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in WIDTHS])
    return middle.select(
        "band", *[x for c, (_, least) in WIDTHS.items() for x in (F.col(c)[1].alias(f"{c}_mid"), F.greatest((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(least)).alias(f"{c}_spread"))]
    )


def judged(measured: DataFrame) -> DataFrame:
    """measured with base_failed and kept; a band of its own for every language or script.

    Short texts vary more: below SETTLED tokens the width for fertility grows with the root of the length.
    """
    measured = _with_residuals(measured)
    limits = bands(measured)
    small = limits.limit(BROADCAST_BANDS + 1).count() <= BROADCAST_BANDS
    joined = measured.join(F.broadcast(limits) if small else limits, "band", "left")
    off = {c: (F.col(c) - F.col(f"{c}_mid")) / F.col(f"{c}_spread") for c in WIDTHS}
    steady = F.sqrt(F.least(F.lit(1.0), F.col("n_tokens") / SETTLED))
    # more characters a token or more entropy than the band is no fault, nor are fewer fallbacks
    inside = (off["fertility"] * steady >= -WIDTHS["fertility"][0]) & (off["surplus"] >= -WIDTHS["surplus"][0]) & (off["fallback"] <= WIDTHS["fallback"][0])
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def rate(docs: DataFrame, model: str) -> DataFrame:
    """doc_id with all counts, measures and verdicts."""
    return judged(materialize(metrics(docs, [F.col("doc_id")], model), "quality"))


def keep_good(docs: DataFrame, model: str) -> DataFrame:
    """The documents that are kept, with all their columns."""
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), *[docs[c] for c in ("text", "lang") if c in docs.columns])
    scored = materialize(metrics(held, [F.col("_doc")], model), "quality")
    return judged(scored).where("kept").select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
