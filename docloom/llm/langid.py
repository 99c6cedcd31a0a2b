"""Language identification by a bidirectional gated recurrent network over bytes.

The bytes of a text are read in segments, forwards and backwards, by gated units with
clipped-linear gates; every position gets a probability for each language, and a document's are
the means over all its positions.  The network is trained with numpy by backpropagation
through time on segments of the labelled documents that are not held out: as many as its steps take, drawn
by hashes from all segments of all those texts, evenly over languages; nothing but the text is read for a prediction.

Defined cases: a null text, an empty one or one without a letter, or any text where nothing could be
learned is `und` with score 0; a very long text is read whole, segment by segment, and may be drawn from at every place;
equal texts get equal predictions; repeated rows are rows of their own, but what they repeat is learned from once; of equally likely
languages the first in order is taken; an empty table gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a segment, and units of the network in each direction.
SEGMENT, UNITS = 48, 12
#: Training: steps, segments a step, rate, seed.
STEPS, BATCH, RATE, SEED = 150, 256, 0.02, 7
#: Segments, over all languages, that are drawn for training on average: the bound of the sample.
SAMPLE_SEGMENTS = STEPS * BATCH
#: Segments that are read together.
TOGETHER = 8192
#: Every fifth document by the CRC-32 of its id is held out.
FOLDS = 5

UNKNOWN = "und"


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


class Network:
    """Weights: by direction the input table (256 by 3 units), the recurrent matrix and its bias, and the outputs."""

    def __init__(self, labels: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        h, k = UNITS, len(labels)
        self.labels = labels
        self.weights = {}
        for d in "fb":
            self.weights[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.weights[f"u{d}"] = rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
            self.weights[f"c{d}"] = np.zeros(3 * h, np.float32)
            self.weights[f"v{d}"] = rng.normal(0, h**-0.5, (h, k)).astype(np.float32)
        self.weights["o"] = np.zeros(k, np.float32)

    def _run(self, d: str, data: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States (segment length, segments, units) in the order of the text; keep gets what backpropagation needs."""
        h = UNITS
        table, u, c = self.weights[f"x{d}"], self.weights[f"u{d}"], self.weights[f"c{d}"]
        table = table + np.r_[c[: 2 * h], np.zeros(h, np.float32)]  # one addition for all steps
        n_steps = data.shape[1]
        state = np.zeros((len(data), h), np.float32)
        states = np.empty((n_steps, len(data), h), np.float32)
        for t in range(n_steps) if d == "f" else range(n_steps - 1, -1, -1):
            given = table[data[:, t]]
            own = state @ u
            gates = given[:, : 2 * h]
            gates += own[:, : 2 * h]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            inner = own[:, 2 * h :] + c[2 * h :]
            new = given[:, 2 * h :]
            new += gates[:, :h] * inner
            clipped = np.clip(new, -1, 1)
            before = state
            state = clipped + gates[:, h:] * (before - clipped)
            if mask is not None:
                state *= mask[:, t : t + 1]
            states[t] = state
            if keep is not None:
                keep.append((t, before, gates, inner, new, clipped))
        return states

    def probabilities(self, data: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Sums over the positions of each segment of the languages' probabilities."""
        w = self.weights
        forward, backward = self._run("f", data, mask, None), self._run("b", data, mask, None)
        total = np.zeros((len(data), len(self.labels)))
        for t in range(data.shape[1]):
            p = forward[t] @ w["vf"] + backward[t] @ w["vb"] + w["o"]
            p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(1, keepdims=True)
            total += p if mask is None else p * mask[:, t : t + 1]
        return total

    def gradients(self, data: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss, the mean over all positions, and its gradients by backpropagation through time."""
        w, h = self.weights, UNITS
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._run(d, data, mask, kept[d]) for d in "fb"}
        logits = states["f"] @ w["vf"] + states["b"] @ w["vb"] + w["o"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        steps, rows = np.arange(data.shape[1])[:, None], np.arange(len(data))[None, :]
        weight = mask.T / mask.sum()
        loss = float(-(np.log(np.maximum(p[steps, rows, target[None, :]], 1e-9)) * weight).sum())
        p[steps, rows, target[None, :]] -= 1
        p *= weight[:, :, None]
        grads = {"o": p.sum((0, 1))}
        for d in "fb":
            grads[f"v{d}"] = np.einsum("tbh,tbk->hk", states[d], p)
            gx, gu, gc = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"u{d}"]), np.zeros_like(w[f"c{d}"])
            flow = np.zeros((len(data), h), np.float32)
            for t, before, gates, inner, new, clipped in reversed(kept[d]):
                flow = (flow + p[t] @ w[f"v{d}"].T) * mask[:, t : t + 1]
                reset, update = gates[:, :h], gates[:, h:]
                d_new = flow * (1 - update) * (np.abs(new) < 1)
                d_update = flow * (before - clipped) * 0.25 * ((update > 0) & (update < 1))
                d_reset = d_new * inner * 0.25 * ((reset > 0) & (reset < 1))
                d_own = np.concatenate([d_reset, d_update, d_new * reset], 1)
                d_given = np.concatenate([d_reset, d_update, d_new], 1)
                np.add.at(gx, data[:, t], d_given)
                gu += before.T @ d_own
                gc += d_own.sum(0)
                flow = flow * update + d_own @ w[f"u{d}"].T
            grads |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return loss, grads


def _filled(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, mask = np.zeros((len(segments), SEGMENT), np.uint8), np.zeros((len(segments), SEGMENT), np.float32)
    for i, s in enumerate(segments):
        data[i, : len(s)] = np.frombuffer(s, np.uint8)
        mask[i, : len(s)] = 1
    return data, mask


def train(segments: list[bytes], targets: list[str], seed: int = SEED, steps: int = STEPS) -> Network | None:
    """A network for the languages of the targets; None if there are none."""
    labels = sorted(set(targets))
    if not labels:
        return None
    net = Network(labels, seed)
    data, mask = _filled(segments)
    target = np.array([labels.index(t) for t in targets])
    rng = np.random.default_rng(seed)
    m = {c: np.zeros_like(x) for c, x in net.weights.items()}
    v = {c: np.zeros_like(x) for c, x in net.weights.items()}
    for step in range(1, steps + 1):
        at = rng.integers(0, len(data), BATCH)
        _, grads = net.gradients(data[at], mask[at], target[at])
        size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for c, g in grads.items():
            g = g * min(1.0, 1 / max(size, 1e-9))
            m[c] = 0.9 * m[c] + 0.1 * g
            v[c] = 0.999 * v[c] + 0.001 * g * g
            net.weights[c] = (net.weights[c] - rate * (m[c] / (1 - 0.9**step)) / (np.sqrt(v[c] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of each text over all its bytes."""
    sizes = np.array([len(t) for t in texts])
    whole, rest = sizes // SEGMENT, sizes % SEGMENT
    total = np.zeros((len(texts), len(net.labels)))
    owner = np.repeat(np.arange(len(texts)), whole)
    if len(owner):
        flat = np.frombuffer(b"".join([t[: n * SEGMENT] for t, n in zip(texts, whole.tolist())]), np.uint8).reshape(-1, SEGMENT)
        for k in range(0, len(flat), TOGETHER):
            np.add.at(total, owner[k : k + TOGETHER], net.probabilities(flat[k : k + TOGETHER]))
    tails = np.flatnonzero(rest)
    for k in range(0, len(tails), TOGETHER):
        at = tails[k : k + TOGETHER]
        data, mask = _filled([texts[i][whole[i] * SEGMENT :] for i in at.tolist()])
        total[at] += net.probabilities(data, mask)
    return total / np.maximum(sizes, 1)[:, None]


def predict(net: Network | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if net is None:
        return langs, scores
    lettered = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(lettered):
        group, size = [], 0
        while start + len(group) < len(lettered) and size < TOGETHER * SEGMENT:
            group.append(texts[int(lettered[start + len(group)])].as_py().encode())
            size += len(group[-1])
        pooled = _pooled(net, group)
        for k, best in enumerate(pooled.argmax(1).tolist()):
            i = int(lettered[start + k])
            langs[i], scores[i] = net.labels[best], min(1.0, float(pooled[k, best]))
        start += len(group)
    return langs, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0, F.lit(False))


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, cut = [], []
        for lang, text, places in zip(*(batch.column(c) for c in ("lang", "text", "places"))):
            raw, at = text.as_py().encode(), places.as_py()
            langs += [lang.as_py()] * len(at)
            cut += [raw[k * SEGMENT : (k + 1) * SEGMENT] for k in at]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cut, pa.binary())], names=["lang", "segment"])


def training_segments(docs: DataFrame) -> DataFrame:
    """lang and segment: about SAMPLE_SEGMENTS of all segments of docs that may be learned from, about as many of each language."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    held = usable.select("lang", "text", F.ceil(F.octet_length("text") / SEGMENT).alias("n"), F.xxhash64(F.lit("sample"), "doc_id", "text").alias("of_row"))
    counts = {r["lang"]: r["n"] for r in held.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return held.select("lang", F.lit(b"").alias("segment"))
    each = max(1, SAMPLE_SEGMENTS // len(counts))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    parts = 1 << 32
    bound = held.withColumn("bound", (share[F.col("lang")] * parts).cast("long"))
    places = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.pmod(F.xxhash64("of_row", k), F.lit(parts)) < F.col("bound"))
    drawn = bound.select("lang", "text", places.alias("places")).where(F.size("places") > 0)
    return drawn.mapInArrow(_cut_segments, "lang string, segment binary").distinct()


def learn(docs: DataFrame) -> Network | None:
    """Train on segments of docs (doc_id, text, lang)."""
    rows = sorted((r["lang"], bytes(r["segment"])) for r in training_segments(docs).collect())
    return train([s for _, s in rows], [lang for lang, _ in rows])


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(net, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
