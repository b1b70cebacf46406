"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, gives every byte position a
distribution over the languages and pools a document's positions into one.  It
is trained here, in numpy, by backpropagation through time, on a bounded sample
of labelled rows.  Texts are read whole, as consecutive segments that run
through the network side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmill.llm.common import text_of

SPACE = 0x20


@dataclass(frozen=True)
class LangParams:
    """per_language bounds the training sample: so many documents of each language at most, and of each a stretch of
    ``segment`` characters, which make up to four segments of as many bytes."""

    hidden: int = 8
    segment: int = 64
    per_language: int = 500
    batch: int = 64
    epochs: int = 12
    rate: float = 0.01
    seed: int = 7


class BiGRU:
    """Both directions are computed together: arrays start with an axis of length 2.

    Gates are in the order update, reset, candidate; the halved gate inputs make the logistic function a tanh.
    """

    def __init__(self, langs: list[str], hidden: int, seed: int):
        r = np.random.default_rng(seed)
        f = np.float32
        self.langs, self.hidden = langs, hidden
        self.w = {
            "x": r.normal(0, 0.3, (2, 256, 3 * hidden)).astype(f),
            "h": r.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(f),
            "b": np.zeros((2, 1, 3 * hidden), f),
            "o": r.normal(0, 0.3, (2 * hidden, len(langs))).astype(f),
            "c": np.zeros(len(langs), f),
        }

    def _states(self, segments: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(positions, 2, segments, hidden) in reading order of each direction."""
        n, t = segments.shape
        k, w = self.hidden, self.w
        ways = np.stack([segments, segments[:, ::-1]])
        table = w["x"] + w["b"]
        out = np.empty((t, 2, n, k), np.float32)
        h = np.zeros((2, n, k), np.float32)
        for i in range(t):
            x = np.stack([table[0].take(ways[0, :, i], 0), table[1].take(ways[1, :, i], 0)])
            u = h @ w["h"]
            g = np.tanh(0.5 * (x[..., : 2 * k] + u[..., : 2 * k])) * 0.5 + 0.5
            z, r = g[..., :k], g[..., k:]
            c = np.tanh(x[..., 2 * k :] + r * u[..., 2 * k :])
            if keep is not None:
                keep.append((h, z, r, c, u[..., 2 * k :], ways[:, :, i]))
            h = c + z * (h - c)
            out[i] = h
        return out

    def probabilities(self, segments: np.ndarray) -> np.ndarray:
        """(segments, positions, languages)."""
        s = self._states(segments)
        both = np.concatenate([s[:, 0], s[::-1, 1]], -1)
        logits = both @ self.w["o"] + self.w["c"]
        np.exp(logits - logits.max(-1, keepdims=True), out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits.transpose(1, 0, 2)

    def gradients(self, segments: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
        keep: list = []
        s = self._states(segments, keep)
        t, _, n, k = s.shape
        both = np.concatenate([s[:, 0], s[::-1, 1]], -1)
        logits = both @ self.w["o"] + self.w["c"]
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        loss = float(-np.log(p[:, np.arange(n), labels] + 1e-12).mean())
        p[:, np.arange(n), labels] -= 1
        p /= t * n
        grad = {name: np.zeros_like(a) for name, a in self.w.items()}
        grad["o"] = np.einsum("tnk,tnl->kl", both, p)
        grad["c"] = p.sum((0, 1))
        back = p @ self.w["o"].T
        into = np.stack([back[..., :k], back[::-1, :, k:]], 1)
        dh = np.zeros((2, n, k), np.float32)
        wt = self.w["h"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            h, z, r, c, uc, byte = keep[i]
            dh = dh + into[i]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], -1)
            du = np.concatenate([dz, dr, dc * r], -1)
            for d in (0, 1):
                np.add.at(grad["x"][d], byte[d], dx[d])
            grad["b"] += dx.sum(1, keepdims=True)
            grad["h"] += h.transpose(0, 2, 1) @ du
            dh = dh * z + du @ wt
        return loss, grad

    def fit(self, segments: np.ndarray, labels: np.ndarray, params: LangParams) -> list[float]:
        """Adam; returns the mean loss of each epoch."""
        r, losses = np.random.default_rng(params.seed), []
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for epoch in range(params.epochs):
            order, seen = r.permutation(len(segments)), []
            rate = params.rate * (1 - epoch / params.epochs)
            for at in range(0, len(order), params.batch):
                some = order[at : at + params.batch]
                loss, grad = self.gradients(segments[some], labels[some])
                seen.append(loss)
                step += 1
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def documents(self, raws: list[bytes], segment: int, labels: bool = False, at_once: int = 2048) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """(pooled distribution, label of each byte) of each non-empty byte string, whatever its length."""
        sums = np.zeros((len(raws), len(self.langs)))
        marks: list[np.ndarray] = []
        pending: list[tuple[int, int]] = [(i, at) for i, x in enumerate(raws) for at in range(0, len(x), segment)]
        for first in range(0, len(pending), at_once):
            some = pending[first : first + at_once]
            block = np.full((len(some), segment), SPACE, np.uint8)
            sizes = np.empty(len(some), np.int64)
            for k, (i, at) in enumerate(some):
                part = np.frombuffer(raws[i], np.uint8, min(segment, len(raws[i]) - at), at)
                block[k, : len(part)] = part
                sizes[k] = len(part)
            p = self.probabilities(block)
            for k in np.flatnonzero(sizes < segment):
                p[k, sizes[k] :] = 0
            np.add.at(sums, [i for i, _ in some], p.sum(1))
            if labels:  # segments follow each other as the bytes do
                marks.append(p.argmax(-1).astype(np.int16)[np.arange(segment) < sizes[:, None]])
        own = np.split(np.concatenate(marks), np.cumsum([len(x) for x in raws])[:-1]) if marks else [None] * len(raws)
        return [(s / len(x), m) for s, x, m in zip(sums, raws, own, strict=True)]


def _held_out(id_col: str):
    """crc32 of the id as text, mod 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train_langid(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", params: LangParams = LangParams()) -> BiGRU | None:
    """Learns from rows that are not held out and have a language and a letter.  None if there are none.

    The sample is drawn by a hash of id and text at a rate per language, and of what is drawn the params.per_language least
    hashes of each language come to the driver, so that rows that share their hash are no more; the least of a language
    always comes.  Each text gives a stretch that starts anywhere in it.
    """
    t = params.segment
    rows = df.where(~_held_out(id_col) & F.col(lang_col).isNotNull() & text_of(df, text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), text_of(df, text_col)).alias("h"), text_of(df, text_col).alias("text")
    )
    begin = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - t, F.lit(1))).cast("int")
    rows = rows.select("lang", "h", F.substring("text", begin + 1, F.lit(t)).alias("text"))
    firsts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "text")).alias("least")).collect()
    counts = {r["lang"]: r["n"] for r in firsts}
    if not counts:
        return None
    draw = F.pmod(F.col("h"), F.lit(1 << 20)) / float(1 << 20)
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * params.per_language / n))])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    drawn = rows.where(draw <= F.element_at(rate, F.col("lang"))).withColumn("_rank", rank).where(F.col("_rank") <= params.per_language)
    sample = [(r["lang"], r["h"], r["text"]) for r in drawn.collect()]
    met = {x[0] for x in sample}
    sample += [(r["lang"], *r["least"]) for r in firsts if r["lang"] not in met]
    langs = sorted(counts)
    segments, labels = [], []
    for lang, _, text in sorted(sample):
        raw = text.encode("utf-8", "replace")
        for at in range(0, len(raw), t):
            segments.append(np.frombuffer(raw[at : at + t].ljust(t, b" "), np.uint8))
            labels.append(langs.index(lang))
    model = BiGRU(langs, params.hidden, params.seed)
    model.fit(np.stack(segments), np.array(labels), params)
    return model


def predict_lang(
    df: DataFrame, model: BiGRU | None, id_col: str = "doc_id", text_col: str = "text", params: LangParams = LangParams(), runs: bool = False
) -> DataFrame:
    """One row per input row: id_col, held_out, lang_pred, score; with runs, also array<struct<start, end, lang>>: the maximal
    runs of equally labelled UTF-8 byte positions.

    Texts that are null or have no letter are ``und`` with score 0, and so is everything without a model.  Only the text
    decides; ids may be null or repeat; an empty table gives an empty result.  A text of any length is read whole, 2048
    segments at a time.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double" + ", runs array<struct<start: int, end: int, lang: string>>" * runs

    def predict(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(2).to_pylist()
                lettered = {t for t in texts if model is not None and any(map(str.isalpha, t))}
                order = sorted(lettered)
                got = dict(zip(order, model.documents([t.encode("utf-8", "replace") for t in order], params.segment, runs), strict=True)) if order else {}
                names, scores, spans = [], [], []
                for t in texts:
                    p, marks = got.get(t, (None, None))
                    names.append("und" if p is None else model.langs[int(p.argmax())])
                    scores.append(0.0 if p is None else min(1.0, float(p.max())))
                    if runs:
                        first = np.zeros(0, np.int64) if marks is None else np.concatenate([[0], np.flatnonzero(marks[1:] != marks[:-1]) + 1])
                        spans.append((first, np.append(first[1:], len(marks)), marks[first]) if marks is not None else (first, first, first))
                out = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                if runs:
                    start, end, mark = (np.concatenate(x).astype(np.int32) for x in zip(*spans, strict=True))
                    named = pa.array(model.langs if model else [], pa.string()).take(pa.array(mark))
                    flat = pa.StructArray.from_arrays([pa.array(start), pa.array(end), named], ["start", "end", "lang"])
                    out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x[0]) for x in spans]), pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(out, [id_col, "held_out", "lang_pred", "score", *["runs"] * runs])

    return df.select(F.col(id_col), _held_out(id_col).alias("_held"), text_of(df, text_col).alias("_text")).mapInArrow(predict, schema)
