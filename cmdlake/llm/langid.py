"""Operator 6: language identification with a byte convolutional network.

Bytes have small embeddings; filters of several widths run over a window of bytes,
their outputs are max-pooled over the window, and a softmax layer gives a language.
It is trained in numpy on windows of labelled texts. A text of any length is split
into windows of one size (its last window is padded, none is left out) and the windows'
log probabilities are averaged by the bytes they hold.

The training sample is bounded: about PER_LANG documents of each language (those whose
hash of id lies under a bound set by the language's count; never over twice as many in
all), WINDOWS windows of each. The languages are all those of the training
rows, the most frequent first. Prediction covers every text and
reads nothing but the text.

Defined cases: null, empty and letterless texts are "und" with score 0; null ids are
training rows by remainder 0; rows with null lang or text are not learned from; with no
training rows all is "und"; repeated rows are predicted alike; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import id_remainder

#: Fixed values of the contract.
FOLDS, HELD_OUT, NONE = 4, 2, "und"
#: Bytes of a window; sizes of the network; the bounds of the training sample.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 6, (2, 3, 4, 5), 8
PER_LANG, WINDOWS = 600, 3
_LETTER = regex.compile(r"\p{L}")


class ByteCnn:
    """Weights: e (256 x EMBED), w (widest * EMBED x filters; rows that a narrower filter
    does not reach stay 0), b, v (filters x languages), c."""

    def __init__(self, langs: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs, n = langs, FILTERS * len(WIDTHS)
        reach = np.repeat(WIDTHS, FILTERS)
        self.mask = (np.arange(max(WIDTHS))[:, None, None] < reach).repeat(EMBED, 1).reshape(-1, n).astype(np.float32)
        self.p = {
            "e": rng.normal(0, 0.5, (256, EMBED)), "w": rng.normal(0, 1, (max(WIDTHS) * EMBED, n)) / np.sqrt(reach * EMBED), "b": np.zeros(n),
            "v": rng.normal(0, 0.3, (n, len(langs))), "c": np.zeros(len(langs)),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.p["w"] *= self.mask

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """x: windows as bytes. The embedded bytes that each place's filters see, zeros past the end."""
        e = self.p["e"][x]
        pad = np.concatenate([e, np.zeros((len(x), max(WIDTHS) - 1, EMBED), np.float32)], 1)
        view = np.lib.stride_tricks.sliding_window_view(pad.reshape(len(x), -1), max(WIDTHS) * EMBED, 1)[:, ::EMBED]
        return np.ascontiguousarray(view)

    def pooled(self, x: np.ndarray):
        cols = self._columns(x)
        out = (cols.reshape(-1, cols.shape[-1]) @ self.p["w"]).reshape(len(x), x.shape[1], -1)
        at = out.argmax(1)
        return cols, at, np.maximum(np.take_along_axis(out, at[:, None], 1)[:, 0] + self.p["b"], 0)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        cols = self._columns(x)
        out = (cols.reshape(-1, cols.shape[-1]) @ self.p["w"]).reshape(len(x), x.shape[1], -1).max(1)
        z = np.maximum(out + self.p["b"], 0) @ self.p["v"] + self.p["c"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 0) -> None:
        """Adam on cross entropy."""
        rng, m, s, t = np.random.default_rng(seed), {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                bx, by = x[order[lo : lo + batch]], y[order[lo : lo + batch]]
                cols, at, h = self.pooled(bx)
                z = h @ self.p["v"] + self.p["c"]
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(len(by)), by] -= 1
                q /= len(by)
                dh = (q @ self.p["v"].T) * (h > 0)
                seen = cols[np.arange(len(bx))[:, None], at]  # windows x filters x columns
                dw = np.einsum("nfk,nf->kf", seen, dh) * self.mask
                dcol = dh[:, :, None] * self.p["w"].T[None]
                place = np.minimum(at[:, :, None] + np.arange(max(WIDTHS)), bx.shape[1] - 1)
                inside = at[:, :, None] + np.arange(max(WIDTHS)) < bx.shape[1]
                de = np.zeros_like(self.p["e"])
                np.add.at(de, bx[np.arange(len(bx))[:, None, None], place][inside], dcol.reshape(*place.shape, EMBED)[inside])
                t += 1
                for k, g in (("e", de), ("w", dw), ("b", dh.sum(0)), ("v", h.T @ q), ("c", q.sum(0))):
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def windows_of(data: bytes) -> np.ndarray:
    """All bytes of a text, as windows; the last is filled up by spaces."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b" "), np.uint8).reshape(n, WINDOW)


def train(docs: DataFrame, *, per_lang: int = PER_LANG, windows: int = WINDOWS, seed: int = 0) -> ByteCnn | None:
    """Fits the network to training rows of docs (doc_id, text, lang); None if there are none."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & (id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    held = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    langs = list(held)
    if not langs:
        return None
    # Of each document a few windows at places given by hashes, so that what is collected is bounded whatever the texts.
    h = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1)))
    cut = F.array(*(F.substring(F.col("text"), (h(i) + 1).cast("int"), F.lit(WINDOW)) for i in range(windows)))
    # Hashes of ids are spread evenly, so a bound by each language's count keeps about per_lang documents, with no window over a language.
    bound = F.create_map(*[x for k, n in held.items() for x in (F.lit(k), F.lit(min((1 << 63) - 1, (1 << 64) * per_lang // n - (1 << 63))))])
    some = rows.filter(F.col("lang").isin(*langs) & (F.xxhash64("doc_id", F.lit(seed)) <= bound[F.col("lang")]))
    got = some.select("lang", F.xxhash64("doc_id", F.lit(seed)).alias("h"), cut.alias("cut")).orderBy("h", "lang", "cut").limit(2 * per_lang * len(langs)).collect()  # the bound holds even where ids repeat
    got.sort(key=lambda r: (r["lang"], r["h"], r["cut"]))
    number = {lang: i for i, lang in enumerate(langs)}
    x = [(windows_of(t.encode("utf-8", "replace")[:WINDOW])[0], number[r["lang"]]) for r in got for t in r["cut"] if t]
    model = ByteCnn(langs, seed)
    model.fit(np.stack([a for a, _ in x]), np.array([b for _, b in x]), seed=seed)
    return model


def _predictor(model: ByteCnn | None):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out, score = b["text"].tolist(), np.full(len(b), NONE, object), np.zeros(len(b))
            held = [i for i, t in enumerate(texts) if isinstance(t, str) and _LETTER.search(t)] if model else []
            sums = np.zeros((len(b), len(model.langs) if model else 1))
            total = np.zeros(len(b))
            block, owner, weight, size = [], [], [], 0

            def flush() -> None:
                nonlocal block, owner, weight, size
                if block:
                    who, w = np.concatenate(owner), np.concatenate(weight)
                    np.add.at(sums, who, model.log_probs(np.concatenate(block)) * w[:, None])
                    np.add.at(total, who, w)
                block, owner, weight, size = [], [], [], 0

            for i in held:
                data = texts[i].encode("utf-8", "replace")
                every = windows_of(data)
                filled = np.full(len(every), WINDOW)
                filled[-1] = len(data) - WINDOW * (len(every) - 1)
                for lo in range(0, len(every), 128):
                    block.append(every[lo : lo + 128])
                    owner.append(np.full(len(block[-1]), i))
                    weight.append(filled[lo : lo + 128])
                    size += len(block[-1])
                    if size >= 128:
                        flush()
            flush()
            if held:
                mean = sums[held] / total[held][:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                out[held], score[held] = np.array(model.langs, object)[p.argmax(1)], p.max(1)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": out, "score": score})

    return predict


def identify(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    kind = "doc_id long, held_out boolean, lang_pred string, score double"
    return rows.withColumn("doc_id", F.col("doc_id")).mapInPandas(_nullable(_predictor(model)), kind)


def _nullable(predict):
    """Ids stay integers where some are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (x.astype({"doc_id": "Int64"}) for x in predict(b.assign(doc_id=b["doc_id"].astype("Int64")) for b in batches))

    return run


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
