"""Online gates over a stream: score with what is known, decide, then learn.

One state for each gate: counts of its n-grams and the last scores that were not
anomalous. Each batch of a gate's sequences is taken in their order of arrival."""

from __future__ import annotations

import json
import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.anomaly import ALPHA, DISCOUNT


class OnlineModel:
    """The n-gram model of operators.anomaly as a fold over sequences."""

    def __init__(self, state: str | None = None, window: int = 100, k: float = 3.0):
        held = json.loads(state) if state else {"counts": {}, "last": []}
        self.counts, self.last, self.window, self.k = Counter(held["counts"]), held["last"], window, k
        self.contexts: dict[str, list[int]] = {}
        for key, n in self.counts.items():
            self._add(key, n)

    def _add(self, key: str, n: int) -> None:
        context = self.contexts.setdefault(key.rpartition("\x1f")[0] if "\x1f" in key else "", [0, 0])
        context[0] += n
        context[1] += 1

    def dump(self) -> str:
        return json.dumps({"counts": self.counts, "last": self.last})

    def score(self, words: list[str]) -> float:
        total, kinds = self.contexts.get("", (0, 0))
        if len(words) < 3 or "" in words or not total:
            return math.inf

        def p(gram: list[str]) -> float:
            if len(gram) == 1:
                c = self.counts.get(gram[0], 0)
                return (c + ALPHA) / (total + ALPHA * kinds) if c else (kinds + ALPHA) / (total + kinds + ALPHA * (kinds + 1))
            c, lower = self.counts.get("\x1f".join(gram), 0), p(gram[1:])
            if not c:
                return lower
            n, u = self.contexts["\x1f".join(gram[:-1])]
            return max(c - DISCOUNT, 0) / n + DISCOUNT * u / n * lower

        grams = [words] if len(words) == 3 else [words[i - 3 : i + 1] for i in range(3, len(words))]
        return sum(-math.log2(p(g)) for g in grams) / len(grams)

    def threshold(self, fixed: float) -> float:
        if len(self.last) < self.window:
            return fixed
        mean = sum(self.last) / len(self.last)
        return mean + self.k * math.sqrt(sum((x - mean) ** 2 for x in self.last) / len(self.last))

    def learn(self, words: list[str], score: float) -> None:
        if any(not w or len(w.encode()) > 1023 for w in words):
            return
        for k in range(1, 5):
            for i in range(len(words) - k + 1):
                key = "\x1f".join(words[i : i + k])
                self.counts[key] += 1
                context = self.contexts.setdefault(key.rpartition("\x1f")[0] if k > 1 else "", [0, 0])
                context[0] += 1
                context[1] += self.counts[key] == 1
        if math.isfinite(score):
            self.last = [*self.last, score][-self.window :]


OUT = "gate string, at long, score double, anomalous boolean"


def online_scores(sequences: DataFrame, fixed: float = 20.0, window: int = 100, k: float = 3.0) -> DataFrame:
    """Streaming rows (gate, at, words) to (gate, at, score, anomalous); an infinite score is null and no anomaly."""

    def run(key, batches, state):
        model = OnlineModel(state.get[0] if state.exists else None, window, k)
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at, words in zip(rows["at"], rows["words"]):
            score = model.score(list(words))
            odd = math.isfinite(score) and score > model.threshold(fixed)
            if not odd:
                model.learn(list(words), score)
            out.append((key[0], at, score if math.isfinite(score) else None, odd))
        state.update((model.dump(),))
        yield pd.DataFrame(out, columns=["gate", "at", "score", "anomalous"])

    return sequences.groupBy("gate").applyInPandasWithState(run, OUT, "model string", "append", "NoTimeout")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Streaming events (gate, ts, w) to sequences by session windows, an addition of this library."""
    grouped = events.withWatermark("ts", late).groupBy("gate", F.session_window("ts", gap))
    words = F.transform(F.array_sort(F.collect_list(F.struct("ts", "w"))), lambda x: x.w)
    return grouped.agg(words.alias("words")).select("gate", F.unix_micros("session_window.end").alias("at"), "words")
