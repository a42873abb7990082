"""Operator 1: scores of whole documents by a gated recurrent language model (GRU).

Counts: every token of every training document is counted (per task, then by word).
The most frequent words, at most HEAD of them, are sent to the workers with their
counts; all other words' counts are joined by word, and such words are rare by
construction, so no key of that join is hot.

Model: the LM vocabulary is the end token, VOCABULARY - 2 most frequent words, and one
token for all other words, whose spelling then has the probability
(c + 1) / (their counts + their number + 1), an unseen word that of c = 0. The output
softmax is factored: a class given the state, a word given state and class. It starts
from the counts (unigrams) and learns by truncated backpropagation in numpy: documents
are dealt by hashes into groups of about PART tokens, and a task trains on every token of
a group's documents, WINDOW tokens at a time with the state carried on from window to
window, BATCH lanes of whole documents side by side. The groups' parameters are averaged
as a tree, weighted by tokens. Groups depend on the rows alone, so scores do not depend on
how the table is partitioned.

Scoring: documents of similar length go through the network together, window by window,
with the state carried from one window into the next, so that a document of any length
is scored whole.

Defined cases: null text is the empty text: its end token alone; a null id counts as
the empty text for the fold; with no training documents all counts are 0 and the
model is its start; repeated rows are scored alike; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import id_remainder, written

#: Fixed values of the contract.
FOLDS, HELD_OUT = 7, 2
#: The end of a text; no word is white space.
END = b"\n"
#: Words with counts on every worker (a bound on what is broadcast); the LM's vocabulary and classes; sizes of the network.
HEAD, VOCABULARY, CLASSES, STATE, EMBED = 1 << 18, 2048, 32, 32, 24
#: Tokens of a window, lanes, learning rate, tokens of a group (one model is learned of each).
WINDOW, BATCH, RATE, PART = 16, 512, 1.6e-2, 6_000_000
#: Steps that a group has at least, if need be by fewer lanes.
STEPS = 400
#: Documents scored together.
TOGETHER = 8192
#: Tokens of a window in scoring.
LONG_WINDOW = 16
OTHER, STOP = 0, 1


def _tokens(text) -> list[bytes]:
    """Words of a text, A-Z in lower case; both steps touch ASCII alone."""
    return text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0, as it should be
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class _Numbers(dict):
    """Numbers of words; one for all that are not there."""

    def __init__(self, words: list[bytes], first: int, other: int):
        super().__init__(zip(words, range(first, first + len(words))))
        self.other = other

    def __missing__(self, word):
        return self.other

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Gru:
    SHAPES = {
        "e": (VOCABULARY, EMBED), "wx": (EMBED, 3 * STATE), "wh": (STATE, 3 * STATE), "b": (3 * STATE,),
        "c": (CLASSES, STATE), "cb": (CLASSES,), "w": (VOCABULARY, STATE), "wb": (VOCABULARY,),
    }
    SIZE = VOCABULARY // CLASSES

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 0) -> Gru:
        """Outputs as the (smoothed) counts of the LM's vocabulary, whatever the state."""
        rng = np.random.default_rng(seed)
        p = {k: rng.normal(0, 0.25 if k in ("wx", "wh") else 0.1, s) for k, s in cls.SHAPES.items()}
        p["b"][:], p["c"][:], p["w"][:] = 0, p["c"] * 0.1, p["w"] * 0.1
        q = (counts + 0.5).reshape(CLASSES, cls.SIZE)
        p["cb"][:] = np.log(q.sum(1) / q.sum())
        p["wb"][:] = np.log(q / q.sum(1, keepdims=True)).ravel()
        return cls({k: x.astype(np.float32) for k, x in p.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    @classmethod
    def of_flat(cls, x: np.ndarray) -> Gru:
        edges = np.cumsum([0, *(int(np.prod(s)) for s in cls.SHAPES.values())])
        return cls({k: x[a:b].reshape(s).astype(np.float32) for (k, s), a, b in zip(cls.SHAPES.items(), edges, edges[1:])})

    def inputs(self) -> np.ndarray:
        """What each token adds to the gates."""
        return self.p["e"] @ self.p["wx"] + self.p["b"]

    def step(self, gx: np.ndarray, h: np.ndarray):
        """Gates update, reset; candidate; its recurrent part; the next state."""
        gh = h @ self.p["wh"]
        zr = _sigmoid(gx[:, : 2 * STATE] + gh[:, : 2 * STATE])
        z, r, rec = zr[:, :STATE], zr[:, STATE:], gh[:, 2 * STATE :]
        n = r * rec
        n += gx[:, 2 * STATE :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return z, r, n, rec, new

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of token y[i] in state h[i]."""
        order = np.argsort(y.astype(np.int16), kind="stable")  # by word, so that each class is a slice
        ys, hs = y[order], h[order]
        group = ys // self.SIZE
        logits = hs @ self.p["c"].T
        logits += self.p["cb"]
        sorted_out = logits[np.arange(len(ys)), group]
        np.exp(logits, out=logits)
        sorted_out -= np.log(logits @ np.ones(CLASSES, logits.dtype))
        edges, ones = np.searchsorted(group, np.arange(CLASSES + 1)), np.ones(self.SIZE, logits.dtype)
        for k in range(CLASSES):
            lo, hi = edges[k], edges[k + 1]
            if lo < hi:
                part = slice(k * self.SIZE, (k + 1) * self.SIZE)
                logits = hs[lo:hi] @ self.p["w"][part].T
                logits += self.p["wb"][part]
                right = logits[np.arange(hi - lo), ys[lo:hi] - k * self.SIZE]
                np.exp(logits, out=logits)
                sorted_out[lo:hi] += right - np.log(logits @ ones)
        out = np.empty_like(sorted_out)
        out[order] = sorted_out
        return out

    def score(self, ids: list[np.ndarray]) -> np.ndarray:
        """Natural log likelihood of each document; ids end with STOP."""
        out = np.zeros(len(ids))
        lengths = np.array([len(x) for x in ids])
        order, gates = np.argsort(-lengths, kind="stable"), self.inputs()
        for lo in range(0, len(ids), TOGETHER):
            some = order[lo : lo + TOGETHER]
            size, h = lengths[some], np.zeros((len(some), STATE), np.float32)
            last = np.full(len(some), STOP)
            for at in range(0, int(size[0]), LONG_WINDOW):
                n = int(np.searchsorted(-size, -at, "left"))  # of those sorted by length, the ones longer than at
                width = min(LONG_WINDOW, int(size[0]) - at)
                y = np.full((n, width), STOP)
                for i in range(n):
                    x = ids[some[i]][at : at + width]
                    y[i, : len(x)] = x
                x = np.concatenate([last[:n, None], y[:, :-1]], 1)
                h, states = h[:n], np.empty((n, width, STATE), np.float32)
                for t in range(width):
                    h = states[:, t] = self.step(gates[x[:, t]], h)[-1]
                last = y[:, -1]
                valid = np.arange(width) < (size[:n, None] - at)
                logs = self.log_probs(states[valid], y[valid])
                out[some[:n]] += np.bincount(np.nonzero(valid)[0], logs, n)
        return out

    def train(self, texts: list[np.ndarray], rate: float = RATE, wide: int = BATCH) -> int:
        """Adam over all windows of all texts, each of its tokens and STOP: up to `wide` lanes side by side (of few tokens
        fewer, for STEPS steps), each a row of whole texts with the state carried from window to window and begun anew
        with each text. Gives the number of tokens learned."""
        wide = min(wide, max(1, sum(map(len, texts)) // (WINDOW * STEPS)))
        flat, lanes = lay_out(texts, wide)
        m, s = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        h, steps, every = np.zeros((len(lanes), STATE), np.float32), 0, 0
        last = np.full(len(lanes), STOP)
        for at in range(0, int(lanes[0, 1]) if len(lanes) else 0, WINDOW):
            n = int(np.searchsorted(-lanes[:, 1], -at, "left"))  # the lanes that are longer than at
            place = at + np.arange(WINDOW)[:, None]
            valid = place < lanes[:n, 1]
            y = flat[np.where(valid, lanes[:n, 0] + place, 0)]
            x = np.concatenate([last[None, :n], y[:-1]])
            g, h = self._gradients(x, y, valid, h[:n])
            last, every, steps = y[-1], every + int(valid.sum()), steps + 1
            # Where few lanes are left, the last long ones, steps are smaller by the root of their share.
            now = rate / (1 + steps / 400) * math.sqrt(n / wide)
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                s[k] += 0.002 * (d * d - s[k])
                self.p[k] -= now * (m[k] / (1 - 0.9**steps)) / (np.sqrt(s[k] / (1 - 0.998**steps)) + 1e-6)
        return every

    def _gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, h: np.ndarray):
        """x, y, valid: places by lanes. The gradients of the mean loss, clipped; the state after the window."""
        p, kept, (width, lanes) = self.p, [], x.shape
        gates = self.inputs()[x]
        states = np.empty((width, lanes, STATE), np.float32)
        begins = x == STOP
        for t in range(width):
            h = np.where(begins[t][:, None], np.float32(0), h)
            z, r, n, rec, new = self.step(gates[t], h)
            kept.append((h, z, r, n, rec))
            h = states[t] = new
        g = {k: np.zeros_like(a) for k, a in p.items()}
        at = np.flatnonzero(valid.ravel())
        at = at[np.argsort(y.ravel()[at], kind="stable")]  # by word, so that each class is a slice
        ys, hs = y.ravel()[at], states.reshape(-1, STATE)[at]
        scale, group = np.float32(1 / len(ys)), ys // self.SIZE
        q = hs @ p["c"].T
        q += p["cb"]
        np.exp(q, out=q)
        q *= (scale / (q @ np.ones(CLASSES, q.dtype)))[:, None]
        q[np.arange(len(ys)), group] -= scale
        g["c"], g["cb"], dhs = q.T @ hs, q.sum(0), q @ p["c"]
        edges = np.searchsorted(group, np.arange(CLASSES + 1))
        for k in range(CLASSES):
            lo, hi = edges[k], edges[k + 1]
            if lo < hi:
                part, own = slice(k * self.SIZE, (k + 1) * self.SIZE), hs[lo:hi]
                q = own @ p["w"][part].T
                q += p["wb"][part]
                np.exp(q, out=q)
                q *= (scale / (q @ np.ones(self.SIZE, q.dtype)))[:, None]
                q[np.arange(hi - lo), ys[lo:hi] - k * self.SIZE] -= scale
                g["w"][part], g["wb"][part] = q.T @ own, q.sum(0)
                dhs[lo:hi] += q @ p["w"][part]
        dstates = np.zeros((width * lanes, STATE), np.float32)
        dstates[at] = dhs
        dstates = dstates.reshape(states.shape)
        din, drecs, dh = np.empty((width, lanes, 3 * STATE), np.float32), np.empty((width, lanes, 3 * STATE), np.float32), np.zeros((lanes, STATE), np.float32)
        wh = np.ascontiguousarray(p["wh"].T)
        for t in range(width - 1, -1, -1):
            before, z, r, n, rec = kept[t]
            dh += dstates[t]
            i, d = din[t], drecs[t]
            dz, dr, dn, away = i[:, :STATE], i[:, STATE : 2 * STATE], i[:, 2 * STATE :], 1 - z
            np.multiply(dh, away, out=dn)
            dn *= 1 - n * n
            np.multiply(before - n, dh, out=dz)
            away *= z
            dz *= away
            np.multiply(dn, rec, out=dr)
            dr *= r * (1 - r)
            d[:, : 2 * STATE] = i[:, : 2 * STATE]
            np.multiply(dn, r, out=d[:, 2 * STATE :])
            dh *= z
            dh += d @ wh
            dh[begins[t]] = 0
        g["wh"] = np.concatenate([k[0] for k in kept]).T @ drecs.reshape(-1, 3 * STATE)
        words, flat = x.ravel(), din.reshape(-1, 3 * STATE)
        seen = flat @ p["wx"].T
        for i in range(EMBED):
            g["e"][:, i] = np.bincount(words, seen[:, i], VOCABULARY)
        g["wx"], g["b"] = p["e"][words].T @ flat, flat.sum(0)
        norm = math.sqrt(sum(float((d * d).sum()) for d in g.values()))
        if norm > 1:
            g = {k: d / np.float32(norm) for k, d in g.items()}
        return g, h


def lay_out(texts: list[np.ndarray], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after another, lane by lane, and per lane its first place and its length, longest lane first.
    Texts go whole to the lane that is shortest so far, the longest texts first."""
    lanes: list = [[0, i, []] for i in range(min(wide, len(texts)))]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        lane = lanes[0]
        lane[2].append(i)
        heapq.heapreplace(lanes, [lane[0] + len(texts[i]), lane[1], lane[2]])
    lanes.sort(key=lambda x: (-x[0], x[1]))
    order = [i for x in lanes for i in x[2]]
    lengths = np.array([x[0] for x in lanes], np.int64)
    flat = np.concatenate([texts[i] for i in order]) if order else np.zeros(0, np.int16)
    return flat, np.stack([np.cumsum(lengths) - lengths, lengths], 1)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for b in batches:
        for text in b["text"]:
            counts.update(_tokens(text))
        counts[END] += len(b)
        if len(counts) > 200_000:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
            counts = Counter()
    if counts:
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), n over all texts of docs, each text's end among them."""
    return docs.select("text").mapInPandas(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """The most frequent words, at most so many: all at or above a count that a histogram gives."""
    words = counts.filter(F.col("word") != F.lit(END))
    level = F.floor(F.log2("n") * 16)
    bound, total = None, 0
    for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():  # at most 1024 rows
        total += r["k"]
        if total > most:
            break
        bound = r["least"]
    if bound is None:
        return []
    got = [(bytes(r["word"]), r["n"]) for r in words.filter(F.col("n") >= bound).collect()]  # at most `most`
    return sorted(got, key=lambda x: (-x[1], x[0]))


_HEADS: dict = {}


def _head(shared):
    """Of a broadcast head: numbers of its words, their counts, and tokens of the LM by word; made once a worker."""
    words, n = shared.value
    if _HEADS.get("of") is not words:
        each = words.split(b"\n") if words else []
        _HEADS.update(of=words, head=(_Numbers(each, 0, -1), n, _Numbers(each[: VOCABULARY - 2], 2, OTHER)))
    return _HEADS["head"]


def _lm_ids(numbers: np.ndarray) -> np.ndarray:
    """Numbers in the head (-1: not there) as tokens of the LM."""
    return np.where((numbers >= 0) & (numbers < VOCABULARY - 2), numbers + 2, OTHER)


def _trainer(shared, flat: np.ndarray):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        _, _, tokens = _head(shared)
        texts = [np.append(tokens.of(_tokens(x)), STOP).astype(np.int16) for x in group.sort_values(["doc_id", "text"], na_position="first")["text"]]
        model = Gru.of_flat(flat)
        seen = model.train(texts)
        return pd.DataFrame({"weight": [float(seen)], "params": [(model.flat().astype(np.float64) * seen).tobytes()]})

    return run


def _sum_models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    weight, total = 0.0, None
    for b in batches:
        for w, p in zip(b["weight"], b["params"]):
            x = np.frombuffer(p, np.float64)
            weight, total = weight + w, x if total is None else total + x
    if total is not None:
        yield pd.DataFrame({"weight": [weight], "params": [total.tobytes()]})


def train(docs: DataFrame, shared, start: Gru, tokens: int, part: int = PART) -> Gru:
    """The average of what each group of documents teaches. Groups are chosen by hashes of the rows, about `part` tokens
    in each, so that the model depends on the documents alone, not on how the table is cut."""
    groups = max(1, -(-tokens // part))
    kind = "weight double, params binary"
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("group"))
    got = rows.groupBy("group").applyInPandas(_trainer(shared, start.flat()), kind)
    while groups > 16:
        groups = math.isqrt(groups)
        got = got.repartition(groups).mapInPandas(_sum_models, kind)
    rows = got.collect()  # at most 16 rows, each as large as the model
    weight = sum(r["weight"] for r in rows)
    return Gru.of_flat(sum(np.frombuffer(r["params"], np.float64) for r in rows) / weight) if weight else start


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, gru double, others long, other_logs double, tail array<binary>, tail_n array<int>"


def _scorer(shared, flat: np.ndarray, end_count: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, counts, _ = _head(shared)
        logs, model = np.log10(np.append(counts, 0).astype(np.float64) + 1), Gru.of_flat(flat)  # the last is for -1
        row = TaskContext.get().partitionId() << 33
        for b in (x.iloc[lo : lo + TOGETHER] for x in batches for lo in range(0, len(x), TOGETHER)):
            ids, rest = [], []
            for text in b["text"]:
                words = _tokens(text)
                numbers = index.of(words)
                tail = Counter(words[i] for i in np.flatnonzero(numbers < 0)) if len(numbers) else Counter()
                lm, inside = _lm_ids(numbers), numbers >= 0
                ids.append(np.append(lm, STOP))
                other = lm == OTHER
                rest.append((len(words) + 1, int(inside.sum()) + (end_count > 0), logs[numbers[inside]].sum() + math.log10(end_count + 1), int(other.sum()), logs[numbers[other & inside]].sum(), list(tail), list(tail.values())))
            gru = model.score(ids) / math.log(10)
            out = pd.DataFrame(rest, columns=["n_tokens", "known", "logs", "others", "other_logs", "tail", "tail_n"])
            yield out.assign(row=row + np.arange(len(b)), doc_id=b["doc_id"].astype("Int64").to_numpy(), held_out=b["held_out"].to_numpy(), gru=gru)[[x.split()[0] for x in SCORED.split(", ")]].astype({"doc_id": "Int64"})
            row += len(b)

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    learn = docs.filter(~F.col("held_out"))
    counts = written(count_words(learn), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    end = counts.filter(F.col("word") == F.lit(END)).first()
    end = end["n"] if end else 0
    head = head_words(counts)
    number = np.array([c for _, c in head], np.int64)
    shared = spark.sparkContext.broadcast((b"\n".join(w for w, _ in head), number))
    inside = number[: VOCABULARY - 2]
    others, kinds = n - end - int(inside.sum()), v - (end > 0) - len(inside)
    start = np.zeros(VOCABULARY)
    start[OTHER], start[STOP], start[2 : 2 + len(inside)] = others, end, inside
    model = train(learn, shared, Gru.start(start), n or 0)
    scored = written(docs.mapInPandas(_scorer(shared, model.flat(), end), SCORED), "lm-scored")
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.tail_n").alias("times"))
    # A word that is not in the head is rare, so its key is no hot one.
    found = tail.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("tail_logs"))
    rows = scored.drop("tail", "tail_n").join(found, "row", "left")
    more, tail_logs = F.coalesce("more", F.lit(0)), F.coalesce("tail_logs", F.lit(0.0))
    spelled, every = math.log10(others + kinds + 1), math.log10(n + v + 1)
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + tail_logs - F.col("n_tokens") * every).alias("base_score"), (F.col("gru") + F.col("other_logs") + tail_logs - F.col("others") * spelled).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
