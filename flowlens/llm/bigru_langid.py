"""Language identification by a bidirectional gated recurrent network over
bytes (operator 10).

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes. A small GRU runs
over each window from the left and another from the right; at every byte both
states together give a probability for each language (every position is
labelled). A document's probabilities are the mean over all its positions, the
prediction is the largest. Whole texts are read, each byte once per direction.

Training is done in numpy by backpropagation through time (Adam, cross entropy
at every position) on windows of a bounded sample of labelled rows:
``train_docs`` documents with a non-null language that are not held out, spread
over the languages and picked by a hash of id and length, so reruns agree.
Languages are the values seen in that sample.

Inference runs in Arrow batches: the windows of a batch are the lanes of one
matrix, laid out states x lanes, and each step is a few vectorised operations
on it. Memory is bounded by ``LANES`` lanes, not by the length of a text. The
network (a few kB) is all that is broadcast.

Defined cases: null text, and text without any letter, gives ``und`` with
score 0; without any labelled row every document is ``und`` with score 0; one
single language gets score 1; extra columns pass through, results live in
columns the caller selects; equal probabilities go to the smaller name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import text_slices, unique_name

WINDOW = 64
LANES = 4096
HIDDEN = 6
TRAIN_DOCS = 4000
WINDOWS_PER_DOC = 4
EPOCH_STEPS = 240
BATCH = 192
RATE = 0.02
PAD = 256  # the code of positions after the end of a window
UNKNOWN = "und"


class Network:
    """Weights of both directions. Gate order in the tables: z, r, candidate."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        scale = 1.0 / np.sqrt(hidden)
        self.w: dict[str, np.ndarray] = {}
        for side in "fb":
            self.w[f"E{side}"] = (rng.standard_normal((3 * hidden, PAD + 1)) * 0.3).astype(np.float32)
            self.w[f"U{side}"] = (rng.standard_normal((2 * hidden, hidden)) * scale).astype(np.float32)
            self.w[f"C{side}"] = (rng.standard_normal((hidden, hidden)) * scale).astype(np.float32)
            self.w[f"V{side}"] = (rng.standard_normal((len(languages), hidden)) * scale).astype(np.float32)
        self.w["b"] = np.zeros((len(languages), 1), dtype=np.float32)

    # ------------------------------------------------------------ training --

    def _forward(self, side: str, x: np.ndarray) -> list[tuple]:
        """x: (time, lanes) codes in reading order of this direction."""
        k, w = self.hidden, self.w
        h, tape = np.zeros((k, x.shape[1]), dtype=np.float32), []
        for codes in x:
            g = w[f"E{side}"][:, codes]
            zr = 1.0 / (1.0 + np.exp(-(w[f"U{side}"] @ h + g[: 2 * k])))
            c = w[f"C{side}"] @ h
            n = np.tanh(zr[k:] * c + g[2 * k :])
            new = zr[:k] * (h - n) + n
            tape.append((codes, h, zr, c, n, new))
            h = new
        return tape

    def _backward(self, side: str, tape: list[tuple], to_state: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        """to_state: (time, hidden, lanes) gradients from the output layer."""
        k, w = self.hidden, self.w
        back = np.zeros_like(tape[0][1])
        for t in range(len(tape) - 1, -1, -1):
            codes, h, zr, c, n, _ = tape[t]
            d = back + to_state[t]
            dn = d * (1 - zr[:k]) * (1 - n * n)
            dz = d * (h - n) * zr[:k] * (1 - zr[:k])
            dr = dn * c * zr[k:] * (1 - zr[k:])
            gates = np.concatenate([dz, dr])
            through = dn * zr[k:]
            grad[f"U{side}"] += gates @ h.T
            grad[f"C{side}"] += through @ h.T
            np.add.at(grad[f"E{side}"].T, codes, np.concatenate([gates, dn]).T)
            back = d * zr[:k] + w[f"U{side}"].T @ gates + w[f"C{side}"].T @ through

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for windows x (time, lanes) and a label per lane."""
        ahead, behind = self._forward("f", x), self._forward("b", x[::-1])
        steps, lanes = x.shape
        grad = {name: np.zeros_like(v) for name, v in self.w.items()}
        real = (x != PAD).astype(np.float32)
        weight = real / max(1.0, float(real.sum()))
        df = np.empty((steps, self.hidden, lanes), dtype=np.float32)
        db = np.empty_like(df)
        loss = 0.0
        for t in range(steps):
            hf, hb = ahead[t][5], behind[steps - 1 - t][5]
            o = self.w["Vf"] @ hf + self.w["Vb"] @ hb + self.w["b"]
            o -= o.max(0)
            p = np.exp(o)
            p /= p.sum(0)
            loss -= float((np.log(p[label, np.arange(lanes)] + 1e-12) * weight[t]).sum())
            p[label, np.arange(lanes)] -= 1.0
            p *= weight[t]
            grad["b"] += p.sum(1, keepdims=True)
            grad["Vf"] += p @ hf.T
            grad["Vb"] += p @ hb.T
            df[t] = self.w["Vf"].T @ p
            db[steps - 1 - t] = self.w["Vb"].T @ p
        self._backward("f", ahead, df, grad)
        self._backward("b", behind, db, grad)
        return loss, grad

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int, batch: int, rate: float, seed: int = 10) -> list[float]:
        """Adam over random batches; windows: (count, time) codes."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(windows), min(batch, len(windows)))
            loss, grad = self.gradients(windows[pick].T, labels[pick])
            losses.append(loss)
            now = rate * min(1.0, 3.0 * (1 - (i - 1) / steps))
            for k, g in grad.items():
                np.clip(g, -1.0, 1.0, out=g)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.w[k] -= (now * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return losses

    # ----------------------------------------------------------- inference --

    def _run(self, side: str, x: np.ndarray) -> np.ndarray:
        """Output layer's share of one direction: (time, languages, lanes)."""
        k, lanes = self.hidden, x.shape[1]
        e, u, c, v = (self.w[name + side] for name in "EUCV")
        h = np.zeros((k, lanes), dtype=np.float32)
        g = np.empty((3 * k, lanes), dtype=np.float32)
        zr, n = np.empty((2 * k, lanes), dtype=np.float32), np.empty((k, lanes), dtype=np.float32)
        out = np.empty((len(x), len(v), lanes), dtype=np.float32)
        steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        for t in steps:
            np.take(e, x[t], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=zr)
            zr += g[: 2 * k]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1.0
            np.reciprocal(zr, out=zr)
            np.matmul(c, h, out=n)
            n *= zr[k:]
            n += g[2 * k :]
            np.tanh(n, out=n)
            h -= n
            h *= zr[:k]
            h += n
            np.matmul(v, h, out=out[t])
        return out

    def label_windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities per position: (time, languages, lanes)."""
        o = self._run("f", x)
        o += self._run("b", x)
        o += self.w["b"]
        np.clip(o, -30.0, 30.0, out=o)
        np.exp(o, out=o)
        o /= o.sum(1, keepdims=True)
        return o

    def pool(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, lanes: int = LANES) -> np.ndarray:
        """Mean probabilities of each document: (documents, languages)."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // window)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        first = np.cumsum(pieces) - pieces
        begin = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * window
        end = np.minimum(begin + window, offsets[1:][owner])
        total = np.zeros((len(sizes), len(self.languages)))
        at = np.arange(window, dtype=np.int64)[:, None]
        for lo in range(0, len(owner), lanes):
            b, e = begin[lo : lo + lanes], end[lo : lo + lanes]
            spot = b[None, :] + at
            real = spot < e[None, :]
            x = np.where(real, data[np.minimum(spot, len(data) - 1)].astype(np.int64), PAD)
            p = self.label_windows(x)
            if not real.all():
                p *= real[:, None, :]
            part = p.sum(0, dtype=np.float64)
            who = owner[lo : lo + lanes]
            for j in range(len(self.languages)):
                total[:, j] += np.bincount(who, weights=part[j], minlength=len(sizes))
        return total / np.maximum(sizes, 1)[:, None]


def _windows(texts: list[str], labels: list[int], per_doc: int, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``per_doc`` windows from anywhere in each text, as code rows."""
    rng = np.random.default_rng(seed)
    rows, owner = [], []
    for text, label in zip(texts, labels):
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        if not len(raw):
            continue
        for _ in range(per_doc):
            begin = int(rng.integers(0, max(1, len(raw) - window + 1)))
            row = np.full(window, PAD, dtype=np.int64)
            piece = raw[begin : begin + window]
            row[: len(piece)] = piece
            rows.append(row)
            owner.append(label)
    return (np.array(rows) if rows else np.zeros((0, window), np.int64)), np.array(owner, dtype=np.int64)


def train_network(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS, seed: int = 10, steps: int = EPOCH_STEPS) -> Network | None:
    """Fits a network on at most ``train_docs`` rows of ``labelled``.

    Only windows of the sampled rows come to the driver: WINDOWS_PER_DOC pieces
    of four windows' length at places spread by hash, so a long text adds no
    more than a short one (the text itself is not collected).
    """
    # one row per language: a catalogue, not the corpus
    counts = {r[0]: r["n"] for r in labelled.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = max(1, train_docs // len(counts))
    rate = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, share / n)))])
    dice = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.length(text)), F.lit(1_000_000)) / 1_000_000.0
    piece = 4 * WINDOW
    spots = F.array(
        *[
            F.substring(
                F.col(text),
                F.pmod(F.xxhash64(F.lit(seed + i), F.col(key).cast("string")), F.greatest(F.lit(1), F.length(text) - piece)).cast("int") + 1,
                F.lit(piece),
            )
            for i in range(WINDOWS_PER_DOC)
        ]
    )
    rows = labelled.where(dice < rate[F.col(lang)]).select(F.col(lang).alias("l"), F.explode(spots).alias("t"), F.col(key).cast("string").alias("k"))
    got = sorted((r["l"], r["k"] or "", r["t"]) for r in rows.collect())
    languages = sorted({r[0] for r in got})
    if not languages:
        return None
    net = Network(languages, seed=seed)
    if len(languages) > 1:
        x, y = _windows([r[2] for r in got], [languages.index(r[0]) for r in got], 2, WINDOW, seed)
        if len(x):
            # every language weighs the same: repeat the rows of the rarer ones
            most = np.bincount(y, minlength=len(languages)).max()
            picks = [np.resize(np.flatnonzero(y == j), most) for j in range(len(languages)) if (y == j).any()]
            order = np.concatenate(picks)
            net.train(x[order], y[order], steps, BATCH, RATE, seed)
    return net


def identify(docs: DataFrame, network: Network | None, text: str = "text", result: str = "language") -> tuple[DataFrame, str]:
    """``docs`` + struct (lang, score, probabilities); returns its name too."""
    result = unique_name(docs.columns, result)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("probabilities", T.ArrayType(T.DoubleType()))])
    arrow = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("probabilities", pa.list_(pa.float64()))])
    shared = docs.sparkSession.sparkContext.broadcast(network)
    lettered = unique_name(docs.columns, "__lettered")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            real = batch.column(batch.schema.get_field_index(lettered)).to_pylist()
            rows = []
            for lo, hi, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text))):
                if net is None:
                    rows += [{"lang": UNKNOWN, "score": 0.0, "probabilities": []}] * (hi - lo)
                    continue
                for ok, q in zip(real[lo:hi], net.pool(data, offsets)):
                    if ok:
                        rows.append({"lang": net.languages[int(q.argmax())], "score": float(min(1.0, q.max())), "probabilities": q.tolist()})
                    else:
                        rows.append({"lang": UNKNOWN, "score": 0.0, "probabilities": []})
            keep = [(c, name) for c, name in zip(batch.columns, batch.schema.names) if name != lettered]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in keep], pa.array(rows, type=arrow)], names=[*[name for _, name in keep], result])

    ready = docs.withColumn(lettered, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return ready.mapInArrow(label, T.StructType([*docs.schema.fields, T.StructField(result, kind)])), result
