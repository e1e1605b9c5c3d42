"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in both directions, labels every position with language probabilities, and pools
them over the document. Texts are read in rows of up to CORE bytes (FIT_CORE when fitting) with CONTEXT more on either side, from which the state of both directions comes; each
byte is labelled once, in the row whose core it is in, and every byte of every text is read. The positions' log-probabilities are averaged.

It is trained in numpy by backpropagation through time, on the driver, on at most SAMPLE labelled documents, those of the smallest hash of text and id, whatever their
length; each is read whole. At most SAMPLE languages, the most frequent ones, are learned. One in five
of the sampled documents is kept from the fit: with pieces of these, of many lengths, the score is calibrated, as softmax(slope * min(bytes, reach) * mean log-probability).

A text that is null or has no letter is `und` with score 0. Without labelled documents every text is `und`. Repeated rows get the same answer;
an empty table gives an empty result. Very long texts are read in bounded blocks of rows. Columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_of_id, quoted, read_table, tidied

UNKNOWN = "und"
#: Documents of the fit, at most.
SAMPLE = 1_500
#: Size of the network, passes over the sample, rows of a step.
HIDDEN, EMBED, EPOCHS, BATCH = 8, 16, 2, 128
#: Bytes that a row labels, when predicting and when fitting, and bytes of context on either side of them; steps that a fit takes at least.
CORE, FIT_CORE, CONTEXT, STEPS = 448, 192, 32, 150
#: Rows that prediction reads at once, and the lengths that rows are filled up to.
BLOCK, LENGTHS = 512, (16, 32, 64, 128, 256, CORE + 2 * CONTEXT)


class ByteGru:
    """Parameters and both passes. Directions are the first axis of all recurrent arrays: 0 forwards, 1 backwards.

    Gates z, q and candidate c: s' = s + z * (c - s), c = tanh(x_c + q * (s @ u_c)), z and q = sigmoid(x + s @ u).
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, embed: int = EMBED, seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, h, n = labels, hidden, len(labels)
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {
            "e": (r.standard_normal((257, embed)) * 0.5).astype(np.float32),  # row 256: no byte
            "w": scale(2, embed, 3 * h), "b": np.zeros((2, 1, 3 * h), np.float32), "u": scale(2, h, 3 * h),
            "o": scale(2 * h, n), "c": np.zeros(n, np.float32),
        }
        self.h, self.slope, self.reach = h, 1.0, 32

    def table(self) -> np.ndarray:
        """Input part of the gates for each byte, in each direction: (2, 257, 3h)."""
        return self.p["e"] @ self.p["w"] + self.p["b"]

    def states(self, codes: np.ndarray, keep: bool = False):
        """codes: (rows, length) bytes or 256. States (2, length, rows, h); steps of direction 1 run from the end."""
        (rows, length), h, u, table = codes.shape, self.h, self.p["u"], self.table()
        steps = np.ascontiguousarray(codes.T)
        out = np.empty((2, length, rows, h), np.float32)
        state, saved = np.zeros((2, rows, h), np.float32), []
        x, g = np.empty((2, rows, 3 * h), np.float32), np.empty((2, rows, 3 * h), np.float32)
        gates, c = np.empty((2, rows, 2 * h), np.float32), np.empty((2, rows, h), np.float32)
        with np.errstate(over="ignore"):
            for t in range(length):
                np.take(table[0], steps[t], 0, mode="clip", out=x[0])
                np.take(table[1], steps[length - 1 - t], 0, mode="clip", out=x[1])
                np.matmul(state, u, out=g)
                np.add(x[..., : 2 * h], g[..., : 2 * h], out=gates)
                np.negative(gates, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                np.multiply(g[..., 2 * h :], gates[..., h:], out=c)
                c += x[..., 2 * h :]
                np.tanh(c, out=c)
                if keep:
                    saved.append((state, gates.copy(), g[..., 2 * h :].copy(), c.copy()))
                c -= state
                c *= gates[..., :h]
                state = np.add(state, c, out=out[:, t])
        return (out, saved) if keep else out

    def log_probabilities(self, out: np.ndarray) -> np.ndarray:
        """(length, rows, labels) from the states."""
        h = self.h
        logits = out[0] @ self.p["o"][:h] + out[1, ::-1] @ self.p["o"][h:] + self.p["c"]
        logits -= logits.max(-1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(-1, keepdims=True))

    def gradients(self, codes: np.ndarray, target: np.ndarray, core: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions that hold a byte, of the core if it is given as (rows, length) flags, and its gradients by backpropagation through time."""
        (out, saved), (rows, length), h, p = self.states(codes, keep=True), codes.shape, self.h, self.p
        held = ((codes.T < 256) if core is None else core.T)[..., None].astype(np.float32)
        logp = self.log_probabilities(out)
        n = max(held.sum(), 1.0)
        hot = np.eye(len(self.labels), dtype=np.float32)[target]
        loss = -(logp * hot * held).sum() / n
        d = (np.exp(logp) - hot) * held / n
        g = {k: np.zeros_like(x) for k, x in p.items()}
        flat = d.reshape(-1, d.shape[-1])
        g["o"][:h], g["o"][h:] = out[0].reshape(-1, h).T @ flat, out[1, ::-1].reshape(-1, h).T @ flat
        g["c"] = flat.sum(0)
        into = np.stack((d @ p["o"][:h].T, (d @ p["o"][h:].T)[::-1]))
        inputs = np.empty((2, length, rows, 3 * h), np.float32)
        carry, ut = np.zeros((2, rows, h), np.float32), np.ascontiguousarray(p["u"].transpose(0, 2, 1))
        dg = np.empty((2, rows, 3 * h), np.float32)
        for t in range(length - 1, -1, -1):
            state, gates, gc, c = saved[t]
            z, q = gates[..., :h], gates[..., h:]
            ds = into[:, t] + carry
            dc = ds * z * (1 - c * c)
            inputs[:, t, :, :h] = dg[..., :h] = ds * (c - state) * z * (1 - z)
            inputs[:, t, :, h : 2 * h] = dg[..., h : 2 * h] = dc * gc * q * (1 - q)
            inputs[:, t, :, 2 * h :] = dc
            dg[..., 2 * h :] = dc * q
            g["u"] += state.transpose(0, 2, 1) @ dg
            carry = ds * (1 - z) + dg @ ut
        table = np.zeros((2, 257, 3 * h), np.float32)
        for k, at in enumerate((codes.T, codes.T[::-1])):
            order = np.argsort(at.ravel(), kind="stable")
            byte, first = np.unique(at.ravel()[order], return_index=True)
            table[k, byte] = np.add.reduceat(inputs[k].reshape(-1, 3 * h)[order], first)
        g["b"] = table.sum(1, keepdims=True)
        g["w"] = p["e"].T @ table
        g["e"] = (table @ p["w"].transpose(0, 2, 1)).sum(0)
        return float(loss), g

    def fit(self, texts: list[bytes], target: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 11) -> ByteGru:
        """Adam over rows of all texts; the order of steps is fixed by the seed."""
        r, step = np.random.default_rng(seed), 0
        m, s = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        batches = list(rows_of(texts, BATCH, r.permutation(len(texts)), FIT_CORE))
        epochs = max(epochs, -(-STEPS // max(len(batches), 1)))
        total = epochs * len(batches)
        for _ in range(epochs):
            for i in r.permutation(len(batches)).tolist():
                codes, owner, core = batches[i]
                _, g = self.gradients(codes, target[owner], core)
                step += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k, x in g.items():
                    x = x * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    s[k] = 0.99 * s[k] + 0.01 * x * x
                    now = rate * (1 - 0.9 * min(1.0, step / total))
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def means(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-probability of each language over all positions: (texts, labels)."""
        sums, sizes = np.zeros((len(texts), len(self.labels))), np.array([len(x) for x in texts])
        for codes, owner, core in rows_of(texts, BLOCK):
            logp = self.log_probabilities(self.states(codes))
            logp *= core.T[..., None]
            np.add.at(sums, owner, logp.sum(0))
        return sums / np.maximum(sizes, 1)[:, None]

    def probabilities(self, means: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        x = (means - means.max(1, keepdims=True)) * (self.slope * np.minimum(sizes, self.reach))[:, None]
        x = np.exp(x)
        return x / x.sum(1, keepdims=True)

    def calibrate(self, texts: list[bytes], target: np.ndarray, seed: int = 13) -> ByteGru:
        """Slope and reach of the least log loss over texts that the fit has not seen and pieces of them, 8 to 256 bytes long."""
        r, parts, owner = np.random.default_rng(seed), [], []
        for k, text in enumerate(texts):
            for size in (8, 16, 32, 64, 128, 256):
                at = int(r.integers(0, max(len(text) - size, 0) + 1))
                parts.append(text[at : at + size])
                owner.append(k)
        if not parts:
            return self
        means, sizes, best = self.means(parts), np.array([len(x) for x in parts]), np.inf
        want = target[owner]
        for reach in (8, 16, 32, 64, 128, 256):
            for slope in 2.0 ** np.arange(-6, 2, 0.5):
                self.slope, self.reach = float(slope), reach
                loss = -np.log(np.maximum(self.probabilities(means, sizes)[np.arange(len(want)), want], 1e-9)).mean()
                if loss < best - 1e-6:
                    best, found = loss, (float(slope), reach)
        self.slope, self.reach = found
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probabilities of each text: (texts, labels)."""
        return self.probabilities(self.means(texts), np.array([len(x) for x in texts], np.int64))


def rows_of(texts: list[bytes], block: int = BLOCK, order: np.ndarray | None = None, size: int = CORE):
    """Yields (codes, text of each row, flags of the row's core), every byte of every text in one core, at most `block` rows at a time.

    Rows are grouped by the length that they are filled up to, which depends on the row alone, so what a text gives does not depend on its neighbours.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    counts = -(-sizes // size)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
    low, high = np.maximum(first - CONTEXT, 0), np.minimum(first + size + CONTEXT, sizes[owner])
    lengths = np.array(LENGTHS)
    width = np.searchsorted(lengths, high - low)
    for k, length in enumerate(LENGTHS):
        rows, step = np.flatnonzero(width == k), np.arange(length)
        if order is not None and len(rows):
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            rows = rows[np.argsort(place[owner[rows]], kind="stable")]
        for i in range(0, len(rows), block):
            own = rows[i : i + block]
            at = low[own, None] + step
            codes = data[np.minimum(starts[owner[own], None] + at, max(len(data) - 1, 0))].astype(np.int64)
            codes[at >= high[own, None]] = 256
            core = (at >= first[own, None]) & (at < np.minimum(first[own] + size, high[own])[:, None])
            yield codes, owner[own], core


def train(labelled: DataFrame, sample: int = SAMPLE) -> ByteGru | None:
    """labelled: (text, lang[, id]). At most `sample` rows in all, each language in its share or 1/(2 languages), whichever is more.

    First only hashes of a few more rows than wanted come to the driver, which picks; then the texts that it has picked.
    """
    usable = labelled.where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return None
    labels, total = sorted(counts), sum(counts.values())
    share = {k: max(n / total, 0.5 / len(counts)) for k, n in counts.items()}
    quota = {k: max(1, int(sample * x / sum(share.values()))) for k, x in share.items()}
    limit = F.lit(0.0)
    for k, n in counts.items():
        limit = F.when(F.col("lang") == k, min(1.0, 1.5 * quota[k] / n + 50 / n)).otherwise(limit)
    usable = usable.withColumn("h", F.xxhash64("text", *(["id"] if "id" in labelled.columns else [])))
    near = usable.where(F.pmod("h", F.lit(1 << 30)) <= limit * (1 << 30)).select("lang", "h").distinct()
    picked = []
    seen = dict.fromkeys(labels, 0)
    for r in sorted(near.collect(), key=lambda r: (r["h"] % (1 << 30), r["h"], r["lang"])):
        if r["lang"] in seen and seen[r["lang"]] < quota[r["lang"]]:
            picked.append(r["h"])
            seen[r["lang"]] += 1
    found = usable.where(F.col("h").isin(picked)).where(F.col("lang").isin(labels)).select("lang", "text").distinct().collect()
    rows = sorted((r["text"].encode(), r["lang"]) for r in found)  # an order that does not depend on tasks
    texts, target = [x for x, _ in rows], np.array([labels.index(k) for _, k in rows], np.int64)
    rest = np.random.default_rng(5).permutation(len(rows))
    kept, held = rest[len(rows) // 5 :], rest[: len(rows) // 5]
    model = ByteGru(labels).fit([texts[k] for k in kept], target[kept])
    return model.calibrate([texts[k] for k in held], target[held])


def _predictor(shared, drop: tuple[int, ...]):
    """Columns 1 and 2 are the text and whether it has letters; those in `drop` are not returned."""

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = [t.encode() if ok and t else b"" for t, ok in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            names, scores, i = [], [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 21):
                    size += len(texts[j])
                    j += 1
                found = model.documents(texts[i:j])
                best = found.argmax(1)
                names += [model.labels[k] if t else UNKNOWN for k, t in zip(best.tolist(), texts[i:j], strict=True)]
                scores += [float(p[k]) if t else 0.0 for p, k, t in zip(found, best, texts[i:j], strict=True)]
                i = j
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(batch.columns)) if k not in drop), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(n for k, n in enumerate(batch.schema.names) if k not in drop), "lang_pred", "score"])

    return tidied(run)


def predict(docs: DataFrame, model: ByteGru | None, keep: dict[str, Column], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs, then the predicted language and its probability, named by `out`. keep[text_col], if given, is the text itself."""
    text = F.col(quoted(text_col))
    at = {n: "__text" if n == text_col else f"k{i}" for i, n in enumerate(keep)}  # inside, columns have names of their own
    others = [(at[n], c) for n, c in keep.items() if n != text_col]
    first, rest = (others[:1] or [("__none", F.lit(None).cast("int"))])[0], others[1:]
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(first[1].alias(first[0]), text.alias("__text"), letters.alias("__letters"), *(c.alias(k) for k, c in rest))
    if model is None:
        return rows.select(*(F.col(at[n]).alias(n) for n in keep), F.lit(UNKNOWN).alias(out[0]), F.lit(0.0).alias(out[1]))
    drop = (2,) if text_col in keep else (1, 2)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for k, f in enumerate(rows.schema.fields) if k not in drop) + ", lang_pred string, score double"
    found = rows.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model), drop), schema)
    return found.select(*(F.col(at[n]).alias(n) for n in keep), F.col("lang_pred").alias(out[0]), F.col("score").alias(out[1]))


def training_fold(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_of_id(F.col(id_col)) % 3 != 1, F.lit(True))


def identify(docs: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score). Learns from `labelled`, else from docs of the training folds: crc32(id) mod 3 is not 1."""
    source = docs.where(training_fold(id_col)) if labelled is None else labelled
    model = train(source.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")), sample)
    return predict(docs, model, {"doc_id": F.col(id_col), "held_out": ~training_fold(id_col)}, text_col)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
