"""Language ID by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time: every byte of a training window has its document's
language as label. A text is read whole, as UTF-8, in segments of SEGMENT bytes that start from a zero state in both directions;
every position gets probabilities from both states, and a document's are the mean over all its positions.

Arrays are feature-major, (features, segments), so that each gate is one contiguous block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import narrow

#: The bounded sample that is fitted on: labelled documents of each language, and windows drawn from all over each whole text.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 160, 96
HIDDEN, WINDOW, STEPS, BATCH = 8, 64, 420, 96
SEGMENT, ABREAST = 128, 2_048
PAD = 256
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign, in the place of the hyperbolic tangent: a fifth of its time; its slope at y is (1 - |y|)^2."""
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * _squash(x)


def _gate_slope(y: np.ndarray) -> np.ndarray:
    return 0.5 * (1 - np.abs(2 * y - 1)) ** 2


class BiGRU:
    """x: byte tables (2, 3H, 257); u: recurrent weights (2, 3H, H); c: biases inside the reset gate (2, H, 1); w, b: output."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        h, self.languages = hidden, languages
        f = lambda *s, by: (rng.normal(size=s) * by).astype(np.float32)
        self.p = {"x": f(2, 3 * h, PAD + 1, by=0.3), "u": f(2, 3 * h, h, by=0.4), "c": np.zeros((2, h, 1), np.float32), "w": f(len(languages), 2 * h, by=0.3), "b": np.zeros((len(languages), 1), np.float32)}
        self._keep_at_pad()

    def _keep_at_pad(self) -> None:
        h = self.p["u"].shape[2]
        self.p["x"][:, :, PAD] = 0
        self.p["x"][:, :h, PAD] = 1e6  # the update gate keeps the state, zero before the first byte

    def _direction(self, k: int, seg: np.ndarray) -> list[tuple]:
        """Per step: (z, r, hn, n, state before, state after), in the direction's own order."""
        h = self.p["u"].shape[2]
        state, out = np.zeros((h, seg.shape[1]), np.float32), []
        for row in seg if k == 0 else seg[::-1]:
            a, g = self.p["x"][k][:, row], self.p["u"][k] @ state
            z, r = _gate(a[:h] + g[:h]), _gate(a[h : 2 * h] + g[h : 2 * h])
            hn = g[2 * h :] + self.p["c"][k]
            n = _squash(a[2 * h :] + r * hn)
            new = n + z * (state - n)
            out.append((z, r, hn, n, state, new))
            state = new
        return out

    def loss_and_gradients(self, seg: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions of seg (steps, segments), and its gradients."""
        h, steps = self.p["u"].shape[2], len(seg)
        runs = [self._direction(0, seg), self._direction(1, seg)]
        both = np.stack([np.concatenate([runs[0][t][5], runs[1][steps - 1 - t][5]]) for t in range(steps)])
        logits = self.p["w"] @ both + self.p["b"]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        real = (seg != PAD)[:, None, :].astype(np.float32)
        n = real.sum()
        at = prob[:, label, np.arange(len(label))]
        loss = float(-(np.log(np.maximum(at, 1e-30)) * real[:, 0]).sum() / n)
        prob[:, label, np.arange(len(label))] -= 1
        d = prob * real / n
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["w"] = np.einsum("tcb,thb->ch", d, both)
        g["b"] = d.sum((0, 2))[:, None]
        back = np.einsum("ch,tcb->thb", self.p["w"], d)
        for k in (0, 1):
            order = seg if k == 0 else seg[::-1]
            dh = np.zeros((h, seg.shape[1]), np.float32)
            for t in range(steps - 1, -1, -1):
                z, r, hn, new, state, _ = runs[k][t]
                dh = dh + back[t if k == 0 else steps - 1 - t][k * h : (k + 1) * h]
                dn = dh * (1 - z) * (1 - np.abs(new)) ** 2
                dz = dh * (state - new) * _gate_slope(z)
                dr = dn * hn * _gate_slope(r)
                da = np.concatenate([dz, dr, dn])
                dg = np.concatenate([dz, dr, dn * r])
                g["u"][k] += dg @ state.T
                g["c"][k] += (dn * r).sum(1, keepdims=True)
                np.add.at(g["x"][k].T, order[t], da.T)
                dh = dh * z + self.p["u"][k].T @ dg
        return loss, g

    def fit(self, texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = 5) -> list[float]:
        """Adam over windows drawn evenly from the languages."""
        rng = np.random.default_rng(seed)
        by = [[t for t, y in zip(texts, labels, strict=True) if y == c and t] for c in range(len(self.languages))]
        known = [c for c, own in enumerate(by) if own]
        m, v, losses = {}, {}, []
        for step in range(1, steps + 1):
            label = np.array([known[(step + i) % len(known)] for i in range(BATCH)])
            seg = np.full((WINDOW, BATCH), PAD, np.int64)
            for i, c in enumerate(label):
                t = by[c][rng.integers(len(by[c]))]
                at = rng.integers(max(1, len(t) - WINDOW + 1))
                cut = np.frombuffer(t[at : at + WINDOW], np.uint8)
                seg[: len(cut), i] = cut
            loss, g = self.loss_and_gradients(seg, label)
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = 0.02 * min(1, step / 20) * (0.1 + 0.9 * (1 - step / steps))
            for k in self.p:
                x = g[k] * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                v[k] = 0.99 * v.get(k, 0) + 0.01 * x * x
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            self._keep_at_pad()
        return losses

    def positions(self, seg: np.ndarray) -> np.ndarray:
        """Probabilities (languages, steps, segments) of every position of seg (steps, segments)."""
        h, (steps, n) = self.p["u"].shape[2], seg.shape
        states = np.empty((2 * h, steps, n), np.float32)
        a, g, size = (np.empty((3 * h, n), np.float32) for _ in range(3))
        for k in (0, 1):
            x, u, c = self.p["x"][k], self.p["u"][k], self.p["c"][k]
            state = np.zeros((h, n), np.float32)
            for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
                np.take(x, seg[t], axis=1, out=a, mode="clip")
                np.matmul(u, state, out=g)
                for part in (slice(0, 2 * h), slice(2 * h, 3 * h)):
                    y, z = a[part], size[part]
                    if part.start:
                        g[part] += c
                        g[part] *= a[h : 2 * h]
                    y += g[part]
                    np.abs(y, out=z)
                    z += 1
                    y /= z
                    if not part.start:
                        y *= 0.5
                        y += 0.5
                new = a[2 * h :]
                state -= new
                state *= a[:h]
                state += new
                states[k * h : (k + 1) * h, t] = state
        logits = self.p["w"] @ states.reshape(2 * h, -1) + self.p["b"]
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits.reshape(-1, steps, n)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (documents, languages) over all positions; zero for a text without bytes."""
        total = np.zeros((len(texts), len(self.languages)))
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts])
        start = np.cumsum(size) - size
        count = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), count)
        first = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
        for i in range(0, len(doc), ABREAST):
            d, f = doc[i : i + ABREAST], first[i : i + ABREAST]
            inside = f[None] + np.arange(SEGMENT)[:, None]
            real = inside < size[d]
            seg = np.where(real, data[np.minimum(start[d] + inside, len(data) - 1)].astype(np.intp), PAD)
            prob = np.einsum("ctn,tn->cn", self.positions(seg), real.astype(np.float32))
            for c in range(len(self.languages)):
                total[:, c] += np.bincount(d, prob[c], len(texts))
        return total / np.maximum(size, 1)[:, None]


def train(labelled: DataFrame) -> BiGRU | None:
    """A network from labelled(doc_id, text, lang): at most DOCS_PER_LANGUAGE documents of each language, those whose ids' hashes come
    first, and WINDOWS_PER_DOC windows of each, at places that its hashes give. Rows without a language or text are passed over."""
    rows = narrow(labelled, doc_id="long", text="string", lang="string").where("lang is not null and text is not null and text <> ''")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = rows.select("lang", "doc_id", "text").withColumn("k", F.row_number().over(order)).where(F.col("k") <= DOCS_PER_LANGUAGE)
    last = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    windows = F.transform(F.sequence(F.lit(1), F.lit(WINDOWS_PER_DOC)), lambda i: F.substr("text", F.pmod(F.xxhash64("doc_id", i), last).cast("int") + 1, F.lit(WINDOW)))
    sample = rows.select("lang", "k", windows.alias("windows")).orderBy("lang", "k").collect()
    if not sample:
        return None
    languages = sorted({r.lang for r in sample})
    net = BiGRU(languages)
    net.fit([w.encode("utf-8", "replace") for r in sample for w in r.windows], [languages.index(r.lang) for r in sample for _ in r.windows])
    return net


def _predict(net: BiGRU | None):
    def run(batches):
        for batch in batches:
            for part in _by_bytes(batch, 2 << 20):
                texts = part.column(1).to_pylist()
                some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if net else []
                lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if some:
                    prob = net.documents([texts[i].encode("utf-8", "replace") for i in some])
                    for i, p in zip(some, prob, strict=True):
                        lang[i], score[i] = net.languages[int(p.argmax())], min(1.0, float(p.max()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def _by_bytes(batch: pa.RecordBatch, size: int):
    """Slices of about `size` bytes of text."""
    n = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(n) // size)) + 1
    for a, b in zip([0, *cut], [*cut, len(batch)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def predict(docs: DataFrame, net: BiGRU | None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, lang_pred, score), a row for each input row; only the text counts.

    A null text, and one without a letter, is `und` with score 0; so is every text if nothing was learned. Null doc_ids and
    repeated rows come back as they are. Extra columns are ignored; an empty table gives an empty one.
    """
    return narrow(docs, doc_id="long", text="string").mapInArrow(_predict(net), "doc_id long, lang_pred string, score double")


def _with_prediction(net: BiGRU | None, least: float):
    run = _predict(net)

    def keep(batches):
        for batch in batches:
            columns = [pa.array(range(len(batch)), pa.int64()), batch.column(batch.schema.get_field_index("text")).cast(pa.string())]
            ok = []
            for part in run([pa.RecordBatch.from_arrays(columns, ["doc_id", "text"])]):
                ok += [x != UNDETERMINED and s >= least for x, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return keep


def keep_identified(docs: DataFrame, net: BiGRU | None, least: float = 0.4) -> DataFrame:
    """docs without those whose language is undetermined or has a score under `least`; all columns stay."""
    return docs.mapInArrow(_with_prediction(net, least), docs.schema)
