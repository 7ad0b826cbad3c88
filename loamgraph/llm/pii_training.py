"""python -m loamgraph.llm.pii_training DIR [SECONDS [SEED]]: trains the character tagger and writes its weights; with a seed it goes on from those written.

Labelled texts are invented (pii_samples). DIR gives the sentences between and around the labelled ones: those of its
documents, and those that many nodes or requests share word for word; and the plain words. Adam on the CRF's negative log likelihood, gradients written out by hand; each batch is shared out to
WORKERS processes and their gradients are added.
"""

from __future__ import annotations

import multiprocessing
import os
import re
import sys
import time

import numpy as np

from . import pii
from .pii import LABELS, SYMBOLS, TYPES
from .pii_samples import GIVEN, Maker, plain_sentences, shared_sentences

HIDDEN, WORKERS, SHARD = 32, 8, 64
TEXTS = 130_000


def plain_words(texts: list[str], least: int = 5) -> frozenset[str]:
    """Lower-case words seen at least `least` times in lower case; no given name."""
    n: dict[str, int] = {}
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t):
            if w.islower() or len(w) < 5:
                n[w.lower()] = n.get(w.lower(), 0) + 1
    given = {g.lower() for g in GIVEN}
    return frozenset(w for w, k in n.items() if k >= least and len(w) > 1 and w not in given)


def labels_of(text: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(len(text), np.int64)
    for a, b, k in spans:
        y[a:b] = 2 * TYPES.index(k) + 2
        y[a] -= 1
    return y


def examples(maker: Maker, n: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of n invented texts, cut as in a query or anywhere."""
    out = []
    for _ in range(n):
        t, sp = maker.text()
        x, y = pii.encode(t), labels_of(t, sp)
        lo = int(rng.integers(0, 60)) if len(t) > 120 and rng.random() < 0.4 else 0
        for a, b in pii.windows(lo, len(t)):
            if b - a > 3:
                out.append((x[a:b], y[a:b]))
    return out


class Trainer:
    def __init__(self, rng: np.random.Generator):
        H = HIDDEN
        f = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {"E": f(SYMBOLS, 2, 4 * H, k=0.3), "U": f(2, H, 4 * H, k=H**-0.5), "W": f(2 * H, LABELS, k=0.2), "c": np.zeros(LABELS, np.float32), "A": f(LABELS, LABELS, k=0.01), "s": np.zeros(LABELS, np.float32)}
        self.p["E"][:, :, H : 2 * H] += 1  # forget gate open
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.n = 0

    def step(self, codes: np.ndarray, gold: np.ndarray, lens: np.ndarray, rate: float) -> float:
        """One Adam step over codes, gold (time, batch)."""
        loss, grad = self.gradient(codes, gold, lens)
        self.apply(grad, rate)
        return loss

    def gradient(self, codes: np.ndarray, gold: np.ndarray, lens: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over codes, gold (time, batch); order of gates: input, forget, output, candidate."""
        p, H = self.p, HIDDEN
        T, B = codes.shape
        back = codes[::-1]
        inp = np.stack([codes, back])
        G = np.empty((T, 2, B, 4 * H), np.float32)
        C = np.empty((T + 1, 2, B, H), np.float32)
        Hs = np.empty((T + 1, 2, B, H), np.float32)
        C[0] = Hs[0] = 0
        live = np.ones((T, 2, B, 1), np.float32)
        live[:, 1, :, 0] = back > 0
        TC = np.empty((T, 2, B, H), np.float32)
        for t in range(T):
            g = np.matmul(Hs[t], p["U"])
            g[0] += p["E"][inp[0, t], 0]
            g[1] += p["E"][inp[1, t], 1]
            g[:, :, : 3 * H] = 0.5 + 0.5 * np.tanh(0.5 * g[:, :, : 3 * H])
            g[:, :, 3 * H :] = np.tanh(g[:, :, 3 * H :])
            G[t] = g
            c = C[t] * g[:, :, H : 2 * H] + g[:, :, :H] * g[:, :, 3 * H :]
            TC[t] = np.tanh(c)
            C[t + 1] = c * live[t]
            Hs[t + 1] = g[:, :, 2 * H : 3 * H] * TC[t] * live[t]
        X = np.concatenate([Hs[1:, 0], Hs[1:, 1][::-1]], axis=2)
        e = X @ p["W"] + p["c"]
        mask = (np.arange(T)[:, None] < lens).astype(np.float32)
        # forward-backward over the CRF
        lse = lambda x, ax: (m := x.max(axis=ax, keepdims=True), np.log(np.exp(x - m).sum(axis=ax)) + m.squeeze(ax))[1]
        al = np.empty_like(e)
        al[0] = e[0] + p["s"]
        for t in range(1, T):
            nxt = lse(al[t - 1][:, :, None] + p["A"], 1) + e[t]
            al[t] = np.where(mask[t][:, None] > 0, nxt, al[t - 1])
        logz = lse(al[-1], 1)
        be = np.zeros_like(e)
        dA = np.zeros_like(p["A"])
        for t in range(T - 2, -1, -1):
            nxt = e[t + 1] + be[t + 1]
            on = mask[t + 1][:, None]
            be[t] = np.where(on > 0, lse(p["A"][None] + nxt[:, None, :], 2), be[t + 1])
            both = np.exp(al[t][:, :, None] + p["A"] + nxt[:, None, :] - logz[:, None, None]) * on[:, :, None]
            dA += both.sum(axis=0)
        post = np.exp(al + be - logz[None, :, None]) * mask[:, :, None]
        rows = np.arange(B)
        onehot = np.zeros_like(e)
        onehot[np.arange(T)[:, None], rows[None], gold] = 1
        onehot *= mask[:, :, None]
        score = (e * onehot).sum() + p["s"][gold[0]].sum() + (p["A"][gold[:-1], gold[1:]] * mask[1:]).sum()
        loss = float(logz.sum() - score) / B
        np.add.at(dA, (gold[:-1], gold[1:]), -mask[1:])
        de = (post - onehot) / B
        grad = {"A": dA / B, "s": de[0].sum(axis=0), "c": de.sum(axis=(0, 1)), "W": X.reshape(-1, 2 * H).T @ de.reshape(-1, LABELS)}
        dX = de @ p["W"].T
        dH = np.stack([dX[:, :, :H], dX[::-1][:, :, H:]], axis=1)
        dE, dU = np.zeros_like(p["E"]), np.zeros_like(p["U"])
        dh, dc = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
        UT = np.ascontiguousarray(p["U"].transpose(0, 2, 1))
        DG = np.empty((T, 2, B, 4 * H), np.float32)
        for t in range(T - 1, -1, -1):
            g, tc = G[t], TC[t]
            i, f, o, n = (g[:, :, k * H : (k + 1) * H] for k in range(4))
            d = (dh + dH[t]) * live[t]
            cc = dc * live[t] + d * o * (1 - tc * tc)
            dg = DG[t]
            dg[:, :, :H] = cc * n * i * (1 - i)
            dg[:, :, H : 2 * H] = cc * C[t] * f * (1 - f)
            dg[:, :, 2 * H : 3 * H] = d * tc * o * (1 - o)
            dg[:, :, 3 * H :] = cc * i * (1 - n * n)
            dc = cc * f
            dh = np.matmul(dg, UT)
        for k in range(2):
            dU[k] = Hs[:-1, k].reshape(-1, H).T @ DG[:, k].reshape(-1, 4 * H)
            flat, idx = DG[:, k].reshape(-1, 4 * H), inp[k].reshape(-1)
            order = np.argsort(idx, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], np.diff(idx[order]) > 0)))
            dE[idx[order][edge], k] = np.add.reduceat(flat[order], edge, axis=0)
        return loss, grad | {"E": dE, "U": dU}

    def apply(self, grad: dict[str, np.ndarray], rate: float) -> None:
        p = self.p
        norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        self.n += 1
        for k, g in grad.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            p[k] -= rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)


def read_texts(folder: str) -> tuple[list[str], list[str]]:
    """The texts of the corpus, which hold no personal data, and those of nodes and requests, which do."""
    import pyarrow.parquet as pq

    get = lambda name, col: sorted({t for t in pq.read_table(f"{folder}/{name}.parquet", columns=[col])[col].to_pylist() if t})
    return get("documents", "text"), get("graph_nodes", "content") + get("ingest_requests", "text")


_DATA: list[tuple[np.ndarray, np.ndarray]] = []
_LOCAL = Trainer(np.random.default_rng(0))


def _share(job: tuple[dict[str, np.ndarray], np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Gradient of the windows numbered in the job under its weights."""
    _LOCAL.p, pick = job
    T = max(len(_DATA[i][0]) for i in pick)
    codes, gold, lens = np.zeros((T, len(pick)), np.int16), np.zeros((T, len(pick)), np.int64), np.array([len(_DATA[i][0]) for i in pick])
    for k, i in enumerate(pick):
        codes[: lens[k], k], gold[: lens[k], k] = _DATA[i]
    return _LOCAL.gradient(codes, gold, lens)


def main(folder: str, seconds: float, seed: int = 1, go_on: bool = False) -> None:
    rng = np.random.default_rng(seed)
    texts, other = read_texts(folder)
    plain, sentences, shared = plain_words(texts), plain_sentences(texts), shared_sentences(other)
    _DATA.extend(examples(Maker(seed, sentences, shared=shared), TEXTS, rng))
    print(len(sentences), "sentences,", len(plain), "plain words,", len(_DATA), "windows", flush=True)
    t = Trainer(rng)
    if go_on:
        t.p = {k: v.astype(np.float32) for k, v in pii.load()[0].items()}
    lens = np.array([len(s) for s, _ in _DATA])
    began, epoch, size = time.time(), 0, WORKERS * SHARD
    with multiprocessing.get_context("fork").Pool(WORKERS) as pool:
        while (done := (time.time() - began) / seconds) < 1:
            order = np.argsort(lens + rng.uniform(0, 12, len(lens)))
            batches, total, n = [order[i : i + size] for i in range(0, len(order), size)], 0.0, 0
            for j in rng.permutation(len(batches)):
                parts = [batches[j][k::WORKERS] for k in range(WORKERS)]
                got = pool.map(_share, [(t.p, x) for x in parts if len(x)], chunksize=1)
                t.apply({k: sum(g[k] for _, g in got) / len(got) for k in t.p}, (0.006 if go_on else 0.012) * max(0.0, 1 - done) + 1e-4)
                total, n = total + sum(x for x, _ in got) / len(got), n + 1
                done = (time.time() - began) / seconds
                if done >= 1:
                    break
            print("epoch", epoch, "loss", round(total / n, 4), round(time.time() - began), "s", flush=True)
            epoch += 1
    np.savez_compressed(pii.WEIGHTS, plain=np.array(" ".join(sorted(plain))), **{k: v.astype(np.float16 if k in ("E", "U") else np.float32) for k, v in t.p.items()})


if __name__ == "__main__":
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    main(sys.argv[1], float(sys.argv[2]) if len(sys.argv) > 2 else 900, *([int(sys.argv[3]), True] if len(sys.argv) > 3 else []))
