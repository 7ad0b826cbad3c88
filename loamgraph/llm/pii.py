"""Personal information in free text: a character-level bidirectional LSTM with CRF transitions, in numpy.

Texts are read whole. Regions around every place that can be personal data are cut into overlapping windows: a word that
is not among the model's plain words (no given name is), two capitalised words or initials in a row whatever they are, a
number before a street word, four or more digits close together, an at sign or its spelling. Outside the regions there
are only plain words in lower case or alone at the start of a sentence; what is lost there is a name typed wholly in
lower case of which every word is a plain one and none a common given name. Windows are decoded by Viterbi in batches;
where windows overlap, each character takes its label from the window in which it lies farther from the edge. Spans are
then moved to word borders and checked for what their type must have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
LABELS = 1 + 2 * len(TYPES)  # 0 outside, 2t+1 begin and 2t+2 inside of type t
MARGIN, WINDOW, OVERLAP = 32, 160, 64
BATCH = 256
WEIGHTS = Path(__file__).with_name("pii_weights.npz")

_ALPHABET = "\0" + "".join(map(chr, range(32, 127))) + "\n äöüßéèêëáàâåãíìîïóòôøõúùûñçæœÄÖÜÉÈÁÀÅÓØÚÑÇ’–—"
_CODE = {c: i for i, c in enumerate(_ALPHABET)}
_OTHER_LOWER, _OTHER_UPPER, _OTHER = len(_ALPHABET), len(_ALPHABET) + 1, len(_ALPHABET) + 2
SYMBOLS = len(_ALPHABET) + 3
_TABLE = np.full(0x3000, _OTHER, dtype=np.int16)
for _i in range(0x3000):
    _c = chr(_i)
    _TABLE[_i] = _CODE.get(_c, _OTHER_UPPER if _c.isupper() else _OTHER_LOWER if _c.isalpha() else _OTHER)

_PARTICLE = "van|von|de|der|da|di|du|del|al|el|la|le"
_STREET = "street|st|road|rd|avenue|ave|lane|drive|close|court|way|place|square|crescent|terrace|grove|row|walk|mews|gardens|boulevard|hill"
_PLACE = re.compile(rf"\d+[a-z]?,? (?:[^\W\d_]+ ){{1,3}}(?:{_STREET})\b|\d(?:[\s().:/+-]{{0,2}}\d){{3,}}|[A-ZÀ-Þ][\w'’.-]*,?\s+[A-ZÀ-Þ]|@|[\[({{]\s?at\s?[\])}}]|[^\W\d_]+")


def encode(text: str) -> np.ndarray:
    """One symbol per character."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return _TABLE[np.minimum(c, 0x2FFF)]


def regions(text: str, plain: frozenset[str]) -> list[tuple[int, int]]:
    """The stretches of text within MARGIN of a place that can be personal data, joined where they touch."""
    out: list[tuple[int, int]] = []
    for m in _PLACE.finditer(text):
        w = m[0]
        if w in plain or w[0].isalpha() and (len(w) == 1 or w.lower() in plain):
            continue
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Windows of at most WINDOW characters that cover a .. b and overlap by OVERLAP."""
    if b - a <= WINDOW:
        return [(a, b)]
    return [(x, min(x + WINDOW, b)) for x in range(a, b - OVERLAP, WINDOW - OVERLAP)]


class Tagger:
    """The trained network. Weights: E (symbols, 2, 4H) input part of the gates, U (2, H, 4H), W (2H, L), c (L), A (L, L), s (L)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.E, self.U, self.W, self.c, self.A, self.s = (np.ascontiguousarray(weights[k], dtype=np.float32) for k in ("E", "U", "W", "c", "A", "s"))
        self.H = self.U.shape[1]
        # sigmoid(x) = (1 + tanh(x / 2)) / 2: halving the three sigmoid gates lets one tanh serve all four
        half = np.ones(4 * self.H, np.float32)
        half[: 3 * self.H] = 0.5
        self.E2, self.U2 = self.E * half, self.U * half

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """(time, batch, labels) for codes (time, batch), padded with 0 at the end."""
        T, B = codes.shape
        H = self.H
        out = np.empty((2, T, B, H), np.float32)
        h, c = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
        g = np.empty((2, B, 4 * H), np.float32)
        back = codes[::-1]
        for t in range(T):
            np.matmul(h, self.U2, out=g)
            g[0] += self.E2[codes[t], 0]
            g[1] += self.E2[back[t], 1]
            np.tanh(g, out=g)
            s = g[:, :, : 3 * H]
            s += 1
            s *= 0.5
            c *= g[:, :, H : 2 * H]
            c += g[:, :, :H] * g[:, :, 3 * H :]
            h = g[:, :, 2 * H : 3 * H] * np.tanh(c)
            live = (back[t] > 0)[:, None]  # padding comes first backwards: the state starts at the last character
            h[1] *= live
            c[1] *= live
            out[:, t] = h
        both = np.concatenate([out[0], out[1, ::-1]], axis=2)
        return (both.reshape(T * B, 2 * H) @ self.W + self.c).reshape(T, B, LABELS)

    def decode(self, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Best label paths (time, batch) under emissions, transitions and start scores."""
        e = self.scores(codes)
        T, B = codes.shape
        best = e[0] + self.s
        from_ = np.empty((T, B, LABELS), np.int8)
        end = np.zeros((B, LABELS), np.float32)
        for t in range(T):
            if t:
                step = best[:, :, None] + self.A
                from_[t] = step.argmax(axis=1)
                best = step.max(axis=1) + e[t]
            last = lens == t + 1
            if last.any():
                end[last] = best[last]
        path = np.zeros((T, B), np.int8)
        now = end.argmax(axis=1)
        rows = np.arange(B)
        for t in range(T - 1, -1, -1):
            inside = t < lens
            path[t] = np.where(inside, now, 0)
            if t:
                now = np.where(inside, from_[t, rows, now], now)
        return path


def label_windows(tagger: Tagger, parts: list[np.ndarray]) -> list[np.ndarray]:
    """The label path of each window; equal windows are decoded once, windows of like length together."""
    first: dict[bytes, int] = {}
    place = [first.setdefault(p.tobytes(), len(first)) for p in parts]
    uniq: list[np.ndarray] = [None] * len(first)  # type: ignore[list-item]
    for p, i in zip(parts, place):
        uniq[i] = p
    lens = np.array([len(p) for p in uniq])
    got: list[np.ndarray] = [None] * len(uniq)  # type: ignore[list-item]
    order = np.argsort(lens, kind="stable")
    for lo in range(0, len(order), BATCH):
        pick = order[lo : lo + BATCH]
        T = int(lens[pick].max())
        codes = np.zeros((T, len(pick)), np.int16)
        for j, i in enumerate(pick):
            codes[: lens[i], j] = uniq[i]
        path = tagger.decode(codes, lens[pick])
        for j, i in enumerate(pick):
            got[i] = path[: lens[i], j]
    return [got[i] for i in place]


_WORD = re.compile(r"[^\W_]")
_DIGITS = re.compile(r"\d")
_NO_NAME = re.compile(r"[^\W\d_]{2,}[.!?]\s+|\b(?:Dr|Prof|Mr|Mrs|Ms|Mx|Miss|Sir)\s+")


def settle(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span moved to word borders and freed of surrounding punctuation; None if it lacks what its type must have."""
    while a > 0 and _WORD.match(text[a]) and _WORD.match(text[a - 1]):
        a -= 1
    while b < len(text) and _WORD.match(text[b - 1]) and _WORD.match(text[b]):
        b += 1
    start, end = (" \t\n.,;:<>=\"'“”", " \t\n,;:<>=\"'“”") if kind != "PHONE" else (" \t\n.,;:<>=\"'", " \t\n.,;:<>=\"'(")
    while a < b and text[a] in start:
        a += 1
    while a < b and text[b - 1] in end:
        b -= 1
    found = text[a:b]
    if kind == "NAME":
        for tail in ("'s", "’s"):
            if found.endswith(tail):
                b -= 2
        for m in _NO_NAME.finditer(text, a, b):  # the end of the sentence before, and titles
            a = m.end()
        if re.search(r"\b[A-ZÀ-Þ]", text[a:b]):  # of a name with capitals, words without are no part at its ends
            first = re.search(rf"\b(?:[A-ZÀ-Þ]|(?:{_PARTICLE})\b)", text[a:b])
            a += first.start() if first else 0
            tail = re.search(r"(?:[\s,]+[a-zß-ÿ][\w'’-]*)+$", text[a:b])
            b -= len(tail[0]) if tail and tail.start() > 0 else 0
        found = text[a:b]
        words = re.findall(r"[^\W\d_]+", found)
        if len(words) < 2 or max(map(len, words)) < 2 or _DIGITS.search(found) or words[-1].lower() in ("street", "road", "rd", "avenue", "crescent"):
            return None
    elif kind == "EMAIL":
        found = found.rstrip(".")
        b = a + len(found)
        if not re.search(r"@|\bat\b", found, re.I) or not re.search(r"\.|\bdot\b", found, re.I):
            return None
        user = re.match(r".*\s(?=[^\W_]\S*\s?[\[({]?\s?\bat\b)", found, re.I | re.S)  # no space stands in the user's part
        a += user.end() if user and "@" not in found else 0
    elif kind in ("PHONE", "ID"):
        n = len(_DIGITS.findall(found))
        if n < (7 if kind == "PHONE" else 5) or n > 16:
            return None
        if found.endswith("."):
            b -= 1
        if kind == "PHONE" and text[a:b].count("(") < text[a:b].count(")"):
            if a and text[a - 1] == "(" and found[-1] != ")":
                a -= 1
            elif found.endswith(")"):
                b -= 1
        elif kind == "PHONE" and found.startswith("(") and ")" not in found:
            a += 1
    elif not _DIGITS.search(found) and not ("," in found and re.search(rf"\b(?:{_STREET})\b", found, re.I)):
        return None
    elif found.endswith(".") and not re.search(r"\b(?:St|Rd|Ave)\.$", found):
        b -= 1
    return (a, b) if b > a else None


def find(texts: list[str | None], tagger: Tagger, plain: frozenset[str]) -> list[list[tuple[int, int, str]]]:
    """Per text the (start, end, type) spans in order, without overlaps. A null text has none."""
    jobs, parts = [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        found = regions(t, plain)
        if not found:
            continue
        code = encode(t)
        if len(code) != len(t):
            continue
        for a, b in found:
            for x, y in windows(a, b):
                jobs.append((i, x, y))
                parts.append(code[x:y])
    marks: dict[int, np.ndarray] = {}
    sure: dict[int, np.ndarray] = {}
    for (i, a, b), path in zip(jobs, label_windows(tagger, parts)):
        if i not in marks:
            marks[i] = np.zeros(len(texts[i]), np.int8)  # type: ignore[arg-type]
            sure[i] = np.full(len(texts[i]), -1, np.int16)  # type: ignore[arg-type]
        n = len(texts[i])  # type: ignore[arg-type]
        at = np.arange(a, b)
        depth = np.minimum(np.where(a == 0, 999, at - a), np.where(b == n, 999, b - 1 - at)).astype(np.int16)
        take = depth > sure[i][a:b]
        marks[i][a:b][take] = path[take]
        sure[i][a:b][take] = depth[take]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, m in marks.items():
        at = np.flatnonzero(m)
        if not len(at):
            continue
        kind = (m[at] - 1) // 2
        new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(kind) != 0) | ((m[at] % 2 == 1)[1:])))
        begin = np.flatnonzero(new)
        stop = np.concatenate((begin[1:], [len(at)]))
        last = 0
        for x, y in zip(begin, stop):
            k = TYPES[kind[x]]
            s = settle(texts[i], int(at[x]), int(at[y - 1]) + 1, k)  # type: ignore[arg-type]
            if s and s[0] >= last:
                out[i].append((*s, k))
                last = s[1]
    return out


def load(path: Path = WEIGHTS) -> tuple[dict[str, np.ndarray], frozenset[str]]:
    """(weights, plain words) as trained."""
    z = np.load(path)
    return {k: z[k] for k in z.files if k != "plain"}, frozenset(str(z["plain"]).split(" "))


def _over(df: DataFrame, keep: list[str], schema: str, rows) -> DataFrame:
    weights, plain = load()
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(weights)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = part.column(n).to_pylist()
                yield rows(part, texts, find(texts, tagger, plain))

    return df.select(*keep, "text").mapInArrow(run, schema)


def found_spans(texts: DataFrame) -> DataFrame:
    """(text_field, row_id, pii_type, start_at, found_text) for texts (text_field, row_id, text); start_at counts characters from 0."""

    def rows(part: pa.RecordBatch, texts: list[str | None], found: list[list[tuple[int, int, str]]]) -> pa.RecordBatch:
        at = pa.array([i for i, s in enumerate(found) for _ in s], pa.int64())
        flat = [(k, a, texts[i][a:b]) for i, s in enumerate(found) for a, b, k in s]  # type: ignore[index]
        cols = list(zip(*flat)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(at), part.column(1).take(at), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
            ["text_field", "row_id", "pii_type", "start_at", "found_text"],
        )

    return _over(texts, ["text_field", "row_id"], "text_field string, row_id bigint, pii_type string, start_at bigint, found_text string", rows)


def redacted(texts: DataFrame) -> DataFrame:
    """(text_field, row_id, n_found, clean_text): every span replaced by its type in square brackets, all else unchanged; null stays null."""

    def rows(part: pa.RecordBatch, texts: list[str | None], found: list[list[tuple[int, int, str]]]) -> pa.RecordBatch:
        out: list[str | None] = []
        for t, spans in zip(texts, found):
            if t is not None:
                bits, last = [], 0
                for a, b, k in spans:
                    bits += [t[last:a], f"[{k}]"]
                    last = b
                t = "".join([*bits, t[last:]])
            out.append(t)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in found], pa.int64()), pa.array(out, pa.string())], ["text_field", "row_id", "n_found", "clean_text"])

    return _over(texts, ["text_field", "row_id"], "text_field string, row_id bigint, n_found bigint, clean_text string", rows)
