"""Secret scans: pattern spans, and a character convolutional network over every candidate in its context.

Three patterns give the base spans, which always stay. Further candidates are runs of 16 or more key characters
with a letter and a digit, also what base spans leave of a longer run. Each candidate is cut out with its surroundings, in overlapping windows if it is longer than
``BODY``, and scored by its best window. The score is a small convolutional network's in numpy (embedding, convolution,
maximum over positions, logistic output), trained on labelled findings made from fixed seeds and on the windows of long
runs joined from them. Scores are calibrated by a logistic fit on findings that training did not see; the threshold lies
above all of their plain candidates, but never so high that less than ``RECALL`` of the secrets pass.

Defined results: a null text is the empty text; positions are code points, ends exclusive; rows that repeat are scanned
alike; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}")
HINTS = ("passw", "secret", "token", "api")

LEFT, BODY, RIGHT, STRIDE = 24, 40, 8, 8
LENGTH = LEFT + BODY + RIGHT
SYMBOLS, EMBED, WIDTH, FILTERS = 98, 8, 5, 32
EXAMPLES, EPOCHS, BATCH, RECALL = 4000, 8, 64, 0.97


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end, by start and then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters with a letter and a digit, without the spans of ``taken`` (by start); what such a span leaves of a run is a run."""
    out, spans, k = [], [(a, b) for _, a, b in taken], 0
    for m in CANDIDATE.finditer(text):
        at, stop = m.span()
        while k < len(spans) and spans[k][0] < stop:
            out.append((at, min(spans[k][0], stop)))
            at = max(at, min(spans[k][1], stop))
            if spans[k][1] > stop:
                break
            k += 1
        out.append((at, stop))
    return [(a, b) for a, b in out if b - a >= LEAST and any(c.isdigit() for c in text[a:b]) and any(c.isalpha() for c in text[a:b])]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Symbols (2 x LENGTH): the characters around and in a candidate, and whether each belongs to it."""
    left, body, right = text[max(0, start - LEFT) : start], text[start : min(end, start + BODY)], text[end : end + RIGHT]
    s = left.rjust(LEFT, "\0") + body.ljust(BODY, "\0") + right.ljust(RIGHT, "\0")
    chars = np.fromiter((0 if c == "\0" else ord(c) - 31 if " " <= c <= "~" else 96 if c in "\t\n\r" else 97 for c in s), np.int64, LENGTH)
    inside = np.zeros(LENGTH, np.int64)
    inside[LEFT : LEFT + len(body)] = 1
    return np.stack([chars, inside])


def window_spans(start: int, end: int) -> list[tuple[int, int]]:
    """The windows of a candidate: one every ``STRIDE`` characters, the last one ending with it."""
    last = max(start, end - BODY)
    return [(at, min(end, at + BODY)) for at in (*range(start, last, STRIDE), last)]


class Network:
    """Embedding (and an inside mark), one convolution, maximum over positions, logistic output."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.5, (SYMBOLS, EMBED)),
            "k": rng.normal(0, (2 / (WIDTH * (EMBED + 1))) ** 0.5, (WIDTH * (EMBED + 1), FILTERS)),
            "c": np.zeros(FILTERS),
            "o": rng.normal(0, FILTERS**-0.5, FILTERS),
            "b": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        emb = np.concatenate([self.p["e"][x[:, 0]], x[:, 1, :, None]], axis=2)
        cols = np.concatenate([emb[:, i : LENGTH - WIDTH + 1 + i] for i in range(WIDTH)], axis=2)
        act = cols @ self.p["k"] + self.p["c"]
        top = act.argmax(axis=1)
        best = np.maximum(np.take_along_axis(act, top[:, None], 1)[:, 0], 0)
        return cols, top, best, best @ self.p["o"] + self.p["b"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-(self.scale * self.logits(x) + self.shift)))

    def span_logits(self, spans: Iterable[tuple[str, int, int]]) -> np.ndarray:
        """The logit of each (text, start, end): its best window's. At most 4096 windows are held at once."""
        best: list[float] = []
        cells = ((k, text, a, b) for k, (text, start, end) in enumerate(spans) for a, b in window_spans(start, end))
        while part := list(islice(cells, 4096)):
            for (k, *_), z in zip(part, self.logits(np.stack([window(*c[1:]) for c in part])).tolist()):
                if k == len(best):
                    best.append(z)
                else:
                    best[k] = max(best[k], z)
        return np.array(best)

    def span_scores(self, spans: Iterable[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probabilities of whole candidates."""
        return 1 / (1 + np.exp(-(self.scale * self.span_logits(spans) + self.shift)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        rng, t = np.random.default_rng(12), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                part = order[at : at + BATCH]
                cols, top, best, z = self._forward(x[part])
                dz = (1 / (1 + np.exp(-z)) - y[part]) / len(part)
                dbest = np.outer(dz, self.p["o"]) * (best > 0)
                picked = np.take_along_axis(cols, top[:, :, None], 1)  # batch, filter, column
                dcols = dbest[:, :, None] * self.p["k"].T[None]
                de = np.zeros_like(self.p["e"])
                for i in range(WIDTH):
                    ids = np.take_along_axis(x[part, 0], top + i, 1)
                    np.add.at(de, ids.ravel(), dcols[:, :, i * (EMBED + 1) : i * (EMBED + 1) + EMBED].reshape(-1, EMBED))
                grads = {"e": de, "k": np.einsum("bf,bfc->cf", dbest, picked), "c": dbest.sum(0), "o": best.T @ dz, "b": np.array([dz.sum()])}
                t += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, spans: list[tuple[str, int, int]], y: np.ndarray) -> None:
        """Logistic fit of the labels on the logits, then a threshold above the plain findings within the recall asked for."""
        z = self.span_logits(spans)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = p * (1 - p) + 1e-9
            h = np.array([[np.sum(w * z * z) + 1e-3, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-3]])
            step = np.linalg.solve(h, [np.sum((p - y) * z), np.sum(p - y)])
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        self.scale, self.shift = float(a), float(b)
        scores = self.span_scores(spans)
        ceiling = float(np.quantile(scores[y == 1], 1 - RECALL, method="lower"))
        self.threshold = min(ceiling, max(0.5, float(scores[y == 0].max(initial=0.0))))


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """text, start, end, label: made findings, half of them secrets, with invented surroundings."""
    rng = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    syllable = lambda: rng.choice("an er in the ou re tion ing de la que en sch ung ment eau ci do rr ge".split())
    word = lambda: "".join(syllable() for _ in range(rng.randint(1, 4)))

    def secret() -> str:
        kind = rng.randrange(6)
        if kind == 0:
            return rng.choice(["gh" + "p_", "sk" + "-", "xox" + "b-", "pk_live_", "glpat-", ""]) + pick(lower + upper + digit, rng.randint(20, 44))
        if kind == 1:
            return "ey" + "J" + ".".join(pick(lower + upper + digit + "_-", rng.randint(16, 40)) for _ in range(3))
        if kind == 2:
            return pick(lower + upper + digit + "+/", rng.randint(24, 60)) + rng.choice(["", "=", "=="])
        if kind == 3:
            return pick(upper + digit, rng.randint(18, 32))
        if kind == 4:
            return pick("0123456789ABCDEF", rng.randint(24, 64))
        return pick(lower + digit, rng.randint(18, 40))

    def plain() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            return f"{word()}{rng.randint(1, 9)}.example.com/{word()}/{rng.randint(1, 999)}"
        if kind == 1:
            return f"20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}"
        if kind == 2:
            return "/".join(word() for _ in range(4)) + f"/{word()}{rng.randint(1, 99)}.html"
        if kind == 3:
            return "-".join(pick(digit + "abcdef", k) for k in (8, 4, 4, 4, 12))
        if kind == 4:
            return f"{word()}_{word()}_{word()}_{word()}_v{rng.randint(1, 20)}"
        if kind == 5:
            return f"{word()}.{rng.randint(1, 99)}.mail{rng.randint(1, 9)}.example.com"
        if kind == 6:
            return word() + "".join(word().capitalize() for _ in range(4)) + str(rng.randint(1, 99))
        if kind == 7:
            return rng.choice(["=", "-", ".", "a1", "x9", "0a"]) * rng.randint(9, 20) + f"{rng.choice(lower)}{rng.randint(0, 9)}"
        return "-".join([word(), word(), str(rng.randint(100, 9999)), word(), word()])

    out = []
    for i in range(n):
        label = i % 2
        core = secret() if label else plain()
        while not (any(c.isdigit() for c in core) and any(c.isalpha() for c in core) and len(core) >= 16):
            core = secret() if label else plain()
        lead = " ".join(word() for _ in range(rng.randint(0, 6)))
        if rng.random() < (0.5 if label else 0.25):
            lead += " " + rng.choice(["key", "auth", "bearer", "credential", "private_key", "access", "id", "session", "file", "see", "url"]) + rng.choice([": ", " = ", "=", " ", ' "'])
        elif lead:
            lead += rng.choice([" ", "\n", " (", ' "'])
        out.append((lead + core + rng.choice(["", " ", ".", '"', "\n", ")"]) + " ".join(word() for _ in range(rng.randint(0, 3))), len(lead), len(lead) + len(core), label))
    return out


def long_findings(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """text, start, end, and start and end of the secret in it: long runs of made findings, half of them with a secret (else both are 0)."""
    rng, made = random.Random(seed), labelled_findings(4 * n, seed)
    cores = [[t[a:b] for t, a, b, label in made if label == k] for k in (0, 1)]
    out = []
    for i in range(n):
        parts = [rng.choice(cores[0]) for _ in range(rng.randint(2, 5))]
        at = rng.randint(0, len(parts))
        if i % 2:
            parts.insert(at, rng.choice(cores[1]))
        joins = [rng.choice("///.=_-") for _ in parts]
        run = "".join(p + j for p, j in zip(parts, joins))[:-1]
        low = sum(len(p) + 1 for p in parts[:at]) if i % 2 else 0
        lead = (m := rng.choice(made))[0][: m[1]]
        out.append((lead + run + rng.choice(["", " ", ".", '"', "\n", ")"]), len(lead), len(lead) + len(run), len(lead) + low if i % 2 else 0, len(lead) + low + len(parts[at]) if i % 2 else 0))
    return out


def long_windows(rows: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """text, start, end, label of the windows of long runs; those with less than 16 characters of a secret are left out."""
    out = []
    for text, start, end, low, high in rows:
        for a, b in window_spans(start, end):
            shared = min(b, high) - max(a, low)
            if shared <= 0 or shared >= 16:
                out.append((text, a, b, int(shared >= 16)))
    return out


@lru_cache(maxsize=1)
def train(examples: int = EXAMPLES) -> Network:
    """The network, trained on made findings and calibrated on others."""
    net = Network()
    rows = [(t, a, b, label) for t, start, end, label in labelled_findings(examples, 1) for a, b in window_spans(start, end)]
    rows += long_windows(long_findings(examples // 4, 3))
    net.fit(np.stack([window(t, a, b) for t, a, b, _ in rows]), np.array([r[3] for r in rows], float))
    rows = labelled_findings(examples, 2) + [(t, a, b, int(high > 0)) for t, a, b, _, high in long_findings(examples // 4, 4)]
    net.calibrate([r[:3] for r in rows], np.array([r[3] for r in rows], float))
    return net


def scan_all(texts: list[str], net: Network) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]]:
    """For each text its base spans, and all spans with scores (of base spans too), by start and then kind."""
    base = [base_spans(t) for t in texts]
    cells = [(i, kind, a, b) for i, spans in enumerate(base) for kind, a, b in spans]
    cells += [(i, "network", a, b) for i, t in enumerate(texts) for a, b in candidates(t, base[i])]
    every: list[list] = [[] for _ in texts]
    for (i, kind, a, b), s in zip(cells, net.span_scores((texts[i], a, b) for i, _, a, b in cells).tolist()):
        if kind != "network" or s >= net.threshold:
            every[i].append((kind, a, b, s))
    return [(b, sorted(e, key=lambda s: (s[1], KINDS.index(s[0])))) for b, e in zip(base, every)]


def _joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def find_secrets(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind, start, end, score, secret: one row per span."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [(i, *s, texts[i][s[1] : s[2]]) for i, (_, spans) in enumerate(scan_all(texts, shared.value)) for s in spans]
            cols = list(zip(*rows)) or [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string())))], ["doc_id", "kind", "start", "end", "score", "secret"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, kind string, start long, end long, score double, secret string")


def secret_digests(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            found = scan_all([t or "" for t in batch.column(1).to_pylist()], shared.value)
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS[:3]]
            digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([_joined(e) for _, e in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
