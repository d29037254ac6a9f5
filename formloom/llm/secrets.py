"""Secret scans: rules, and a character convolutional network over every candidate.

Three rules find assignments, access keys and hexadecimal runs; their spans always
stay.  Every run of 16 or more key characters is a candidate, also where a rule found it.
A small convolutional network in numpy reads each candidate with the characters
around it, and those that score at least the threshold add a span of kind ``net``.

The network is trained on two kinds of labelled findings: generated keys, tokens and
ordinary long strings in the contexts they occur in (``examples``, a fixed number), and
candidates of the texts themselves (``sample`` of all distinct ones, those of the smallest
hashes): those that a rule found count as secrets, those that none found as ordinary
strings if they are of one kind of character, a word or a number; others, which may be
keys that the rules do not know, are left out.  Scores of whole candidates, the
greatest of their windows', are calibrated on a held-out fold by a logistic scale and
shift.  The threshold is the one of greatest precision there among those that keep the
stated recall.  Taking the sample and training run when the frame is built.

Defined results for odd input: null and empty texts have no findings; a null id is
passed through; repeated rows are scanned one by one; an empty table gives an empty
table; only the id and text columns are read.  Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The rules.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
ORDINARY = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|(.)\1*")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.ASCII)

WIDTH, CONTEXT = 48, 16  # characters of a candidate and of each side that the network reads at once
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.:;,'\"<>()[]{}@#$%&*!?|\\~^` \n\t"
_CODE = {c: i + 1 for i, c in enumerate(_ALPHABET)}
_OTHER, _PAD = len(_ALPHABET) + 1, 0
_CODES = np.array([_PAD, *[_CODE.get(chr(i), _OTHER) for i in range(1, 128)], _OTHER], dtype=np.int64)


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind rank, kind, end) of the rules, by start and then kind."""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A maximal run is long enough or not, so asking for the length in the pattern finds the same runs.
    out += [(m.start(), 2, "hex", m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(out)


def _line(text: str, start: int, stop: int) -> str:
    """A window of characters: context, candidate (its first WIDTH characters), context; nulls where there is nothing."""
    body = text[start : min(stop, start + WIDTH)]
    left = text[max(0, start - CONTEXT) : start].rjust(CONTEXT, "\0")
    return left + body.ljust(WIDTH, "\0") + text[stop : stop + CONTEXT].ljust(CONTEXT, "\0")


def windows(text: str, start: int, stop: int) -> list[str]:
    """Windows that cover a whole candidate; a long one takes several, half a width apart."""
    last = max(start, stop - WIDTH)
    starts = [*range(start, last, WIDTH // 2), last]
    return [_line(text, s, min(stop, s + WIDTH)) for s in starts]


def encoded(lines: list[str]) -> np.ndarray:
    """Character codes of windows, a row each."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), dtype=np.uint32).reshape(len(lines), WIDTH + 2 * CONTEXT)
    return _CODES[np.minimum(points, 128)]


class CharCNN:
    """Embedding, one convolution, maximum over positions, dense layer, logistic output; Adam."""

    def __init__(self, seed: int = 5, dim: int = 8, filters: int = 24, span: int = 5):
        r = np.random.default_rng(seed)
        self.span = span
        self.p = {
            "E": r.normal(0, 0.3, (_OTHER + 1, dim)),
            "W": r.normal(0, (2 / (span * dim)) ** 0.5, (span * dim, filters)),
            "b": np.zeros(filters),
            "V": r.normal(0, 0.2, 2 * filters),
            "c": np.zeros(1),
        }
        self.scale, self.shift = 1.0, 0.0
        self.threshold = 0.5

    def _forward(self, x: np.ndarray):
        e = self.p["E"][x]
        n, length, dim = e.shape
        m = length - self.span + 1
        cols = np.concatenate([e[:, d : d + m] for d in range(self.span)], axis=2)
        z = np.maximum(cols @ self.p["W"] + self.p["b"], 0)
        peak = z.argmax(axis=1)
        top = np.take_along_axis(z, peak[:, None], axis=1)[:, 0]
        f = np.concatenate([top, z.mean(axis=1)], axis=1)
        return cols, z, peak, f, f @ self.p["V"] + self.p["c"]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 5e-3, seed: int = 6) -> None:
        r = np.random.default_rng(seed)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), 64):
                i = order[at : at + 64]
                cols, z, peak, f, s = self._forward(x[i])
                ds = (1 / (1 + np.exp(-s)) - y[i]) / len(i)
                df = ds[:, None] * self.p["V"]
                k = z.shape[2]
                dz = np.repeat(df[:, None, k:] / z.shape[1], z.shape[1], axis=1)
                rows = np.arange(len(i))[:, None]
                dz[rows, peak, np.arange(k)] += df[:, :k]
                dz *= z > 0
                dcols = dz @ self.p["W"].T
                de = np.zeros_like(self.p["E"])
                dim = self.p["E"].shape[1]
                for d in range(self.span):
                    np.add.at(de, x[i][:, d : d + z.shape[1]], dcols[:, :, d * dim : (d + 1) * dim])
                grads = {
                    "E": de,
                    "W": cols.reshape(-1, cols.shape[2]).T @ dz.reshape(-1, k),
                    "b": dz.sum((0, 1)),
                    "V": f.T @ ds,
                    "c": ds.sum(keepdims=True),
                }
                step += 1
                for name, g in grads.items():
                    m, v = state[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[a : a + 256])[4] for a in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def calibrate(self, x: np.ndarray, y: np.ndarray, owner: np.ndarray, recall: float) -> None:
        """Logistic scale and shift by Newton steps, then the threshold by constrained recall, over whole candidates."""
        _, first, owner = np.unique(owner, return_index=True, return_inverse=True)
        s, y = np.full(len(first), -np.inf), y[first]
        np.maximum.at(s, owner, self.logits(x))
        w = np.array([1.0, 0.0])
        a = np.stack([s, np.ones_like(s)], axis=1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
            w -= np.linalg.solve(h, a.T @ (p - y) + 1e-2 * (w - [1, 0]))
        self.scale, self.shift = w
        p = 1 / (1 + np.exp(-np.clip(s * self.scale + self.shift, -30, 30)))
        best = max(
            (t for t in np.unique(p) if (p[y == 1] >= t).mean() >= recall),
            key=lambda t: ((y[p >= t] == 1).mean(), -t),
        )
        below = p[p < best]  # midway to the next score: a threshold on a score would sit on a case
        self.threshold = float((best + below.max()) / 2) if len(below) else float(best)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) * self.scale + self.shift, -30, 30)))


def labelled_candidates(examples: int, seed: int = 11) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All windows of generated findings with label and finding: keys of many shapes, and strings that only look long."""
    r = np.random.default_rng(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = lower + lower.upper() + digits
    syllables = [c + v for c in "bcdfghlmnprstvw" for v in "aeiou"] + ["tion", "ing", "heit", "ment", "ung", "que", "th", "er"]
    groups = "sch ich ver keit lich zu und ein eau oux ous elle ge ber ach pf tz st ren be an en ist nicht gen au ou re le es ar os ue ent on the and ing".split()

    def pick(alphabet, n: int) -> str:
        return "".join(alphabet[j] for j in r.integers(0, len(alphabet), n))

    def word() -> str:
        return pick(syllables, int(r.integers(1, 5)))

    def prose(n: int) -> str:
        return " ".join(word() for _ in range(n))

    x, y, owner = [], [], []
    for i in range(examples):
        secret = i % 2 == 0
        n = int(r.integers(16, 48)) if r.random() < 0.85 else int(r.integers(48, 120))
        if secret:
            body = [
                lambda: pick(mixed, n),
                lambda: pick(lower + lower.upper(), n),
                lambda: pick("0123456789abcdef", n),
                lambda: "AKIA" + pick(lower.upper() + digits, 16),
                lambda: str(r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"])) + pick(mixed, n),
                lambda: pick(mixed + "+/", n) + "==",
            ][int(r.integers(0, 6))]()
            lead = str(r.choice(["token = \"", "key: ", "secret=", "Authorization: Bearer ", "", ""]))
        else:
            body = [
                lambda: pick(syllables, int(r.integers(7, 16))),
                lambda: "-".join(word() for _ in range(5)),
                lambda: "_".join(word() for _ in range(5)),
                lambda: "/".join(word() for _ in range(6)),
                lambda: pick(digits, int(r.integers(16, 30))),
                lambda: str(r.choice(list("-=_/+"))) * n,
                lambda: str(r.choice(list(mixed))) * n,
                lambda: str(r.choice(list(mixed))) * (4 * n),
                lambda: pick([word() for _ in range(3)], n // 2),
                lambda: pick(groups, int(r.integers(6, 14))),
                lambda: pick(groups, int(r.integers(6, 14))).capitalize(),
                lambda: pick([word()], 8),
                lambda: pick(syllables, 10).upper(),
                lambda: f"/{word()}/{word()}/{r.integers(1990, 2030)}/{r.integers(10, 99)}/{word()}",
            ][int(r.integers(0, 14))]()
            lead = str(r.choice(["", "", "see ", "https://", "id "]))
        if len(body) < 16:
            body = body + pick(syllables, 9)
        before, after = prose(4) + " " + lead, str(r.choice(["\" ", " ", ". ", "\n"])) + prose(4)
        for line in windows(before + body + after, len(before), len(before) + len(body)):
            x.append(line)
            y.append(float(secret))
            owner.append(i)
    return x, np.array(y), np.array(owner)


def labelled_sample(docs: DataFrame, sample: int, text_col: str = "text") -> list[tuple[str, bool]]:
    """(window, label) of at most ``sample`` distinct windows of the texts' labelled candidates, of the smallest hashes."""

    def run(batches):
        for batch in batches:
            lines, labels = [], []
            for x in batch[0]:
                text = _text(x)
                for start, stop, found in candidates(text, rule_spans(text)):
                    if not found and not ORDINARY.fullmatch(text, start, stop):
                        continue
                    new = windows(text, start, stop)
                    lines += new
                    labels += [found] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(labels, pa.bool_())], ["line", "label"])

    found = docs.select(docs[text_col].cast("binary").alias("text")).mapInArrow(run, "line string, label boolean")
    rows = found.groupBy("line").agg(F.max("label").alias("label")).orderBy(F.xxhash64("line"), "line").limit(sample).collect()
    return [(r["line"], r["label"]) for r in rows]


def trained(examples: int = 3000, recall: float = 0.95, found: tuple[tuple[str, bool], ...] = ()) -> CharCNN:
    """The network: four fifths of the labelled findings, generated and ``found``, train it, the last fifth calibrates it."""
    lines, y, owner = labelled_candidates(examples)
    lines = lines + [line for line, _ in found]
    y = np.concatenate((y, [float(label) for _, label in found]))
    owner = np.concatenate((owner, examples + np.arange(len(found))))
    x = encoded(lines)
    held = owner % 5 == 4
    net = CharCNN()
    net.fit(x[~held], y[~held])
    net.calibrate(x[held], y[held], owner[held], recall)
    return net


def candidates(text: str, spans: list[tuple[int, int, str, int]]):
    """(start, stop, whether a rule found it) of each candidate; one pass over the text and its sorted spans."""
    at, reach = 0, -1
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][3])
            at += 1
        yield m.start(), m.end(), reach > m.start()


def find_spans(texts: list[str], net: CharCNN) -> list[list[tuple[int, int, str, int]]]:
    """All spans of each text; the candidates of a block are scored together."""
    found, lines, owners = [], [], []
    for i, text in enumerate(texts):
        spans = rule_spans(text)
        found.append(list(spans))
        for start, stop, _ in candidates(text, spans):
            new = windows(text, start, stop)
            lines += new
            owners += [(i, start, stop)] * len(new)
            if len(lines) > 4096:
                _score(net, lines, owners, found)
                lines, owners = [], []
    _score(net, lines, owners, found)
    return [sorted(set(x)) for x in found]


def _score(net: CharCNN, lines: list[str], owners: list[tuple[int, int, int]], found: list) -> None:
    if lines:
        p = net.probability(encoded(lines))
        for (i, start, stop), good in zip(owners, p >= net.threshold, strict=True):
            if good:
                found[i].append((start, 3, "net", stop))


def _text(x) -> str:
    raw = x.as_py()
    return "" if raw is None else raw.decode("utf-8", "replace")


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{stop}" for start, _, kind, stop in spans)


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = 3000, recall: float = 0.95, sample: int = 2000
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_net: one row per input row."""
    net = trained(examples, recall, tuple(labelled_sample(docs, sample, text_col)))
    net = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                all_spans = find_spans([_text(x) for x in part[1]], net.value)
                base = [[s for s in spans if s[1] < 3] for spans in all_spans]
                count = lambda rank, rows: pa.array([sum(s[1] == rank for s in r) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part[0],
                        count(0, base),
                        count(1, base),
                        count(2, base),
                        pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base], pa.string()),
                        pa.array([_joined(s) for s in all_spans], pa.string()),
                        count(3, all_spans),
                    ],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_net"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            *[T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")],
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
            T.StructField("n_net", T.LongType()),
        ]
    )
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text")).mapInArrow(run, schema)


def redact_secrets(
    docs: DataFrame, text_col: str = "text", mask: str = "[secret]", examples: int = 3000, recall: float = 0.95, sample: int = 2000
) -> DataFrame:
    """The documents with every span replaced by ``mask``; ``n_chars`` follows where the input has it."""
    net = trained(examples, recall, tuple(labelled_sample(docs, sample, text_col)))
    net = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf(T.StringType())
    def redact(texts):
        import pandas as pd

        out = []
        for at in range(0, len(texts), 256):
            part = texts.iloc[at : at + 256]
            values = [t if isinstance(t, str) else "" for t in part]
            for t, original, spans in zip(values, part, find_spans(values, net.value), strict=True):
                if not spans:
                    out.append(original)
                    continue
                pieces, last = [], 0
                for start, _, _, stop in spans:
                    if start >= last:
                        pieces += [t[last:start], mask]
                    last = max(last, stop)
                out.append("".join([*pieces, t[last:]]))
        return pd.Series(out, index=texts.index, dtype=object)

    rows = docs.withColumn(text_col, redact(docs[text_col]))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
