"""Secret scans: fixed rules plus a character convolutional network.

Rules find assignments, access keys and long hexadecimal runs. Every further
candidate (an unbroken token that they do not cover whole) and its surroundings go through a
small convolutional network in numpy, window by window; the highest score is calibrated on held-out
findings; the threshold is the highest that keeps the required recall there.
The network is trained on labelled findings made by ``labelled_findings`` from
a fixed seed, so every run has the same network.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

# The fixed rules.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
MIN_VALUE, MIN_ACCESS = 8, 16

#: A candidate: a token of 12 or more of these characters, at least one of them a letter or digit.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[+/_=-]*+[A-Za-z0-9])[A-Za-z0-9+/_=-]{12,}")
#: Characters of a token that the network sees at once, from one such window to the next, and of its surroundings.
WINDOW, STEP, AROUND = 48, 24, 20
LENGTH = AROUND + WINDOW + AROUND
ALPHABET = {c: i + 2 for i, c in enumerate(string.ascii_letters + string.digits + string.punctuation + " \n")}
CODES = len(ALPHABET) + 2
WIDTH, FILTERS, EMBED = 5, 24, 8
#: Of these, harmless words of the labelled findings are spelled.
ONSETS = "b br c ch cl d dr f fl g gr h j k kl l m n p pl pr qu r s sch sp st str t th tr v w z".split()
VOWELS = "a e i o u ai au ea ei eu ie io ou".split()
CODAS = ["", "", "", *"b ch ck d f ft g ght l ll m mp n nd ng nt p r rd rk rs rt s ss st t tz x".split()]
RECALL = 0.99


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the rules' matches in code points, by start and kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping windows that together hold every character of a token."""
    if end - start <= WINDOW:
        return [(start, end)]
    return [(at, at + WINDOW) for at in (*range(start, end - WINDOW, STEP), end - WINDOW)]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of a window and its surroundings, padded with 0."""
    out = np.zeros(LENGTH, np.int16)

    def put(at: int, piece: str) -> None:
        out[at : at + len(piece)] = [ALPHABET.get(c, 1) for c in piece]

    before = text[max(0, start - AROUND) : start]
    put(AROUND - len(before), before)
    put(AROUND, text[start:end])
    put(AROUND + WINDOW, text[end : end + AROUND])
    return out


def labelled_findings(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first windows of n tokens in surroundings, half of them secrets, as codes and labels."""
    found = findings(n, seed)
    return np.array([encode(text, *windows(start, end)[0]) for text, start, end, _ in found]), np.array([secret for *_, secret in found], float)


def findings(n: int, seed: int, digit_free: bool = False) -> list[tuple[str, int, int, bool]]:
    """n texts with a token's place in each, half of the tokens secrets (letters only if ``digit_free``)."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    alnum, upper, lower, digits = string.ascii_letters + string.digits, string.ascii_uppercase, string.ascii_lowercase, string.digits
    syllables = ["ti", "on", "er", "an", "the", "ing", "re", "st", "en", "be", "ver", "sch", "que", "ment", "os", "ra", "le", "au"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    secrets = [
        lambda: pick(alnum, rng.randint(20, 64)),
        lambda: pick(alnum + "+/", rng.choice([32, 40, 44])) + rng.choice(["", "=", "=="]),
        lambda: rng.choice(["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "pk_test_", "npm_"]) + pick(alnum, rng.randint(20, 40)),
        lambda: "eyJ" + pick(alnum + "_-", rng.randint(30, 80)),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: pick("0123456789abcdef", rng.randint(24, 40)),
        lambda: pick("0123456789ABCDEF", rng.randint(32, 64)),
        lambda: pick(upper + digits, rng.randint(20, 32)),
    ]
    letters = [lambda: pick(string.ascii_letters, rng.randint(20, 64)), lambda: pick(upper, rng.randint(24, 40)), lambda: pick(lower, rng.randint(24, 40))]
    harmless = [
        lambda: pick(digits, rng.randint(12, 20)),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}",
        lambda: "-".join(word() for _ in range(rng.randint(2, 5))) + f"-{rng.randint(1, 999)}",
        lambda: "/".join(word() for _ in range(rng.randint(2, 6))) + f"/{rng.randint(1, 99999)}",
        lambda: "_".join(word() for _ in range(rng.randint(2, 4))) + str(rng.randint(0, 99)),
        lambda: word() + word() + word() + word() + str(rng.randint(0, 99)),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(3, 5))) + str(rng.randint(0, 9)),
        lambda: "+" + pick(digits, rng.randint(11, 14)),
        lambda: "-".join(pick(digits, rng.choice([3, 4])) for _ in range(4)),
        lambda: "=" * rng.randint(10, 30) + str(rng.randint(0, 9)),
        lambda: f"version-{rng.randint(0, 20)}-{rng.randint(0, 20)}-{word()}",
        lambda: pick(lower, 3) + pick(digits, rng.randint(9, 14)),
    ]
    spelled = lambda: "".join(rng.choice(ONSETS) + rng.choice(VOWELS) + rng.choice(CODAS) for _ in range(rng.randint(4, 8)))
    plain = [
        spelled,
        lambda: spelled().capitalize(),
        lambda: spelled().upper(),
        lambda: (word() + word() + rng.choice([word, spelled])()).upper(),
        lambda: word() + word() + word() + word() + spelled(),
        lambda: rng.choice("-/_").join(rng.choice([word, spelled])() for _ in range(rng.randint(2, 6))),
        lambda: "".join(rng.choice([word, spelled])().capitalize() for _ in range(rng.randint(2, 4))),
        lambda: rng.choice(["//www-", "//", "/"]) + spelled() + "/" + spelled(),
        lambda: rng.choice("-=_") * rng.randint(4, 20) + spelled(),
    ]
    if digit_free:
        secrets, harmless = letters, plain
    found = []
    for k in range(n):
        secret = k % 2 == 0
        token = rng.choice(secrets if secret else harmless)()
        lead = " ".join(word() for _ in range(rng.randint(0, 4))) + rng.choice([" ", ": ", " = ", ' "', "(", "\n", "=", " key ", " id ", " no. ", " see "])
        text = lead + token + rng.choice([" ", ".", '"', ",", "\n", ")", ""]) + " ".join(word() for _ in range(rng.randint(0, 4)))
        found.append((text, len(lead), len(lead) + len(token), secret))
    return found


def joined_findings(n: int, seed: int) -> list[tuple[str, int, int, int, int, bool]]:
    """n long tokens (text, start, end, secret's start and end, secret): paths and values, half with a key somewhere in them."""
    rng, found = random.Random(seed), []
    for text, start, end, secret in findings(n, seed):
        pieces = [text[a:b] for text, a, b, other in findings(40, rng.randrange(1 << 30)) if not other and b - a <= 30]
        mark = rng.choice("///_-=")
        lead, tail = (mark.join(rng.choices(pieces, k=rng.randint(0, 6))) for _ in range(2))
        lead, tail = lead + mark if lead else "", mark + tail if tail else ""
        at = start + len(lead)
        whole = text[:start] + lead + text[start:end] + tail + text[end:]
        found.append((whole, start, at + end - start + len(tail), at, at + end - start, secret))
    return found


def training_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of tokens alone and of joined ones; positive where half a secret, or 16 characters, are in sight."""
    codes, labels = [], []
    alone = findings(n, seed) + findings(n, seed + 200, digit_free=True)
    tokens = [(text, a, b, a, b, secret) for text, a, b, secret in alone] + joined_findings(n // 2, seed + 100)
    for text, start, end, a, b, secret in tokens:
        for low, high in windows(start, end):
            shown = min(b, high + AROUND) - max(a, low - AROUND)
            if not secret or shown <= 0 or shown >= min(16, (b - a) / 2):
                codes.append(encode(text, low, high))
                labels.append(secret and shown > 0)
    return np.array(codes), np.array(labels, float)


class CharNetwork:
    """Embedding, one convolution, maximum and mean over the token, one linear unit."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (CODES, EMBED)),
            "kernel": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.1, 2 * FILTERS),
            "shift": np.zeros(1),
        }
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray):
        x = self.p["embed"][codes] * (codes > 0)[..., None]
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)
        flat = np.ascontiguousarray(windows.transpose(0, 1, 3, 2)).reshape(len(codes), -1, WIDTH * EMBED)
        hidden = np.maximum(flat @ self.p["kernel"] + self.p["bias"], 0)
        place = hidden.argmax(axis=1)
        top = np.take_along_axis(hidden, place[:, None, :], 1)[:, 0]
        pooled = np.concatenate([top, hidden.mean(axis=1)], axis=1)
        return flat, hidden, place, pooled, pooled @ self.p["out"] + self.p["shift"][0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[k : k + 512])[-1] for k in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probability that a candidate is a secret."""
        return 1 / (1 + np.exp(-(self.scale * self.logits(codes) + self.offset)))

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int, seed: int, rate: float = 0.01) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), 64):
                batch = order[at : at + 64]
                x = codes[batch]
                flat, hidden, place, pooled, logit = self._forward(x)
                slope = (1 / (1 + np.exp(-logit)) - labels[batch]) / len(batch)
                back = slope[:, None] * self.p["out"]
                grad = np.broadcast_to(back[:, None, FILTERS:] / hidden.shape[1], hidden.shape).copy()
                rows, filters = np.arange(len(batch))[:, None], np.arange(FILTERS)[None, :]
                grad[rows, place, filters] += back[:, :FILTERS]
                grad *= hidden > 0
                d_flat = (grad @ self.p["kernel"].T).reshape(len(batch), -1, WIDTH, EMBED)
                d_x = np.zeros((len(batch), x.shape[1], EMBED))
                for k in range(WIDTH):
                    d_x[:, k : k + d_flat.shape[1]] += d_flat[:, :, k]
                d_x *= (x > 0)[..., None]
                d_embed = np.zeros_like(self.p["embed"])
                np.add.at(d_embed, x, d_x)
                grads = {"embed": d_embed, "kernel": np.tensordot(flat, grad, ([0, 1], [0, 1])), "bias": grad.sum((0, 1)), "out": slope @ pooled, "shift": np.array([slope.sum()])}
                step += 1
                for name, g in grads.items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float) -> None:
        """Platt scaling on windows, and the highest threshold that keeps ``recall`` there."""
        logits = self.logits(codes)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(self.scale * logits + self.offset)))
            self.scale -= 0.05 * float(((p - labels) * logits).mean())
            self.offset -= 0.05 * float((p - labels).mean())
        self.set_threshold(self.probability(codes)[labels > 0], recall)

    def scores(self, tokens: list[tuple[str, int, int]]) -> np.ndarray:
        """Per token (text, start, end) the highest probability over its windows."""
        best = np.zeros(len(tokens))
        places = [(k, window) for k, (_, start, end) in enumerate(tokens) for window in windows(start, end)]
        for at in range(0, len(places), 4096):
            block = places[at : at + 4096]
            np.maximum.at(best, [k for k, _ in block], self.probability(np.array([encode(tokens[k][0], *window) for k, window in block])))
        return best

    def set_threshold(self, scores: np.ndarray, recall: float) -> None:
        """The highest threshold that keeps ``recall`` of secrets with these scores."""
        self.threshold = float(np.sort(scores)[int(np.floor((1 - recall) * len(scores)))])


def held_out_secrets(n: int, seed: int) -> list[tuple[str, int, int]]:
    """Secrets (text, start, end): alone, of letters only, and within long tokens."""
    alone = findings(n, seed) + findings(n // 4, seed + 200, digit_free=True)
    return [x[:3] for x in alone if x[3]] + [(x[0], x[3], x[4]) for x in joined_findings(n // 2, seed + 100) if x[5]]


@functools.lru_cache(maxsize=1)
def trained(n: int = 4000, epochs: int = 6, seed: int = 7, recall: float = RECALL) -> CharNetwork:
    """The network fitted on n findings and calibrated on n / 2 others."""
    net = CharNetwork(seed)
    net.fit(*training_windows(n, seed), epochs, seed)
    net.calibrate(*training_windows(n // 2, seed + 1), recall)
    net.set_threshold(secret_scores(held_out_secrets(n // 2, seed + 2), net), recall)
    return net


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens that the rules' spans do not cover whole."""
    found = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for _, start, end in base:
            if start <= at < end:
                at = end
        if at < m.end():
            found.append(m.span())
    return found


def secret_scores(found: list[tuple[str, int, int]], net: CharNetwork) -> np.ndarray:
    """Per secret (text, start, end) the score of what covers it in a scan: 1 for rules, the lowest of its candidates, 0 if some is no candidate."""
    out = np.ones(len(found))
    tokens = []
    for k, (text, start, end) in enumerate(found):
        base = rule_spans(text)
        free = set(range(start, end)) - {at for _, a, b in base for at in range(a, b)}
        for a, b in candidates(text, base):
            if free & set(range(a, b)):
                tokens.append((k, (text, a, b)))
                free -= set(range(a, b))
        if free:
            out[k] = 0.0
    np.minimum.at(out, [k for k, _ in tokens], net.scores([token for _, token in tokens]))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _found(texts: list[str], net: CharNetwork) -> list[tuple[list, list]]:
    """(rules' spans, all spans) of each text; the network sees all candidates at once."""
    base = [rule_spans(text) for text in texts]
    places = [(i, span) for i, text in enumerate(texts) for span in candidates(text, base[i])]
    spans = [list(b) for b in base]
    for (i, span), score in zip(places, net.scores([(texts[i], *span) for i, span in places]), strict=True):
        if score >= net.threshold:
            spans[i].append(("model", *span))
    return [(b, sorted(s, key=lambda x: (x[1], KINDS.index(x[0])))) for b, s in zip(base, spans, strict=True)]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_model.

    spans holds the rules' spans and those that the network adds (kind model)
    as kind:start:end in code points, by start and kind; base_sha256 is the
    digest of the rules' alone. Null and empty texts have no span, repeated
    rows and null ids are kept, other columns are ignored, an empty table
    gives an empty table. Texts are read whole, rows stay where they are.
    """
    net, kind = trained(), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = _found([x or "" for x in batch.column(1).to_pylist()], net)
                columns = [batch.column(0)]
                for name in KINDS[:3]:
                    columns.append(pa.array([sum(k == name for k, _, _ in base) for base, _ in found], pa.int64()))
                columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]))
                columns.append(pa.array([joined(spans) for _, spans in found], pa.string()))
                columns.append(pa.array([len(spans) - len(base) for base, spans in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_model bigint")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """``text`` with every stretch of overlapping spans replaced by ``mark``."""
    parts, at = [], 0
    for _, start, end in spans:
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows of ``docs`` with secrets in the text replaced by ``mark``.

    ``length_col``, if ``docs`` has it, becomes the new text's length in code
    points for rows whose text changed. Null texts stay null, repeated rows and
    null ids stay as they are, and an empty table gives an empty one.
    """
    net = trained()

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = _found([x or "" for x in texts], net)
            out = [None if t is None else redacted(t, spans, mark) for t, (_, spans) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.string()), pa.array([a != b for a, b in zip(texts, out, strict=True)])], names=["_row", "_new", "_changed"])

    packed = docs.select(F.col(text_col).alias("_old"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    schema = T.StructType([packed.schema["_row"], T.StructField("_new", T.StringType()), T.StructField("_changed", T.BooleanType())])
    rows = packed.mapInArrow(lean(run), schema)
    fresh = {text_col: F.col("_new")}
    if length_col in docs.columns:
        fresh[length_col] = F.when(F.col("_changed"), F.length("_new").cast(docs.schema[length_col].dataType)).otherwise(F.col("_row")[length_col])
    return rows.select(*(fresh.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
