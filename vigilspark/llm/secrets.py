"""Secret scans (operator 4): fixed patterns, and two character Markov models compared by log-likelihood ratio.

The models, of random strings and of ordinary identifiers, hold first-order transitions between the characters of
tokens. They are trained from labelled samples. Random: made strings of seven alphabets, and what the patterns match in a
bounded sample of documents. Ordinary: the other tokens of those documents, but for long ones that mix digits and letters,
and identifiers joined from their words. A quarter of both is held out and sets the margin: the least ratio that at most
ALARMS of the held-out ordinary identifiers exceed. A candidate (16 or more token characters, outside the pattern spans)
is a secret if its ratio exceeds the margin.

Spans are code points, end exclusive. Defined cases: null text is empty and has no spans; a sample without any word
trains no model and adds no spans; a ratio of exactly the margin is no secret; a text of any length is scanned whole, in
time that grows with its length alone; rows that repeat and null ids are scanned each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, lean, row_key, scratch, stash

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
WIDTH = len(ALPHABET) + 1

#: At most about so many documents are sampled for training.
SAMPLE = 5000
#: Made random strings of each alphabet.
MADE = 1000
#: Share of held-out ordinary identifiers that may count as random, and the least log-likelihood ratio of a secret.
ALARMS, LEAST = 0.0005, 3
WORD = re.compile(r"[A-Za-z]{2,12}")
DIGITS, UPPER_CASE, LOWER_CASE = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of random strings: base64, its form for urls, letters and digits, of one case, and hexadecimal.
ALPHABETS = (
    UPPER_CASE + LOWER_CASE + DIGITS + "+/", UPPER_CASE + LOWER_CASE + DIGITS + "-_", UPPER_CASE + LOWER_CASE + DIGITS,
    LOWER_CASE + DIGITS, UPPER_CASE + DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF",
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches, leftmost and non-overlapping per kind, sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def transitions(tokens: list[str]) -> np.ndarray:
    """Counts of character pairs, with a boundary before each token."""
    at = np.zeros((WIDTH, WIDTH))
    for t in tokens:
        c = CODE[np.frombuffer(t.encode("ascii"), np.uint8)]
        np.add.at(at, (np.concatenate([[WIDTH - 1], c[:-1]]), c), 1)
    return at


def ratios(chance: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P(next | previous) under the random model minus under the ordinary one; transitions are smoothed towards
    each model's own character frequencies, those towards even ones."""

    def logs(n: np.ndarray) -> np.ndarray:
        single = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * WIDTH)
        return np.log((n + 8 * single) / (n.sum(axis=1, keepdims=True) + 8))

    return logs(chance) - logs(ordinary)


class Models(NamedTuple):
    """The log-likelihood ratios of transitions, the margin, and the held-out shares of random strings found and of
    ordinary identifiers found."""

    table: np.ndarray
    margin: float
    found: float
    alarms: float

    def score(self, token: str) -> float:
        c = CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
        return float(self.table[np.concatenate([[WIDTH - 1], c[:-1]]), c].sum())


def made_random(n: int, seed: int) -> list[str]:
    """Labelled samples of random strings: of each alphabet n, of 16 to 48 characters."""
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randrange(16, 49))) for letters in ALPHABETS for _ in range(n)]


def identifiers(text: str) -> list[str]:
    """Labelled samples of ordinary identifiers of a text: its longer tokens, but for those that mix digits and letters,
    and neighbouring words joined the ways identifiers are, every 16th with a number."""
    rest = list(text)
    for a, _, b in base_spans(text):
        rest[a:b] = " " * (b - a)
    rest = "".join(rest)
    out = [t for t in ORDINARY.findall(rest) if len(t) < 16 or not (any(map(str.isdigit, t)) and any(map(str.isalpha, t)))]
    words = WORD.findall(rest)
    for k in range(0, len(words) - 2, 8):
        w = words[k : k + 3]
        out += ["_".join(w).lower(), w[0].lower() + w[1].title() + w[2].title(), "-".join(w), f"{w[0]}/{w[1]}_{k % 2100}" if k % 16 else "_".join(w).upper()]
    return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Models | None:
    """Both models and the margin, by two small aggregates over the sampled documents: those of three in four sampled
    documents and made strings train the models, the others' set the margin."""
    with scratch(docs.sparkSession):
        total = in_small_batches(docs).count()
        key = row_key()
        chosen = docs.select(F.pmod(F.xxhash64("text"), F.lit(4)).alias("part"), F.col("text").alias("text"), key.alias("_key")).where("text is not null")
        chosen = stash(chosen.where(F.pmod("_key", F.lit(1 << 20)) < min(1.0, sample / max(1, total)) * (1 << 20)).select("part", "text"), "secret-sample")

        def count(batches):
            values, ordinary = np.zeros((WIDTH, WIDTH)), np.zeros((WIDTH, WIDTH))
            for pdf in batches:
                for text in pdf["text"]:
                    spans = [ASSIGN.match(text, a)[2] if kind == 0 else text[a:b] for a, kind, b in base_spans(text)]
                    values += transitions([v.replace(".", "") for v in spans])
                    ordinary += transitions(identifiers(text))
            cells = np.flatnonzero(values + ordinary)
            yield pd.DataFrame({"cell": cells, "random": values.ravel()[cells], "ordinary": ordinary.ravel()[cells]})

        counts = chosen.where("part > 0").select("text").mapInPandas(lean(count), "cell int, random double, ordinary double")
        counts = counts.groupBy("cell").agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary")).toPandas()
        both = np.zeros((2, WIDTH * WIDTH))
        both[0, counts["cell"]], both[1, counts["cell"]] = counts["random"], counts["ordinary"]
        if not both[1].any():
            return None
        table = ratios(both[0].reshape(WIDTH, WIDTH) + transitions(made_random(MADE, 1)), both[1].reshape(WIDTH, WIDTH))
        model = Models(table, 0.0, 0.0, 0.0)

        def rate(batches):
            for pdf in batches:
                tokens = [t for text in pdf["text"] for t in identifiers(text) if len(t) >= 16]
                yield pd.DataFrame({"score": np.ceil([model.score(t) for t in tokens]).astype(np.int64)}).groupby("score").size().rename("n").reset_index()

        held = chosen.where("part = 0").select("text").mapInPandas(rate, "score long, n long").groupBy("score").agg(F.sum("n").alias("n")).toPandas()
    held = held.sort_values("score", ascending=False)
    above = held["n"].cumsum() / max(1, held["n"].sum())
    margin = max([LEAST, *held["score"][above > ALARMS].head(1)])
    caught = np.array([model.score(t) for t in made_random(MADE, 2)]) > margin
    return Models(table, float(margin), float(caught.mean()), float(held["n"][held["score"] > margin].sum() / max(1, held["n"].sum())))


def all_spans(text: str, base: list[tuple[int, int, int]], model: Models | None) -> list[tuple[int, int, int]]:
    """The base spans, and the candidates outside them that the models call random."""
    added, taken, k = [], [], 0
    for a, _, b in base:  # base spans by start, overlapping ones as one
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    if model is not None:
        for m in TOKEN.finditer(text):
            a, b = m.span()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if (k == len(taken) or b <= taken[k][0]) and model.score(m[0]) > model.margin:
                added.append((a, 3, b))
    return sorted(base + added)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches):
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["_id"], pdf["_text"], strict=True):
                base = base_spans(text)
                spans = all_spans(text, base, model.value)
                n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((key, *n[:3], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), n[3]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).mapInPandas(lean(run), schema)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of text (overlapping ones as one) replaced by mark; other texts stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            spans = all_spans(text, base_spans(text), model.value) if text else []
            parts, at = [], 0
            for a, _, b in spans:
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]) if parts else text)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", clean("text"))
