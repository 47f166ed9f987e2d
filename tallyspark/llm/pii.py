"""Personal data: rule-based spans, and more by weak supervision.

Strict patterns give the base spans.  A wider net of candidates is voted on by labelers
(patterns, a gazetteer of cue words, context, shape), each of which may abstain.  Spark
counts how often each combination of votes and features occurs over the whole corpus;
expectation-maximisation estimates from these counts how reliable each labeler is, and a
logistic classifier is fitted to the estimated classes.  Candidates that it accepts and
that don't touch a base span are added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

# Base patterns.  Possessive quantifiers and the look-behinds only keep the time linear:
# a run of the first class always starts where the class starts.
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_ANY = re.compile(r"[0-9@]|(?i:password|passwd|pwd|secret|token|api_key)|AKIA|(?i:\bdot\b)")
_DIGIT = re.compile(r"[0-9]")
_WRITTEN_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,}+", re.I
)
_NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9][0-9()\x20./-]{5,}[0-9](?!\w)")
_SECRET = re.compile(r"(?i:password|passwd|pwd|secret|token|api_key)[\x20]?[=:][\x20]?[\"']?[^\s\"']{6,}+|(?<!\w)AKIA[0-9A-Z]{16}(?!\w)")
_OBVIOUS_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})\Z")

#: Cue words of the gazetteer, by the kind they speak for.
CUES = {
    "email": ("email", "e-mail", "mail", "correo", "courriel"),
    "phone": ("phone", "tel", "telephone", "telefon", "call", "mobile", "fax", "teléfono", "téléphone"),
    "card": ("card", "visa", "iban", "account", "karte", "tarjeta", "carte"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "api_key", "key", "passwort"),
}
#: Words before a number that speak against personal data.
PLAIN_CUES = ("version", "page", "chapter", "isbn", "section", "no", "figure", "seite")
_CUE_OF = {word: kind for kind, words in CUES.items() for word in words}

YES, NO, ABSTAIN = 1, 0, 2
LABELERS = ("pattern", "gazetteer", "context", "shape", "digits", "checksum", "mixture")
#: What labelers are expected to say (NO, YES, ABSTAIN) of other text and of personal data,
#: and the share of the corpus that this expectation counts as.
HOPE, HOPE_SHARE = np.array([[0.38, 0.02, 0.6], [0.02, 0.38, 0.6]]), 0.2
#: Candidates over this posterior are accepted.
ACCEPT = 0.5


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict spans by kind as listed, then by start; offsets in code points."""
    out: list[tuple[str, int, int]] = []
    end = 0
    if "@" in text:
        for m in _EMAIL_TAIL.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _EMAIL_LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append(("email", start, end))
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Wider net: ``kind, start, end, votes, features``, also of the base spans.

    ``votes`` holds one base-3 digit a labeler, ``features`` one bit a feature.
    """
    found = [(kind, a, b, True) for kind, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    wide = [("secret", *m.span()) for m in _SECRET.finditer(text)]
    if _DIGIT.search(text):
        wide += [("phone", *m.span()) for m in _NUMBER.finditer(text)]
    if re.search(r"dot", text, re.I):
        wide += [("email", *m.span()) for m in _WRITTEN_EMAIL.finditer(text)]
    last, i = 0, 0
    for kind, a, b in sorted(wide, key=lambda s: (s[1], -s[2])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= last and not (i < len(taken) and taken[i][0] < b):
            found.append((kind, a, b, False))
            last = b
    return [(kind, a, b, *_judge(text, kind, a, b, strict)) for kind, a, b, strict in found]


def _judge(text: str, kind: str, a: int, b: int, strict: bool) -> tuple[int, int]:
    span = text[a:b]
    digits, letters = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
    before = re.findall(r"[\w-]+", text[max(0, a - 40) : a].lower())[-3:]
    cue = next((_CUE_OF[w] for w in reversed(before) if w in _CUE_OF), None)
    inner = next((_CUE_OF[w] for w in re.findall(r"[a-z_]+", span.lower()) if w in _CUE_OF), None)
    plain = any(w in PLAIN_CUES for w in before)
    separated = bool(re.search(r"[0-9][ ().-]+[0-9]", span))
    date = bool(_OBVIOUS_DATE.match(span))
    groups = len(re.findall(r"[0-9]+", span))
    mixed = digits >= 4 and letters >= 4
    votes = (
        YES if strict else ABSTAIN,
        YES if inner or cue == kind else ABSTAIN,
        NO if plain else YES if cue else ABSTAIN,
        NO if kind == "phone" and (date or groups > 6) else YES if kind == "phone" and separated and 3 <= groups <= 5 and 9 <= digits <= 15 else ABSTAIN,
        NO if kind == "phone" and (digits < 8 or digits > 15) else ABSTAIN,
        NO if not strict and kind == "phone" and 13 <= digits <= 19 and groups == 1 else ABSTAIN,
        YES if kind == "secret" and mixed else ABSTAIN,
    )
    bits = [kind == k for k in KINDS] + [strict, bool(cue), bool(inner), plain, separated, date, mixed, digits >= 8, digits >= 10, digits > 15, 3 <= groups <= 5]
    code = 0
    for v in votes:
        code = 3 * code + v
    return code, sum(1 << i for i, bit in enumerate(bits) if bit)


N_FEATURES = len(KINDS) + 11


def _count_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int], int] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text and _ANY.search(text):
                for _, _, _, votes, features in candidates(text, base_spans(text)):
                    counts[votes, features] = counts.get((votes, features), 0) + 1
    rows = [(v, f, n) for (v, f), n in counts.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.int32(), pa.int64()))], ["votes", "features", "n"])


def vote_counts(docs: DataFrame) -> DataFrame:
    """``text`` -> ``votes, features, n``: how often each combination occurs in the corpus."""
    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(_count_votes, "votes int, features int, n long").groupBy("votes", "features").agg(F.sum("n").alias("n"))


def estimate_reliability(votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Expectation-maximisation of a two-class model with independent labelers.

    ``votes`` (combinations x labelers) in {NO, YES, ABSTAIN}, ``n`` occurrences.  Returns each
    combination's probability of personal data, each labeler's table of P(vote | class), and
    the penalised log-likelihood of each round, which never falls.  Abstaining is a vote like
    the others; the classes' share is estimated as well.  Dirichlet priors say which class is
    which: they count as ``HOPE_SHARE`` (tables) and one whole (share) of the corpus.
    """
    if not len(n):
        return np.empty(0), np.repeat(HOPE[None], votes.shape[1], 0), []
    total, labelers = n.sum(), votes.shape[1]
    extra = HOPE_SHARE * total * HOPE
    table, share, trace = np.repeat(HOPE[None], labelers, 0), 0.5, []
    for _ in range(rounds):
        joint = np.log([1 - share, share]) + sum(np.log(table[k][:, votes[:, k]]).T for k in range(labelers))
        either = np.logaddexp(joint[:, 0], joint[:, 1])
        post = np.exp(joint[:, 1] - either)
        trace.append(float((n * either).sum() + (extra * np.log(table)).sum() + total / 2 * np.log(share * (1 - share))))
        if len(trace) > 1 and trace[-1] - trace[-2] < 1e-10 * abs(trace[-1]):
            break
        weight = np.stack([n * (1 - post), n * post])
        counts = np.stack([[weight[:, votes[:, k] == v].sum(1) for v in (NO, YES, ABSTAIN)] for k in range(labelers)]).transpose(0, 2, 1)
        table = counts + extra
        table = table / table.sum(2, keepdims=True)
        share = (weight[1].sum() + total / 2) / (2 * total)
    return post, table, trace


def fit_span_classifier(features: np.ndarray, soft: np.ndarray, n: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weighted logistic regression on soft labels; weights and, last, the intercept."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    weight = n / max(n.sum(), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (soft - p)) - 1e-4 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _bits(features: np.ndarray) -> np.ndarray:
    return (features[:, None] >> np.arange(N_FEATURES) & 1).astype(float)


def train(docs: DataFrame) -> np.ndarray:
    """The span classifier's weights, learned from the votes on all of ``docs`` without labels.

    What reaches the driver is one row for each combination of votes and features: at most
    some thousands, whatever the size of the corpus.
    """
    rows = vote_counts(docs).orderBy("votes", "features").collect()
    if not rows:
        return np.zeros(N_FEATURES + 1)
    codes, features, n = (np.array([r[k] for r in rows], np.int64) for k in ("votes", "features", "n"))
    votes = np.stack([codes // 3 ** (len(LABELERS) - 1 - k) % 3 for k in range(len(LABELERS))], 1)
    post, _, _ = estimate_reliability(votes, n.astype(float))
    return fit_span_classifier(_bits(features), post, n.astype(float))


def find_spans(text: str | None, weights: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans; by kind, then by start."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    wide = candidates(text, base)[len(base) :]
    score = _bits(np.array([c[4] for c in wide], np.int64)) @ weights[:-1] + weights[-1] if wide else []
    more = [c[:3] for c, s in zip(wide, score) if s > np.log(ACCEPT / (1 - ACCEPT))]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span (of overlapping ones, their union) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def detect(docs: DataFrame, weights: np.ndarray, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text`` -> counts and digest of base spans, all spans, and the redacted text.

    Columns named in ``carry`` are handed through, after the others.
    Null text: no spans, and a null redacted text.  Empty text: no spans.  Rows are judged one
    by one, so repeated rows repeat; very long texts take linear time.
    """
    small_batches(docs.sparkSession)

    def write(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find_spans(text, weights) for text in texts]
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in BASE_KINDS]
            written = [write(base) for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *counts,
                    pa.array([hashlib.sha256(w.encode()).hexdigest() for w in written], pa.string()),
                    pa.array([write(every) for _, every in found], pa.string()),
                    pa.array([redact(text, every) if every else text for text, (_, every) in zip(texts, found)], pa.string()),
                    *batch.columns[2:],
                ],
                ["doc_id", *(f"n_{kind}" for kind in BASE_KINDS), "base_sha256", "spans", "redacted", *carry],
            )

    schema = StructType().add("doc_id", "long")
    for kind in BASE_KINDS:
        schema.add(f"n_{kind}", "long")
    schema.add("base_sha256", "string").add("spans", "string").add("redacted", "string")
    for field in docs.select(*carry).schema if carry else ():
        schema.add(field)
    return docs.select(F.col("doc_id").cast("long"), "text", *carry).mapInArrow(run, schema)


def find_personal_data(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Train on the votes over all of ``docs``, then :func:`detect`.

    Null text: no spans and a null redacted text; empty text: none.  Rows are judged one by one,
    so repeated rows and ids repeat, and a null doc_id stays null.  Texts of any length are read
    whole.  Only ``doc_id``, ``text`` and ``carry`` are read, whatever else the table holds.  An
    empty table gives an empty result.
    """
    return detect(docs, train(docs), carry)
