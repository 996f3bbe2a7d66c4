"""Personal data: exact base patterns, and further spans from a linear-chain conditional random field.

The field labels white-space words with B-/I- tags of four kinds or O. Its features are word shapes and what stands
beside a word; its weights are trained here from a small labelled table (sentences made from templates), by gradient
descent on the regularised likelihood; it is decoded by Viterbi in numpy, all windows of a block at a time. A word
without a digit or @ can only be O, so words further than two from any such word cannot change a label and are left out
of the windows; a window is as long as its words stand together, and is never cut. Spans that it adds never overlap base spans, and must pass their kind's arithmetic (digit counts, parts,
the check digit).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import map_rows, table, text_blocks

KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns' matches, leftmost and non-overlapping within a kind, in order."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if text.count(".") >= 3:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


#: Words beside which a kind is likely; a feature, not a rule.
CUES = {
    "email": {"email", "e-mail", "mail", "correo", "courriel", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "login", "adresse"},
    "card": {"card", "visa", "mastercard", "carte", "karte", "tarjeta", "payment", "charged"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "cell", "dial"},
    "money": {"$", "€", "usd", "eur", "price", "cost", "paid", "total", "invoice", "order", "no.", "#", "version", "v", "page", "chapter", "id"},
}
_SHAPE = re.compile(r"([0-9]+)|([A-Za-z]+)|([^\W\d_]+)|(.)", re.S)
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Words that are decoded side by side, and how many of a window's words are scored at a time: they bound memory only.
TOGETHER, STEP = 1 << 17, 1024
_STRIP = "()[]{}<>\"'`.,;:!?*#$%&|=_"


def shape(word: str) -> str:
    """Runs of digits as their length (up to 9, then 9+), of letters as a, other characters as they are."""
    return "".join((str(len(m[1])) if len(m[1]) < 10 else "9+") if m[1] else "a" if m[2] or m[3] else m[4] for m in _SHAPE.finditer(word))


def features(words: list[str]) -> list[list[str]]:
    """The features of each word of a sentence or window; words without a digit or @ have none, being O."""
    cue = [next((k for k, some in CUES.items() if w.lower().strip(_STRIP) in some or w in some), "") for w in words]
    signed = [bool(_SIGN.search(w)) for w in words]
    shapes = [shape(w.strip(_STRIP)) if s else "" for w, s in zip(words, signed, strict=True)]
    out = []
    for i, w in enumerate(words):
        if not signed[i]:
            out.append([])
            continue
        d = _NOT_DIGIT.sub("", w)
        f = ["bias", f"shape={shapes[i]}", f"digits={min(len(d), 20)}", f"dots={min(w.count('.'), 4)}", f"at={'@' in w}", f"plus={w[:2].find('+') >= 0}", f"paren={'(' in w}", f"dash={min(w.count('-'), 3)}"]
        if 12 <= len(d) <= 19:
            f.append(f"luhn={luhn(d)}")
        f.append(f"letters={bool(re.search('[A-Za-z]', w))}")
        for step in (-2, -1, 1):
            k = i + step
            if 0 <= k < len(words):
                f.append(f"cue{step}={cue[k]}")
                if abs(step) == 1:
                    f.append(f"near{step}={shapes[k]}")
        out.append(f)
    return out


def labelled_table(seed: int = 11, rows: int = 900) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: (words, tags) of sentences made from templates, with look-alikes labelled O."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card() -> str:
        d = digits(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"+{digits(11)}")

    def ip() -> str:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))

    def email() -> str:
        name = pick("anna", "j.smith", "info", "sales", "k")
        return pick(f"{name}.{digits(2)}@mail{digits(1)}.example.com", f"{name}@example.org", f"{name}{digits(2)}@localhost", f"{name}+x@example.net")

    fill = ["the", "and", "of", "la", "und", "que", "then", "was", "here", "today", "les", "para", "it"]
    ends = ["", "", "", ".", ",", ";", "***", "$$$"]
    out = []
    for _ in range(rows):
        words, tags = [], []

        def say(text: str, kind: str = "") -> None:
            for i, w in enumerate(text.split()):
                words.append(w)  # noqa: B023
                tags.append(f"{'B' if i == 0 else 'I'}-{kind}" if kind else "O")  # noqa: B023

        for _ in range(rng.integers(1, 4)):
            say(" ".join(pick(*fill) for _ in range(rng.integers(1, 4))))
            what = rng.integers(0, 12)
            end = pick(*ends)
            if what < 2:
                say(pick("", "", "card", "visa", "tarjeta"))
                c = card()
                if rng.random() < 0.4:  # two in a row
                    say(c, "card")
                    c = card()
                say(pick(c, f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}") + end, "card")
            elif what < 4:
                say(pick("", "", "call", "tel", "phone", "fax", "telefon"))
                say(phone() + end, "phone")
            elif what == 4:
                say(pick("", "ip", "server", "host"))
                say(ip() + end, "ip")
            elif what == 5:
                say(pick("", "mail", "email", "contact"))
                say(email() + end, "email")
            else:  # look-alikes
                d = digits(15)
                bad = d + next(c for c in "0123456789" if not luhn(d + c))
                fake = pick(f"{rng.integers(1, 20)}.{rng.integers(0, 10)}", f"{rng.integers(1900, 2100)}", f"${rng.integers(1, 999)},{digits(3)}.{digits(2)}", bad, bad, f"{rng.integers(1, 32):02d}/{rng.integers(1, 13):02d}/{rng.integers(1990, 2030)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", digits(rng.integers(1, 12)), digits(rng.integers(20, 30)), f"{rng.integers(1, 100)}%", f"{pick('@home', '@you', 'a@', '@')}", "".join(pick(*"0123456789abcdef") for _ in range(40)), f"{digits(3)}-{digits(2)}")
                say(pick("", "order", "page", "version", "no."))
                say(fake + end)
        out.append((words, tags))
    return out


@dataclass
class ChainField:
    """weights: a row of tag scores per feature; steps: scores of a tag after a tag; first: of a window's first tag."""

    index: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[list[str], list[str]]], rounds: int = 120, rate: float = 0.4, ridge: float = 0.02) -> ChainField:
        """Full-batch gradient descent with per-weight rates; the gradient is observed minus expected feature counts."""
        made = [features(words) for words, _ in rows]
        names = sorted({f for sentence in made for word in sentence for f in word})
        index = {f: i for i, f in enumerate(names)}
        n, length, k = len(rows), max(len(w) for w, _ in rows), len(TAGS)
        truth, mask = np.zeros((n, length), int), np.zeros((n, length), bool)
        free = np.zeros((n, length), bool)
        where, which = [], []
        for i, (sentence, (_, tags)) in enumerate(zip(made, rows, strict=True)):
            mask[i, : len(tags)] = True
            truth[i, : len(tags)] = [TAGS.index(t) for t in tags]
            for t, word in enumerate(sentence):
                free[i, t] = bool(word)
                where += [i * length + t] * len(word)
                which += [index[f] for f in word]
        where, which = np.array(where), np.array(which)
        model = cls(index, np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k))
        seen = [np.full_like(x, 1e-8) for x in (model.weights, model.steps, model.first)]
        hot = np.eye(k)[truth]
        pairs = mask[:, 1:]
        for _ in range(rounds):
            node = np.zeros((n * length, k))
            np.add.at(node, where, model.weights[which])
            node = node.reshape(n, length, k)
            node[~free] = [0] + [-1e4] * (k - 1)
            alpha, beta = np.zeros_like(node), np.zeros_like(node)
            alpha[:, 0] = model.first + node[:, 0]
            for t in range(1, length):
                alpha[:, t] = np.where(mask[:, t, None], node[:, t] + _log_sum(alpha[:, t - 1, :, None] + model.steps, 1), alpha[:, t - 1])
            for t in range(length - 2, -1, -1):
                beta[:, t] = np.where(mask[:, t + 1, None], _log_sum(model.steps + (node[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
            total = _log_sum(alpha[:, -1], 1)
            node_p = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
            step_p = np.exp(alpha[:, :-1, :, None] + model.steps + (node[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[..., None, None]
            gap = ((hot - node_p) * mask[..., None]).reshape(n * length, k)
            grown = np.zeros_like(model.weights)
            np.add.at(grown, which, gap[where])
            step_seen = np.einsum("nti,ntj->ij", hot[:, :-1] * pairs[..., None], hot[:, 1:])
            for value, up, old in zip((model.weights, model.steps, model.first), (grown, step_seen - step_p.sum((0, 1)), (hot[:, 0] - node_p[:, 0]).sum(0)), seen, strict=True):
                up = up - ridge * value
                old += up * up
                value += rate * up / np.sqrt(old)
        return model

    def decode(self, windows: list[list[str]]) -> list[list[str]]:
        """The likeliest tags of each window, by Viterbi; windows of like length go through together."""
        out: list[list[str]] = [[] for _ in windows]
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        at = 0
        while at < len(order):
            length = len(windows[order[at]])
            group = [i for i in order[at : at + max(1, TOGETHER // max(length, 8))] if len(windows[i]) <= max(length, 8) + 8]
            at += len(group)
            self._viterbi(windows, group, out)
        return out

    def _scores(self, windows: list[list[str]], group: list[int], start: int, end: int) -> np.ndarray:
        """The tag scores of the group's words from start to end."""
        node = np.zeros((len(group), end - start, len(TAGS)))
        node[..., 1:] = -1e4
        before = max(0, start - 2)  # features look at two words before and one after
        for row, i in enumerate(group):
            for t, word in enumerate(features(windows[i][before : end + 1])[start - before : end - before]):
                if word:
                    node[row, t] = self.weights[[self.index[f] for f in word if f in self.index]].sum(0)
        return node

    def _viterbi(self, windows: list[list[str]], group: list[int], out: list[list[str]]) -> None:
        length, k = max(len(windows[i]) for i in group), len(TAGS)
        back = np.zeros((len(group), length, k), np.int8)
        ends = np.array([len(windows[i]) for i in group])
        best = self.first
        for start in range(0, length, STEP):
            node = self._scores(windows, group, start, min(length, start + STEP))
            for t in range(start, min(length, start + STEP)):
                if t == 0:
                    best = self.first + node[:, 0]
                    continue
                score = best[:, :, None] + self.steps
                back[:, t] = score.argmax(1)
                best = np.where((t < ends)[:, None], score.max(1) + node[:, t - start], best)
        tag = best.argmax(1)
        tags = np.zeros((len(group), length), np.int8)
        rows = np.arange(len(group))
        for t in range(length - 1, -1, -1):
            inside = t < ends
            tags[inside, t] = tag[inside]
            if t:
                tag = np.where(inside, back[rows, t, tag], tag)
        for row, i in enumerate(group):
            out[i] = [TAGS[x] for x in tags[row, : ends[row]]]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _word_before(text: str, at: int, least: int) -> tuple[int, int] | None:
    """Bounds of the last word before `at` that begins at `least` or later."""
    while at > least and text[at - 1].isspace():
        at -= 1
    start = at
    while start > least and not text[start - 1].isspace():
        start -= 1
    return (start, at) if start < at else None


def windows_of(text: str) -> list[list[tuple[int, int]]]:
    """Bounds of the words of each window: words with a digit or @, and two words before and one after each."""
    found: list[tuple[int, int]] = []
    at = 0
    while m := _SIGN.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _WORD.match(text, m.start()).end()
        found.append((start, end))
        at = end
    out: list[list[tuple[int, int]]] = []
    for start, end in found:
        last = out[-1][-1][1] if out else 0
        before, reach = [], start
        while len(before) < 2 and (word := _word_before(text, reach, last)):
            before.append(word)
            reach = word[0]
        if out and not text[last:reach].strip():
            out[-1] += [*reversed(before), (start, end)]
        else:
            out.append([*reversed(before), (start, end)])
    for window in out:
        after = _WORD.search(text, window[-1][1])
        if after:
            window.append(after.span())
    return out


def _added(text: str, window: list[tuple[int, int]], tags: list[str]) -> Iterator[tuple[int, int, int]]:
    at = 0
    while at < len(tags):
        if tags[at][0] != "B":
            at += 1
            continue
        kind, last = tags[at][2:], at
        while last + 1 < len(tags) and tags[last + 1] == f"I-{kind}":
            last += 1
        start, end = window[at][0], window[last][1]
        at = last + 1
        keep = "+(" if kind == "phone" else ""
        while start < end and not text[start].isalnum() and text[start] not in keep:
            start += 1
        while start < end and not text[end - 1].isalnum():
            end -= 1
        body = text[start:end]
        d = _NOT_DIGIT.sub("", body)
        right = {
            "email": bool(re.fullmatch(r"[^\s@]+@[^\s@]+", body)),
            "ip": bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", body)) and all(map(_small, body.split("."))),
            "card": 12 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9 -]+", body)),
            "phone": 9 <= len(d) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][ ().0-9-]+", body)),
        }[kind]
        if right:
            yield start, KINDS.index(kind), end


def find_all(texts: list[str], field: ChainField) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text; spans are (start, kind's number, end) in code points."""
    base = [base_spans(t) if _SIGN.search(t) else [] for t in texts]
    spots = [windows_of(t) if _SIGN.search(t) else [] for t in texts]
    flat = [[texts[i][a:b] for a, b in w] for i, some in enumerate(spots) for w in some]
    tags = iter(field.decode(flat))
    out = []
    for text, sure, some in zip(texts, base, spots, strict=True):
        spans = list(sure)
        for window in some:
            for start, kind, end in _added(text, window, next(tags)):
                if all(end <= a or start >= b for a, _, b in spans):
                    spans.append((start, kind, end))
        out.append((sure, sorted(spans)))
    return out


@cache
def trained() -> ChainField:
    """The field that the queries use, fitted once a session on its table of sentences."""
    return ChainField.fit(labelled_table())


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, field: ChainField | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans, n_added.

    Null and empty texts have no spans (base_sha256 is that of the empty string). An empty table gives an empty result;
    other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, chars=2_000_000):
            found = find_all([t or "" for t in batch.column("text").to_pylist()], shared.value)
            counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(4)]
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([listed(s) for _, s in found], pa.string()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([len(s) - len(b) for b, s in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in capitals and brackets; of overlapping spans the union is replaced once."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def stage_pii(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with all spans of personal data replaced in text; n_chars follows if it is there."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, chars=2_000_000):
            texts = batch.column("text").to_pylist()
            found = find_all([t or "" for t in texts], shared.value)
            new = [t if t is None else redact(t, s) for t, (_, s) in zip(texts, found, strict=True)]
            columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(new, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([old if t is None else len(t) for t, old in zip(new, columns["n_chars"].to_pylist(), strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_rows(docs, run)
