"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides (op8)."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import table

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only start at the first digit of a run, so runs of digits are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Wider candidates of the method. Numbers with and without a plus sign, in the groups that people write.
_PLUS = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9])")
_NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![\w-])")
#: Addresses with the signs spelt out, four numbers within longer dotted runs, and addresses of eight hexadecimal groups.
_AT = re.compile(r"[\[({]at[\])}]\s?[A-Za-z0-9-]{2,40}(?:\s?[\[({]dot[\])}]\s?[A-Za-z0-9-]{2,20})+", re.I)
_NAME = re.compile(r"[A-Za-z0-9_%+-]{2,40}(?:\.[A-Za-z0-9_%+-]{1,40})*")
#: Signs of a local part before a spelt sign, at most; mail systems allow 64.
_LOCAL_SIGNS = 64
_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")
_COLONS = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![\w:])")
_GROUP = re.compile(r"[0-9]++")

#: Words before a span that name its kind, and words that speak against one.
_NAMED = {
    "email": ("mail", "contact", "write to", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "login from"),
    "card": ("card", "visa", "mastercard", "amex", "carte", "tarjeta", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "sms", "telefon", "portable"),
}
_AGAINST = ("version", "isbn", "issn", "order", "invoice", "page", "chapter", "section", "figure", "table", "no.", "id", "$", "#", "ref")
#: The generic domains of the first rounds of delegation (those of two letters are countries').
_TOP_LEVEL = frozenset("com org net edu gov int mil arpa info biz name pro aero coop museum jobs mobi travel tel cat asia post app dev blog shop online site xyz".split())
#: Card networks' ranges of first digits and the lengths of their numbers, as the networks publish them under ISO/IEC 7812.
_ISSUERS = (
    ("2200", "2204", 16, 19), ("2221", "2720", 16, 16), ("300", "305", 14, 19), ("3095", "3095", 14, 19), ("34", "34", 15, 15), ("3528", "3589", 16, 19), ("36", "36", 14, 19), ("37", "37", 15, 15), ("38", "39", 14, 19),
    ("4", "4", 13, 19), ("50", "50", 12, 19), ("51", "55", 16, 16), ("56", "59", 12, 19), ("60", "69", 12, 19), ("81", "82", 16, 19),
)
#: Country codes that are assigned, as ranges (ITU-T E.164).
_CALLING = "1 7 20 211-213 216 218 220-258 260-269 27 290-291 297-299 30-34 350-359 36 370-379 380-383 385-387 389 39-41 420-421 423 43-49 500-509 51-58 590-599 60-66 670 672-679 680-683 685-692 800 808 81-82 84 850 852-853 855-856 86 870 878 880-883 886 888 90-95 960-968 970-977 979 98 992-996 998"
_CODES = frozenset(str(n) for part in _CALLING.split() for n in range(int(part.split("-")[0]), int(part.split("-")[-1]) + 1))
#: Networks that no host of the public internet has (IANA's registry of special addresses): this network, loopback, documentation, benchmarks, multicast and beyond.
_SPECIAL = (((0,), 8), ((127,), 8), ((192, 0, 2), 24), ((198, 18), 15), ((198, 51, 100), 24), ((203, 0, 113), 24), ((224,), 3))
#: Votes: 1 for, 0 against, 2 none.
LABELERS = ("regex", "arithmetic", "context", "gazetteer", "neighbours")
#: Before any text is seen, the labelers are taken to vote for so many of the false and of the true spans, as if so many had been seen.
FOR = ((0.3, 0.2, 0.2, 0.4, 0.6), (0.7, 0.98, 0.8, 0.8, 0.8))
SEEN = (4.0, 20.0)
#: Added spans need this probability from the classifier.
SURE = 0.9


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(number: str) -> bool:
    """Whether decimal digits, however many zeros lead, are 255 at most."""
    number = number.lstrip("0")
    return len(number) < 3 or len(number) == 3 and number <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points: leftmost non-overlapping matches per kind that pass its test."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        # the local part is the whole run of its characters before the sign
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        nxt = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            floor = nxt = m.end()
        at = text.find("@", nxt)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_octet, m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _number_groups(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts of a run of digits, blanks and hyphens that could be a card: a group of 13 to 19 digits, or 4-4-4-4, or 4-6-5."""
    at = [(m.start(), m.end()) for m in _GROUP.finditer(text, start, end)]
    sizes = [e - s for s, e in at]
    k = 0
    while k < len(at):
        n = 1 if 13 <= sizes[k] <= 19 else 4 if sizes[k : k + 4] == [4, 4, 4, 4] else 3 if sizes[k : k + 3] == [4, 6, 5] else 0
        if n:
            yield at[k][0], at[k + n - 1][1]
        k += max(n, 1)


def _spelt(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with the signs spelt out: each spelt sign is found first, then its local part by walking back over a bounded run."""
    for m in _AT.finditer(text):
        end = m.start() - (m.start() > 0 and text[m.start() - 1].isspace())
        start = end
        while start > 0 and end - start <= _LOCAL_SIGNS and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        whole = start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_")
        if whole and end - start <= _LOCAL_SIGNS and _NAME.fullmatch(text, start, end):
            yield start, m.end()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, is base): base spans, and wider matches that touch none of them.

    The wider ones are what the base patterns pass over: the numbers inside a run that fails as a whole (a card behind
    another number, a telephone number before one), numbers without a plus sign, addresses spelt out or in
    hexadecimal groups. Of wider ones that overlap the leftmost stays, cards before telephone numbers.
    """
    out = [(s, k, e, True) for s, k, e in base]
    wider = []
    if ("[" in text or "(" in text or "{" in text) and "at" in text.lower():
        wider += [(s, 0, e) for s, e in _spelt(text)]
    if _DIGIT.search(text):
        wider += [(m.start(), 1, m.end()) for m in _QUAD.finditer(text)]
        if ":" in text:
            wider += [(m.start(), 1, m.end()) for m in _COLONS.finditer(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                wider += [(s, 2, e) for s, e in _number_groups(text, m.start(), m.end())]
        if "+" in text:
            wider += [(m.start(), 3, m.end()) for m in _PLUS.finditer(text)]
        wider += [(m.start(), 3, m.end()) for m in _NUMBER.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 13]
    if wider:
        taken = sorted((s, e) for s, _, e in base)
        i, reach, top = 0, -1, -1
        for s, k, e in sorted(wider):
            while i < len(taken) and taken[i][0] < e:
                top = max(top, taken[i][1])
                i += 1
            if s >= reach and top <= s:
                out.append((s, k, e, False))
                reach = e
    return out


def _is_special(groups: list[str]) -> bool:
    """Whether four numbers lie in one of the networks that no public host has."""
    address = 0
    for g in groups[:4]:
        address = address << 8 | min(int(g.lstrip("0")[:4] or 0), 255)
    for first, bits in _SPECIAL:
        net = int.from_bytes(bytes((*first, 0, 0, 0, 0)[:4]))
        if address >> (32 - bits) == net >> (32 - bits):
            return True
    return False


def _gazetteer(kind: int, value: str, groups: list[str]) -> int:
    """Whether the value stands in the table for its kind: domains, public networks, card ranges with lengths, country codes."""
    digits = "".join(groups)
    if kind == 0:
        last = re.split(r"[.@\s\[\](){}]+", value.lower().rstrip("])} "))[-1]
        return int(last in _TOP_LEVEL or len(last) == 2 and last.isalpha())
    if kind == 1:
        return 2 if ":" in value else int(not _is_special(groups))
    if kind == 2:
        return int(any(low <= digits[: len(low)] <= high and a <= len(digits) <= b for low, high, a, b in _ISSUERS))
    if not value.startswith("+"):
        return 2
    return int(any(digits[:n] in _CODES for n in (1, 2, 3)))


def votes(text: str, span: tuple[int, int, int, bool]) -> tuple[str, str]:
    """(votes, form) of a candidate: the kind and a digit for each labeler; the kind and the classifier's discrete features.

    The regex labeler votes for base spans and against others, which its patterns pass over. The others judge by the kind's arithmetic (check digit,
    numbers up to 255, how many digits), by words before the span, by lists of known beginnings and ends, and by the characters beside it.
    """
    start, kind, end, is_base = span
    value, name = text[start:end], KINDS[kind]
    before, beside = text[max(0, start - 32) : start].lower(), text[max(0, start - 1) : start] + text[end : end + 1]
    groups = _GROUP.findall(value)
    digits = "".join(groups)
    sizes = [len(g) for g in groups]
    if kind == 0:
        shape, structure = int("@" in value), int("@" not in value or value[0] not in ".-" and ".." not in value)
    elif kind == 1:
        shape = 1
        structure = int(":" in value or len(groups) == 4 and all(map(_octet, groups)))
    elif kind == 2:
        shape, structure = int(len(groups) == 1 or sizes in ([4, 4, 4, 4], [4, 6, 5])), int(_luhn(digits))
    else:
        shape, structure = int(value[0] == "+"), int(10 <= len(digits) <= 15 if value[0] == "+" else 9 <= len(digits) <= 11 and sizes[-1] != 2)
    context = 1 if any(w in before for w in _NAMED[name]) else 0 if any(w in before[-10:] for w in _AGAINST) else 2
    # a point between digits goes on with the number, one at a sentence's end does not
    longer = bool(re.match(r"[.:,][0-9]", text[end : end + 2]) or re.search(r"[0-9][.:,]\Z", text[max(0, start - 2) : start]))
    neighbours = int(not (longer or re.search(r"[\w=/$#%+-]", beside)))
    gazetteer = _gazetteer(kind, value, groups)
    form = f"{kind}{shape}{structure}{context}{gazetteer}{neighbours}{min(len(digits) // 2, 9)}{min(len(groups), 9)}{int('(' in value)}"
    return f"{kind}{int(is_base)}{structure}{context}{gazetteer}{neighbours}", form


def vote_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(votes, form, n) over all candidates of all texts; batches are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for v in batch.column(0):
                t = v.as_py() or ""
                seen.update(votes(t, c) for c in candidates(t, base_spans(t)))
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["votes", "form", "n"])

    return docs.select(text).mapInArrow(run, "votes string, form string, n long").groupBy("votes", "form").agg(F.sum("n").alias("n"))


def fit_labelers(patterns: list[tuple[str, float]], rounds: int = 500) -> tuple[float, np.ndarray]:
    """(prior, share[truth, labeler] of votes for) by expectation-maximisation over counted vote patterns of one kind.

    All five labelers vote and all are measured, the regex labeler too: no span is taken to be true beforehand, base spans are weighed by the votes on them like all
    others. A missing vote says nothing. Counts have those of FOR and SEEN added, so truth keeps its meaning where all spans vote alike.
    The number of patterns is bounded by 3 to the number of labelers.
    """
    v = np.array([[int(c) for c in p] for p, _ in patterns])
    n = np.array([float(x) for _, x in patterns])
    prior, share = 0.5, np.array(FOR)
    post = np.array([posterior(p, prior, share) for p, _ in patterns])
    for _ in range(rounds):
        prior = float((n * post).sum() + 2) / (n.sum() + 4)
        for truth, weight in enumerate((n * (1 - post), n * post)):
            for j in range(share.shape[1]):
                share[truth, j] = (weight[v[:, j] == 1].sum() + SEEN[truth] * FOR[truth][j]) / (weight[v[:, j] != 2].sum() + SEEN[truth])
        new = np.array([posterior(p, prior, share) for p, _ in patterns])
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return prior, share


def posterior(pattern: str, prior: float, share: np.ndarray) -> float:
    """Probability of personal data from the votes on one span."""
    score = math.log(prior / (1 - prior))
    for j, c in enumerate(pattern):
        if c != "2":
            no, yes = share[0, j], share[1, j]
            score += math.log(yes / no) if c == "1" else math.log((1 - yes) / (1 - no))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, score))))


def _features(form: str) -> list[int]:
    """Places of the ones: a constant for the kind, and each feature's value within the kind."""
    kind, places = int(form[0]), len(form)
    return [kind * places * 10, *(kind * places * 10 + j * 10 + int(c) for j, c in enumerate(form[1:], 1))]


class SpanModel:
    """A logistic classifier of spans by their form. Without weights it is sure of nothing."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights

    def probability(self, form: str) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.weights[_features(form)].sum(), -30, 30))))


def train_spans(counts: list[tuple[str, str, float]]) -> SpanModel:
    """The span classifier: logistic regression by form on the EM posteriors as soft labels.

    Works on the counted (votes, form) cells of the whole corpus, whose number is bounded by the
    digits of the two keys. Reliabilities are estimated for each kind. Without candidates the model is sure of nothing.
    """
    if not counts:
        return SpanModel()
    by: dict[str, Counter] = {}
    for v, _, n in counts:
        by.setdefault(v[0], Counter())[v[1:]] += n
    fitted = {kind: fit_labelers(sorted(patterns.items())) for kind, patterns in by.items()}
    forms = sorted({f for _, f, _ in counts})
    at = {f: i for i, f in enumerate(forms)}
    n, y = np.zeros(len(forms)), np.zeros(len(forms))
    for v, f, k in counts:
        n[at[f]] += k
        y[at[f]] += k * posterior(v[1:], *fitted[v[0]])
    y = y / n
    x = np.zeros((len(forms), len(KINDS) * len(forms[0]) * 10))
    for f, i in at.items():
        x[i, _features(f)] = 1
    # rare forms are fitted as well as common ones
    w, weight = np.zeros(x.shape[1]), np.log1p(n) / np.log1p(n).sum()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-5 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-5 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, g), -4, 4)
    return SpanModel(w)


def find_spans(text: str, model: SpanModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of one text. Wider candidates are added where the classifier is sure of them."""
    base = base_spans(text)
    more = [c[:3] for c in candidates(text, base) if not c[3] and model.probability(votes(text, c)[1]) >= SURE]
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """`text` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def train_model(docs: DataFrame, *, text: str = "text") -> SpanModel:
    """The span classifier learned from all texts; the driver gets the counted cells only."""
    return train_spans([(r["votes"], r["form"], r["n"]) for r in vote_counts(docs, text=text).collect()])


def find_personal_data(docs: DataFrame, model: SpanModel, *, text: str = "text", keep: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """`docs` (or its columns `keep`) with n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    With `redacted` only the text changes: every span is replaced by its kind, and the columns stay
    those of `docs`. Null texts count as empty and have no spans (redacted, they stay null). Columns
    of the added names are replaced. Rows stay in their partition.
    """
    added = [] if redacted else [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    columns = [c for c in (keep or docs.columns) if c not in added]
    source = docs.select(*dict.fromkeys([*columns, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = [find_spans(v.as_py() or "", model) for v in texts]
            columns_of = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
            if redacted:
                columns_of[text] = pa.array([None if not v.is_valid else redact(v.as_py(), spans) for v, (_, spans) in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns_of.values()), names=list(columns_of))
                continue
            for k, name in enumerate(KINDS):
                columns_of[f"n_{name}"] = pa.array([sum(x[1] == k for x in base) for base, _ in found], pa.int64())
            columns_of["base_sha256"] = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            columns_of["spans"] = pa.array([_joined(spans) for _, spans in found], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns_of.values()), names=list(columns_of))

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    if not redacted:
        schema += ", " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return source.mapInArrow(run, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, train_model(docs), keep=["doc_id"])
