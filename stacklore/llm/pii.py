"""Personal data by candidate generation and boosted trees.

Base spans (email, ip, card, phone) come from fixed formats. Wider generators
propose more spans that overlap each other and the base: anything joined by @ or
its spelled forms, dotted number groups, long runs of digits and separators. They
run over the text and once more with the base spans blanked out, which gives the
shorter spans that stop before a base span or start behind one.
Boosted trees read each candidate's format (digits, separators, groups, checksum,
range of parts) and its context (neighbouring characters and cue words).

No table marks personal data, so the trees learn from the formats. Texts of a bounded
sample are read twice: as they are, and with each base span rewritten by one of the
``VARIANTS`` of its kind, spelled or grouped otherwise or broken (a wrong check digit, a
part above 255, a date, a version). Candidates of both that a validator confirms in
normalised form are positive, those that it refutes are negative, and so are numbers like
phones without any sign of one; other candidates that it leaves open are no example. The
validators are hidden from half of the rows so that context is learned too.

Every candidate that touches no base span passes through the score of its kind's trees. It is
added if the score reaches the kind's threshold: a quarter of the way (``MARGIN``) from the
least score of a positive held example, down to which the share of positives is at least
``precision``, to the next held example. A kind with
too few held examples has no threshold; there the validators' word counts alone. Base
spans always stay.

Null texts are empty. Repeated rows are scanned each on its own, also under one
doc_id or without any, and count once for the fit, however often they stand. Candidates
that reach their thresholds and overlap give way to the longest, then to the one with the
highest score, then to the first. A table without examples of both classes gives base and confirmed spans, an empty
one an empty result. Extra columns are ignored, or carried as they are by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.llm.base import light, sampled, slices
from stacklore.llm.boosting import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
#: Sampled texts that the fit may draw candidates from, at most about, and told candidates of each.
FIT_DOCUMENTS, FIT_OF_EACH = 8000, 40
#: Part of the way from the last held example above a threshold to the next one below it.
MARGIN = 0.25
#: Held candidates that a kind's threshold must rest on.
LEAST_HELD = 10
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: The wider generators.
WIDE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?\[at\] ?| ?\(at\) ?| ?@ ?)[A-Za-z0-9-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9-]+)++", re.A)),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9.])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]{1,2}[0-9]{4}){2,3}(?:[ ./-]{1,2}[0-9]{1,3})?(?![0-9])|(?<![0-9])[0-9]{12,19}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]{1,2}[0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{4}[ ./-]{1,2}[0-9]{6}[ ./-]{1,2}[0-9]{4,5}(?![0-9])")),
    ("phone", PHONE),
    ("phone", re.compile(r"(?<![0-9.+])(?:00 ?)?\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{2,5}(?:[ ./-]{1,2}[0-9]{2,6}){1,4}(?![0-9.])")),
)
#: Fixed cue words, in the languages of the corpus.
CUES = {
    "email": ("mail", "contact", "correo", "courriel", "write", "@"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "carte", "karte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "móvil", "télé"),
}
#: Spelled signs of an address, and the form that they must give.
AT, DOT = re.compile(r" ?(?:\[at\]|\(at\)|@) ?"), re.compile(r" ?(?:\[dot\]|\(dot\)) ?")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: Forms of a phone number without +: exit code, area code in brackets (no year), 3-3-4 groups; and the word before one.
DIALLED = re.compile(r"00|\((?!(?:19|20)[0-9]{2}\))[0-9]{2,4}\)|[2-9][0-9]{2}([.-])[2-9][0-9]{2}\1[0-9]{4}$")
CALLED = re.compile(r"\b(?:(?:tele)?phone|tel|fax|mobile|cell|call|móvil|teléfono|tél|téléphone|telefon)(?: (?:number|no|is|at|us))?[ .:=]*$")
DATE = re.compile(r"(?:(?:19|20)[0-9]{2}([ ./-])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([ ./-])[0-3]?[0-9]\2(?:19|20)[0-9]{2})(?![0-9])")
#: Numbers that describe a candidate, and those of them that are validators.
FEATURES, VALIDATORS = 24, 5
HAS_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    found: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not HAS_DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_byte_sized, m.groups()))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the wider generators propose, each span once; spans may overlap."""
    if not HAS_DIGIT.search(text) and "@" not in text and "at]" not in text and "at)" not in text:
        return []
    found = []
    for kind, pattern in WIDE:
        if kind == "email" and not ("@" in text or "at]" in text or "at)" in text):
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return list(dict.fromkeys(found))


def beside(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the text with its base spans blanked out: none touches a base span."""
    parts, end = [], 0
    for _, a, b in sorted(base, key=lambda s: s[1]):
        parts += [text[end:a], "\0" * (b - max(a, end))]
        end = max(end, b)
    return candidates("".join([*parts, text[end:]]))


def verdict(text: str, span: tuple[str, int, int], base: list[tuple[str, int, int]]) -> int | None:
    """1 where a validator confirms the candidate in normalised form, 0 where it refutes it, None where it leaves it open."""
    kind, a, b = span
    touched = [s for s in base if s[1] < b and a < s[2]]
    if any(s[0] == kind for s in touched):
        return 1
    if touched:
        return 0 if any(s[1] <= a and b <= s[2] for s in touched) else None
    s = text[a:b]
    d = _digits(s)
    if kind == "email":
        plain = DOT.sub(".", s)
        if not EMAIL.fullmatch(AT.sub("@", plain)):
            return 0
        return 1 if plain != s or "at" in AT.search(s)[0] else None
    if kind == "ip":
        return int(all(map(_byte_sized, s.split("."))))
    if kind == "card":
        return int(13 <= len(d) <= 19 and luhn(d))
    if s[0] == "+":
        return int(9 <= len(d) <= 15)
    if not 7 <= len(d) <= 15 or DATE.match(s) or (len(d) >= 13 and luhn(d)):
        return 0
    return 1 if CALLED.search(text[max(0, a - 40) : a].lower()) or (len(d) >= 9 and DIALLED.match(s)) else None


def _changed(s: str) -> str:
    """The number with its last digit one up: a wrong check digit."""
    return s[:-1] + str((int(s[-1]) + 1) % 10) if s and "0" <= s[-1] <= "9" else s


def _grouped(d: str, sep: str) -> str:
    return sep.join(d[i : i + 4] for i in range(0, len(d), 4))


def _last(d: str) -> str:
    return d[-10:].rjust(10, "2")


#: How a base span is rewritten for the fit: other spellings, and near misses.
VARIANTS = {
    "email": (
        lambda s: s.replace("@", " [at] ").replace(".", " [dot] "), lambda s: s.replace("@", " (at) "), lambda s: s.replace("@", "[at]"),
        lambda s: s.replace("@", " [at] ") + ".7", lambda s: s.partition("@")[0] + " (at) 10.30", lambda s: "v2 @ 1.0.3",
    ),
    "ip": (lambda s: s.rpartition(".")[0] + ".300", lambda s: "1.2.1024.7", lambda s: "0" + s),
    "card": (
        lambda s: _grouped(_digits(s)[:16], "."), lambda s: _grouped(_digits(s)[:16], "/"), lambda s: _grouped(_digits(s)[:16], " - "),
        lambda s: _changed(_grouped(_digits(s)[:16], ".")), lambda s: _changed(_grouped(_digits(s)[:16], "-")), lambda s: _changed(_digits(s)),
    ),
    "phone": (
        lambda s: "00" + _digits(s)[:2] + " " + _last(_digits(s))[:3] + " " + _last(_digits(s))[3:6] + " " + _last(_digits(s))[6:],
        lambda s: f"({_last(_digits(s))[:3]}) {_last(_digits(s))[3:6]}-{_last(_digits(s))[6:]}",
        lambda s: f"tel. {_last(_digits(s))[:3]} {_last(_digits(s))[3:6]} {_last(_digits(s))[6:]}",
        lambda s: f"2024-05-{_digits(s)[:2]} 10-20", lambda s: f"{_last(_digits(s))[:4]}/{_last(_digits(s))[4:7]}/{_last(_digits(s))[7:]}", lambda s: "12.30.45",
    ),
}


def rewritten(text: str, base: list[tuple[str, int, int]]) -> str:
    """The text with each base span in one of the variants of its kind, as its hash picks."""
    parts, end = [], 0
    for kind, a, b in sorted(base, key=lambda s: s[1]):
        if a >= end:
            own = VARIANTS[kind]
            parts += [text[end:a], own[xxhash.xxh3_64_intdigest(f"{a}:{text[a:b]}") % len(own)](text[a:b])]
            end = b
    return "".join([*parts, text[end:]])


def label(text: str, span: tuple[str, int, int], base: list[tuple[str, int, int]]) -> int | None:
    """What the fit takes a candidate for: the verdict, and 0 for a number like a phone without any sign of one."""
    v = verdict(text, span, base)
    return 0 if v is None and span[0] == "phone" else v


def features(text: str, span: tuple[str, int, int], blind: bool = False) -> list[float]:
    """Format and context of a candidate; ``blind`` hides the validators."""
    kind, a, b = span
    s, left, right = text[a:b], text[max(0, a - 40) : a].lower(), text[b : b + 24].lower()
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    return [
        KINDS.index(kind),
        len(s),
        len(d),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        sum(c in " -" for c in s),
        s.count("."),
        s.count("(") + s.count(")"),
        float("[" in s or "(at" in s),
        float(a > 0 and text[a - 1] == "+"),
        float(a > 0 and text[a - 1].isalnum()),
        float(b < len(text) and text[b].isalnum()),
        float(any(c in left for c in CUES[kind])),
        float(any(c in right for c in CUES[kind])),
        float(left.rstrip().endswith((":", "=", "("))),
        len(set(d)) / max(len(d), 1),
        float(bool(CALLED.search(left))),
        float(bool(DIALLED.match(s))),
        -1.0 if blind else float(bool(EMAIL.fullmatch(AT.sub("@", DOT.sub(".", s))))),
        -1.0 if blind else float(bool(DATE.match(s))),
        -1.0 if blind else float(13 <= len(d) <= 19 and luhn(d)),
        -1.0 if blind else float(len(groups) == 4 and all(map(_byte_sized, groups))),
        -1.0 if blind else float(9 <= len(d) <= 15 and (s.startswith("+") or (a > 0 and text[a - 1] == "+"))),
    ]


def _overlaps(span: tuple[str, int, int], others: list[tuple[str, int, int]]) -> bool:
    return any(a < span[2] and span[1] < b for _, a, b in others)


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of the candidates of sampled documents, as they are and rewritten."""
    for (texts,) in slices(batches, text=0):
        x, y = [], []
        for t in texts:
            base = base_spans(t) if t else []
            for own in dict.fromkeys((t, rewritten(t, base))) if t else ():
                base = base_spans(own)
                told = [(c, v) for c in dict.fromkeys(candidates(own) + beside(own, base)) if (v := label(own, c, base)) is not None]
                told.sort(key=lambda c: xxhash.xxh3_64_intdigest(repr(c[0])))
                for n, (c, v) in enumerate(told[:FIT_OF_EACH]):
                    x.append(features(own, c, blind=n % 2 == 1))
                    y.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int64())], ["x", "y"])


class PiiModel:
    """Trees and threshold of each kind; None where there are too few examples."""

    def __init__(self, x: np.ndarray, y: np.ndarray, precision: float = 0.98):
        self.trees: list[BoostedTrees | None] = [None] * len(KINDS)
        self.threshold: list[float | None] = [None] * len(KINDS)
        for k in range(len(KINDS)):
            own = np.flatnonzero(x[:, 0] == k)
            held = own[3::4]
            told = np.setdiff1d(own, held)
            if len(set(y[told])) < 2:
                continue  # without refuted candidates a kind has nothing to learn from
            self.trees[k] = BoostedTrees().fit(x[told], y[told])
            held = held[(x[held, -VALIDATORS:] >= 0).all(axis=1)]  # as in use
            score = self.trees[k].score(x[held])
            # of equal scores the negatives come first
            order = np.lexsort((y[held], -score))
            good = np.cumsum(y[held][order]) / np.arange(1, len(order) + 1)
            able = np.flatnonzero((good >= precision) & (y[held][order] == 1) & (np.arange(1, len(order) + 1) >= LEAST_HELD))
            if len(able):
                least, below = score[order[able[-1]]], score[order[min(able[-1] + 1, len(order) - 1)]]
                self.threshold[k] = float(least - MARGIN * (least - below))

    def takes(self, text: str, span: tuple[str, int, int]) -> tuple[bool, float]:
        """Whether a candidate is added, and its score."""
        k = KINDS.index(span[0])
        if self.threshold[k] is None:
            return verdict(text, span, []) == 1, 0.0
        score = float(self.trees[k].score(np.array([features(text, span)]))[0])
        return score >= self.threshold[k], score

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all spans by kind and start."""
        base = base_spans(text)
        extra = beside(text, base)
        if not extra:
            return base, base
        able = [(c, score) for c in extra for taken, score in [self.takes(text, c)] if taken]
        chosen: list[tuple[str, int, int]] = []
        for c, _ in sorted(able, key=lambda x: (x[0][1] - x[0][2], -x[1])):
            if not _overlaps(c, chosen):
                chosen.append(c)
        return base, sorted(base + chosen, key=lambda s: (KINDS.index(s[0]), s[1]))


def fit(docs: DataFrame, most: int = FIT_DOCUMENTS) -> PiiModel:
    """Fit on the candidates of the ``most`` different texts whose hashes come first, of all rows."""
    rows = light(sampled(docs.select("text"), most)).select("text").mapInArrow(_propose, "x array<double>, y long").toPandas()
    order = rows["x"].map(tuple).argsort(kind="stable") if len(rows) else []
    rows = rows.iloc[order]
    return PiiModel(np.array(rows["x"].tolist(), float).reshape(len(rows), FEATURES), rows["y"].to_numpy())


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans of each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            found = [shared.value.spans(t or "") for t in texts]
            columns = [pa.array(ids, pa.int64())]
            columns += [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            columns += [pa.array([_joined(x[i]) for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    return light(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


def redact(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """``docs`` with each span of personal data replaced by [KIND]; other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs.select("doc_id", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                spans, end, parts = sorted(shared.value.spans(text)[1], key=lambda s: s[1]) if text else [], 0, []
                for kind, a, b in spans:
                    if b <= end:
                        continue
                    parts += [text[end:a], f"[{kind.upper()}]"] if a >= end else []
                    end = b
                out.append("".join([*parts, text[end:]]) if spans else text)
            yield batch.set_column(at, "text", pa.array(out, pa.string()))

    return light(docs).mapInArrow(run, docs.schema)
