"""Personal data in texts by weak supervision.

Base spans follow fixed patterns (email, ip, card, phone). Beyond them, loose patterns give candidates, and labelers of three sorts vote for or against each, or abstain: regular
expressions (does a stricter form match, does a checksum hold), gazetteers (known domains, hosts and prefixes) and context (words next to the candidate). Votes of the whole corpus are counted by
pattern; expectation-maximisation estimates from those counts how often each labeler is right about true and about false candidates of each kind, and a logistic span classifier is trained on the
features of the candidates with the estimated labels. Candidates that it accepts are added to the base spans; base spans are candidates too, from which reliabilities are learnt, but stay
whatever the classifier says. Counts are by vote pattern, of which there are at most ``PATTERNS``; nothing that grows with the corpus reaches the driver.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import cut

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
RANK = {k: i for i, k in enumerate(KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: each @ in turn, its local part as far left as the last match allows."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping in each kind."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if not HAS_DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 or len(p) > 3 and int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = DIGITS.sub("", m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


HAS_DIGIT = re.compile(r"[0-9]")
#: Loose forms, by kind. Each is anchored on a rare character or word.
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:\s?[\[({]\s?at\s?[\])}]\s?|\s?@\s?)[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)[A-Za-z0-9-]{1,63}){1,5}", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4}){1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.+])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])"),
    "secret": re.compile(
        r"(?:(?<=(?i:password)[=:])|(?<=(?i:passwort)[=:])|(?<=(?i:passwd)[=:])|(?<=(?i:pass)[=:])|(?<=(?i:pwd)[=:])|(?<=(?i:secret)[=:])|(?<=(?i:token)[=:])|(?<=(?i:key)[=:]))(?!//)[0-9A-Za-z+/_!#$%&*-]{8,}={0,2}"
        r"|(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*[0-9])[0-9A-Za-z+/_-]{20,}={0,2}(?![0-9A-Za-z+/_=-])"
    ),
}
#: What a text must hold for a loose form to be tried, one of the patterns at least: every match of the form holds one. Each starts with a plain class of characters, which is quick to search.
NEEDS = {
    "email": (re.compile(r"@|[\[({]\s?at\s?[\])}]", re.I),),
    "ip": (re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),),
    "card": (re.compile(r"[0-9]{4}"),),
    "phone": (re.compile(r"[0-9]{3}[\x20.-]?[0-9]{3,4}"),),
    "secret": (re.compile(r"[=:](?!//)[0-9A-Za-z+/_!#$%&*-]{8}"), re.compile(r"[0-9A-Za-z+/_-]{20}")),
}
CONTEXT = {
    "email": re.compile(r"e-?mail|mail|contact|write|correo|courriel|@|kontakt", re.I),
    "ip": re.compile(r"\bip\b|ipv[46]|address|host|server|addr|login", re.I),
    "card": re.compile(r"card|visa|credit|debit|master|amex|tarjeta|carte|karte|payment", re.I),
    "phone": re.compile(r"phone|call|tel\b|tel[.:]|fax|mobile|cell|whatsapp|telefon|téléphone|llama", re.I),
    "secret": re.compile(r"token|secret|passw|passwd|pwd|api|key|bearer|auth|credential|private", re.I),
}
ASSIGNED = re.compile(r"[:=]\s*[\"']?$|\bis\s+[\"']?$")
PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
AGAINST = re.compile(r"isbn|order|invoice|version|commit|sha-?1|sha-?256|md5|checksum|digest|page|https?://|doi|serial|uuid", re.I)
DOMAINS = frozenset("com org net edu gov io de fr es uk info eu co ch at nl it pl".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "30", "36", "38")
SECRET_STARTS = ("ghp_", "gho_", "sk-", "sk_", "pk_", "AKIA", "ASIA", "xox", "AIza", "eyJ", "glpat-", "hf_")
#: Area codes and country codes that a number in plain digits may start with.
PHONE_STARTS = re.compile(r"(?:\+|00)[1-9]|\(0?[1-9]|[2-9][0-9]{2}[.-]")
PRIVATE = re.compile(r"(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.")
GLOBAL_V6 = re.compile(r"(?:2[0-9a-f]{3}|fe80|fd[0-9a-f]{2}|fc[0-9a-f]{2}):", re.I)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
#: Labelers, and how often each is believed to be right before any count.
BELIEFS = {"form": 0.8, "check": 0.9, "gazetteer": 0.75, "context": 0.8, "assigned": 0.75, "against": 0.85}
LABELERS = tuple(BELIEFS)
#: Candidates that a belief weighs as many as.
STRENGTH = 20.0
PATTERNS = 2 * len(KINDS) * 3 ** len(LABELERS) * 16


def _entropy(s: str) -> float:
    n = np.array(list(Counter(s).values()), float) / len(s)
    return float(-(n * np.log2(n)).sum())


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: str
    pattern: str


def _signed(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "0"


def _pattern(text: str, a: int, b: int, kind: str, base: bool) -> str:
    """``kind:votes:features``: the votes of the labelers as one of -0+ each, and whether it is a base span (b or l), a length class and a character mix.

    A labeler abstains where the loose form alone settles its vote.
    """
    s = text[a:b]
    before, after = text[max(0, a - 32) : a], text[b : b + 16]
    digits = DIGITS.sub("", s)
    context = CONTEXT[kind].search(before) is not None
    assigned = ASSIGNED.search(before) is not None and not AGAINST.search(before[-12:])
    if kind == "email":
        bracketed = re.search(r"[\[({]", s) is not None
        form = _signed(PLAIN_EMAIL.fullmatch(s) is not None, not bracketed)
        last = re.split(r"[^A-Za-z]+", s.strip(" )]}"))[-1].lower()
        check = _signed(bracketed and not re.search(r"(?:^|[^\s\])}])\.(?=[^\s\[({])", s.split("at", 1)[-1]), not last)
        known = _signed(last in DOMAINS, True)
    elif kind == "ip" and ":" not in s:
        octets = s.split(".")
        form = "0"
        check = _signed(all(p == "0" or not p.startswith("0") for p in octets), True)
        known = _signed(PRIVATE.match(s) is not None, int(octets[0].lstrip("0") or "0") in (0, *range(224, 256)))
    elif kind == "ip":
        groups = s.split(":")
        form = _signed(len(groups) == 8 or "::" in s, True)
        check = _signed(any(len(g) > 2 for g in groups) and re.search("[a-f]", s, re.I) is not None, all(len(g) <= 2 for g in groups))
        known = _signed(GLOBAL_V6.match(s) is not None, True)
    elif kind == "card":
        form = _signed(len(s) > len(digits) and len(digits) == 16)
        check = _signed(luhn(digits), True)
        known = _signed(digits.startswith(CARD_STARTS) and len(digits) in (13, 14, 15, 16, 19), True)
    elif kind == "phone":
        form = _signed(s.startswith(("+", "00")) or "(" in s)
        check = _signed(9 <= len(digits) <= 15, True)
        known = _signed(PHONE_STARTS.match(s) is not None, True)
    else:
        form = _signed(re.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2}", s) is not None, s.count("/") > 2 or UUID.fullmatch(s) is not None)
        check = _signed(_entropy(s) >= 2.75 and len(digits) >= 2 and len(digits) < len(s), True)
        known = _signed(s.startswith(SECRET_STARTS))
    votes = form + check + known + _signed(context, kind == "secret") + _signed(assigned, kind == "secret") + _signed(False, AGAINST.search(before) is not None or after[:1].isalnum())
    size = min(3, (b - a) // 12)
    mix = 2 * any(c.isalpha() for c in s) + any(not c.isalnum() for c in s)
    return f"{kind}:{votes}:{'b' if base else 'l'}{size}{mix}"


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[Candidate]:
    """Spans of the loose forms that no base span overlaps, and the base spans themselves, each with its votes."""
    out = [Candidate(a, b, k, _pattern(text, a, b, k, True)) for a, b, k in base]
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(base):  # disjoint runs, since base spans of different kinds may overlap
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for kind in KINDS:
        if not any(p.search(text) for p in NEEDS[kind]):
            continue
        free: list[tuple[int, int]] = []
        for m in LOOSE[kind].finditer(text):
            a, b = m.span()
            i = bisect_left(ends, a + 1)
            if i == len(starts) or starts[i] >= b:
                free.append((a, b))
                out.append(Candidate(a, b, kind, _pattern(text, a, b, kind, False)))
        if free:
            both = sorted([*zip(starts, ends), *free])
            starts, ends = [x for x, _ in both], [y for _, y in both]
    return out


@dataclass
class Model:
    """Accepted patterns, with the classifier's probability."""

    score: dict[str, float]
    reliability: dict[str, dict[str, tuple[float, float]]]


def _features(pattern: str) -> np.ndarray:
    """Kind, each vote by kind, length class and character mix as zeros and ones."""
    kind, votes, more = pattern.split(":")
    n = 1 + 2 * len(LABELERS)
    x = np.zeros(1 + n * len(KINDS) + 8)
    x[0] = 1
    at = 1 + n * RANK[kind]
    x[at] = 1
    for i, v in enumerate(votes):
        x[at + 1 + 2 * i + (v == "-")] = v != "0"
    at = 1 + n * len(KINDS)
    x[at + int(more[1])] = 1
    x[at + 4 + int(more[2])] = 1
    return x


def fit(counts: dict[str, int], rounds: int = 100) -> Model:
    """Labeler reliabilities by expectation-maximisation over counted vote patterns, then the span classifier by Newton steps.

    For each kind, a labeler that votes is right with one probability about true and with another about false candidates, both at least a half. They start at the labeler's belief, which
    stays as a prior worth ``STRENGTH`` candidates. The share of true candidates is estimated apart for base spans and for the others, so that many base spans don't speak for loose forms.
    """
    score, reliability = {}, {}
    posterior: dict[str, float] = {}
    belief = np.array([BELIEFS[name] for name in LABELERS])
    for kind in KINDS:
        keys = sorted(p for p in counts if p.startswith(kind + ":"))
        if not keys:
            continue
        n = np.array([counts[p] for p in keys], float)
        votes = np.array([[{"-": -1, "0": 0, "+": 1}[v] for v in p.split(":")[1]] for p in keys])
        base = np.array([p.split(":")[2][0] == "b" for p in keys])
        right, share = np.stack([belief, belief]), np.where(base, 0.8, 0.5)  # about false, about true candidates
        for _ in range(rounds):
            false = np.where(votes < 0, np.log(right[0]), np.where(votes > 0, np.log(1 - right[0]), 0)).sum(1) + np.log(1 - share)
            true = np.where(votes > 0, np.log(right[1]), np.where(votes < 0, np.log(1 - right[1]), 0)).sum(1) + np.log(share)
            q = 1 / (1 + np.exp(np.clip(false - true, -50, 50)))
            for sort in (base, ~base):
                share[sort] = np.clip((n[sort] @ q[sort] + 2) / (n[sort].sum() + 4), 0.02, 0.98)
            for c, w in ((0, n * (1 - q)), (1, n * q)):
                good, voted = w @ (votes == 2 * c - 1), w @ (votes != 0)
                right[c] = np.clip((good + STRENGTH * belief) / (voted + STRENGTH), 0.5, 0.98)
        reliability[kind] = {name: (float(right[0, i]), float(right[1, i])) for i, name in enumerate(LABELERS)}
        posterior |= dict(zip(keys, q.tolist()))
    if posterior:
        keys = sorted(posterior)
        x = np.array([_features(p) for p in keys])
        y, w = np.array([posterior[p] for p in keys]), np.array([counts[p] for p in keys], float)
        w *= min(1.0, 1e6 / w.sum())
        beta = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
            beta += np.clip(np.linalg.solve(h, x.T @ (w * (y - p)) - 0.05 * beta), -2, 2)
        score = dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))).tolist()))
    return Model(score, reliability)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], RANK[s[2]])))


def find_pii(docs: DataFrame, accept: float = 0.6) -> DataFrame:
    """doc_id, counts of the base spans by kind, base (``kind:start:end`` by start, in code points, end exclusive), spans (base and added ones) for each row.

    ``docs``: doc_id and text; others are ignored. A null text is empty. Base spans always stay; an added span overlaps none of them. Repeated rows give repeated results, an empty table an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fields = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, more array<struct<start:int,end:int,pattern:string>>"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string())]))
        for batch in batches:
            column = batch.column(1)
            counts, base, more = {k: [] for k in BASE}, [], []
            for i in range(batch.num_rows):
                text = column[i].as_py()
                spans = base_spans(text)
                n = Counter(k for _, _, k in spans)
                for k in BASE:
                    counts[k].append(n[k])
                base.append(_joined(spans))
                more.append([{"start": c.start, "end": c.end, "pattern": c.pattern} for c in candidates(text, spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(base, pa.string()), pa.array(more, kind)], ["doc_id", *(f"n_{k}" for k in BASE), "base", "more"])

    seen = cut(rows.mapInArrow(look, fields))
    votes = seen.select(F.explode("more.pattern").alias("pattern")).groupBy("pattern").count()
    model = fit({r["pattern"]: r["count"] for r in votes.collect()})
    good = sorted(p for p, s in model.score.items() if s >= accept)
    fine = F.filter("more", lambda c: c["pattern"].isin(good)) if good else F.filter("more", lambda c: F.lit(False))
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    added = F.transform(fine, lambda c: F.concat_ws(":", F.split(c["pattern"], ":")[0], c["start"].cast("string"), c["end"].cast("string")))
    rank = F.create_map(*[x for k, i in RANK.items() for x in (F.lit(k), F.lit(i))])
    every = F.transform(F.array_union(base, added), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), rank[F.split(s, ":")[0]].alias("k"), s.alias("s")))
    spans = F.array_join(F.transform(F.array_sort(every), lambda s: s["s"]), ",")
    return seen.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", spans.alias("spans"))


def base_digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
