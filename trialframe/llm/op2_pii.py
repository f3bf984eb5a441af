"""Personal data by weak supervision.

Four base patterns with their checks, and looser patterns beside them, propose
spans.  Labelers vote on each proposal: regular expressions and checksums,
gazetteers (top-level domains, given names, reserved addresses, issuer
prefixes) and context words around it.  Spark counts the vote patterns of the
whole corpus; expectation-maximisation on those counts estimates how reliable
each labeler is, and the posterior trains the final span classifier (logistic
regression on votes and shape).  A loose proposal becomes a span where the
classifier says at least one half; base spans stay.

The tables of counts are bounded: a cell is (kind, votes, shape), at most
``5 * 3**5 * 24`` of them, whatever the corpus size.

Defined cases: null or empty text has no spans; a repeated row gives a row
each; any length is scanned whole; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import map_rows, outside, sha_hex, shared_table, span_text, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "person")
# The base patterns.  The guards only keep a failed try from
# starting again inside the same run of characters.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Looser patterns, proposals only.
LOOSE_EMAIL = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}"
                         r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{2,63})+")
MASKED_AT = re.compile(r"[(\[{]at[)\]}]")
LOOSE_PHONE = re.compile(r"(?<![0-9+.(-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")
TITLED = re.compile(r"\b(Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\.? "
                    r"([A-ZÀ-Þ][a-zß-ÿ]{1,30}(?: [A-ZÀ-Þ][a-zß-ÿ]{1,30})?)")
NAMED = re.compile(r"\b(Alice|Anna|Anne|Antonio|Carlos|Carmen|Charles|Claire|David|Emma|Hans|Ingrid|Isabel|James|Jean|"
                   r"John|José|Juan|Jürgen|Karl|Klaus|Laura|Louis|Luis|Maria|Marie|Mary|Michael|Miguel|Pablo|Paul|"
                   r"Peter|Pierre|Robert|Sophie|Thomas|Ursula|William|Wolfgang) [A-ZÀ-Þ][a-zß-ÿ]{1,30}")
# Gazetteers.
TLDS = frozenset("com org net edu gov int info biz de fr es uk us eu it nl ch at be io co ai dev".split())
GIVEN = frozenset(NAMED.pattern.split("(")[1].split(")")[0].split("|"))
CODES = ("1", "7", "20", "27", "3", "4", "5", "6", "8", "9")     # country calling codes by their first digits
RESERVED = ("0.", "127.", "255.")
CONTEXT = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write|reply|kontakt|courriel|correo)\b"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address|login|addr|adresse|ping|client)\b"),
    "card": re.compile(r"(?i)\b(card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta|pan)\b"),
    "phone": re.compile(r"(?i)\b(phone|tel|call|mobile|fax|telefon|téléphone|teléfono|whatsapp)\b"),
    "person": re.compile(r"(?i)\b(name|called|named|signed|author|by|dear|regards|von|par|por)\b"),
}
AGAINST = re.compile(r"(?i)\b(version|release|isbn|issn|section|chapter|page|figure|order|invoice|serial|build)\b")
WINDOW = 40               # characters of context on either side
LABELERS = ("pattern", "check", "gazetteer", "context", "against")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c.isascii() and c.isdigit())


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` outwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m and at > done:
            s = at
            while s > done and text[s - 1] in LOCAL:
                s -= 1
            if s < at:
                out.append((s, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    return out


def find_base(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = digits_of(m[0]) if m.end() - m.start() >= 12 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def proposals(text: str, base: list) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base); loose ones only where no base span of any kind lies."""
    loose = [("email", *m.span()) for m in LOOSE_EMAIL.finditer(text)] if MASKED_AT.search(text) else []
    loose += [("phone", *m.span()) for m in LOOSE_PHONE.finditer(text)]
    loose += [("card", *m.span()) for m in CARD.finditer(text)
              if m.end() - m.start() >= 12 and 12 <= len(digits_of(m[0])) <= 19]
    loose += [("person", *m.span(2)) for m in TITLED.finditer(text)]
    loose += [("person", *m.span()) for m in NAMED.finditer(text)]
    loose.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    kind = {}
    for k, s, e in loose:
        kind.setdefault((s, e), k)
    kept = outside(((s, e) for _, s, e in loose), [(s, e) for _, s, e in base])
    return [(k, s, e, True) for k, s, e in base] + [(kind[x], *x, False) for x in kept]


def votes(text: str, kind: str, s: int, e: int, base: bool) -> tuple[int, ...]:
    """One vote (-1, 0, 1) of each of ``LABELERS``."""
    value, d = text[s:e], digits_of(text[s:e])
    pattern = 1 if base else 0
    check = {"card": lambda: 1 if luhn(d) else -1,
             "ip": lambda: 1 if all(len(x) == 1 or x[0] != "0" for x in value.split(".")) else -1,
             "phone": lambda: 1 if 9 <= len(d) <= 15 else -1,
             "email": lambda: 1 if "@" in value and ".." not in value else 0,
             "person": lambda: 1 if " " in value else 0}[kind]()
    gaz = {"email": lambda: 1 if re.split(r"[. ]", value.lower())[-1] in TLDS else -1,
           "ip": lambda: -1 if value.startswith(RESERVED) else 0,
           "card": lambda: 1 if d[0] in "3456" and len(d) in (13, 14, 15, 16) else -1,
           "phone": lambda: (1 if d.startswith(CODES) else -1) if value[0] == "+" else 0,
           "person": lambda: 1 if value.split(" ")[0] in GIVEN else 0}[kind]()
    near = f"{text[max(0, s - WINDOW):s]} {text[e:e + WINDOW]}"
    return (pattern, check, gaz, 1 if CONTEXT[kind].search(near) else 0, -1 if AGAINST.search(near) else 0)


def shape(value: str) -> int:
    """Length band (0 to 5) times kinds of separators (0 to 3)."""
    n = min(5, len(value) // 5)
    return n * 4 + 2 * bool(re.search(r"[ ()-]", value)) + bool(re.search(r"[.@]", value))


def propose(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row with its proposals, their votes and shapes."""

    def make():
        def run(rows):
            for key, text in rows:
                text = text or ""
                yield key, [{"kind": k, "start": s, "end": e, "base": b, "votes": list(votes(text, k, s, e, b)),
                             "shape": shape(text[s:e])} for k, s, e, b in proposals(text, find_base(text))]
        return run

    key = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(F.col(id_col).alias("key"), text_col), make,
                    f"key {key}, found array<struct<kind:string,start:int,end:int,base:boolean,"
                    "votes:array<int>,shape:int>>")


def em(votes_: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Two-class latent model with independent labelers on weighted vote rows.

    Returns the posterior of each row, the prior, and P(vote | class) of shape
    (labelers, 2, 3).  Starts from the signed vote sum; add-one smoothing keeps
    every estimate inside (0, 1); the classes cannot swap because the start
    says which one positive votes mean.
    """
    n, m = votes_.shape
    post = 1 / (1 + np.exp(-votes_.sum(1, dtype=float)))
    hot = np.stack([votes_ == v for v in (-1, 0, 1)], 2).astype(float)        # rows, labelers, 3
    prior, table_ = 0.5, np.full((m, 2, 3), 1 / 3)
    for _ in range(rounds):
        w = np.stack([weight * (1 - post), weight * post], 1)                  # rows, 2
        table_ = np.einsum("rc,rlv->lcv", w, hot) + 1
        table_ /= table_.sum(2, keepdims=True)
        prior = (w[:, 1].sum() + 1) / (w.sum() + 2)
        lp = np.einsum("rlv,lcv->rc", hot, np.log(table_)) + np.log([1 - prior, prior])
        post = 1 / (1 + np.exp(np.clip(lp[:, 0] - lp[:, 1], -60, 60)))
    return post, prior, table_


def features(kind: str, v, shape_: int) -> list[float]:
    x = [1.0] + [float(kind == k) for k in KINDS]
    for i in v:
        x += [float(i > 0), float(i < 0)]
    return x + [float(shape_ // 4 == b) for b in range(6)] + [float(shape_ & 2), float(shape_ & 1)]


def train(cells: list) -> np.ndarray:
    """Weights of the span classifier from (kind, votes, shape, count) cells."""
    if not cells:
        return np.zeros(len(features(KINDS[0], [0] * len(LABELERS), 0)))
    target = np.zeros(len(cells))
    weight = np.array([float(c[3]) for c in cells])
    for k in KINDS:
        at = [i for i, c in enumerate(cells) if c[0] == k]
        if at:
            target[at] = em(np.array([cells[i][1] for i in at]), weight[at])[0]
    x = np.array([features(*c[:3]) for c in cells])
    w = np.zeros(x.shape[1])
    for _ in range(40):                                  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def find_personal(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, found`` for every row; ``found`` holds the kept spans (kind, start, end, base)."""
    proposed = shared_table(propose(df, id_col, text_col), "pii")
    cells = (proposed.select(F.explode("found").alias("f"))
             .groupBy("f.kind", "f.votes", "f.shape").agg(F.count("*").alias("n")).collect())
    w = train(sorted((r["kind"], tuple(r["votes"]), r["shape"], r["n"]) for r in cells))

    def make():
        def run(rows):
            for key, found in rows:
                yield key, [{"kind": f["kind"], "start": f["start"], "end": f["end"], "base": f["base"]}
                            for f in found
                            if f["base"] or np.dot(features(f["kind"], f["votes"], f["shape"]), w) >= 0]
        return run

    key = df.schema[id_col].dataType.simpleString()
    return map_rows(proposed.select("key", "found"), make, f"`{id_col}` {key}, found array<struct<kind:string,"
                    "start:int,end:int,base:boolean>>", chunk=2048)


def digest(found: DataFrame, id_col: str) -> DataFrame:
    """The contract's columns from the spans of ``find_personal``."""

    def make():
        def run(rows):
            for key, got in rows:
                base = [(f["kind"], f["start"], f["end"]) for f in got if f["base"]]
                n = Counter(k for k, *_ in base)
                yield (key, *(n[k] for k in BASE_KINDS), sha_hex(span_text(base, BASE_KINDS)),
                       span_text([(f["kind"], f["start"], f["end"]) for f in got], KINDS), len(got) - len(base))
        return run

    key = found.schema[id_col].dataType.simpleString()
    return map_rows(found.select(id_col, "found"), make, f"`{id_col}` {key}, n_email bigint, n_ip bigint, "
                    "n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint", chunk=2048)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
