"""URL filter: allow and block rules, else a weighted vocabulary of URL terms.

Terms are found by one Aho-Corasick scan of the lower-cased URL and count only
between boundaries (no ASCII letter or digit on either side).  One strict term
blocks; soft terms block when at least two distinct ones are found and their weights reach
``SOFT_LIMIT``.  A rule ``host/path`` fits its host and all subdomains when
the URL's path starts with the rule's path; the longest rule wins over the
vocabulary.

Defined cases: a null URL, or one without ``://``, has empty host and path, so
no rule fits; a null URL has no terms and is allowed.  Long URLs are scanned
whole, repeated rows are judged each, an empty table gives an empty table,
other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from trialframe.llm.common import map_rows, table

# The rules of the contract.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow",
         "net/es/": "block", "net/fr/": "block"}
STRICT = ("adult", "bdsm", "camgirl", "camgirls", "casino", "casinos", "escort", "escorts", "hentai", "hardcore",
          "jackpot", "milf", "nude", "nudes", "phishing", "poker", "porn", "porno", "roulette", "sex", "sexy",
          "viagra", "warez", "xxx")
SOFT = {"ad": 1, "ads": 1, "adserver": 2, "affiliate": 1, "banner": 1, "bet": 1, "bets": 1, "betting": 2, "bonus": 1,
        "cheap": 1, "clickbait": 2, "coupon": 1, "crack": 1, "dating": 1, "deal": 1, "deals": 1, "discount": 1,
        "download": 1, "farm": 1, "free": 1, "gambling": 2, "keygen": 2, "loan": 1, "loans": 1, "lottery": 2,
        "pill": 1, "pills": 1, "promo": 1, "slots": 1, "spam": 1, "torrent": 1, "track": 1, "tracker": 1,
        "tracking": 1, "win": 1, "winner": 1}
SOFT_LIMIT = 2            # weight of the soft terms of a rejected url
SOFT_TERMS = 2            # and how many distinct ones it has at least
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
AFTER = re.compile(r"([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    _, sep, rest = (url or "").partition("://")
    host, path = AFTER.match(rest).groups() if sep else ("", "")
    return host.translate(LOWER), path


def rule_table(rules: dict[str, str]) -> dict[str, list[tuple[str, str, str]]]:
    """host -> its (path, rule, verdict), longest rule first."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    for rule in sorted(rules, key=len, reverse=True):
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule, rules[rule]))
    return out


def find_rule(host: str, path: str, by_host: dict) -> tuple[str | None, str | None]:
    """The longest rule that fits, looked up by each suffix of the host."""
    best: tuple[str | None, str | None] = (None, None)
    while True:
        for start, rule, verdict in by_host.get(host, ()):
            if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        _, dot, host = host.partition(".")
        if not dot:
            return best


class Terms:
    def __init__(self, strict, soft: dict[str, int]):
        import ahocorasick
        self.auto = ahocorasick.Automaton()
        for t in {*strict, *soft}:
            self.auto.add_word(t, (t, len(t)))
        self.auto.make_automaton()
        self.strict, self.soft = set(strict), soft

    def found(self, url: str) -> set[str]:
        text = url.translate(LOWER)
        edge = lambda i: not (0 <= i < len(text) and text[i].isascii() and text[i].isalnum())
        return {t for end, (t, n) in self.auto.iter(text) if edge(end + 1) and edge(end - n)}

    def judge(self, url: str) -> tuple[int, int, str]:
        got = self.found(url)
        mild = got - self.strict
        strict, soft = len(got & self.strict), sum(self.soft[t] for t in mild)
        return strict, soft, "block" if strict or len(mild) >= SOFT_TERMS and soft >= SOFT_LIMIT else "allow"


def judge_urls(df: DataFrame, id_col: str, url_col: str, rules: dict[str, str] = RULES, strict=STRICT,
               soft: dict[str, int] = SOFT) -> DataFrame:
    """``id_col, host, path, rule, verdict, n_strict, soft_weight`` for every row."""

    def make():
        terms, by_host = Terms(strict, soft), rule_table(rules)

        def run(rows):
            for key, url in rows:
                host, path = split_url(url)
                rule, verdict = find_rule(host, path, by_host)
                n_strict, weight, own = terms.judge(url or "")
                yield key, host, path, rule, verdict or own, n_strict, weight
        return run

    key = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, url_col), make, f"`{id_col}` {key}, host string, path string, rule string, "
                    "verdict string, n_strict bigint, soft_weight bigint", chunk=4096)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url")


def op5_sql() -> str:
    low = f"translate(coalesce(url, ''), '{UPPER}', '{UPPER.lower()}')"
    hit = lambda t: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)"
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'"
        for r in sorted(RULES, key=len, reverse=True) for h, _, p in [r.partition("/")])
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())
    return f"""
WITH a AS (SELECT page_id, {low} AS low, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS pos FROM pages),
b AS (SELECT page_id, low, CASE WHEN pos = 0 THEN '' ELSE substr(url, pos + 3) END AS rest FROM a),
c AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
d AS (SELECT page_id, host, path, CASE {fits} END AS rule,
      CAST({' + '.join(map(hit, STRICT))} AS BIGINT) AS n_strict,
      {' + '.join(map(hit, SOFT))} AS n_soft,
      CAST({' + '.join(f'{w} * {hit(t)}' for t, w in SOFT.items())} AS BIGINT) AS soft_weight FROM c)
SELECT page_id, host, path, rule, coalesce(CASE rule {verdicts} END,
       CASE WHEN n_strict > 0 OR n_soft >= {SOFT_TERMS} AND soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, soft_weight FROM d"""
