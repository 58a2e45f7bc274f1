"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A rule is a pattern over host and path: `||` stands for the start of the host or of one of its labels, `|` for
the start or end, `*` for anything, `^` for a separator or an end; other text stands for itself.  A token is a
run of ASCII letters and digits; a rule's tokens are those that any URL it fits must hold whole.  The rule is
filed under the one that the corpus's URLs hold least often, so the tokens of a URL fetch few rules, and only
those run their regular expressions.  Of the rules that fit, the lowest tier wins, then the longest text.

Rules go to the executors in parts of `rules_per_pass`; a longer list takes more passes, each keeping the best
rule so far, so memory is bounded and the result the same.

Cases: a URL that is null or has no `://` has an empty host and path, is fitted by no rule with a token and
gets the default verdict; repeated rows repeat; null ids stay; extra columns pass through, but
those named host, path, rule or verdict are replaced by the results.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_name, map_rows

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = {c: c + 32 for c in range(65, 91)}
_TOKEN = re.compile(r"[a-z0-9]+")
_SYNTAX = re.compile(r"\|\||[|*^]")
_STANDS_FOR = {"*": ".*", "^": r"(?:[^A-Za-z0-9]|^|$)", "|": r"(?:^|$)", "||": r"(?:^|\.)"}


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    tier: int = 0
    label: str | None = None

    @property
    def regex(self) -> str:
        out, at = "", 0
        for m in _SYNTAX.finditer(self.text):
            out += re.escape(self.text[at : m.start()])
            out += r"^(?:[^/]*\.)?" if m[0] == "||" and not m.start() else _STANDS_FOR[m[0]]
            at = m.end()
        return out + re.escape(self.text[at:])

    @property
    def tokens(self) -> set[str]:
        """Tokens that stand between separators in every URL that the rule fits."""
        lower, found = self.text.translate(_LOWER), set()
        for m in _TOKEN.finditer(lower):
            before, after = lower[: m.start()][-1:], lower[m.end() :][:1]
            if before and before != "*" and after and after != "*":
                found.add(m[0])
        return found

    @property
    def rank(self) -> tuple:
        return (self.tier, -len(self.label or self.text), self.verdict != "block", self.label or self.text)


def site_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """A rule for a host with all subdomains and paths that start with `path`."""
    return Rule(f"||{host}{path}", verdict, 0, f"{host}{path}")


#: What decides where no site rule fits; whatever none of these fits is allowed.
PATTERNS = tuple(
    Rule(text, "block", 1)
    for text in (
        "/login^", "/signup^", "/cart^", "/checkout^", "/wp-login.php^", "/xmlrpc.php^", "^casino^", "^porn^", ".zip|", ".exe|",
        ".iso|", "||ads.*.", "||tracker.*.",
    )
)


def parts_of(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class Index:
    """Rules by their rarest token; `counts` says how often the corpus's URLs hold each."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list] = defaultdict(list)
        for rule in sorted(rules, key=lambda r: r.rank):
            token = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
            self.by_token[token].append((rule.rank, re.compile(rule.regex, re.DOTALL), rule))

    def best(self, target: str) -> Rule | None:
        tokens = {"", *_TOKEN.findall(target.translate(_LOWER))}
        found = min((c for t in tokens for c in self.by_token.get(t, ()) if c[1].search(target)), key=lambda c: c[0], default=None)
        return found and found[2]


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many rows of `url` hold each of the rules' tokens, over the whole table."""

    def run(columns):
        counts = Counter(t for u in columns[0] for t in tokens.intersection(_TOKEN.findall("".join(parts_of(u)).translate(_LOWER))))
        yield list(counts), list(counts.values())

    sums = map_rows(urls.select("url"), run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in sums.collect()}  # a row for each of the rules' tokens at most


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", rules_per_pass: int = 50_000) -> DataFrame:
    """pages with host, path, rule (a site rule's text, else null) and verdict added."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    best = free_name(pages, "best")
    out = pages.select(*names).withColumns(
        {"host": F.lit(""), "path": F.lit(""), "rule": F.lit(None).cast("string"), "verdict": F.lit(default), best: F.lit(None).cast("int")}
    )
    rules = sorted(rules, key=lambda r: r.rank)
    for first in range(0, max(1, len(rules)), rules_per_pass):
        part = rules[first : first + rules_per_pass]
        index = Index(part, token_counts(pages, {t for r in part for t in r.tokens}))
        shared = pages.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for some in cut(batch):
                    columns = dict(zip(some.schema.names, some.columns))
                    split = [parts_of(u) for u in columns["url"].to_pylist()]
                    rule, verdict, done = (columns[c].to_pylist() for c in ("rule", "verdict", best))
                    for i, (host, path) in enumerate(split):
                        if done[i] is None and (first := shared.value.best(host + path)):  # later parts rank lower
                            rule[i], verdict[i], done[i] = first.label, first.verdict, 1
                    columns |= {"host": pa.array([h for h, _ in split], pa.string()), "path": pa.array([p for _, p in split], pa.string())}
                    columns |= {
                        "rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string()),
                        best: pa.array(done, pa.int32()),
                    }
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        out = out.mapInArrow(run, out.schema)
    return out.drop(best)
