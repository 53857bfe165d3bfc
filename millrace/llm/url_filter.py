"""URL filter: pattern rules indexed by their rarest literal token.

A filter list holds thousands of patterns, and a URL matches almost none of them. Every
pattern that holds literal tokens is filed under the one that is rarest among the URLs to
be judged (counted over all of them). A URL is cut into tokens, its tokens fetch the rules
filed under them, and only those run their regular expressions; rules without a literal
token are tried on every URL.

Token counts are one distributed aggregate restricted to the rules' own tokens, so what
reaches the driver is bounded by the rule list, not by the URLs. Rules travel in the task
closure; ``MAX_RULES`` bounds them. Judging is a map without any shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MAX_RULES = 200_000
_TOKEN = re.compile(r"[0-9A-Za-z]+")


@dataclass(frozen=True)
class HostRule:
    """Fits ``host``, its subdomains, and paths that start with ``path``; the longest wins."""

    verdict: str
    rule: str  # host and path together, as in "example.com/en/"


@dataclass(frozen=True)
class PatternRule:
    """A pattern over host and path: ``*`` stands for any characters, ``^`` for a separator
    or the end, a leading ``||`` for the start of a host label, ``|`` at either end for the
    start of the host or the end of the path, all else for itself, in either case unless
    ``match_case``. An important block rule outweighs exceptions."""

    verdict: str
    pattern: str
    match_case: bool = False
    important: bool = False

    def rank(self) -> tuple[int, int]:
        """Important blocks first, then exceptions, then other blocks; the longer of a kind."""
        return (1 if self.verdict == "allow" else 2 * self.important), len(self.pattern)


def parse_list(lines: Iterable[str]) -> tuple[list[PatternRule], Counter[str]]:
    """Pattern rules from a filter list, and what was left out of it: block patterns, ``@@`` before
    those that allow, lines of hosts files ("0.0.0.0 name"), comments (``!``, ``#``).

    Of ``$`` options those that a page's URL decides are honoured: match-case, important, and the
    types document, doc and all, which a page is. A rule with others (which site asks, what kind
    of part is loaded) or with a ``##`` selector is no rule for URLs; each is counted by its
    option's name or as "##". Empty lines go. A rule that stands twice counts once."""
    out: dict[PatternRule, None] = {}
    left: Counter[str] = Counter()
    for line in map(str.strip, lines):
        address = _HOSTS_LINE.fullmatch(line)
        if address:
            for name in address[1].split():
                out.setdefault(PatternRule("block", f"||{name.lower()}^"))
        elif _SELECTOR.search(line):
            left["##"] += 1
        elif line and line[0] not in "!#[":
            found = _OPTIONS.search(line)
            options = {o.partition("=")[0].lower() for o in found[1].split(",") if o} if found else set()
            types, others = options & _PAGE_TYPES, options - _PAGE_TYPES - _DECIDED
            if others - (_PART_TYPES if types else set()):
                left.update(others)
                continue
            pattern = (line[: found.start()] if found else line).removeprefix("@@")
            if pattern:
                out.setdefault(PatternRule("allow" if line.startswith("@@") else "block", pattern, "match-case" in options, "important" in options))
    return list(out), left


def parse_rules(lines: Iterable[str]) -> list[PatternRule]:
    """The rules of :func:`parse_list`."""
    return parse_list(lines)[0]


_HOSTS_LINE = re.compile(r"(?:0\.0\.0\.0|127\.0\.0\.1|::1?)\s+([^#]+?)\s*(?:#.*)?")
_SELECTOR = re.compile(r"#@?[?$]?#")
_OPTIONS = re.compile(r"\$([a-z0-9~_,=|.-]+)$", re.I)
_DECIDED, _PAGE_TYPES = {"match-case", "important"}, {"document", "doc", "all"}
#: Types of parts of pages: beside a page type they take nothing from the rule.
_PART_TYPES = {"script", "image", "stylesheet", "subdocument", "xmlhttprequest", "object", "media", "font", "ping", "websocket", "popup", "other"}


def _regex(p: str, match_case: bool = False) -> re.Pattern:
    head = r"^(?:[^/]*\.)?" if p.startswith("||") else "^" if p.startswith("|") else ""
    p = p.removeprefix("||") if p.startswith("||") else p.removeprefix("|")
    tail = "$" if p.endswith("|") else ""
    body = "".join({"*": ".*", "^": r"(?:[^0-9A-Za-z_.%-]|$)"}.get(c) or re.escape(c) for c in p.removesuffix("|"))
    return re.compile(head + body + tail, re.S if match_case else re.S | re.I)


def literal_tokens(p: str) -> list[str]:
    """Tokens that every URL fitting the pattern holds whole, lower-cased.

    A run that touches ``*`` or an open end of the pattern may continue in the URL, so it
    is no whole token and is left out.
    """
    inner, out = p.removeprefix("||"), []
    for m in _TOKEN.finditer(inner):
        before, after = inner[: m.start()][-1:], inner[m.end() :][:1]
        opened = (before and before != "*") or (not before and p.startswith("||"))
        if opened and after and after != "*":
            out.append(m[0].lower())
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


class RuleIndex:
    """Rules filed under their rarest literal token."""

    def __init__(self, host_rules: Sequence[HostRule], patterns: Sequence[PatternRule], counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for r in host_rules:
            host, slash, path = r.rule.partition("/")
            labels = [x for x in _TOKEN.findall(host.lower())]
            pattern = re.compile(r"(?:^|.*\.)" + re.escape(host.lower()) + "\n" + re.escape(slash + path))
            self._file(labels, counts, (1, len(r.rule), r.rule, r.verdict, pattern))
        for p in patterns:
            self._file(literal_tokens(p.pattern), counts, (0, p.rank(), p.pattern, p.verdict, _regex(p.pattern, p.match_case)))

    def _file(self, tokens: list[str], counts: dict[str, int], rule: tuple) -> None:
        if not tokens:
            self.always.append(rule)
            return
        rarest = min(tokens, key=lambda t: (counts.get(t, 0), t))
        self.by_token.setdefault(rarest, []).append(rule)

    def judge(self, host: str, path: str) -> tuple[str | None, str | None, str]:
        """(host rule that wins or None, pattern rule that wins or None, verdict)."""
        text, joined = f"{host}{path}", f"{host}\n{path}"
        found = list(self.always)
        for t in {x.lower() for x in _TOKEN.findall(joined)}:
            found += self.by_token.get(t, ())
        best = {0: None, 1: None}
        for rule in found:
            kind, n, name = rule[:3]
            at = best[kind]
            if (at is None or (n, name) > at[1:3]) and (rule[4].match(joined) if kind else rule[4].search(text)):
                best[kind] = rule
        won = best[1] or best[0]
        return best[1] and best[1][2], best[0] and best[0][2], won[3] if won else "allow"


def judge_urls(df: DataFrame, host_rules: Sequence[HostRule], patterns: Sequence[PatternRule] = (), url: str = "url", id_col: str = "page_id") -> DataFrame:
    """Per row: id, host, path, rule, pattern, verdict.

    A host rule that fits decides (longest first, ties to the larger string); else a fitting
    pattern rule: an important block, else an exception, else any block, the longest of its
    kind; else the URL is allowed. Null, empty or scheme-less URLs have
    an empty host and path, which no host rule fits. Rows repeat as they come, null and
    repeated ids, too; a long URL counts whole. Other columns are ignored, whatever their
    names. An empty table gives no rows, an empty list of rules allows all.
    """
    if len(host_rules) + len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: split the list and take the longest match of the parts")
    wanted = sorted({t for p in patterns for t in literal_tokens(p.pattern)} | {t.lower() for r in host_rules for t in _TOKEN.findall(r.rule.partition("/")[0])})
    spark = df.sparkSession
    counts: dict[str, int] = {}
    if wanted:
        tokens = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(url)), F.lit("([0-9a-z]+)"))).alias("t"))
        rare = spark.createDataFrame([(t,) for t in wanted], "t string")
        counts = dict(tuple(r) for r in tokens.join(F.broadcast(rare), "t").groupBy("t").count().collect())
    index = RuleIndex(host_rules, patterns, counts)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        split = [split_url(u) for u in batch.column(1).to_pylist()]
        judged = [index.judge(*x) for x in split]
        cols = [batch.column(0), [x[0] for x in split], [x[1] for x in split], [x[0] for x in judged], [x[1] for x in judged], [x[2] for x in judged]]
        text = pa.string()
        yield pa.RecordBatch.from_arrays([cols[0], *(pa.array(c, text) for c in cols[1:])], names=["page_id", "host", "path", "rule", "pattern", "verdict"])

    out = map_arrow(df.select(F.col(id_col), F.col(url)), run, f"page_id {kind}, host string, path string, rule string, pattern string, verdict string")
    return out.withColumnRenamed("page_id", id_col)
