"""URL verdicts: host and path rules, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabulary.  A strict term rejects alone, soft terms only together.
STRICT = ("casino", "gambling", "poker", "porn", "sex", "viagra", "warez", "xxx")
SOFT = ("ads", "bets", "bonus", "cheap", "farm", "free", "loans", "pills", "prize", "spam", "track", "win")
#: Weight of a strict term and of a soft term, and the sum over distinct terms that rejects.
STRICT_WEIGHT, SOFT_WEIGHT, REJECT = 2, 1, 2

#: (verdict, host and path); a rule fits the host and its subdomains where the path starts with the rule's (fixed values).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def lower_ascii(s: str) -> str:
    return s.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    at = rest.find("/", 0, end)
    return (lower_ascii(rest[:end]), "") if at < 0 else (lower_ascii(rest[:at]), rest[at:end])


@dataclass(frozen=True)
class Rules:
    """Rules by host, the longest path first."""

    by_host: dict[str, list[tuple[str, str]]]

    @classmethod
    def of(cls, rules: Sequence[tuple[str, str]]) -> Rules:
        out: dict[str, list[tuple[str, str]]] = {}
        for verdict, text in rules:
            host, slash, path = text.partition("/")
            out.setdefault(host, []).append((slash + path, verdict))
        return cls({h: sorted(p, key=lambda x: -len(x[0])) for h, p in out.items()})

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; one lookup for each label of the host."""
        best, labels = None, host.split(".") if host else []
        for i in range(len(labels)):
            name = ".".join(labels[i:])
            for start, verdict in self.by_host.get(name, ()):
                if path.startswith(start):
                    if best is None or len(name) + len(start) > len(best[0]):
                        best = (name + start, verdict)
                    break
        return best


class Vocabulary:
    """Distinct strict and soft terms of a url, where neither neighbour is a letter or digit."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for kind, terms in (("soft", soft), ("strict", strict)):
            for term in terms:
                self.automaton.add_word(lower_ascii(term), (kind, lower_ascii(term)))
        self.automaton.make_automaton()

    def counts(self, url: str | None) -> tuple[int, int]:
        text, strict, soft = lower_ascii(url or ""), set(), set()
        for last, (kind, term) in self.automaton.iter(text):
            first = last - len(term)
            if (first < 0 or text[first] not in _WORD) and (last + 1 == len(text) or text[last + 1] not in _WORD):
                (strict if kind == "strict" else soft).add(term)
        return len(strict), len(soft)


def judge_urls(pages: DataFrame, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """Every row, in ``row``, with host, path, rule, verdict, n_strict, n_soft.

    The longest fitting rule decides.  Without one the weights of the distinct terms found anywhere in
    the url decide: one strict term or several soft ones reject.  A url that is null or empty has no
    host, path, rule or term and is allowed.  There is no shuffle, rows that repeat get the same
    answer, and other columns pass through under any name.  Rules and vocabulary are parameters
    that are sent with the function; each task builds the automaton once.
    """
    def run(batches):
        table, vocabulary = Rules.of(rules), Vocabulary(strict, soft)
        for batch in batches:
            out = []
            for url in batch.column(0).field(url_col).to_pylist():
                host, path = host_and_path(url)
                n_strict, n_soft = vocabulary.counts(url)
                rule = table.find(host, path)
                weighed = "block" if STRICT_WEIGHT * n_strict + SOFT_WEIGHT * n_soft >= REJECT else "allow"
                out.append((host, path, rule and rule[0], rule[1] if rule else weighed, n_strict, n_soft))
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    names = ["row", "host", "path", "rule", "verdict", "n_strict", "n_soft"]
    kinds = [pa.string()] * 4 + [pa.int32()] * 2
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    schema = T.StructType([*rows.schema, *(T.StructField(n, T.StringType()) for n in names[1:5]), *(T.StructField(n, T.IntegerType()) for n in names[5:])])
    return rows.mapInArrow(run, schema)


def sql_terms(terms: Sequence[str]) -> str:
    """The number of distinct terms in ``u``, in SQL."""
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms)


def oracle(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, rules: Sequence[tuple[str, str]] = RULES) -> str:
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in rules)
    return f"""
        WITH split AS (
            SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
                   CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id, u, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
            FROM split
        ), rules(verdict, rule, h, p) AS (VALUES {values}), fits AS (
            SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS nth
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ), hits AS (SELECT page_id, host, path, {sql_terms(strict)} AS n_strict, {sql_terms(soft)} AS n_soft FROM parts)
        SELECT page_id, host, path, rule,
               coalesce(verdict, CASE WHEN {STRICT_WEIGHT} * n_strict + {SOFT_WEIGHT} * n_soft >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
               n_strict, n_soft
        FROM hits LEFT JOIN (SELECT * FROM fits WHERE nth = 1) USING (page_id)
    """
