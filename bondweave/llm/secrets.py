"""Secret scans with a trigram inverted index.

Everything on the executors is DataFrame and SQL functions. The driver derives the Boolean trigram
queries from the regexes, a few bytes for each rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, running_sums

#: Expanding classes and alternatives into literal strings stops at so many.
MAX_STRINGS = 64
#: Bits of a long that stand for trigrams.
MASK_BITS = 62


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``min_chars`` code points are spans of ``kind``."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0
    base: bool = False


# The contract's three rules; then formats of further credentials.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

#: A query is a conjunction of groups; a group holds alternatives; an alternative is a set of trigrams.
Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """Trigrams (A-Z lower-cased) that every text with a match must contain; empty if the regex demands none.

    Literal runs are collected through concatenations, small classes, options and alternatives; whatever
    has no short list of strings ends the run. Every run gives one group: an alternative for each of its
    strings, unless one of them is shorter than a trigram.
    """
    query: Query = []

    def flush(strings: set[str]) -> None:
        if min(map(len, strings)) < 3:
            return
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        query.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))

    def run(node, strings: set[str]) -> set[str]:
        for code, arg in node:
            options = literal(code, arg)
            if options is None or len(strings) * len(options) > MAX_STRINGS:
                flush(strings)
                strings = {""} if options is None else options
                if code is op.SUBPATTERN:  # what is inside is mandatory too
                    strings = run(arg[-1], {""})
                elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0]:
                    flush(run(arg[2], {""}))
                    strings = {""}
            else:
                strings = {a + b for a, b in product(strings, options)}
        return strings

    def literal(code, arg) -> set[str] | None:
        """All strings that a node matches, if few."""
        if code is op.LITERAL:
            return {chr(arg).lower() if arg < 128 else chr(arg)}
        if code is op.IN and all(c is op.LITERAL for c, _ in arg):
            return {chr(a).lower() if a < 128 else chr(a) for _, a in arg}
        if code is op.SUBPATTERN:
            return whole(arg[-1])
        if code is op.BRANCH:
            parts = [whole(p) for p in arg[1]]
            return None if None in parts else set().union(*parts)
        if code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] <= 4:
            one = whole(arg[2])
            if one is not None and len(one) ** arg[1] <= MAX_STRINGS:
                return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
        return None

    def whole(node) -> set[str] | None:
        strings = {""}
        for code, arg in node:
            options = literal(code, arg)
            if options is None or len(strings) * len(options) > MAX_STRINGS:
                return None
            strings = {a + b for a, b in product(strings, options)}
        return strings

    flush(run(_parser.parse(pattern), {""}))
    return query


def postings(text: Column, trigrams: list[str]) -> list[Column]:
    """The index entries of a text: one bit for each trigram that the rules ask for, MASK_BITS to a long.

    Bits stay in their document's row, so the index is as large as the table has rows, and nothing has to
    be brought together again to intersect postings or to verify.
    """
    low = F.lower(text)
    held = [F.when(F.contains(low, F.lit(t)), F.lit(1 << (i % MASK_BITS))).otherwise(F.lit(0)).cast("long") for i, t in enumerate(trigrams)]
    return [reduce(lambda a, b: a + b, held[i : i + MASK_BITS]) for i in range(0, len(held), MASK_BITS)]


def candidate(masks: list[str], query: Query, trigrams: list[str]) -> Column:
    """Whether a document's postings satisfy a rule's Boolean query: each alternative is a test of bits."""
    place = {t: divmod(i, MASK_BITS) for i, t in enumerate(trigrams)}

    def has(alternative: frozenset[str]) -> Column:
        wanted = [sum(1 << place[t][1] for t in alternative if place[t][0] == w) for w in range(len(masks))]
        return reduce(lambda a, b: a & b, [F.col(masks[w]).bitwiseAND(F.lit(m)) == m for w, m in enumerate(wanted) if m])

    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(has, group)) for group in query])


SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """Spans of leftmost non-overlapping matches: the pieces between matches and the matches themselves give the offsets."""
    pattern = F.lit(rule.pattern)
    matches, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    kept = matches if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.arrays_zip(F.transform(pieces, F.length).alias("p"), F.transform(matches, F.length).alias("m"), F.transform(kept, F.length).alias("k"))

    def placed(found: Column) -> Column:
        ends = running_sums(F.transform(found, lambda s: s["p"] + F.coalesce(s["m"], F.lit(0))))
        span = lambda s, end: F.struct((end - s["m"]).cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.cast("int").alias("end"))
        return F.filter(F.zip_with(found, ends, lambda s, end: F.when(s["k"] >= rule.min_chars, span(s, end))), lambda s: s.isNotNull())

    return let(steps, placed)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every document: spans (start, rank, kind, end) in code points, end exclusive, sorted by start and rule.

    Rules with mandatory trigrams are verified by their regex in the candidates that the index gives;
    rules without any (such as ``hex``) scan every text. The index only ever leaves out texts that
    cannot match, so the result is that of scanning all texts with all rules. Null texts are empty; a
    text's spans take n log n steps of its matches, whatever its length; rows are judged one by one, so
    repeated and null ids need nothing special; an empty table gives no rows; no columns but the two
    named are read. Nothing is shuffled.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for g in q for alt in g for t in alt})
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = {f"m{w}": b for w, b in enumerate(postings(F.col("text"), trigrams))}
    none = F.array().cast(f"array<{SPAN}>")
    per_rule = []
    for rank, rule in enumerate(rules):
        # A look for one match first: most texts have none. A long enough match is sought where the rule has no group.
        may = candidate(list(bits), queries[rule.kind], trigrams) if rule.kind in queries else F.lit(True)
        per_rule.append(F.when(may & F.col("text").rlike(_quick(rule)), _spans(rule, rank, F.col("text"))).otherwise(none))
    return texts.withColumns(bits).select(F.col("id").alias(id_col), F.array_sort(F.concat(*per_rule)).alias("spans"))


def _quick(rule: Rule) -> str:
    """A regex that finds something wherever the rule does: a final + needs at least as many as are asked for."""
    if rule.group == 0 and rule.min_chars and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return rule.pattern[:-1] + "{%d,}" % rule.min_chars
    return rule.pattern


def secrets_digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """The contract's digest of ``find_secrets``."""
    base = F.array(*[F.lit(r.kind) for r in rules if r.base])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in ("assign", "access", "hex")]
    of_base = F.filter("spans", lambda s: F.array_contains(base, s["kind"]))
    return found.select(id_col, *counts, F.sha2(shown(of_base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
