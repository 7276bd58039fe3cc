"""Secret scans over a trigram index.

Every rule is a regular expression. From its parse tree comes a Boolean query over trigrams that any match must contain (a
disjunction of conjunctions). One pass over the documents notes which of the rules' trigrams each text holds and turns that
into postings (trigram, document); the postings of a conjunction are intersected, and the rule's expression then runs on the
candidates only. A rule without mandatory trigrams (a bare run of hex digits) scans all texts. The index is of lower-case text,
so one index serves rules with and without case.

Spans are in code points, end exclusive; matches are leftmost and non-overlapping per rule, and a match that is too short is
dropped without another try. Null text counts as empty; an empty text has no spans. A null doc_id joins null-safe; repeated
rows are each scanned. Further columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


@dataclass(frozen=True)
class Rule:
    """pattern: valid for Python's parser and for Java. group, least: that group must have so many characters at least."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1


_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: The three base rules, then those that the method adds.
RULES = (
    Rule("assign", rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url", r"[a-z]{2,10}://[A-Za-z0-9._-]{1,64}:[^\x20/@:\n]{3,64}@[A-Za-z0-9.-]{3,}"),
)

#: Sets of exact strings larger than this are not carried through a concatenation.
_WIDE = 64


def _strings(items) -> tuple[set[str] | None, list[set[frozenset[str]]]]:
    """Of a parsed sequence: the exact strings that it can be (None: too many), and the Boolean clauses found inside it.

    A clause is a set of alternatives, each a set of trigrams that must all be there; all clauses must hold."""
    run: set[str] | None = {""}
    clauses: list[set[frozenset[str]]] = []

    def close() -> None:
        nonlocal run
        if run and all(len(s) >= 3 for s in run):
            clauses.append({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run})
        run = {""}

    for op, arg in items:
        name, exact, inner = str(op), None, []
        if name == "LITERAL":
            exact = {chr(arg).lower()}
        elif name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in arg):
            some = {c for k, v in arg for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))}
            exact = {chr(c).lower() for c in some} if len(some) <= 8 else None
        elif name == "SUBPATTERN":
            exact, inner = _strings(arg[-1])
        elif name == "BRANCH":
            parts = [_strings(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                exact = set().union(*(p[0] for p in parts))
            else:
                inner = _either([_closed(*p) for p in parts])
        elif name == "MAX_REPEAT" and arg[1] == 1 and arg[0] == 0:
            body, _ = _strings(arg[2])
            exact = None if body is None else body | {""}
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            body, inner = _strings(arg[2])
            if body is not None:
                inner = inner + _closed(body, [])
        if exact is not None and len(exact) * len(run) <= _WIDE:
            run = {a + b for a, b in product(run, exact)}
        else:
            close()
            if exact is not None and len(exact) <= _WIDE:
                run = exact
            clauses += inner
            continue
        clauses += inner
    if not clauses and run is not None and len(list(items)):
        simple = all(str(op) in ("LITERAL", "IN", "SUBPATTERN", "BRANCH") or (str(op) == "MAX_REPEAT" and a[1] == 1) for op, a in items)
        if simple and run != {""}:
            return run, []
    close()
    return None, clauses


def _closed(exact: set[str] | None, clauses: list) -> list[set[frozenset[str]]]:
    if exact is not None and exact and all(len(s) >= 3 for s in exact):
        return [*clauses, {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact}]
    return clauses


def _either(options: list[list[set[frozenset[str]]]]) -> list[set[frozenset[str]]]:
    """Clauses that hold if any option does: the first clause of each, joined; none if an option has none."""
    return [set().union(*(o[0] for o in options))] if all(options) else []


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams, one of which any match holds whole; empty if the pattern has no mandatory trigram."""
    exact, clauses = _strings(re._parser.parse(pattern))
    clauses = _closed(exact, clauses)
    if not clauses:
        return []
    if len(clauses) == 1 or max(map(len, clauses)) * len(clauses) > _WIDE:
        clauses = [max(clauses, key=lambda c: (min(map(len, c)), -len(c)))]
    whole = {frozenset().union(*x) for x in product(*clauses)}
    return sorted((x for x in whole if not any(y < x for y in whole)), key=sorted)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, kind, end>> of the rule's matches."""
    marked = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    lengths = F.transform(F.arrays_zip(F.slice(marked, F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), tested.alias("test")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["test"]).alias("test")))
    span = lambda acc, x: F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(order).alias("order"), F.lit(rule.name).alias("kind"), (acc["at"] + x["gap"] + x["hit"]).alias("end"))
    empty = F.expr("cast(array() as array<struct<start:int,order:int,kind:string,end:int>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    walked = F.aggregate(lengths, start, lambda acc, x: F.struct((acc["at"] + x["gap"] + x["hit"]).alias("at"), F.when(x["test"] >= rule.least, F.array_append(acc["found"], span(acc, x))).otherwise(acc["found"]).alias("found")))
    return walked["found"]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for the trigrams that a rule asks for."""
    lower = F.lower(text_of())
    held = F.array_compact(F.array(*[F.when(F.col("_lower").contains(t), F.lit(t)) for t in trigrams]))
    return docs.select("doc_id", lower.alias("_lower")).select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): of the rules with mandatory trigrams, those whose trigram query the document meets."""
    asked = [(r.name, i, sorted(conj)) for r in rules for i, conj in enumerate(trigram_query(r.pattern))]
    trigrams = sorted({t for _, _, conj in asked for t in conj})
    spark = docs.sparkSession
    if not trigrams:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, rules array<string>")
    # Each trigram leads to (conjunction, its bit there); the postings of a conjunction meet in its full set of bits.
    leads = {t: [(k, 1 << conj.index(t)) for k, (_, _, conj) in enumerate(asked) if t in conj] for t in trigrams}
    table = F.create_map(*[x for t in trigrams for x in (F.lit(t), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(b).cast("long").alias("bit")) for k, b in leads[t]]))])
    parts = postings(docs, trigrams).select("doc_id", F.explode(table[F.col("trigram")]).alias("_x")).select("doc_id", "_x.k", "_x.bit")
    met = parts.groupBy("doc_id", "k").agg(F.bit_or("bit").alias("bits"))
    full = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit((1 << len(conj)) - 1).cast("long").alias("bits")) for name, _, conj in asked])
    met = met.select("doc_id", full[F.col("k")].alias("want"), "bits").where("want.bits = bits")
    return met.groupBy("doc_id").agg(F.collect_set("want.rule").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `found`: all spans of all rules, by start and then rule."""
    docs = docs.drop("found", "_rules")
    listed = candidates(docs, rules).withColumnsRenamed({"doc_id": "_id", "rules": "_rules"})
    joined = docs.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    text, none = text_of(), F.expr("cast(array() as array<struct<start:int,order:int,kind:string,end:int>>)")
    each = [spans(text, r, i) if not trigram_query(r.pattern) else F.when(F.array_contains("_rules", r.name), spans(text, r, i)) for i, r in enumerate(rules)]
    return joined.withColumn("found", F.array_sort(F.concat(*[F.coalesce(x, none) for x in each]))).drop("_rules")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span replaced by <secret:kind>; spans that overlap are one, of the first one's kind. A null text stays null."""
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        mark = F.concat(acc["out"], before, F.lit("<secret:"), x["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], mark).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return scan(docs, rules).withColumn("text", F.when(F.size("found") > 0, done).otherwise(text)).select(docs.columns)


def listing(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    base = tuple(r.name for r in RULES[:3])
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    of_base = F.filter("found", lambda x: x["kind"].isin(*base))
    return scan(docs.select("doc_id", "text")).select("doc_id", *[n(k) for k in base], F.sha2(listing(of_base), 256).alias("base_sha256"), listing(F.col("found")).alias("spans"))
