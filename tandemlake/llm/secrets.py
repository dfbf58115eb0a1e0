"""Secret scans by a trigram inverted index, in DataFrame functions alone.

From each rule's parsed pattern a Boolean query over trigrams is derived: every
match holds all trigrams of one of a few clauses. The index holds, for each
trigram that any query names, the documents whose lower-cased text has it.
Clauses intersect postings, rules unite clauses, and only documents found so are
held against the pattern. A rule whose pattern makes no trigram certain (a run
of hex digits) scans every document. All of a text is scanned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

_parser = re._parser


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (leftmost, not overlapping) whose group has `least` characters at least."""

    kind: str
    pattern: str
    group: int
    least: int
    any_case: bool = False
    base: bool = True


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that are long enough
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]+", 0, 30, base=False),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, base=False),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, base=False),
)

#: Strings that one place of a pattern may be spelt out to, at most; beyond, the place is left open.
SPELLED = 16


def _and(left: list[frozenset], right: list[frozenset]) -> list[frozenset]:
    return list(dict.fromkeys(a | b for a in left for b in right))


def _told(strings: set[str]) -> list[frozenset]:
    """A clause for each string: its trigrams."""
    return list(dict.fromkeys(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _spell(items) -> set[str] | None:
    """All strings that the items stand for, if they are few."""
    out = {""}
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            own = {chr(arg).lower()}
        elif op == "IN" and str(arg[0][0]) != "NEGATE":
            own = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    own.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < SPELLED:
                    own |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
        elif op == "SUBPATTERN":
            own = _spell(arg[3])
        elif op == "BRANCH":
            parts = [_spell(x) for x in arg[1]]
            own = None if None in parts else set().union(*parts)
        elif op == "MAX_REPEAT" and arg[1] != _parser.MAXREPEAT and arg[1] <= 3:
            one = _spell(arg[2])
            own = None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
        else:
            own = None
        if own is None or len(out) * len(own) > SPELLED:
            return None
        out = {a + b for a in out for b in own}
    return out


def trigram_query(pattern: str) -> list[frozenset]:
    """Clauses (sets of lower-case trigrams); a match holds all of one. An empty clause: scan fully."""

    def walk(items) -> list[frozenset]:
        clauses, run = [frozenset()], []

        def close():
            nonlocal clauses, run
            if run and (strings := _spell(run)):
                clauses = _and(clauses, _told(strings))
            run = []

        for item in items:
            op, arg = str(item[0]), item[1]
            if _spell([*run, item]) is not None:
                run.append(item)
                continue
            close()
            if _spell([item]) is not None:
                run = [item]
            elif op == "SUBPATTERN":
                clauses = _and(clauses, walk(arg[3]))
            elif op == "BRANCH":
                clauses = _and(clauses, list(dict.fromkeys(c for x in arg[1] for c in walk(x))))
            elif op == "MAX_REPEAT" and arg[0] >= 1:
                clauses = _and(clauses, walk(arg[2]))
        close()
        return clauses

    found = walk(_parser.parse(pattern))
    return [frozenset()] if frozenset() in found else found


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, kinds): documents that the index finds for any rule that has trigrams, from (id, text)."""
    clauses = [(r.kind, k, t, len(c)) for r in rules for k, c in enumerate(trigram_query(r.pattern)) for t in sorted(c) if c]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(clauses, "kind string, clause int, trigram string, size int")
    low = docs.select("id", F.lower("text").alias("low"))
    has = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted({c[2] for c in clauses})])
    index = low.select("id", F.explode(F.array_compact(has)).alias("trigram")).distinct()
    met = index.join(F.broadcast(wanted), "trigram").groupBy("id", "kind", "clause", "size").agg(F.count("*").alias("n"))
    return met.where("n = size").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans as array<struct<start, rank, end, kind>>, in code points.

    The pieces between matches and the matches follow each other, so lengths
    summed up to a match give its place.
    """
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    found, part = F.regexp_extract_all(text, pattern, 0), F.regexp_extract_all(text, pattern, rule.group)
    shape = "array<struct<start:int,rank:int,end:int,kind:string>>"
    none = F.array().cast(shape)
    each = F.arrays_zip(found.alias("whole"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("before"), part.alias("part"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["before"])
        end = start + F.char_length(x["whole"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.char_length(x["part"]) >= rule.least, F.concat(acc["out"], one.cast(shape))).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]
    return F.when(F.size(found) > 0, whole).otherwise(none)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text, found): each document with its spans, by start, then the rules' order.

    found is array<struct<start, rank, end, kind>>, offsets in code points, end
    exclusive. A null text is empty and has none. Repeated rows each give a row;
    a null id is an id. Other columns aren't read. An empty table gives an empty one.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hits = candidates(source, rules).withColumnRenamed("id", "hit")
    d = source.join(hits, F.col("id").eqNullSafe(F.col("hit")), "left")
    shape = "array<struct<start:int,rank:int,end:int,kind:string>>"
    each = []
    for rank, rule in enumerate(rules):
        own = spans(F.col("text"), rule, rank)
        scan = frozenset() in trigram_query(rule.pattern)
        each.append(own if scan else F.when(F.array_contains("kinds", rule.kind), own).otherwise(F.array().cast(shape)))
    return d.select(F.col("id").alias("doc_id"), "text", F.array_sort(F.concat(*each)).alias("found"))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of find_secrets()."""
    found = find_secrets(docs, rules=rules).select("doc_id", "found")
    base = [k for k, r in enumerate(rules) if r.base]

    def count(rank: int) -> Column:
        return F.size(F.filter("found", lambda x: x["rank"] == rank)).cast("long").alias(f"n_{rules[rank].kind}")

    return found.select("doc_id", *map(count, base), F.sha2(written(F.filter("found", lambda x: x["rank"].isin(base))), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
