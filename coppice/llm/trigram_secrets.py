"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: an
OR of branches, each an AND of trigrams that any match of that branch contains
(letters folded to lower case). The index holds, for every trigram that some
rule asks for and every shard of rows, the keys of the rows that contain it.
Branches intersect postings, rules unite branches, and only candidate rows are
scanned with the regular expression. A rule without mandatory trigrams scans
every row. The candidates' keys are broadcast if they are few; else the text of
rows with at least one posting is shuffled to them.

Rows are keyed by a hash of id and text, so the plan needs no stable row order;
equal rows share a key and get equal spans. A shard of the index holds about
``SHARD_ROWS`` rows, however many the table has. A null text is empty and has no
spans; a text may be of any length; an empty table gives an empty one. Spans are
(kind, start, end) in code points, end exclusive, by start and then by the rules'
order. Extra columns are kept, whatever their names; one that is called like the
result's gives way.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import guarded, small, written

#: Rows in a shard of the index: no list of postings is longer.
SHARD_ROWS = 1 << 15
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern``: valid and alike in Java and Python; ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    folded: bool = False


# fixed values: the rules that every scan has, in the order of their kinds
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the maximal runs of [0-9a-f]+ with 24 characters or more
)
#: Further rules, whose spans are added.
EXTRA = (Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"))


def mandatory(pattern: str) -> list[str] | None:
    """Strings of which any match contains one, in lower case; None if there is no such list.

    The pattern is read as Python's parser reads it. Enumerable runs (literals, alternatives,
    optional literals, groups) grow the strings; anything else ends a run. The run whose shortest
    string is longest is the answer.
    """
    from re import _constants as c
    from re import _parser as parser

    def walk(items, done: list[set[str]]) -> set[str]:
        """Strings of the open run at the end of ``items``; finished runs go into ``done``."""
        now = {""}
        for op, arg in items:
            if op is c.LITERAL:
                now = {x + chr(arg).lower() for x in now}
            elif op is c.SUBPATTERN:
                inner: list[set[str]] = []
                tail = walk(arg[3], inner)
                if inner:  # the group holds a break: what stands on both sides of it
                    done.append(now)
                    done += inner
                    now = tail
                else:
                    now = {x + y for x in now for y in tail}
            elif op is c.BRANCH:
                ends = []
                for part in arg[1]:
                    inner = []
                    tail = walk(part, inner)
                    ends.append(set() if inner else tail)
                if all(ends):
                    now = {x + y for x in now for end in ends for y in end}
                else:
                    done.append(now)
                    now = {""}
            elif op is c.MAX_REPEAT and arg[0] == 0 and arg[1] == 1 and len(arg[2]) == 1 and arg[2][0][0] is c.LITERAL:
                now = now | {x + chr(arg[2][0][1]).lower() for x in now}
            else:
                done.append(now)
                now = {""}
            if len(now) > 64:
                done.append(now)
                now = {""}
        return now

    runs: list[set[str]] = []
    runs.append(walk(parser.parse(pattern), runs))
    best = max(runs, key=lambda run: min(map(len, run)))
    return sorted(best) if min(map(len, best)) >= 3 else None


def trigram_query(pattern: str) -> list[list[str]] | None:
    """An OR of ANDs of trigrams that every match satisfies; None: scan fully."""
    strings = mandatory(pattern)
    if strings is None:
        return None
    return [sorted({s[min(k, len(s) - 3) :][:3] for k in range(0, len(s), 3)}) for s in strings]


def found(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in a text: the lengths of what lies between the matches and of the matches add up to positions."""
    pattern = ("(?i)" if rule.folded else "") + rule.pattern
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    tested = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), lambda x: F.length(x))
    step = F.transform(F.arrays_zip(between.alias("a"), whole.alias("b"), tested.alias("c")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c")))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPANS).alias("no"), F.array().cast(SPANS).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["a"]
        end = begin + F.coalesce(x["b"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        out = F.when(x["c"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), acc["no"].alias("no"), out.alias("out"))

    spans = F.aggregate(step, start, add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))


def postings(rows: DataFrame, trigrams: list[str], shards: int) -> DataFrame:
    """The inverted index: per shard a map from trigram to the keys of its rows. ``rows`` has _key and _folded."""
    here = F.array_compact(F.array(*[F.when(F.contains(F.col("_folded"), F.lit(t)), F.lit(t)) for t in trigrams]))
    entries = rows.select("_key", F.explode(here).alias("trigram"))
    lists = entries.groupBy(F.pmod("_key", F.lit(shards)).alias("shard"), "trigram").agg(F.collect_set("_key").alias("keys"))
    return lists.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(_key, _rules): the rows that satisfy each rule's Boolean query."""
    none = F.array().cast("array<bigint>")

    def branch(trigrams: list[str]) -> Column:
        return reduce(F.array_intersect, [F.coalesce(F.col("lists")[t], none) for t in trigrams])

    def united(kind: str, query: list[list[str]]) -> Column:
        return F.transform(reduce(F.array_union, [branch(b) for b in query]), lambda k: F.struct(k.alias("_key"), F.lit(kind).alias("_rule")))

    sets = [united(kind, query) for kind, query in queries.items()]
    pairs = index.select(F.explode(F.concat(*sets)).alias("_p")).select("_p.*")
    return pairs.groupBy("_key").agg(F.collect_set("_rule").alias("_rules"))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, text: str = "text", key: str = "doc_id", into: str = "spans") -> DataFrame:
    """``docs`` plus an array of spans."""
    return guarded(docs, (text, key), lambda d: _scanned(d, rules, text, key, into))


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], text: str, key: str, into: str) -> DataFrame:
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    vocabulary = sorted({t for q in asked.values() for branch in q for t in branch})
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_key", F.xxhash64(F.col(key), body))
    empty = F.array().cast(SPANS)
    full = [found(body, r, k) for k, r in enumerate(rules) if r.kind not in asked]
    out = rows.withColumn("_full", F.concat(empty, *full))
    if asked:
        some = rows.select("_key", F.col(key).alias("_id"), body.alias("_text"), F.lower(body).alias("_folded"))
        holding = some.where(reduce(lambda a, b: a | b, [F.contains(F.col("_folded"), F.lit(t)) for t in vocabulary]))
        shards = max(1, -(-docs.count() // SHARD_ROWS))
        cands = small(written(candidates(postings(some, vocabulary, shards), asked)))
        spans = [F.when(F.array_contains("_rules", r.kind), found(F.col("_text"), r, k)).otherwise(empty) for k, r in enumerate(rules) if r.kind in asked]
        verified = holding.drop("_folded").join(cands, "_key").select("_key", "_id", F.concat(empty, *spans).alias("_part")).where(F.size("_part") > 0).dropDuplicates(["_key", "_id"])
        verified = small(written(verified.withColumnRenamed("_key", "_vkey")), "_part")
        out = out.join(verified, (F.col("_key") == F.col("_vkey")) & F.col(key).eqNullSafe(F.col("_id")), "left")
        joined = F.concat(F.col("_full"), F.coalesce(F.col("_part"), empty))
    else:
        joined = F.col("_full")
    return out.withColumn(into, F.array_sort(joined)).select(*[c for c in docs.columns if c != into], into)


def rendered(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[redacted]") -> Column:
    """The text with every span (they may overlap) replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), piece.alias("out"))

    rest = F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
