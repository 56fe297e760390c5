"""Secret scans through a trigram index: Boolean trigram queries, intersected postings, verified candidates."""

from __future__ import annotations

import re._parser as parser
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern in the syntax that Java and Python share. group: what must have `least` characters (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The rules' patterns are fixed values; the first three are the base kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{30,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._-]+:[^\x20/@:\x22']{3,}@"),
)

# ---------------------------------------------------------------- trigram queries
# A query is True (no demand), a trigram, or ("and" | "or", frozenset of queries).

_MOST = 64  # strings of an exact set, before it is turned into trigrams


def _all(op: str, parts: Iterable):
    parts = set(parts)
    if op == "and":
        parts.discard(True)
    elif True in parts:
        return True
    if not parts:
        return True
    return next(iter(parts)) if len(parts) == 1 else (op, frozenset(parts))


def _demand(strings: set[str]):
    """The trigrams that a text with one of the strings must have."""
    least = {s for s in strings if not any(t != s and t in s for t in strings)}
    if any(len(s) < 3 for s in least):
        return True
    return _all("or", (_all("and", (s[i : i + 3] for i in range(len(s) - 2))) for s in least))


def _walk(nodes) -> tuple[set[str] | None, object]:
    """Of a concatenation: the strings it can be (None: too many), and what else it demands."""
    exact: set[str] | None = {""}
    found = []
    whole = True
    for op, arg in nodes:
        name, own, demand = str(op), None, True
        if name == "LITERAL":
            own = {chr(arg).lower()}
        elif name == "IN" and not any(str(k) in ("NEGATE", "CATEGORY") for k, _ in arg):
            chars = {chr(c).lower() for k, v in arg for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))}
            own = chars if len(chars) <= 8 else None
        elif name == "SUBPATTERN":
            own, demand = _walk(arg[3])
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                own = set().union(*(e for e, _ in parts))
            demand = _all("or", (_all("and", [d, True if e is None else _demand(e)]) for e, d in parts)) if own is None else True
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, sub = arg
            e, d = _walk(sub)
            if e is not None and high == 1:
                own = e | {""} if low == 0 else e
            elif low and e is not None and len(e) ** min(low, 3) <= _MOST:
                demand = _demand({"".join(x) for x in product(e, repeat=min(low, 3))})
            elif low:
                demand = d
        found.append(demand)
        if own is not None and exact is not None and len(exact) * len(own) <= _MOST:
            exact = {a + b for a, b in product(exact, own)}
            continue
        found.append(_demand(exact) if exact is not None else True)
        whole = False
        exact = own if own is not None and len(own) <= _MOST else {""}
    if whole:
        return exact, _all("and", found)
    return None, _all("and", [*found, _demand(exact)])


def trigram_query(pattern: str):
    """What a text must have for the pattern to match, over trigrams of the lower-cased text; True: nothing, scan fully."""
    exact, demand = _walk(parser.parse(pattern))
    return demand if exact is None else _all("and", [demand, _demand(exact)])


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _holds(query, bit: dict[str, tuple[str, int]]) -> Column:
    if isinstance(query, str):
        word, b = bit[query]
        return F.col(word).bitwiseAND(F.lit(1 << b)) != 0
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), [_holds(q, bit) for q in sorted(query[1], key=str)])


# ---------------------------------------------------------------- index and search


def postings(docs: DataFrame, wanted: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, trigram): the wanted trigrams' posting lists over the lower-cased texts; trigram is its place in
    `wanted`. digest: a hash of the text, so that texts without a key, or of one key, are apart."""
    low = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("digest"), F.lower(text).alias("low"))
    has = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(wanted))))
    return low.select("key", "digest", F.explode(has).alias("trigram"))


def candidates(lists: DataFrame, wanted: list[str], demands: list) -> DataFrame:
    """(key, digest, rules): for each text the numbers of the demands that its postings meet, as bits. Texts that meet none are absent."""
    words = {f"w{k}": range(k * 60, min(len(wanted), (k + 1) * 60)) for k in range((len(wanted) + 59) // 60)}
    bit = {wanted[i]: (w, i - own.start) for w, own in words.items() for i in own}
    own = [F.bit_or(F.when(F.col("trigram").between(r.start, r.stop - 1), F.expr(f"shiftleft(1L, trigram - {r.start})")).otherwise(F.lit(0).cast("long"))).alias(w) for w, r in words.items()]
    met = reduce(Column.bitwiseOR, [F.when(_holds(q, bit), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, q in enumerate(demands) if q is not True])
    return lists.groupBy("key", "digest").agg(*own).select("key", "digest", met.alias("rules")).where("rules != 0")


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _in_parts(items: Column, size, make) -> Column:
    """All arrays that make(part, offset) gives for the parts of an array, joined. offset: the sum of size(item) before
    the part. Parts have about the root of the array's length, so what is put together item by item stays short."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda n, x: n + size(x))
    before = lambda parts: F.aggregate(F.transform(parts, total), zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def cut(x: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(x)))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), step), lambda i: F.slice(x, i + 1, step))

    return _let(items, lambda x: _let(cut(x), lambda parts: F.flatten(F.transform(F.arrays_zip(parts.alias("part"), before(parts).alias("offset")), lambda z: make(z["part"], z["offset"])))))


def _spans(rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches of the rule in `text`: array of (start, ord, kind, end), code points, end exclusive.

    What stands between matches comes from split(), so places are sums of lengths.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    value = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), found.alias("hit"), value.alias("value"))
    sizes = F.transform(
        parts,
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit"), (x["hit"].isNotNull() & (F.length(x["value"]) >= rule.least)).alias("keep")),
    )
    kind = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (start + x["hit"]).alias("end"))).cast(kind)
        return F.struct((start + x["hit"]).alias("at"), F.when(x["keep"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def make(part: Column, offset: Column) -> Column:
        return F.aggregate(part, F.struct(offset.alias("at"), F.array().cast(kind).alias("out")), add)["out"]

    return _in_parts(sizes, lambda x: (x["gap"] + x["hit"]).cast("long"), make)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, text, spans, kept) for every row; spans: array of (start, ord, kind, end) by start, then by the rules' order.

    kept: a struct of the columns named in `keep`, whose names thus can't clash.

    Native throughout: posting lists of the rules' mandatory trigrams are built and intersected, and each row runs only
    the patterns of the rules it is a candidate for, and those of rules without mandatory trigrams. Candidates aren't
    broadcast, as they grow with the table.

    Null and empty text: empty, no spans. Rows of one key, repeated rows and null keys: each row by itself. Ties: spans
    that start together stand in the rules' order. Very long texts are searched whole. Empty table: no rows.
    """
    demands = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams, demands)))
    found = candidates(postings(docs, wanted, key, text), wanted, demands).withColumnsRenamed({"key": "_key", "digest": "_digest"})
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("digest"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"))
    rows = rows.join(found.hint("shuffle_hash"), (rows["digest"] == found["_digest"]) & rows["key"].eqNullSafe(found["_key"]), "left")
    none = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>")
    each = []
    for i, (rule, q) in enumerate(zip(rules, demands, strict=True)):
        hit = F.rlike(F.col("text"), F.lit(rule.pattern))
        if q is not True:
            hit = (F.coalesce(F.col("rules"), F.lit(0).cast("long")).bitwiseAND(F.lit(1 << i)) != 0) & hit
        each.append(F.when(hit, _spans(rule, i)).otherwise(none))
    spans = F.array_sort(F.flatten(F.array(*each)))
    return rows.select("key", "text", spans.alias("spans"), "kept")


def redacted(mark: str = "[secret]") -> Column:
    """`text` with every span of `spans` replaced; overlapping spans are replaced once."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        before = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        piece = F.when(x["start"] >= acc["at"], F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), piece.alias("out"))

    return F.when(F.size("spans") == 0, F.col("text")).otherwise(
        F.aggregate("spans", zero, add, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    )
