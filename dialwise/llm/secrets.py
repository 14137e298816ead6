"""Secret scans over a trigram inverted index, in DataFrame functions only.

From the syntax tree of each rule's regular expression a Boolean trigram query is derived: any of some
sets of trigrams that all must occur. The index holds the postings of the trigrams that some query
asks for (case folded), in blocks of consecutive ids, so a posting list has at most ``BLOCK`` ids
however frequent its trigram is. Per block the lists are intersected and united as the queries say;
the resulting candidates come to the texts as bitmaps, and are then verified with the full expressions.
A rule that implies no trigram scans every text.

The work on a text grows in proportion to its length and its matches.

Defined cases: a null text counts as empty; rows without an id are candidates of every rule; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored by
:func:`scan_secrets` and kept by :func:`drop_secrets`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _parser as syntax

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialwise.llm.common import filled, fresh
from dialwise.session import frozen

BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
#: Ids of a bitmap of candidates, and how many bitmaps of a rule are broadcast: 16 MB for 134 million ids.
WIDE_BITS, WIDE_BLOCKS = 15, 4096
#: Matches whose lengths are added up at once.
RUN = 256
#: Sets of strings that a part of an expression may match are followed up to this size.
EXACT = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The rules, in the order in which kinds sort. A run of 32 or more is a run that has as
# many, so the last two lengths can stand in the expressions; the first can't, as a match that is too
# short still takes its characters.
RULES = (
    Rule(
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
        "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)

Query = frozenset[frozenset[str]]
_ALL: Query = frozenset([frozenset()])


def _absorb(query: Query) -> Query:
    """Without the alternatives that another one implies."""
    return frozenset(q for q in query if not any(other < q for other in query))


def _and(a: Query, b: Query) -> Query:
    return _absorb(frozenset(x | y for x in a for y in b))


def _of_strings(strings: set[str]) -> Query:
    return _absorb(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(tree) -> tuple[set[str] | None, Query]:
    """The strings that the tree can match, if they are few, and the trigrams that they need."""
    query, run = _ALL, {""}
    whole = True
    for op, value in tree:
        name = str(op)
        own: tuple[set[str] | None, Query] = (None, _ALL)
        if name == "LITERAL":
            own = ({chr(value).lower()}, _ALL)
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            own = ({chr(c).lower() for _, c in value}, _ALL)
        elif name == "SUBPATTERN":
            own = _walk(value[3])
        elif name == "BRANCH":
            parts = [_walk(p) for p in value[1]]
            if all(strings is not None for strings, _ in parts):
                own = (set().union(*(strings for strings, _ in parts)), _ALL)
            else:
                needs = [q if s is None else _of_strings(s) for s, q in parts]
                own = (None, _absorb(frozenset().union(*needs)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            strings, needs = _walk(inner)
            if (low, high) == (0, 1) and strings is not None:
                own = (strings | {""}, _ALL)
            elif low:
                own = (None, needs if strings is None else _of_strings(strings))
        strings, needs = own
        longer = {a + b for a in run for b in strings} if strings is not None else None
        if longer is not None and len(longer) <= EXACT:
            run = longer
            continue
        whole = False
        query = _and(_and(query, _of_strings(run)), needs if strings is None else _of_strings(strings))
        run = {""}
    return (run, _ALL) if whole else (None, _and(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """Alternatives of case-folded trigrams; every match holds all trigrams of one of them."""
    strings, needs = _walk(syntax.parse(pattern))
    return needs if strings is None else _of_strings(strings)


def _any_trigram(trigrams: list[str]) -> str:
    """An expression that finds every place of the trigrams, in either case, overlaps included."""

    def letter(c: str) -> str:
        if c.isalpha():
            return f"[{c}{c.upper()}]"
        return c if c.isalnum() else f"\\x{{{ord(c):x}}}"

    by_first: dict[str, list[str]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], []).append(letter(t[1]) + letter(t[2]))
    return "(?=(" + "|".join(f"{letter(c)}(?:{'|'.join(r)})" for c, r in by_first.items()) + "))"


def postings(
    docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """trigram, block, doc_ids: the inverted index of the given trigrams."""
    places = F.regexp_extract_all(filled(text_col), F.lit(_any_trigram(trigrams)), F.lit(1))
    return (
        docs.select(
            F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(places)).alias("trigram")
        )
        .where("doc_id IS NOT NULL")
        .groupBy(F.lower("trigram").alias("trigram"), F.shiftright("doc_id", BLOCK_BITS).alias("block"))
        .agg(F.collect_set("doc_id").alias("doc_ids"))
    )


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """doc_id and, per rule, whether its trigram query holds; ids for which one holds."""
    trigrams = sorted({t for q in queries.values() for a in q for t in a})
    none = F.array().cast("array<bigint>")
    lists = index.groupBy("block").agg(
        *[
            F.coalesce(F.first(F.when(F.col("trigram") == t, F.col("doc_ids")), True), none).alias(t)
            for t in trigrams
        ]
    )

    def answer(query: Query) -> Column:
        both = [
            reduce(F.array_intersect, [F.col(f"`{t}`") for t in sorted(alternative)])
            for alternative in sorted(query, key=sorted)
        ]
        return reduce(F.array_union, both)

    found = lists.select(*[answer(q).alias(kind) for kind, q in queries.items()])
    ids = F.explode(F.array_distinct(F.flatten(F.array(*queries)))).alias("candidate_id")
    return found.select("*", ids).select(
        "candidate_id", *[F.array_contains(kind, F.col("candidate_id")).alias(kind) for kind in queries]
    )


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """start, kind and end of the matches, in code points, from the pieces between and the matches.

    Lengths are added up in runs of ``RUN`` matches, and the runs' own lengths after that: appending to
    an array copies it, so a single fold would grow with the square of the matches.
    """
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1),
        F.regexp_extract_all(text, pattern, F.lit(0)),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)),
    )
    span_type = "struct<start:int,kind:int,end:int>"
    begin_run = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span_type}>").alias("out"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span_type}>>").alias("out"))

    def step(so_far: Column, x: Column) -> Column:
        start = so_far["at"] + F.length(x["0"])
        end = start + F.coalesce(F.length(x["1"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(place).alias("kind"), end.alias("end"))
        out = F.when(F.length(x["2"]) >= rule.least, F.array_append(so_far["out"], span))
        return F.struct(end.alias("at"), out.otherwise(so_far["out"]).alias("out"))

    def add(so_far: Column, run: Column) -> Column:
        at = so_far["at"]
        moved = F.transform(
            run["out"],
            lambda s: F.struct(
                (s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end")
            ),
        )
        return F.struct((at + run["at"]).alias("at"), F.array_append(so_far["out"], moved).alias("out"))

    def spans(all_: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(RUN))
        runs = F.transform(firsts, lambda i: F.aggregate(F.slice(all_, i, F.lit(RUN)), begin_run, step))
        return F.flatten(F.aggregate(runs, begin, add, lambda x: x["out"]))

    # As the element of an array, the parts are computed once for all runs.
    return F.get(F.transform(F.array(parts), spans), F.lit(0))


def _bitmaps(hits: DataFrame, kinds: list[str]) -> DataFrame:
    """wide block, and per kind a bitmap of its candidates: 4 KB for ``1 << WIDE_BITS`` ids."""
    place = F.col("candidate_id").bitwiseAND(F.lit((1 << WIDE_BITS) - 1))
    return hits.groupBy(F.shiftright("candidate_id", WIDE_BITS).alias("block")).agg(
        *[F.bitmap_construct_agg(F.when(F.col(k), place)).alias(k) for k in kinds]
    )


def _holds(bitmap: Column, number: Column) -> Column:
    """Whether the bit of an id is set."""
    place = number.bitwiseAND(F.lit((1 << WIDE_BITS) - 1))
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    # Two to the power of the bit, as shifts take no column.
    return byte.cast("int").bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0


def _marked(docs: DataFrame, indexed: dict[str, Query], id_col: str, text_col: str) -> tuple:
    """``docs`` with a flag per indexed rule that says whether the row is a candidate.

    The candidates are bitmaps; up to ``WIDE_BLOCKS`` of them for each rule are broadcast (4 KB each), so
    that texts stay where they are. Beyond that, texts and candidates meet by a shuffle.
    """
    index = postings(docs, sorted({t for q in indexed.values() for a in q for t in a}), id_col, text_col)
    hits = frozen(candidates(index, indexed), "candidates")
    bitmaps = frozen(_bitmaps(hits, list(indexed)), "bitmaps")
    key, *names = fresh(docs, "candidate_id", *indexed)
    if bitmaps.count() <= WIDE_BLOCKS:
        found = F.broadcast(bitmaps.toDF(key, *names))
        rows = docs.join(found, F.shiftright(F.col(id_col).cast("long"), WIDE_BITS) == F.col(key), "left")
        held = {kind: _holds(F.col(name), F.col(id_col).cast("long")) for kind, name in zip(indexed, names)}
    else:
        rows = docs.join(hits.toDF(key, *names), F.col(id_col) == F.col(key), "left")
        held = {kind: F.col(name) for kind, name in zip(indexed, names)}
    return rows, {kind: F.coalesce(flag, F.col(id_col).isNull()) for kind, flag in held.items()}


def _scanned(docs: DataFrame, rules, id_col: str, text_col: str, name: str) -> DataFrame:
    """``docs`` with one more column: the array of all verified spans of each row."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if frozenset() not in q}
    rows, flags = _marked(docs, indexed, id_col, text_col) if indexed else (docs, {})
    text = filled(text_col)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = [
        F.when(flags.get(r.kind, text.rlike(r.pattern)), _spans(text, r, i)).otherwise(none)
        for i, r in enumerate(rules)
    ]
    found = F.array_sort(F.flatten(F.array(*spans)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], found.alias(name))


def scan_secrets(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_<kind> of each rule, and spans: ``kind:start:end`` by start, comma-joined."""
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _scanned(few, rules, "doc_id", "text", "found")
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def shown(x: Column) -> Column:
        return F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])

    def number(place: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == place)).cast("long")

    return found.select(
        "doc_id",
        *[number(i).alias(f"n_{r.kind}") for i, r in enumerate(rules)],
        F.concat_ws(",", F.transform("found", shown)).alias("spans"),
    )


def drop_secrets(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows that hold a secret of any rule, all columns kept."""
    (found,) = fresh(docs, "found")
    scanned = _scanned(docs, rules, id_col, text_col, found)
    return scanned.where(F.size(found) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
