"""Secret scans by a trigram inverted index.

Each rule is a regular expression. From its syntax a Boolean query over trigrams is derived: what every
match must contain, as ANDs along a concatenation and ORs over alternatives. The index holds postings
(trigram, document) for the trigrams that any query names; their number is bounded by the rules. A
query is answered by meeting the postings of a document in one aggregation by document, so a trigram
that occurs everywhere is no hot key. Only candidates are verified by the expression itself; a rule that
has no mandatory trigram scans all documents.

Case: the index is over lower-cased text, which can only add candidates.

Spans are code point offsets, end exclusive, found without Python: the text is split by the expression
and lengths of pieces and matches are summed in two levels, so a text with very many matches stays cheap.

Defined results: null text counts as empty and has no spans; equal rows get equal results, null ids
stay null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, row_key, staged, unpacked, whole_row


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0
    any_case: bool = False
    base: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The three base rules, in the order that breaks ties; then well-known key formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, True),
    # a run that is too short holds no longer match, so the least length may stand in the expression
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: Alternatives of one place in an expression that are still spelled out.
MAX_SPELLED = 16
BLOCK = 256


def _all_of(queries: list) -> object:
    rest = [q for q in queries if q is not True]
    return True if not rest else rest[0] if len(rest) == 1 else ("and", rest)


def _any_of(queries: list) -> object:
    return True if True in queries else queries[0] if len(queries) == 1 else ("or", queries)


def _spelled(strings: set[str]) -> object:
    """Query for texts that contain one of the strings."""
    if min(map(len, strings)) < 3:
        return True
    return _any_of([_all_of([("tri", s[i:i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(items) -> set[str] | None:
    """All strings that a fully literal part matches, or None."""
    found = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            tails = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            tails = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            tails = _strings(arg[-1])
        elif op is sre.BRANCH:
            parts = [_strings(branch) for branch in arg[1]]
            tails = None if None in parts else set().union(*parts)
        else:
            tails = None
        if tails is None or len(found) * len(tails) > MAX_SPELLED:
            return None
        found = {a + b for a in found for b in tails}
    return found


def _query(items) -> object:
    queries, run = [], []

    def flush() -> None:
        if run and (strings := _strings(run)) is not None:
            queries.append(_spelled(strings))
        run.clear()

    for item in items:
        if _strings([item]) is not None and _strings([*run, item]) is not None:
            run.append(item)
            continue
        flush()
        op, arg = item
        if _strings([item]) is not None:
            run.append(item)
        elif op is sre.SUBPATTERN:
            queries.append(_query(arg[-1]))
        elif op is sre.BRANCH:
            queries.append(_any_of([_query(branch) for branch in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            queries.append(_query(arg[2]))
    flush()
    return _all_of(queries)


def trigram_query(pattern: str) -> object:
    """True (no mandatory trigram) or a tree of ("and", [..]), ("or", [..]) and ("tri", text)."""
    return _query(sre_parse.parse(pattern))


def _trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(_trigrams, query[1]))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (trigram, key), a row for each document that contains the trigram in any case."""
    low = staged(docs, "low", F.lower("body"), ["key"])
    held = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    return low.select("key", F.explode(F.array_compact(held)).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """Per document a bit for each kind whose query its postings satisfy; documents without any are left out."""
    names = sorted(set().union(*map(_trigrams, queries.values())))
    words = [names[i:i + 60] for i in range(0, len(names), 60)]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("trigram")).cast("int") - 1
    masks = index.withColumn("place", place).groupBy("key").agg(*[
        F.bit_or(F.when((F.col("place") >= 60 * w) & (F.col("place") < 60 * w + len(part)), F.expr(f"shiftleft(1L, place - {60 * w})")).otherwise(F.lit(0).cast("long"))).alias(f"mask{w}")
        for w, part in enumerate(words)])
    where = {t: (w, i) for w, part in enumerate(words) for i, t in enumerate(part)}

    def holds(query: object) -> Column:
        if query[0] == "tri":
            w, i = where[query[1]]
            return F.col(f"mask{w}").bitwiseAND(F.lit(1 << i).cast("long")) != 0
        parts = [holds(q) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if query[0] == "and" else out | p
        return out

    bits = F.lit(0).cast("long")
    for n, query in enumerate(queries.values()):
        bits = bits.bitwiseOR(F.when(holds(query), F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")))
    return masks.select(F.col("key").alias("found_key"), bits.alias("bits")).where("bits != 0")


def _prefix_sums(lengths: Column) -> Column:
    """Running totals of an array, in blocks of ``BLOCK`` entries."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("int"), lambda s, x: s + x)

    def offsets(blocks: Column) -> Column:
        starts = F.transform(blocks, lambda _, b: total(F.slice(blocks, 1, b)))
        return let(starts, lambda at: F.transform(lengths, lambda _, i: F.get(at, F.floor(i / BLOCK).cast("int"))
                                                  + total(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))))

    n_blocks = F.ceil(F.size(lengths) / BLOCK).cast("int")
    return let(F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: total(F.slice(lengths, b * BLOCK + 1, BLOCK))), offsets)


SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans_of(body: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in a text, leftmost and non-overlapping."""
    regex = F.lit(rule.regex)

    def spans(parts: Column) -> Column:
        # the end of match i is what lies before it: i + 1 pieces and i + 1 matches
        lengths = F.transform(parts["matches"], lambda m, i: F.length(m) + F.length(F.get(parts["pieces"], i)))
        kept = F.arrays_zip(F.transform(parts["matches"], lambda m: F.length(m)).alias("n"), F.transform(parts["values"], lambda v: F.length(v)).alias("v"))
        ends = let(lengths, _prefix_sums)
        return let(ends, lambda e: F.filter(
            F.transform(kept, lambda k, i: F.when(k["v"] >= rule.min_chars, F.struct(
                (F.get(e, i) - k["n"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.get(e, i).alias("end")))),
            lambda s: s.isNotNull()))

    matches = F.regexp_extract_all(body, regex, F.lit(0))
    none = F.array().cast(SPAN)
    parts = let(matches, lambda m: F.when(F.size(m) > 0, F.struct(
        m.alias("matches"), F.split(body, rule.regex, -1).alias("pieces"), F.regexp_extract_all(body, regex, F.lit(rule.group)).alias("values"))))
    return let(parts, lambda p: F.when(p.isNull(), none).otherwise(spans(p)))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``__secrets``: all spans, by start and then by rule order."""
    rest = docs.columns
    rows = docs.select(F.struct(*rest).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
                       row_key(F.col("doc_id"), F.col("text").cast("string")).alias("key"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    index = postings(rows, sorted(set().union(*map(_trigrams, queries.values()))))
    found = candidates(index, queries)
    rows = rows.join(found, rows["key"] == found["found_key"], "left")
    kinds = list(queries)
    parts = []
    for rank, rule in enumerate(rules):
        spans = spans_of(F.col("body"), rule, rank)
        if rule.kind in queries:
            bit = F.coalesce(F.col("bits"), F.lit(0).cast("long")).bitwiseAND(F.lit(1 << kinds.index(rule.kind)).cast("long"))
            spans = F.when(bit != 0, spans).otherwise(F.array().cast(SPAN))
        parts.append(spans)
    out = staged(rows, "__secrets", F.sort_array(F.concat(*parts)), ["row"])
    return out.select(*[F.col("row")[c].alias(c) for c in rest], "__secrets")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans, per document."""
    found = find_secrets(docs.select("doc_id", "text"))
    base = [r.kind for r in RULES if r.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("__secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base), F.sha2(spans_text(F.filter("__secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        spans_text(F.col("__secrets")).alias("spans"))


def _reach(ends: Column) -> Column:
    """For each entry the largest of those before it (0 for the first), in blocks of ``BLOCK`` entries."""

    def carried(most: Column) -> Column:
        before = F.transform(most, lambda _, b: F.coalesce(F.array_max(F.slice(most, 1, b)), F.lit(0)))
        return let(before, lambda at: F.transform(ends, lambda _, i: F.greatest(
            F.get(at, F.floor(i / BLOCK).cast("int")),
            F.coalesce(F.array_max(F.slice(ends, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)), F.lit(0)))))

    n_blocks = F.ceil(F.size(ends) / BLOCK).cast("int")
    return let(F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.array_max(F.slice(ends, b * BLOCK + 1, BLOCK))), carried)


def _pieces(text: Column, gaps: Column, mark: str) -> Column:
    """The texts of the gaps joined by ``mark``; a block of gaps is cut out first, each gap from its block."""

    def block(part: Column) -> Column:
        start = part[0]["start"]
        cut = F.substring(text, start + 1, F.element_at(part, -1)["stop"] - start)
        return let(cut, lambda t: F.array_join(F.transform(part, lambda g: F.substring(t, g["start"] - start + 1, g["stop"] - g["start"])), mark))

    n_blocks = F.ceil(F.size(gaps) / BLOCK).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: let(F.slice(gaps, b * BLOCK + 1, BLOCK), block)), mark)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping spans become one. ``n_chars`` follows."""
    out = find_secrets(docs.select("doc_id", "text", whole_row(docs.drop("text")).alias("rest")))
    found = F.size("__secrets") > 0
    # what lies before a span and after all earlier ones; a span that begins inside an earlier one has no gap
    gaps = let(_reach(F.col("__secrets.end")), lambda reach: F.filter(
        F.transform("__secrets", lambda s, i: F.struct(F.get(reach, i).alias("start"), s["start"].alias("stop"))), lambda g: g["start"] <= g["stop"]))
    out = staged(out, "gaps", F.when(found, gaps))
    tail = F.substring(F.col("text"), F.array_max("__secrets.end") + 1, F.length("text"))
    out = staged(out, "masked", F.when(found, F.concat(_pieces(F.col("text"), F.col("gaps"), mark), F.lit(mark), tail)), ["text", "rest"])
    made = {"text": F.coalesce("masked", "text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("masked").isNotNull(), F.length("masked").cast("long")).otherwise(F.col("rest")["n_chars"])
    return unpacked(out, "rest", docs, made)
