"""Personal data by bootstrapped contextual extraction.

Strict expressions find the base spans.  They are the seeds: the words around them become lexical patterns (word
before, word after, both).  Things that look like an identifier but miss the strict form (a phone number without its
plus, an address spelled out) are candidates, and every other long number counts against a pattern.  On the graph of
patterns and instances Spark scores both sides in turn: a pattern by the share of its distinct instances that are
trusted, a candidate by the patterns it stands in.  Candidates that end above ``ACCEPT`` are added; base spans always
stay.

The graph holds only identifier-like tokens, is built from distinct (pattern, value) pairs and is reduced by partial
aggregation, so copies of a text and frequent words do not make a group large.  Spans are keyed by the text's hash.

Defined results: null and empty texts have no spans; repeated rows get equal results; a null id is carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import spare_names, stored

KINDS = ("email", "ip", "card", "phone")
SEED, LOOSE, OTHER = 0, 1, 2
ROUNDS, ACCEPT, SUPPORT = 3, 0.9, 5.0  #: rounds of scoring; least score; least trusted instances of a pattern
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A number can only begin where no digit stands before it: from there it takes all digits, so later starts fail alike.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
LOOSE_AT = re.compile(r"[\[(]\x20?(?:at|AT)\x20?[\])]")
LOOSE_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)"
                          r"[A-Za-z0-9-]{1,63})+")
NUMBER = re.compile(r"[0-9]{5,}+")
SPAN = "struct<start:int,kind:int,end:int>"
SEEN = "struct<start:int,kind:int,end:int,state:int,value:string,before:string,after:string>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _left_run(text: str, end: int, floor: int) -> int:
    """Where the run of address characters that ends at ``end`` begins."""
    start = end
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    return start


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, ordered by start and kind."""
    found = []
    at, floor = text.find("@"), 0
    while at >= 0:
        after = DOMAIN.match(text, at)
        if after:
            start = _left_run(text, at, floor)
            if start < at:
                found.append((start, 0, after.end()))
                floor = after.end()
        at = text.find("@", max(at + 1, floor))
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m.groups())):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _loose(text: str) -> Iterator[tuple[int, int, int]]:
    for m in LOOSE_PHONE.finditer(text):
        yield m.start(), 3, m.end()
    for m in LOOSE_AT.finditer(text):
        end = m.start() - (text[m.start() - 1:m.start()] == " ")
        start, after = _left_run(text, end, 0), LOOSE_DOMAIN.match(text, m.end())
        if start < end and after:
            yield start, 0, after.end()


def _word(text: str, begin: int, end: int, last: bool) -> str:
    words = text[max(0, begin):end].split()
    word = (words[-1] if last else words[0]) if words else ""
    return re.sub(r"[0-9]", "0", word.lower())[:24]


def instances(text: str) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """Base spans, and all identifier-like tokens with the words around them."""
    base = base_spans(text)
    taken = sorted((s, e) for s, _, e in base)
    seen = [(*span, SEED) for span in base]
    spots = [(s, k, e, LOOSE) for s, k, e in _loose(text)]
    spots += [(m.start(), -1, m.end(), OTHER) for m in NUMBER.finditer(text)]
    # Walk both lists by place: what touches a base span, or a candidate before it, is not one of its own.
    i, reach = 0, -1
    for start, kind, end, state in sorted(spots, key=lambda x: (x[0], x[3])):
        while i < len(taken) and taken[i][0] < end:
            reach = max(reach, taken[i][1])
            i += 1
        if start >= reach:
            seen.append((start, kind, end, state))
            reach = max(reach, end)
    return base, [(s, k, e, st, text[s:e][:64].lower(), _word(text, s - 48, s, True), _word(text, e, e + 48, False))
                  for s, k, e, st in seen]


def _structs(rows: list[tuple], offsets: list[int], names: list[str], text_columns: int = 0) -> pa.Array:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    kinds = [pa.int32()] * (len(names) - text_columns) + [pa.string()] * text_columns
    struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


def found(text: str = "text", moved: bool = True) -> Column:
    """A struct of base spans and of all identifier-like tokens of a text column; with ``moved`` Spark may evaluate it
    in several places."""
    @F.arrow_udf(f"struct<base:array<{SPAN}>,seen:array<{SEEN}>>")
    def scan(texts: pa.Array) -> pa.Array:
        base, seen, at, seen_at = [], [], [0], [0]
        for begin in range(0, len(texts), 64):
            for x in texts.slice(begin, 64).to_pylist():
                a, b = instances(x) if x else ([], [])
                base += a
                seen += b
                at.append(len(base))
                seen_at.append(len(seen))
        return pa.StructArray.from_arrays([
            _structs(base, at, ["start", "kind", "end"]),
            _structs(seen, seen_at, ["start", "kind", "end", "state", "value", "before", "after"], 3)],
            names=["base", "seen"])

    return (scan if moved else scan.asNondeterministic())(F.col(text))


def accepted(seen: DataFrame) -> DataFrame:
    """Candidates that the pattern graph trusts: (text_hash, start, kind, end).

    ``seen`` holds the identifier-like tokens of distinct texts: text_hash, start, kind, end, state, value, before,
    after.
    """
    patterns = F.explode(F.array(F.concat(F.lit("b "), "before"), F.concat(F.lit("a "), "after"),
                                 F.concat_ws(" ", F.lit("w"), "before", "after"))).alias("pattern")
    edges = stored(seen.select("kind", "state", "value", patterns).groupBy("pattern", "kind", "value")
                   .agg(F.min("state").alias("state")), "pattern-edges")
    kinds = edges.where(f"state = {LOOSE}").select("kind").distinct()
    candidates = edges.where(f"state = {LOOSE}").select("kind", "value").distinct()
    scores = candidates.select("kind", "value", F.lit(0.0).alias("score"))
    instances_of = edges.groupBy("pattern").agg(F.count("*").alias("all"))
    seeds = edges.where(f"state = {SEED}").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    seeds = seeds.join(F.broadcast(kinds), "kind").join(instances_of, "pattern")  # kinds: four rows at most
    loose = edges.where(f"state = {LOOSE}").select("pattern", "kind", "value")
    for _ in range(ROUNDS):
        trusted = loose.join(scores, ["kind", "value"]).groupBy("pattern", "kind").agg(F.sum("score").alias("more"))
        strength = (seeds.join(trusted, ["pattern", "kind"])
                    .withColumn("sum", F.col("seeds") + F.col("more")).where(F.col("sum") >= SUPPORT)
                    .select("pattern", "kind", (F.col("sum") / F.col("all")).alias("strength")))
        # Noisy or over the patterns a candidate stands in, each judged without the candidate itself.
        scores = (loose.join(strength, ["pattern", "kind"], "left").groupBy("kind", "value")
                  .agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce("strength", F.lit(0.0)))))))
                       .alias("score")))
        scores = stored(scores, "instance-scores")
    good = scores.where(F.col("score") >= ACCEPT).select("kind", "value")
    return (seen.where(f"state = {LOOSE}").join(good, ["kind", "value"]).select("text_hash", "start", "kind", "end"))


def _tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """text_hash and the identifier-like tokens of texts that have some."""
    # As a column that is never moved: else the filter would scan every text once more, with workers of its own.
    seen = found(text, moved=False)["seen"].alias("seen")
    return docs.select(F.xxhash64(F.col(text)).alias("text_hash"), seen).where(F.size("seen") > 0)


def _added(docs: DataFrame, text: str, key: str, more: str) -> DataFrame:
    """Spans that the pattern graph adds, by hash of the text."""
    first = stored(_tokens(docs, text).groupBy("text_hash").agg(F.first("seen").alias("seen"))
                   .select("text_hash", F.explode("seen").alias("s")).select("text_hash", "s.*"), "pii-seen")
    span = F.struct(*(F.col(c).cast("int").alias(c) for c in ("start", "kind", "end")))
    return accepted(first).groupBy(F.col("text_hash").alias(key)).agg(F.collect_list(span).alias(more))


def with_spans(docs: DataFrame, text: str = "text", base: str = "base_spans", every: str = "all_spans") -> DataFrame:
    """Documents with the columns ``base`` and ``every``: arrays of (start, kind, end), ordered."""
    key, both, more = spare_names(docs, "text_hash", "found_spans", "added")
    hashed = docs.withColumn(key, F.xxhash64(F.col(text))).withColumn(both, found(text))
    return (hashed.join(_added(docs, text, key, more), key, "left").withColumn(base, F.col(both)["base"])
            .withColumn(every, F.when(F.col(more).isNull(), F.col(base))
                        .otherwise(F.array_sort(F.concat(F.col(base), F.col(more)))))
            .drop(key, both, more))


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(
        ":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts, checksum of the base spans, and all spans of each document."""
    spans = with_spans(docs.select("doc_id", "text"))

    def many(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return spans.select("doc_id", *map(many, range(4)),
                        F.sha2(written("base_spans").cast("binary"), 256).alias("base_sha256"),
                        written("all_spans").alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with every span replaced by its kind in brackets; all other columns as they were."""
    @F.arrow_udf("string")
    def replaced(texts: pa.Array, added: pa.Array) -> pa.Array:
        out = []
        for begin in range(0, len(texts), 64):
            for x, more in zip(texts.slice(begin, 64).to_pylist(), added.slice(begin, 64).to_pylist(), strict=True):
                spans = base_spans(x) if x else []
                if more:
                    spans = sorted([*spans, *((s["start"], s["kind"], s["end"]) for s in more)])
                if spans:
                    parts, at = [], 0
                    for start, kind, end in spans:
                        if start >= at:
                            parts += [x[at:start], f"[{KINDS[kind].upper()}]"]
                        at = max(at, end)
                    x = "".join([*parts, x[at:]])
                out.append(x)
        return pa.array(out, pa.string())

    key, more = spare_names(docs, "text_hash", "added")
    # One step of Python for base spans and replacement: two in a task are two workers.
    marked = docs.withColumn(key, F.xxhash64(F.col(text))).join(_added(docs, text, key, more), key, "left")
    return marked.withColumn(text, replaced(F.col(text), F.col(more))).select(*docs.columns)
