"""Filter interaction audit with wide packed counters.

Filters take out documents one after the other, so what one of them removes depends on its place.  This operator says,
for every order of the filters and every step, what is kept, removed, or would have been removed had an earlier filter
not done so.  Documents are told apart by their mask alone: which filters they fail and which marks they carry.  Each
mask maps to one big integer whose 64-bit fields hold the outcome at every step of every order (600 steps for five
filters).  The integers are added up per part; a field is a count of documents, which Spark holds in 63 bits, so no sum
ever runs over into the next field.

Documents are counted per part and mask before anything is shuffled (at most 2^(filters + marks) rows of a part leave
a task), so a part that holds a third of all rows reaches its reducer as those few rows.  Texts are never shuffled: the
filter on repeated texts compares SHA-256 digests and joins on (digest, id), which spreads the copies of a text.

Defined results: a null text counts as empty, a null part as the empty string; a row with a null id has no smaller id
and is never the smaller one; rows with equal id and text are all first; a label counts if any row of its id has it;
labels with a null id are ignored; texts of any length are read whole; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import stored

BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELD = 8  #: bytes of a field: any count that Spark can hold
TEXT_FILTERS = "ABCD"  #: judged by the text alone
FILTERS = "ABCDE"
MARKS = ("good", "toxic")


def text_flags(text):
    """Failure of each filter that looks at one text: (letter, condition) pairs."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return [("A", n < 100),
            ("B", 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long")),
            ("C", 100 * capitals.cast("long") > 10 * F.char_length(text).cast("long")),
            ("D", text.rlike("[#$%&*|]"))]


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counted documents with the outcome of the five filters: (part, A, ..., E, good, toxic, n)."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("part"), F.col("doc_id").alias("own_id"),
                       digest.alias("digest"), *[fails.alias(letter) for letter, fails in text_flags(F.col("text"))])
    # Rows that agree in all of this count as one from here on; read again below, so kept.
    rows = stored(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    firsts = (rows.where("own_id is not null").groupBy("digest").agg(F.min("own_id").alias("own_id"))
              .withColumn("first", F.lit(True)))
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("own_id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    repeated = F.col("own_id").isNotNull() & F.col("first").isNull()
    return (rows.join(firsts, ["digest", "own_id"], "left").join(marks, "own_id", "left")
            .select("part", *TEXT_FILTERS, repeated.alias("E"),
                    *[F.coalesce(m, F.lit(False)).alias(m) for m in MARKS], "n"))


def audit(rows: DataFrame, filters: Sequence[str] = FILTERS, marks: Sequence[str] = MARKS) -> DataFrame:
    """One row per part, order of the filters and step.

    ``rows`` has ``part``, a boolean column for each filter (true: fails) and mark, and how many documents a row stands
    for (``n``).  Returns part, filter_order, step, kept, removed, redundant, unique_fails, ``<mark>_lost`` and shapley.
    """
    filters, marks = tuple(filters), tuple(marks)
    bits = [F.col(name).cast("int") * (1 << i) for i, name in enumerate(filters + marks)]
    counted = rows.select("part", sum(bits, F.lit(0)).alias("mask"), "n").groupBy("part", "mask").agg(
        F.sum("n").alias("n"))
    counts = ["kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counts)

    def summed(part: pa.Table) -> pa.Table:
        total = 0
        for mask, n in zip(part["mask"].to_pylist(), part["n"].to_pylist()):
            total += n * packed(mask, filters, len(marks))
        rows = unpacked(total, filters, marks)
        at = part["part"][0].as_py()
        return pa.table({"part": pa.array([at] * len(rows["step"]), pa.string()), **rows})

    return counted.groupBy("part").applyInArrow(summed, schema)


@lru_cache(1)
def orders(filters: tuple[str, ...]) -> list[tuple[int, ...]]:
    """All orders of the filters, as places in ``filters``."""
    return list(permutations(range(len(filters))))


@lru_cache(1 << 12)
def packed(mask: int, filters: tuple[str, ...], marks: int) -> int:
    """What happens to one document of this mask, at each step of each order, as one big integer.

    Fields of a step: kept, removed, redundant, then one for each mark lost here; after all steps, one for each filter
    that is the only one failed.
    """
    size, per_step = len(filters), 3 + marks
    fields = np.zeros(len(orders(filters)) * size * per_step + size, "<u8")
    steps = fields[:-size].reshape(-1, size, per_step)
    for own, order in zip(steps, orders(filters)):
        gone = False
        for step, which in zip(own, order):
            fails = mask >> which & 1
            if fails and not gone:
                step[1] = 1
                step[3:] = [mask >> size + m & 1 for m in range(marks)]
            elif fails:
                step[2] = 1
            gone = gone or bool(fails)
            step[0] = not gone
    for which in range(size):
        fields[which - size] = mask & ((1 << size) - 1) == 1 << which
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int, filters: tuple[str, ...], marks: tuple[str, ...]) -> dict[str, pa.Array]:
    """The fields of a sum of packed masks as columns, one row per order and step."""
    size, per_step = len(filters), 3 + len(marks)
    n = len(orders(filters)) * size * per_step + size
    fields = np.frombuffer(total.to_bytes(n * FIELD, "little"), "<u8").astype(np.int64)
    steps = fields[:-size].reshape(-1, per_step)
    which = np.array(orders(filters)).reshape(-1)
    shapley = np.zeros(size, np.int64)
    np.add.at(shapley, which, steps[:, 1])
    names = ["".join(filters[i] for i in order) for order in orders(filters)]
    columns = {"filter_order": pa.array(np.repeat(names, size).tolist(), pa.string()),
               "step": pa.array(np.tile(np.arange(1, size + 1), len(names)), pa.int32()),
               "kept": steps[:, 0], "removed": steps[:, 1], "redundant": steps[:, 2],
               "unique_fails": fields[-size:][which], **{f"{m}_lost": steps[:, 3 + i] for i, m in enumerate(marks)},
               "shapley": shapley[which]}
    return {k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in columns.items()}


ORACLE = r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
        m AS (SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
                + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
                + 8 * regexp_matches(t, '[#$%&*|]')::INT
                + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)::INT AS mask,
                coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
            FROM d LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
        x(i) AS (VALUES (0), (1), (2), (3), (4)),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (SELECT array_to_string(list_transform(p, lambda k: chr((65 + k)::INT)), '') AS filter_order, i + 1 AS step,
                (1 << p[i + 1])::INT AS bit,
                list_sum(list_transform(p[1:i], lambda k: 1 << k))::INT AS earlier FROM o, x),
        r AS (SELECT part, filter_order, step, bit, n, good, toxic, mask & bit <> 0 AS fails,
                mask & coalesce(earlier, 0) <> 0 AS gone, mask = bit AS alone FROM c, s),
        g AS (SELECT part, filter_order, step, bit,
                sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
            FROM r GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM g"""
