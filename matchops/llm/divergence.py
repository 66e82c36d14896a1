"""Source divergence audit: how far the word use of sources of one language differs.

Identical texts of a language are collapsed first: a text is tokenised once,
and the numbers of its copies by source weight its term counts and document
frequencies.  Workers add up (lang, source, term) in dictionaries of a bounded
size before anything is shuffled.

Two sources of a language are compared over all kept terms, most of which
neither has.  With p0 for a source's share of a term that it lacks, the sum
of absolute differences splits into what each source alone gives (its sum of
shares, its number of terms, p0), a correction for shares below the other's
p0, and a correction for the terms that both have; only the last needs a join
on terms.  All of it is whole-number arithmetic, so the split is exact.

Contract: a null text, lang or source counts as ''.  Empty texts, and texts
without terms, give their (lang, source) group and nothing else.  A language
none of whose terms is in ``min_docs`` documents keeps no term: its pairs are
all 0 and it has no term rows.  Repeated rows are copies.  Ties rank by item
in UTF-8 order.  Texts of any length are read in pieces that end at a
separator.  Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchops.llm.common import shuffle_width, slices
from matchops.session import materialize

SCALE = 1_000_000_000
SMOOTHING = 5
COPIES_PAGE = 1024  # sources in one list of a text's copies
HELD_TERMS = 200_000  # entries a worker adds up before it sends them on
PIECE = 1 << 20  # bytes of a text tokenised at once

#: Letters A-Z become a-z, other ASCII separates terms, UTF-8 bytes of all else belong to them.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of bounded pieces."""
    folded, start = text.translate(_FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, copies): each text of a language once, with its copies by
    source as a list of (source, n); a text in very many sources has several
    such lists, each on a row of its own."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                       F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where(F.length("text") > 0).withColumn("digest", F.unhex(F.sha2("text", 256)))
    same = ["lang", "digest"]
    copies = rows.groupBy(*same, "source").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("source"))
    lists = copies.withColumn("page", F.floor((nth - 1) / COPIES_PAGE)).groupBy(*same, "page").agg(
        F.collect_list(F.struct("source", "n")).alias("copies"))
    once = rows.groupBy(*same).agg(F.first("text").alias("text"))
    return once.join(lists, same).select("lang", F.col("text").cast("binary").alias("text"), "copies")


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term, and the
    documents that have it."""

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent():
            for (lang, source), (n, docs_with) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()),
                     pa.array(list(n.values()), pa.int64()), pa.array([docs_with[t] for t in n], pa.int64())], schema=_COUNTED)
            held.clear()

        for part in slices(batches):
            for lang, text, copies in zip(*(part.column(c).to_pylist() for c in ("lang", "text", "copies")), strict=True):
                whole = list(terms(text)) if len(text) <= PIECE else None
                own: Counter | None = None
                for copy in copies:
                    n, docs_with = held.setdefault((lang, copy["source"]), (Counter(), Counter()))
                    if whole is not None and len(copies) == 1 and copy["n"] == 1:
                        for words in whole:
                            n.update(words)
                            docs_with.update(set(words))
                        continue
                    if own is None:
                        own = Counter()
                        for words in whole if whole is not None else terms(text):
                            own.update(words)
                    for term, times in own.items():
                        n[term] += times * copy["n"]
                        docs_with[term] += copy["n"]
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from sent()
        yield from sent()

    sums = collapsed(docs).mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kept: str = "v") -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * v)), exact beyond 64 bits."""
    return F.expr(f"1L + CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {SMOOTHING} AS DECIMAL(20,0)) "
                  f"div CAST({total} + {SMOOTHING} * {kept} AS DECIMAL(20,0))")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first): the kept terms where they occur;
    ``lang_n`` is the whole language's count, ``first`` marks one row a term."""
    term = Window.partitionBy("lang", "term")
    rows = term_counts(docs).withColumns({
        "lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term),
        "first": F.col("source") == F.min("source").over(term)})
    return rows.where(F.col("lang_docs") >= min_docs).select(
        "lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "first")


def sized_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, v, lang_total, p0) of every occurring group."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    by_lang = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    sized = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0)
    return sized.withColumn("p0", F.when(F.col("v") > 0, _share("0L", "total")).otherwise(F.lit(0)).cast("long"))


def pair_values(valued: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for a < b: the summed differences of all pairs of
    sources of a language."""
    slots = shuffle_width(valued.sparkSession)  # a language's groups meet in so many places
    slot = F.pmod(F.xxhash64("source"), F.lit(slots)).alias("slot")
    spread = F.explode(F.expr(f"sequence(0L, {slots - 1}L)")).alias("slot")
    sums = groups.join(valued.groupBy("lang", "source").agg(F.sum("p").alias("p_sum")), ["lang", "source"], "left").fillna(0)

    left = sums.select("lang", slot, "v", *[F.col(c).alias(f"{c}_a") for c in ("source", "terms", "p_sum", "p0")])
    right = sums.select("lang", spread, *[F.col(c).alias(f"{c}_b") for c in ("source", "terms", "p_sum", "p0")])
    alone = left.join(right, ["lang", "slot"]).where("source_a < source_b").select(
        "lang", F.col("source_a").alias("a"), F.col("source_b").alias("b"),
        F.expr("p_sum_a - p0_b * terms_a + p_sum_b - p0_a * terms_b + (v - terms_a - terms_b) * abs(p0_a - p0_b)").alias("value"))

    shares = valued.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    other = groups.select("lang", spread, F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    below = shares.select("lang", slot, "source", "p", "times").join(other, ["lang", "slot"]).where(
        "p < other_p0 AND source <> other").select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"),
        F.expr("2 * times * (other_p0 - p)").alias("value"))

    one, two = (valued.select("lang", "term", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "p0")]) for x in "ab")
    both = one.join(two, ["lang", "term"]).where("source_a < source_b").select(
        "lang", F.col("source_a").alias("a"), F.col("source_b").alias("b"),
        F.expr("abs(p_a - p_b) - abs(p_a - p0_b) - abs(p_b - p0_a) + abs(p0_a - p0_b)").alias("value"))

    parts = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (below, both)]
    return alone.union(parts[0]).union(parts[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the
    language by their difference ('pair'), and the ``most_terms`` terms that
    the source has most above its language ('term')."""
    kept = materialize(kept_terms(docs, min_docs), "kept-terms")
    groups = materialize(sized_groups(docs, kept), "groups")
    valued = materialize(
        kept.join(groups.select("lang", "source", "total", "v", "lang_total", "p0"), ["lang", "source"]).select(
            "lang", "source", "term", "p0", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q")), "shares")

    pairs = pair_values(valued, groups)
    both_ways = pairs.select("lang", "value", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    pair = both_ways.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    term = valued.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order)
    return pair.withColumn("rank", ranked).union(term.withColumn("rank", ranked).where(F.col("rank") <= most_terms))
