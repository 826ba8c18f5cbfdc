"""Audit of how far the sources of a language differ in their words, in relations only.

The matches of a regular expression are exploded from the texts, and counts of (lang, source, term) are added up in the
tasks before they shuffle. Each language keeps the terms that are in at least ``least_docs`` of its documents. The kept vocabulary
is crossed with the language's groups (an equality join on the language), so that groups without a term have it with
count 0; smoothed shares ``p`` follow as integers per 10**9. The dense relation is joined with itself on language and term;
sums over the terms give each pair of sources a divergence, and windows rank pairs and terms.

What bounds it: no raw term is shuffled, only counts per task. A kept term is one row that holds its counts by source
(as many as the language has sources). Rows are dealt out by (lang, term), so a language or a source with most of
the rows is spread over all tasks; the dense rows are made where their term lies and joined there, without a further shuffle.
Totals, a row per (lang, source), are counted first and broadcast up to ``BROADCAST_ROWS`` rows; with more of them the join
is by language and a salt. The work is (terms x sources squared) per language, as the pairs ask for.

Defined results: null text, language and source are ''. A row is a document, so rows that repeat an id count each; other
columns are ignored. A group without kept terms has p = 1 + floor(10**9 / V) for all V kept terms; with V = 0 pairs have the
value 0 and there are no terms. An empty table gives an empty result. Shares are computed in decimals of 38 places: nothing is rounded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank_slices, materialize, text_of
from .memory import release

#: Terms are runs of ASCII letters and of all characters beyond ASCII: a space for every other byte, a-z for A-Z.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]")
FOLD = b"".join(bytes([b]).lower() if TERM.match(bytes([b])) else b" " for b in range(256))
#: Terms by group whose counts a task holds.
HELD = 400_000
#: Most rows of totals that are broadcast, and the parts that a language's terms are salted into beyond that.
BROADCAST_ROWS, SALTS = 50_000, 64
SCALE = 1_000_000_000


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, docs, sources array, n array): occurrences of terms by source and the documents that hold them, added up
    in the tasks: a term may have several rows.

    Terms are matched on UTF-8 bytes, where A-Z are the only letters that ``FOLD`` changes. A task hands its counts on
    when it holds more than ``HELD`` of them.
    """
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[str, dict[str, tuple[Counter, Counter]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, by_source in groups.items():
                names = pa.array(list(by_source), pa.string())
                parts = [pa.table({"term": pa.array(list(n), pa.binary()), "source": pa.array(np.full(len(n), k)), "n": pa.array(list(n.values()), pa.int64()), "docs": pa.array([found[t] for t in n], pa.int64())}) for k, (n, found) in enumerate(by_source.values())]
                t = pa.concat_tables(parts).group_by("term", use_threads=False).aggregate([("docs", "sum"), ("source", "list"), ("n", "list")]).combine_chunks()
                for b in t.to_batches(10_000):
                    at = b["source_list"]
                    sources = pa.ListArray.from_arrays(at.offsets, names.take(at.values))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), b["term"].cast(pa.string()), b["docs_sum"], sources, b["n_list"]], ["lang", "term", "docs", "sources", "n"])
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, found = groups.setdefault(lang, {}).setdefault(source, (Counter(), Counter()))
                seen: set[bytes] = set()
                for part in blank_slices(text.as_py()):
                    terms = part.translate(FOLD).split()
                    n.update(terms)
                    seen.update(terms)
                found.update(seen)
            if sum(len(n) for own in groups.values() for n, _ in own.values()) > HELD:
                yield from flush()
        yield from flush()
        release()

    return rows.mapInArrow(count, "lang string, term string, docs long, sources array<string>, n array<long>")


def kept_terms(counts: DataFrame, least_docs: int = 3) -> DataFrame:
    """(lang, term, total, counts): terms in enough documents of a language, their occurrences in all and by source.

    ``counts``: as ``term_counts`` gives them. Rows are dealt out by (lang, term) once; both sums are made where they arrive.
    """
    dealt = counts.repartition("lang", "term")
    # A row's documents are counted at the first of its sources.
    each = dealt.select("lang", "term", "docs", F.posexplode(F.arrays_zip("sources", "n")).alias("_at", "_s"))
    each = each.groupBy("lang", "term", F.col("_s.sources").alias("source")).agg(F.sum("_s.n").alias("n"), F.sum(F.when(F.col("_at") == 0, F.col("docs")).otherwise(0)).alias("docs"))
    got = each.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return got.where(F.col("_docs") >= least_docs).drop("_docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), exactly; null where there are no terms."""
    below = F.nullif(total + terms, F.lit(0).cast("long"))
    # Beyond 63 bits in decimals.
    large = F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), below.cast("decimal(20,0)"))
    return F.when(n < 9 * SCALE, F.call_function("div", (n + 1) * F.lit(SCALE).cast("long"), below)).otherwise(large) + 1


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    got = rows.withColumn("rank", F.row_number().over(order))
    got = got if most is None else got.where(F.col("rank") <= most)
    return got.select("lang", "source", F.lit(part).alias("part"), "item", "p", "q", "value", "rank")


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, most_terms: int = 200, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(lang, source, part, item, p, q, value, rank).

    part ``pair``: item is another source of the language and value the sum of floor((p - q)**2 / q) over its kept terms
    (p, q: null). part ``term``: item is a term that the source uses more than its language does, up to rank ``most_terms``.
    """
    kept = materialize(kept_terms(term_counts(docs, text, lang, source), least_docs), "kept-terms")
    used = kept.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    whole = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count(F.lit(1)).alias("terms"))
    groups = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source")).distinct().join(used, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = materialize(groups.na.fill(0, ["group_n", "lang_n", "terms"]), "term-groups")
    small = groups.count() <= broadcast_rows

    # Both sides of the self-join read this exchange; crossing and exploding keep its partitioning.
    dealt = kept.repartition("lang", "term") if small else kept.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    if small:
        dense = dealt.join(F.broadcast(groups), "lang")
    else:
        dense = dealt.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["lang", "_salt"])
    own = F.coalesce(F.try_element_at("counts", "source"), F.lit(0).cast("long"))
    dense = dense.select("lang", "term", "source", share(own, F.col("group_n"), F.col("terms")).alias("p"))
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = dense.join(other, ["lang", "term"]).where("source <> item").groupBy("lang", "source", "item").agg(F.sum(excess(F.col("p"), F.col("q"))).alias("value"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("q"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    uses = kept.select("lang", F.col("term").alias("item"), "total", F.explode("counts").alias("source", "n")).where("n > 0")
    uses = uses.join(F.broadcast(groups) if small else groups, ["lang", "source"])
    uses = uses.select("lang", "source", "item", share(F.col("n"), F.col("group_n"), F.col("terms")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("terms")).alias("q")).where("p > q")
    terms = uses.withColumn("value", excess(F.col("p"), F.col("q")))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term", most_terms))
