"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only.

Each source gets a target in words; a document of a source is to be copied target / source size times, between 0 and
2. The whole part of that is certain. The fractions are settled in pairs: of two documents, words move from one to
the other, in a direction drawn so that neither's expectation changes, until one fraction is 0 or 1; the other goes on
to the next pair. Words are conserved in every pair, so a source misses its target by at most half of one document: the last
fraction goes to the nearer side. Pairs form a tree: buckets of about ``bucket`` documents fold their rows into one
residual each, residuals are dealt into buckets again, until a source has one left. A hot source has more buckets,
not larger ones.

Draws are hashes of id, size and seed, and a bucket is folded from its longest document on: reruns agree, however the
input is dealt out.

Defined results: a null text has no words; documents without words and those of sources without words take nothing;
the null source is a source, last in order; rows of equal id, source and size are one unit, and each takes the same;
an empty table gives an empty result; extra columns are ignored by ``mix_sizes`` and kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, materialize, text_of, word_count

UNIT = ("id", "source", "size", "rows", "source_size", "target", "base", "p", "buckets")
SPREAD = 1 << 52


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, ...) -> the same and target.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` of all words; a target stops at
    ``most`` times its source's words, and the excess goes to the others by weight. The windows over all sources run in
    one task, on one row of five numbers per source: right for up to some ten million sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(most)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    everyone = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everyone) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    ranked = ranked.withColumn("_level", level)
    free = F.min_by("_level", F.when(F.col("_ratio") > F.col("_level"), F.col("_ratio"))).over(everyone)
    return ranked.withColumn("target", F.least(F.col("_cap"), F.coalesce(free * F.col("_w"), F.col("_cap")))).drop("_w", "_cap", "_ratio", "_level")


def _draw(*of: Column) -> Column:
    """Uniform in [0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*of), 12)).cast("double") / F.lit(float(SPREAD))


def _fold(items: Column) -> Column:
    """Settle a bucket's sorted units one after another; the last of the array has no ``bit``: the residual."""
    # The first unit opens the fold, as the residual with nothing settled.
    first, rest = F.element_at(items, 1), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    none = F.slice(F.transform(items, lambda e: F.struct(e["unit"].alias("unit"), F.lit(0).alias("bit"))), 1, 0)
    start = F.struct(first["unit"].alias("unit"), first["unit"]["p"].alias("p"), none.alias("out"))

    def step(held: Column, e: Column) -> Column:
        a, b = held["unit"], e["unit"]
        wa, wb, pa, pb = a["size"] * a["rows"], b["size"] * b["rows"], held["p"], b["p"]
        up_a, up_b, down_a, down_b = (1 - pa) * wa, pb * wb, pa * wa, (1 - pb) * wb
        x, y = F.least(up_a, up_b), F.least(down_a, down_b)
        up = e["u"] * (x + y) < y
        a_full, a_void = up & (up_a <= up_b), ~up & (down_a <= down_b)
        b_left = F.when(up, F.greatest(pb - x / wb, F.lit(0.0))).otherwise(F.least(pb + y / wb, F.lit(1.0)))
        a_left = F.when(up, F.least(pa + x / wa, F.lit(1.0))).otherwise(F.greatest(pa - y / wa, F.lit(0.0)))
        a_done = a_full | a_void
        gone = F.when(a_done, F.struct(a.alias("unit"), a_full.cast("int").alias("bit"))).otherwise(F.struct(b.alias("unit"), (~up).cast("int").alias("bit")))
        return F.struct(F.when(a_done, b).otherwise(a).alias("unit"), F.when(a_done, b_left).otherwise(a_left).alias("p"), F.concat(held["out"], F.array(gone)).alias("out"))

    return F.aggregate(rest, start, step, lambda held: F.concat(held["out"], F.array(F.struct(held["unit"].withField("p", held["p"]).alias("unit"), F.lit(None).cast("int").alias("bit")))))


def pivotal_round(units: DataFrame, most_buckets: int, bucket: int = 128, seed: int = 7) -> DataFrame:
    """``units`` (columns ``UNIT``; 0 < p < 1, size > 0) and bit, 0 or 1, with expectation p and rounded in pairs.

    ``buckets`` is the number of buckets of the unit's source in the first round, ``most_buckets`` the largest.
    """
    out, level = None, 0
    while True:
        at = F.pmod(F.xxhash64("id", "size", F.lit(seed), F.lit(level)), F.col("buckets"))
        item = F.struct((-F.col("size")).alias("large_first"), _draw(F.col("id"), F.col("size"), F.lit(seed), F.lit(level), F.lit("order")).alias("order"), _draw(F.col("id"), F.col("size"), F.lit(seed), F.lit(level), F.lit("draw")).alias("u"), F.struct(*UNIT).alias("unit"))
        folded = units.groupBy("source", at.alias("_at")).agg(F.array_sort(F.collect_list(item)).alias("_items"))
        rows = materialize(folded.select(F.explode(_fold(F.col("_items"))).alias("_e")).select("_e.unit.*", "_e.bit"), f"pivotal-{level}")
        done = rows.where("bit IS NOT NULL")
        units = rows.where("bit IS NULL").drop("bit")
        if most_buckets <= 1:
            break
        out = done if out is None else out.unionByName(done)
        most_buckets = -(-most_buckets // bucket)
        units = units.withColumn("buckets", F.ceil(F.col("buckets") / bucket))
        level += 1
    # The one left of a source goes to the nearer side: it alone decides how far the source misses its target.
    last = units.withColumn("bit", (F.col("p") >= 0.5).cast("int"))
    last = done.unionByName(last)
    return last if out is None else out.unionByName(last)


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, bucket: int = 128, seed: int = 7) -> DataFrame:
    """One row per unit (id, source, size): rows, source_size, target, copies (how often the mix takes each row)."""
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(text_of(text_col)).alias("size"))
    units = materialize(sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("_units"))
    targets = materialize(source_targets(totals, weights, share, most), "mix-targets")
    # Sources of over a thousandth of all units are broadcast; the key stands for the source, null included.
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("_key")
    total = targets.agg(F.sum("_units")).first()[0] or 0
    known = join_groups(units.select("*", key), targets.select(key, "source_size", "target", "_units"), ["_key"], "_units", total)
    known = known.withColumn("_times", F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.least(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(most))).otherwise(0.0))
    known = known.withColumn("base", F.floor("_times")).withColumn("p", F.col("_times") - F.col("base")).withColumn("buckets", F.ceil(F.col("_units") / bucket)).select(*UNIT)
    most_buckets = targets.agg(F.max(F.ceil(F.col("_units") / bucket))).first()[0] or 1
    rounded = pivotal_round(known.where("p > 0"), most_buckets, bucket, seed).unionByName(known.where("p <= 0").withColumn("bit", F.lit(0)))
    return rounded.select("id", "source", "size", "rows", "source_size", "target", (F.col("base") + F.col("bit")).alias("copies"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: ``id_col``, size, source_size, target, taken (words the mix takes of it)."""
    units = mix_sizes(docs, id_col, **options)
    each = units.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs``, each row as often as the mix takes it; the columns stay as they are."""
    units = mix_sizes(docs, id_col, text_col, source_col, **options).where("copies > 0").select(F.col("id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), F.col("copies").alias("_mix_copies"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"), word_count(text_of(text_col)).alias("_size"))
    taken = row.join(units, F.col("_id").eqNullSafe(F.col("_mix_id")) & F.col("_source").eqNullSafe(F.col("_mix_source")) & (F.col("_size") == F.col("_mix_size")))
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))).alias("_copy")).select("_row.*")
