"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

Each source's documents stand in a shuffled (hash) order as one stream of words, cut into blocks
of equal length. Slot n of the mix has the golden-ratio point frac(n * phi), which falls into one
source's interval of the cumulative weights; the source's k-th slot takes its k-th block, and runs
over the stream again (at most `ceiling` times in all) once the blocks are used up.

Defined results: null or blank texts have size 0 and are never taken; a null source is a source of
its own, ranked last; rows without a doc_id are ordered by their texts; repeated rows are documents of
their own, equal in all that orders them, so which of them is taken more often makes no difference; a
text longer than a block is taken by several slots; an empty table gives an empty result; columns
beside doc_id, text and source are ignored. Tables of sources (one row each, thousands at most) are
ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import plain
from .common import cut, offsets, small, table, word_count

#: The golden ratio as a fraction of 2**31, and the cells of the weight axis.
PHI_31 = 1327217885
CELLS = 4096


def source_targets(sized: DataFrame, ceiling: int = 3, weights: DataFrame | None = None) -> DataFrame:
    """One row for each source: sid, source, source_size, n_docs, weight, target.

    The targets share all sizes by weight; a target stops at `ceiling` times the size of its source,
    and what exceeds that is shared again among the others. Sources taken in the order of
    size / weight reach their ceiling first, so one ordered pass over the (small) table of sources
    finds the level at which none is above. weights: columns source and weight; by default 1, 2, 3
    in turn over the sources by code point.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("sid", rank.cast("long") - 1)
    if weights is None:
        s = s.withColumn("weight", (F.col("sid") % 3 + 1).cast("double"))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        s = s.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-12)))
    s = s.withColumn("_cap", F.col("source_size").cast("double") * ceiling)
    first = Window.orderBy(F.col("_cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns({"_c": F.coalesce(F.sum("_cap").over(first), F.lit(0.0)), "_w": F.coalesce(F.sum("weight").over(first), F.lit(0.0))})
    s = s.withColumns({"_size": F.sum(F.col("source_size").cast("double")).over(everything), "_all": F.sum("weight").over(everything)})
    full = F.col("_cap") * (F.col("_all") - F.col("_w")) <= F.col("weight") * (F.col("_size") - F.col("_c"))
    s = s.withColumn("_full", full)
    s = s.withColumns({
        "_rest": F.col("_size") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0.0)),
        "_share": F.col("_all") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("weight"))).over(everything), F.lit(0.0)),
    })
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_rest") * F.col("weight") / F.col("_share"))
    return s.select("sid", "source", "source_size", "n_docs", "weight", target.alias("target"))


def _streams(sized: DataFrame, sources: DataFrame, n_sources: int, docs_per_cell: int = 64) -> DataFrame:
    """Documents with words and the place `start` of their first word in their source's shuffled stream.

    Order: md5 of doc_id, or of the text where that is null. A cell is a range of md5 values that holds about 64 documents, so even a
    source with a third of all rows is spread over many tasks.
    """
    d = sized.where("size > 0")
    s = sources.select(F.col("source").alias("_s"), "sid", "source_size", "block", "_take", F.ceil(F.col("n_docs") / docs_per_cell).alias("_cells"))
    d = d.join(small(s, n_sources), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    unit = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    d = d.withColumn("cell", F.floor(unit * F.col("_cells"))).drop("_cells")
    before = Window.partitionBy("sid", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    base = offsets(d.groupBy("sid", "cell").agg(F.sum("size").alias("v")), ["sid"], "cell", "v", "_base")
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return d.join(base, ["sid", "cell"]).withColumn("start", F.col("_base") + F.col("_in")).drop("_base", "_in", "cell", "h")


def _slots(spark, sources: DataFrame, n_sources: int, n_slots: int) -> DataFrame:
    """sid, slot (place in the mix) and k (rank within the source), `quota` of them for each source."""
    q = sources.select("sid", "quota", "_edge").where("quota > 0")
    at = lambda c: F.floor(F.col(c).cast("double") / n_slots * CELLS)
    spans = q.withColumn("_end", F.col("_edge") + F.col("quota")).withColumn("cell", F.explode(F.sequence(at("_edge"), F.least(at("_end"), F.lit(CELLS - 1)))))
    n = spark.range(n_slots).withColumnRenamed("id", "slot")
    point = (F.pmod(F.col("slot"), F.lit(2**31)) * F.lit(PHI_31)) % F.lit(2**31)
    n = n.withColumn("_u", point.cast("double") / float(2**31)).withColumns({"cell": F.floor(F.col("_u") * CELLS), "_v": F.floor(F.col("_u") * n_slots)})
    hit = n.join(small(spans, n_sources), "cell").where("_v >= _edge and _v < _end")
    hit = hit.select("sid", "slot", "quota", F.floor(F.col("slot") / 256).alias("chunk"))
    base = offsets(hit.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("v")), ["sid"], "chunk", "v", "_base")
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    hit = hit.withColumn("_r", rank).join(base, ["sid", "chunk"]).select("sid", "slot", (F.col("_base") + F.col("_r")).alias("k"), "quota").where("k < quota")
    got = hit.groupBy("sid").agg(F.count(F.lit(1)).alias("_got"))
    lack = q.join(got, "sid", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).where("_got < quota")
    lack = lack.withColumn("k", F.explode(F.sequence("_got", F.col("quota") - 1)))
    # the schedule misses a quota by a few slots at most: these close the mix
    return hit.select("sid", "slot", "k").unionByName(lack.select("sid", (F.lit(n_slots) + F.col("_edge") + F.col("k")).alias("slot"), "k"))


def mix(docs: DataFrame, block_words: int = 1024, ceiling: int = 3, least_blocks: int = 256, weights: DataFrame | None = None):
    """The mix as rows (slot, sid, start, doc_id, source, size, pass, from_word, to_word), and the tables it is built on.

    A row says that the slot takes words from_word up to to_word (exclusive) of the document. A block has
    block_words words, or fewer where a target would otherwise be made of under least_blocks blocks.
    Returns (mix, sized documents, sources).
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(name.cast("binary")).alias("h")))
    s = source_targets(sized, ceiling, weights).withColumn("_take", F.floor("target"))
    s = s.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("_take") / least_blocks), F.col("source_size"))).cast("long"))
    blocks = F.ceil(F.col("source_size") / F.col("block"))
    whole = F.expr("case when source_size > 0 then _take div source_size else 0 end")
    s = s.withColumns({"blocks": blocks, "_whole": whole})
    s = s.withColumn("quota", F.col("_whole") * F.col("blocks") + F.ceil((F.col("_take") - F.col("_whole") * F.col("source_size")) / F.col("block")))
    s = s.withColumn("_edge", F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("quota"))
    s = cut(s)
    n_sources, n_slots = s.agg(F.count(F.lit(1)), F.coalesce(F.sum("quota"), F.lit(0))).first()
    placed = _streams(sized, s, n_sources)
    # blocks that begin beyond the target are never taken
    pieces = placed.where("start < _take").withColumn("b", F.explode(F.sequence(F.expr("start div block"), F.expr("(least(start + size, _take) - 1) div block"))))
    pieces = pieces.withColumns({"_from": F.greatest("start", F.col("b") * F.col("block")), "_to": F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * F.col("block"))}).drop("block", "source_size", "_take")
    slots = _slots(spark, s, n_sources, max(1, n_slots)).join(small(s.select("sid", "blocks", "source_size", "_take"), n_sources), "sid")
    slots = slots.withColumns({"pass": F.expr("k div blocks"), "b": F.expr("k % blocks")}).withColumn("_left", F.col("_take") - F.col("pass") * F.col("source_size"))
    taken = pieces.join(slots.select("sid", "b", "slot", "pass", "_left"), ["sid", "b"]).withColumn("_to", F.least("_to", "_left")).where("_to > _from")
    rows = taken.select("slot", "sid", "start", "doc_id", "source", "size", "pass", (F.col("_from") - F.col("start")).alias("from_word"), (F.col("_to") - F.col("start")).alias("to_word"))
    return rows, sized, s


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each as often as the mix takes its first word, with all its columns.

    Repeated rows with one doc_id, source and size share their copies evenly, rounded up.
    """
    rows, sized, _ = mix(docs, **options)
    keys = ["doc_id", "source", "size"]
    copies = rows.where("from_word = 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("start").alias("_k"))
    twins = sized.where("size > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    copies = copies.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n")
    twins = twins.select(*[F.col(k).alias(f"_{k}") for k in keys], "_rows").where("_rows > 1")
    same = lambda a, b: [a[f"_{k}"].eqNullSafe(b[f"_{k}"]) for k in keys]
    j = copies.join(twins, same(copies, twins), "left").select(*[copies[f"_{k}"] for k in keys], F.ceil(F.col("_n") / F.coalesce("_rows", F.lit(1))).alias("_copies"))
    own = plain(docs.columns)
    doc_id, source, text = (own[docs.columns.index(c)] for c in ("doc_id", "source", "text"))
    d = docs.toDF(*own).withColumn("_words", word_count(F.col(text)))
    on = F.col(doc_id).eqNullSafe(j["_doc_id"]) & F.col(source).eqNullSafe(j["_source"]) & (d["_words"] == j["_size"])
    return d.join(j, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*own).toDF(*docs.columns)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    rows, sized, s = mix(table(spark, sf_dir, "documents"))
    n_sources = s.count()
    keys = ["sid", "start", "doc_id", "size"]
    # a slot takes one block, and of a block a document is one piece
    took = rows.groupBy(*keys).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    placed = _streams(sized, s, n_sources).select(*keys)
    on = [placed[k].eqNullSafe(took[k]) for k in keys]
    d = placed.join(took, on, "left").select(placed["sid"], placed["doc_id"], placed["size"], F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).alias("n_slots"))
    blank = sized.where("size = 0").join(small(s.select(F.col("source").alias("_s"), "sid"), n_sources), F.col("source").eqNullSafe(F.col("_s")))
    none = F.lit(0).cast("long")
    d = d.unionByName(blank.select("sid", "doc_id", "size", none.alias("taken"), F.lit(None).cast("long").alias("first_slot"), none.alias("n_slots")))
    return d.join(small(s.select("sid", "source_size", "target"), n_sources), "sid").select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


SQL = r"""
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '-' || md5(coalesce(text, '')))) h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
g as (select source, sum(size)::bigint source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 sid from g),
w as (select *, (sid % 3 + 1)::double weight, 3.0::double * source_size::double cap from r),
c as (select *, coalesce(sum(cap) over before, 0) c0, coalesce(sum(weight) over before, 0) w0,
             sum(source_size::double) over () total, sum(weight) over () all_w
      from w window before as (order by cap / weight, sid rows between unbounded preceding and 1 preceding)),
f as (select *, cap * (all_w - w0) <= weight * (total - c0) is_full from c),
t as (select *, case when is_full then cap else
             (total - coalesce(sum(case when is_full then cap end) over (), 0)) * weight
             / (all_w - coalesce(sum(case when is_full then weight end) over (), 0)) end target from f),
b0 as (select *, floor(target)::bigint take, greatest(1, least(1024, floor(target)::bigint // 256, source_size))::bigint block from t),
b1 as (select *, (source_size + block - 1) // block blocks, case when source_size > 0 then take // source_size else 0 end whole from b0),
b2 as (select *, (whole * blocks + (take - whole * source_size + block - 1) // block)::bigint quota from b1),
b as (select *, (sum(quota) over (order by sid rows unbounded preceding) - quota)::bigint edge, (sum(quota) over ())::bigint slots from b2),
n as (select slot, floor((slot % 2147483648 * 1327217885 % 2147483648)::double / 2147483648.0::double * (select any_value(slots) from b))::bigint v from (select unnest(range((select any_value(slots) from b))) slot)),
h as (select sid, slot, row_number() over (partition by sid order by slot) - 1 k from n join b on v >= edge and v < edge + quota),
k as (select h.sid, slot, k from h join b using (sid) where k < quota
      union all select sid, slots + edge + i, i from (select *, unnest(range(coalesce((select count(*) from h where h.sid = b.sid), 0), quota)) i from b)),
s as (select k.sid, slot, k % blocks bl, take - k // blocks * source_size remains from k join b using (sid)),
p as (select row_number() over () id, d.doc_id, d.size, b.sid, b.source_size, b.target, b.take, b.block,
             sum(d.size) over (partition by b.sid order by d.h, d.doc_id, d.size rows unbounded preceding)::bigint - d.size o
      from d join b on d.source is not distinct from b.source),
q as (select p.*, unnest(range(o // block, (least(o + size, take) - 1) // block + 1)) bl from p where size > 0 and o < take),
u as (select q.id, min(slot)::bigint first_slot, count(*) n_slots from q join s on s.sid = q.sid and s.bl = q.bl
      where least(o + size, (q.bl + 1) * block, remains) > greatest(o, q.bl * block) group by 1)
select doc_id, size, source_size, target,
       (greatest(0, least(o + size, take) - o) + greatest(0, least(source_size + o + size, take) - source_size - o)
        + greatest(0, least(2 * source_size + o + size, take) - 2 * source_size - o))::bigint taken, first_slot, coalesce(n_slots, 0) n_slots from p left join u using (id)
"""
