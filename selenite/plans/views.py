"""Views that bind the operators to the driver's tables, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

PX = "select cast(floor(event_id/100) as int) y, cast(event_id%100 as int) x, least(value, cast(255 as double)) dn from events"
TIE0 = """select l_suppkey%8 job, row_number() over (partition by l_suppkey%8 order by l_orderkey,l_linenumber,l_partkey,l_suppkey,
 l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate,l_returnflag,l_linestatus) i,
 (l_partkey*7)%1000 + l_tax*10 rx, (l_orderkey*13)%1000 + l_discount*5 ry, l_quantity q, l_linenumber ln, 1-l_discount*5 conf from lineitem"""
TIE = f"""select cast(job as bigint) job, cast(i as bigint) i, cast(1.03 as double)*rx+cast(0.02 as double)*ry+5+q/50+case when ln=7 then 40 else 0 end sx,
 cast(1.02 as double)*ry-cast(0.015 as double)*rx+20 sy, rx, ry, conf from ({TIE0}) tie0"""
TELEM = "select p_partkey id, cast(p_size as double)/4 gsd, p_retailprice-90*floor(p_retailprice/90) inc from part"
BOXES = """select s_suppkey id, lat_min, least(lat_min+8, cast(90 as double)) lat_max, lon_min, lon_min+40 lon_max from (select s_suppkey,
 cast((s_suppkey*37)%170-85 as double) lat_min, cast((s_suppkey*53)%360-180 as double) lon_min from supplier) t"""
JOB_EV = """select user_id job, ts, event_id, case event_type when 'signup' then 'queued' when 'view' then 'processing'
 when 'click' then 'progress' when 'purchase' then 'complete' else 'failed' end kind from events"""
TAGS = (
    "select page_id, cast(pos as bigint) ord, tag from pages lateral view posexplode(regexp_extract_all(html,'<([a-z0-9]+)[^>]*>',1)) t as pos, tag",
    "select page_id, unnest(range(len(a))) ord, unnest(a) tag from (select page_id, regexp_extract_all(html,'<([a-z0-9]+)[^>]*>',1) a from pages)",
)

SPARK = {"px": PX, "tie": TIE, "telem": TELEM, "boxes": BOXES, "job_ev": JOB_EV, "html_tags": TAGS[0]}
DUCK = {**SPARK, "html_tags": TAGS[1]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir, or a view over its tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("tie", "tie_unnumbered"):
        return _ties(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), name == "tie")
    sql = SPARK[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"from {t}" in sql}
    for t in used:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(sql, **used)


#: A cell of the ties' numbering has 2**CELL consecutive orders; a cell of a job is ranked in one task.
CELL = 14
#: What a tie's columns are made from, and its places.
COMPACT = ["(l_partkey * 7) % 1000 + l_tax * 10 rx", "(l_orderkey * 13) % 1000 + l_discount * 5 ry", "q", "ln", "1 - l_discount * 5 conf"]
PLACE = ["cast(1.03 as double) * rx + cast(0.02 as double) * ry + 5 + q / 50 + case when ln = 7 then 40 else 0 end sx", "cast(1.02 as double) * ry - cast(0.015 as double) * rx + 20 sy", "rx", "ry", "conf"]


def tie_lines(lines: DataFrame) -> DataFrame:
    """The table's rows with job and cell of their ties."""
    return lines.selectExpr(
        "cast(l_suppkey % 8 as bigint) job", f"cast(shiftright(l_orderkey, {CELL}) as bigint) cell", "l_quantity q", "l_linenumber ln",
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus",
    )


def tie_bases(t: DataFrame) -> DataFrame:
    """job, cell, n (its ties) and _base, the ties of the job in the cells before."""
    before = Window.partitionBy("job").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return t.groupBy("job", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def numbered_ties(t: DataFrame, bases: DataFrame) -> DataFrame:
    """job, i and COMPACT of rows of tie_lines(), which may be some of the table's as long as their cells are whole; bases are the whole table's.

    Numbers run within cells of consecutive orders and then over the cells' counts, so no job is ranked in one task.
    """
    order = ["l_orderkey", "ln", "l_partkey", "l_suppkey", "q", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    rank = F.row_number().over(Window.partitionBy("job", "cell").orderBy(*order))
    return t.withColumn("_rank", rank).join(bases.select("job", "cell", "_base"), ["job", "cell"]).selectExpr("job", "_base + _rank i", *COMPACT)


def _ties(lines: DataFrame, numbered: bool) -> DataFrame:
    """The view tie, or without i where nothing reads it: the number is what costs a shuffle and a join."""
    t = tie_lines(lines)
    return numbered_ties(t, tie_bases(t)).selectExpr("job", "i", *PLACE) if numbered else t.selectExpr("job", *COMPACT).selectExpr("job", *PLACE)


def duck(sql: str, *names: str) -> str:
    """The SQL with the views it needs in front."""
    return "with " + ", ".join(f"{n} as ({DUCK[n]})" for n in names) + (", " if sql.lstrip().startswith("+") else " ") + sql.lstrip().removeprefix("+")
